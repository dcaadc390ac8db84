"""Indexed search over texts: prefixes of words, substrings by runs of three bytes, near strings by segments.

All three find candidates by equi-joins on short keys and end with the exact test, so their results are
those of testing every pair, and no pair of texts that share nothing is ever made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..sources.shared import written

# --- words by prefix: an inverted index --------------------------------------------------------------

#: Prefixes up to which a search sends its ranges down to the scan of the dictionary.
RANGES_PUSHED = 200


@dataclass(frozen=True)
class WordIndex:
    """An inverted index in a folder.

    postings/ holds (word, id) in order of both, dealt by ranges into buckets, a folder each; a word of very
    many rows may fill several. dictionary/ holds (word, bucket, n), in order of the word: a prefix is a range
    of it, which Parquet's statistics cut out of the scan.
    """

    spark: SparkSession
    path: str

    @staticmethod
    def build(rows: DataFrame, words: Column, path: str, id_column: str = "id", buckets: int | None = None) -> WordIndex:
        """Index rows by their distinct words (an array; nulls and empty words are left out)."""
        spark = rows.sparkSession
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        pairs = rows.select(F.explode(F.array_distinct(words)).alias("word"), F.col(id_column).alias("id")).where("word != ''")
        dealt = pairs.repartitionByRange(n, "word", "id").sortWithinPartitions("word", "id").withColumn("bucket", F.spark_partition_id())
        dealt.write.partitionBy("bucket").parquet(f"{path}/postings")
        index = WordIndex(spark, path)
        index.postings().groupBy("word", "bucket").agg(F.count("*").alias("n")).repartitionByRange(n, "word").sortWithinPartitions("word").write.parquet(f"{path}/dictionary")
        return index

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def dictionary(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/dictionary")

    def resolve(self, terms: DataFrame) -> DataFrame:
        """(term, word, bucket, n) of the words that each distinct term begins."""
        asked = terms.select("term").distinct()
        size = asked.agg(F.count("*").alias("n"), F.collect_set(F.length("term")).alias("lengths")).first()
        words = self.dictionary()
        if 0 < size["n"] <= RANGES_PUSHED:
            ranges = [F.col("word").startswith(r["term"]) for r in asked.collect()]
            some = ranges[0]
            for more in ranges[1:]:
                some = some | more
            words = words.where(some)
        fronts = F.array_distinct(F.array(*(F.substring("word", 1, k) for k in sorted(size["lengths"])))) if size["n"] else F.array().cast("array<string>")
        return words.select("word", "bucket", "n", F.explode(fronts).alias("term")).join(asked, "term")

    def search(self, queries: DataFrame, terms: Column) -> DataFrame:
        """(query_id, id) of the rows in which every term of a query begins some word. queries: query_id and what
        `terms` (an array of lower-case terms) is made of. A query without terms filters nothing and has no rows here."""
        asked = queries.select("query_id", F.explode(F.array_distinct(terms)).alias("term")).where("term != ''")
        found = written(self.resolve(asked), "resolved")
        buckets = [r["bucket"] for r in found.select("bucket").distinct().collect()]
        wanted = asked.join(found.select("term", "word").distinct(), "term")
        held = self.postings().where(F.col("bucket").isin(buckets)).select("word", "id").join(wanted, "word").select("query_id", "term", "id").distinct()
        sizes = asked.groupBy(F.col("query_id").alias("_q")).agg(F.count_distinct("term").alias("_terms"))
        met = held.groupBy("query_id", "id").agg(F.count("*").alias("_met"))
        return met.join(sizes, F.col("query_id").eqNullSafe(F.col("_q")) & (F.col("_met") == F.col("_terms"))).select("query_id", "id")


# --- substrings: runs of bytes ---------------------------------------------------------------------------

GRAM = 3
#: Runs of one, two and GRAM bytes are numbered, the longer after the shorter; CODES is above them all.
FIRST = {1: 1, 2: 1 + 256, 3: 1 + 256 + 256**2}
CODES = 1 + 256 + 256**2 + 256**3
#: Bytes of text that one numpy pass handles, bits of one of Spark's bitmaps, passages that one list of a text holds (about).
SLICE_BYTES, BITMAP_BITS, PASSAGES_AT_ONCE = 1 << 19, 8 * 4096, 4096


def _runs(batch: pa.RecordBatch, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, run) of the wanted runs in the texts of a batch, each once a row."""
    texts = batch.column("_text")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE_BYTES, side="right")) - 1)
        if offsets[high] > offsets[low]:
            data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[low] : offsets[high]]
            places, code, found = offsets[low : high + 1] - offsets[low], np.zeros(len(data), dtype=np.int32), []
            for size, first in FIRST.items():
                n = len(data) - size + 1
                if n < 1:
                    break
                code = (code[:n] << 8) | data[size - 1 :]
                if not wanted[first : first + 256**size].any():
                    continue
                hit = wanted[code + first]
                for k in range(1, size):  # runs that would end in the next row
                    last = places[1:] - k
                    hit[last[(last >= 0) & (last < n)]] = False
                at = np.flatnonzero(hit)
                found.append((np.searchsorted(places, at, side="right") - 1) * CODES + code[at] + first)
            both = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
            yield low + both // CODES, (both % CODES).astype(np.int32)
        low = high


def _with_runs(texts: DataFrame, key: str, wanted: DataFrame | None = None, counted: bool = False) -> DataFrame:
    """(key, gram): the runs in each text (_text, not null), of those in `wanted`; or (gram, n): numbers of texts, to be summed."""
    maps = None
    if wanted is not None:  # 2 MB at most: a bit for each run that there can be
        maps = [tuple(r) for r in wanted.groupBy(F.bitmap_bucket_number("gram").alias("i")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("gram")).alias("bits")).collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.full(-(-CODES // BITMAP_BITS) * BITMAP_BITS + 1, maps is None)
        for i, bits in maps or ():
            held[1 + (i - 1) * BITMAP_BITS : 1 + i * BITMAP_BITS] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little")
        for batch in batches:
            for row, gram in _runs(batch, held):
                if counted:
                    gram, n = np.unique(gram, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n.astype(np.int64))], names=["gram", "n"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row)), pa.array(gram)], names=[key, "gram"])

    if counted:
        return texts.select("_text").mapInArrow(run, "gram int, n long")
    return texts.select(key, "_text").mapInArrow(run, StructType([texts.schema[key], StructField("gram", IntegerType())]))


def _met_by_runs(plain: DataFrame, asked: DataFrame) -> DataFrame:
    """(_asked, _key) of the texts that hold a passage's rarest run of GRAM bytes (of a shorter passage: the whole)."""
    size = F.least(F.octet_length("_text"), F.lit(GRAM))
    least = F.coalesce(*(F.when(size == k, F.lit(first)) for k, first in FIRST.items()))
    texts = asked.select("_asked", F.col("_passage").alias("_text"))
    own = written(_with_runs(texts, "_asked").join(texts.select("_asked", least.alias("least")), "_asked").where("gram >= least").select("_asked", "gram"), "passage-runs")
    n = _with_runs(plain, "_key", own, counted=True).groupBy("gram").agg(F.sum("n").alias("n"))
    rarest = own.join(n, "gram", "left").groupBy("_asked").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    rarest = written(rarest, "rarest-runs")
    return _with_runs(plain, "_key", rarest).join(rarest, "gram").select("_asked", "_key")


def _containing(plain: DataFrame, asked: DataFrame, met: DataFrame) -> DataFrame:
    """(_key, _asked) of the pairs met where the text contains the passage. A text meets all its passages at once and is dealt once, not once a pair."""
    lists = max(1, -(-asked.count() // PASSAGES_AT_ONCE))
    passages = F.collect_set(F.struct("_asked", "_passage")).alias("_passages")
    listed = met.join(asked, "_asked").groupBy(F.col("_key").alias("_of"), F.pmod(F.xxhash64("_asked"), F.lit(lists)).alias("_list")).agg(passages)
    told = plain.join(listed, F.col("_key").eqNullSafe(F.col("_of")))
    held = F.filter("_passages", lambda p: F.col("_text").contains(p["_passage"]))
    return told.select("_key", F.explode(F.transform(held, lambda p: p["_asked"])).alias("_asked"))


def _texts_and_passages(rows: DataFrame, key: str, text: str, passages: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(_key, _text) of the rows that have a text; (_asked, _passage) of the distinct passages."""
    plain = rows.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_text IS NOT NULL")
    return plain, written(passages.select("_passage").distinct().withColumn("_asked", F.monotonically_increasing_id()), name)


def substring_pairs(rows: DataFrame, key: str, text: str, tokens: DataFrame, token: str = "token") -> DataFrame:
    """Distinct (key, token) where the row's text contains the token: `LIKE '%token%'` for a batch of tokens.

    A token meets the texts that hold its rarest run of three bytes (of shorter tokens: the token itself), then
    the exact test. Null and empty tokens, and null texts, have no pairs. Keys must be unique.
    """
    plain, asked = _texts_and_passages(rows, key, text, tokens.select(F.col(token).alias("_passage")).where("_passage != ''"), "tokens")
    return _containing(plain, asked, _met_by_runs(plain, asked)).join(asked, "_asked").select(F.col("_key").alias("key"), F.col("_passage").alias("token"))


#: A word, or a run of white space.
PIECE = r"[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def passage_pairs(docs: DataFrame, key: str, text: str, passages: DataFrame, passage_key: str, passage: str) -> DataFrame:
    """(passage key, key) where a document contains a passage whole.

    A passage meets the documents that hold its rarest inner word; passages without one (two words at most)
    meet those that hold their rarest run of three bytes; then the exact test. Rows of one passage are looked for
    once. Null and empty passages have no pairs.
    """
    rows = passages.select(F.col(passage_key).alias("_item"), F.col(passage).alias("_passage")).where("_passage != ''")
    plain, asked = _texts_and_passages(docs, key, text, rows, "passages")
    pieces = lambda c: F.regexp_extract_all(c, F.lit(PIECE), F.lit(0))
    cut = asked.withColumn("_pieces", pieces("_passage"))
    inner = F.array_distinct(F.filter(F.slice("_pieces", 2, F.greatest(F.size("_pieces") - 2, F.lit(0))), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    cut = written(cut.select("_asked", "_passage", inner.alias("_inner")), "cut-passages")
    words, short = cut.select("_asked", F.explode("_inner").alias("piece")), cut.where("size(_inner) = 0")
    met = []
    if not words.isEmpty():
        held = plain.select("_key", F.explode(F.array_distinct(pieces("_text"))).alias("piece"))
        found = written(held.join(words.select("piece").distinct(), "piece"), "held")
        df = found.groupBy("piece").agg(F.count("*").alias("n"))
        rarest = words.join(df, "piece", "left").groupBy("_asked").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("piece"))
        met.append(found.join(rarest, "piece").select("_asked", "_key"))
    if not met or not short.isEmpty():
        met.append(_met_by_runs(plain, short))
    exact = _containing(plain, asked, met[0] if len(met) == 1 else met[0].unionByName(met[1]))
    return exact.join(rows.join(asked, "_passage").select("_item", "_asked"), "_asked").select(F.col("_item").alias(passage_key), F.col("_key").alias(key))


# --- near strings: segments ------------------------------------------------------------------------------


#: Bits of the map of hashes that substrings are held against, and hashes that one numpy pass makes (about).
MAP_BITS, HASHES_AT_ONCE = 26, 1 << 20
_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _edits(n: int, ratio: float) -> tuple[int, int]:
    """The longest partner of a text of n characters, and the edits between two that long."""
    longest = int(n / ratio + 1e-9)
    return longest, int((1 - ratio) * longest + 1e-9)


@lru_cache(maxsize=4096)
def _places(size: int, n: int, ratio: float, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and number of the segments of a text of n characters (own), or of all substrings of one of `size` that could be them."""
    edits = _edits(n, ratio)[1]
    t = min(edits, n - 1)
    i = np.arange(t + 1)
    at = n * i // (t + 1)
    width = n * (i + 1) // (t + 1) - at
    if own:
        return at, at + width, i
    # Every edit may be needed to the left of the segment or to the right of it; texts shorter than t + 1 segments may spend all.
    spare, delta = edits - t, size - n
    low = np.maximum(np.maximum(at - i - spare, at + delta - (t - i) - spare), 0)
    high = np.minimum(np.minimum(at + i + spare, at + delta + (t - i) + spare), size - width)
    many = np.maximum(high - low + 1, 0)
    begin = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return begin, begin + np.repeat(width, many), np.repeat(i, many)


def _segment_keys(texts: DataFrame, key: str, text: str, ratio: float, known: DataFrame | None = None) -> DataFrame:
    """(key, h): hashes of (length, number, segment) of each text; with known hashes, of the substrings that could be a partner's segments, as far as a map of
    the known ones (8 MB) has them."""
    maps = None
    if known is not None:
        slots = known.select((F.shiftrightunsigned("h", 64 - MAP_BITS) + 1).alias("slot"))
        maps = [tuple(r) for r in slots.groupBy(F.bitmap_bucket_number("slot").alias("i")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        if maps is not None:
            held = np.zeros((1 << MAP_BITS) // 8, dtype=np.uint8)
            for i, bits in maps:
                held[(i - 1) * BITMAP_BITS // 8 : i * BITMAP_BITS // 8] = np.frombuffer(bits, dtype=np.uint8)
        odd = [np.uint64(x) for x in _ODD]
        back = np.uint64(pow(_ODD[0], -1, 1 << 64))
        for batch in batches:
            codes = [np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) for t in batch.column(text).to_pylist()]
            sizes = np.array([len(c) for c in codes])
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                up, down = (np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size, x, dtype=np.uint64)]), dtype=np.uint64) for x in (odd[0], back))
                lengths = [size] if held is None else range(max(math.ceil(size * ratio - 1e-9), 1), _edits(size, ratio)[0] + 1)
                step = max(1, HASHES_AT_ONCE // (size + 1))
                for first in range(0, len(rows), step):
                    some = rows[first : first + step]
                    sums = np.zeros((len(some), size + 1), dtype=np.uint64)
                    np.cumsum((np.stack([codes[r] for r in some]).astype(np.uint64) + np.uint64(1)) * odd[1] * up[:size], axis=1, out=sums[:, 1:])
                    for n in lengths:
                        begin, end, number = _places(size, n, ratio, held is None)
                        salt = (number.astype(np.uint64) * odd[1] + np.uint64(n)) * odd[2]
                        wide = max(1, HASHES_AT_ONCE // max(len(begin), 1))
                        for low in range(0, len(some), wide):
                            h = (sums[low : low + wide][:, end] - sums[low : low + wide][:, begin]) * down[begin] + salt
                            h = (h ^ (h >> np.uint64(29))) * odd[2]
                            h ^= h >> np.uint64(32)
                            h *= odd[1]
                            row, at = np.nonzero(np.ones(h.shape, dtype=bool) if held is None else _known(h, held))
                            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(some[low + row])), pa.array(h[row, at].view(np.int64))], names=[key, "h"])

    return texts.select(key, text).mapInArrow(run, StructType([texts.schema[key], StructField("h", LongType())]))


def _known(h: np.ndarray, held: np.ndarray) -> np.ndarray:
    slot = h >> np.uint64(64 - MAP_BITS)
    return (held[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def near_pairs(left: DataFrame, left_key: str, left_text: str, right: DataFrame, right_key: str, right_text: str, ratio: float = 0.92) -> DataFrame:
    """(left key, right key, ratio) of the texts whose Levenshtein ratio is at least `ratio` (0.5 at least).

    A pair of that ratio is at most t edits apart, t being (1 - ratio) of the longer length. So cut into t + 1
    segments, one segment of the right text stands unchanged in the left one, shifted by no more than the edits
    left to either side of it. Right texts are keyed by a hash of (length, number, segment); left texts by those of the
    substrings that could be that segment, for every length that a partner may have, as far as a bitmap of the right texts' hashes knows them. Empty and null texts have no
    pairs. Keys are joined by equality; every pair found is measured exactly, so hashes only save work. Texts meet once, however many rows
    have them: rows come back to the pairs of different texts at the end.
    """
    if not 0.5 <= ratio < 1:
        raise ValueError("ratio from 0.5 to below 1")
    def keyed(df: DataFrame, key: str, text: str, names: tuple[str, str]) -> DataFrame:
        return df.select(F.col(key).alias(names[0]), F.col(text).alias(names[1])).where(f"{names[1]} != ''")

    rows_a, rows_b = keyed(left, left_key, left_text, ("_a", "_x")), keyed(right, right_key, right_text, ("_b", "_y"))
    texts = lambda df, text, name: written(df.select(text).distinct().withColumn(name, F.monotonically_increasing_id()), "near-texts")
    a, b = texts(rows_a, "_x", "_i"), texts(rows_b, "_y", "_j")
    # Few bytes of text make very many substrings: as many tasks as there may be.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = lambda df, *key: df.repartition(tasks, *key)
    keys = written(_segment_keys(spread(b, "_j"), "_j", "_y", ratio), "near-keys")
    asked = _segment_keys(spread(a, "_i"), "_i", "_x", ratio, keys)
    met = spread(spread(asked, "h").join(spread(keys, "h"), "h").select("_i", "_j"), "_i", "_j").distinct()
    told = met.join(a, "_i").join(b, "_j")
    most = F.greatest(F.length("_x"), F.length("_y"))
    # Beyond the edits that the ratio leaves, distances are not worked out: -1.
    edits = F.call_function("levenshtein", F.col("_x"), F.col("_y"), F.floor(most * (1 - ratio) + 1e-6).cast("int") + 1)
    found = told.withColumn("edits", edits).where("edits >= 0").withColumn("ratio", 1 - F.col("edits") / most).where(F.col("ratio") >= ratio - 1e-12).drop("edits")
    return found.drop("_i", "_j").join(rows_a, "_x").join(rows_b, "_y").select(F.col("_a").alias(left_key), F.col("_b").alias(right_key), "ratio")
