"""Ranked lexical search by bag deduplication.

Items (queries) are ranked against all documents. What a document scores depends on its bag alone:
how often it holds each term of the items' vocabulary, and its length class m. So documents are
restricted to that vocabulary, those of identical bag and m form one class, and each class is scored
once; its members share the score and follow in ascending id. Copies of a text, however many, and
short texts that hold the same few terms cost one scoring.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII in the whole text;
only A-Z are lower-cased. Document length n counts all terms of a document with repeats, N the
documents that have a term, L the terms of all of them, df the documents that hold a term, tf the
occurrences in a document. With integer division rounding down,

    w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))          in doubles
    m = 100 - 90 + (90 * n * N) div L
    score = sum of w * ((1000000000 * tf) div (1000 * tf + 8 * m))   over the item's terms, once each.

How it runs:

1. The items' terms are counted. Up to TERMS_AT_ONCE of them the items are one block; more items are
   dealt into blocks by a hash, each of about that many terms, and the passes below run once a block.
   So what a pass sends to the workers (its vocabulary, its items) is bounded whatever the items are.
2. One pass over the texts: a row for each document with its length and its bag, entries sorted by
   term. Terms are compared as strings, not as hashes. Written, since all that follows reads it.
3. N, L and df by partial aggregates over the written bags.
4. Classes: rows are dealt by a hash of bag and m, and grouped by bag and m themselves, so equal
   hashes of different bags stay apart. Of a class only its `k` least ids can be among an item's `k`
   best; they are cut to `k` before the shuffle, so a class of a third of all rows sends `k` rows a task.
5. One pass over the classes: sums of a slice of classes by all items of the block in 64-bit
   integers; a task keeps `k` classes an item (of highest score, then of least first id), which hold
   its `k` best documents, and sends them to the final ranking.

Defined results: a null or empty text has no terms and is ranked for nothing; an item without terms has no
rows; rows of one item_id are one item with the terms of all of them, a null id included; each row of
the documents is a document, repeated rows too, and null ids come after all others; a document with
score 0 is not ranked; equal scores go by ascending id; empty tables give no rows; other columns are
not read. Very long texts are read whole, as a slice of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import map_batches, release, settle, text_or_empty
from ._text import buffers, slices, words

#: The pattern of a term, as SQL has it.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms of the items, counted once an item, that one block holds, about; and items of a block, about.
TERMS_AT_ONCE, ITEMS_AT_ONCE = 1 << 20, 1 << 13
#: Scores that a numpy pass adds up, and term matches that it spreads to items.
SCORES_AT_ONCE, MATCHES_AT_ONCE = 1 << 21, 1 << 21

_CODES = np.arange(256)
_CAPITAL = (_CODES >= 65) & (_CODES <= 90)
GAPS = ~(_CAPITAL | ((_CODES >= 97) & (_CODES <= 122)) | ((_CODES >= 48) & (_CODES <= 57)) | (_CODES >= 128))
LOWERED = np.where(_CAPITAL, _CODES + 32, _CODES).astype(np.uint8)


def terms_of(column: str) -> Column:
    """The terms of a text column, with repeats."""
    return F.regexp_extract_all(F.translate(text_or_empty(column), UPPER, LOWER), F.lit(TERM), 0)


def term_lists(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(terms, first): the terms of row i are first[i]:first[i + 1]."""
    starts, ends, first = words(data, offsets, GAPS)
    edges = np.empty(2 * len(starts) + 1, dtype=np.int64)
    edges[0:-1:2], edges[1::2], edges[-1] = starts, ends, ends[-1] if len(ends) else 0
    both = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(edges), pa.py_buffer(LOWERED[data])])
    return both.take(pa.array(np.arange(0, 2 * len(starts), 2))), first


def _bag_rows(vocabulary: pa.Array):
    """Length and bag of each document: entries term << 32 | tf, in order of the term."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "_text"):
            terms, first = term_lists(*buffers(part.column("_text")))
            n = np.diff(first)
            at = pc.fill_null(pc.index_in(terms, value_set=vocabulary), -1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            entries, tf = np.unique((row << 32 | at)[at >= 0], return_counts=True)
            bounds = np.searchsorted(entries >> 32, np.arange(len(n) + 1))
            bag = (entries & 0xFFFFFFFF) << 32 | tf
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(bag))], names=["doc_id", "_n", "_bag"])

    return rows


class Items:
    """A block's items as rows of terms, and the weight of each term."""

    def __init__(self, ids: list, of_term: np.ndarray, item: np.ndarray, weight: np.ndarray) -> None:
        order = np.lexsort((item, of_term))
        self.n, self.weight, self.item = len(ids), weight, item[order]
        self.first = np.searchsorted(of_term[order], np.arange(len(weight) + 1))

    def score(self, bag: np.ndarray, bounds: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Scores, classes x items, in 64-bit integers."""
        out = np.zeros(len(m) * self.n, dtype=np.int64)
        term, tf = bag >> 32, bag & 0xFFFFFFFF
        own = np.repeat(np.arange(len(m)), np.diff(bounds))
        gain = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[own]))
        spread = self.first[term + 1] - self.first[term]
        for a, b in _stretches(spread, MATCHES_AT_ONCE):
            of = np.repeat(np.arange(a, b), spread[a:b])
            nth = np.arange(len(of)) - np.repeat(np.cumsum(spread[a:b]) - spread[a:b], spread[a:b])
            np.add.at(out, own[of] * self.n + self.item[self.first[term[of]] + nth], gain[of])
        return out.reshape(len(m), self.n)


def _stretches(load: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of about `most` load each."""
    part = np.cumsum(load) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(load)] if len(load) else [0]
    yield from zip(edges[:-1], edges[1:], strict=True)


def _best_rows(items: Items, k: int):
    """Of the classes of a task, the k best of each item, by (score, first id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.ones(items.n, dtype=np.int64)
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        lists: pa.ListArray = pa.array([], pa.list_(pa.int64()))
        step = max(1, SCORES_AT_ONCE // max(items.n, 1))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                part = whole.slice(at, step)
                bags, ids = part.column("_bag"), part.column("_ids")
                bounds = bags.offsets.to_numpy().astype(np.int64)
                bag = bags.values.slice(bounds[0], bounds[-1] - bounds[0]).to_numpy()
                first = pc.list_element(ids, 0)
                null = first.is_null().to_numpy(zero_copy_only=False)
                score = items.score(bag, bounds - bounds[0], part.column("_m").to_numpy())
                row, item = np.nonzero(score >= floor)
                new = (item, score[row, item], pc.fill_null(first, 0).to_numpy()[row], null[row])
                item, score, first, null = (np.concatenate(x) for x in zip(held, new, strict=True))
                source = np.concatenate([np.arange(len(lists)), len(lists) + row])
                order = np.lexsort((first, null, -score, item))
                ranked = item[order]
                place = np.arange(len(order)) - np.searchsorted(ranked, ranked)
                last = place == k - 1
                floor[ranked[last]] = score[order[last]]
                keep = order[place < k]
                held = item[keep], score[keep], first[keep], null[keep]
                lists = pa.concat_arrays([lists, ids.cast(pa.list_(pa.int64()))]).take(pa.array(source[keep]))
        yield pa.RecordBatch.from_arrays([pa.array(held[0].astype(np.int32)), pa.array(held[1]), lists], names=["_item", "score", "_ids"])

    return run


def _block(docs: DataFrame, pairs: DataFrame, id_type: T.DataType, k: int) -> DataFrame:
    """The ranking of the items of one block: pairs (item_id, term), distinct, a bounded number."""
    spark = docs.sparkSession
    asked = pairs.collect()
    vocabulary, of_term = np.unique(np.array([r["_term"].encode() for r in asked], dtype=object), return_inverse=True)
    ids = list(dict.fromkeys(r["_id"] for r in asked))
    place = {x: i for i, x in enumerate(ids)}
    item = np.array([place[r["_id"]] for r in asked], dtype=np.int64)

    bags = settle(map_batches(docs, _bag_rows(pa.array(vocabulary.tolist(), pa.large_binary())), "doc_id long, _n long, _bag array<bigint>"), "bags")
    total = bags.where("_n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("_n"), F.lit(0)).alias("terms")).first()
    held = bags.select(F.explode("_bag").alias("_e")).groupBy(F.expr("shiftright(_e, 32)").alias("term")).agg(F.count("*").alias("df")).collect()
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for r in held:
        df[r["term"]] = r["df"]
    weight = np.floor(1000 * np.log((2 * total["docs"] + 2) / (2 * df + 1))).astype(np.int64)

    m = F.expr(f"100 - 90 + (90L * _n * {total['docs']}L) div {max(total['terms'], 1)}L")
    sized = bags.where("size(_bag) > 0").select("doc_id", "_bag", m.alias("_m")).withColumn("_hash", F.xxhash64("_m", "_bag"))
    bag = ["_hash", "_m", "_bag"]
    least = Window.partitionBy(*bag).orderBy(F.col("doc_id").asc_nulls_last())
    members = sized.withColumn("_at", F.row_number().over(least)).where(F.col("_at") <= k)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_at", "doc_id"))), lambda x: x["doc_id"])
    classes = members.groupBy(*bag).agg(listed.alias("_ids")).select("_m", "_bag", "_ids")
    best = settle(classes.mapInArrow(_best_rows(Items(ids, of_term, item, weight), k), "_item int, score long, _ids array<bigint>"), "best")
    release(bags)
    names = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], T.StructType([T.StructField("_item", T.IntegerType()), T.StructField("item_id", id_type)]))
    # The k best classes hold the k best documents; only they are expanded.
    place = Window.partitionBy("_item").orderBy(F.col("score").desc(), F.col("_ids")[0].asc_nulls_last())
    order = Window.partitionBy("_item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    kept = best.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= k)
    ranked = kept.select("_item", "score", F.explode("_ids").alias("doc_id")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(names, "_item").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, terms_at_once: int = TERMS_AT_ONCE, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the `k` highest-scoring documents of each item.

    docs: doc_id (an integer type) and text; items: item_id and text. All documents with score
    above 0, if they are fewer than `k`. terms_at_once, items_at_once: about what a block of items holds.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("_text"))
    pairs = settle(items.select(F.col("item_id").alias("_id"), F.explode(F.array_distinct(terms_of("text"))).alias("_term")).distinct(), "item-terms")
    id_type = pairs.schema["_id"].dataType
    size = pairs.agg(F.count("*").alias("pairs"), F.count_distinct(F.coalesce(F.xxhash64("_id"), F.lit(0))).alias("items")).first()
    blocks = max(1, -(-size["pairs"] // terms_at_once), -(-size["items"] // items_at_once))
    out = None
    for i in range(blocks):
        block = pairs.where(F.pmod(F.xxhash64("_id"), F.lit(blocks)) == i)
        found = _block(plain, block, id_type, k)
        out = found if out is None else out.unionByName(found)
    return out
