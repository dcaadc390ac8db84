"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target of words; a document of it is wanted target / source size times. The whole
part of that is taken surely, the rest is a copy probability. Pivotal rounding settles those
probabilities without losing mass: the largest document with a fractional probability is paired with the
pool of all smaller ones, and a random one of the two hands words to the other until the document or one
of the pool is integral. The pool gives and takes in the same fixed shares, so the expected number of
copies of every document stays what it was, and the words of the source stay exactly its target but for
the last fraction, which one document rounds at random. Going from large to small, that is a small one.

Spark deals each source into buckets of bounded size, so a hot source is many tasks. A bucket settles
its documents, holds back its RESERVE smallest, and leaves one more fractional
document at most; these are combined FAN_IN buckets at a time, level by level, until a source has one
bucket left, which settles all - a reduction tree over the cluster. What was held back lets the small
documents come last at every depth of the tree, so what remains at a source's root is small. Which
documents are held back depends on sizes alone and every level draws once, so the copy probabilities are
exactly those of pivotal rounding. Random numbers are hashes of the rows, so reruns agree.

Defined results: null or blank texts have size 0 and are never taken; a null source is a source, the
last one; a source of size 0 has target 0; rows that are wholly the same are counted first, numbered
and rounded one by one, in as many buckets as others; ties in size go by the row key; very long texts are
read whole; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import map_batches, row_keys, schema_of, settle, text_or_empty, with_rank
from ._text import buffers, mix64, slices, unit, words

#: Documents of one bucket, about, buckets that meet at the next level, and documents that a bucket holds back.
BUCKET_ROWS, FAN_IN, RESERVE = 2048, 32, 16
#: Copies of one row that one task lays out.
COPIES_AT_ONCE = 4096
DUST = 1e-9


def sizes(docs: DataFrame, source: str, text: str, carry: list[str]) -> DataFrame:
    """Carried columns, _k1, _k2, source (as _source) and the number of words (size)."""
    plain = docs.select(*(F.col(f"`{c}`") for c in carry), F.col(f"`{source}`").cast("string").alias("_source"), text_or_empty(text).alias("_text"))
    keyed = plain.select("*", *row_keys(*(f"`{c}`" for c in carry if c != text), F.coalesce("_source", F.lit("")), "_text"))

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "_text"):
            counts = np.diff(words(*buffers(part.column("_text")))[2])
            kept = [n for n in part.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), pa.array(counts.astype(np.int64))], names=[*kept, "size"])

    return map_batches(keyed, rows, schema_of(keyed.drop("_text"), ("size", "bigint")))


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """One row per source: _source, _source_rows, source_size, target; of rows with _source, size and how many there are (_rows).

    Sources by code point, null last, take the weights in turn. The words to share are `share` times
    all; no target is above `most` times its source, and what is over goes to the others by weight.
    """
    each = sized.groupBy("_source").agg(F.sum("_rows").alias("_source_rows"), F.sum(F.col("size") * F.col("_rows")).alias("source_size"))
    ranked = with_rank(each, [F.col("_source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = settle(ranked.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * most), "sources")
    total = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level = -1.0
    while True:  # the level of words per weight rises until no further source is at its cap
        full = F.col("_cap") <= F.lit(level) * F.col("_weight")
        row = table.agg(F.sum(F.when(full, F.col("_cap"))).alias("capped"), F.sum(F.when(~full, F.col("_weight"))).alias("open")).first()
        if not row["open"]:
            break
        higher = (total - (row["capped"] or 0.0)) / row["open"]
        if higher <= level:
            break
        level = higher
    return table.select("_source", "_rank", "_source_rows", "source_size", F.least("_cap", F.lit(max(level, 0.0)) * F.col("_weight")).cast("double").alias("target"))


def pivot(size: np.ndarray, p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(added copies 0 or 1, probability left) of documents, largest first; one stays fractional at most.

    Every step settles a document at least: the first open one, or one of the pool of those after it.
    """
    p = p.astype(np.float64, copy=True)
    open_ = np.flatnonzero((p > DUST) & (p < 1 - DUST))
    for draw in u:
        if len(open_) < 2:
            break
        at, pool = open_[0], open_[1:]
        own, b, q = size[at], size[pool], p[pool]
        weight = b * q * (1 - q)
        weight /= weight.sum()
        up = min(own * (1 - p[at]), (q * b / weight).min())
        down = min(own * p[at], ((1 - q) * b / weight).min())
        move = up if draw * (up + down) < down else -down
        p[at] += move / own
        p[pool] = q - move * weight / b
        open_ = open_[(p[open_] > DUST) & (p[open_] < 1 - DUST)]
    return (p >= 1 - DUST).astype(np.int64), np.where((p > DUST) & (p < 1 - DUST), p, 0.0)


def _settle_bucket(last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "_k1", "_k2", "_no"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        n = len(rows) if last else max(len(rows) - RESERVE, 0)
        added, left = np.zeros(len(rows), np.int64), rows["_p"].to_numpy(copy=True)
        added[:n], left[:n] = pivot(rows["size"].to_numpy(np.float64)[:n], left[:n], unit(mix64(rows["_u"].to_numpy().view(np.uint64)[:n])))
        return rows.assign(copies=rows["copies"] + added, _p=left)

    return run


def _draw(level: int, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(level), "_k1", "_k2", "_no")


def _laid_out(rows: DataFrame, times: str, number: str, key: list[str]) -> DataFrame:
    """Every row as often as `times` says, numbered from 0, COPIES_AT_ONCE of a row by one task."""
    count, part = F.col(times), F.lit(COPIES_AT_ONCE)
    parts = rows.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((count - 1) / part)))).repartition(*key, "_part")
    begin = F.col("_part") * part
    return parts.withColumn(number, F.explode(F.sequence(begin, F.least(begin + part, count) - 1))).drop("_part")


def mix(docs: DataFrame, source: str = "source", text: str = "text", carry: list[str] | None = None, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """Carried columns (default doc_id), size, source_size, target, copies, and the row key _k1, _k2."""
    carry = ["doc_id"] if carry is None else carry
    sized = sizes(docs, source, text, carry)
    each = sized.groupBy("_k1", "_k2").agg(*(F.first(F.col(f"`{c}`")).alias(c) for c in [*carry, "_source", "size"]), F.count("*").alias("_rows"))
    each = settle(each, "sizes")
    targets = source_targets(each, weights, share, most)
    joined = each.join(targets, each["_source"].eqNullSafe(targets["_source"])).drop(targets["_source"])
    wanted = F.when((F.col("size") > 0) & (F.col("source_size") > 0), F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(wanted + DUST)
    numbered = joined.where("_rows = 1").withColumn("_no", F.lit(0).cast("long")).unionByName(_laid_out(joined.where("_rows > 1"), "_rows", "_no", ["_k1", "_k2"]))
    buckets = F.greatest(F.ceil(F.col("_source_rows") / BUCKET_ROWS), F.lit(1))
    start = numbered.withColumn("copies", whole.cast("long")).withColumn("_p", F.greatest(wanted - whole, F.lit(0.0))).withColumn("_bucket", F.pmod(F.xxhash64("_k1", "_no"), buckets).cast("long"))
    columns = [*carry, "_k1", "_k2", "_no", "size", "source_size", "target", "_rank", "_bucket", "copies", "_p"]
    fractional = F.col("_p") > DUST
    now = settle(start.select(*(f"`{c}`" for c in columns)), "wanted")
    done = [now.where(~fractional)]
    now = now.where(fractional)
    most_buckets = targets.agg(F.max(F.ceil(F.col("_source_rows") / BUCKET_ROWS))).first()[0] or 1
    levels = 1
    while most_buckets > 1:
        most_buckets, levels = -(-most_buckets // FAN_IN), levels + 1
    for level in range(levels):
        if level:
            now = now.withColumn("_bucket", F.floor(F.col("_bucket") / FAN_IN).cast("long"))
        dealt = now.withColumn("_u", _draw(level, seed))
        now = settle(dealt.groupBy("_rank", "_bucket").applyInPandas(_settle_bucket(level == levels - 1), dealt.schema).drop("_u"), "rounded")
        done.append(now.where(~fractional))
        now = now.where(fractional)
    done.append(now.withColumn("copies", F.col("copies") + (F.shiftrightunsigned(_draw(-1, seed), 11) * 2.0**-53 < F.col("_p")).cast("long")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("_rank", "_bucket", "_p", "_no")


def repeat(docs: DataFrame, mixed: DataFrame, source: str = "source", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The mix itself: every row of `docs` as often as `mixed` (of the same columns) takes it."""
    carry = ["doc_id"] if carry is None else carry
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *row_keys(*(F.col(f"`{c}`") for c in carry if c != text), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")), text_or_empty(text)))
    plan = mixed.groupBy("_k1", "_k2").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).where("_copies > 0")
    found = keyed.join(plan, ["_k1", "_k2"])
    # Rows that are wholly the same share their copies; one of them stands for all.
    single = found.where("_rows = 1").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    same = _laid_out(found.where("_rows > 1").dropDuplicates(["_k1", "_k2"]), "_copies", "_copy", ["_k1", "_k2"])
    return single.select("_row").unionByName(same.select("_row")).select("_row.*")
