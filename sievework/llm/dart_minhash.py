"""MinHash near-dedup with DartMinHash signatures.

A document is a weighted set of word shingles. Every unit of an element's weight is a strip of the
plane along an axis of ranks, and hashed darts hit the strip as a Poisson process whose hits depend
on the element and the unit alone. A document sees the darts inside its own region: below its
weights, and below a rank chosen so that about COORDINATES * (ln COORDINATES + 3) darts fall there in
all, whatever the number of elements. Each dart has a coordinate, and the earliest dart of each
coordinate is the signature; where a coordinate is empty the rank is doubled. Two documents agree in a
coordinate with probability equal to their weighted Jaccard similarity. With weights of 1 that is
the similarity of the sets.

Bands of ROWS coordinates are joined. Two documents of similarity s share a band with probability
1 - (1 - s^ROWS)^BANDS: above 0.999994 at 0.8. Equal sets are one vertex from the start. In each
bucket members are held against one hub (its least member), exactly, on whole shingle sets, in two
rounds of one row per member; so groups of thousands of copies cost one comparison per member. What
is still in different components of one bucket then meets member by member, so that no link which
could join two classes is lost: first in the join itself by sketches (four bits of each coordinate),
where a pair goes on unless it disagrees more often than a pair at the threshold ever would (SURE
standard deviations, 1e-5), then exactly. There a large bucket is dealt into blocks of about BLOCK
members, and each task meets two blocks, so one bucket is many tasks of bounded size.

Defined results: null, empty and blank texts have no shingles, are never linked and are classes of
their own; texts of fewer words than a shingle are one shingle; ties go to the least id; repeated rows
fall into one class; null ids come last; an empty table gives no rows; only the id, the text and
carried columns are read.

Shingles are told apart by hashes of 61 bits at a point that the run draws (`_text.Spans`); sets of them are compared whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import map_batches, row_keys, schema_of, settle, text_or_empty
from ._text import U64, buffers, mix64, shingles, slices, unit, word_hashes, words
from .components import components

SHINGLE, ROWS, BANDS = 5, 6, 40
COORDINATES = ROWS * BANDS
#: Coordinates of the sketches of the last round, and how many standard deviations they may be off.
SKETCH, SURE = 1024, 4.4
#: Members of one bucket that meet as many others in one task of the last round, about.
BLOCK = 2048
#: Darts that one numpy pass throws where strips have many.
DARTS_AT_ONCE = 1 << 19
_STEP = U64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each row in order, how often each is found, first)."""
    starts, ends, first = words(data, offsets)
    keys, own = shingles(word_hashes(data, starts, ends), first, width)
    row = np.repeat(np.arange(len(own) - 1), np.diff(own))
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.concatenate([at, [len(keys)]]))
    return keys[at], counts, np.searchsorted(row[at], np.arange(len(own)))


def _throw(strip: np.ndarray, row: np.ndarray, limit: np.ndarray, width: np.ndarray, t: int):
    """Darts (row, coordinate, rank, id) of strips below each strip's limit of rank."""
    rank, k = np.zeros(len(strip)), np.zeros(len(strip), dtype=U64)
    while len(strip):
        k = k + U64(1)
        dart = mix64(strip + k * _STEP)
        rank = rank - np.log(unit(dart))
        live = rank < limit
        strip, row, limit, width, rank, k, dart = (x[live] for x in (strip, row, limit, width, rank, k, dart))
        other = mix64(dart ^ U64(0x5851F42D4C957F2D))
        seen = unit(mix64(other)) < width  # a dart beyond a fractional weight misses the region
        yield row[seen], (other[seen] % U64(t)).astype(np.int64), rank[seen], dart[seen]


def _throw_many(strip: np.ndarray, row: np.ndarray, limit: np.ndarray, width: np.ndarray, t: int):
    """The same darts for strips with many of them: all steps at once, DARTS_AT_ONCE at a time."""
    every = np.ceil(limit + 8 * np.sqrt(limit) + 16).astype(np.int64)
    part = np.cumsum(every) // DARTS_AT_ONCE
    for own in np.split(np.arange(len(strip)), np.flatnonzero(np.diff(part)) + 1):
        steps = every[own]
        begin = np.concatenate([[0], np.cumsum(steps)])
        of = np.repeat(np.arange(len(own)), steps)
        k = (np.arange(begin[-1]) - begin[of] + 1).astype(U64)
        dart = mix64(strip[own][of] + k * _STEP)
        total = np.cumsum(-np.log(unit(dart)))
        rank = total - np.concatenate([[0.0], total])[begin[of]]
        live = rank < limit[own][of]
        of, rank, dart = own[of[live]], rank[live], dart[live]
        other = mix64(dart ^ U64(0x5851F42D4C957F2D))
        seen = unit(mix64(other)) < width[of]
        yield row[of[seen]], (other[seen] % U64(t)).astype(np.int64), rank[seen], dart[seen]


def signatures(keys: np.ndarray, weights: np.ndarray, first: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """Dart ids, rows x t, of rows of weighted elements; zeros where a row has no element."""
    n = len(first) - 1
    ids, best = np.zeros((n, t), dtype=U64), np.full(n * t, np.inf)
    element_row = np.repeat(np.arange(n), np.diff(first))
    units = np.ceil(weights).astype(np.int64)
    of = np.repeat(np.arange(len(keys)), units)
    level = np.arange(len(of)) - np.repeat(np.cumsum(units) - units, units)
    strip = mix64(keys[of] + mix64(level.astype(U64) + U64(1)))
    width = np.minimum(weights[of] - level, 1.0)
    row = element_row[of]
    mass = np.bincount(row, weights=width, minlength=n)
    limit = np.divide(t * (math.log(t) + 3), mass, out=np.zeros(n), where=mass > 0)
    todo = mass > 0
    while todo.any():
        use = todo[row]
        best.reshape(n, t)[todo] = np.inf
        for big, throw in ((False, _throw), (True, _throw_many)):
            pick = use & ((limit[row] > 64) == big)
            if not pick.any():
                continue
            for r, c, rank, dart in throw(strip[pick], row[pick], limit[row[pick]], width[pick], t):
                cell = r * t + c
                np.minimum.at(best, cell, rank)
                won = rank <= best[cell]
                ids.ravel()[cell[won]] = dart[won]
        todo &= np.isinf(best.reshape(n, t)).any(axis=1)
        limit = limit * 2
    return ids


def band_keys(ids: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of `rows` coordinates."""
    parts = ids.reshape(len(ids), -1, rows)
    out = np.broadcast_to(np.arange(parts.shape[1], dtype=U64) * _STEP, parts.shape[:2]).copy()
    for j in range(rows):
        out = mix64(out ^ parts[:, :, j]) + _STEP
    return out


def sketches(ids: np.ndarray) -> np.ndarray:
    """Four bits of every coordinate, sixteen to a 64-bit number."""
    n, t = ids.shape
    bits = np.zeros((n, -(-t // 16) * 16), dtype=U64)
    bits[:, :t] = ids & U64(15)
    shifts = np.arange(0, 64, 4, dtype=U64)
    return np.bitwise_or.reduce(bits.reshape(n, -1, 16) << shifts, axis=2)


def _differing(x: Column, y: Column) -> Column:
    """In how many coordinates two sketch columns differ."""

    def unequal(a: Column, b: Column) -> Column:
        z = a.bitwiseXOR(b)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseAND(F.lit(0x1111111111111111)))

    return F.aggregate(F.zip_with(x, y, unequal), F.lit(0), lambda total, n: total + n)


def _sketch_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    listed = batch.column("_elements")
    first = listed.offsets.to_numpy().astype(np.int64)
    keys = listed.values.to_numpy().view(U64)[first[0] : first[-1]]
    for at in range(0, batch.num_rows, 64):  # so many sets at once
        own = first[at : at + 65] - first[0]
        short = sketches(signatures(keys[own[0] : own[-1]], np.ones(own[-1] - own[0]), own - own[0], SKETCH))
        drawn = pa.ListArray.from_arrays(pa.array(np.arange(len(own)) * short.shape[1], pa.int32()), pa.array(short.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("_set").slice(at, 64), drawn], names=["_set", "_sketch"])


def _signature_rows(width: int, rows: int, bands: int, weighted: bool):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "_text"):
            keys, counts, first = shingle_sets(*buffers(part.column("_text")), width)
            n, size = part.num_rows, np.diff(first)
            weights = counts.astype(np.float64) if weighted else np.ones(len(keys))
            found = band_keys(signatures(keys, weights, first, rows * bands), rows)
            marked = mix64(keys ^ mix64(counts.astype(U64))) if weighted else mix64(keys)
            total = np.concatenate([np.zeros(1, U64), np.cumsum(marked)])
            label = mix64(total[first[1:]] - total[first[:-1]] + size.astype(U64))
            full = np.flatnonzero(size > 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((size > 0) * bands)]).astype(np.int32)), pa.array(found[full].ravel().view(np.int64)))
            names = [c for c in part.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(np.where(size > 0, label, U64(0)).view(np.int64)), pa.array(size.astype(np.int64)), lists], names=[*names, "_set", "_size", "_bands"])

    return run


def _set_rows(width: int, weighted: bool):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "_text"):
            keys, counts, first = shingle_sets(*buffers(part.column("_text")), width)
            if weighted:  # the c-th time that a shingle is found is an element of its own
                of = np.repeat(np.arange(len(keys)), counts)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
                first = np.concatenate([[0], np.cumsum(counts)])[first]
                keys = mix64(keys[of] + nth.astype(U64) * _STEP)
            yield pa.RecordBatch.from_arrays([part.column("_set"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(keys.view(np.int64)))], names=["_set", "_elements"])

    return run


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b) of sets, those whose exact similarity is at least the threshold."""
    left = sets.select(F.col("_set").alias("a"), F.col("_elements").alias("_x"))
    right = sets.select(F.col("_set").alias("b"), F.col("_elements").alias("_y"))
    n, m = F.size("_x"), F.size("_y")
    both = pairs.join(left, "a").join(right, "b").where(F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9)
    common = both.withColumn("_common", F.size(F.array_intersect("_x", "_y")))
    return settle(common.where(F.col("_common") >= similarity * (n + m - F.col("_common")) - 1e-9).select("a", "b"), "links")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", carry: list[str] | None = None, similarity: float = 0.8, width: int = SHINGLE, rows: int = ROWS, bands: int = BANDS, weighted: bool = False) -> DataFrame:
    """One row per row of `docs`: the id, carried columns, the row key _k1, _k2, class_id (the least
    id of its class) and kept (true for the row that stands for its class; wholly equal rows share it).

    weighted: shingles weigh as often as they are found; else 1.
    """
    carry = [c for c in (carry or []) if c != id_column]
    keyed = docs.select(F.col(f"`{id_column}`"), *(F.col(f"`{c}`") for c in carry), text_or_empty(text).alias("_text")).select("*", *row_keys(f"`{id_column}`", *(f"`{c}`" for c in carry if c != text), "_text"))
    plain = keyed.drop("_text")
    signed = settle(map_batches(keyed, _signature_rows(width, rows, bands, weighted), schema_of(plain, ("_set", "bigint"), ("_size", "bigint"), ("_bands", "array<bigint>"))), "signatures")

    distinct = signed.where("_size > 0").groupBy("_set").agg(F.first("_size").alias("_size"), F.first("_bands").alias("_bands"), F.first("_k1").alias("_k1"), F.first("_k2").alias("_k2"))
    distinct = settle(distinct, "distinct")
    buckets = distinct.select("_set", "_size", F.explode("_bands").alias("_band"))
    hubs = settle(buckets.groupBy("_band").agg(F.min("_set").alias("_hub"), F.max("_set").alias("_high")).where("_hub != _high").select("_band", "_hub"), "hubs")
    members = settle(buckets.join(hubs, "_band"), "members")
    wanted = distinct.join(members.select("_set").distinct(), "_set").select("_set", "_k1", "_k2")
    sets = settle(map_batches(keyed.select("_k1", "_k2", "_text").join(wanted, ["_k1", "_k2"]).select("_set", "_text"), _set_rows(width, weighted), "_set long, _elements array<bigint>").dropDuplicates(["_set"]), "sets")

    def grouped(links: DataFrame) -> DataFrame:
        return settle(components(links), "components")

    def in_groups(found: DataFrame, *columns: str) -> DataFrame:
        out = members
        for c in columns:
            named = found.select(F.col("vertex").alias(c), F.col("component").alias(f"{c}_group"))
            out = out.join(named, c, "left").withColumn(f"{c}_group", F.coalesce(f"{c}_group", c))
        return out

    first = settle(members.where("_set != _hub").groupBy("_set").agg(F.min("_hub").alias("_hub")).select(F.col("_hub").alias("a"), F.col("_set").alias("b")), "pairs")
    links = _linked(first, sets, similarity)
    groups = grouped(links)
    apart = in_groups(groups, "_set", "_hub").where("_set_group != _hub_group").select(F.col("_hub").alias("a"), F.col("_set").alias("b")).distinct()
    second = settle(apart.join(first, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(_linked(second, sets, similarity))
    groups = grouped(links)

    # The rest, exactly: members of one bucket that are still in different components.
    placed = in_groups(groups, "_set")
    several = settle(placed.groupBy("_band").agg(F.min("_set_group").alias("_low"), F.max("_set_group").alias("_high")).where("_low != _high").select("_band"), "several")
    open_ = settle(placed.join(several, "_band").where("_set != _hub").select("_band", "_set", "_set_group"), "open")
    opened = settle(sets.join(open_.select("_set").distinct(), "_set"), "opened")
    bodies = opened.select("_set", F.explode("_elements").alias("_element"))
    found_once = F.count("*") == 1
    lone = bodies.groupBy("_element").agg(F.first("_set").alias("_set"), found_once.alias("_once")).where("_once").groupBy("_set").agg(F.count("*").alias("_lone"))
    drawn = map_batches(opened, _sketch_rows, "_set long, _sketch array<bigint>")
    facts = opened.select("_set", F.size("_elements").alias("_n")).join(lone, "_set", "left").join(drawn, "_set")
    at = F.array_position("_bands", F.col("_band")).cast("int")
    open_ = settle(open_.join(facts, "_set").join(distinct.select("_set", "_bands"), "_set").withColumn("_lone", F.coalesce("_lone", F.lit(0))).withColumn("_before", F.slice("_bands", 1, at - 1)).drop("_bands"), "open")
    sides = ("_set", "_set_group", "_n", "_lone", "_sketch", "_before")
    crowd = settle(open_.groupBy("_band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks")), "crowd")
    open_ = open_.join(crowd, "_band")
    own, every = F.pmod(F.xxhash64("_set"), "_blocks").cast("int"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    x, y = (open_.select("_band", *(F.col(c).alias(f"{c}_{side}") for c in sides), (own if side == "x" else every).alias("_row"), "_blocks") for side in "xy")
    x, y = x.withColumn("_column", every).drop("_blocks"), y.withColumn("_column", F.pmod(F.xxhash64("_set_y"), "_blocks").cast("int")).drop("_blocks")
    # What only one open set holds is never shared: that bounds the similarity from above.
    most_shared = F.least(F.col("_n_x") - F.col("_lone_x"), F.col("_n_y") - F.col("_lone_y"))
    least_union = F.greatest(F.col("_n_x") + F.col("_lone_y"), F.col("_n_y") + F.col("_lone_x"))
    agree = similarity + (1 - similarity) / 16
    most = math.ceil(SKETCH * (1 - agree) + SURE * math.sqrt(SKETCH * agree * (1 - agree)))
    could = (most_shared >= similarity * least_union - 1e-9) & (_differing(F.col("_sketch_x"), F.col("_sketch_y")) <= most)
    # A pair comes out of the first of the bands that it shares.
    could = could & ~F.exists(F.zip_with("_before_x", "_before_y", lambda a, b: a == b), lambda same: same)
    meeting = x.join(y, (x["_band"] == y["_band"]) & (x["_row"] == y["_row"]) & (x["_column"] == y["_column"]) & (F.col("_set_x") < F.col("_set_y")) & (F.col("_set_group_x") != F.col("_set_group_y")) & could)
    third = settle(meeting.select(F.col("_set_x").alias("a"), F.col("_set_y").alias("b")).join(first.unionByName(second), ["a", "b"], "left_anti"), "pairs")
    groups = grouped(links.unionByName(_linked(third, sets, similarity)))

    named = groups.select(F.col("vertex").alias("_set"), F.col("component").alias("_group"))
    classed = settle(signed.select(*plain.columns, "_set", "_size").join(named, "_set", "left").withColumn("_group", F.when(F.col("_size") > 0, F.coalesce("_group", "_set"))), "classed")
    full = classed.where("_size > 0")
    order = F.struct(F.col(f"`{id_column}`").isNull().alias("_none"), F.col(f"`{id_column}`").alias("_id"), F.col("_k1"), F.col("_k2"))
    least = settle(full.groupBy("_group").agg(F.min(order).alias("_least")), "least")
    joined = full.join(least, "_group").withColumn("class_id", F.col("_least._id")).withColumn("kept", (F.col("_k1") == F.col("_least._k1")) & (F.col("_k2") == F.col("_least._k2")))
    alone = classed.where("_size = 0").withColumn("class_id", F.col(f"`{id_column}`")).withColumn("kept", F.lit(True))
    columns = [*plain.columns, "class_id", "kept"]
    return joined.select(*(F.col(f"`{c}`") for c in columns)).unionByName(alone.select(*(F.col(f"`{c}`") for c in columns)))


def keep_one(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The rows of `docs` that stand for their classes in `found`, one each (same columns as there)."""
    carry = [c for c in (carry or []) if c != id_column]
    # Blank texts are classes of their own, so equal rows of them all stay.
    blank = F.length(F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", "")) == 0
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    keyed = docs.select(whole, blank.alias("_blank"), *row_keys(F.col(f"`{id_column}`"), *(F.col(f"`{c}`") for c in carry if c != text), text_or_empty(text)))
    rows = found.where("kept").groupBy("_k1", "_k2").agg(F.count("*").alias("_rows"))
    stay = keyed.join(rows, ["_k1", "_k2"])
    single = (F.col("_rows") == 1) | F.col("_blank")
    return stay.where(single).unionByName(stay.where(~single).dropDuplicates(["_k1", "_k2"])).select("_row.*")
