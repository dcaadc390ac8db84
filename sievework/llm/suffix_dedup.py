"""Suffix-array dedup: exact repeated windows by a depth-limited radix sort of suffixes.

Two suffixes that agree on their first `threshold` tokens start a repeated window. A full suffix
array would order every suffix of the corpus to its end; here suffixes are only told apart through
`threshold` tokens, by most-significant-digit passes over the whole corpus. A digit is a stretch of
threshold / digits tokens (DIGITS of them, unless told), the first pass reads the front one, and each pass splits the groups of the
pass before it by the next digit; a suffix that is alone in its group starts no repeated window and
drops out. What is left after the last pass are exactly the groups of equal windows. Groups are told
apart, not ordered: nothing here asks for the order. A pass groups by the hashes of what is known before and after
it (`_text.Spans`: 61 bits at a point that the run draws), so windows that agree on all but the last digit are told apart by
one such hash, and others by more.

Two named speed-ups come first, since most suffixes of a corpus need no digit read at all:

* Anchors. Of all runs of threshold / 2 tokens inside a window, the one with the least hash (leftmost
  on ties) is its anchor. Equal windows have equal anchors at equal distances. So suffixes are dealt
  into groups by anchor, the windows of one anchor occurrence as one row, and those whose anchor is
  found once in the corpus drop out together: all but about two rows in (threshold / 2) suffixes.
* Collapse. The span of an anchor occurrence is all that its windows cover. Equal spans settle all
  their windows at once, and one span stands for all of its copies in the digit passes, which only
  look at anchors with different spans around them: the edges of repeated passages.

Every pass counts by a partial aggregation before its shuffle, so hot groups arrive summed.

Defined results: a null text is empty; texts shorter than the threshold keep everything; repeated
rows count as different documents, so their windows are repeated; very long texts are read in
overlapping pieces, and every window is in exactly one; an empty table gives no rows; only the columns
named are read, others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import map_batches, release, row_keys, schema_of, settle, text_or_empty
from ._text import BYTE_VALUES, MASK64, U64, Spans, buffers, mix64, slices, word_hashes, words

#: Bits of a packed run of windows that count them; the rest is the first window's start.
RUN_BITS = 20
#: Digits of a suffix, and suffixes that one numpy pass handles.
DIGITS, SUFFIXES_AT_ONCE = 2, 1 << 20
#: Tokens of one piece of a long document; pieces overlap so that each window is in exactly one.
PIECE = 1 << 22


def _tokens(batch: pa.RecordBatch, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(values, first token of each row, byte start and end of each token)."""
    data, offsets = buffers(batch.column("_text"))
    if unit == "byte":
        place = np.arange(len(data), dtype=np.int64)
        return BYTE_VALUES[data], offsets, place, place + 1
    starts, ends, first = words(data, offsets)
    return word_hashes(data, starts, ends), first, starts, ends


def _pieces(first: np.ndarray, threshold: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, rows, bounds): stretches of whole rows of about PIECE tokens, or overlapping parts of a longer row."""
    row, n = 0, len(first) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(first, first[row] + PIECE, side="right")) - 1)
        a, b = int(first[row]), int(first[end])
        if b - a <= PIECE:
            yield a, b, np.arange(row, end), first[row : end + 1] - a
        else:
            for at in range(a, b - threshold + 1, PIECE):
                to = min(b, at + PIECE + threshold - 1)
                yield at, to, np.array([row]), np.array([0, to - at])
        row = end


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    blocks = np.concatenate([x, np.full(-len(x) % width, MASK64, dtype=U64)]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def core_runs(values: np.ndarray, bounds: np.ndarray, threshold: int) -> tuple[np.ndarray, ...] | None:
    """(first window, last window, core hash, span hash) of every core occurrence, over all rows in `values`."""
    if not (np.diff(bounds) >= threshold).any():
        return None
    width = threshold - threshold // 2 + 1
    spans = Spans(values)
    core = spans.windows(threshold // 2)
    place_bits = U64(max(1, int(len(core)).bit_length()))
    least = sliding_min((core >> place_bits << place_bits) | np.arange(len(core), dtype=U64), width)
    long = np.diff(bounds) >= threshold
    inside = np.zeros(len(values) + 1, dtype=np.int8)
    inside[bounds[:-1][long]] += 1
    np.add.at(inside, bounds[1:][long] - threshold + 1, -1)
    valid = np.flatnonzero(np.cumsum(inside[: len(least)], dtype=np.int8) > 0)
    at = (least[valid] & ((U64(1) << place_bits) - U64(1))).astype(np.int64)
    cut = np.flatnonzero(at[1:] != at[:-1]) + 1
    low, high = valid[np.concatenate([[0], cut])], valid[np.concatenate([cut, [len(at)]]) - 1]
    at = at[np.concatenate([[0], cut])]
    span = mix64(spans.hash(low, high + threshold) ^ mix64((at - low).astype(U64) * U64(0x9E3779B97F4A7C15)))
    return low, high, core[at], span


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _core_rows(unit: str, threshold: int):
    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "_text"):
            values, first, _, _ = _tokens(part, unit)
            k1, k2 = part.column("_k1").to_numpy(), part.column("_k2").to_numpy()
            for a, b, own, bounds in _pieces(first, threshold):
                if (found := core_runs(values[a:b], bounds, threshold)) is not None:
                    low, high, core, span = found
                    row = own[np.searchsorted(bounds, low, side="right") - 1]
                    run = ((a + low - first[row]) << RUN_BITS) | (high - low + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(k1[row]), pa.array(k2[row]), pa.array(run), _signed(core), _signed(span)], names=["_k1", "_k2", "_run", "_core", "_span"])

    return rows


def depths(threshold: int, digits: int = DIGITS) -> list[int]:
    """How many tokens of a suffix are known after each pass."""
    return sorted({-(-threshold * k // digits) for k in range(1, digits + 1)})


def _suffix_rows(unit: str, threshold: int, digits: int):
    """Of documents with the runs that the digit passes look at: a row for each suffix, its group after each pass."""
    ends = depths(threshold, digits)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "_text"):
            values, first, _, _ = _tokens(part, unit)
            offsets = part.column("_runs").offsets.to_numpy().astype(np.int64)
            listed = part.column("_runs").values.slice(offsets[0], offsets[-1] - offsets[0])
            packed, anchors, alone = (listed.field(n).to_numpy(zero_copy_only=False) for n in ("_run", "_core", "_alone"))
            doc, uid = np.repeat(np.arange(part.num_rows), np.diff(offsets)), part.column("_uid").to_numpy()
            start, count = packed >> RUN_BITS, packed & ((1 << RUN_BITS) - 1)
            load = np.cumsum(count) // SUFFIXES_AT_ONCE
            for own in np.split(np.arange(len(packed)), np.flatnonzero(np.diff(load)) + 1):
                for document in (np.split(own, np.flatnonzero(np.diff(doc[own])) + 1) if len(values) > SUFFIXES_AT_ONCE else [own]):
                    if not len(document):
                        continue
                    n = count[document]
                    of = np.repeat(document, n)
                    at = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                    where = first[doc[of]] + at
                    low = int(where.min())
                    spans = Spans(values[low : int(where.max()) + threshold])
                    groups = [_signed(mix64(spans.hash(where - low, where - low + d) ^ mix64(anchors[of].view(U64)))) for d in ends]
                    yield pa.RecordBatch.from_arrays([pa.array(uid[doc[of]]), pa.array(at), pa.array(alone[of]), *groups], names=["_uid", "_at", "_alone", *(f"_group{d}" for d in ends)])

    return rows


def _cut(unit: str, threshold: int):
    """Adds what is left of the text and the removed byte spans, merged, in order."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "_text"):
            _, first, starts, ends = _tokens(part, unit)
            data, offsets = buffers(part.column("_text"))
            runs, kept, spans = part.column("_runs"), [], []
            for i in range(part.num_rows):
                whole, listed = data[offsets[i] : offsets[i + 1]], runs[i].values
                if listed is None or not len(listed):
                    kept.append(whole.tobytes())
                    spans.append([])
                    continue
                packed = np.sort(listed.to_numpy(zero_copy_only=False))
                low, high = packed >> RUN_BITS, (packed >> RUN_BITS) + (packed & ((1 << RUN_BITS) - 1)) + threshold - 1
                reach = np.maximum.accumulate(high)
                new = np.concatenate([[True], low[1:] > reach[:-1]])
                low, high = low[new], reach[np.concatenate([np.flatnonzero(new)[1:], [len(reach)]]) - 1]
                low, high = starts[first[i] + low] - offsets[i], ends[first[i] + high - 1] - offsets[i]
                stay = np.ones(len(whole), dtype=bool)
                for s, e in zip(low, high, strict=True):
                    stay[s:e] = False
                kept.append(whole[stay].tobytes())
                spans.append([{"start": s, "end": e} for s, e in zip(low.tolist(), high.tolist(), strict=True)])
            carry = [n for n in part.schema.names if n not in ("_k1", "_k2", "_runs", "_text")]
            out = [*(part.column(n) for n in carry), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(out, names=[*carry, "kept", "removed"])

    return rows


def suffix_dedup(docs: DataFrame, text: str = "text", carry: list[str] | None = None, unit: str = "byte", threshold: int = 400, digits: int = DIGITS) -> DataFrame:
    """Remove every token covered by a run of `threshold` tokens that also starts anywhere else.

    docs: any table with a text column. carry: columns to return besides (default doc_id).
    digits: how many passes a suffix is read in. unit: "byte", or "word" for runs of [^\\x20\\x09-\\x0D]+. Overlaps count, and runs are judged on
    the input. Returns the carried columns, kept (binary: the remaining bytes) and removed
    (array<struct<start, end>>: maximal removed byte ranges of the UTF-8 text).
    """
    if unit not in ("byte", "word") or not 4 <= threshold < 1 << RUN_BITS or not 1 <= digits <= threshold:
        raise ValueError("unit must be byte or word, threshold from 4 on, digits from 1 to threshold")
    carry = ["doc_id"] if carry is None else carry
    keyed = docs.select(*(F.col(f"`{c}`") for c in carry), text_or_empty(text).alias("_text")).select("*", *row_keys(*(f"`{c}`" for c in carry if c != text), "_text"))
    plain = keyed.select("_k1", "_k2", "_text")
    cores = map_batches(plain, _core_rows(unit, threshold), "_k1 long, _k2 long, _run long, _core long, _span long")

    # Anchors: groups of one occurrence drop out; the commonest span of each anchor is settled at once.
    # What is counted is written before it is joined: Spark splits a hot key's side of a join of two shuffles.
    counted = cores.groupBy("_core", "_span").agg(F.count("*").alias("_n"))
    shared = counted.groupBy("_core").agg(F.sum("_n").alias("_rows"), F.count("*").alias("_kinds"), F.max("_n").alias("_most"), F.max_by("_span", "_n").alias("_top")).where("_rows >= 2")
    done = (F.col("_span") == F.col("_top")) & (F.col("_most") >= 2)
    shared = settle(shared, "shared")
    left = settle(cores.join(shared, "_core").select("_k1", "_k2", "_run", "_core", "_span", done.alias("_done"), (F.col("_kinds") > 1).alias("_mixed")), "cores")
    release(shared)

    # Collapse: where spans differ, others that occur twice are repeated too; each distinct span goes on as one row.
    mixed = left.where("_mixed")
    spans = settle(mixed.groupBy("_core", "_span").agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in ("_k1", "_k2", "_run"))), "spans")
    same = mixed.where("NOT _done").join(spans.where("_n >= 2").select("_core", "_span"), ["_core", "_span"], "left_semi")

    # The digit passes: each splits the groups of the one before, and suffixes alone in their group drop out.
    listed = spans.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("_run", "_core", (F.col("_n") == 1).alias("_alone"))).alias("_runs"))
    look = settle(listed.withColumn("_uid", F.monotonically_increasing_id()), "look")
    keys = [f"_group{d}" for d in depths(threshold, digits)]
    suffixes = map_batches(plain.join(look, ["_k1", "_k2"]).select("_uid", "_runs", "_text"), _suffix_rows(unit, threshold, digits), f"_uid long, _at long, _alone boolean, {', '.join(f'{k} long' for k in keys)}")
    for k, key in enumerate(keys):
        group = keys[max(k - 1, 0) : k + 1]
        several = settle(suffixes.groupBy(*group).agg(F.count("*").alias("_n")).where("_n >= 2").select(*group), "several")
        if key == keys[-1]:  # spans that stand for copies are settled
            suffixes = suffixes.where("_alone")
        suffixes = settle(suffixes.join(several, group, "left_semi"), "suffixes")
        release(several, *([written] if k else []))
        written = suffixes
    edges = suffixes.join(look.select("_uid", "_k1", "_k2"), "_uid").select("_k1", "_k2", F.expr(f"shiftleft(_at, {RUN_BITS}) | 1").alias("_run"))

    runs = left.where("_done").select("_k1", "_k2", "_run").unionByName(same.select("_k1", "_k2", "_run")).unionByName(edges)
    # Rows that are wholly the same have one key: their runs are one set.
    listed = runs.groupBy("_k1", "_k2").agg(F.collect_set("_run").alias("_runs"))
    out = schema_of(keyed.drop("_k1", "_k2", "_text"), ("kept", "binary"), ("removed", "array<struct<start: bigint, end: bigint>>"))
    return map_batches(keyed.join(listed, ["_k1", "_k2"], "left"), _cut(unit, threshold), out)
