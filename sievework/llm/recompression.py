"""Substring dedup by recompression.

Recompression rewrites all documents in rounds. A round names each maximal run of one symbol (symbol,
length), then deals symbols into left and right ones and names each pair of a left symbol and a right
one after it. The first symbols are words. Names have to be the same wherever the same run or pair
stands in the corpus: a name is a hash, by the key of the run, of what it stands for, so all tasks agree on
it without asking (a dictionary would have to shuffle every occurrence once a round).

Whether two neighbours are joined depends on them alone. So inside any stretch of words all symbols are settled
by the stretch itself, but for a few at its edges that could be joined to what stands outside. Take off,
round by round, the first and the last run, a first symbol that is a right one, and a last symbol that is a left
one: what is taken off and what remains is the same for equal stretches wherever they stand, and spells
the stretch. Folding what is taken off until nothing remains gives one high-level symbol for the stretch
(`Parse.symbols`): equal stretches have the same, and any stretch is named in a number of steps that grows with
the logarithm of its length.

A window is `threshold` words. How repeats are found:

1. Reveal. Of all stretches of threshold / 2 words in a window, the one with the least symbol is its core.
   Spark counts the cores of the corpus; equal windows have equal cores at equal places, so windows of a
   core that is found once drop out.
2. Span. The windows of one core occurrence are neighbours; the words they cover are its span. Spark groups spans
   by core, symbol and a second hash of other kind (a polynomial at a secret point), which has to agree too.
   The earliest of equal spans stands for them; all words of the others go.
3. Verify. Where a core has several spans, windows of those that stand for others are compared one by one
   by symbol and second hash, and the earliest of equal windows stays.

Both hashes together have 125 bits of the run's key; nothing else decides that two windows are equal.

Order is by doc_id, nulls last, then (rows of one doc_id) by hashes of the row, then by place. Defined results: a
null text has no words; documents with fewer words than a window keep all; of wholly equal rows one is
the first document and the others are removed but for words in no window; very long texts are read in
overlapping pieces, each window in exactly one; an empty table gives no rows; columns that aren't named are
not read, and named ones may be called anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import map_batches, release, row_keys, schema_of, settle, text_or_empty
from ._text import MASK64, U64, Spans, buffers, mix64, slices, word_hashes, words
from .suffix_dedup import RUN_BITS, _pieces, sliding_min

#: Odd constants that keep runs, pairs, sides and rounds apart.
_RUN, _PAIR, _LEFT, _RIGHT, _DEEPER, _ONE = (U64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93))
#: Windows that one numpy pass compares.
WINDOWS_AT_ONCE = 1 << 20


class Round:
    """A round over all symbols of a stretch of documents; `edge` is true where a document begins."""

    def __init__(self, symbols: np.ndarray, edge: np.ndarray, number: int) -> None:
        n = len(symbols)
        self.symbols = symbols
        new = edge.copy()
        new[1:] |= symbols[1:] != symbols[:-1]
        self.run_start = np.flatnonzero(new)
        self.run_end = np.append(self.run_start[1:], n)
        self.run_of = np.cumsum(new) - 1
        length = (self.run_end - self.run_start).astype(U64)
        self.runs = symbols[self.run_start]
        several = length > 1
        self.runs[several] = mix64(self.runs[several] * _RUN + length[several])
        edge = edge[self.run_start]
        salt = U64((number + 1) * int(_PAIR) & MASK64)
        self.right = (mix64(self.runs ^ salt) & U64(1)).astype(bool)
        begins = np.ones(len(self.runs), dtype=bool)
        begins[1:] = self.right[:-1] | ~self.right[1:] | edge[1:]
        self.pair_of = np.cumsum(begins) - 1
        at = np.flatnonzero(begins)
        self.next, self.next_edge = self.runs[at], edge[at]
        joined = np.flatnonzero(np.diff(np.append(at, len(self.runs))) > 1)
        self.next[joined] = mix64(mix64(self.runs[at[joined]] * _PAIR) + self.runs[at[joined] + 1])


class Parse:
    """The rounds over a stretch of documents, made as they are asked for."""

    def __init__(self, values: np.ndarray, bounds: np.ndarray) -> None:
        edge = np.zeros(len(values), dtype=bool)
        edge[bounds[:-1][bounds[:-1] < len(values)]] = True
        self.begin, self.rounds = (values, edge), []

    def round(self, number: int) -> Round:
        while len(self.rounds) <= number:
            last = self.rounds[-1] if self.rounds else None
            self.rounds.append(Round(*((last.next, last.next_edge) if last else self.begin), len(self.rounds)))
        return self.rounds[number]

    def symbols(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The high-level symbol of each stretch of words start:end, each inside one document and not empty."""
        out = np.zeros(len(start), dtype=U64)
        own, a, b = np.arange(len(start)), start, end
        fold, number = np.full(len(start), _ONE, dtype=U64), 0
        while len(own):
            now = self.round(number)
            first, last = now.run_of[a], now.run_of[b - 1]
            one = first == last
            left = np.where(one, b, now.run_end[first]) - a
            right = np.where(one, 0, b - now.run_start[last])
            fold = mix64(fold * _LEFT + (now.symbols[a] ^ (left.astype(U64) * _RUN)))
            fold = mix64(fold * _RIGHT + (now.symbols[b - 1] ^ (right.astype(U64) * _RUN)))
            a, b = first + 1, last
            open_ = np.flatnonzero(a < b)
            out[own] = fold
            own, a, b, fold = own[open_], a[open_], b[open_], fold[open_]
            off = now.right[a]
            fold = np.where(off, mix64(fold * _LEFT + now.runs[a] + _PAIR), fold)
            a = a + off
            off = (a < b) & ~now.right[b - 1]
            fold = np.where(off, mix64(fold * _RIGHT + now.runs[b - 1] + _PAIR), fold)
            b = b - off
            out[own] = fold
            open_ = np.flatnonzero(a < b)
            own, fold = own[open_], mix64(fold[open_] * _DEEPER + U64(1))
            a, b = now.pair_of[a[open_]], now.pair_of[b[open_] - 1] + 1
            number += 1
        return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    data, offsets = buffers(batch.column("_text"))
    starts, ends, first = words(data, offsets)
    return data, offsets, starts, ends, first


def core_spans(values: np.ndarray, bounds: np.ndarray, threshold: int, with_spans: bool) -> tuple[np.ndarray, ...] | None:
    """(first window, last window, core) of every core occurrence, and the symbol and second hash of its span."""
    long = np.diff(bounds) >= threshold
    if not long.any():
        return None
    half, parse = threshold // 2, Parse(values, bounds)
    begin = np.arange(len(values) - half + 1)
    whole = np.searchsorted(bounds, begin, side="right") == np.searchsorted(bounds, begin + half - 1, side="right")
    core = np.full(len(begin), U64(0xFFFFFFFFFFFFFFFF))
    core[whole] = parse.symbols(begin[whole], begin[whole] + half)
    bits = U64(max(1, len(core).bit_length()))
    least = sliding_min((core >> bits << bits) | np.arange(len(core), dtype=U64), threshold - half + 1)
    inside = np.zeros(len(values) + 1, dtype=np.int64)
    inside[bounds[:-1][long]] += 1
    np.add.at(inside, bounds[1:][long] - threshold + 1, -1)
    valid = np.flatnonzero(np.cumsum(inside[: len(least)]) > 0)
    at = (least[valid] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    cut = np.flatnonzero(np.diff(at)) + 1
    low, high = valid[np.append(0, cut)], valid[np.append(cut, len(at)) - 1]
    at = at[np.append(0, cut)]
    if not with_spans:
        return low, high, core[at]
    end, shift = high + threshold, (at - low).astype(U64) * _RUN
    return low, high, core[at], mix64(parse.symbols(low, end) ^ shift), mix64(Spans(values).hash(low, end) ^ shift)


def _core_rows(threshold: int, with_spans: bool):
    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "_text"):
            data, _, starts, ends, first = _words(part)
            values = word_hashes(data, starts, ends)
            for a, b, own, bounds in _pieces(first, threshold):
                found = core_spans(values[a:b], bounds, threshold, with_spans)
                if found is None:
                    continue
                low, high, core, *more = found
                if not with_spans:
                    yield pa.RecordBatch.from_arrays([_signed(core)], names=["_core"])
                    continue
                row = own[np.searchsorted(bounds, low, side="right") - 1]
                run = ((a + low - first[row]) << RUN_BITS) | (high - low + 1)
                ids = [part.column(c).take(pa.array(row)) for c in ("_id", "_k1", "_k2")]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(run), _signed(core), *map(_signed, more)], names=["_id", "_k1", "_k2", "_run", "_core", "_span", "_check"])

    return rows


def _window_rows(threshold: int):
    """A row for each window of the listed runs."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "_text"):
            data, _, starts, ends, first = _words(part)
            values = word_hashes(data, starts, ends)
            lists = part.column("_runs")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            packed = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy()
            doc, start, count = np.repeat(np.arange(part.num_rows), np.diff(offsets)), packed >> RUN_BITS, packed & ((1 << RUN_BITS) - 1)
            for a, b, own, bounds in _pieces(first, threshold):
                # The runs of these documents that begin in this piece; a run never leaves its piece.
                base = first[doc] + start
                mine = np.flatnonzero((base >= a) & (base + count + threshold - 1 <= b) & (doc >= own[0]) & (doc <= own[-1]))
                parse, spans = Parse(values[a:b], bounds), Spans(values[a:b])
                for some in np.split(mine, np.flatnonzero(np.diff(np.cumsum(count[mine]) // WINDOWS_AT_ONCE)) + 1):
                    n = count[some]
                    of = np.repeat(some, n)
                    at = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                    low = first[doc[of]] + at - a
                    ids = [part.column(c).take(pa.array(doc[of])) for c in ("_id", "_k1", "_k2")]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array((at << RUN_BITS) | 1), _signed(parse.symbols(low, low + threshold)), _signed(spans.hash(low, low + threshold))], names=["_id", "_k1", "_k2", "_run", "_window", "_check"])

    return rows


def _cut(threshold: int):
    """Adds kept (the words that stay, joined by one space), n_words and the removed word ranges, merged, in order."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "_text"):
            data, _, starts, ends, first = _words(part)
            raw, lists, kept, spans = data.tobytes(), part.column("_runs"), [], []
            for i in range(part.num_rows):
                n, packed = int(first[i + 1] - first[i]), lists[i].values
                stay, cut = np.ones(n, dtype=bool), []
                if packed is not None and len(packed):
                    packed = packed.to_numpy(zero_copy_only=False)
                    low = packed >> RUN_BITS
                    high = np.minimum(low + (packed & ((1 << RUN_BITS) - 1)) + threshold - 1, n)
                    edge = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(edge, low, 1)
                    np.add.at(edge, high, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    turn = np.flatnonzero(np.diff(np.concatenate([[True], stay, [True]]).astype(np.int8)))
                    cut = [{"start": int(s), "end": int(e)} for s, e in zip(turn[::2], turn[1::2], strict=True)]
                at = first[i] + np.flatnonzero(stay)
                kept.append(b" ".join([raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]).decode())
                spans.append(cut)
            carry = [c for c in part.schema.names if c not in ("_text", "_runs")]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            out = [*(part.column(c) for c in carry), pa.array(kept, pa.string()), pa.array(np.diff(first)), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(out, names=[*carry, "kept", "n_words", "removed"])

    return rows


def dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text", carry: list[str] | None = None, threshold: int = 20) -> DataFrame:
    """Remove every word covered by a window of `threshold` words whose words also start earlier.

    Words are runs of [^\\x20\\x09-\\x0D]+. Windows are judged on the input. carry: columns to return (default the
    id). Returns them with kept (string: the words that stay, joined by one space), n_words (long) and removed
    (array<struct<start, end>>: maximal removed ranges of words).
    """
    if not 4 <= threshold < 1 << RUN_BITS:
        raise ValueError("threshold must be from 4 on")
    carry = [id_column] if carry is None else carry
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)))
    keyed = docs.select(row.alias("_row"), F.col(f"`{id_column}`").cast("long").alias("_id"), text_or_empty(text).alias("_text"))
    keyed = keyed.select("*", *row_keys("_row", "_id", "_text"))
    plain = keyed.select("_id", "_k1", "_k2", "_text")

    # Reveal: cores found once drop out. Only the cores that are left are written, and met once.
    cores = map_batches(plain.select("_text"), _core_rows(threshold, False), "_core long")
    shared = settle(cores.groupBy("_core").agg(F.count("*").alias("_n")).where("_n >= 2").select("_core"), "shared")
    rows = map_batches(plain, _core_rows(threshold, True), "_id long, _k1 long, _k2 long, _run long, _core long, _span long, _check long")
    left = settle(rows.join(shared, "_core", "left_semi"), "cores")
    release(shared)

    # Span: the earliest of equal spans stands for them.
    place = F.struct(F.col("_id").isNull().alias("n"), "_id", "_k1", "_k2", "_run")
    first = settle(left.groupBy("_core", "_span", "_check").agg(F.min(place).alias("_first")), "spans")
    several = first.groupBy("_core").agg(F.count("*").alias("_kinds")).where("_kinds > 1").select("_core")
    later = left.join(first, ["_core", "_span", "_check"]).where(place != F.col("_first")).select("_k1", "_k2", "_run")

    # Verify: windows of the spans that stand for others, one by one.
    look = first.join(several, "_core", "left_semi").select("_first._k1", "_first._k2", "_first._run").groupBy("_k1", "_k2").agg(F.collect_set("_run").alias("_runs"))
    windows = settle(map_batches(plain.join(look, ["_k1", "_k2"]), _window_rows(threshold), "_id long, _k1 long, _k2 long, _run long, _window long, _check long"), "windows")
    least = windows.groupBy("_window", "_check").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n >= 2")
    edges = windows.join(least, ["_window", "_check"]).where(place != F.col("_first")).select("_k1", "_k2", "_run")
    runs = settle(later.unionByName(edges).groupBy("_k1", "_k2").agg(F.collect_set("_run").alias("_runs")), "runs")
    release(left, first, windows)

    # Wholly equal rows: one is cut like any other, of the rest only words in no window stay.
    again = settle(keyed.groupBy("_k1", "_k2").agg(F.count("*").alias("_copies")).where("_copies >= 2"), "again")
    single = keyed.join(again.select("_k1", "_k2"), ["_k1", "_k2"], "left_anti").join(runs, ["_k1", "_k2"], "left").select("_row", "_text", "_runs")
    held = keyed.join(again, ["_k1", "_k2"]).groupBy("_k1", "_k2").agg(F.first("_row").alias("_row"), F.first("_text").alias("_text"), F.first("_copies").alias("_copies"))
    copies = held.join(runs, ["_k1", "_k2"], "left").select("_row", "_text", "_runs", F.explode(F.expr("sequence(1L, _copies)")).alias("_nth"))
    n_words = F.size(F.regexp_extract_all("_text", F.lit(r"[^\x20\x09-\x0D]+"), 0))
    most = (1 << RUN_BITS) - 1
    every = F.transform(F.sequence(F.lit(0).cast("long"), n_words.cast("long"), F.lit(most).cast("long")), lambda s: F.shiftleft(s, RUN_BITS).bitwiseOR(F.lit(most).cast("long")))
    copies = copies.withColumn("_runs", F.when((F.col("_nth") > 1) & (n_words >= threshold), every).otherwise(F.col("_runs"))).drop("_nth")
    both = single.unionByName(copies)
    out = map_batches(both, _cut(threshold), schema_of(both.select("_row"), ("kept", "string"), ("n_words", "bigint"), ("removed", "array<struct<start: bigint, end: bigint>>")))
    return out.select(*(F.col(f"_row.c{i}").alias(c) for i, c in enumerate(carry)), "kept", "n_words", "removed")
