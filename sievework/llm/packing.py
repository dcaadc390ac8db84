"""Best-fit packing of tokenised documents into sequences, by swap-based local search.

Documents become pieces of at most `capacity` tokens; only a longer document is cut, its first piece
taking the remainder. Pieces are dealt at random into cells of bounded size. In a cell a best-fit
decreasing pass opens the bins, then local search improves them: between two underfull bins it moves
a document, exchanges one for one, two for one or one for two, always so that the fuller bin gains.
Each exchange raises the sum of squared fills, so the search ends, and poor bins run empty and
close. How hard it looks is an `Effort`: passes over the bins, documents of a bin that may go in pairs,
donors looked back at for one exchange, and the fill up to which later rounds take a bin up again.
THOROUGH has no such bounds: there a cell ends in a local optimum, where no move or exchange of these
kinds is left. Later rounds deal the bins that are still poor into new cells, where bins of different cells
meet, and search on from what they hold, so a round never adds a bin.

No task sees more than a cell, and cells are numbered by row, so neither hot sources nor repeated
rows make one larger.

Defined results: null and empty texts are the closing token alone; repeated rows are packed one by
one; very long texts are cut into as many pieces as they fill; ties go by length, then by place; an
empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import map_batches, schema_of, settle, text_or_empty
from ._text import slices

CAPACITY, END_ID = 2048, 0
#: Pieces of a cell, about, and rounds of search.
CELL_PIECES, ROUNDS = 4096, 3


@dataclass(frozen=True)
class Effort:
    """Bounds of the search; None is no bound."""

    passes: int | None = 8
    pairs: int | None = 12
    looks: int | None = 24
    poor: float = 0.97


USUAL, THOROUGH = Effort(), Effort(None, None, None, 1.0)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of a tokenizers file, run by the faster library on the same vocabulary and merges.

    Their ids agree (tests/llm hold them against each other). As in that library with
    add_special_tokens=False, nothing is added to a text, but the string of an added token in it is that token.
    """
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers.pre_tokenizers import ByteLevel

    plain = {c: b for b, c in zip(sorted(byte_order(), key=byte_order().get), sorted(byte_order().values()), strict=True)}
    assert set(plain) == set(ByteLevel.alphabet())
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    assert not any(token[flag] for token in model["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized"))
    special = {token["content"]: token["id"] for token in model["added_tokens"]}
    ranks = {bytes(plain[c] for c in token): rank for token, rank in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def byte_order() -> dict[int, str]:
    """Byte -> printable stand-in of byte-level vocabularies: printable bytes stand for themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def pieces(docs: DataFrame, text: str = "text", carry: list[str] | None = None, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Carried columns, piece (int), start, length, ids_crc32 (long): the pieces of every document."""
    carry = ["doc_id"] if carry is None else carry
    vocabulary = vocabulary or vocabulary_path()
    plain = docs.select(*(F.col(f"`{c}`") for c in carry), text_or_empty(text).alias("_text"))

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encode = partial(encoder(vocabulary).encode, allowed_special="all")
        for part in slices(batch, "_text"):
            row, piece, start, length, crc = [], [], [], [], []
            for i, value in enumerate(part.column("_text")):
                ids = np.array([*encode(value.as_py()), END_ID], dtype="<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in carry), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=[*carry, "piece", "start", "length", "ids_crc32"])

    return map_batches(plain, rows, schema_of(plain.drop("_text"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint")))


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins of places in `lengths`."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect_left(free, (lengths[i], -1))
        if at < len(free):
            room, b = free.pop(at)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > lengths[i]:
            insort(free, (room - lengths[i], b))
    return bins


def search(bins: list[list[int]], lengths: list[int], capacity: int, effort: Effort = USUAL) -> list[list[int]]:
    """Local search between underfull bins; returns the bins that are not empty.

    For each bin, fullest first, the parts of poorer bins (one document or two) are looked up by
    length for the exchange that fills it most.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    home = {i: b for b, own in enumerate(bins) for i in own}
    passes = 0
    while effort.passes is None or passes < effort.passes:
        passes += 1
        under = [b for b in range(len(bins)) if 0 < fill[b] < capacity]
        parts = sorted((sum(lengths[i] for i in part), b, part) for b in under for part in _parts(bins[b], lengths, effort))
        sizes = [p[0] for p in parts]
        gained = False
        for b in sorted(under, key=lambda b: -fill[b]):
            while 0 < fill[b] < capacity and (swap := _best(b, bins, home, lengths, fill, capacity, parts, sizes, effort)):
                gain, donor, given, taken = swap
                bins[b] = [i for i in bins[b] if i not in given] + list(taken)
                bins[donor] = [i for i in bins[donor] if i not in taken] + list(given)
                home |= {i: b for i in taken} | {i: donor for i in given}
                fill[b] += gain
                fill[donor] -= gain
                gained = True
        if not gained:
            break
    return [b for b in bins if b]


def _parts(own: list[int], lengths: list[int], effort: Effort) -> list[tuple[int, ...]]:
    """Single documents, and pairs of the smallest ones."""
    small = sorted(own, key=lambda i: (-lengths[i], i))[-effort.pairs :] if effort.pairs else own
    return [(i,) for i in own] + [(i, j) for n, i in enumerate(small) for j in small[n + 1 :]]


def _best(b, bins, home, lengths, fill, capacity, parts, sizes, effort):
    """(gain, donor, documents given, documents taken) that fills bin b most, or None."""
    free, best = capacity - fill[b], None
    for given in [(), *_parts(bins[b], lengths, effort)]:
        out = sum(lengths[i] for i in given)
        at = bisect_right(sizes, out + free) - 1
        for look in range(at, -1 if effort.looks is None else max(-1, at - effort.looks), -1):
            size, donor, taken = parts[look]
            gain = size - out
            if gain <= (best[0] if best else 0):
                break
            if donor != b and 0 < fill[donor] <= fill[b] and not (len(given) == 2 and len(taken) == 2) and all(home[i] == donor for i in taken):
                best = gain, donor, given, taken
                break
        if best and best[0] == free:
            break
    return best


def _pack_cell(capacity: int, first: bool, round_no: int, effort: Effort):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        lengths = rows["length"].tolist()
        if first:
            bins = best_fit(lengths, capacity)
        else:
            bins = [g.tolist() for g in rows.groupby("sequence_id", sort=True).indices.values()]
            for b in bins:
                b.sort(key=lambda i: -lengths[i])
        bins = search(bins, lengths, capacity, effort)
        place, offset, filled = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                place[i], offset[i] = k, at
                at += lengths[i]
            filled[b] = at
        cell = int(rows["_cell"].iloc[0])
        return rows.assign(sequence_id=(round_no << 58) | (cell << 24) | place, offset=offset, _fill=filled)

    return pack


def pack(cut: DataFrame, carry: list[str] | None = None, capacity: int = CAPACITY, rounds: int = ROUNDS, effort: Effort = USUAL) -> DataFrame:
    """Pieces (of `pieces`) with sequence_id and offset; sequences are gapless from offset 0."""
    carry = ["doc_id"] if carry is None else carry
    now = settle(cut, "pieces")
    done = []
    columns = [*carry, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    for round_no in range(rounds):
        count = now.count()
        cells = max(1, -(-count // CELL_PIECES))
        if not round_no:
            dealt = now.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).withColumn("_fill", F.lit(0).cast("long"))
            dealt = dealt.withColumn("_cell", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(cells)).cast("long"))
        else:
            dealt = now.withColumn("_cell", F.pmod(F.xxhash64(F.lit(round_no), "sequence_id"), F.lit(cells)).cast("long"))
        packed = settle(dealt.groupBy("_cell").applyInPandas(_pack_cell(capacity, not round_no, round_no, effort), dealt.schema).drop("_cell"), "packed")
        poor = F.col("_fill") <= int(effort.poor * capacity)
        if round_no < rounds - 1:
            done.append(packed.where(~poor))
            now = packed.where(poor)
        else:
            done.append(packed)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*(F.col(f"`{c}`") for c in columns))


def sequences(docs: DataFrame, text: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, carry: list[str] | None = None, effort: Effort = USUAL) -> DataFrame:
    """Tokenise, cut and pack a table of documents."""
    return pack(pieces(docs, text, carry, vocabulary, capacity), carry, capacity, effort=effort)
