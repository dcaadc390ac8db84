"""Quality rules: a bitmask ledger.

Every rule is evaluated once for every document. The ledger keeps the measurements and one bit for
each failed rule; policies are versioned sets of rules, applied to the stored bits with no second
look at the texts; ablations (what does a rule remove that no other does?) are bitwise aggregations
over at most 2**rules distinct masks.

Words are runs of [^\\x20\\x09-\\x0D]. Measurements come from whole texts, by numpy passes over Arrow
batches; rules, policies and ablations are DataFrame expressions.

Defined results: a null or blank text has no words and fails too_few_words; ties and repeated rows
are judged row by row; an empty table gives an empty ledger; only the text and the carried columns
are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import map_batches, schema_of, text_or_empty
from ._text import BYTE_VALUES, U64, WHITE_SPACE, Spans, buffers, mix64, shingles, slices, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document fails the rule where the expression over the measurements is true."""

    name: str
    fails: str


#: The bit of a rule is its place here; new rules go to the end, so stored ledgers stay valid.
RULES = (
    Rule("too_few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
)
#: Policies by version: the rules that reject.
POLICIES = {
    "base-1": ("too_few_words", "repeated_windows"),
    "standard-1": ("too_few_words", "repeated_windows", "many_symbols", "short_words", "long_words", "duplicate_lines"),
}


def mask_of(rules: tuple[str, ...]) -> int:
    bits = {rule.name: 1 << bit for bit, rule in enumerate(RULES)}
    return sum(bits[name] for name in rules)


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is the key found twice or more in its row, is it an earlier one's copy)."""
    own = mix64(keys ^ (row.astype(U64) * U64(0x9E3779B97F4A7C15)))
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    same = np.concatenate([[False], ranked[1:] == ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
    twice, later = np.empty(len(own), bool), np.empty(len(own), bool)
    later[order] = same
    twice[order] = same | np.concatenate([same[1:], [False]]) if len(same) else same
    return twice, later


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of each row of a batch of texts."""
    starts, ends, first = words(data, offsets)
    n_words = np.diff(first)
    spans = Spans(BYTE_VALUES[data])
    keys, own = shingles(spans.hash(starts, ends), first, WINDOW)
    row = np.repeat(np.arange(len(n_words)), np.diff(own))
    twice, _ = _repeats(keys, row)
    at = (first[:-1][row] + np.arange(len(row)) - own[:-1][row])[twice]
    edge = np.zeros(len(starts) + WINDOW + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    covered = np.cumsum(edge)[: len(starts)] > 0

    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_end = np.concatenate([line_start[1:], [len(data)]]) if len(line_start) else line_start
    line_row = np.searchsorted(offsets, line_start, side="right") - 1
    with_break = (line_end > line_start) & (data[np.maximum(line_end, 1) - 1] == 10) if len(line_start) else np.zeros(0, bool)
    solid = np.concatenate([[0], np.cumsum(~WHITE_SPACE[data], dtype=np.int64)])
    full = solid[line_end] > solid[line_start]
    line_start, line_end, line_row = line_start[full], (line_end - with_break)[full], line_row[full]
    _, later = _repeats(spans.hash(line_start, line_end), line_row)
    n = len(n_words)
    return {
        "n_words": n_words,
        "word_chars": _sums(~WHITE_SPACE[data] & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _sums(SYMBOLS[data], offsets),
        "n_lines": np.bincount(line_row, minlength=n),
        "n_dup_lines": np.bincount(line_row[later], minlength=n),
        "n_repeat_words": _sums(covered, first),
    }


def ledger(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (default doc_id), the measurements (long) and failed_bits (long)."""
    carry = ["doc_id"] if carry is None else carry
    plain = docs.select(*(F.col(f"`{c}`") for c in carry), text_or_empty(text).alias("_text"))

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "_text"):
            found = measure(*buffers(part.column("_text")))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), *(pa.array(found[m].astype(np.int64)) for m in MEASURES)], names=[*carry, *MEASURES])

    measured = map_batches(plain, rows, schema_of(plain.drop("_text"), *((m, "bigint") for m in MEASURES)))
    bits = [F.when(F.expr(rule.fails), F.lit(1 << bit)).otherwise(0).cast("long") for bit, rule in enumerate(RULES)]
    total = bits[0]
    for more in bits[1:]:
        total = total.bitwiseOR(more)
    return measured.withColumn("failed_bits", total)


def passes(version: str, bits: str = "failed_bits") -> Column:
    """True where no rule of the policy failed."""
    return F.col(bits).bitwiseAND(F.lit(mask_of(POLICIES[version])).cast("long")) == 0


def ablations(found: DataFrame, version: str) -> DataFrame:
    """For each rule of a policy: how many rows fail it, fail it alone (kept again without it), and
    fail it with others; and the rules that ever fail together with it (bitwise or of the masks)."""
    mask = mask_of(POLICIES[version])
    masks = found.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(rule.name).alias("rule"), F.lit(1 << bit).cast("long").alias("bit")) for bit, rule in enumerate(RULES) if mask >> bit & 1))
    each = masks.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.*")
    hit, alone = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits") == F.col("bit")
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(alone, F.col("n"))), F.lit(0)).alias("n_only"),
        F.coalesce(F.sum(F.when(hit & ~alone, F.col("n"))), F.lit(0)).alias("n_shared"),
        F.coalesce(F.expr("bit_or(CASE WHEN bits & bit != 0 THEN bits END)"), F.lit(0).cast("long")).alias("with_bits"),
    )
