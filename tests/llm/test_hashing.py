"""Span hashes: exact values by definition, and texts made to collide under a polynomial hash modulo 2**64."""

from __future__ import annotations

import random

import numpy as np
import pytest
from sievework.llm import _text, dart_minhash, license_scan, quality_rules, suffix_dedup

DOCS = "doc_id long, text string"


def thue_morse(k: int) -> str:
    return "".join("ab"[bin(i).count("1") & 1] for i in range(1 << k))


S = thue_morse(10)
T = S.translate(str.maketrans("ab", "ba"))


def by_definition(values: list[int], key: int) -> int:
    point, total = _text.point_of(key), 0
    for i, v in enumerate(values):
        total = (total + v * pow(point, i, _text.PRIME)) % _text.PRIME
    return int(_text.mix64(np.array([(total + len(values) * 0x9E3779B97F4A7C15) & _text.MASK64], dtype=np.uint64))[0])


@pytest.mark.parametrize("key", [0, 1, 2**63 - 1])
def test_spans_by_definition(key):
    draw = random.Random(key)
    values = [draw.getrandbits(64) for _ in range(60)]
    spans = _text.Spans(np.array(values, dtype=np.uint64), key)
    for _ in range(50):
        s = draw.randint(0, 60)
        e = draw.randint(s, 60)
        assert int(spans.hash(np.array([s]), np.array([e]))[0]) == by_definition(values[s:e], key)
    assert [int(x) for x in spans.windows(7)] == [by_definition(values[i : i + 7], key) for i in range(54)]
    assert len(spans.windows(61)) == 0
    raw = np.frombuffer(bytes(draw.randrange(256) for _ in range(40_000)), dtype=np.uint8)
    short = _text.Spans(_text.BYTE_VALUES[raw], key)
    for s, e in ((0, 40_000), (5, 20), (16_380, 16_390), (30_000, 39_999)):
        assert int(short.hash(np.array([s]), np.array([e]))[0]) == by_definition([int(x) + 1 for x in raw[s:e]], key)


def test_keys_differ():
    values = np.arange(1, 9, dtype=np.uint64)
    assert _text.Spans(values, 1).windows(8)[0] != _text.Spans(values, 2).windows(8)[0]


def test_rules_tell_lines_and_windows_apart(spark):
    lines = f"{S}\n{T}\nother"
    windows = " ".join(["x", "y", S, "z", "w", "and", "x", "y", T, "z", "w"])
    found = {r["doc_id"]: r for r in quality_rules.ledger(spark.createDataFrame([(0, lines), (1, windows)], DOCS)).collect()}
    assert found[0]["n_dup_lines"] == 0
    assert found[1]["n_repeat_words"] == 0


def test_suffix_dedup_keeps_both(spark):
    front, back = [f"w{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    rows = [(i, " ".join([*front, middle, *back])) for i, middle in enumerate((S, T))]
    found = {r["doc_id"]: bytes(r["kept"]).decode() for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, DOCS), unit="word", threshold=50).collect()}
    assert found == dict(rows)


def test_near_dedup_keeps_two_classes(spark):
    rows = [(i, f"one two {middle} four five") for i, middle in enumerate((S, T))]
    found = dart_minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len({r["class_id"] for r in found}) == 2


def test_license_needs_its_words(spark):
    words = [f"term{i}" for i in range(40)]
    template = " ".join([*words[:20], S, *words[20:]])
    rows = [(0, template), (1, template.replace(S, T))]
    found = license_scan.scan(spark.createDataFrame(rows, DOCS), templates={"own": template}, containment=1.0).collect()
    assert [r["doc_id"] for r in found] == [0]
