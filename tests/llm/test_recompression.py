"""Recompression against brute force, and the property that it rests on."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from sievework.llm import queries, recompression

DOCS = "doc_id long, text string"


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows: list[tuple], threshold: int) -> list[tuple]:
    """doc_id, n_words, what is left; rows of one id have one text here."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        own = words(text)
        stay = [True] * len(own)
        for i in range(len(own) - threshold + 1):
            window = tuple(own[i : i + threshold])
            if window in seen:
                stay[i : i + threshold] = [False] * threshold
            seen.add(window)
        out.append((doc_id, len(own), " ".join(x for x, s in zip(own, stay, strict=True) if s)))
    return sorted(out, key=str)


def found(docs, threshold: int) -> list[tuple]:
    rows = recompression.dedup(docs, threshold=threshold).collect()
    for r in rows:
        assert r["n_words"] - sum(x["end"] - x["start"] for x in r["removed"]) == len(words(r["kept"]))
        assert all(a["end"] < b["start"] for a, b in zip(r["removed"], r["removed"][1:], strict=False))
    return sorted(((r["doc_id"], r["n_words"], r["kept"]) for r in rows), key=str)


def test_equal_stretches_have_one_symbol():
    draw = random.Random(1)
    values = np.array([draw.choice([3, 3, 5, 7, 11]) for _ in range(3000)], dtype=np.uint64)
    bounds = np.array([0, 0, 700, 1900, 3000])
    parse = recompression.Parse(values, bounds)
    for length in (1, 2, 5, 10, 20):
        start = np.array([s for s in range(3000 - length + 1) if np.searchsorted(bounds, s, "right") == np.searchsorted(bounds, s + length - 1, "right")])
        symbols = parse.symbols(start, start + length)
        spelled = [tuple(values[s : s + length].tolist()) for s in start]
        assert len(set(zip(spelled, symbols.tolist(), strict=True))) == len(set(spelled)) == len(set(symbols.tolist()))
    runs = recompression.Parse(np.full(500, 9, dtype=np.uint64), np.array([0, 500]))
    assert len(set(runs.symbols(np.arange(480), np.arange(480) + 20).tolist())) == 1


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    draw = random.Random(2)
    prose = lambda n, k=400: [f"w{draw.randrange(k)}" for _ in range(n)]
    passages = [prose(draw.randint(15, 70)) for _ in range(8)]
    texts: list = []
    for _ in range(120):
        own = prose(draw.randint(0, 60))
        for _ in range(draw.randint(0, 3)):
            at, p = draw.randint(0, len(own)), draw.choice(passages)
            cut = draw.randint(0, 10)
            own[at:at] = p[cut : len(p) - draw.randint(0, 5)]
        texts.append(draw.choice([" ", "  ", "\n"]).join(own))
    texts += [texts[5]] * 6 + [texts[7] + " more", "x " + texts[7], None, "", " \t\n"]
    texts += ["are, " * 300, "are, " * 25, "a b " * 60, "a b c " * 30, " ".join(prose(3000, 12)), " ".join(prose(19)), "schön ü " * 30]
    near = prose(200)
    for k in range(8):
        copy = list(near)
        for _ in range(k):
            copy[draw.randrange(200)] = f"e{draw.randrange(999)}"
        texts.append(" ".join(copy))
    out = [(i, t) for i, t in enumerate(texts)]
    out.append((None, texts[9]))
    draw.shuffle(out)
    return out


@pytest.mark.parametrize("threshold", [20, 7, 4])
def test_against_brute_force(spark, rows, threshold):
    clash = {n: F.lit(1) for n in ("_text", "_core", "_row", "kept", "removed", "_first", "c0", "_k1")}
    docs = spark.createDataFrame(rows, DOCS).repartition(5).withColumns(clash)
    assert found(docs, threshold) == brute(rows, threshold)


def test_small_pieces(spark, rows, monkeypatch):
    """Long rows are read in overlapping pieces, windows in several passes."""
    from sievework.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    monkeypatch.setattr(recompression, "WINDOWS_AT_ONCE", 16)
    draw = random.Random(4)
    values = np.array([draw.randrange(6) for _ in range(1000)], dtype=np.uint64)
    whole = recompression.core_spans(values, np.array([0, 1000]), 20, True)
    got = []
    for a, b, _, bounds in suffix_dedup._pieces(np.array([0, 1000]), 20):
        low, high, core, span, check = recompression.core_spans(values[a:b], bounds, 20, True)
        got += [(a + s, x) for s, e, x in zip(low, high, core.tolist(), strict=True) for s in range(s, e + 1)]
    assert sorted(got) == [(s, x) for a, e, x in zip(whole[0], whole[1], whole[2].tolist(), strict=True) for s in range(a, e + 1)]


def test_equal_rows(spark):
    text = " ".join(f"t{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text)] * 3 + [(2, "short one")] * 2 + [(2, text)], DOCS)
    assert found(docs, 20) == sorted([(1, 30, text), (1, 30, ""), (1, 30, ""), (2, 2, "short one"), (2, 2, "short one"), (2, 30, "")], key=str)


def test_empty(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    assert recompression.dedup(docs.limit(0)).count() == 0
    assert {r["kept"] for r in recompression.dedup(docs.where("text IS NULL")).collect()} == {""}


def test_registered_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_recompression(spark, sf_dir)
    assert got.columns[:4] == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(((r["doc_id"], r["n_words"], r["text"]) for r in got.collect()), key=str) == brute(docs, 20)
