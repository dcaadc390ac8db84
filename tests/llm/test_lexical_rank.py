"""Ranked lexical search against brute force, over odd rows and over blocks of items."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from sievework.llm import lexical_rank

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
WORDS = "a b Ab aB été ÉTÉ x1 2 über straße 漢字 ß the of and in".split()


def terms(text: str | None) -> list[str]:
    lowered = (text or "").translate(str.maketrans(lexical_rank.UPPER, lexical_rank.LOWER))
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(x for _, b in bags for x in b)
    wanted: dict = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, own in wanted.items():
        scored = []
        for d, b in bags:
            m = 10 + 90 * sum(b.values()) * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * b[x] // (1000 * b[x] + 8 * m)) for x in own if b[x])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def ranked(docs, items, **more) -> list[tuple]:
    return sorted((tuple(r) for r in lexical_rank.rank(docs, items, **more).select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def rows() -> tuple[list[tuple], list[tuple]]:
    draw = random.Random(7)
    gap = lambda: draw.choice([" ", "\n", "-", "_", "\x00", "{", "  "])
    text = lambda n: "".join(draw.choice(WORDS) + gap() for _ in range(n))
    texts = [text(draw.randint(0, 30)) for _ in range(80)] + [None, "", " ._ ", text(5000), "zzz zzz"]
    texts += [texts[3]] * 30 + ["the of", "of the", "THE OF", "the the of of"]
    docs = [(i * 7 % 131, t) for i, t in enumerate(texts)]
    docs += [docs[0], docs[3], (None, texts[3]), (None, "été the"), (5, texts[3])]
    draw.shuffle(docs)
    items = [(i, text(draw.randint(1, 8))) for i in range(12)] + [(20, None), (21, ""), (22, "nowhere"), (3, "über x1"), (None, "the été"), (4, "the the The")]
    return docs, items


@pytest.mark.parametrize(("k", "more"), [(10, {}), (3, {"terms_at_once": 9}), (40, {"items_at_once": 4}), (1, {})])
def test_against_brute_force(spark, rows, k, more):
    docs, items = rows
    clash = {"_bag": 1, "_m": 2, "score": 3, "rank": 4, "_at": 5, "item_id": 6}
    given = spark.createDataFrame(docs, DOCS).repartition(5).withColumns({n: F.lit(v) for n, v in clash.items()})
    asked = spark.createDataFrame(items, ITEMS).repartition(3).withColumns({"_id": F.lit(1), "doc_id": F.lit(2)})
    assert ranked(given, asked, k=k, **more) == brute(docs, items, k)


def test_small_passes(spark, rows, monkeypatch):
    """Slices and stretches of a few rows give the same rows."""
    docs, items = rows
    with monkeypatch.context() as at:
        at.setattr(lexical_rank, "SCORES_AT_ONCE", 64)
        at.setattr(lexical_rank, "MATCHES_AT_ONCE", 5)
        own = lexical_rank.Items([0, 1], lexical_rank.np.array([0, 1, 1]), lexical_rank.np.array([0, 0, 1]), lexical_rank.np.array([3, 5]))
        got = own.score(lexical_rank.np.array([0 << 32 | 2, 1 << 32 | 1, 1 << 32 | 4]), lexical_rank.np.array([0, 2, 3]), lexical_rank.np.array([100, 10]))
    g = lambda tf, m: 10**9 * tf // (1000 * tf + 8 * m)
    assert got.tolist() == [[3 * g(2, 100) + 5 * g(1, 100), 5 * g(1, 100)], [5 * g(4, 10), 5 * g(4, 10)]]


def test_empty_tables(spark, rows):
    docs, items = spark.createDataFrame(rows[0], DOCS), spark.createDataFrame(rows[1], ITEMS)
    assert lexical_rank.rank(docs, items.limit(0)).count() == 0
    assert lexical_rank.rank(docs.limit(0), items).count() == 0
    assert lexical_rank.rank(docs.where("text IS NULL"), items).count() == 0
