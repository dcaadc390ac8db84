"""Indexed search against testing every pair."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F
from sievework.operators import search

LETTERS = "abcé漢 -"


@pytest.fixture(scope="module")
def texts() -> list[tuple]:
    draw = random.Random(1)
    out = [(i, "".join(draw.choice(LETTERS) for _ in range(draw.randint(0, 40)))) for i in range(120)]
    return [*out, (200, None), (201, ""), (202, "   "), (203, "abc" * 400), (204, "a\n\nb\tc")]


def test_word_index(spark, texts, tmp_path):
    rows = spark.createDataFrame(texts, "id long, text string")
    index = search.WordIndex.build(rows, F.split("text", " "), f"file://{tmp_path}/index", buckets=5)
    assert len([x for x in os.listdir(tmp_path / "index" / "postings") if x.startswith("bucket=")]) > 1
    asked = [(1, "a b"), (2, "abc"), (3, "é"), (4, "zz"), (5, ""), (6, "c a b"), (7, "a a"), (None, "漢")]
    queries = spark.createDataFrame(asked, "query_id long, raw string")
    want = set()
    for q, raw in asked:
        terms = [t for t in raw.split(" ") if t]
        want |= {(q, i) for i, t in texts if t is not None and terms and all(any(w.startswith(x) for w in t.split(" ") if w) for x in terms)}
    found = index.search(queries, F.split("raw", " "))
    assert {tuple(r) for r in found.collect()} == want
    assert found.count() == len(want)
    plan = index.resolve(spark.createDataFrame([("ab",)], "term string"))._jdf.queryExecution().toString()
    assert "StringStartsWith(word,ab)" in plan
    assert index.search(queries.limit(0), F.split("raw", " ")).count() == 0


def test_substrings(spark, texts):
    draw = random.Random(2)
    tokens = {"".join(draw.choice(LETTERS) for _ in range(n)) for n in range(1, 13) for _ in range(4)} | {t[3 : 3 + n] for n in range(1, 13) for _, t in texts[:6] if t}
    asked = [(t,) for t in sorted(tokens)] + [(None,), ("",), ("a",)]
    rows = spark.createDataFrame(texts, "id long, text string")
    found = [tuple(r) for r in search.substring_pairs(rows, "id", "text", spark.createDataFrame(asked, "token string")).collect()]
    assert sorted(found) == sorted((i, t) for i, x in texts for t in tokens if x and t and t in x)
    assert search.substring_pairs(rows, "id", "text", spark.createDataFrame([("",)], "token string")).count() == 0


def test_passages(spark, texts):
    draw = random.Random(3)
    asked = [(i, t[s : s + draw.randint(1, 20)]) for i, (_, t) in enumerate(texts * 2) if t for s in [draw.randrange(len(t))]]
    asked += [(900, " "), (901, None), (902, ""), (903, "\n\n"), (904, "none here"), (None, "b")]
    rows, passages = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(asked, "item long, passage string")
    found = [tuple(r) for r in search.passage_pairs(rows, "id", "text", passages.where("item IS NOT NULL"), "item", "passage").collect()]
    assert sorted(found) == sorted((i, k) for i, p in asked if p and i is not None for k, t in texts if t and p in t)


def test_short_passages_do_not_deal_the_words(spark):
    def shuffled(above: int = -1) -> tuple[int, int]:
        """The last stage's number, and the records that stages above one have shuffled."""
        context, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
        context.listenerBus().waitUntilEmpty()
        none = spark.sparkContext._gateway.new_array(jvm.double, 0)
        stages = context.statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
        told = [(stages.apply(i).stageId(), stages.apply(i).shuffleWriteRecords()) for i in range(stages.size())]
        return max((i for i, _ in told), default=-1), sum(n for i, n in told if i > above)

    texts = [(i, " ".join(f"w{i}x{k}y{k * i % 7}" for k in range(300))) for i in range(60)]
    asked = [(i, p) for i, p in enumerate(["w1", "x2", "y3 w", "0 ", "w5x10y", "zz"] * 5)]
    rows, passages = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(asked, "item long, passage string")
    last, _ = shuffled()
    found = sorted(tuple(r) for r in search.passage_pairs(rows, "id", "text", passages, "item", "passage").collect())
    _, records = shuffled(last)
    assert found == sorted((i, k) for i, p in asked for k, t in texts if p in t)
    assert records < 3000  # the texts hold 18000 words


def test_passages_repeated(spark, texts, monkeypatch):
    monkeypatch.setattr(search, "PASSAGES_AT_ONCE", 3)
    texts = [*texts, (0, "other \U0001f600 b"), (300, "\u6f22"), (301, "\ub22b\xe9"), (302, "\x7f\x00\u0800"), (303, ""), (304, "a")]
    asked = [(i, p) for i, p in enumerate(["a", "\xe9", "\u6f22", "\x00", " b", "c a", "\U0001f600", "\U0001f600 b", "\u6f22\xe9", "ab", "-\u6f22", "q", "a\n\nb\tc", "other \U0001f600 b"] * 2)] + [(None, "a"), (1, "a"), (1, "a")]
    rows, passages = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(asked, "item long, passage string")
    found = [tuple(r) for r in search.passage_pairs(rows, "id", "text", passages, "item", "passage").collect()]
    want = [(i, k) for i, p in asked for k, t in texts if t and p in t]
    order = lambda pair: (pair[0] is None, pair[0] or 0, pair[1])
    assert sorted(found, key=order) == sorted(want, key=order)


@pytest.mark.parametrize("ratio", [0.92, 0.8, 0.6])
def test_near_pairs(spark, ratio):
    draw = random.Random(4)

    def edited(t: str, n: int) -> str:
        for _ in range(n):
            at = draw.randint(0, len(t))
            t = draw.choice([t[:at] + draw.choice("abcd") + t[at:], t[:at] + t[at + 1 :], t[:at] + draw.choice("abcd") + t[at + 1 :]])
        return t

    base = ["".join(draw.choice("abcd") for _ in range(draw.choice([1, 2, 5, 12, 13, 25, 40, 90]))) for _ in range(25)]
    left = [(i, edited(t, draw.randint(0, 6))) for i, t in enumerate(base)] + [(99, None), (98, "")]
    right = [(i, edited(t, draw.randint(0, 4))) for i, t in enumerate(base)] + [(99, None), (98, "")]

    def distance(x: str, y: str) -> int:
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, b in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
        return row[-1]

    want = {(i, j) for i, x in left for j, y in right if x and y and 1 - distance(x, y) / max(len(x), len(y)) >= ratio - 1e-12}
    found = search.near_pairs(spark.createDataFrame(left, "l long, t string"), "l", "t", spark.createDataFrame(right, "r long, t string"), "r", "t", ratio)
    assert {(r["l"], r["r"]) for r in found.collect()} == want
    assert len(want) > 5


def test_near_pairs_of_copies_meet_once(spark):
    rows = spark.range(60).selectExpr("id", "'a title of many copies' AS t")
    found = search.near_pairs(rows, "id", "t", rows.selectExpr("id AS other", "t"), "other", "t")
    assert found.count() == 3600 and found.distinct().count() == 3600
    assert any("near-texts" in f for f in found.inputFiles())


def test_near_pairs_make_few_substrings(spark):
    """Substrings that no partner has as a segment are told by a map of hashes and never dealt."""
    draw = random.Random(9)
    texts = ["".join(draw.choice("abcdefgh ") for _ in range(110)) for _ in range(40)]
    left, right = spark.createDataFrame(list(enumerate(texts)), "i long, x string"), spark.createDataFrame([(i, t[:50] + "#" + t[51:]) for i, t in enumerate(texts)], "j long, y string")
    keys = search._segment_keys(right, "j", "y", 0.92)
    assert keys.count() == 40 * 10
    assert 40 * 9 <= search._segment_keys(left, "i", "x", 0.92, keys).count() < 40 * 30
    found = search.near_pairs(left, "i", "x", right, "j", "y", 0.92).collect()
    assert sorted((r["i"], r["j"]) for r in found) == [(i, i) for i in range(40)] and {round(r["ratio"], 6) for r in found} == {round(1 - 1 / 110, 6)}
