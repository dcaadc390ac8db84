"""The pipeline's stages, one after the other, against brute force."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("steps"), spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, sf_dir)
        found.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def test_columns(spark, sf_dir, steps):
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert all(step.columns == columns for step in steps[:-1])
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_quality_keeps_the_clean(spark, sf_dir, steps):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = steps[0].select("doc_id").withColumn("k", F.lit(1))
    rows = labels.join(kept, "doc_id", "left").collect()
    good = [r["k"] == 1 for r in rows if r["quality"] == 1]
    bad = [r["k"] is None for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) >= 0.9 * len(bad)


def test_one_of_each_near_duplicate_stays(steps):
    def shingles(text):
        w = text.encode().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    before = {r["doc_id"]: shingles(r["text"]) for r in steps[0].collect()}
    after = {r["doc_id"] for r in steps[1].collect()}
    near = lambda a, b: a and b and 5 * len(a & b) >= 4 * len(a | b)
    assert not any(near(before[a], before[b]) for a in after for b in after if a < b)
    reached = set(after)
    while more := {i for i in before if i not in reached and any(near(before[i], before[j]) for j in reached)}:
        reached |= more
    assert reached == set(before)


def test_repeats_are_cut(steps):
    word = re.compile(r"[^\x20\x09-\x0d]+")
    before, after = ({r["doc_id"]: r["text"] for r in s.collect()} for s in steps[1:3])
    grams = Counter()
    for text in before.values():
        w = word.findall(text)
        grams.update(tuple(w[i : i + 50]) for i in range(len(w) - 49))
    assert before.keys() == after.keys()
    for doc_id, text in before.items():
        spans = [m.span() for m in word.finditer(text)]
        w = [text[a:b] for a, b in spans]
        gone = bytearray(len(text))
        for i in range(len(w) - 49):
            if grams[tuple(w[i : i + 50])] > 1:
                gone[spans[i][0] : spans[i + 49][1]] = b"\1" * (spans[i + 49][1] - spans[i][0])
        assert after[doc_id] == "".join(c for c, g in zip(text, gone, strict=True) if not g)


def test_mix_and_pack(spark, steps):
    copies = Counter(r["doc_id"] for r in steps[3].select("doc_id").collect())
    assert max(copies.values()) <= 2 and set(copies) <= {r["doc_id"] for r in steps[2].select("doc_id").collect()}
    assert steps[3].join(steps[2].select("doc_id", F.col("text").alias("t")), "doc_id").where("text != t").count() == 0
    packed = steps[4]
    assert packed.where("piece = 0").count() == sum(copies.values())
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r["n"] == r["end"] <= 2048 for r in rows)


def test_odd_rows_in_every_stage(spark, sf_dir):
    """Nulls in any column, blank and repeated rows, and extra columns named like those of the operators."""
    some = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, "a", 0), (1, "", None, "a", 0), (2, " \n", "en", None, None), (3, "x " * 4000, "en", "a", 8000), (3, "x " * 4000, "en", "a", 8000)], some.schema)
    docs = some.unionByName(odd)
    for name in ("kept", "score", "removed", "copies", "size", "class_id", "piece", "_k1", "_text"):
        docs = docs.withColumn(name, F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() > 0 and (name == "packing" or out.columns == docs.columns)
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
