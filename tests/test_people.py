"""People against notices: lists and counts made without pairing people and records hold against the pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import matching as M
from sievework.operators.policy import STRICT
from sievework.plans import registry

PEOPLE = "query_id long, name string, institution string, email string, doi string, pmid string"
RECORDS = "record_id string, author string, institution string, original_doi string, retraction_doi string, original_pmid string, retraction_pmid string"
NAMES = ["John Smith", "J Smith", "Jane Smith", "Smith John", "Smith J", "John A Smith", "John Quill Smith", "J. A. Smith", "Smith", "Jo Smith", "", "--", "王 小明", "王 小", "小明 王", "Ann Lee", "A Lee", "Lee Ann", "J J", "S John", "Xander Smith", "Smith X"]
PLACES = ["north institute xx", "south college xx", None, "unrelated school", "academy xx"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(7)
    ids = [f"10.1/{i}" for i in range(6)]
    pick = lambda k: rng.choice([*ids[:k], "", ""])
    people = [(i, rng.choice([*NAMES, "Nobody Known", None]), rng.choice(PLACES), rng.choice([None, "x@mail.north.org", "x@gmail.com"]), pick(6), "" if i % 9 else "77") for i in range(120)]
    records = [(f"D{i:04}", ";".join(rng.choice(NAMES) for _ in range(rng.randint(1, 3))), f"{rng.choice(PLACES[:2])};academy xx", pick(5), "", "77" if i % 50 == 0 else "", "") for i in range(260)]
    return spark.createDataFrame(people, PEOPLE), spark.createDataFrame(records, RECORDS)


@pytest.mark.parametrize("limit", [3, 10])
def test_lists_are_those_of_all_pairs(tables, limit):
    people, records = tables
    shown = lambda df: sorted(tuple(r) for r in M.rank_people(df, limit).select("query_id", "record_id", "kind", "rank", "score", "verdict", "matched_fields").collect())
    want = shown(M.score_people(M.person_routes(people, records), people, records))
    assert want and shown(M.listed_people(people, records, limit)) == want


def test_lists_of_copies_make_no_pairs(spark):
    people = spark.range(300).select(F.col("id").alias("query_id"), F.lit("John Smith").alias("name"), *(F.lit("").alias(c) for c in ("institution", "email", "doi", "pmid")))
    records = spark.range(400).select(F.format_string("D%04d", "id").alias("record_id"), F.lit("John Smith;J Smith").alias("author"), *(F.lit("").alias(c) for c in ("institution", "original_doi", "retraction_doi", "original_pmid", "retraction_pmid")))
    found = M.listed_people(people, records)
    assert {r["count"] for r in found.groupBy("query_id").count().collect()} == {10} and found.agg(F.max("record_id")).first()[0] == "D0009"


def test_given_pairs_and_counts_hold_against_the_routes(tables):
    people, records = tables
    pool = M.person_routes(people, records)
    want = sorted(tuple(r) for r in pool.select("query_id", "record_id").collect())
    every = people.select("query_id").crossJoin(records.select("record_id"))
    assert len(set(want)) == len(want) and sorted(tuple(r) for r in M.routed(every, people, records).collect()) == want
    strict = M.score_people(pool, people, records, STRICT).groupBy("verdict").count().collect()
    assert {tuple(r) for r in M.hard_verdict_counts(people, records, STRICT).collect()} == {tuple(r) for r in strict}


def test_pairs_are_scored_where_they_meet(spark, tables, sf_dir):
    people, records = tables
    shown = lambda df: sorted(tuple(r) for r in df.select("query_id", "record_id", *M.PERSON_EVIDENCE).collect())
    want = shown(M.score_people(M.person_routes(people, records), people, records))
    assert want and shown(M.scored_people(people, records)) == want
    registry.load()
    for name in ("c05_person_scores", "c06_person_verdicts"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        joins = [line for line in plan.splitlines() if "Join" in line]
        assert "key#" in joins[0] and "part#" in joins[0], joins[0]  # no join after that of the keys


def test_frequent_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(M, "KEYS_A_PART", 10)
    asked = spark.range(100).select(F.col("id").alias("query_id"), F.when(F.col("id") < 90, "a").otherwise("b").alias("key"))
    held = spark.range(50).select(F.col("id").cast("string").alias("record_id"), F.when(F.col("id") < 40, "a").otherwise("b").alias("key"))
    pairs = M.key_pairs(asked, held)
    assert pairs.count() == pairs.distinct().count() == 90 * 40 + 10 * 10
    assert pairs.where("key = 'a'").select(F.spark_partition_id()).distinct().count() > 1
