"""Cleaning pipeline over `documents`: classify, near-dedup, cut repeats, mix, pack.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last
return the columns of documents. Between stages the rows are written and read again, so a lost
executor never runs an earlier stage anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import dart_minhash, mixing, packing, quality_classifier, suffix_dedup
from sievework.llm._spark import settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    whole = docs.select("text", "source", "lang", "n_chars", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    return quality_classifier.score(whole, model, carry=["_row"]).where("kept").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return dart_minhash.keep_one(docs, dart_minhash.near_duplicates(docs, similarity=0.8))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 50 words that start anywhere else too are cut from the texts; every document stays."""
    rest = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("_row"))
    cut = suffix_dedup.suffix_dedup(rest, carry=["_row"], unit="word", threshold=50)
    text = F.col("kept").cast("string")
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return cut.select(*(new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeat(docs, mixing.mix(docs, weights=(5, 2, 1), share=1.5, most=2.0))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.sequences(docs, capacity=2048)


STAGES = [
    ("quality_classifier", quality),
    ("dart_minhash", near_dedup),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]
#: Pseudo-labels, rounding and packing can't be said in SQL: tests/llm hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
