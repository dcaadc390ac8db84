"""Shared Spark helpers: lineage cuts in the cluster's shared folder, row keys, distributed ranks."""

from __future__ import annotations

import re
import secrets
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import use_key

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset, as in local tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sievework-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet in the shared folder and read them back.

    Cuts the lineage so that what follows survives lost executors without running the work before
    it again, and so that values which could differ between attempts are fixed once. The shuffle
    files behind the written rows go when the write ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sievework/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def release(*settled: DataFrame) -> None:
    """Delete what `settle` wrote for these frames; only where all that reads them has been settled itself."""
    for df in settled:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_keys(*columns: Column | str) -> list[Column]:
    """Two independent 64-bit hashes of a row's values: the same row has the same key in every scan."""
    return [F.xxhash64(F.lit("a"), *columns).alias("_k1"), F.xxhash64(F.lit("b"), *columns).alias("_k2")]


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def schema_of(df: DataFrame, *more: tuple[str, str]) -> T.StructType:
    out = T.StructType(list(df.schema.fields))
    for name, kind in more:
        out = out.add(name, T._parse_datatype_string(kind), True)
    return out


HASH_KEY = "spark.sievework.hash.key"


def hash_key(spark: SparkSession) -> int:
    """The key of this application's hashes: the setting, or a number drawn once an application."""
    held = spark.conf.get(HASH_KEY, None)
    if held is None:
        held = str(secrets.randbits(63))
        spark.conf.set(HASH_KEY, held)
    use_key(int(held))
    return int(held)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """`f` over Arrow batches, in workers that hash by the application's key."""
    key = hash_key(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_key(key)
        for batch in batches:
            yield from f(batch)

    return df.mapInArrow(run, schema)


def with_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Consecutive numbers from 0 in the given total order, with no single-task sort.

    Rows are dealt into ranges, numbered inside each range, and shifted by the sizes of the ranges
    before; the table of range sizes has one row per partition.
    """
    from pyspark.sql import Window

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    sizes = sorted((r["_range"], r["n"]) for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).collect())
    rows, total = [], 0
    for part, size in sizes:
        rows.append((part, total))
        total += size
    shift = df.sparkSession.createDataFrame(rows, "_range int, _before long")
    return inside.join(F.broadcast(shift), "_range").withColumn(name, F.col("_before") + F.col("_at") - 1).drop("_range", "_before", "_at")
