"""Sinks of micro-batches that may be tried again: audit rows once each, and a retention sweep.

A stream hands its sink (rows, batch id) and, after a failure, the same batch again. What a batch writes goes to a
folder of its number, whole or not at all, so trying again replaces it; and a sweep deletes by condition, so
sweeping twice deletes no more than once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def append_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """The rows of a batch, once, however often it is tried."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def audit_sink(stream: DataFrame, path: str) -> DataStreamWriter:
    """An append-only audit table that a stream feeds."""
    return stream.writeStream.foreachBatch(lambda rows, batch_id: append_batch(rows, batch_id, path))


def audit_rows(spark: SparkSession, path: str) -> DataFrame:
    """The audit table, with the number of the batch that wrote each row."""
    return spark.read.parquet(path)


def expired(rows: DataFrame, at: str, now_ms: int, keep_hours: float) -> DataFrame:
    """Rows at or before the retention cutoff."""
    return rows.where(F.unix_millis(F.col(at).cast("timestamp")) <= now_ms - int(keep_hours * 3_600_000))


def sweep(spark: SparkSession, path: str, at: str, now_ms: int, keep_hours: float) -> int:
    """Rewrite the batches that hold rows past retention without them; how many rows went.

    Other batches are not touched, so a sweep costs what it deletes from, and a repeated one deletes nothing. What a
    batch keeps is written beside it first; a sweep that was stopped after that is finished by the next one.
    """
    _finish(spark, path)
    rows = audit_rows(spark, path)
    hit = {r["batch"]: r["n"] for r in expired(rows, at, now_ms, keep_hours).groupBy("batch").agg(F.count("*").alias("n")).collect()}
    for batch in hit:
        own = spark.read.parquet(f"{path}/batch={batch}")
        kept = own.join(expired(own, at, now_ms, keep_hours).select(at).distinct(), at, "left_anti").select(*own.columns)
        kept.write.mode("overwrite").parquet(f"{path}/_swept-{batch}")
        _finish(spark, path)
    return sum(hit.values())


def _finish(spark: SparkSession, path: str) -> None:
    """Put what whole `_swept-` folders keep in place of their batches; unfinished ones go."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    files = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.globStatus(Path(f"{path}/_swept-*")) or []:
        fresh = found.getPath()
        if files.exists(Path(fresh, "_SUCCESS")):
            batch = fresh.getName().removeprefix("_swept-")
            # Parquet files with their schema are there even where no row is kept.
            spark.read.parquet(fresh.toString()).write.mode("overwrite").parquet(f"{path}/batch={batch}")
        files.delete(fresh, True)


def sweep_on(stream: DataFrame, path: str, at: str, clock: str, keep_hours: float) -> DataStreamWriter:
    """Sweep on every trigger of a stream whose newest `clock` is the time that it is."""

    def run(rows: DataFrame, batch_id: int) -> None:
        now = rows.agg(F.max(F.unix_millis(F.col(clock).cast("timestamp"))).alias("now")).first()["now"]
        if now is not None:
            sweep(rows.sparkSession, path, at, now, keep_hours)

    return stream.writeStream.foreachBatch(run)
