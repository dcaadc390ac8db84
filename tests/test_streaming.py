"""Machines on streams of late and repeated events against the batch folds; sinks whose batches are tried again."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from sievework.operators import state
from sievework.streaming import machine, sinks

T0 = datetime(2024, 1, 1)
EVENTS = "user long, event_id long, ts timestamp, action string, job long, expires long"


@pytest.fixture(scope="module")
def log() -> list[tuple]:
    draw, out = random.Random(3), []
    for i in range(240):
        at = T0 + timedelta(seconds=20 * i + draw.randint(0, 15))
        user = draw.randint(0, 5)
        out.append((user, i, at, draw.choice(["acquire", "done", "error", "recover", "acquire"]), draw.randint(0, 2), int((T0 + timedelta(seconds=700 * user)).timestamp() * 1000)))
    return out


def streamed(spark, tmp_path, log, how, ts_end=timedelta(days=9)):
    """Rows of a stream over the log in four parts, shuffled within ten minutes, each event twice; last of all one far ahead."""
    pytest.importorskip("google.protobuf")
    draw = random.Random(4)
    late = sorted(log + log, key=lambda e: e[2] + timedelta(seconds=draw.randint(0, 500)))
    parts = [late[k * 120 : k * 120 + 120] for k in range(4)] + [[(99, 9000, T0 + ts_end, "use", 0, 0)], [(99, 9001, T0 + ts_end + timedelta(days=1), "use", 0, 0)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", machine.ROCKSDB)
    try:
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        q = how(stream).writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
        q.processAllAvailable()
        state_rows = q.lastProgress["stateOperators"][0]["numRowsTotal"]
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.table("told").where("key < 99").drop("key").collect(), state_rows


def test_rate_windows(spark, tmp_path, log):
    got, left = streamed(spark, tmp_path, log, lambda s: machine.run(s, machine.Rate(2, 180_000), "user", "ts", "event_id"))
    batch = state.rate_limit(spark.createDataFrame(log, EVENTS), "user", "ts", "event_id", 2, 180_000)
    want = sorted(tuple(r) for r in batch.select("event_id", "allowed", "remaining", "retry_after_ms").collect())
    assert sorted(map(tuple, got)) == want
    assert left <= 6  # the keys that are at rest have left; the last key waits


def test_leases(spark, tmp_path, log):
    got, _ = streamed(spark, tmp_path, log, lambda s: machine.run(s, machine.Lease(), "user", "ts", "event_id", "action", "job"))
    assert len(got) == len(log)
    last = {}
    for r in sorted(got, key=lambda r: [e[2] for e in log if e[1] == r["event_id"]][0]):
        last[next(e[0] for e in log if e[1] == r["event_id"])] = (r["status"], r["job_id"])
    rows = spark.createDataFrame(log, EVENTS).select(F.col("user").alias("id"), F.col("event_id").alias("seq"), "action", F.col("job").alias("job_id"))
    assert last == {r["id"]: (r["status"], r["job_id"]) for r in state.lease_states(rows).collect()}


def test_tokens(spark, tmp_path, log):
    got, left = streamed(spark, tmp_path, log, lambda s: machine.run(s, machine.Token("acquire"), "user", "ts", "event_id", "action", "expires"))
    uses = spark.createDataFrame(log, EVENTS).select(F.col("user").alias("token"), F.col("event_id").alias("use_id"), F.col("ts").alias("at"), F.col("action").alias("kind"))
    tokens = spark.createDataFrame(log, EVENTS).select(F.col("user").alias("token"), F.lit("acquire").alias("wanted"), F.timestamp_millis("expires").alias("expires_at")).distinct()
    assert {r["event_id"] for r in got if r["consumed"]} == {r["use_id"] for r in state.consume_once(uses, tokens).collect()}
    assert left <= 6


def test_stale_lease():
    lease = machine.Lease(stale_ms=100)
    now, _ = lease.step(lease.begin, 0, "acquire", 1)
    assert lease.step(now, 50, "acquire", 2)[1] == ("parsing", 1)
    assert lease.step(now, 101, "acquire", 2)[1] == ("parsing", 2)
    assert lease.step(now, 101, "done", 1)[1] == ("error", 1)


def test_batches_tried_again(spark, tmp_path):
    path = f"file://{tmp_path}/audit"
    rows = spark.range(10).select("id", F.timestamp_millis(F.col("id") * 3_600_000).alias("at"))
    sinks.append_batch(rows.where("id < 4"), 0, path)
    sinks.append_batch(rows.where("id >= 4"), 1, path)
    sinks.append_batch(rows.where("id >= 4"), 1, path)
    assert sorted(r["id"] for r in sinks.audit_rows(spark, path).collect()) == list(range(10))
    # Cutoff at three hours, that row included; the second batch is not touched.
    assert sinks.sweep(spark, path, "at", 8 * 3_600_000, 5) == 4
    assert sinks.sweep(spark, path, "at", 8 * 3_600_000, 5) == 0
    assert sorted(r["id"] for r in sinks.audit_rows(spark, path).collect()) == list(range(4, 10))
    # A sweep that stopped once it had written what a batch keeps, and one that stopped before.
    rows.where("id = 9").write.parquet(f"{path}/_swept-1")
    rows.where("id = 8").write.parquet(f"{path}/_swept-0")
    (tmp_path / "audit" / "_swept-0" / "_SUCCESS").unlink()
    assert sinks.sweep(spark, path, "at", 0, 5) == 0
    assert [r["id"] for r in sinks.audit_rows(spark, path).collect()] == [9]


def test_audit_stream(spark, tmp_path):
    rows = spark.range(6).select("id", F.timestamp_millis(F.col("id") * 3_600_000).alias("at"))
    for k in range(3):
        rows.where(f"id % 3 = {k}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    path = f"file://{tmp_path}/audit"
    for _ in range(2):  # the second run begins where the first ended
        q = sinks.audit_sink(stream, path).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r["id"] for r in sinks.audit_rows(spark, path).collect()) == list(range(6))
    q = sinks.sweep_on(stream, path, "at", "at", 2).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["id"] for r in sinks.audit_rows(spark, path).collect()) == [4, 5]
