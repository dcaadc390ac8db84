"""Every registered query with SQL against DuckDB on the smallest tables; state in batch and on a stream."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from sievework.operators import state
from sievework.plans import registry
from sievework.sources import readers
from sievework.streaming import rate

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def shown(v) -> str:
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf_dir, name):
    found = __spark_entry__.queries()[name](spark, sf_dir)
    columns = sorted(found.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in found.collect())
    result = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_rate_limit_on_a_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "user_id", "cast(ts as timestamp) ts").orderBy("ts")
    batch = {r["event_id"]: r["allowed"] for r in state.rate_limit(events, "user_id", "ts", "event_id", 2, 86_400_000).collect()}
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = rate.stream_rate_limit(stream, "user_id", "ts", "event_id", 2, 86_400_000)
    q = out.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r["event_id"]: r["allowed"] for r in spark.table("limited").collect()} == batch


def test_notice_csv(spark, tmp_path):
    (tmp_path / "n.csv").write_text(",".join(readers.NOTICE_COLUMNS) + '\n1,"A ""quoted""\ntitle", s\n,second,\n')
    rows = readers.row_ids(readers.read_notices(spark, str(tmp_path / "n.csv")), ["title"]).collect()
    assert {(r["record_id"], r["title"], r["subject"]) for r in rows} == {("1", 'A "quoted"\ntitle', " s"), ("row-2", "second", "")}
    assert readers.snapshot(spark, str(tmp_path / "n.csv"), "generated on 2026-01-02").first()["generated_on"] == "2026-01-02"
