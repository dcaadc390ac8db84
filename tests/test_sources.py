"""Snapshots, listings, audit rows and numbering."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from sievework.operators.ordering import numbered
from sievework.sources import readers, refresh, writers


def test_open_snapshot(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "records"))
    assert readers.open_snapshot(spark, str(tmp_path), "records").count() == 3
    with pytest.raises(FileNotFoundError, match="import the notices first"):
        readers.open_snapshot(spark, str(tmp_path), "authors")


def test_newest_files(spark, tmp_path):
    for i, name in enumerate(("b.txt", "a.txt", "c.txt")):
        (tmp_path / name).write_text("x" * i)
        os.utime(tmp_path / name, (1_700_000_000 + 60 * i, 1_700_000_000 + 60 * i))
    found = readers.newest_files(spark, str(tmp_path), limit=2).collect()
    assert [os.path.basename(r["path"]) for r in found] == ["c.txt", "a.txt"] and [r["length"] for r in found] == [2, 1]


def test_audit_rows_are_added(spark, tmp_path):
    for i in range(2):
        writers.append_audit(spark.range(i, i + 2), str(tmp_path / "audit"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "audit")).collect()) == [0, 1, 1, 2]


def test_numbers_in_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit(1).alias("n"))
    found = numbered(rows, [F.col("k").desc()], "at").collect()
    assert sorted((r["at"], r["k"]) for r in found) == [(i + 1, 999 - i) for i in range(1000)]
    assert numbered(rows.limit(0), ["k"], "at").count() == 0


def test_refresh_changes_all_tables_or_none(spark, tmp_path):
    path = f"file://{tmp_path}/star"
    table = lambda n: {"records": spark.range(n), "authors": spark.range(2 * n), "institutions": spark.range(n), "identifiers": spark.range(n)}
    with pytest.raises(FileNotFoundError, match="refresh it first"):
        refresh.read(spark, path, "records")
    assert refresh.refresh(table(3), path, "1", {"source_commit": "abc"})
    assert refresh.read(spark, path, "authors").count() == 6

    broken = table(5)
    broken["identifiers"] = spark.range(5).select(F.raise_error(F.lit("stopped")).alias("id"))
    with pytest.raises(Exception, match="stopped"):
        refresh.refresh(broken, path, "2")
    assert refresh.newest(spark, path) == "1"
    assert refresh.read(spark, path, "records").count() == 3
    with pytest.raises(FileNotFoundError, match="not been loaded whole"):
        refresh.read(spark, path, "records", "2")

    assert refresh.refresh(table(5), path, "2")
    assert not refresh.refresh(table(9), path, "2")
    assert refresh.read(spark, path, "records").count() == 5
    assert refresh.read(spark, path, "records", "1").count() == 3
    found = {r["version"]: r for r in refresh.snapshots(spark, path).collect()}
    assert found["2"]["row_counts"] == {"records": 5, "authors": 10, "institutions": 5, "identifiers": 5}
    assert found["1"]["source_commit"] == "abc"
    assert refresh.refresh(table(1), path, "3")
    assert refresh.vacuum(spark, path, keep=2) == ["1"]
    assert {r["version"] for r in refresh.snapshots(spark, path).collect()} == {"2", "3"}
    with pytest.raises(ValueError, match="version"):
        refresh.refresh(table(1), path, "../x")
