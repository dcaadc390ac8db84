"""Connected components by alternating large-star and small-star steps, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import settle


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
    return row["n"], int(row["sum"] or 0)


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Each vertex hangs its (larger, or all) neighbours under the least of them and itself."""
    ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both_ways else edges
    least = settle(ways.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
    linked = ways.join(least, "a")
    if both_ways:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return settle(out.where("a != b").distinct(), "star")


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of the vertices of (a, b) edges of longs; a component is its least vertex.

    Minima are combined before shuffles, so a vertex of any degree is no hot group; rounds grow as
    the logarithm of the longest path. No rows: no rows.
    """
    now = settle(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, mark = None, _mark(now)
    while mark != before and mark[0]:
        now = _star(_star(now, both_ways=True), both_ways=False)
        before, mark = mark, _mark(now)
    roots = now.select(F.col("b").alias("vertex")).distinct()
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(roots.select("vertex", F.col("vertex").alias("component")))
