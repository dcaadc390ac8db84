"""Reading order of positioned text items: column detection and rendering, as windows over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Items a page needs, width of a gap, its band, items on each side, line and paragraph breaks.
LEAST_ITEMS, GAP, BAND, SIDE, LINE, PARAGRAPH = 30, 0.08, (0.3, 0.7), 0.25, 0.6, 1.6


def detect_columns(items: DataFrame, width: float) -> DataFrame:
    """(page, columns, split_x) of items (page, x, ...): two columns if the widest gap in the middle
    band is wide enough and both sides hold enough items; the leftmost gap on ties."""
    order = Window.partitionBy("page").orderBy("x")
    gaps = items.withColumn("next", F.lead("x").over(order)).withColumn("mid", (F.col("x") + F.col("next")) / 2).withColumn("gap", F.col("next") - F.col("x"))
    central = F.col("mid").between(width * BAND[0], width * BAND[1]) & (F.col("gap") > 0)
    widest = F.max_by(F.struct("mid", "gap"), F.when(central, F.struct(F.col("gap"), -F.col("mid"))))
    best = gaps.groupBy("page").agg(F.count("*").alias("n"), F.max(F.when(central, F.col("gap"))).alias("most"), widest.alias("w"))
    sides = items.join(best, "page").groupBy("page").agg(F.first("n").alias("n"), F.first("most").alias("most"), F.first("w.mid").alias("split"), F.count_if(F.col("x") < F.col("w.mid")).alias("n_left"))
    two = (F.col("n") >= LEAST_ITEMS) & (F.col("most") >= width * GAP) & (F.col("n_left") >= F.col("n") * SIDE) & (F.col("n") - F.col("n_left") >= F.col("n") * SIDE)
    return sides.select("page", F.when(F.coalesce(two, F.lit(False)), 2).otherwise(1).alias("columns"), F.when(F.coalesce(two, F.lit(False)), F.col("split")).alias("split_x"))


def render_pages(items: DataFrame, columns: DataFrame) -> DataFrame:
    """(page, text): columns from left to right, items from the top, breaks by the drop between lines."""
    placed = items.join(columns, "page").withColumn("side", F.coalesce((F.col("x") >= F.col("split_x")).cast("int"), F.lit(0)))
    order = Window.partitionBy("page", "side").orderBy(F.col("y").desc(), "x", "item", "str")
    drop, height = F.lag("y").over(order) - F.col("y"), F.greatest(F.lag("height").over(order), F.col("height"), F.lit(8.0))
    gap = F.when(F.lag("y").over(order).isNull(), F.when(F.col("side") == 1, "\n\n").otherwise("")).when(drop > height * PARAGRAPH, "\n\n").when(drop > height * LINE, "\n").otherwise(" ")
    parts = placed.withColumn("part", F.concat(gap, "str")).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("side", (-F.col("y")).alias("up"), "x", "item", "str", "part"))).alias("p"))
    return parts.select("page", F.trim(F.regexp_replace(F.array_join(F.transform("p", lambda x: x["part"]), ""), r"[ \t]{2,}", " ")).alias("text"))
