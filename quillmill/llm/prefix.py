"""Positions in a total order by two passes: totals of partitions, then sums before each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

#: Partitions whose totals are summed together, so the last window sees one row for each
#: so many partitions.
WIDTH = 1024


def before(totals: DataFrame) -> DataFrame:
    """totals(part, n) with base: the sum of n over all smaller parts. Totals alone are
    ordered, in two levels: whole blocks of WIDTH parts, then the parts of each block."""
    blocks = totals.withColumn("block", F.expr(f"part div {WIDTH}"))
    sums = blocks.groupBy("block").agg(F.sum("n").alias("m"))
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("block", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    out = blocks.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return out.join(sums, "block").select("part", "n", (F.col("ahead") + F.col("inside")).alias("base"))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place (long, from 1) in the order as column `name`. Ranges of the
    order are sorted apart and counted, so no task sees more than a range; rows that the
    order doesn't tell apart share a range."""
    place = F.monotonically_increasing_id()  # partition and row within it
    apart = store.written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place), "ranges")
    part = F.shiftright("_place", 33)
    bases = before(apart.groupBy(part.alias("part")).agg(F.count("*").alias("n"))).select(F.col("part").alias("_part"), F.col("base").alias("_base"))
    out = apart.withColumn("_part", part).join(bases, "_part")
    return out.select(*rows.columns, (F.col("_base") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name))
