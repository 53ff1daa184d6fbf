"""Scans in an order within keys, without a key's rows in one task.

Rows are put in ranges of (keys, order), so a key that holds a third of all rows is many
tasks. Each range is scanned by a window; what earlier ranges of the key amount to comes from
one row for each key and range. Null keys are a key; rows that the order doesn't tell apart
share a range. Columns whose name starts with `_scan` are the scans' own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .tables import cut

PART = "_scan_part"


def apart(df: DataFrame, keys: list[str], order: list[Column], range_rows: int | None = None) -> DataFrame:
    """df with the number of the range of (keys, order) that each row is in, written. There are
    as many ranges as a shuffle has partitions, or so many that each has about range_rows."""
    many = [] if range_rows is None else [df.count() // range_rows + 1]
    ranges = df.repartitionByRange(*many, *(F.col(k) for k in keys), *order)
    return cut(ranges.withColumn(PART, F.spark_partition_id()))


def inside(keys: list[str], order: list[Column]) -> WindowSpec:
    """The rows of a key's range up to a row."""
    return Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of keys that several ranges hold: each is the last key of a range and the first
    one of the next, so there are fewer than ranges, however many keys there are."""
    if not keys:
        return rows
    ends = rows.groupBy(PART).agg(F.min(F.struct(*keys)).alias("_scan_low_key"), F.max(F.struct(*keys)).alias("_scan_high_key"))
    ends = ends.select(PART, F.explode(F.array("_scan_low_key", "_scan_high_key")).alias("_scan_key"))
    several = ends.groupBy("_scan_key").agg(F.countDistinct(PART).alias("_scan_m")).where("_scan_m > 1")
    several = several.select(*(F.col("_scan_key")[k].alias(f"_scan_key_{i}") for i, k in enumerate(keys)))
    on = [F.col(k).eqNullSafe(F.col(f"_scan_key_{i}")) for i, k in enumerate(keys)]
    return rows.join(F.broadcast(several), on, "left_semi")


def ahead(rows: DataFrame, keys: list[str], summary: dict[str, Column], *stages: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """rows with the columns of the stages, worked out over the summaries of the key's earlier
    ranges; a stage sees the columns of those before it. Null for keys of one range."""
    per = spread(rows, keys).groupBy(*keys, PART).agg(*(c.alias(n) for n, c in summary.items()))
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    names: list[str] = []
    for stage in stages:
        found = stage(before)
        per, names = per.withColumns(found), [*names, *found]
    named = {k: f"_scan_{i}" for i, k in enumerate([*keys, PART])}
    per = per.select(*(F.col(k).alias(v) for k, v in named.items()), *names)
    on = [F.col(k).eqNullSafe(F.col(v)) for k, v in named.items()]
    return rows.join(F.broadcast(per), on, "left").drop(*named.values())  # two rows a range at most


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str, range_rows: int | None = None) -> DataFrame:
    """df with the place (from 1) of each row among those of its keys."""
    rows = apart(df, keys, order, range_rows).withColumn(name, F.row_number().over(inside(keys, order)))
    out = ahead(rows, keys, {"_scan_n": F.count("*")}, lambda w: {"_scan_before": F.sum("_scan_n").over(w)})
    return out.withColumn(name, (F.col(name) + F.coalesce("_scan_before", F.lit(0))).cast("long")).select(*df.columns, name)


def running_total(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """df with the sum of the value up to each row; null while no row had a value."""
    rows = apart(df.withColumn("_scan_v", value), keys, order).withColumn(name, F.sum("_scan_v").over(inside(keys, order)))
    out = ahead(rows, keys, {"_scan_n": F.sum("_scan_v")}, lambda w: {"_scan_before": F.sum("_scan_n").over(w)})
    both = F.when(F.col(name).isNotNull() | F.col("_scan_before").isNotNull(), F.coalesce(name, F.lit(0)) + F.coalesce("_scan_before", F.lit(0)))
    return out.withColumn(name, both).select(*df.columns, name)


def carry_forward(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """df with the last value that isn't null up to each row."""
    rows = apart(df.withColumn("_scan_v", value), keys, order)
    mine = F.last("_scan_v", ignorenulls=True).over(inside(keys, order))
    rows = rows.withColumns({name: mine, "_scan_at": F.row_number().over(inside(keys, order))})
    last = F.max_by("_scan_v", F.when(F.col("_scan_v").isNotNull(), F.col("_scan_at")))
    out = ahead(rows, keys, {"_scan_last": last}, lambda w: {"_scan_before": F.last("_scan_last", ignorenulls=True).over(w)})
    return out.withColumn(name, F.coalesce(name, "_scan_before")).select(*df.columns, name)


def islands(df: DataFrame, keys: list[str], order: list[Column], state: str) -> DataFrame:
    """df with `run`: the number (from 1) of the run of equal neighbours that a row is in."""
    rows = apart(df, keys, order)
    w = inside(keys, order)
    first = F.row_number().over(w)
    before = F.lag(F.struct(state)).over(Window.partitionBy(*keys, PART).orderBy(*order))
    rows = rows.withColumns({"_scan_at": first, "_scan_was": before})
    rows = ahead(rows, keys, {"_scan_last": F.max_by(F.struct(state), "_scan_at")}, lambda w: {"_scan_before": F.last("_scan_last").over(w)})
    was = F.coalesce("_scan_was", "_scan_before")
    rows = rows.withColumn("_scan_change", F.when(was.isNull() | ~was[state].eqNullSafe(F.col(state)), 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("_scan_change").over(w))
    out = ahead(rows, keys, {"_scan_n": F.sum("_scan_change")}, lambda w: {"_scan_more": F.sum("_scan_n").over(w)})
    return out.withColumn("run", F.col("run") + F.coalesce("_scan_more", F.lit(0))).select(*df.columns, "run")


def brackets(df: DataFrame, keys: list[str], order: list[Column], mark: Column) -> DataFrame:
    """df with n, level and owner (long), for marks 'begin' and 'end' in the order.

    n: the place of a row in its keys. level: how many brackets are open at a row, those
    that begin and end there counted. owner: n of the begin of the innermost one; null
    where none is open, also for an end that closes nothing. An end closes the last open
    begin; a begin without an end is open for good.
    """
    step = F.when(mark == "begin", 1).when(mark == "end", -1).otherwise(0)
    rows = apart(df.withColumns({"_scan_mark": mark, "_scan_v": step}), keys, order)
    w = inside(keys, order)
    rows = rows.withColumns({"n": F.row_number().over(w).cast("long"), "_scan_sum": F.sum("_scan_v").over(w)})
    earlier = Window.partitionBy(*keys, PART).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_scan_low", F.min("_scan_sum").over(earlier))
    summary = {"_scan_rows": F.count("*"), "_scan_total": F.sum("_scan_v"), "_scan_least": F.min("_scan_sum")}
    rows = ahead(
        rows, keys, summary, lambda w: {"_scan_n": F.sum("_scan_rows").over(w), "_scan_base": F.coalesce(F.sum("_scan_total").over(w), F.lit(0))},
        lambda w: {"_scan_lows": F.min(F.col("_scan_base") + F.col("_scan_least")).over(w)},
    )
    base = F.coalesce("_scan_base", F.lit(0))
    # the sum is counted from its lowest value so far: an end at that depth closes nothing
    low = F.least(F.lit(0), F.coalesce("_scan_lows", F.lit(0)), F.coalesce(base + F.col("_scan_low"), F.lit(0)))
    before = base + F.col("_scan_sum") - F.col("_scan_v") - low  # open brackets before the row
    level = (before + F.when(F.col("_scan_mark") == "begin", 1).otherwise(0)).cast("long")
    rows = rows.withColumns({"n": F.col("n") + F.coalesce("_scan_n", F.lit(0)), "level": level}).select(*df.columns, "_scan_mark", "n", "level")
    begin = F.when(F.col("_scan_mark") == "begin", F.col("n"))
    out = carry_forward(rows, [*keys, "level"], [F.col("n")], begin, "owner")
    return out.withColumn("owner", F.when(F.col("level") > 0, F.col("owner"))).select(*df.columns, "n", "level", "owner")
