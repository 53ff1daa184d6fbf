"""Work that may cost so much for each key, given out in an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within_budget(df: DataFrame, keys: list[str], order: list[str], cost: str, limit: int, name: str = "taken") -> DataFrame:
    """df with a boolean: in the order, a row is taken if its cost fits in what those taken
    before it have left of the limit; one that doesn't fit is passed over, and later, cheaper
    ones may still fit. A key is what one document holds, whose rows fit in a task."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    items = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, F.struct(*rest).alias("_rest")))).alias("_items"))

    def step(state: Column, item: Column) -> Column:
        price = item["_rest"][cost].cast("long")
        fits = price <= state["left"]
        return F.struct(F.when(fits, state["left"] - price).otherwise(state["left"]).alias("left"), F.concat(state["taken"], F.array(fits)).alias("taken"))

    start = F.struct(F.lit(limit).cast("long").alias("left"), F.array().cast("array<boolean>").alias("taken"))
    taken = F.aggregate("_items", start, step)["taken"]
    out = items.select(*keys, F.inline(F.arrays_zip(F.col("_items").alias("i"), taken.alias(name))))
    return out.select(*keys, *(F.col(f"i.{c}").alias(c) for c in order), *(F.col(f"i._rest.{c}").alias(c) for c in rest), name).select(*df.columns, name)


def surplus(wanted: Column, given: Column) -> Column:
    """struct(whole, extra) of two arrays: whole is true if `wanted` is met, in order, by items
    of `given`, each taken as soon as it fits; extra holds the items that were not needed."""
    kind = F.array().cast("array<int>")

    def step(state: Column, i: Column) -> Column:
        item = F.get(given, i)
        fits = (state["at"] < F.size(wanted)) & item.eqNullSafe(F.get(wanted, state["at"]))
        return F.struct(
            (state["at"] + F.when(fits, 1).otherwise(0)).cast("int").alias("at"),
            F.when(fits, state["extra"]).otherwise(F.concat(state["extra"], F.array(i))).alias("extra"),
        )

    start = F.struct(F.lit(0).alias("at"), kind.alias("extra"))
    places = F.when(F.size(given) > 0, F.sequence(F.lit(0), F.size(given) - 1)).otherwise(kind)
    end = F.aggregate(places, start, step)
    return F.struct((end["at"] == F.size(wanted)).alias("whole"), F.transform(end["extra"], lambda i: F.get(given, i)).alias("extra"))
