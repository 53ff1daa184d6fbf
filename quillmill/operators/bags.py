"""Multiset operators. Losing one of two equal items is a loss, so counts decide."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan
from .tables import cut, drop


def bag_counts(df: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(n))


def _paired(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Counts of both bags side by side (n_a, n_b); null keys equal null keys."""
    x = bag_counts(a, keys, "n_a").withColumnsRenamed({k: f"_{k}" for k in keys})
    y = bag_counts(b, keys, "n_b")
    on = None
    for k in keys:
        on = y[k].eqNullSafe(x[f"_{k}"]) if on is None else on & y[k].eqNullSafe(x[f"_{k}"])
    joined = x.join(y, on, how)
    names = [F.when(F.col("n_a").isNotNull(), F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    return joined.select(*names, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """left with the other columns of right where keys are equal, null being equal to null."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = None
    for k in keys:
        same = left[k].eqNullSafe(other[f"_r_{k}"])
        on = same if on is None else on & same
    return left.join(other, on, how).drop(*(f"_r_{k}" for k in keys))


def bag_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys and n: how often more in a than in b."""
    return _paired(a, b, keys, "left").where("n_a > n_b").select(*keys, (F.col("n_a") - F.col("n_b")).alias("n"))


def bag_intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return _paired(a, b, keys, "inner").select(*keys, F.least("n_a", "n_b").alias("n"))


def bag_union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Every key of either bag with both counts."""
    return _paired(a, b, keys, "full_outer")


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str, bucket_rows: int | None = None) -> DataFrame:
    """df with the place (from 1) of each row among those of its keys, null keys being one;
    a hot key is as many tasks as ranges of the order, whatever its type."""
    return scan.numbered(df, keys, order, name, bucket_rows)


def counted_allowance(df: DataFrame, allowances: DataFrame, key: str, order: list[Column], allowed: str = "allowed") -> DataFrame:
    """df without the first `allowed` rows of each key; keys without an allowance lose none."""
    return (
        numbered(df, [key], order, "_at").join(allowances, key, "left")
        .where(F.col("_at") > F.coalesce(allowed, F.lit(0))).drop("_at", allowed)
    )


def two_level_inherit(items: DataFrame, known: DataFrame, exact: list[str], loose: list[str], order: list[Column]) -> DataFrame:
    """items with `level`: 'exact' while known has a row left with equal `exact` columns,
    else 'loose' while one is left with equal `loose` columns, else 'new'. Each known row
    serves once; loose is a subset of exact."""
    exact_n = bag_counts(known, exact, "_exact_n")
    loose_n = bag_counts(known, loose, "_loose_n")
    first = null_safe(numbered(items, exact, order, "_at"), exact_n, exact)
    first = first.withColumn("_exact", F.coalesce(F.col("_at") <= F.col("_exact_n"), F.lit(False)))
    used = first.where("_exact").groupBy(*loose).agg(F.count("*").alias("_used"))
    rest = null_safe(null_safe(numbered(first, [*loose, "_exact"], order, "_place"), loose_n, loose), used, loose)
    left = F.coalesce("_loose_n", F.lit(0)) - F.coalesce("_used", F.lit(0))
    level = F.when(F.col("_exact"), "exact").when(F.col("_place") <= left, "loose").otherwise("new")
    return rest.withColumn("level", level).select(*items.columns, "level")


def pair_lost_added(lost: DataFrame, added: DataFrame, identity: list[str], order: str) -> DataFrame:
    """The k-th lost and the k-th added row of one identity are one change. Columns: the
    identity, `k`, lost_<order> and added_<order>; a side without partner is null."""
    key = [*identity, "k"]
    a = numbered(lost, identity, [F.col(order)], "k").select(*key, F.col(order).alias(f"lost_{order}"))
    b = numbered(added, identity, [F.col(order)], "k").select(*(F.col(c).alias(f"_{c}") for c in key), F.col(order).alias(f"added_{order}"))
    on = F.col("k") == F.col("_k")
    for c in identity:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    named = [F.when(F.col("k").isNotNull(), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in key]
    return a.join(b, on, "full_outer").select(*named, f"lost_{order}", f"added_{order}")


def match_texts(source: DataFrame, edited: DataFrame, keys: list[str], rounds: list[tuple[str, str]], order: str = "ord") -> DataFrame:
    """One-to-one matches of two bags of rows: in each round (source column, edited column)
    the k-th free source row of a value meets the k-th free edited row of it, so every row
    is used once. Returns keys, s_<order>, e_<order>, round."""
    # both bags are one table, written once: each round numbers all of it in one pass
    row = lambda df, side, cs: df.select(*keys, F.col(order).alias("_ord"), F.lit(side).alias("_side"), *(F.col(c).alias(f"_v{n}") for n, c in enumerate(cs)))
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))  # a null key equals nothing
    free = cut(row(source, 0, [x for x, _ in rounds]).unionByName(row(edited, 1, [y for _, y in rounds])).where(known))
    found = None
    for n in range(len(rounds)):
        value = f"_v{n}"
        k = numbered(free.where(F.col(value).isNotNull()).select(*keys, value, "_side", "_ord"), [*keys, value, "_side"], [F.col("_ord")], "_k")
        # the k-th of both sides of a value are one row
        both = k.groupBy(*keys, value, "_k").agg(*(F.min(F.when(F.col("_side") == s, F.col("_ord"))).alias(f"{c}_{order}") for s, c in enumerate("se")), F.count("*").alias("_n"))
        now = both.where("_n = 2").select(*keys, f"s_{order}", f"e_{order}", F.lit(n).alias("round"))
        if n + 1 < len(rounds):
            now = cut(now)
            used = now.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("_side"), F.col(f"s_{order}").alias("_ord")), F.struct(F.lit(1).alias("_side"), F.col(f"e_{order}").alias("_ord")))).alias("_u"))
            used = used.select(*keys, "_u.*")
            rest = cut(free.join(used, [*keys, "_side", "_ord"], "left_anti"))
            drop(free)
            free = rest
        found = now if found is None else found.unionByName(now)
    return found
