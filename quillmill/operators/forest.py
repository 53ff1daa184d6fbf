"""Trees given by a parent for each node, and ids that no other row has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan
from .tables import cut, drop


def rooted(nodes: DataFrame, keys: list[str], node: str = "node", parent: str = "parent") -> DataFrame:
    """keys, node, parent, root, depth, state of nodes(keys, node, parent), written.

    state: 'top' without a parent; 'orphan' if no node has the parent's name; 'unclear' if
    the node, or its parent, is there more than once; 'cycle' if the way up never ends;
    else 'below'. root and depth (0 at the root) are those of the tree that the node hangs
    in, the root being a node of any of the first three kinds; null on or below a cycle.
    Names are compared within the keys, null names are left out. Pointers are doubled: a
    tree takes as many rounds as the logarithm of its depth, each a written table.
    """
    named = nodes.where(F.col(node).isNotNull())
    own = named.groupBy(*keys, node).agg(F.count("*").alias("_n"), F.min(parent).alias("_up"))
    known = own.select(*keys, F.col(node).alias("_up"), F.col("_n").alias("_many"))
    first = own.join(known, [*keys, "_up"], "left")
    state = (
        F.when((F.col("_n") > 1) | (F.col("_many") > 1), "unclear").when(F.col("_up").isNull(), "top").when(F.col("_many").isNull(), "orphan").otherwise("below")
    )
    base = cut(first.select(*keys, node, state.alias("state")))
    linked = first.select(*keys, node, "_up", state.alias("state"))
    ahead = F.when(F.col("state") == "below", F.col("_up")).otherwise(F.col(node))
    step = F.when(F.col("state") == "below", 1).otherwise(0).cast("long")
    now = cut(linked.select(*keys, node, ahead.alias("root"), step.alias("depth"), (F.col("state") != "below").alias("_done")))
    open_ = now.where("not _done").count()
    while open_:
        far = now.select(*keys, F.col(node).alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_more"), F.col("_done").alias("_end"))
        doubled = now.where("not _done").join(far, [*keys, "root"])
        doubled = doubled.select(*keys, node, F.col("_root").alias("root"), (F.col("depth") + F.col("_more")).alias("depth"), F.col("_end").alias("_done"))
        after = cut(now.where("_done").unionByName(doubled))
        drop(now)
        now, before, open_ = after, open_, after.where("not _done").count()
        if open_ == before:  # a way that ends would have come nearer by one node at least
            break
    whole = named.join(base, [*keys, node]).join(now, [*keys, node])
    none = F.lit(None)
    out = whole.select(
        *keys, node, parent, F.when(F.col("_done"), F.col("root")).otherwise(none).alias("root"), F.when(F.col("_done"), F.col("depth")).otherwise(none).alias("depth"),
        F.when(F.col("_done") | (F.col("state") != "below"), F.col("state")).otherwise("cycle").alias("state"),
    )
    out = cut(out)
    drop(base, now)
    return out


def fresh_ids(rows: DataFrame, keys: list[str], name: str, order: list[Column], used: DataFrame | None = None) -> DataFrame:
    """rows with `fresh`: of rows of one key with an equal id, the first in the order keeps it
    (null), the others get numbers above the largest of the key, in the order and without
    gaps. used(keys, top): the largest id that is taken elsewhere. Ids that aren't whole
    numbers are repeated, too, but take no number away."""
    number = F.expr(f"try_cast(trim(cast({name} as string)) as bigint)")
    top = rows.groupBy(*keys).agg(F.max(number).alias("_top"))
    if used is not None:
        top = top.join(used, keys, "left").select(*keys, F.greatest("_top", "top").alias("_top"))
    placed = scan.numbered(rows, [*keys, name], order, "_use")
    again = placed.withColumn("_again", F.when(F.col("_use") > 1, 1).otherwise(0))
    counted = scan.running_total(again, keys, order, F.col("_again"), "_nth")
    named = {k: f"_top_{k}" for k in keys}
    on = [F.col(k).eqNullSafe(F.col(v)) for k, v in named.items()]
    out = counted.join(top.withColumnsRenamed(named), on, "left")
    fresh = F.when(F.col("_use") > 1, F.greatest(F.coalesce("_top", F.lit(0)), F.lit(0)) + F.col("_nth"))
    return out.withColumn("fresh", fresh.cast("long")).select(*rows.columns, "fresh")
