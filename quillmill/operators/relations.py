"""Reference checks, repeated keys, hops, theta matches, spans and reachability."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan
from .tables import cut, drop


def anti_ref(refs: DataFrame, defs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of refs whose key has no definition. Null keys have none."""
    return refs.join(defs.select(*keys).distinct(), keys, "left_anti")


def dup_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def any_candidate(rels: DataFrame, key: list[str], candidates: str, targets: DataFrame, name: str) -> DataFrame:
    """Rows of rels none of whose candidate names is among the targets."""
    good = rels.select(*key, F.explode(candidates).alias(name)).join(targets.select(name).distinct(), name).select(*key).distinct()
    return rels.join(good, key, "left_anti")


def first_failing_hop(start: DataFrame, hops: list[tuple[DataFrame, Column, str, str]]) -> DataFrame:
    """start with `failed`: the label of the first hop that finds nothing, or null. A hop is
    (table, condition, a column that is null only without a match, label)."""
    out = reduce(lambda df, hop: df.join(hop[0], hop[1], "left"), hops, start)
    return out.withColumn("failed", F.coalesce(*(F.when(F.col(probe).isNull(), F.lit(label)) for _, _, probe, label in hops)))


def first_match(items: DataFrame, rules: DataFrame, condition: Column, item_keys: list[str], ordinal: str, rule: str) -> DataFrame:
    """The first rule (by ordinal) that fits each item; items without one get null. rules
    is a configuration table of bounded size, so it is broadcast."""
    hits = items.join(F.broadcast(rules), condition, "left")
    return hits.groupBy(*item_keys).agg(F.min_by(rule, ordinal).alias(rule))


def contained(texts: DataFrame, items: DataFrame, text: str, block_bytes: int = 4 << 20) -> DataFrame:
    """texts with the other columns of each item whose text they contain. Items are a stated
    query set: they go to the texts in blocks of about block_bytes, a pass over the texts for
    each block, so what is broadcast has a bound."""
    own = items.withColumnRenamed(text, "_piece")
    size = own.agg(F.coalesce(F.sum(F.octet_length("_piece") + 64), F.lit(0)).alias("n")).first()["n"]
    blocks = -(-size // block_bytes) or 1
    block = F.pmod(F.xxhash64("_piece"), F.lit(blocks))
    parts = (F.broadcast(own.where(block == k)) for k in range(blocks))
    return reduce(DataFrame.unionByName, (texts.join(p, F.contains(F.col(text), F.col("_piece"))) for p in parts)).drop("_piece")


def near_pairs(df: DataFrame, group: list[str], order: str, reach: Column, columns: list[str], width: Column, tie: str) -> DataFrame:
    """Pairs a before b of one group with b.order - a.order <= reach. Each row is put in the
    buckets of its own place and the next one, so the join has equal keys however long a
    group is; `width` is the number of the bucket of `order`."""
    left = df.select(*(F.col(c).alias(f"a_{c}") for c in {*group, order, tie, *columns}), F.explode(F.array(width, width + 1)).alias("_bucket"))
    right = df.select(*(F.col(c).alias(f"b_{c}") for c in {*group, order, tie, *columns}), width.alias("_bucket"))
    on = [F.col("_a.a_" + g) == F.col("_b.b_" + g) for g in group] + [F.col("_a._bucket") == F.col("_b._bucket")]
    pairs = left.alias("_a").join(right.alias("_b"), reduce(lambda x, y: x & y, on))
    first = F.struct(f"a_{order}", f"a_{tie}") < F.struct(f"b_{order}", f"b_{tie}")
    return pairs.where(first & reach).drop("_bucket")


def rectangles_overlap(shapes: DataFrame, group: list[str], order: str) -> DataFrame:
    """Pairs of shapes of a group (first < second by order) with their shared area over the
    smaller one's area: x, y, cx, cy in whole units; empty shapes overlap nothing.

    Shapes meet by cells of grids, one for each power of two: a shape has at most four cells
    of the grid that its longer side fits, and looks for larger ones in theirs, too. So a
    group with many shapes is not all pairs, and no large shape is in many cells.
    """
    cols = [order, "x", "y", "cx", "cy"]
    fit = F.when((F.col("cx") > 0) & (F.col("cy") > 0), F.length(F.bin(F.greatest("cx", "cy").cast("long"))).cast("int"))
    rows = shapes.select(*group, *cols, fit.alias("_fit")).where("_fit is not null")
    levels = sorted(r["_fit"] for r in rows.select("_fit").distinct().collect())  # at most 64

    def celled(df: DataFrame, level: Column) -> DataFrame:
        df = df.withColumn("_level", level)
        side = F.expr("shiftleft(cast(1 as bigint), _level)")
        reach = lambda c, d: F.sequence(F.floor(F.col(c) / side), F.floor((F.col(c) + F.col(d) - 1) / side))
        df = df.withColumn("_cx", F.explode(reach("x", "cx")))
        return df.withColumn("_cy", F.explode(reach("y", "cy")))

    known = F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")
    a = celled(rows, F.col("_fit"))
    b = celled(rows, F.explode(F.filter(known, lambda v: v >= F.col("_fit"))))
    # ends and a cell's own corner are worked out for each row, so a pair costs a few comparisons
    side = F.expr("shiftleft(cast(1 as bigint), _level)")
    a = a.select(*group, "_level", "_cx", "_cy", *(F.col(c).alias(f"l_{c}") for c in cols), (F.col("x") + F.col("cx")).alias("_lx"), (F.col("y") + F.col("cy")).alias("_ly"))
    b = b.select(
        *group, "_level", "_cx", "_cy", (F.col("_fit") == F.col("_level")).alias("_same"), *(F.col(c).alias(f"s_{c}") for c in cols),
        (F.col("x") + F.col("cx")).alias("_sx"), (F.col("y") + F.col("cy")).alias("_sy"), (F.col("_cx") * side).alias("_x0"), (F.col("_cy") * side).alias("_y0"),
    )
    # few bytes make many pairs, so partitions must not be put together by their bytes
    key = [*group, "_level", "_cx", "_cy"]
    a, b = (df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key) for df in (a, b))
    touch = (F.col("l_x") < F.col("_sx")) & (F.col("s_x") < F.col("_lx")) & (F.col("l_y") < F.col("_sy")) & (F.col("s_y") < F.col("_ly"))
    # the pair counts in the cell of its shared corner, and once if both have one size
    corner = ((F.col("l_x") >= F.col("_x0")) | (F.col("s_x") >= F.col("_x0"))) & ((F.col("l_y") >= F.col("_y0")) | (F.col("s_y") >= F.col("_y0")))
    once = (F.col(f"l_{order}") < F.col(f"s_{order}")) | (~F.col("_same") & (F.col(f"l_{order}") != F.col(f"s_{order}")))
    same = [F.col("_a." + k) == F.col("_b." + k) for k in key]
    both = a.alias("_a").join(b.alias("_b"), reduce(lambda x, y: x & y, same) & touch & corner & once)
    first = F.col(f"l_{order}") < F.col(f"s_{order}")
    named = [F.when(first, F.col(f"{p}_{c}")).otherwise(F.col(f"{q}_{c}")).alias(f"{n}_{c}") for n, p, q in (("a", "l", "s"), ("b", "s", "l")) for c in cols]
    pairs = both.select(*(F.col("_a." + g) for g in group), *named)
    end = lambda p, d: F.least(F.col(f"a_{p}") + F.col(f"a_{d}"), F.col(f"b_{p}") + F.col(f"b_{d}")) - F.greatest(f"a_{p}", f"b_{p}")
    w, h = end("x", "cx"), end("y", "cy")
    area = F.least(F.col("a_cx") * F.col("a_cy"), F.col("b_cx") * F.col("b_cy"))
    return pairs.withColumn("share", w.cast("double") * h / area)


def reachable(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc, node, depth) that edges(doc, src, dst) reach from start(doc, node), however far.
    One join a level; a node is visited once, so cycles end; each level is a written table, so
    a lost executor repeats one level at most."""
    front = cut(start.select("doc", "node").distinct().withColumn("depth", F.lit(0)))
    found, parts = front, [front]
    for depth in count(1):
        ahead = front.select("doc", F.col("node").alias("src")).join(edges.select("doc", "src", "dst"), ["doc", "src"])
        ahead = ahead.select("doc", F.col("dst").alias("node")).distinct()
        front = cut(ahead.join(found, ["doc", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            drop(front)
            return found
        found = found.unionByName(front)
        parts.append(front)
        if depth % 16 == 0:  # one table again, so plans stay short
            found = cut(found)
            drop(*parts[:-1])  # the last one is the front
            parts = [found, front]


def carry_forward(df: DataFrame, group: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """The last non-null value up to each row."""
    return scan.carry_forward(df, group, order, value, name)


def inherited(sections: DataFrame, refs: DataFrame, group: list[str], order: str, slot: list[str], value: str) -> DataFrame:
    """group, order, slot and value of every section and slot that has a value by then: a
    section that names none for a slot has that of the section before. sections(group, order)
    and refs(group, order, slot, value); slots are those that occur in the group."""
    every = sections.join(refs.select(*group, *slot).distinct(), group).join(refs, [*group, order, *slot], "left")
    last = scan.carry_forward(every.withColumnRenamed(value, "_own"), [*group, *slot], [F.col(order)], F.col("_own"), value)
    return last.where(F.col(value).isNotNull()).select(*group, order, *slot, value)


def sibling_index(df: DataFrame, parent: list[str], name: str, order: str) -> DataFrame:
    """df with `step`: the name, and its place among the parent's children of that name if
    there are several."""
    w = Window.partitionBy(*parent, name)
    at, n = F.row_number().over(w.orderBy(order)), F.count("*").over(w)
    step = F.when(F.col("_n") > 1, F.concat(F.col(name), F.lit("["), F.col("_at"), F.lit("]"))).otherwise(F.col(name))
    return df.withColumns({"_at": at, "_n": n}).withColumn("step", step).drop("_at", "_n")


def running_total(df: DataFrame, group: list[str], order: str, value: str, name: str = "total") -> DataFrame:
    return scan.running_total(df, group, [F.col(order)], F.col(value), name)


def first_of_equal(df: DataFrame, group: list[str], same: list[str], order: str) -> DataFrame:
    """Of rows of a group that are equal in `same`, the first."""
    at = F.row_number().over(Window.partitionBy(*group, *same).orderBy(order))
    return df.withColumn("_at", at).where("_at = 1").drop("_at")


def outcome_counts(df: DataFrame, keys: list[str], column: str, values: list[str]) -> DataFrame:
    """A count for each value in a column of its own, also 0, and their total."""
    return df.groupBy(*keys).agg(*(F.count_if(F.col(column) == v).alias(v) for v in values), F.count("*").alias("total"))


def islands(df: DataFrame, group: list[str], order: list[Column], state: str) -> DataFrame:
    """Runs of equal neighbours: group, state, run, n, and the state of the next run."""
    runs = scan.islands(df, group, order, state)
    runs = runs.groupBy(*group, "run", state).agg(F.count("*").alias("n"))
    # a run and the one before it, by an equal key: as many runs as a key has don't share a task
    after = runs.select(*(F.col(g).alias(f"_{g}") for g in group), (F.col("run") - 1).alias("_run"), F.col(state).alias(f"next_{state}"))
    on = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group] + [F.col("run") == F.col("_run")]
    return runs.join(after, on, "left").drop("_run", *(f"_{g}" for g in group))


def topk(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def severity_summary(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """One row with a count for each key, also for keys that don't occur."""
    return df.agg(*(F.count_if(F.col(column) == k).alias(k) for k in keys))


def grouped_metrics(df: DataFrame, groupings: list[str], measures: list[Column]) -> DataFrame:
    """Each grouping alone (overlapping, not crossed): one row for each of its values."""
    marked = df.groupingSets([[g] for g in groupings], *groupings)
    name = F.coalesce(*(F.when(F.grouping(g) == 0, F.lit(g)) for g in groupings)).alias("grouping")
    value = F.coalesce(*(F.when(F.grouping(g) == 0, F.col(g).cast("string")) for g in groupings)).alias("value")
    return marked.agg(name, value, *measures).select("grouping", "value", *[c for c in marked.agg(*measures).columns if c not in groupings])


def delta_counts(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Counts on both sides with the difference; keys of either side."""
    a = before.groupBy(*keys).agg(F.count("*").alias("n_before"))
    b = after.groupBy(*keys).agg(F.count("*").alias("n_after"))
    out = a.join(b, keys, "full_outer").na.fill(0, ["n_before", "n_after"])
    return out.withColumn("delta", F.col("n_after") - F.col("n_before"))
