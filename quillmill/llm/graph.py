"""Groups of linked nodes, without pairs inside a group and without collecting a link.

`components` contracts a graph: every node points to its smallest neighbour, pointers
are shortened, links are relabelled, and what is left is a smaller graph. `grouped`
finds the links that join candidates of shared buckets: members against hubs of their
buckets first, then only members whose groups still differ. `by_hubs` does so where every
pair that is asked for is tested: a hub leaves its bucket after its round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bloom, store

Verify = Callable[[DataFrame, bool], DataFrame]


def _pointers(links: DataFrame) -> DataFrame:
    """(node, to): the smallest neighbour or the node itself, shortened twice; written."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("near")).unionAll(
        links.select(F.col("b").alias("node"), F.col("a").alias("near"))
    )
    to = both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("to"))
    first = to = store.written(to, "pointers")
    for _ in range(2):
        ahead = to.where("node <> to").select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        to = to.join(ahead, "to", "left").select("node", F.coalesce("beyond", "to").alias("to"))
    out = store.written(to, "round")
    store.drop(first)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that occurs in links(a, b), written: component is
    the smallest node that can be reached. No link: no row. Repeated links, loops and
    either direction are the same. A group takes about log4 of its longest path rounds;
    each round is a written table, so a lost executor repeats one round at most.
    """
    levels: list[DataFrame] = []
    rest = links
    while True:
        to = _pointers(rest)
        left = to.select(F.col("node").alias("a"), F.col("to").alias("pa"))
        right = to.select(F.col("node").alias("b"), F.col("to").alias("pb"))
        ahead = store.written(
            rest.join(left, "a").join(right, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(),
            "contracted",
        )
        if levels:  # the links given are the caller's
            store.drop(rest)
        levels.append(to.withColumnRenamed("to", "component"))
        levels[-1].stored_at = to.stored_at
        rest = ahead
        if store.is_empty(rest):
            store.drop(rest)
            return composed(levels)


def composed(levels: list[DataFrame]) -> DataFrame:
    """(node, component), written, of tables each of which maps the components of those
    before it, and nodes that none before had. The smaller ones are put together first."""
    found = levels[-1]
    for level in levels[-2::-1]:
        onward = found.select(F.col("node").alias("component"), F.col("component").alias("_to"))
        mapped = level.join(onward, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
        fresh = found.select("node", "component").join(level.select("node"), "node", "left_anti")
        out = store.written(mapped.unionByName(fresh), "components")
        store.drop(found, level)
        found = out
    return found


def stray_pairs(open_: DataFrame, marks: DataFrame | None = None, near: Column | None = None) -> DataFrame:
    """(a, b), a < b, once each, of open_(key, id, label): the members of each bucket outside of its
    largest group with all members of other groups. Where given, marks has a row for each id, and
    near says of the columns of two ids, the other's with an o_, whether they are a pair."""
    largest = open_.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.max_by("label", F.struct("n", "label")).alias("main")
    )
    ranked = open_.join(largest, "key")
    if marks is not None:
        ranked = ranked.join(marks, "id")
    mine = ranked.where("label <> main")
    others = ranked.withColumnsRenamed({c: f"o_{c}" for c in ranked.columns})
    meet = F.expr("key = o_key and label <> o_label and (o_label = main or id < o_id)")
    pairs = mine.join(others, meet if near is None else meet & near)
    return pairs.select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b")).distinct()


def grouped(buckets: DataFrame, verify: Verify, rounds: int = 4, prepare: Callable[[DataFrame], None] | None = None,
            finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, component) for the nodes that verify() links to another one, written.

    buckets(key, id): nodes that share a key are candidates. prepare(open), where given,
    sees the nodes of shared buckets before any is tested. verify(pairs(a, b), some)
    returns (a, b, linked) for a < b; if `some`, it may leave pairs out. The result is
    that of all candidate pairs: a pair is never tested only when its two nodes are in one
    group already. In each round every member of a bucket that is not in the hub's group
    meets the hub, and each round draws other hubs. At last, in buckets that still hold
    several groups, the members outside of the largest group meet all members of other
    groups, so work in a bucket is its size times the number of its strays. finish(open),
    where given, is the last step: the links(a, b) between groups of one bucket.
    """
    # keys alone are counted first; ids travel only for keys that several share
    several = store.written(buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
    shared = bloom.candidates(buckets, several, ["key"]).join(several, "key", "left_semi")
    open_ = store.written(shared.withColumn("label", F.col("id")), "buckets")
    store.drop(several)
    if prepare is not None:
        prepare(open_)
    tests: list[DataFrame] = []
    levels: list[DataFrame] = []  # ids to labels, then labels to labels
    last = False  # no round found a link: only the exhaustive one is left

    def relabelled(links: DataFrame, open_: DataFrame) -> DataFrame | None:
        """The next level, from links(a, b) of ids; None if there is none."""
        if levels:
            labels = open_.select("id", "label").distinct()
            links = links.join(labels.withColumnsRenamed({"id": "a", "label": "la"}), "a").join(labels.withColumnsRenamed({"id": "b", "label": "lb"}), "b")
            links = links.where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        links = store.written(links.distinct(), "links")
        out = None if store.is_empty(links) else components(links)
        store.drop(links)
        return out

    for k in [*range(rounds), rounds]:
        if k < rounds and last:
            continue
        if k < rounds:
            drawn = open_.groupBy("key").agg(F.min_by(F.struct("id", "label"), F.xxhash64("id", "key", F.lit(k))).alias("hub"))
            pairs = open_.join(drawn, "key").where("label <> hub.label").select("id", F.col("hub.id").alias("other"))
        elif finish is not None:
            more = relabelled(finish(open_), open_)
            if more is not None:
                levels.append(more)
            break
        else:
            pairs = stray_pairs(open_).withColumnsRenamed({"a": "id", "b": "other"})
        pairs = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
        for t in tests:
            pairs = pairs.join(t.select("a", "b"), ["a", "b"], "left_anti")
        now = store.written(verify(pairs, k < rounds), "tested")
        tests.append(now)
        level = relabelled(now.where("linked").select("a", "b"), open_)
        if level is None:
            named, last = open_, True
        else:
            levels.append(level)
            onward = level.select(F.col("node").alias("label"), F.col("component").alias("_to"))
            named = open_.join(onward, "label", "left").select("key", "id", F.coalesce("_to", "label").alias("label"))
        if k == rounds:
            break
        mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
        before, open_ = open_, store.written(named.join(mixed.select("key"), "key", "left_semi"), "open")
        store.drop(before)
        if store.is_empty(open_):
            break
    store.drop(open_, *tests)
    if not levels:
        return buckets.select(F.col("id").alias("node"), F.col("id").alias("component")).limit(0)
    return composed(levels)


def shared_buckets(buckets: DataFrame) -> DataFrame:
    """(key, id, label, hub, hub_label), written, of buckets(key, id): the rows of keys that several
    ids share. One shuffle; rows of other keys are written nowhere. A label is the id, the hub
    of a key its smallest id."""
    key = Window.partitionBy("key")
    seen = buckets.select("key", "id", F.min("id").over(key).alias("hub"), F.max("id").over(key).alias("most"))
    rows = seen.where("hub <> most").select("key", "id", F.col("id").alias("label"), "hub", F.col("hub").alias("hub_label"))
    return store.written(rows, "buckets")


def by_hubs(open_: DataFrame, verify: Callable[[DataFrame], DataFrame], finish: Callable[[DataFrame], DataFrame], rounds: int,
            known: DataFrame | None = None) -> DataFrame:
    """(node, component), written, for the nodes that verify() or finish() link to another one, or
    known, links(a, b) of the caller.

    open_ is that of shared_buckets() and is dropped. verify(pairs(a, b)) gives the linked
    ones, a < b, and leaves none out. In each round every member of a bucket that is not in the
    hub's group meets the hub. Then the hub has met all of its bucket and leaves it, so that a
    bucket of two is done after one round, and others draw a new hub. finish(open) gives the
    links of all pairs that are left: members of one bucket with different labels.
    """
    links: list[DataFrame] = [] if known is None else [known]
    named, seen = None, 0

    def groups() -> DataFrame | None:
        """components() of all links so far, made anew only if there are more; None if there is no link."""
        nonlocal named, seen
        if not all(store.is_empty(x) for x in links[seen:]):
            store.drop(named)
            named = _all(links)
        seen = len(links)
        return named

    def drawn(rest: DataFrame, k: int) -> DataFrame:
        """The rows(key, id) of buckets that still hold several groups, with labels and new hubs; written."""
        if groups() is None:
            rest = rest.withColumn("label", F.col("id"))
        else:
            to = named.select(F.col("node").alias("id"), "component")
            rest = rest.join(to, "id", "left").select("key", "id", F.coalesce("component", "id").alias("label"))
        key, draw = Window.partitionBy("key"), F.xxhash64("id", F.lit(k))
        rest = rest.select("key", "id", "label", *(f(c).over(key).alias(n) for f, c, n in ((F.min, "label", "low"), (F.max, "label", "high"))), F.min(draw).over(key).alias("first"), draw.alias("drawn"))
        rest = rest.where("low <> high")
        hubs = [F.min(F.when(F.col("drawn") == F.col("first"), F.col(c))).over(key).alias(n) for c, n in (("id", "hub"), ("label", "hub_label"))]
        return store.written(rest.select("key", "id", "label", *hubs), "open")

    if known is not None:
        before, open_ = open_, drawn(open_.select("key", "id"), rounds)
        store.drop(before)
    for k in range(rounds):
        pairs = open_.where("label <> hub_label").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        links.append(verify(pairs))
        before, open_ = open_, drawn(open_.where("id <> hub").select("key", "id"), k)
        store.drop(before)
        if store.is_empty(open_):
            break
    else:
        links.append(finish(open_))
    found = groups()
    found = _all(links) if found is None else found
    store.drop(open_, *(x for x in links if x is not known))
    return found


def merged(open_: DataFrame, many: int = 512) -> DataFrame:
    """(key, id, label, big), written, of open_(key, id, label, hub): buckets of more than `many`
    ids are big, and those of them that have the same hub are one. A passage that many lines share
    makes many buckets of nearly the same ids, and all pairs of these would be met in each. The
    hub is the id with the smallest hash, so two buckets have the same one about as often as an id
    of one is in the other."""
    sized = open_.select("key", "id", "label", "hub", (F.count("*").over(Window.partitionBy("key")) > many).alias("big"))
    sized = store.written(sized, "sized")
    big = sized.where("big").select(F.xxhash64(F.lit("hub"), "hub").alias("key"), "id", "label", "big").distinct()
    out = store.written(sized.where("not big").select("key", "id", "label", "big").unionByName(big), "merged")
    store.drop(sized)
    return out


def _all(links: list[DataFrame]) -> DataFrame:
    """components() of several tables of links."""
    several = links[0].select("a", "b")
    for more in links[1:]:
        several = several.unionAll(more.select("a", "b"))
    return components(several)
