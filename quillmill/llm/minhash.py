"""MinHash near-duplicates with sequential Bayesian verification.

Banded MinHash proposes candidates; the signatures of a candidate pair are compared in
batches, and the pair is dropped as soon as the posterior probability that its similarity
reaches the threshold falls under `miss`; survivors are verified exactly on full shingle
sets. Documents with equal sets are one class before that, so copies never meet in pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays, bloom, graph, store


@dataclass(frozen=True)
class Settings:
    """percent: smallest Jaccard similarity of a link, in hundredths. A pair of exactly
    that similarity shares no band with probability (1 - s**rows)**bands (4e-4 at 0.80,
    8e-6 at 0.85).
    miss: posterior probability below which a batch comparison drops a pair."""

    percent: int = 80
    words: int = 5
    bands: int = 20
    rows: int = 5
    batch: int = 20
    miss: float = 1e-6


def shingle_sets(column: pa.Array, words: int) -> Iterator[list[np.ndarray]]:
    """For each chunk, the sorted distinct shingle hashes of each text. Fewer words than
    `words`: the whole sequence is one shingle; none: the empty set."""
    for _, raw, offsets in arrays.chunks(column):
        data = arrays.ASCII_LOWER[raw]
        starts, ends, first = arrays.words(data, offsets, arrays.SPACES)
        hashes = arrays.substring_hash(arrays.prefix(data), starts, ends)
        grams = arrays.ngrams(hashes, words)
        out = []
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            if hi - lo >= words:
                out.append(np.unique(grams[lo : hi - words + 1]))
            elif hi > lo:
                out.append(arrays.ngrams(hashes[lo:hi], hi - lo) ^ np.uint64(hi - lo))
            else:
                out.append(hashes[:0])
        yield out


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n minima for each non-empty set, the low 16 bits of each: two sets agree by chance
    in one value of 65536, which only adds candidates."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets)][:-1])
    low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(77)
    out = np.empty((len(sets), n), np.uint16)
    for k in range(n):
        a, b = (rng.integers(0, 1 << 31, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
        h = (low ^ b) * a
        h ^= h >> np.uint32(15)
        h += high
        h *= np.uint32(0x85EBCA6B)
        out[:, k] = np.minimum.reduceat(h, at)
    return out


def _describe(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    k = s.bands * s.rows
    for batch in batches:
        ids, at = batch.column(0), 0
        for sets in shingle_sets(batch.column(1), s.words):
            full = [x for x in sets if len(x)]
            sig = iter(signatures(full, k)) if full else iter(())
            rows = [(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), next(sig).tobytes()) if len(x) else (None, None) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(at, len(sets)), pa.array(list(map(len, sets)), pa.int64()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
                names=["doc_id", "n_shingles", "digest", "sig"],
            )
            at += len(sets)


def _bands(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, s.bands * s.rows).astype(np.uint64)
        rows = sig.reshape(-1, s.bands, s.rows) * arrays.LANES[: s.rows]
        keys = arrays.mix(rows.sum(axis=2, dtype=np.uint64) + arrays.mix(np.arange(s.bands, dtype=np.uint64)))
        ids = np.repeat(batch.column(0).to_numpy(), s.bands)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], names=["key", "id"])


def least_matches(s: Settings) -> list[tuple[int, int]]:
    """(n, m): after n compared values a pair with fewer than m matches is dropped. With
    a uniform prior P(similarity >= t | m of n) is P(Binomial(n + 1, t) <= m)."""
    t, out = s.percent / 100, []
    for n in range(s.batch, s.bands * s.rows + 1, s.batch):
        below, m = 0.0, 0
        while True:
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= s.miss:
                break
            m += 1
        out.append((n, m))
    return out


def _prune(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    k, limits = s.bands * s.rows, least_matches(s)
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, k) for c in (2, 3))
        alive, matches, done = np.arange(len(x)), np.zeros(len(x), np.int64), 0
        live = np.zeros(len(x), bool)
        for n, least in limits:
            matches[alive] += (x[alive, done:n] == y[alive, done:n]).sum(axis=1)
            alive, done = alive[matches[alive] >= least], n
        live[alive] = True
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(matches), pa.array(live)], names=["a", "b", "matches", "alive"])


def _sets(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for sets in shingle_sets(batch.column(1), s.words):
            flat = np.concatenate(sets).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), lists], names=["doc_id", "shingles"])
            at += len(sets)


def close_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b, once each: every pair of ids with different labels whose sets may reach the
    similarity, of sets(id, label, set, shingles); an id may have several sets, told apart by
    `set`. No pair that reaches it is left out.

    Shingles are ordered by frequency, rare ones first. Sets x and y, x not larger, of that
    similarity share at least percent * (x + y) / (100 + percent) shingles. So the first one
    that they share is among those of x that have 2 * percent * x / (100 + percent) from there
    to the end, and among those of y that have percent * y / 100. Sets whose larger part is
    common to many have no common shingle that far in front. Of the labels of a shingle, the
    one with most sets does not meet itself, so a group of links is not all its pairs."""
    flat = sets.select("id", "label", "set", F.size("shingles").alias("size"), F.explode("shingles").alias("key"))
    known = flat.groupBy("key").agg(F.count("*").alias("n"))
    order = Window.partitionBy("id", "set").orderBy(F.desc("n"), F.desc("key"))
    placed = flat.join(known, "key").withColumn("rest", F.row_number().over(order))  # shingles from here to the end
    near = placed.where((F.col("n") > 1) & (100 * F.col("rest") >= percent * F.col("size")))
    near = near.select("key", "id", "label", "size", "rest", ((100 + percent) * F.col("rest") >= 2 * percent * F.col("size")).alias("front"))
    per = near.groupBy("key", "label").agg(F.count("*").alias("m")).groupBy("key").agg(
        F.max_by("label", F.struct("m", "label")).alias("main"), F.count("*").alias("labels")
    )
    near = store.written(near.join(per.where("labels > 1").select("key", "main"), "key"), "prefixes")
    found = []
    for mine in ("label <> main", "label = main"):
        x = near.where(f"front and {mine}").select("key", "main", *(F.col(c).alias(f"x_{c}") for c in ("id", "label", "size", "rest")))
        # sets of the main label meet strays only
        y = (near if mine == "label <> main" else near.where("label <> main")).select("key", *(F.col(c).alias(f"y_{c}") for c in ("id", "label", "size", "rest")))
        sizes = (F.col("x_size") <= F.col("y_size")) & (100 * F.col("x_size") >= percent * F.col("y_size"))
        shared = (100 + percent) * F.least("x_rest", "y_rest") >= percent * (F.col("x_size") + F.col("y_size"))
        meet = x.alias("_x").join(y.alias("_y"), (F.col("_x.key") == F.col("_y.key")) & (F.col("x_label") != F.col("y_label")) & sizes & shared)
        found.append(meet.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")))
    return found[0].unionByName(found[1]).distinct()


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text).

    Links are pairs with 100 * |A & B| >= percent * |A | B|; component_id is the smallest
    doc_id that links reach. Null, empty or blank texts have the empty set, link with
    nothing and are kept. A doc_id that occurs in several rows gives a row for each, and
    those are one node. Other columns are not read. An empty table gives an empty one.
    """
    s = settings
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = store.written(
        texts.mapInArrow(lambda it: _describe(it, s), "doc_id long, n_shingles long, digest binary, sig binary"), "signatures"
    )
    full = described.where("digest is not null and doc_id is not null")
    # equal sets have equal signatures: one of each class stands for all its documents
    classes = store.written(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("sig").alias("sig")), "classes")
    buckets = classes.select("rep", "sig").mapInArrow(lambda it: _bands(it, s), "key long, id long")

    def sets_of(ids: DataFrame) -> DataFrame:
        ids = store.written(ids.distinct(), "wanted")
        found = bloom.candidates(texts, ids, ["doc_id"]).join(ids, "doc_id").select("doc_id", "text")
        return found.mapInArrow(lambda it: _sets(it, s), "doc_id long, shingles array<long>")

    def verify(pairs: DataFrame, some: bool) -> DataFrame:
        a = classes.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"))
        b = classes.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"))
        wide = pairs.join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b")
        rated = store.written(
            wide.mapInArrow(lambda it: _prune(it, s), "a long, b long, matches long, alive boolean")
            .groupBy("a", "b").agg(F.max("matches").alias("matches"), F.max("alive").alias("alive")),
            "candidates",
        )
        alive = rated.where("alive")
        if some:  # the likeliest partner of each; the others only if groups still differ
            best = alive.groupBy("b").agg(F.max_by("a", F.struct("matches", -F.col("a"))).alias("a"))
            alive = best.select("a", "b").unionAll(
                alive.groupBy("a").agg(F.max_by("b", F.struct("matches", -F.col("b"))).alias("b")).select("a", "b")
            ).distinct()
        alive = store.written(alive.select("a", "b"), "alive")
        sets = store.written(sets_of(alive.select(F.col("a").alias("doc_id")).unionAll(alive.select("b"))), "sets")
        x = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
        y = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        exact = alive.join(x, "a").join(y, "b").select(
            "a", "b", (100 * both >= s.percent * (F.size("x") + F.size("y") - both)).alias("linked")
        )
        exact = exact.groupBy("a", "b").agg(F.max("linked").alias("linked"))
        return exact.unionAll(rated.where("not alive").select("a", "b", F.lit(False)))

    def finish(open_: DataFrame) -> DataFrame:
        """Links between groups that still share buckets: the pairs that close_pairs leaves go
        the way of all others, through the signatures and the exact test."""
        labels = store.written(open_.groupBy("id").agg(F.min("label").alias("label")), "labels")
        sets = sets_of(labels.select(F.col("id").alias("doc_id"))).withColumnRenamed("doc_id", "id")
        # a doc_id in rows with different texts has the sets of all of them
        rows = store.written(sets.join(labels, "id").select("id", "label", F.xxhash64("shingles").alias("set"), "shingles"), "open_sets")
        pairs = store.written(close_pairs(rows, s.percent), "close")
        links = store.written(verify(pairs, False).where("linked").select("a", "b"), "close_links")
        store.drop(labels, rows, pairs)
        return links

    linked = graph.grouped(buckets, verify, rounds=3, finish=finish)
    named = classes.select("digest", "rep").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("digest", F.coalesce("component", "rep").alias("component_id"))
    found = full.select("doc_id", "digest").join(named, "digest")
    # a doc_id in rows with different texts has one group: its smallest
    found = found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = described.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
