"""Centroid clustering: Lloyd's rounds on whole numbers with Drake's adaptive bounds.

Each vector keeps the numbers of its several nearest other centroids with a lower bound of
the distance to each, and one remainder bound for all the rest. Bounds follow the moves of
the centroids. A vector whose own distance (an upper bound of it) is below the first bound
keeps its centroid without any distance; else those centroids in front of the first bound
that is above it are measured; if no bound is, all are. Distances are exact whole numbers
wherever two centroids are compared, so ties go to the smaller number, as in a full scan.

Vectors and bounds lie in one written table, replaced round by round; only the centroids
(k rows) pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

#: Components beyond this would not leave squared distances in 64 bits.
LARGEST = 1 << 27
#: Bounds are doubles that have been added up; this share of them covers the rounding.
MARGIN = 1e-9
#: Vectors measured at once.
ROWS = 4096

STATE = "cluster int, upper double, near array<int>, low array<double>, rest double, used int"


@dataclass(frozen=True)
class Settings:
    """scale: a component x becomes floor(scale * x). bounds: single bounds of a vector to
    begin with (a fourth of the centroids by default); later rounds keep as many as any
    vector of the round before needed, an eighth of the centroids at least."""

    k: int = 16
    dims: int = 64
    scale: int = 64
    rounds: int = 3
    seed: str = "1"
    bounds: int | None = None


@dataclass(frozen=True)
class Clusters:
    """assigned(vec_id, cluster, distance), written; centroids by number; of each its
    number of vectors and the sum of their squared distances."""

    assigned: DataFrame
    centroids: list[list[int]]
    sizes: list[int]
    inertias: list[int]


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every vector to every centroid."""
    largest = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0), 1)
    if 4 * vectors.shape[1] * int(largest) ** 2 < 1 << 53:  # every sum is exact in doubles
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(1) for c in centroids], 1)


def scanned(vectors: np.ndarray, centroids: np.ndarray, b: int) -> tuple[np.ndarray, ...]:
    """(cluster, upper, near, low, rest) from all distances; equal ones in order of number."""
    d = distances(vectors, centroids)
    order = np.argsort(d, axis=1, kind="stable")
    root = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
    rest = root[:, b + 1] if root.shape[1] > b + 1 else np.full(len(d), np.inf)
    return order[:, 0], root[:, 0], order[:, 1 : b + 1], root[:, 1 : b + 1], rest


def reassigned(vectors: np.ndarray, centroids: np.ndarray, moves: np.ndarray, state: tuple[np.ndarray, ...], b: int) -> tuple[np.ndarray, ...]:
    """The state after centroids have moved by `moves`, with b single bounds, and how many
    bounds each vector needed (b + 1: all centroids were measured)."""
    cluster, upper, near, low, rest = (x.copy() for x in state)
    upper += moves[cluster]
    low -= moves[near]
    rest -= moves.max(initial=0)
    if near.shape[1] > b:  # what is no longer kept alone joins the remainder
        rest = np.minimum(rest, low[:, b:].min(1))
        near, low = near[:, :b], low[:, :b]
    # bound z holds for the centroids at place z and all after it
    after = np.minimum.accumulate(np.column_stack([low, rest])[:, ::-1], 1)[:, ::-1] * (1 - MARGIN)
    used = np.zeros(len(vectors), np.int64)
    open_ = np.flatnonzero(upper * (1 + MARGIN) >= after[:, 0])
    own = ((vectors[open_] - centroids[cluster[open_]]) ** 2).sum(1)
    upper[open_] = np.sqrt(own.astype(np.float64))
    certain = upper[open_, None] * (1 + MARGIN) < after[open_]
    used[open_] = np.where(certain.any(1), certain.argmax(1), b + 1)
    for z in range(1, b + 1):
        rows = np.flatnonzero(used == z)
        if not len(rows):
            continue
        found = np.column_stack([cluster[rows], near[rows, :z]])
        d = ((vectors[rows, None, :] - centroids[found]) ** 2).sum(2)
        order = np.lexsort((found, d), axis=1)
        found, d = np.take_along_axis(found, order, 1), np.take_along_axis(d, order, 1)
        root = np.sqrt(d.astype(np.float64))
        cluster[rows], upper[rows] = found[:, 0], root[:, 0]
        near[rows, :z], low[rows, :z] = found[:, 1:], root[:, 1:]
    rows = np.flatnonzero(used == b + 1)
    if len(rows):
        cluster[rows], upper[rows], near[rows], low[rows], rest[rows] = scanned(vectors[rows], centroids, b)
    return cluster, upper, near, low, rest, used


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel(), kind))


def _step(centroids: np.ndarray, moves: np.ndarray | None, width: int, b: int, last: bool):
    """A function on batches of (vec_id, v) or, with moves, (vec_id, v, state of `width`
    single bounds)."""

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = _matrix(batch.column(1), centroids.shape[1], np.int64)
        if moves is None:
            state = (*scanned(v, centroids, b), np.full(len(v), b + 1))
        else:
            flat = [batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 6)]
            near, low = _matrix(batch.column(4), width, np.int64), _matrix(batch.column(5), width, np.float64)
            state = reassigned(v, centroids, moves, (flat[0].astype(np.int64), flat[1], near, low, flat[2]), b)
        cluster = pa.array(state[0], pa.int32())
        if last:
            d = ((v - centroids[state[0]]) ** 2).sum(1)
            return pa.RecordBatch.from_arrays([batch.column(0), cluster, pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])
        columns = [cluster, pa.array(state[1]), _lists(state[2], pa.int32()), _lists(state[3], pa.float64()), pa.array(state[4]), pa.array(state[5], pa.int32())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["vec_id", "v", "cluster", "upper", "near", "low", "rest", "used"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield part(batch.slice(at, ROWS))

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cluster, dim, total, n, used): a task's sums of each component; dim -1 has none."""
    totals: dict[int, np.ndarray] = {}
    counts: dict[int, int] = {}
    used = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        cluster = batch.column(1).to_numpy(zero_copy_only=False)
        used = max(used, int(batch.column(2).to_numpy(zero_copy_only=False).max()))
        for c in np.unique(cluster).tolist():
            mine = v[cluster == c]
            totals[c] = totals.get(c, 0) + mine.sum(0, dtype=np.int64)
            counts[c] = counts.get(c, 0) + len(mine)
    rows = [(c, dim, int(x), counts[c], used) for c, t in totals.items() for dim, x in enumerate(t)]
    names = ["cluster", "dim", "total", "n", "used"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def usable(vectors: DataFrame, s: Settings) -> DataFrame:
    """(vec_id, v) of the vectors with exactly `dims` components, none null or non-finite."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where((F.size(x) == s.dims) & finite)
    too_large = F.raise_error(F.lit(f"a scaled component is beyond {LARGEST}; distances would not fit in 64 bits"))
    whole = F.transform("embedding", lambda e: F.when(F.abs(e * s.scale) <= LARGEST, F.floor(e * s.scale)).otherwise(too_large.cast("long")).cast("int"))
    return rows.select("vec_id", whole.alias("v"))


def cluster(vectors: DataFrame, settings: Settings = Settings()) -> Clusters:
    """Clusters of vectors(vec_id, embedding).

    Centroids start as the k vectors with the smallest sha256 of "seed:vec_id" (a null id
    has no digits there), then by components; with fewer vectors there are fewer
    centroids. After each round a centroid becomes the exact floor of its vectors' mean,
    and one without vectors stays. Vectors of another length, null vectors and those with
    a null or non-finite component are left out; one beyond LARGEST raises. Repeated
    rows are vectors of their own, other columns are not read, and an empty table gives
    no centroid and an empty one.
    """
    s = settings
    rows = state = store.written(usable(vectors, s), "vectors")
    name = F.sha2(F.concat(F.lit(f"{s.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select("v", name.alias("name")).orderBy("name", "v").limit(s.k).collect()
    if not first:
        return Clusters(rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [], [], [])
    centroids = np.array([r["v"] for r in first], np.int64)
    k = len(centroids)
    width = b = min(k - 1, s.bounds if s.bounds is not None else max(1, k // 4))
    moves = None
    for _ in range(s.rounds):
        step = _step(centroids, moves, width, b, last=False)
        before, state = state, store.written(state.mapInArrow(step, f"vec_id long, v array<int>, {STATE}"), "bounds")
        store.drop(before)
        width = b
        sums = state.select("v", "cluster", "used").mapInArrow(_sums, "cluster int, dim int, total long, n long, used int")
        found = sums.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("used").alias("used"))
        moved, used = centroids.copy(), 0
        for r in found.collect():  # k * dims rows
            moved[r["cluster"], r["dim"]] = r["total"] // r["n"]
            used = max(used, r["used"])
        moves = np.sqrt(((moved - centroids) ** 2).sum(1).astype(np.float64))
        centroids = moved
        b = min(b, max(1, k // 8, used)) if k > 1 else 0
    schema = "vec_id long, cluster int, distance long"
    assigned = store.written(state.mapInArrow(_step(centroids, moves, width, b, last=True), schema), "assigned")
    store.drop(state)
    by = assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("distance").alias("inertia"))
    found = {r["cluster"]: (r["n"], r["inertia"]) for r in by.collect()}
    sizes, inertias = zip(*(found.get(c, (0, 0)) for c in range(k)))
    return Clusters(assigned, centroids.tolist(), list(sizes), list(inertias))
