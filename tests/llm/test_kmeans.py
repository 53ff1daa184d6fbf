"""Centroid clustering against plain rounds with all distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from quillmill.llm import kmeans

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, s):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == s.dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(s.scale * float(np.float32(x))) for x in v]))
    name = lambda r: (hashlib.sha256(f"{s.seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [list(v) for _, v in sorted(kept, key=name)[: s.k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids)) for _, v in kept]

    for _ in range(s.rounds):
        found = assign()
        for k in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, found) if c == k]
            if mine:
                centroids[k] = [sum(x) // len(mine) for x in zip(*mine)]
    found = assign() if centroids else []
    return sorted((-1 if i is None else i, c, d) for (i, _), (d, c) in zip(kept, found)), centroids


def vectors(n, dims, seed, spread=1.0):
    r = random.Random(seed)
    centres = [[r.uniform(-spread, spread) for _ in range(dims)] for _ in range(6)]
    return [(k, [x + r.gauss(0, 0.2) for x in r.choice(centres)]) for k in range(n)]


def same(spark, rows, s, parts=3):
    got = kmeans.cluster(spark.createDataFrame(rows, SCHEMA).repartition(parts), s)
    want, centroids = plain(rows, s)
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"]) for r in got.assigned.collect()) == want
    assert got.centroids == centroids
    for c in range(len(centroids)):
        mine = [d for _, k, d in want if k == c]
        assert (got.sizes[c], got.inertias[c]) == (len(mine), sum(mine))
    return got


@pytest.mark.parametrize("bounds", [None, 1, 3, 9, 40])
def test_clusters_are_those_of_plain_rounds(spark, bounds):
    same(spark, vectors(700, 8, 1), kmeans.Settings(k=12, dims=8, rounds=5, bounds=bounds))


def test_ties_repeats_and_what_is_left_out(spark):
    rows = [(k, [float(k % 3), float(k % 2)]) for k in range(60)] * 2  # many equal vectors and distances
    rows += [(None, [0.5, 0.5]), (70, None), (71, []), (72, [1.0]), (73, [1.0, None]), (74, [float("nan"), 1.0]), (75, [float("inf"), 0.0]), (76, [-0.0, -0.01])]
    same(spark, rows, kmeans.Settings(k=7, dims=2, scale=4))
    same(spark, rows[:3], kmeans.Settings(k=7, dims=2))  # fewer vectors than centroids
    same(spark, rows[:1], kmeans.Settings(k=1, dims=2))


def test_empty_table_extra_columns_and_large_components(spark):
    from pyspark.sql import functions as F

    none = kmeans.cluster(spark.createDataFrame([], SCHEMA))
    assert none.assigned.count() == 0 and none.centroids == [] and none.assigned.columns == ["vec_id", "cluster", "distance"]
    rows = vectors(90, 4, 3, 30_000.0)  # sums beyond 2**53 are exact, too
    named = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("v", "cluster", "distance", "upper", "near", "used", "name")})
    s = kmeans.Settings(k=5, dims=4, scale=4000)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in kmeans.cluster(named, s).assigned.collect()) == plain(rows, s)[0]
    with pytest.raises(Exception, match="beyond"):
        kmeans.cluster(spark.createDataFrame([(1, [1e30] * 4)], SCHEMA), s)


@pytest.mark.parametrize("seed", range(20))
def test_bounds_certify_only_what_is_certain(seed):
    """Random moves: the state stays that of a full scan, and bounds stay bounds."""
    r = np.random.default_rng(seed)
    k, dims, b = int(r.integers(2, 20)), int(r.integers(1, 6)), int(r.integers(1, 6))
    b = min(b, k - 1)
    v, c = r.integers(-9, 9, (200, dims)), r.integers(-9, 9, (k, dims))
    state = kmeans.scanned(v, c, b)
    for _ in range(6):
        moved = c + r.integers(-2, 3, c.shape) * (r.random((k, 1)) < 0.5)
        moves, c = np.sqrt(((moved - c) ** 2).sum(1).astype(float)), moved
        b = max(1, b - int(r.integers(0, 2)))
        *state, used = kmeans.reassigned(v, c, moves, tuple(state), b)
        d = ((v[:, None, :] - c) ** 2).sum(2)
        assert (state[0] == d.argmin(1)).all() and state[2].shape[1] == b and used.max() <= b + 1
        root = np.sqrt(d)
        assert (state[1] >= root[np.arange(len(v)), state[0]] - 1e-9).all()
        assert (state[3] <= np.take_along_axis(root, state[2], 1) + 1e-9).all()
        others = np.ones((len(v), k), bool)
        np.put_along_axis(others, np.column_stack([state[0], state[2]]), False, 1)
        assert (np.where(others, root, np.inf).min(1) >= state[4] - 1e-9).all()
