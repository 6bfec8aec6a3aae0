"""Clustering by pivot bounds against measuring every distance."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from numerion.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, v int"


def brute(rows, k, dim, rounds):
    """The clusters by plain loops over Python integers."""
    kept = []
    for vec_id, x in rows:
        if x is None or len(x) != dim or any(c is None or not math.isfinite(c) for c in x):
            continue
        kept.append((vec_id, [math.floor(64 * max(-(2.0**27) / 64, min(2.0**27 / 64, float(np.float32(c))))) for c in x]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    mids = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda v: min((far(v, m), j) for j, m in enumerate(mids))
    for _ in range(rounds):
        told = [pick(v)[1] for _, v in kept]
        mids = [[sum(c) // len(c) for c in zip(*own, strict=True)] if (own := [v for (_, v), t in zip(kept, told, strict=True) if t == j]) else m for j, m in enumerate(mids)]
    found = [(i, *pick(v)) for i, v in kept]
    inertia = {j: sum(d for _, d, c in found if c == j) for j in range(len(mids))}
    name = lambda m: hashlib.sha256(",".join(map(str, m)).encode()).hexdigest()
    return [(i, j, d, inertia[j], sum(inertia.values()), name(mids[j])) for i, d, j in found]


def awkward(seed, n, dim):
    r = random.Random(seed)
    near = [[r.uniform(-3, 3) for _ in range(dim)] for _ in range(5)]
    rows = [(i, [c + r.gauss(0, 0.3) for c in r.choice(near)]) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [1.0] * (dim - 1)), (n + 3, [None] + [0.0] * (dim - 1)), (n + 4, [float("nan")] * dim), (n + 5, [float("inf")] + [0.0] * (dim - 1))]
    rows += [(None, [0.5] * dim), (3, rows[3][1]), (3, rows[7][1]), (n + 6, [1e30] + [0.0] * (dim - 1)), *[(n + 10 + i, rows[0][1]) for i in range(n // 3)]]
    return rows


@pytest.mark.parametrize(("seed", "n", "k", "dim", "rounds"), [(1, 120, 6, 4, 3), (2, 40, 16, 3, 1), (3, 5, 16, 2, 2), (4, 60, 2, 8, 4)])
def test_clusters_equal_brute_force(spark, seed, n, k, dim, rounds):
    rows = awkward(seed, n, dim)
    df = spark.createDataFrame([(i, x, 1, "x", 2) for i, x in rows], SCHEMA).repartition(3)
    got = centroids.report(df, k=k, dim=dim, rounds=rounds).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, k, dim, rounds), key=key)


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1, "x", 2), (2, [1.0], 1, "x", 2)]):
        out = centroids.report(spark.createDataFrame(rows, SCHEMA))
        assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and out.count() == 0


def test_bounds_save_distances_and_lose_nothing():
    """Vectors around far-off centroids: most exact distances are not measured; equal ones go to the smaller number."""
    r = np.random.default_rng(5)
    mids = r.integers(-500, 500, (16, 64))
    v = mids[r.integers(0, 16, 3000)] + r.integers(-20, 21, (3000, 64))
    mids[9] = mids[4]
    every = centroids.squared(v, mids)
    cluster, best, measured = centroids.nearest(v, every, mids, mids)
    assert (cluster == every.argmin(1)).all() and (best == every.min(1)).all()
    assert measured < 0.2 * every.size


def test_huge_components_do_not_overflow():
    v = np.array([[centroids.MOST] * 64, [-centroids.MOST] * 64])
    assert centroids.squared(v, v).tolist() == [[0, 2**62], [2**62, 0]]
    cluster, best, _ = centroids.nearest(v, centroids.squared(v, v), v, v)
    assert cluster.tolist() == [0, 1] and best.tolist() == [0, 0]


def test_sql_equals_query(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = centroids.report(spark.read.parquet(f"{sf}/embeddings.parquet")).toPandas().sort_values("vec_id").reset_index(drop=True)
    want = con.sql(centroids.ORACLE).df()[got.columns].sort_values("vec_id").reset_index(drop=True)
    assert got.equals(want) and len(got)
