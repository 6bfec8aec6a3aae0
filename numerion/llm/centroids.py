"""Clustering of vectors around centroids, with a table of pivot distances (LAESA).

1. Vectors of exactly ``dim`` finite components become integers, ``floor(scale * x)``.
2. The ``k`` vectors with the smallest salted hashes of their ids are the first
   centroids, and the fixed pivots too. Every vector's squared distances to the pivots
   are worked out once and stored with it.
3. In each round a vector's distance to a centroid is at least the difference of
   their distances to any pivot. The centroid of the least bound gets an exact
   distance first; only centroids whose bound doesn't exceed it get one as well.
4. Each task adds up the vectors of its clusters: at most ``k`` rows of sums a task,
   summed by Spark. What passes through the driver are the ``k`` centroids, at most
   ``k * dim`` integers whatever the number of vectors.

Bounds are floating-point with a margin far over their error, and drop a centroid
only where it is strictly farther than one already measured, so results
(integers, ties to the smaller centroid) are those of measuring all.

Defined results: null vectors, and vectors of another length, with a null or with a
non-finite component, have no row. Rows that repeat an id or a vector count
as often as they are there; a null id is hashed as the empty id; equal hashes go by the vector. With fewer than ``k``
vectors each is a centroid. Components are held within +-2^27, so that squared distances fit 64 bits.
An empty table gives an empty result; columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numerion.llm.common import shared_table

K, DIM, ROUNDS, SCALE, SEED = 16, 64, 3, 64, 1
#: Components beyond this saturate.
MOST = 1 << 27
#: Vectors whose bounds are held at once.
STEP = 2048
#: Relative error allowed for in the bounds; that of a square root and a difference is under 1e-15.
MARGIN = 1e-12


def integers(vectors: DataFrame, dim: int = DIM, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, v: the vectors that count, in integers."""
    v = vectors[vector_column]
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x.cast("double") * scale))).cast("int"))
    return vectors.where((F.size(v) == dim) & finite).select(vectors[id_column].alias("vec_id"), whole.alias("v"))


def first_centroids(whole: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes, in their order: a top-k, so tasks hand on ``k`` rows each."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = whole.select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow array of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def squared(v: np.ndarray, points: np.ndarray) -> np.ndarray:
    """All exact squared distances between rows of ``v`` and of ``points``."""
    out = np.empty((len(v), len(points)), np.int64)
    for j, p in enumerate(points):
        gap = v - p
        out[:, j] = np.einsum("ij,ij->i", gap, gap)
    return out


def nearest(v: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row, its squared distance, and how many exact distances were measured."""
    root, reach = np.sqrt(to_pivots.astype(np.float64)), np.sqrt(squared(centroids, pivots).astype(np.float64))
    least = np.zeros((len(v), len(centroids)))
    for p in range(len(pivots)):
        a, b = root[:, p, None], reach[None, :, p]
        np.maximum(least, np.abs(a - b) - MARGIN * (a + b), out=least)
    least *= least
    every = np.arange(len(v))
    guess = least.argmin(1)
    gap = v - centroids[guess]
    best = np.einsum("ij,ij->i", gap, gap)
    alive = least <= best[:, None] * (1 + MARGIN)
    alive[every, guess] = False
    cluster, measured = guess.copy(), len(v)
    for j in range(len(centroids)):
        rows = np.flatnonzero(alive[:, j] & (least[:, j] <= best * (1 + MARGIN)))
        gap = v[rows] - centroids[j]
        d = np.einsum("ij,ij->i", gap, gap)
        measured += len(rows)
        better = (d < best[rows]) | ((d == best[rows]) & (j < cluster[rows]))
        best[rows[better]], cluster[rows[better]] = d[better], j
    return cluster, best, measured


TABLE = "vec_id long, v array<int>, to_pivots array<long>"


def pivot_table(whole: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, v, to_pivots: every vector with its squared distances to the pivots, stored in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(1), pivots.shape[1])
            far = squared(v, pivots)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * len(pivots), pa.int32()), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["vec_id", "v", "to_pivots"])

    return shared_table(whole.select(F.col("vec_id").cast("long").alias("vec_id"), "v").mapInArrow(run, TABLE), "pivots")


def _measured(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, pivots: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, STEP):
            part = b.slice(at, STEP)
            v = _matrix(part.column(1), centroids.shape[1])
            cluster, best, _ = nearest(v, _matrix(part.column(2), len(pivots)), centroids, pivots)
            yield part.column(0), v, cluster, best


def sums(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """cluster, n, sums: of each task's vectors; at most a row per centroid and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, v, cluster, _ in _measured(batches, centroids, pivots):
            np.add.at(n, cluster, 1)
            np.add.at(total, cluster, v)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return table.mapInArrow(run, "cluster long, n long, sums array<long>")


def moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means; those without vectors stay."""
    wide = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(centroids.shape[1])]
    after = centroids.copy()
    for r in sums(table, centroids, pivots).groupBy("cluster").agg(F.sum("n").alias("n"), *wide).collect():
        after[r["cluster"]] = [int(s) // r["n"] for s in r[2:]]
    return after


def assigned(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, cluster, best in _measured(batches, centroids, pivots):
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(best)], names=["vec_id", "cluster", "distance"])

    return table.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = K, dim: int = DIM, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance of every vector after ``rounds`` rounds, and the centroids."""
    whole = integers(vectors, dim, scale)
    pivots = first_centroids(whole, k, seed)
    if not len(pivots):
        return whole.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), pivots
    table, centroids = pivot_table(whole, pivots), pivots
    for _ in range(rounds):
        centroids = moved(table, centroids, pivots)
    return assigned(table, centroids, pivots), centroids


def report(vectors: DataFrame, k: int = K, dim: int = DIM, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector."""
    found, centroids = cluster(vectors, k, dim, rounds, scale, seed)
    digests = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    named = found.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    rows = shared_table(found, "clusters") if digests else found
    total = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # At most k rows, one of each centroid.
    per = {r["cluster"]: r["cluster_inertia"] for r in total.collect()}
    inertia = found.sparkSession.createDataFrame([(j, s, sum(per.values())) for j, s in per.items()], "cluster int, cluster_inertia long, inertia long")
    small = named.join(inertia, "cluster")
    return rows.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = K, dim: int = DIM, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> str:
    """DuckDB text over ``embeddings``: every distance of every round."""
    text = f"""
WITH whole AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v AS c FROM (
  SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM whole ORDER BY h, v LIMIT {k}) q)"""
    for n in range(rounds + 1):
        text += f""",
a{n} AS MATERIALIZED (SELECT rid, (m).j AS j, (m).d AS d FROM (SELECT rid, min({{'d': d, 'j': j}}) AS m FROM (
  SELECT rid, j, CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM whole, c{n}) q GROUP BY rid) r)"""
        if n < rounds:
            text += f""",
m{n} AS (SELECT j, i, sum(x) AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, unnest(range({dim})) AS i FROM a{n} JOIN whole USING (rid)) q GROUP BY j, i),
c{n + 1} AS MATERIALIZED (SELECT c{n}.j, coalesce(t.c, c{n}.c) AS c FROM c{n} LEFT JOIN (SELECT j, list(CAST(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS BIGINT) ORDER BY i) AS c FROM m{n} GROUP BY j) t USING (j))"""
    return (
        text
        + f"""
SELECT vec_id, CAST(j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN whole USING (rid) JOIN c{rounds} USING (j)
"""
    )


ORACLE = oracle()
