"""Exact top-k inner products without random access, over blocks of vectors.

Each block keeps one list per dimension, sorted by value, with the rows its entries belong to. A query reads its lists
from the end that is best for the sign of its component, all to the same
depth. What a list has not yet shown is worth at most the value at the depth reached
and at least the list's last value. A query reads on until vectors not seen in any list
cannot reach its k-th score; from there on the seen ones keep a lower and an upper bound,
and those that cannot reach it are out. When few are left, reading stops
and their scores are resolved.

Up to a part of the lists, an entry is looked at only as it is read (``opening``): 16 entries of each list, then twice as many, and so
on. Where the values that far down show that this can't be enough (dense vectors whose dimensions are independent), single entries cost more than
they save, and the same bounds are worked out for the block at even depths, as matrix products over the queries that
read on together. At full depth both bounds are the score itself, so the result is exact in any case.

Queries and vectors meet block by block: a stated query set against all
rows. The first block knows no k-th score, so there the k-th greatest lower
bound stands for it; what it finds is the floor that every other block has
to beat, and a block whose best conceivable score is under the floor is not read. Each
block returns at most k rows a query, and these are ranked by
window. No block grows with the data.

Defined results: vectors that are null, empty, or hold null or non-finite
components take no part, nor rows without a vec_id; vectors of different lengths have no
score together; all rows with the query's vec_id count as the query's own; a query id is
answered once, for the smallest of its vectors; scores are exact, those beyond a long
count as its greatest or least value but one, and so do components; ties go to the smaller vec_id; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from numerion.llm.common import shared_table

K = 20
EVERY = 20
#: Queries and vectors that meet in one task.
QUERIES = 1024
VECTORS = 8192
#: Looks at the bounds in one list, at even distances.
LOOKS = 8
#: Entries of each list that are read first, and the part of the lists up to which entries are read one by one.
FIRST, PART = 16, 8
#: A query with at most this share of a block left is resolved.
FEW = 0.04
#: Doubles hold whole numbers up to this exactly.
EXACT = 2.0**53
MOST = 2**63 - 1


def integer_vectors(table: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, dim and v (floor(scale * x) as doubles, exact) of the vectors that take part."""
    x = F.transform("embedding", lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("double"))
    fine = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    rows = table.select(table["vec_id"].cast("long").alias("vec_id"), table["embedding"].alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size("embedding") > 0)).select("vec_id", F.size("embedding").alias("dim"), x.alias("v"))


class Lists:
    """The sorted lists of a block, one per dimension, with their values at each look."""

    def __init__(self, v: np.ndarray) -> None:
        self.order = np.argsort(v, axis=0, kind="stable")
        self.ranked = ranked = np.take_along_axis(v, self.order, axis=0)
        n = len(v)
        self.v, self.bottom, self.top = v, ranked[0], ranked[-1]
        self.depths = sorted({max(1, n * look // LOOKS) for look in range(1, LOOKS + 1)})
        #: What reading from the top and from the bottom has come to.
        self.high = [ranked[n - depth] for depth in self.depths]
        self.low = [ranked[depth - 1] for depth in self.depths]

    def unseen(self, q: np.ndarray, look: int) -> np.ndarray:
        """The most that a vector not seen in any list can score."""
        return np.maximum(q, 0) @ self.high[look] + np.minimum(q, 0) @ self.low[look]

    def best(self, q: np.ndarray) -> np.ndarray:
        """The most that any vector of the block can score."""
        return np.maximum(q, 0) @ self.top + np.minimum(q, 0) @ self.bottom

    def upper(self, q: np.ndarray, look: int) -> np.ndarray:
        """Upper bounds of all scores: entries not yet read are worth what the reading has come to."""
        return np.maximum(q, 0) @ np.maximum(self.v, self.high[look]).T + np.minimum(q, 0) @ np.minimum(self.v, self.low[look]).T

    def lower(self, q: np.ndarray, look: int) -> np.ndarray:
        """Lower bounds of all scores: entries not yet read are worth the list's last value."""
        seen_high, seen_low = self.v >= self.high[look], self.v <= self.low[look]
        return np.maximum(q, 0) @ np.where(seen_high, self.v, self.bottom).T + np.minimum(q, 0) @ np.where(seen_low, self.v, self.top).T


def opening(lists: Lists, q: np.ndarray, own: np.ndarray, floor: float, k: int) -> tuple[np.ndarray | None, int]:
    """One query's reading from the begin of its lists: who may still be among its k best, or None if a part of the lists doesn't tell; and the depth read to.

    Only entries that have been read are looked at: their rows' known components, and for rows seen the bounds that follow.
    """
    n, asked = len(lists.v), np.flatnonzero(q)  # lists of a zero say nothing
    q = q[asked]
    worst = np.where(q > 0, lists.bottom[asked], lists.top[asked])
    known, score, spare = {}, np.zeros(n), np.zeros(n)
    seen = np.zeros(n, bool)
    done, depth = 0, FIRST
    while depth * PART <= n:
        steps = np.arange(done, depth)[:, None]
        at = np.where(q > 0, n - 1 - steps, steps)
        rows, value = lists.order[at, asked], lists.ranked[at, asked]
        flat = rows.ravel()
        score += np.bincount(flat, (q * value).ravel(), n)
        spare += np.bincount(flat, np.broadcast_to(q * worst, rows.shape).ravel(), n)
        known[done] = (flat, np.broadcast_to(np.arange(len(asked)), rows.shape).ravel())
        seen[flat] = True
        last = q * lists.ranked[np.where(q > 0, n - depth, depth - 1), asked]
        some = np.flatnonzero(seen & ~own)
        bar = floor
        if len(some) >= k:
            lower = score[some] + (q * worst).sum() - spare[some]
            bar = max(bar, np.partition(lower, len(some) - k)[len(some) - k])
        if last.sum() < bar:
            covered = sum(np.bincount(f, last[d], n) for f, d in known.values())
            left = some[score[some] + last.sum() - covered[some] >= bar]
            if len(left) <= max(k, FEW * n):
                out = np.zeros(n, bool)
                out[left] = True
                return out, depth
        done, depth = depth, depth * 2
    return None, done


def read(lists: Lists, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Who may still be among each query's k best, and how deep its lists were read.

    ``floor`` is a score that each query has k times elsewhere already (or minus infinity).
    """
    n = len(lists.v)
    left, depth = ~own, np.zeros(len(q), np.int64)
    left[lists.best(q) < floor] = False
    waiting = np.flatnonzero(left.sum(axis=1) > k)
    # A part of the lists can only be enough where vectors that it doesn't show stay under the floor.
    deep = max(1, n // PART)
    beyond = np.maximum(q, 0) @ lists.ranked[n - deep] + np.minimum(q, 0) @ lists.ranked[deep - 1]
    for i in waiting[(beyond < floor)[waiting] | np.isneginf(floor[waiting])].tolist():
        found, depth[i] = opening(lists, q[i], own[i], floor[i], k)
        if found is not None:
            left[i] &= found
    waiting = waiting[(depth[waiting] == 0) | (left[waiting].sum(axis=1) > max(k, FEW * n))]
    for look, reached in enumerate(lists.depths[:-1]):
        depth[waiting] = reached
        bar = floor[waiting]
        # Without a floor the lower bounds give one; they say little before half of the lists is read.
        bare = np.flatnonzero(np.isneginf(bar))
        if len(bare) and 2 * reached >= n:
            lower = lists.lower(q[waiting[bare]], look)
            lower[own[waiting[bare]]] = -np.inf
            bar[bare] = np.partition(lower, n - k, axis=1)[:, n - k]
        ready = lists.unseen(q[waiting], look) < bar
        if ready.any():
            at = waiting[ready]
            left[at] &= lists.upper(q[at], look) >= bar[ready, None]
            waiting = waiting[left[waiting].sum(axis=1) > max(k, FEW * n)]
        if not len(waiting):
            break
    depth[waiting] = n
    return left, depth


def exact_best(ids: np.ndarray, v: np.ndarray, query_ids: np.ndarray, q: np.ndarray, left: np.ndarray, k: int) -> pd.DataFrame:
    """The k best by whole numbers of any size, for components whose products doubles don't hold."""
    whole = [[int(x) for x in row] for row in v]
    out = []
    for name, row, some in zip(query_ids.tolist(), q, left, strict=True):
        asked = [int(x) for x in row]
        scores = ((max(-MOST, min(MOST, sum(a * b for a, b in zip(asked, whole[j], strict=True)))), int(ids[j])) for j in np.flatnonzero(some))
        out += [(name, i, s) for s, i in sorted(scores, key=lambda x: (-x[0], x[1]))[:k]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")


def best_of_block(ids: np.ndarray, v: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None) -> pd.DataFrame:
    """The k best of one block for each query, without those under its floor."""
    own = query_ids[:, None] == ids[None, :]
    if np.abs(v).max(initial=0) * np.abs(q).max(initial=0) * v.shape[1] >= EXACT:
        return exact_best(ids, v, query_ids, q, ~own, k)
    floor = np.full(len(q), -np.inf) if floor is None else floor
    left = read(Lists(v), q, own, floor, k)[0] if len(v) > k else ~own
    out_q, out_v, out_s = [], [], []
    for i in range(len(q)):
        some = np.flatnonzero(left[i])
        score = v[some] @ q[i]
        order = np.lexsort((ids[some], -score))[:k]
        order = order[score[order] >= floor[i]]
        out_q.append(np.full(len(order), query_ids[i]))
        out_v.append(ids[some][order])
        out_s.append(score[order])
    return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s).astype(np.int64)})


def _meet(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        floor = left["floor"].to_numpy(np.float64, na_value=np.nan)
        return best_of_block(right["vec_id"].to_numpy(), np.stack(right["v"]), left["asked_id"].to_numpy(), np.stack(left["v"]), k, np.where(np.isnan(floor), -np.inf, floor))

    return run


def top_k(table: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by ``every``."""
    vectors = integer_vectors(table)
    queries = vectors.where(F.col("vec_id") % every == 0)
    # Sizes only: how many blocks there are follows from the number of rows.
    rows = table.count()
    nv, nq = max(2, -(-rows // VECTORS)), max(1, -(-(rows // every) // QUERIES))
    block = lambda n: F.pmod(F.hash("vec_id"), F.lit(n))
    each = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b)))
    first = queries.groupBy("vec_id").agg(F.min(F.struct("v", "dim")).alias("f")).select(F.col("vec_id").alias("asked_id"), "f.dim", "f.v", block(nq).alias("qb"))
    held = vectors.select("vec_id", "dim", "v", block(nv).alias("vb"), each(0, nq - 1).alias("qb"))

    def met(asked: DataFrame, held: DataFrame) -> DataFrame:
        pairs = asked.groupBy("dim", "qb", "vb").cogroup(held.groupBy("dim", "qb", "vb"))
        return pairs.applyInPandas(_meet(k), "query_id long, vec_id long, score long")

    # At most k rows a query: what the first block found, and its k-th score where it has one.
    opening = shared_table(met(first.withColumn("floor", F.lit(None).cast("double")).withColumn("vb", F.lit(0)), held.where("vb = 0")), "opening")
    floors = opening.groupBy("query_id").agg(F.min("score").cast("double").alias("low"), F.count("*").alias("n")).where(F.col("n") >= k)
    asked = first.join(floors, F.col("asked_id") == F.col("query_id"), "left").select("asked_id", "dim", "v", "qb", F.when(F.abs("low") < EXACT, F.col("low")).alias("floor"), each(1, nv - 1).alias("vb"))
    best = opening.unionByName(met(asked, held.where("vb > 0")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) r WHERE rank <= {K}
"""
