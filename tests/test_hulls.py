"""Hulls, least rectangles and projective maps against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from numerion.functions import geometry as G
from numerion.operators import hulls as H


def brute_hull(points):
    """Corners by half-planes: edges with all points on one side."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts
    cross = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    found = {}
    for a in pts:
        for b in pts:
            if a != b and all((k := cross(a, b, p)) > 0 or (k == 0 and min(a, b) <= p <= max(a, b)) for p in pts):
                found[a] = b
    at, out = pts[0], []
    while at not in out:
        out.append(at)
        at = found[at]
    return out


def point_sets():
    r = random.Random(6)
    sets = [[(r.randint(-k, k), r.randint(-k, k)) for _ in range(n)] for k, n in ((3, 5), (4, 30), (50, 25), (400, 40), (1000, 12)) for _ in range(4)]
    return [*sets, [(5, 5)], [(5, 5)] * 3, [(0, 0), (2, 4), (1, 2)], [(3, y) for y in range(9)], [(x, 7) for x in range(600)], [(0, 0), (9, 0), (9, 9), (0, 9), (4, 4)]]


@pytest.mark.parametrize("bucket", [1, 7, 256])
def test_hulls_equal_half_planes(spark, bucket):
    sets = point_sets()
    rows = [(k, x, y) for k, s in enumerate(sets) for x, y in s]
    random.Random(2).shuffle(rows)
    got = H.hulls(spark.createDataFrame(rows, "image_id long, x long, y long").repartition(4), bucket).collect()
    assert {r["image_id"]: [tuple(p) for p in r["hull"]] for r in got} == {k: brute_hull(s) for k, s in enumerate(sets)}


def test_least_rectangle(spark):
    sets = point_sets()
    df = spark.createDataFrame([(k, x, y) for k, s in enumerate(sets) for x, y in s], "image_id long, x long, y long")
    for row in H.hulls(df).select("image_id", "hull", H.least_rectangle(F.col("hull")).alias("r")).collect():
        h, r = np.array(row["hull"], float), row["r"]
        if len(h) < 3:
            assert r is None
            continue
        areas = []
        for a, b in zip(h, np.roll(h, -1, axis=0), strict=True):
            d = (b - a) / np.hypot(*(b - a))
            u, v = h @ d, h @ np.array([-d[1], d[0]])
            areas.append((u.max() - u.min()) * (v.max() - v.min()))
        assert math.isclose(r["area"], min(areas), rel_tol=1e-9) and math.isclose(r["along"] * r["across"], r["area"], rel_tol=1e-9)
        c = np.array([(p["x"], p["y"]) for p in r["corners"]])
        shoelace = abs(c[:, 0] @ np.roll(c[:, 1], 1) - c[:, 1] @ np.roll(c[:, 0], 1)) / 2
        assert math.isclose(shoelace, r["area"], rel_tol=1e-9)


def test_a_page_of_many_points_is_reduced_where_it_lies(spark):
    points = spark.range(1_000_000).selectExpr("0L AS image_id", "pmod(hash(id), 1600) AS x", "pmod(hash(id, 7), 1200) AS y")
    out = H.hulls(points)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") >= 2
    (row,) = out.collect()
    assert {(0, 0), (1599, 0), (1599, 1199), (0, 1199)} >= {tuple(p) for p in row["hull"] if tuple(p) in {(0, 0), (1599, 0), (1599, 1199), (0, 1199)}}
    xs, ys = zip(*row["hull"], strict=True)
    assert (min(xs), max(xs), min(ys), max(ys)) == (0, 1599, 0, 1199) and len(xs) < 200


def test_projective_maps(spark):
    """Corners go to corners, a round trip ends where it began, quads with three points on a line have no map."""
    r = random.Random(1)
    quads = [[(r.uniform(0, 80), r.uniform(0, 80)), (r.uniform(320, 400), r.uniform(0, 80)), (r.uniform(320, 400), r.uniform(160, 240)), (r.uniform(0, 80), r.uniform(160, 240))] for _ in range(40)]
    flat = [[(0.0, 0.0), (5.0, 5.0), (9.0, 9.0), (0.0, 9.0)], [(1.0, 1.0), (1.0, 1.0), (4.0, 4.0), (0.0, 9.0)], [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (4.5, 4.5)]]
    df = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in q]) for k, q in enumerate(quads + flat)], "k int, q array<struct<x:double,y:double>>")
    to = G.projective(F.col("q"), G.rectangle(300.0, 200.0))
    rows = df.withColumn("m", to).withColumn("n", G.inverse(F.col("m"))).collect()
    for row in rows:
        if row["k"] >= len(quads):
            assert row["m"] is None and row["n"] is None
            continue
        m, n = (np.array(row[c]).reshape(3, 3) for c in "mn")
        apply = lambda a, p: (t := a @ np.array([*p, 1.0]))[:2] / t[2]
        for p, want in zip(quads[row["k"]], [(0, 0), (300, 0), (300, 200), (0, 200)], strict=True):
            assert np.allclose(apply(m, p), want, atol=1e-6) and np.allclose(apply(n, apply(m, p)), p, atol=1e-6)
        p = (r.uniform(50, 350), r.uniform(50, 190))
        assert np.allclose(apply(n, apply(m, p)), p, atol=1e-6)
    assert [r["m"] for r in df.where("k < 1").select(G.projective(F.slice("q", 1, 3), G.rectangle(1.0, 1.0)).alias("m")).collect()] == [None]
