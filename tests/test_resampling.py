"""Windows, warps, sizes, fields and distances of rasters against NumPy, on rasters of many sizes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from numerion.functions import areas as A
from numerion.functions import geometry as G
from numerion.functions import resample as W
from numerion.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rasters():
    r = np.random.default_rng(4)
    return [(k, h, w, r.integers(0, 256, (h, w)) * (r.random((h, w)) < 0.6)) for k, (h, w) in enumerate([(1, 1), (1, 7), (6, 1), (5, 9), (12, 8), (24, 30), (3, 3), (31, 26)])]


@pytest.fixture(scope="module")
def df(spark, rasters):
    return spark.createDataFrame([(k, w, h, t.ravel().tolist()) for k, h, w, t in rasters], "k int, w int, h int, t array<long>")


def test_any_window_from_four_look_ups(df, rasters):
    block = 1 + 2 * (F.col("k") % 6)
    sums = A.summed(F.col("t"), F.col("w"), F.col("h"))
    told = A.windowed(F.col("t"), F.col("s"), F.col("w"), F.col("h"), block, lambda v, s, n: F.struct(v.alias("v"), s.alias("s"), n.alias("n")))
    rows = {r["k"]: r for r in df.withColumn("s", sums).select("k", "s", told.alias("x")).collect()}
    for k, h, w, t in rasters:
        want = np.zeros((h + 1, w + 1), int)
        want[1:, 1:] = t.cumsum(0).cumsum(1)
        assert rows[k]["s"] == want.ravel().tolist()
        half = k % 6
        for i, x in enumerate(rows[k]["x"]):
            part = t[max(0, i // w - half) : i // w + half + 1, max(0, i % w - half) : i % w + half + 1]
            assert (x["v"], x["s"], x["n"]) == (t.ravel()[i], part.sum(), part.size)


def test_warps_take_four_neighbours_or_one(df, rasters):
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    quad = [(-1.5, 0.5), (6.25, 1.0), (7.0, 8.5), (0.5, 6.0)]
    m = G.projective(G.rectangle(9.0, 6.0), F.array(*(point(*p) for p in quad)))
    out = df.withColumn("m", m)
    seen = lambda nearest: W.warped(F.col("t"), F.col("w"), F.col("h"), F.col("m"), 10, 7, nearest)
    for row in out.select("k", "m", seen(False).alias("v"), seen(True).alias("n")).collect():
        _, h, w, t = rasters[row["k"]]
        m = np.array(row["m"]).reshape(3, 3)
        for i in range(70):
            x, y, z = m @ np.array([i % 10, i // 10, 1.0])
            x, y = min(max(x / z, 0), w - 1), min(max(y / z, 0), h - 1)
            assert row["n"][i] in {t[b, a] for a in {round(x - 1e-9), round(x + 1e-9)} for b in {round(y - 1e-9), round(y + 1e-9)}}
            c, r = int(x), int(y)
            c1, r1 = min(c + 1, w - 1), min(r + 1, h - 1)
            want = (t[r, c] * (c + 1 - x) + t[r, c1] * (x - c)) * (r + 1 - y) + (t[r1, c] * (c + 1 - x) + t[r1, c1] * (x - c)) * (y - r)
            assert abs(row["v"][i] - want) <= 0.5 + 1e-6
    assert [r["v"] for r in df.select(W.warped(F.col("t"), F.col("w"), F.col("h"), F.lit(None).cast("array<double>"), 2, 2).alias("v")).distinct().collect()] == [None]


def test_sizes_by_areas_and_between_neighbours(df, rasters):
    small, large = (F.greatest(F.lit(1), F.floor(F.col(c) / 2) + F.col("k") % 2) for c in "wh"), (F.col(c) + 3 * F.col("k") for c in "wh")
    (sw, sh), (lw, lh) = list(small), list(large)
    less, more = W.resized(F.col("t"), F.col("w"), F.col("h"), sw, sh, F.lit(True)), W.resized(F.col("t"), F.col("w"), F.col("h"), lw, lh, F.lit(False))
    for row in df.select("k", sw.alias("sw"), sh.alias("sh"), lw.alias("lw"), lh.alias("lh"), less.alias("less"), more.alias("more")).collect():
        _, h, w, t = rasters[row["k"]]
        fine = np.kron(t, np.ones((row["sh"], row["sw"])))  # each pixel cut so that places begin at cuts
        mean = fine.reshape(row["sh"], h, row["sw"], w).mean(axis=(1, 3))
        assert row["less"] == np.floor(mean + 0.5 + 1e-9).astype(int).ravel().tolist()
        place = lambda n, to: np.clip((np.arange(to) + 0.5) * n / to - 0.5, 0, n - 1)
        across = np.array([np.interp(place(w, row["lw"]), np.arange(w), line) for line in t])
        both = np.array([np.interp(place(h, row["lh"]), np.arange(h), line) for line in across.T]).T
        assert np.abs(np.array(row["more"]).reshape(both.shape) - both).max() <= 0.5 + 1e-6


def test_fields_are_centred_by_mass(df, rasters):
    got = {r["k"]: r["f"] for r in df.select("k", W.in_field(F.col("t"), F.col("w"), F.col("h"), 32).alias("f")).collect()}
    for k, h, w, t in rasters:
        if not t.any():
            assert got[k] is None
            continue
        field = np.array(got[k]["v"]).reshape(32, 32)
        r, c = np.nonzero(field)
        assert field.sum() == t.sum() and sorted(field[field > 0]) == sorted(t[t > 0])
        y, x = (field[r, c] * r).sum() / field.sum(), (field[r, c] * c).sum() / field.sum()
        assert abs(y - 15.5) <= 0.5 + 1e-9 or 0 in r or 31 in r
        assert abs(x - 15.5) <= 0.5 + 1e-9 or 0 in c or 31 in c


@pytest.mark.parametrize("paper", [False, True])
def test_distances_are_exact(spark, paper):
    r = np.random.default_rng(2)
    tiles = [(r.random((5, 7)) < p).astype(int) * 255 for p in (0, 0.1, 0.5, 0.9, 1)]
    df = spark.createDataFrame([(k, t.ravel().tolist()) for k, t in enumerate(tiles)], "k int, t array<long>")
    for row in df.select("k", W.distances(F.col("t"), 7, 5, 2, paper).alias("d")).collect():
        t = np.pad(tiles[row["k"]], 2)
        hits = np.argwhere(t <= 0 if paper else t > 0)
        want = [int(((hits - (i, j)) ** 2).sum(1).min()) if len(hits) else None for i in range(t.shape[0]) for j in range(t.shape[1])]
        assert row["d"] == want


def test_every_branch_of_strokes_and_windows_is_met(spark):
    queries = catalog.queries()
    actions = {(r["action"], r["v"].count("1") > r["n"], r["v"].count("1") < r["n"]) for r in queries["stroke_changes"](spark, SF).collect()}
    assert {a for a, _, _ in actions} == {"thicken", "thin", "keep"} and ("thin", False, True) in actions and ("thicken", True, False) in actions
    windows = {(r["block"], r["window"]) for r in queries["binary_tiles_fitted"](spark, SF).collect()}
    assert {(3, 3), (3, 5), (5, 5)} <= windows
