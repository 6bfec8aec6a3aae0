"""Components from runs against flood fill, over strips, pieces and partitions."""

from __future__ import annotations

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from numerion.operators import contours, runs


def flood(raster):
    """{(first row, first column): (x, y, w, h, ink)} of 8-connected ink."""
    seen, out = set(), {}
    for r, line in enumerate(raster):
        for c, v in enumerate(line):
            if v <= 0 or (r, c) in seen:
                continue
            todo, own = deque([(r, c)]), []
            seen.add((r, c))
            while todo:
                i, j = todo.popleft()
                own.append((i, j))
                for a in range(max(0, i - 1), min(len(raster), i + 2)):
                    for b in range(max(0, j - 1), min(len(line), j + 2)):
                        if raster[a][b] > 0 and (a, b) not in seen:
                            seen.add((a, b))
                            todo.append((a, b))
            rows, columns = [i for i, _ in own], [j for _, j in own]
            out[r, c] = (min(columns), min(rows), max(columns) - min(columns) + 1, max(rows) - min(rows) + 1, len(own))
    return out


def spiral(n):
    t = [[0] * n for _ in range(n)]
    r = c = d = 0
    t[0][0] = 1
    moves = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    turned = 0
    while turned < 2:
        a, b = r + moves[d][0], c + moves[d][1]
        e, f = a + moves[d][0], b + moves[d][1]
        if 0 <= a < n and 0 <= b < n and not t[a][b] and not (0 <= e < n and 0 <= f < n and t[e][f]):
            r, c, turned = a, b, 0
            t[r][c] = 1
        else:
            d, turned = (d + 1) % 4, turned + 1
    return t


def rasters():
    r = random.Random(8)
    noise = lambda h, w, p: [[int(r.random() < p) * r.randint(1, 255) for _ in range(w)] for _ in range(h)]
    comb = [[int(c % 2 == 0 or i == 36) for c in range(50)] for i in range(37)]
    steps = [[int(c == i) for c in range(40)] for i in range(40)]
    return [noise(45, 30, 0.2), noise(45, 60, 0.4), noise(1, 1, 1), noise(3, 9, 0), [[1] * 20 for _ in range(33)], spiral(41), comb, steps, [row[::-1] for row in steps], noise(70, 13, 0.5)]


@pytest.mark.parametrize(("height", "bucket", "piece"), [(1, 1, 7), (4, 3, 100), (8, 256, 5), (64, 256, 16)])
def test_components_equal_flood_fill(spark, height, bucket, piece):
    every = rasters()
    rows = [(k, i, at, line[at : at + piece]) for k, raster in enumerate(every) for i, line in enumerate(raster) for at in range(0, len(line), piece)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "image_id long, r int, x int, t array<int>").repartition(5)
    got = {}
    for b in runs.boxes(runs.components(df, height, bucket)).collect():
        got.setdefault(b["image_id"], {})[b["first_row"], b["first_column"]] = (b["x"], b["y"], b["w"], b["h"], b["ink"])
    assert got == {k: f for k, raster in enumerate(every) if (f := flood(raster))}


def test_tiles_need_no_shuffle(spark):
    r = random.Random(3)
    tiles = [(k, [int(r.random() < 0.45) * 255 for _ in range(64)]) for k in range(300)]
    df = spark.createDataFrame(tiles, "vec_id long, ink array<int>").repartition(3)
    told = runs.labelled(runs.tile_runs(df, "vec_id", "ink", 8, 8))
    assert "Exchange" not in told._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    got = {(b["image_id"], b["first_row"], b["first_column"]): b["ink"] for b in runs.boxes(told, "label").collect()}
    assert got == {(k, *at): box[4] for k, t in tiles for at, box in flood([t[i : i + 8] for i in range(0, 64, 8)]).items()}


def test_names_of_images_may_be_texts(spark):
    df = spark.createDataFrame([("b", 0, 0, [1, 0, 1]), ("a", 63, 0, [1]), ("a", 64, 1, [1, 1]), ("a", 70, 0, [])], "image_id string, r int, x int, t array<int>")
    got = runs.boxes(runs.components(df)).orderBy("image_id", "first_column").select("image_id", "first_row", "ink").collect()
    assert list(map(tuple, got)) == [("a", 63, 3), ("b", 0, 1), ("b", 0, 1)]
    assert runs.components(df.where(F.lit(False))).count() == 0


@pytest.mark.parametrize(("height", "piece"), [(3, 4), (64, 100)])
def test_areas_within_outer_contours(spark, height, piece):
    """Ink and all that it closes in, filled by hand; components in holes have no contour of their own."""
    nested = [[int(max(abs(i - 7), abs(j - 7)) % 3 == 0) for j in range(15)] for i in range(15)]
    open_ = [[int(i in (0, 9) or j == 0 or (j == 9 and i != 5)) for j in range(10)] for i in range(10)]
    corner = [[int((i, j) in {(1, 2), (2, 1), (2, 3), (3, 2)}) for j in range(5)] for i in range(5)]
    every = [nested, open_, corner, *(x for x in rasters() if any(map(any, x)))]
    cut = lambda value: spark.createDataFrame(
        [(k, i, at, [int((v > 0) == value) for v in line[at : at + piece]]) for k, t in enumerate(every) for i, line in enumerate(t) for at in range(0, len(line), piece)], "image_id long, r int, x int, t array<int>"
    ).repartition(3)
    sizes = spark.createDataFrame([(k, len(t[0]), len(t)) for k, t in enumerate(every)], "image_id long, w int, h int")
    paper = runs.components(cut(False), height, reach=0).join(sizes, "image_id")
    found = contours.contours(runs.components(cut(True), height), contours.outside(paper, F.col("w"), F.col("h"), "root"), "root").collect()
    got, best = {}, {}
    for row in found:
        at = row["root"] >> 32, row["root"] & 0xFFFFFFFF
        got[row["image_id"], *at] = (row["area"], row["ink"])
        if row["largest"]:
            best[row["image_id"]] = at
    want = {}
    for k, t in enumerate(every):
        h, w = len(t), len(t[0])
        beyond, todo = set(), deque([(-1, -1)])
        while todo:
            i, j = todo.popleft()
            if (i, j) in beyond or not (-1 <= i <= h and -1 <= j <= w) or (0 <= i < h and 0 <= j < w and t[i][j] > 0):
                continue
            beyond.add((i, j))
            todo.extend([(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)])
        # What isn't beyond falls into 8-connected regions: one for each outer contour, named by its first pixel.
        filled = [[int((i, j) not in beyond) for j in range(w)] for i in range(h)]
        ink = flood(t)
        for at, box in flood(filled).items():
            want[k, *at] = (box[4], ink[at][4])
        assert best[k] == min((at for at in flood(filled)), key=lambda at: (-flood(filled)[at][4], at))  # noqa: B023
    assert got == want
