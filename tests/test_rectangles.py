"""Hulls and least rectangles of whole batches against the column functions, and how often their queries shuffle."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from numerion.operators import hulls as H
from numerion.plans import shapes

SF = "/root/testdata/sf0.001"


def sets():
    r = random.Random(11)
    found = [[(r.randint(-k, k), r.randint(-k, k)) for _ in range(n)] for k, n in ((1, 4), (2, 6), (5, 20), (40, 9), (300, 60), (9000, 15)) for _ in range(6)]
    return [*found, [(4, 4)], [(1, 1), (5, 9)], [(0, 0), (1, 1), (2, 2)], [(0, 0), (4, 0), (4, 4), (0, 4)], [(x, x * x) for x in range(-30, 30)], [(x, -x * x) for x in range(40)]]


@pytest.mark.parametrize("bucket", [1, 13, H.BUCKET])
def test_batches_equal_column_functions(spark, bucket):
    rows = [(f"image {k}", x, y) for k, s in enumerate(sets()) for x, y in s] + [("image 0", None, 5), ("image 0", 5, None), ("none", None, None), (None, 0, 0), (None, 8, 0), (None, 8, 4)]
    random.Random(1).shuffle(rows)
    points = spark.createDataFrame(rows, "image_id string, x int, y int").repartition(3)
    gathered = points.where("x is not null and y is not null").groupBy("image_id").agg(F.collect_list(F.struct(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))).alias("p"))
    plain = gathered.select("image_id", H.hull(F.col("p")).alias("hull"))
    got = H.hulls(points, bucket)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    flat = [F.get("r.corners", F.lit(k))[c].alias(f"{c}{k}") for k in range(4) for c in "xy"]
    want = plain.withColumn("r", H.least_rectangle(F.col("hull"))).select("image_id", "r.area", F.col("r.a.x").alias("ax"), F.col("r.a.y").alias("ay"), "r.along", "r.across", *flat)
    boxed = H.rectangles(got)
    assert boxed.dtypes == want.dtypes and sorted(map(str, boxed.collect())) == sorted(map(str, want.collect()))


def test_points_too_far_out_are_refused():
    with pytest.raises(OverflowError):
        H.corners(np.zeros(3, int), np.array([0, 1, H.FAR]), np.array([0, 5, 3]))
    assert [len(a) for a in H.corners(*np.zeros((3, 0), int))] == [0, 0, 0]


def test_no_points(spark):
    none = H.hulls(spark.createDataFrame([], "image_id long, x long, y long"))
    assert none.count() == 0 and H.rectangles(none).count() == 0


def dealt(spark, query):
    """The exchanges of a query where nothing is broadcast."""
    kept = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in kept}
    for k, v in kept.items():
        spark.conf.set(k, v)
    try:
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return [line for line in plan.split("\n") if "Exchange " in line and "Reused" not in line]


def test_points_are_dealt_once(spark):
    assert len(dealt(spark, shapes.least_rectangles)) == 1


def test_hulls_are_made_once_for_both_ways(spark):
    """Points of hulls, hulls, and boxes are dealt once each; corners of boxes, and maps of many numbers, never are."""
    lines = dealt(spark, shapes.boxes_on_sheets)
    assert len(lines) == 3 and all("hashpartitioning(image_id" in line for line in lines)
