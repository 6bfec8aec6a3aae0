"""Outer contours of ink and the areas they enclose, from the runs of ink and of paper.

Between a run of ink and the paper beside it lies a crack: its place is a column, its sign whether ink begins or
ends there. Paper that reaches the raster's rim over pixel sides is outside; other paper lies in holes. Adding up, row by row,
the places of the cracks to the outside alone gives the area within the outer contour, holes and all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outside(paper: DataFrame, w: Column | int, h: Column | int, name: str = "label") -> DataFrame:
    """``paper`` (runs with the component they belong to, joined over sides) with ``out``: whether the component reaches the rim."""
    w, h = (v if isinstance(v, Column) else F.lit(v) for v in (w, h))
    rim = (F.col("r") == 0) | (F.col("r") == h - 1) | (F.col("a") == 0) | (F.col("z") == w - 1)
    known = paper.groupBy("image_id", name).agg(F.max(rim).alias("out"))
    return paper.join(known, ["image_id", name])


def contours(ink: DataFrame, paper: DataFrame, name: str = "label") -> DataFrame:
    """image_id, ``name``, area (within the outer contour), ink, largest (whether it is the image's largest contour) of components of ``ink`` that lie in no hole.

    ``ink`` and ``paper`` are runs (image_id, r, a, z, ``name``), ``paper`` with ``out``. Equal areas: the component met first is the largest.
    """
    row = Window.partitionBy("image_id", "r").orderBy("a")
    both = ink.select("image_id", "r", "a", "z", name, F.lit(None).cast("boolean").alias("out"), F.lit(True).alias("black")).unionByName(paper.select("image_id", "r", "a", "z", name, "out", F.lit(False).alias("black")))
    # Beyond the ends of a row lies the outside; beside a run cut in pieces lies ink, and no crack.
    crack = lambda step: F.coalesce(step("out").over(row), ~F.coalesce(step("black").over(row), F.lit(False)))
    told = both.withColumns({"begins": crack(F.lag), "ends": crack(F.lead)}).where("black")
    zero = F.lit(0).cast("long")
    signed = F.when(F.col("ends"), F.col("z") + 1).otherwise(zero) - F.when(F.col("begins"), F.col("a")).otherwise(zero)
    each = told.groupBy("image_id", name).agg(F.sum(signed).alias("area"), F.sum(F.col("z") - F.col("a") + 1).alias("ink"), F.max(F.col("begins") | F.col("ends")).alias("outer")).where("outer").drop("outer")
    best = each.groupBy("image_id").agg(F.max(F.struct("area", (-F.col(name)).alias("first"))).alias("best"))
    return each.join(best, "image_id").withColumn("largest", F.col(name) == -F.col("best.first")).drop("best")
