"""The sheet that the points of an image lie on: its corners, and the maps between photo and sheet, a matrix for each image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numerion.functions import geometry as G

#: Fixed value: sheets with a shorter side are none.
SMALLEST = 20
#: Points whose depth falls under this part of the first corner's lie beyond the sheet's horizon.
HORIZON = 0.01


def quads(hulls: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """image_id, quad, width, height, to_sheet, to_photo from ``(image_id, hull)``.

    The quad is the hull's corners farthest towards top left, top right, bottom right and bottom left; the sheet is as wide and high
    as the longer ones of its opposite sides. The matrices are null where a side is under ``smallest`` or three corners are on a line.
    """
    corners = hulls.select("image_id", G.ordered_corners(F.array_sort("hull")).alias("quad"))
    side = lambda a, b: F.sqrt(sum((F.pow((F.get("quad", a)[c] - F.get("quad", b)[c]).cast("double"), F.lit(2)) for c in "xy"), F.lit(0.0)))
    longer = lambda a, b: G.half_even(F.greatest(a, b))
    sized = corners.withColumns({"width": longer(side(1, 0), side(2, 3)), "height": longer(side(3, 0), side(2, 1))})
    sheet = G.rectangle(F.col("width") - 1, F.col("height") - 1)
    matrix = F.when((F.col("width") >= smallest) & (F.col("height") >= smallest), G.projective(F.col("quad"), sheet))
    return sized.withColumn("to_sheet", matrix).withColumn("to_photo", G.inverse(F.col("to_sheet")))


def flat(x: Column, y: Column) -> tuple[Column, Column]:
    """The place on the sheet of a point beside ``quad`` and ``to_sheet``; null without a sheet, or beyond its horizon."""
    m, q = G.entries(F.col("to_sheet")), F.get("quad", F.lit(0))
    depth = lambda x, y: m[6] * x + m[7] * y + m[8]
    u, v = G.project(m, x, y)
    seen = depth(x, y) / F.nullif(depth(q["x"], q["y"]), F.lit(0.0)) > HORIZON
    return F.when(seen, u), F.when(seen, v)


def on_sheet(points: DataFrame, sheets: DataFrame) -> DataFrame:
    """``points`` (image_id, x, y, ...) with u, v: their places on the image's sheet; null without a sheet, or beyond its horizon."""
    u, v = flat(F.col("x"), F.col("y"))
    return points.join(sheets.select("image_id", "quad", "to_sheet"), "image_id").withColumns({"u": u, "v": v}).drop("quad", "to_sheet")


def on_photo(points: DataFrame, sheets: DataFrame) -> DataFrame:
    """``points`` (image_id, u, v, ...) of sheets with x, y: their places in the photo."""
    x, y = G.project(G.entries(F.col("to_photo")), F.col("u"), F.col("v"))
    return points.join(sheets.select("image_id", "to_photo"), "image_id").withColumns({"x": x, "y": y}).drop("to_photo")
