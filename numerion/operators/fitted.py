"""The local threshold whose window is fitted to the digits that a first one finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numerion.functions import areas as A
from numerion.functions import raster as X
from numerion.operators import boxes as B
from numerion.operators import runs as R
from numerion.operators import tiles as P
from numerion.params import Reading


def fitted_block(block: Column, href: Column, w: Column | int, h: Column | int, p: Reading) -> Column:
    """The window for digits of height ``href``: at most half of the shorter side, odd; the first one where that is no smaller."""
    w, h = (v if isinstance(v, Column) else F.lit(v) for v in (w, h))
    wanted = F.floor(F.lit(p.window_digits) * href).cast("long")
    odd = lambda v: v + (1 - v % 2)
    most = odd(F.floor(F.least(w, h) / 2).cast("long"))
    return F.when(wanted > block, odd(F.least(wanted, most))).otherwise(block)


def binarise(tiles: DataFrame, block: Column, c: int = 3, w: int = 8, h: int = 8, p: Reading | None = None) -> DataFrame:
    """vec_id, block, window, ink of each tile (vec_id, t): ``block`` first, then the window fitted to the reference height found.

    1. Blur, global level and polarity, and the summed areas of the blurred tile, once for both windows.
    2. Ink by the first window; its components, from runs, give a reference height where any of them has the shape of a digit.
    3. Ink by the fitted window, from the same sums; the global level instead, where that is over half of the tile.

    Rows meet again by ``vec_id``, which names one tile.
    """
    p = p or Reading()
    told = P.levelled(tiles.withColumn("block", block.cast("long")), w, h).withColumn("sums", A.summed(F.col("blurred"), w, h))
    first = told.withColumn("first", A.local_ink(F.col("blurred"), F.col("sums"), F.col("light"), w, h, F.col("block"), c))
    found = R.boxes(R.labelled(R.tile_runs(first, "vec_id", "first", w, h)), "label")
    digits = B.with_reference_height(found.where(f"h >= {p.window_min_digit} AND 2 * w <= 3 * h"))
    heights = digits.groupBy(F.col("image_id").alias("vec_id")).agg(F.max("href").alias("href"))
    fitted = first.join(heights, "vec_id", "left").withColumn("window", F.coalesce(fitted_block(F.col("block"), F.col("href"), w, h, p), "block"))
    second = fitted.withColumn("second", F.when(F.col("window") == F.col("block"), F.col("first")).otherwise(A.local_ink(F.col("blurred"), F.col("sums"), F.col("light"), w, h, F.col("window"), c)))
    everywhere = X.let(F.struct("blurred", "light", "level"), lambda s: P.global_threshold(s["blurred"], s["light"], s["level"]))
    return second.select("vec_id", "block", "window", F.when(2 * X.count_ink(F.col("second")) > w * h, everywhere).otherwise(F.col("second")).alias("ink"))
