"""Pixel stages on tiles: one row per tile, one projection per stage, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numerion.functions import raster as X


def luma(b: Column, g: Column, r: Column) -> Column:
    """Gray of blue, green and red: weights in thousandths, halves up."""
    return F.floor((114 * b + 587 * g + 299 * r + 500) / 1000).cast("long")


def over_white(c: Column, a: Column) -> Column:
    """A channel over white paper, truncated."""
    return F.floor((c * a + 255 * (255 - a)) / 255).cast("long")


def _black(on: Column) -> Column:
    return F.when(on, F.lit(255).cast("long")).otherwise(F.lit(0).cast("long"))


def local_threshold(t: Column, light: Column, c: int, w: int, h: int) -> Column:
    """Ink (255) where a pixel differs from its blurred neighbourhood by over ``c`` on the ink side."""
    pair = lambda b: F.transform(t, lambda v, i: _black(F.when(b["light"], v <= F.get(b["mean"], i) - c).otherwise(v > F.get(b["mean"], i) + c)))
    return X.let(F.struct(X.convolve(t, X.BLUR5, w, h).alias("mean"), light.alias("light")), pair)


def global_threshold(t: Column, light: Column, level: Column) -> Column:
    return F.transform(t, lambda v: _black(F.when(light, v <= level).otherwise(v > level)))


def levelled(tiles: DataFrame, w: int, h: int) -> DataFrame:
    """Adds blurred, level and light."""
    blurred = tiles.withColumn("blurred", X.convolve(F.col("t"), X.BLUR3, w, h)).withColumn("level", X.otsu(F.col("blurred")))
    return blurred.withColumn("light", X.light_background(F.col("blurred"), F.col("level")))


def binarise(tiles: DataFrame, c: int = 3, w: int = 8, h: int = 8) -> DataFrame:
    """Adds blurred, level, light, and ink: the local threshold, or the global one where that finds ink in over half of the tile.

    What pixel lambdas read is bound before them: a column named inside one would be worked out again for each pixel.
    """
    told = levelled(tiles, w, h)
    local = told.withColumn("local_", local_threshold(F.col("blurred"), F.col("light"), c, w, h))
    everywhere = X.let(F.struct("blurred", "light", "level"), lambda s: global_threshold(s["blurred"], s["light"], s["level"]))
    return local.withColumn("ink", F.when(2 * X.count_ink(F.col("local_")) > w * h, everywhere).otherwise(F.col("local_"))).drop("local_")


def line_source(tiles: DataFrame, contrast: int = 25, w: int = 8, h: int = 8) -> DataFrame:
    """Adds paper2 (twice the median gray) and mask: what differs from it by over ``contrast`` on the ink side."""
    told = levelled(tiles, w, h).withColumn("paper2", X.median2(F.col("blurred")))
    far = lambda s: F.transform(s["g"], lambda v: _black(F.when(s["light"], 2 * v < s["paper2"] - 2 * contrast).otherwise(2 * v > s["paper2"] + 2 * contrast)))
    return told.withColumn("mask", X.let(F.struct(F.col("blurred").alias("g"), "light", "paper2"), far))


def soft_ink(tiles: DataFrame, w: int = 8, h: int = 8) -> DataFrame:
    """vec_id, core, soft: how far pixels are from paper, 255 from the core on, 0 off the grown ink.

    The core is the ninth tenth of the ink's depths (20 times it, an integer); paper is the median off the grown ink, or of the
    whole tile where that has under 20 pixels. Where the core is one level or less, the ink itself is taken.
    """
    grown = binarise(tiles, w=w, h=h).withColumn("near", X.dilate(F.col("ink"), X.CROSS3, w, h))
    paper = F.filter("t", lambda v, i: F.get("near", i) == 0)
    told = grown.withColumn("paper2", X.let(paper, lambda x: F.when(F.size(x) >= 20, X.median2(x)).otherwise(X.median2(F.col("t")))))
    depth = lambda s: F.transform(s["t"], lambda v: F.when(s["light"], s["paper2"] - 2 * v).otherwise(2 * v - s["paper2"]))
    deep = told.withColumn("depth", X.let(F.struct("t", "light", "paper2"), depth)).withColumn("core", X.quantile(F.filter("depth", lambda v, i: F.get("ink", i) > 0), 9))
    zero = F.lit(0).cast("long")
    scaled = lambda s: F.transform(s["depth"], lambda v, i: F.when(F.get(s["near"], i) == 0, zero).otherwise(F.floor(255 * F.greatest(zero, F.least(10 * v, s["core"])) / s["core"]).cast("long")))
    soft = F.when(F.coalesce(F.col("core") <= 20, F.lit(True)), F.col("ink")).otherwise(X.let(F.struct("depth", "near", "core"), scaled))
    return deep.select("vec_id", "core", soft.alias("soft"))


def paper_mask(tiles: DataFrame, saturation: int = 90, w: int = 8, h: int = 8) -> DataFrame:
    """vec_id, level, sheet: bright pixels (at Otsu's level of the blurred brightness or over it) with little colour, closed and opened.

    Channels are the arrays ``blue``, ``green``, ``red``; saturation is 255 times the channels' spread over the greatest, rounded.
    """
    three = F.transform(F.arrays_zip("blue", "green", "red"), lambda z: F.array(z["blue"], z["green"], z["red"]))
    cells = F.transform(three, lambda c: F.struct(F.array_max(c).alias("hi"), F.array_min(c).alias("lo")))
    valued = tiles.withColumn("cells", cells).withColumn("value", F.transform("cells", lambda c: c["hi"]))
    bright = valued.withColumn("smooth", X.convolve(F.col("value"), X.BLUR5, w, h)).withColumn("level", X.otsu(F.col("smooth")))
    pale = lambda c: 2 * 255 * (c["hi"] - c["lo"]) < (2 * saturation + 1) * F.greatest(c["hi"], F.lit(1).cast("long"))
    on = X.let(F.struct("cells", "level"), lambda s: F.transform(s["cells"], lambda c: _black((c["hi"] >= s["level"]) & pale(c))))
    closed = bright.withColumn("on_", on).withColumn("closed_", X.closed(F.col("on_"), X.CROSS3, w, h))
    return closed.select("vec_id", "level", X.opened(F.col("closed_"), X.CROSS3, w, h).alias("sheet"))


def components(tiles: DataFrame, mask: str = "ink", w: int = 8, h: int = 8) -> DataFrame:
    """vec_id, comp_id, x, y, w, h, ink: the connected ink of each tile."""
    told = tiles.select("vec_id", X.labelled(F.col(mask), w, h).alias("labels"))
    each = told.select("vec_id", "labels", F.explode(F.filter(F.array_distinct("labels"), lambda v: v > 0)).alias("comp_id"))
    on = F.transform("labels", lambda v: F.when(v == F.col("comp_id"), 1).otherwise(0).cast("long"))
    boxed = each.withColumn("on", on).withColumn("b", X.tight_box(F.col("on"), w, h))
    return boxed.select("vec_id", "comp_id", "b.x", "b.y", "b.w", "b.h", X.total(F.col("on")).alias("ink"))


def without_lines(tiles: DataFrame, mask: str = "ink", length: int = 5, w: int = 8, h: int = 8) -> DataFrame:
    """vec_id, lines, cleaned: long thin runs, and the mask without them, strokes bridged.

    Rows with ink in 60 % of the width count as lines too. The band of a line is one pixel wider above and below; inside it a vertical closing of three rows restores strokes.
    """
    rows = X.row_profile(F.col(mask), w, h)
    found = tiles.withColumn("rows_", rows).withColumn("runs_", X.horizontal_runs(F.col(mask), w, h, length))
    full = lambda i: 10 * F.get("rows_", F.floor(i / w).cast("int")) >= 6 * w
    lines = F.transform("runs_", lambda v, i: F.when((v > 0) | (full(i) & (F.get(F.col(mask), i) > 0)), F.lit(255).cast("long")).otherwise(F.lit(0).cast("long")))
    with_lines = found.withColumn("lines", lines).withColumn("band_", X.dilate(F.col("lines"), ((-1, 0), (0, 0), (1, 0)), w, h))
    bare = with_lines.withColumn("bare_", F.transform(F.col(mask), lambda v, i: F.when(F.get("band_", i) > 0, F.lit(0).cast("long")).otherwise(v)))
    bridged = bare.withColumn("bridged_", X.closed(F.col("bare_"), ((-1, 0), (0, 0), (1, 0)), w, h))
    cleaned = F.transform("bare_", lambda v, i: F.when((F.get("band_", i) > 0) & (F.get("bridged_", i) > 0), F.lit(255).cast("long")).otherwise(v))
    return bridged.select("vec_id", "lines", cleaned.alias("cleaned"))


def normal_placement(tiles: DataFrame, mask: str = "ink", fit: int = 20, out: int = 28, w: int = 8, h: int = 8) -> DataFrame:
    """vec_id, width, height, left, top: where the tight ink goes in the classifier's field: fitted into ``fit``, centred in ``out``; nulls without ink."""
    boxed = tiles.select("vec_id", X.tight_box(F.col(mask), w, h).alias("b"))
    longest = F.greatest("b.w", "b.h")
    size = lambda v: F.when(v.isNotNull(), F.greatest(F.lit(1), F.rint(v * (F.lit(float(fit)) / longest)).cast("long")))
    sized = boxed.select("vec_id", size(F.col("b.w")).alias("width"), size(F.col("b.h")).alias("height"))
    return sized.withColumn("left", F.floor((out - F.col("width")) / 2).cast("long")).withColumn("top", F.floor((out - F.col("height")) / 2).cast("long"))


def convolution_layer(tiles: DataFrame, kernels: tuple[tuple[int, ...], ...], w: int = 8, h: int = 8) -> DataFrame:
    """vec_id, features: integer 3 x 3 kernels, rectified, then the greatest of each 2 x 2 block; all kernels in a row."""

    def plane(kernel: tuple[int, ...]) -> Column:
        def one(i: Column) -> Column:
            acc = F.lit(0).cast("long")
            for (dr, dc), k in zip(X.SQUARE3, kernel, strict=True):
                acc = acc + k * X.inside(F.col("t"), i, dr, dc, w, h, 0)
            return F.greatest(F.lit(0).cast("long"), acc)

        blocks = F.sequence(F.lit(0), F.lit((w // 2) * (h // 2) - 1))
        corner = lambda b: F.floor(b / (w // 2)).cast("int") * 2 * w + (b % (w // 2)) * 2
        return X.let(F.transform(X.pixels(w, h), one), lambda f: F.transform(blocks, lambda b: F.greatest(*(F.get(f, corner(b) + d) for d in (0, 1, w, w + 1)))))

    return tiles.select("vec_id", "label", F.concat(*(plane(k) for k in kernels)).alias("features"))
