"""Summed areas of rasters held as arrays, and what any window of a raster follows from: four look-ups.

Width, height and window may differ from row to row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from numerion.functions.raster import let


def _int(v: Column | int) -> Column:
    return (v if isinstance(v, Column) else F.lit(v)).cast("int")


def summed(t: Column, w: Column | int, h: Column | int) -> Column:
    """(h + 1) x (w + 1) sums, row by row: entry (r, c) is the sum of all pixels above row r and left of column c.

    A row's running sums are added to the row of sums above it.
    """
    w, h = _int(w), _int(h)
    running = lambda row: F.aggregate(row, F.array(F.lit(0).cast("long")), lambda a, v: F.array_append(a, F.element_at(a, -1) + v))
    none = F.array_repeat(F.lit(0).cast("long"), w + 1)

    def under(state: Column, r: Column) -> Column:
        added = F.zip_with(running(F.slice(t, r * w + 1, w)), F.element_at(state, -1), lambda a, b: a + b)
        return F.array_append(state, added)

    rows = F.when(h > 0, F.sequence(F.lit(0), h - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.aggregate(rows, F.array(none), under))


def area_sum(sums: Column, w: Column, r0: Column, c0: Column, r1: Column, c1: Column) -> Column:
    """The sum of the pixels of rows r0 to r1 and columns c0 to c1, both ends without the last."""
    at = lambda r, c: F.get(sums, (r * (w + 1) + c).cast("int"))
    return at(r1, c1) - at(r0, c1) - at(r1, c0) + at(r0, c0)


def windowed(pixels: Column, sums: Column, w: Column | int, h: Column | int, block: Column, body) -> Column:
    """``body(value, sum, size)`` of each pixel, with sum and size of its ``block`` x ``block`` window, cut at the edges."""
    half = F.floor(block / 2).cast("int")
    given = F.struct(pixels.alias("t"), sums.alias("s"), _int(w).alias("w"), _int(h).alias("h"), half.alias("k"))

    def each(g: Column) -> Column:
        def one(v: Column, i: Column) -> Column:
            r, c = F.floor(i / g["w"]).cast("int"), i % g["w"]
            zero = F.lit(0)
            r0, r1 = F.greatest(zero, r - g["k"]), F.least(g["h"], r + g["k"] + 1)
            c0, c1 = F.greatest(zero, c - g["k"]), F.least(g["w"], c + g["k"] + 1)
            return body(v, area_sum(g["s"], g["w"], r0, c0, r1, c1), ((r1 - r0) * (c1 - c0)).cast("long"))

        return F.transform(g["t"], one)

    return let(given, each)


def local_ink(pixels: Column, sums: Column, light: Column, w: Column | int, h: Column | int, block: Column, c: int) -> Column:
    """Ink (255) where a pixel is over ``c`` from its window's mean, on the ink side; exact, without a division."""
    black = lambda on: F.when(on, F.lit(255).cast("long")).otherwise(F.lit(0).cast("long"))
    dark = lambda v, s, n: black(v * n <= s - c * n)
    bright = lambda v, s, n: black(v * n > s + c * n)
    return F.when(light, windowed(pixels, sums, w, h, block, dark)).otherwise(windowed(pixels, sums, w, h, block, bright))
