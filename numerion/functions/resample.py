"""Rasters laid out anew: warped by a matrix, resized by areas, placed in a field; sizes and matrices may differ from row to row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from numerion.functions.geometry import entries, project
from numerion.functions.raster import let


def _int(v: Column | int) -> Column:
    return (v if isinstance(v, Column) else F.lit(v)).cast("int")


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def warped(t: Column, w: Column | int, h: Column | int, matrix: Column, out_w: Column | int, out_h: Column | int, nearest: bool = False) -> Column:
    """A raster seen through ``matrix``, which leads from places of the result to places of ``t``.

    Each pixel of the result weighs the four around its place, halves up, or takes the nearest one. Places outside
    take the edge's pixels; null without a matrix.
    """
    given = F.struct(t.alias("t"), _int(w).alias("w"), _int(h).alias("h"), matrix.alias("m"), _int(out_w).alias("ow"), _int(out_h).alias("oh"))

    def each(g: Column) -> Column:
        m = entries(g["m"])
        at = lambda r, c: F.get(g["t"], (r * g["w"] + c).cast("int"))
        held = lambda v, n: F.greatest(F.lit(0.0), F.least(v, (n - 1).cast("double")))

        def weighed(p: Column) -> Column:
            if nearest:
                return at(F.rint(p["y"]).cast("int"), F.rint(p["x"]).cast("int"))
            c, r = F.floor(p["x"]).cast("int"), F.floor(p["y"]).cast("int")
            c1, r1 = F.least(c + 1, g["w"] - 1), F.least(r + 1, g["h"] - 1)
            fx, fy = p["x"] - c, p["y"] - r
            one = F.lit(1.0)
            return F.floor((one - fx) * (one - fy) * at(r, c) + fx * (one - fy) * at(r, c1) + (one - fx) * fy * at(r1, c) + fx * fy * at(r1, c1) + 0.5).cast("long")

        def pixel(i: Column) -> Column:
            x, y = project(m, (i % g["ow"]).cast("double"), F.floor(i / g["ow"]).cast("double"))
            return let(F.struct(held(x, g["w"]).alias("x"), held(y, g["h"]).alias("y")), weighed)

        return F.transform(_upto(g["ow"] * g["oh"]), pixel)

    return F.when(matrix.isNotNull(), let(given, each))


def _taps(size: Column, to: Column, smaller: Column) -> Column:
    """For each of ``to`` places the pixels (i) out of ``size`` that it is made of and their integer weights (k).

    Smaller: the lengths, in ``1/to``, by which place and pixel overlap; they add up to ``size``. Larger: the two
    pixels around the place's middle by nearness, in ``1/(2 to)``; the edge's pixel stands for those outside.
    """

    def overlapping(j: Column) -> Column:
        first, last = F.floor(j * size / to).cast("int"), F.floor(((j + 1) * size - 1) / to).cast("int")
        return F.transform(F.sequence(first, last), lambda i: F.struct(i.alias("i"), (F.least((i + 1) * to, (j + 1) * size) - F.greatest(i * to, j * size)).cast("long").alias("k")))

    def between(j: Column) -> Column:
        place = (2 * j + 1) * size - to
        low = F.floor(place / (2 * to)).cast("int")
        part = place - low * 2 * to
        inside = lambda i: F.greatest(F.lit(0), F.least(i, size - 1))
        return F.array(F.struct(inside(low).alias("i"), (2 * to - part).cast("long").alias("k")), F.struct(inside(low + 1).alias("i"), part.cast("long").alias("k")))

    return F.when(smaller, F.transform(_upto(to), overlapping)).otherwise(F.transform(_upto(to), between))


def resized(t: Column, w: Column | int, h: Column | int, to_w: Column | int, to_h: Column | int, smaller: Column) -> Column:
    """A raster of another size, one axis after the other in integers, rounded once, halves up.

    ``smaller``: each pixel is the mean of the area it covers; else it lies between its neighbours.
    """
    sized = F.struct(t.alias("t"), *(_int(v).alias(n) for n, v in (("w", w), ("h", h), ("tw", to_w), ("th", to_h))), smaller.alias("smaller"))
    zero = F.lit(0).cast("long")

    def weighed(s: Column) -> Column:
        whole = F.when(s["smaller"], s["w"] * s["h"]).otherwise(4 * s["tw"] * s["th"]).cast("long")
        return F.struct(s["t"].alias("t"), s["w"].alias("w"), s["h"].alias("h"), s["tw"].alias("tw"), _taps(s["w"], s["tw"], s["smaller"]).alias("across"), _taps(s["h"], s["th"], s["smaller"]).alias("down"), whole.alias("whole"))

    def each(g: Column) -> Column:
        rows = F.transform(_upto(g["h"]), lambda r: F.transform(g["across"], lambda taps: F.aggregate(taps, zero, lambda a, x: a + x["k"] * F.get(g["t"], r * g["w"] + x["i"]))))

        def joined(mid: Column) -> Column:
            line = lambda taps: F.transform(_upto(g["tw"]), lambda c: F.aggregate(taps, zero, lambda a, x: a + x["k"] * F.get(F.get(mid, x["i"]), c)))
            return F.flatten(F.transform(g["down"], line))

        return F.transform(let(rows, joined), lambda v: F.floor((2 * v + g["whole"]) / (2 * g["whole"])).cast("long"))

    return let(let(sized, weighed), each)


def cropped(t: Column, w: Column | int, box: Column) -> Column:
    """The pixels of a box (x, y, w, h) of a raster ``w`` wide."""
    return let(F.struct(t.alias("t"), _int(w).alias("w"), box.alias("b")), lambda g: F.flatten(F.transform(_upto(g["b"]["h"].cast("int")), lambda r: F.slice(g["t"], ((g["b"]["y"] + r) * g["w"] + g["b"]["x"] + 1).cast("int"), g["b"]["w"].cast("int")))))


def in_field(t: Column, w: Column, h: Column, out: int) -> Column:
    """dx, dy, v: a raster in the middle of an ``out`` x ``out`` field, moved by whole pixels until its centre of mass is there.

    It is never moved over the field's edge. Nulls for a raster without mass.
    """
    w, h = _int(w), _int(h)
    left, top = F.floor((out - w) / 2).cast("int"), F.floor((out - h) / 2).cast("int")
    given = F.struct(t.alias("t"), w.alias("w"), h.alias("h"), left.alias("x"), top.alias("y"))

    def each(g: Column) -> Column:
        places = F.transform(F.filter(F.transform(g["t"], lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda p: p["v"] > 0), lambda p: F.struct(p["v"].alias("v"), (g["x"] + p["i"] % g["w"]).alias("c"), (g["y"] + F.floor(p["i"] / g["w"])).cast("int").alias("r")))
        weigh = lambda ps, f: F.aggregate(ps, F.lit(0).cast("long"), lambda a, p: a + p["v"] * f(p))

        def told(ps: Column) -> Column:
            mass = F.aggregate(ps, F.lit(0).cast("long"), lambda a, p: a + p["v"])

            def shift(axis: str) -> Column:
                wanted = F.rint((out - 1) / 2.0 - weigh(ps, lambda p: p[axis]) / mass).cast("int")
                ends = F.transform(ps, lambda p: p[axis])
                return F.greatest(-F.array_min(ends), F.least(wanted, out - 1 - F.array_max(ends)))

            moved = F.struct(shift("c").alias("dx"), shift("r").alias("dy"))

            def laid(d: Column) -> Column:
                def pixel(i: Column) -> Column:
                    c, r = i % out - g["x"] - d["dx"], F.floor(i / out).cast("int") - g["y"] - d["dy"]
                    return F.when((c >= 0) & (c < g["w"]) & (r >= 0) & (r < g["h"]), F.get(g["t"], r * g["w"] + c)).otherwise(F.lit(0).cast("long"))

                return F.struct(d["dx"].cast("long").alias("dx"), d["dy"].cast("long").alias("dy"), F.transform(F.sequence(F.lit(0), F.lit(out * out - 1)), pixel).alias("v"))

            return F.when(F.size(ps) > 0, let(moved, laid))

        return let(places, told)

    return let(given, each)


def distances(t: Column, w: int, h: int, pad: int, paper: bool = False) -> Column:
    """The squared distance of each pixel to the nearest ink, or to the nearest ``paper``; ``pad`` rows and columns of paper are added on each side.

    Down each column the nearest row is found first; along a row, the least of ``(c - c')^2 + g(c')^2`` is then the
    exact distance. Null where there is none. Which pixels a disc of any radius reaches is one comparison.
    """
    wide, high = w + 2 * pad, h + 2 * pad
    inner = lambda r, c: F.when((r >= pad) & (r < h + pad) & (c >= pad) & (c < w + pad), F.get(t, (r - pad) * w + c - pad)).otherwise(F.lit(0).cast("long"))
    hit = lambda r, c: inner(r, c) <= 0 if paper else inner(r, c) > 0
    rows, columns = F.sequence(F.lit(0), F.lit(high - 1)), F.sequence(F.lit(0), F.lit(wide - 1))
    held = F.transform(columns, lambda c: F.filter(rows, lambda r: hit(r, c)))
    down = let(held, lambda hs: F.transform(rows, lambda r: F.transform(hs, lambda own: F.array_min(F.transform(own, lambda q: F.abs(q - r))))))
    along = lambda line: F.transform(columns, lambda c: F.array_min(F.transform(line, lambda g, k: (g * g + (c - k) * (c - k)).cast("long"))))
    return F.flatten(F.transform(down, along))
