"""Scalar geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column) -> Column:
    """Rounded to the nearest integer, halves to even."""
    return F.rint(value).cast("long")


def truncated(value: Column) -> Column:
    """Towards zero."""
    return value.cast("long")


def rescale(value: Column, scale: Column) -> Column:
    """A working-resolution coordinate in the original image: times the inverse of the scale."""
    return half_even(value * (F.lit(1.0) / scale))


def working_scale(height: Column, width: Column, max_side: int) -> Column:
    longest = F.greatest(height, width)
    return F.when((F.lit(max_side) <= 0) | (longest <= max_side), F.lit(1.0)).otherwise(F.lit(float(max_side)) / longest)


def auto_block(height: Column, width: Column) -> Column:
    """The odd window of the local threshold: an eighth of the shorter side, at least 31."""
    block = F.greatest(F.lit(31), F.floor(F.least(height, width) / 8)).cast("long")
    return block + (1 - block % 2)


def window_rect(height: Column, width: Column, share: Column) -> Column:
    """x, y, w, h of a centred part of a frame; the share is held within 0.2 and 1."""
    f = F.least(F.lit(1.0), F.greatest(F.lit(0.2), share))
    w, h = truncated(width * f), truncated(height * f)
    return F.struct(F.floor((width - w) / 2).cast("long").alias("x"), F.floor((height - h) / 2).cast("long").alias("y"), w.alias("w"), h.alias("h"))


def ordered_corners(points: Column) -> Column:
    """Top left, top right, bottom right, bottom left of four (x, y) structs; first wins ties."""
    first = lambda key: F.array_min(F.transform(points, lambda p, i: F.struct(key(p).alias("k"), i.alias("i"), p.alias("p"))))["p"]
    return F.array(
        first(lambda p: p["x"] + p["y"]), first(lambda p: p["y"] - p["x"]), first(lambda p: -(p["x"] + p["y"])), first(lambda p: p["x"] - p["y"])
    )


def project(m: list[Column] | list[float], x: Column, y: Column) -> tuple[Column, Column]:
    """A point under a 3 x 3 matrix, row by row; nulls at infinity."""
    m = [v if isinstance(v, Column) else F.lit(float(v)) for v in m]
    z = F.nullif(m[6] * x + m[7] * y + m[8], F.lit(0.0))
    return (m[0] * x + m[1] * y + m[2]) / z, (m[3] * x + m[4] * y + m[5]) / z


def mapped_box(m: list, x: Column, y: Column, w: Column, h: Column) -> Column:
    """The box around the projected corners of a box, rounded."""
    corners = [project(m, a, b) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    x0, y0 = half_even(F.least(*xs)), half_even(F.least(*ys))
    return F.struct(x0.alias("x"), y0.alias("y"), (half_even(F.greatest(*xs)) - x0).alias("w"), (half_even(F.greatest(*ys)) - y0).alias("h"))


def _adjugate(m: list[Column]) -> list[Column]:
    a, b, c, d, e, f, g, h, i = m
    return [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]


def _product(m: list[Column], n: list[Column]) -> list[Column]:
    return [m[3 * r] * n[c] + m[3 * r + 1] * n[3 + c] + m[3 * r + 2] * n[6 + c] for r in range(3) for c in range(3)]


def _basis(points: Column) -> tuple[list[Column], list[Column]]:
    """The matrix that takes the unit points of the plane to four points, and the weights of its columns: 0 where three points are on a line."""
    at = [F.get(points, F.lit(k)) for k in range(4)]
    x, y = ([p[n].cast("double") for p in at] for n in "xy")
    three = [x[0], x[1], x[2], y[0], y[1], y[2], *(F.lit(1.0) for _ in range(3))]
    n = _adjugate(three)
    weights = [n[3 * k] * x[3] + n[3 * k + 1] * y[3] + n[3 * k + 2] for k in range(3)]
    whole = n[0] * three[0] + n[1] * three[3] + n[2] * three[6]
    return [three[3 * r + c] * weights[c] for r in range(3) for c in range(3)], [*weights, whole]


def _bound(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def projective(source: Column, target: Column) -> Column:
    """The 3 x 3 matrix, as an array, that takes four (x, y) points to four others; null where three of either are on a line.

    Both quads are images of the unit points, so the matrix is one basis times the adjugate of the other. No
    division is made: small integers give an exact matrix, up to its scale.
    """
    one, more = _basis(source)
    two, again = _basis(target)
    told = F.struct(*(v.alias(f"s{k}") for k, v in enumerate(one)), *(v.alias(f"t{k}") for k, v in enumerate(two)), F.array(*more, *again).alias("w"))

    def whole(b: Column) -> Column:
        matrix = _product([b[f"t{k}"] for k in range(9)], _adjugate([b[f"s{k}"] for k in range(9)]))
        return F.when(~F.exists(b["w"], lambda v: v == 0), F.array(*matrix))

    return F.when((F.size(source) == 4) & (F.size(target) == 4), _bound(told, whole))


def inverse(matrix: Column) -> Column:
    """The matrix that leads back, up to its scale; null for null."""
    return F.when(matrix.isNotNull(), F.array(*_adjugate([F.get(matrix, F.lit(k)) for k in range(9)])))


def entries(matrix: Column) -> list[Column]:
    """The nine numbers of a matrix held as an array, for ``project`` and ``mapped_box``."""
    return [F.get(matrix, F.lit(k)) for k in range(9)]


def rectangle(width: Column | float, height: Column | float) -> Column:
    """The corners of an upright rectangle at the origin, in the order of ``ordered_corners``."""
    w, h = (v if isinstance(v, Column) else F.lit(float(v)) for v in (width, height))
    zero = F.lit(0.0)
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(zero, zero), corner(w, zero), corner(w, h), corner(zero, h))
