"""Small rasters as array columns, row by row; no pixel is ever exploded into a row.

Borders mirror without repeating the edge pixel (reflect 101) unless a
function says otherwise. Kernels are integer tables; results stay integers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Tap = tuple[int, int, int]

#: Binomial kernels (row, column, weight), sums 16 and 256.
BLUR3: tuple[Tap, ...] = tuple((r - 1, c - 1, a * b) for r, a in enumerate((1, 2, 1)) for c, b in enumerate((1, 2, 1)))
BLUR5: tuple[Tap, ...] = tuple((r - 2, c - 2, a * b) for r, a in enumerate((1, 4, 6, 4, 1)) for c, b in enumerate((1, 4, 6, 4, 1)))
#: Structuring elements.
SQUARE3 = tuple((r, c) for r in (-1, 0, 1) for c in (-1, 0, 1))
CROSS3 = ((-1, 0), (0, -1), (0, 0), (0, 1), (1, 0))


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _mirror(k: Column, size: int) -> Column:
    k = F.abs(k)
    return F.when(k > size - 1, 2 * (size - 1) - k).otherwise(k)


def pixels(w: int, h: int) -> Column:
    return F.sequence(F.lit(0), F.lit(w * h - 1))


def at(t: Column, i: Column, dr: int, dc: int, w: int, h: int) -> Column:
    """The pixel ``dr`` rows and ``dc`` columns from pixel ``i``, mirrored at borders."""
    r, c = F.floor(i / w).cast("int"), i % w
    return F.get(t, _mirror(r + dr, h) * w + _mirror(c + dc, w))


def inside(t: Column, i: Column, dr: int, dc: int, w: int, h: int, outside: int) -> Column:
    """As ``at``, with a constant outside the raster."""
    r, c = F.floor(i / w).cast("int") + dr, i % w + dc
    return F.when((r < 0) | (r >= h) | (c < 0) | (c >= w), F.lit(outside).cast("long")).otherwise(F.get(t, r * w + c))


def convolve(t: Column, taps: tuple[Tap, ...], w: int, h: int) -> Column:
    """Weighted sums divided by the kernel's sum, halves up."""
    total = sum(k for _, _, k in taps)

    def one(i: Column) -> Column:
        acc = F.lit(total // 2).cast("long")
        for dr, dc, k in taps:
            acc = acc + k * at(t, i, dr, dc, w, h)
        return F.floor(acc / total).cast("long")

    return F.transform(pixels(w, h), one)


def _morph(t: Column, element: tuple, w: int, h: int, pick, outside: int) -> Column:
    return F.transform(pixels(w, h), lambda i: pick(*(inside(t, i, dr, dc, w, h, outside) for dr, dc in element)) if len(element) > 1 else inside(t, i, *element[0], w, h, outside))


def dilate(t: Column, element: tuple, w: int, h: int) -> Column:
    return _morph(t, element, w, h, F.greatest, 0)


def erode(t: Column, element: tuple, w: int, h: int) -> Column:
    """What lies outside doesn't erode."""
    return _morph(t, element, w, h, F.least, 255)


def opened(t: Column, element: tuple, w: int, h: int) -> Column:
    return let(erode(t, element, w, h), lambda e: dilate(e, element, w, h))


def closed(t: Column, element: tuple, w: int, h: int) -> Column:
    return let(dilate(t, element, w, h), lambda d: erode(d, element, w, h))


def otsu(t: Column) -> Column:
    """The gray level that separates two classes best; levels over it are bright. The lowest of equal ones.

    Only levels that occur can be best. Between-class variance is compared as (S n0 - s0 N)^2 / (n0 n1).
    """
    levels = F.array_sort(F.array_distinct(t))
    whole = F.aggregate(t, F.lit(0).cast("long"), lambda a, x: a + x)

    def score(v: Column) -> Column:
        low = F.filter(t, lambda x: x <= v)
        n0, s0 = F.size(low).cast("long"), F.aggregate(low, F.lit(0).cast("long"), lambda a, x: a + x)
        n1 = F.size(t) - n0
        gap = whole * n0 - s0 * F.size(t)
        return F.when(n1 > 0, (gap * gap).cast("double") / (n0 * n1)).otherwise(-1.0)

    return F.aggregate(
        levels,
        F.struct(F.lit(-2.0).alias("s"), F.lit(0).cast("long").alias("v")),
        lambda a, v: let(score(v), lambda s: F.when(s > a["s"], F.struct(s.alias("s"), v.alias("v"))).otherwise(a)),
        lambda a: a["v"],
    )


def light_background(t: Column, threshold: Column) -> Column:
    """Whether at least half of the pixels are brighter than the threshold."""
    return let(threshold, lambda level: 2 * F.size(F.filter(t, lambda x: x > level)) >= F.size(t))


def median2(t: Column) -> Column:
    """Twice the median, an integer."""
    s = F.array_sort(t)
    n = F.size(t)
    return let(s, lambda o: F.get(o, F.floor((n - 1) / 2).cast("int")) + F.get(o, F.floor(n / 2).cast("int")))


def quantile(t: Column, tenths: int) -> Column:
    """Ten times the value that ``tenths`` of ten values lie under, by linear interpolation between neighbours; an integer."""

    def between(o: Column) -> Column:
        place = tenths * (F.size(o) - 1)
        low = F.floor(place / 10).cast("int")
        return 10 * F.get(o, low) + (place % 10) * (F.get(o, F.least(low + 1, F.size(o) - 1)) - F.get(o, low))

    return F.when(F.size(t) > 0, let(F.array_sort(t), between)).cast("long")


def total(t: Column) -> Column:
    return F.aggregate(t, F.lit(0).cast("long"), lambda a, x: a + x)


def count_ink(t: Column) -> Column:
    return F.size(F.filter(t, lambda x: x > 0)).cast("long")


def column_profile(t: Column, w: int, h: int) -> Column:
    """Ink pixels of each column."""
    return F.transform(F.sequence(F.lit(0), F.lit(w - 1)), lambda c: F.size(F.filter(F.sequence(F.lit(0), F.lit(h - 1)), lambda r: F.get(t, r * w + c) > 0)).cast("long"))


def row_profile(t: Column, w: int, h: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda r: F.size(F.filter(F.slice(t, r * w + 1, w), lambda v: v > 0)).cast("long"))


def tight_box(t: Column, w: int, h: int) -> Column:
    """(x, y, w, h) of the ink; null without ink."""
    on = F.filter(pixels(w, h), lambda i: F.get(t, i) > 0)
    xs, ys = F.transform(on, lambda i: i % w), F.transform(on, lambda i: F.floor(i / w).cast("int"))
    lo_x, lo_y = F.array_min(xs), F.array_min(ys)
    return F.when(F.size(on) > 0, F.struct(lo_x.cast("long").alias("x"), lo_y.cast("long").alias("y"), (F.array_max(xs) - lo_x + 1).cast("long").alias("w"), (F.array_max(ys) - lo_y + 1).cast("long").alias("h")))


def moments(t: Column, w: int, h: int) -> Column:
    """m00, m10, m01: mass, and mass times column and row."""
    weighed = lambda f: F.aggregate(pixels(w, h), F.lit(0).cast("long"), lambda a, i: a + F.get(t, i) * f(i))
    return F.struct(total(t).alias("m00"), weighed(lambda i: i % w).alias("m10"), weighed(lambda i: F.floor(i / w).cast("long")).alias("m01"))


def labelled(t: Column, w: int, h: int) -> Column:
    """The 8-connected component of each ink pixel: its least pixel number + 1; 0 for paper.

    A label travels one pixel a round, and rounds end where none has moved; no path in the raster is longer than half of it.
    """
    start = F.transform(t, lambda v, i: F.when(v > 0, (i + 1).cast("long")).otherwise(F.lit(0).cast("long")))
    big = w * h + 1

    def moved(labels: Column) -> Column:
        def one(v: Column, i: Column) -> Column:
            near = [inside(labels, i, dr, dc, w, h, 0) for dr, dc in SQUARE3]
            return F.when(v > 0, F.least(*(F.when(n > 0, n).otherwise(big) for n in near))).otherwise(v)

        return F.transform(labels, one)

    def round_(state: Column, _: Column) -> Column:
        after = lambda new: F.struct(new.alias("labels"), (new == state["labels"]).alias("still"))
        return F.when(state["still"], state).otherwise(let(moved(state["labels"]), after))

    first = F.struct(start.alias("labels"), F.lit(False).alias("still"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(w * h // 2)), first, round_, lambda state: state["labels"])


def horizontal_runs(t: Column, w: int, h: int, length: int) -> Column:
    """Ink that lies in a horizontal run of at least ``length``: an opening by a flat bar."""
    starts = lambda i: [F.when((i % w + k >= 0) & (i % w + k + length <= w), F.least(*(F.get(t, F.greatest(F.lit(0), i + k + j)) for j in range(length)))).otherwise(0) for k in range(1 - length, 1)]
    return F.transform(pixels(w, h), lambda i: F.when(F.greatest(*starts(i)) > 0, F.lit(255).cast("long")).otherwise(F.lit(0).cast("long")))


def chamfer(t: Column, w: int, h: int) -> Column:
    """Distance of each ink pixel to the nearest paper pixel (outside counts as paper) in chamfer units: 3 straight, 4 diagonal."""
    far = 3 * (w + h)
    start = F.transform(t, lambda v: F.when(v > 0, F.lit(far).cast("long")).otherwise(F.lit(0).cast("long")))

    def round_(d: Column, _: Column) -> Column:
        return F.transform(pixels(w, h), lambda i: F.least(*(inside(d, i, dr, dc, w, h, 0) + (0 if (dr, dc) == (0, 0) else 3 if 0 in (dr, dc) else 4) for dr, dc in SQUARE3)))

    return F.aggregate(F.sequence(F.lit(1), F.lit((min(w, h) + 1) // 2)), start, round_)
