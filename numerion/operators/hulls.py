"""Convex hulls of points per image, and the least rectangle around each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numerion.functions.raster import let

#: Points that are folded at once.
BUCKET = 1 << 14
#: Coordinates from which on products of three points' differences may leave 64 bits.
FAR = 1 << 30


def _turn(o: Column, a: Column, b: Column) -> Column:
    """Over 0 where o, a, b turn towards rising y on the way along rising x."""
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def chain(points: Column) -> Column:
    """The lower chain of sorted points (x, y), ends included, without points on its edges.

    The chain so far is convex, so what a new point takes off it is its end: the longest beginning whose last
    turn towards the point is a true one stays.
    """

    def step(kept: Column, q: Column) -> Column:
        good = F.filter(F.sequence(F.lit(1), F.size(kept)), lambda k: (k == 1) | (_turn(F.get(kept, k - 2), F.get(kept, k - 1), q) > 0))
        return F.array_append(F.slice(kept, 1, F.array_max(good)), q)

    return F.when(F.size(points) > 1, F.aggregate(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1), step)).otherwise(points)


def hull(points: Column) -> Column:
    """The hull's corners from the least (x, y) on, along the side of small y first; one or two points where there are no more."""
    ordered = F.array_sort(F.array_distinct(points))

    def both(p: Column) -> Column:
        lower, upper = chain(p), chain(F.reverse(p))
        return F.when(F.size(p) < 3, p).otherwise(F.concat(F.slice(lower, 1, F.size(lower) - 1), F.slice(upper, 1, F.size(upper) - 1)))

    return let(ordered, both)


def _lower(g: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The places of the lower chain's points, of points sorted along each group's chain.

    A point that doesn't turn the way from the one before to the one behind is no corner, whatever else there is: all such points go at once, until none is left.
    """
    at = np.arange(len(g))
    while len(at) > 2:
        o, p, q = at[:-2], at[1:-1], at[2:]
        gone = (g[o] == g[q]) & ((x[p] - x[o]) * (y[q] - y[o]) <= (y[p] - y[o]) * (x[q] - x[o]))
        if not gone.any():
            break
        at = at[np.concatenate([[True], ~gone, [True]])]
    return at


def corners(g: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """g, x, y of the corners of each group's hull, group by group, each in the order of ``hull``."""
    if len(g) and max(x.max(), -x.min(), y.max(), -y.min()) >= FAR:
        raise OverflowError("points too far out for exact hulls")
    order = np.lexsort((y, x, g))
    g, x, y = g[order], x[order], y[order]
    new = np.append(True, (np.diff(g) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0))[: len(g)]
    g, x, y = g[new], x[new], y[new]
    chains = []
    for way in (np.arange(len(g)), np.arange(len(g))[::-1]):
        kept = way[_lower(g[way], x[way], y[way])]
        # The end of a chain is the other one's beginning.
        chains.append(kept[np.append(g[kept[1:]] == g[kept[:-1]], False)[: len(kept)]])
    alone = np.flatnonzero(np.append(True, np.diff(g) != 0)[: len(g)] & np.append(np.diff(g) != 0, True)[: len(g)])
    both = np.concatenate([*chains, alone])
    both = both[np.argsort(g[both], kind="stable")]
    return g[both], x[both], y[both]


def _named(ids: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each image, in order of appearance, and the images by number."""
    coded = ids.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _listed(g: np.ndarray, x: np.ndarray, y: np.ndarray, images: pa.Array) -> pa.RecordBatch:
    """A row of image_id and hull for each group."""
    begin = np.flatnonzero(np.append(True, np.diff(g) != 0)[: len(g)])
    points = pa.StructArray.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(g)).astype(np.int32)), points)
    return pa.RecordBatch.from_arrays([images.take(pa.array(g[begin])), lists], names=["image_id", "hull"])


def hulls(points: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """image_id, hull (array of x, y; longs) of ``points`` (image_id, x, y); points without x or y are none.

    Points are folded to the corners of their hulls where they lie, ``bucket`` at a time. Where an image's corners meet, columns are reduced
    to their ends and folded again in order of images: no task holds more than the columns of a bucket and the corners of one image so far.
    """
    kind = points.schema["image_id"].dataType.simpleString()

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, bucket):
                part = whole.slice(at, bucket)
                g, images = _named(part.column(0))
                g, x, y = corners(g, *(part.column(k).to_numpy() for k in (1, 2)))
                yield pa.RecordBatch.from_arrays([images.take(pa.array(g)), pa.array(x), pa.array(y)], names=["image_id", "x", "y"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, open_ = None, np.zeros((2, 0), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, bucket):
                part = whole.slice(at, bucket)
                x, lo, hi = (part.column(k).to_numpy() for k in (1, 2, 3))
                g, images = _named(pa.concat_arrays([*([] if ids is None else [ids]), part.column(0), part.column(0)]))
                g, x, y = corners(g, np.concatenate([open_[0], x, x]), np.concatenate([open_[1], lo, hi]))
                # The last image, which was named last, may go on.
                done = np.searchsorted(g, g[-1])
                if done:
                    yield _listed(g[:done], x[:done], y[:done], images)
                ids, open_ = images.take(pa.array(g[done:])), np.stack([x[done:], y[done:]])
        if ids is not None:
            yield _listed(np.zeros(len(ids), np.int64), *open_, ids[:1])

    rows = points.select("image_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    dealt = rows.mapInArrow(folded, f"image_id {kind}, x long, y long").repartition("image_id")
    ends = dealt.groupBy("image_id", "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    return ends.sortWithinPartitions("image_id").mapInArrow(met, f"image_id {kind}, hull array<struct<x:bigint,y:bigint>>")


def edges(hull: Column) -> Column:
    """a, b of each edge, the closing one included; a single point is an edge of itself."""
    return F.transform(hull, lambda p, i: F.struct(p.alias("a"), F.get(hull, (i + 1) % F.size(hull)).alias("b")))


def least_rectangle(hull: Column) -> Column:
    """area, a, b (the edge it lies on), along, across (its sides) and corners of the least rectangle around a hull; null for a point or a line.

    Along an edge d, points lie between extremes of u = p.d and v = p x d; integers, divided by the edge's length in the end.
    """

    def around(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        u, v = F.transform(hull, lambda p: p["x"] * dx + p["y"] * dy), F.transform(hull, lambda p: p["y"] * dx - p["x"] * dy)
        ends = F.struct(F.array_min(u).alias("u0"), F.array_max(u).alias("u1"), F.array_min(v).alias("v0"), F.array_max(v).alias("v1"), dx.alias("dx"), dy.alias("dy"), (dx * dx + dy * dy).alias("l"))

        def sized(m: Column) -> Column:
            corner = lambda s, t: F.struct(((s * m["dx"] - t * m["dy"]) / m["l"]).alias("x"), ((s * m["dy"] + t * m["dx"]) / m["l"]).alias("y"))
            along, across = m["u1"] - m["u0"], m["v1"] - m["v0"]
            root = F.sqrt(m["l"].cast("double"))
            corners = F.array(corner(m["u0"], m["v0"]), corner(m["u1"], m["v0"]), corner(m["u1"], m["v1"]), corner(m["u0"], m["v1"]))
            return F.struct(((along * across) / m["l"]).alias("area"), e["a"].alias("a"), e["b"].alias("b"), (along / root).alias("along"), (across / root).alias("across"), corners.alias("corners"))

        return let(ends, sized)

    return F.when(F.size(hull) > 2, F.array_min(F.transform(edges(hull), around)))


RECTANGLE = ("area", "ax", "ay", "along", "across", *(f"{c}{k}" for k in range(4) for c in "xy"))


def _least(starts: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """The columns of RECTANGLE for hulls of over two corners, which lie one after the other from ``starts`` on."""
    g = np.repeat(np.arange(len(sizes)), sizes)
    at, size = np.arange(len(g)) - starts[g], sizes[g]
    ahead = lambda k: starts[g] + (at + k) % size
    bx, by = x[ahead(1)], y[ahead(1)]
    dx, dy = bx - x, by - y
    u0, v0 = x * dx + y * dy, y * dx - x * dy
    u1, v1 = u0.copy(), v0.copy()
    for k in range(1, int(sizes.max(initial=0))):
        p = ahead(k)
        u, v = x[p] * dx + y[p] * dy, y[p] * dx - x[p] * dy
        u0, u1, v0, v1 = np.minimum(u0, u), np.maximum(u1, u), np.minimum(v0, v), np.maximum(v1, v)
    along, across, length = u1 - u0, v1 - v0, dx * dx + dy * dy
    if (along.astype(float) * across).max(initial=0) >= 2.0**63:
        raise OverflowError("points too far out for exact rectangles")
    area = along * across / length
    order = np.lexsort((by, bx, y, x, area, g))
    m = order[np.append(True, np.diff(g[order]) != 0)[: len(g)]]
    root = np.sqrt(length[m].astype(float))
    sides = ((u0, v0), (u1, v0), (u1, v1), (u0, v1))
    places = [c for s, t in sides for c in ((s[m] * dx[m] - t[m] * dy[m]) / length[m], (s[m] * dy[m] + t[m] * dx[m]) / length[m])]
    return [area[m], x[m], y[m], along[m] / root, across[m] / root, *places]


def rectangles(hulls_: DataFrame) -> DataFrame:
    """image_id and the columns of RECTANGLE: ``least_rectangle`` of each hull, with its edge's first corner, for whole batches of hulls at once."""
    kind = hulls_.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            x, y = (flat.field(k).to_numpy() for k in (0, 1))
            told = sizes > 2
            in_told = np.repeat(told, sizes)
            found = _least(np.append(0, np.cumsum(sizes[told])[:-1])[: told.sum()], sizes[told], x[in_told], y[in_told])
            # Points and lines have a row without a rectangle.
            places = np.where(told, np.cumsum(told) - 1, 0)
            columns = [pa.array(c[places] if len(c) else np.zeros(len(told), c.dtype), mask=~told) for c in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["image_id", *RECTANGLE])

    kinds = ", ".join(f"{c} {'long' if c in ('ax', 'ay') else 'double'}" for c in RECTANGLE)
    return hulls_.select("image_id", "hull").mapInArrow(run, f"image_id {kind}, {kinds}")
