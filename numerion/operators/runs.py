"""Connected ink of rasters of any size, from a table of runs.

A raster is a table of scanline pieces: image_id, r (row), x (column of the piece's first pixel), t (its
pixels; ink is over 0). Pieces may be of any width, rows may lack, and a
raster may lie in any number of partitions.

1. Each piece becomes its runs of ink: r, a, z (first and last column). A run is all that is kept of its pixels.
2. Rows are cut into strips of ``height`` rows. The runs of a strip meet in one task, in order; a run touches those of
   the row above whose columns overlap its own, widened by one, and a run that begins where another one ends. Labels
   are closed within the strip: the least run of a component, in raster order, names it.
3. Runs on both sides of a border between strips are joined where they overlap, by columns in buckets of ``BUCKET``,
   so that a row of very many runs is no product of runs.
4. What that links are names, few beside the runs; stars are contracted until nothing moves, the rounds growing
   with the logarithm of the longest chain of strips.

Ink connects over corners too (8-connected), or, with a ``reach`` of 0, over sides alone. A raster without ink has no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numerion.sinks.stored import stored

HEIGHT, BUCKET = 64, 256
#: A label is row * 2^32 + column of the component's first pixel, in raster order.
ROW = 32


def runs(pieces: DataFrame) -> DataFrame:
    """image_id, r, a, z: the runs of ink of scanline pieces, in one projection."""
    n = F.size("t")
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (F.get("t", i) > 0) & ((i == 0) | (F.get("t", i - 1) <= 0)))
    ends = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (F.get("t", i) > 0) & ((i == n - 1) | (F.get("t", i + 1) <= 0)))
    found = pieces.where(n > 0).select("image_id", "r", "x", F.inline(F.arrays_zip(begins.alias("a"), ends.alias("z"))))
    return found.select("image_id", F.col("r").cast("long").alias("r"), (F.col("x") + F.col("a")).cast("long").alias("a"), (F.col("x") + F.col("z")).cast("long").alias("z"))


def tile_runs(tiles: DataFrame, id_column: str, mask: str, w: int, h: int) -> DataFrame:
    """image_id, r, a, z of rasters that are one array each, in order and without a shuffle."""
    lines = F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda r: F.struct(r.alias("r"), F.slice(mask, r * w + 1, w).alias("t")))
    return runs(tiles.select(F.col(id_column).alias("image_id"), F.inline(lines)).withColumn("x", F.lit(0)))


def close(group: np.ndarray, r: np.ndarray, a: np.ndarray, z: np.ndarray, reach: int = 1) -> np.ndarray:
    """For each run the number of its component's first run; runs come by group (numbers that rise), row and column.

    ``reach`` is 1 where corners connect, 0 where only sides do.
    """
    n = len(r)
    first = np.ones(n, bool)
    first[1:] = (group[1:] != group[:-1]) | (r[1:] != r[:-1])
    line, starts = np.cumsum(first), np.flatnonzero(first)
    above = np.zeros(len(starts) + 1, bool)
    above[2:] = (group[starts[1:]] == group[starts[1:] - 1]) & (r[starts[1:]] == r[starts[1:] - 1] + 1)
    wide = int(z.max(initial=0)) + 3
    at = (line - 1) * wide
    lo, hi = np.searchsorted(line * wide + z, at + a - reach), np.searchsorted(line * wide + a, at + z + reach, "right")
    many = np.where(above[line], np.maximum(hi - lo, 0), 0)
    u = np.repeat(np.arange(n), many)
    v = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(len(u))
    beside = np.flatnonzero(~first[1:] & (a[1:] == z[:-1] + 1)) + 1
    u, v = np.concatenate([u, beside]), np.concatenate([v, beside - 1])
    names = np.arange(n)
    while len(u):
        low = np.minimum(names[u], names[v])
        after = names.copy()
        np.minimum.at(after, names[u], low)
        np.minimum.at(after, names[v], low)
        while (after[after] != after).any():
            after = after[after]
        if (after == names).all():
            break
        names = after
        apart = names[u] != names[v]
        u, v = u[apart], v[apart]
    return names


def _closed(height: int, reach: int):
    def told(ids: pa.Array, r: np.ndarray, a: np.ndarray, z: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        names = close(group, r, a, z, reach)
        return pa.RecordBatch.from_arrays([ids, pa.array(r), pa.array(a), pa.array(z), pa.array((r[names] << ROW) + a[names])], names=["image_id", "r", "a", "z", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the runs of the strip that the last batch ended in
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            table = pa.Table.from_batches(held).combine_chunks()
            ids, (r, a, z) = table.column(0), (table.column(i).to_numpy() for i in (1, 2, 3))
            names = ids.to_numpy()
            strip = r // height
            changes = np.flatnonzero((names[1:] != names[:-1]) | (strip[1:] != strip[:-1])) + 1
            if not len(changes):
                continue
            cut = int(changes[-1])
            group = np.zeros(cut, np.int64)
            group[changes[:-1]] = 1
            yield told(ids.slice(0, cut).combine_chunks(), r[:cut], a[:cut], z[:cut], np.cumsum(group))
            held = table.slice(cut).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            r, a, z = (table.column(i).to_numpy() for i in (1, 2, 3))
            yield told(table.column(0).combine_chunks(), r, a, z, np.zeros(len(r), np.int64))

    return run


def labelled(found: DataFrame, height: int = HEIGHT, reach: int = 1) -> DataFrame:
    """``found`` (runs; those of a strip together and in order) with ``label``: the component within the strip."""
    kind = found.schema["image_id"].dataType.simpleString()
    return found.mapInArrow(_closed(height, reach), f"image_id {kind}, r long, a long, z long, label long")


def in_strips(found: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Runs dealt by image and strip, in order."""
    strip = F.expr(f"r div {height}")
    return found.repartition("image_id", strip).sortWithinPartitions("image_id", strip, "r", "a")


def border_links(told: DataFrame, height: int = HEIGHT, bucket: int = BUCKET, reach: int = 1) -> DataFrame:
    """image_id, u, v (u > v): labels of runs that touch across the border of two strips."""
    spread = lambda lo, hi: F.explode(F.sequence(F.expr(f"({lo}) div {bucket}"), F.expr(f"({hi}) div {bucket}"))).alias("bucket")
    upper = told.where(F.col("r") % height == height - 1).select("image_id", (F.col("r") + 1).alias("at"), "a", "z", "label", spread(f"greatest(0, a - {reach})", f"z + {reach}"))
    lower = told.where(F.col("r") % height == 0).select("image_id", F.col("r").alias("at"), F.col("a").alias("a2"), F.col("z").alias("z2"), F.col("label").alias("label2"), spread("a", "z"))
    met = upper.join(lower, ["image_id", "at", "bucket"]).where(f"a <= z2 + {reach} and z >= a2 - {reach}")
    return met.select("image_id", F.greatest("label", "label2").alias("u"), F.least("label", "label2").alias("v")).distinct()


def contracted(links: DataFrame) -> DataFrame:
    """image_id, label, root: the least label that each one reaches over ``links`` (image_id, u, v with u > v); roots have no row.

    A round hangs each label's larger neighbours, then each label itself, on its least one; minima
    are aggregated, never gathered.
    """
    least = lambda edges: edges.groupBy("image_id", "u").agg(F.min("v").alias("w"))

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("image_id", "u", "v"))).first())

    edges = stored(links, "links")
    seen = state(edges)
    while seen[0]:
        both = edges.unionByName(edges.select("image_id", F.col("v").alias("u"), F.col("u").alias("v")))
        hung = both.join(least(both), ["image_id", "u"]).where("v > u").select("image_id", F.col("v").alias("u"), F.least("u", "w").alias("v")).where("u > v").distinct()
        low = least(hung)
        moved = hung.join(low, ["image_id", "u"]).where("v > w").select("image_id", F.col("v").alias("u"), F.col("w").alias("v"))
        edges = stored(moved.unionByName(low.select("image_id", "u", F.col("w").alias("v"))).distinct(), "links")
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select("image_id", F.col("u").alias("label"), F.col("v").alias("root"))


def components(pieces: DataFrame, height: int = HEIGHT, bucket: int = BUCKET, reach: int = 1) -> DataFrame:
    """image_id, r, a, z, root: every run of a raster with its component, named by the component's first pixel."""
    told = stored(labelled(in_strips(runs(pieces), height), height, reach), "runs")
    roots = contracted(border_links(told, height, bucket, reach))
    return told.join(roots, ["image_id", "label"], "left").select("image_id", "r", "a", "z", F.coalesce("root", "label").alias("root"))


def boxes(told: DataFrame, name: str = "root") -> DataFrame:
    """image_id, first_row, first_column (of the component's first pixel), x, y, w, h, ink."""
    x, y = F.min("a"), F.min("r")
    each = told.groupBy("image_id", name).agg(x.alias("x"), y.alias("y"), (F.max("z") - x + 1).alias("w"), (F.max("r") - y + 1).alias("h"), F.sum(F.col("z") - F.col("a") + 1).alias("ink"))
    return each.select("image_id", F.shiftright(name, ROW).alias("first_row"), F.col(name).bitwiseAND(F.lit((1 << ROW) - 1)).alias("first_column"), "x", "y", "w", "h", "ink")
