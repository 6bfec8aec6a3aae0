"""Live readings in batch form: votes, changes, rates. The streaming twins are in ``streaming``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VOTES = 8


def majority(frames: DataFrame, n: int = VOTES) -> DataFrame:
    """camera, k, reading, stable, agreement: the most frequent of the last ``n`` readings, the oldest of equal ones.

    A window frame holds n readings at most, so the vote is counted in the row; cameras are dealt by key.
    """
    last = Window.partitionBy("camera").orderBy("k").rowsBetween(1 - n, 0)
    held = frames.select("camera", "k", "reading", F.collect_list(F.coalesce("reading", F.lit(""))).over(last).alias("held"))
    score = F.transform("held", lambda v, i: F.struct(F.size(F.filter("held", lambda o: o == v)).alias("n"), (-i).alias("age"), v.alias("v")))
    best = held.withColumn("best", F.array_max(score))
    return best.select("camera", "k", "reading", F.col("best.v").alias("stable"), (F.col("best.n") / F.size("held")).alias("agreement"))


def changes(votes: DataFrame) -> DataFrame:
    """The rows of ``votes`` whose (reading, stable) differs from the row before."""
    order = Window.partitionBy("camera").orderBy("k")
    pair = F.struct("reading", "stable")
    return votes.withColumn("before_", F.lag(pair).over(order)).where(F.col("before_").isNull() | ~F.col("before_").eqNullSafe(pair)).drop("before_")


def new_results(frames: DataFrame) -> DataFrame:
    """Frames whose time differs from that of the frame before."""
    order = Window.partitionBy("camera").orderBy("k")
    return frames.withColumn("before_", F.lag("ts").over(order)).where(F.col("before_").isNull() | (F.col("before_") != F.col("ts"))).drop("before_")


def smoothed_whole(frames: DataFrame, value: str, keep: float = 0.9, rows: int = 1024) -> DataFrame:
    """camera, k, smooth: an exponential mean over all earlier rows of a camera; ``k`` counts its rows from 1.

    Rows are folded in blocks of ``rows``, each from 0; what a block carries over is folded from the ends of the blocks
    before, so a camera of any length is dealt over many tasks. The first row counts in full; a null makes all that follows null.
    """
    part = F.when(F.col("k") == 1, F.col(value).cast("double")).otherwise(F.lit(1.0 - keep) * F.col(value))
    rowed = frames.select("camera", "k", F.expr(f"(k - 1) div {rows}").alias("block"), part.alias("x"))
    held = rowed.groupBy("camera", "block").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("xs"))
    fold = lambda xs, start: F.aggregate(xs, start, lambda a, v: F.lit(keep) * a + v["x"])
    ends = held.select("camera", "block", F.size("xs").alias("n"), fold(F.col("xs"), F.lit(0.0)).alias("end"))
    lists = ends.groupBy("camera").agg(F.array_sort(F.collect_list(F.struct("block", "n", "end"))).alias("bs"))
    carried = F.aggregate(
        "bs", F.array(F.lit(0.0)), lambda a, b: F.array_append(a, F.pow(F.lit(keep), b["n"]) * F.element_at(a, -1) + b["end"])
    )
    starts = lists.select("camera", F.posexplode(carried).alias("block", "carry")).withColumn("block", F.col("block").cast("long"))
    sums = F.aggregate(
        "xs", F.array(F.col("carry")), lambda a, v: F.array_append(a, F.lit(keep) * F.element_at(a, -1) + v["x"])
    )
    pairs = F.arrays_zip(F.col("xs.k").alias("k"), F.slice(sums, 2, rows).alias("smooth"))
    return held.join(starts, ["camera", "block"]).select("camera", F.explode(pairs).alias("p")).select("camera", "p.k", "p.smooth")


def newest(frames: DataFrame, slots) -> DataFrame:
    """The newest frame of each camera in each slot of time; older ones in the slot are dropped by design."""
    return frames.groupBy("camera", slots.alias("slot")).agg(F.max(F.struct("k", "event_id", "reading")).alias("f"), F.count("*").alias("n")).select("camera", "slot", "f.event_id", "f.reading", (F.col("n") - 1).alias("dropped"))
