"""Structured Streaming twins of the live-reading operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from numerion.operators.votes import VOTES

VOTE_SCHEMA = "camera long, k long, reading string, stable string, agreement double"


def vote_of(held: list[str]) -> tuple[str, float]:
    """The most frequent reading and its share; the oldest of equal ones; ("", 0) of nothing."""
    counts: dict[str, int] = {}
    for v in held:
        counts[v] = counts.get(v, 0) + 1
    best = max(counts.values(), default=0)
    return next(((v, n / len(held)) for v, n in counts.items() if n == best), ("", 0.0))


def stable_readings(frames: DataFrame, n: int = VOTES) -> DataFrame:
    """The vote of ``votes.majority`` on a stream of (camera, k, reading): the state of a camera is its last ``n`` readings."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values("k")
        out = []
        for k, reading in zip(rows["k"], rows["reading"], strict=True):
            held = [*held, "" if reading is None else reading][-n:]
            out.append((key[0], k, reading, *vote_of(held)))
        state.update((held,))
        yield pd.DataFrame(out, columns=["camera", "k", "reading", "stable", "agreement"])

    return frames.select("camera", "k", "reading").groupBy("camera").applyInPandasWithState(step, VOTE_SCHEMA, "held array<string>", "append", GroupStateTimeout.NoTimeout)


class ResettableVotes(StatefulProcessor):
    """The last ``n`` readings of a camera as a list in the state store, gone when the camera is reset or idle for ``idle_ms``."""

    def __init__(self, n: int, idle_ms: int | None) -> None:
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "reading string", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [r[0] for r in self.held.get()] if self.held.exists() else []
        for part in rows:
            part = part.sort_values("k", kind="stable")
            stable, agreement = [], []
            for reading, reset in zip(part["reading"], part["reset"], strict=True):
                held = [] if reset else [*held, reading or ""][-self.n :]
                vote, share = vote_of(held)
                stable.append(vote)
                agreement.append(share)
            yield pd.DataFrame({"camera": key[0], "k": part["k"], "reading": part["reading"], "stable": stable, "agreement": agreement})
        self.held.clear()
        if held:
            self.held.put([(v,) for v in held])

    def close(self) -> None:
        pass


def resettable_readings(frames: DataFrame, n: int = VOTES, idle_ms: int | None = None) -> DataFrame:
    """``stable_readings`` of a stream (camera, k, reading, reset) in which a row with ``reset`` empties its camera's vote: "" at agreement 0.

    A camera without frames for ``idle_ms`` milliseconds leaves the state. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    told = frames.select("camera", "k", "reading", F.coalesce("reset", F.lit(False)).alias("reset"))
    return told.groupBy("camera").transformWithStateInPandas(ResettableVotes(n, idle_ms), VOTE_SCHEMA, "append", "ProcessingTime" if idle_ms else "None")


def newest_frames(batch: DataFrame) -> DataFrame:
    """Of one micro-batch, the newest frame of each camera: for ``foreachBatch``, where load must be shed."""
    return batch.groupBy("camera").agg(F.max(F.struct("k", "reading")).alias("f"), F.count("*").alias("n")).select("camera", "f.k", "f.reading", (F.col("n") - 1).alias("dropped"))


def until(frames: DataFrame, n: int) -> DataFrame:
    """The first ``n`` frames of each camera: what a run that stops after ``n`` frames sees; frames without a number are out."""
    return frames.where(F.col("k") <= n)


def follow(frames: DataFrame, handle, checkpoint: str, newest_only: bool = False, live: bool = False, pace: str = "1 second"):
    """Start handing the frames to ``handle(batch, number)``, every one or only each camera's newest of a micro-batch.

    A live run looks for frames at each ``pace`` until it is stopped; any other
    ends by itself when the frames that are there have been read. The
    batches of a checkpoint are repeated under the same number after a failure.
    """

    def give(batch: DataFrame, number: int) -> None:
        handle(newest_frames(batch) if newest_only else batch, number)

    writer = frames.writeStream.foreachBatch(give).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=pace) if live else writer.trigger(availableNow=True)).start()


def counters(frames: DataFrame) -> DataFrame:
    """``frames`` with observed counts of requests and of digits read, told to query listeners with each batch."""
    return frames.observe("numerion", F.count("*").alias("requests"), F.sum(F.length(F.regexp_replace(F.coalesce("reading", F.lit("")), "[^0-9]", ""))).alias("digits"))


def event_time(frames: DataFrame, column: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """A stream with a watermark; times without zone are taken in the session's zone."""
    return frames.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)
