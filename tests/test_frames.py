"""Frame source, snapshots and resettable votes: restarts, failures, resets, idle cameras."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from numerion.sinks import snapshots
from numerion.sources.frames import frames
from numerion.streaming import live


def put(folder, camera, numbers):
    (folder / camera).mkdir(parents=True, exist_ok=True)
    for k in numbers:
        (folder / camera / f"{k:06d}.png").write_bytes(f"{camera}{k}".encode())


def run(spark, stream, folder, name):
    """All that there is now, appended to a table of files."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-check").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return sorted((r["camera"], r["k"], bytes(r["content"])) for r in spark.read.parquet(f"{folder}/{name}").collect())


def test_a_restarted_stream_repeats_no_frame(spark, tmp_path):
    where = tmp_path / "cams"
    put(where, "a", range(1, 8))
    put(where, "b", [3])
    (where / "a" / "notes.txt").write_text("no frame")
    want = [("a", k, f"a{k}".encode()) for k in range(1, 8)] + [("b", 3, b"b3")]
    assert run(spark, frames(spark, f"file://{where}", per_task=2), tmp_path, "out") == want
    assert run(spark, frames(spark, f"file://{where}", per_task=2), tmp_path, "out") == want
    put(where, "a", [8, 9])
    put(where, "c", [1])
    want = sorted([*want, ("a", 8, b"a8"), ("a", 9, b"a9"), ("c", 1, b"c1")])
    assert run(spark, frames(spark, f"file://{where}", per_task=2), tmp_path, "out") == want


def test_the_stream_ends_at_a_number_of_frames(spark, tmp_path):
    where = tmp_path / "cams"
    put(where, "a", range(10))
    put(where, "b", range(2))
    got = run(spark, frames(spark, f"file://{where}", frames=4), tmp_path, "out")
    assert [(c, k) for c, k, _ in got] == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0), ("b", 1)]


def test_a_failed_job_shows_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/snaps"
    rows = spark.range(40).selectExpr("concat('f', id) AS name", "cast(concat('c', id) AS binary) AS content", "id").repartition(4)
    snapshots.save(rows.where("id < 10"), path)
    with pytest.raises(Exception, match="broken"):
        snapshots.save(rows.withColumn("content", F.when(F.col("id") == 33, F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("content"))), path)
    got = {(r["name"], bytes(r["content"])) for r in snapshots.published(spark, path).collect()}
    assert got == {(f"f{i}", f"c{i}".encode()) for i in range(10)}
    assert len(list((tmp_path / "snaps" / "manifests").iterdir())) == 1


def test_frame_annotated_image_and_result_appear_together(spark, tmp_path):
    where, path = tmp_path / "cams", f"file://{tmp_path}/snaps"
    put(where, "a", [1, 2])

    def go():
        seen = frames(spark, f"file://{where}").withColumn("read", F.struct(F.col("k"), F.lit("123").alias("text")))
        files = seen.select(F.inline(snapshots.snapshot(F.col("camera"), F.col("k"), F.col("content"), F.reverse(F.col("content").cast("string")), F.col("read"))))
        assert snapshots.stream(files, path, f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination(120)
        return {(r["manifest"], r["name"]): bytes(r["content"]) for r in snapshots.published(spark, path).collect()}

    first = go()
    assert len(first) == 6 and {m for m, _ in first} == {"batch-000000000"}
    put(where, "a", [3])
    both = go()
    assert {k: v for k, v in both.items() if k in first} == first and len(both) == 9
    new = {n: v for (m, n), v in both.items() if m == "batch-000000001"}
    assert new["a/000000003.png"] == b"a3" and new["a/000000003-annotated.png"] == b"3a" and json.loads(new["a/000000003.json"]) == {"k": 3, "text": "123"}


@pytest.mark.parametrize("idle_ms", [None, 1])
def test_votes_are_reset_and_idle_cameras_leave(spark, tmp_path, idle_ms):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        schema = "camera long, k long, reading string, reset boolean"
        batches = [[(1, k, "123", False) for k in range(5)] + [(2, 0, "7", None)], [(1, 5, None, True), (2, 1, "8", False)], [(1, 6, "9", False), (2, 2, "8", False)]]
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        # Timers of processing time keep a query that takes what is there from ending by itself, so it is stopped.
        q = live.resettable_readings(stream, idle_ms=idle_ms).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").start()
        until = time.time() + 90
        while time.time() < until and q.isActive and sum(p["numInputRows"] for p in q.recentProgress) < 10:
            time.sleep(0.5)
        q.stop()
        got = {(r["camera"], r["k"]): (r["stable"], round(r["agreement"], 3)) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got[1, 4] == ("123", 1.0) and got[1, 5] == ("", 0.0) and got[1, 6] == ("9", 1.0)
    # An idle camera's earlier readings no longer count.
    assert got[2, 2] == (("8", 1.0) if idle_ms else ("8", 0.667))
