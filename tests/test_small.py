"""Small operators: offsets of frames, wide pixels, counts and event times of streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from numerion.functions import kernels
from numerion.operators import detection
from numerion.streaming import live


def test_boxes_and_quads_of_a_window_are_moved_into_the_frame(spark):
    df = spark.createDataFrame([(1, 5, 6, [[5, 6], [9, 6], [9, 12], [5, 12]], 100, 40), (2, 0, 0, None, 3, 4)], "id int, x int, y int, quad array<array<int>>, dx int, dy int")
    got = [(r["x"], r["y"], r["quad"]) for r in detection.framed(df, F.col("dx"), F.col("dy")).orderBy("id").collect()]
    assert got == [(105, 46, [[105, 46], [109, 46], [109, 52], [105, 52]]), (3, 4, None)]
    assert detection.framed(df.drop("quad"), F.lit(1), F.lit(2)).orderBy("id").first()["y"] == 8


def test_wide_pixels():
    assert kernels.from_wide(np.array([0, 256, 257, 65535], np.uint16)).tolist() == [0, 0, 1, 255]


def test_counts_and_event_times_of_a_stream(spark, tmp_path):
    rows = [(1, "12", "2024-01-01 00:00:00"), (1, "?3", "2024-01-01 00:20:00"), (2, None, "2024-01-01 00:00:30")]
    spark.createDataFrame(rows, "camera long, reading string, ts string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("camera long, reading string, ts string").parquet(f"{tmp_path}/in")
    told = live.event_time(live.counters(stream))
    q = told.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    seen = [p["observedMetrics"].get("numerion") for p in q.recentProgress]
    assert [(s["requests"], s["digits"]) for s in seen if s and s["requests"]] == [(3, 3)]
    assert q.lastProgress["eventTime"] is not None and spark.read.parquet(f"{tmp_path}/out").schema["ts"].dataType.simpleString() == "timestamp"
