"""Files in and out that Spark has no format for."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from numerion.schema import DATASET


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """image, lines, category from a JSON object of image name -> {lines, category}."""
    kind = "map<string,struct<lines:array<string>,category:string>>"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", kind)).alias("image", "t")).select("image", "t.lines", "t.category")


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """idx, split, pixels, label of npz files with x_train, y_train, x_test and y_test; read where Spark reads."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                with np.load(io.BytesIO(content)) as f:
                    for split in ("train", "test"):
                        x, y = f[f"x_{split}"], f[f"y_{split}"]
                        for at in range(0, len(x), 5000):
                            some = x[at : at + 5000]
                            yield pd.DataFrame({"idx": np.arange(at, at + len(some)), "split": split, "pixels": [i.tobytes() for i in some], "label": y[at : at + 5000].astype("int32")})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, DATASET)


def write_images(rows: DataFrame, folder: str) -> None:
    """(name, png) rows as image files in a folder that executors share; folders are made, files of one name are replaced."""

    def run(parts):
        import os

        os.makedirs(folder, exist_ok=True)
        for row in parts:
            with open(os.path.join(folder, row["name"]), "wb") as f:
                f.write(row["png"])

    rows.select("name", "png").foreachPartition(run)


def write_results(results: DataFrame, path: str) -> None:
    """Detection rows as JSON lines."""
    results.write.mode("overwrite").json(path)
