"""Training a linear softmax classifier over examples of any number: gradients in tasks, one step an epoch, a table of weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How many epochs keep the first rate, what it then falls by each epoch, and the held-out share in thousandths.
STEADY, FALL, HELD = 3, 0.5, 50

HISTORY = "epoch int, rate double, loss double, accuracy double, val_loss double, val_accuracy double, examples long, val_examples long, classes int, weights array<double>"
METRICS = ("loss", "accuracy", "val_loss", "val_accuracy")


def rate_of(epoch: int, first: float) -> float:
    return first * FALL ** max(0, epoch - STEADY + 1)


def held_out(name: str = "idx", share: int = HELD):
    """Whether an example is for validation: by a hash of its number, so that it stays so however the table is cut or grows."""
    return F.conv(F.substring(F.md5(F.col(name).cast("string")), 1, 7), 16, 10).cast("long") % 1000 < share


def scores(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The probabilities of the classes; ``weights`` has a row a class, its last entry the bias."""
    z = x @ weights[:, :-1].T + weights[:, -1]
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def partial_sums(examples: DataFrame, weights: np.ndarray) -> DataFrame:
    """what, value: sums of each task over its examples (tensor, label, val): gradient entries by number, and those of the metrics from -1 down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, sums = np.zeros_like(weights), np.zeros(6)
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            y, val = b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            p = scores(x, weights)
            loss, right = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)), p.argmax(axis=1) == y
            for at, some in ((0, ~val), (3, val)):
                sums[at : at + 3] += loss[some].sum(), right[some].sum(), some.sum()
            p[np.arange(len(y)), y] -= 1
            own = p[~val]
            gradient[:, :-1] += own.T @ x[~val]
            gradient[:, -1] += own.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-6, gradient.size)), pa.array(np.concatenate([sums[::-1], gradient.ravel()]))], names=["what", "value"])

    return examples.select("tensor", F.col("label").cast("int").alias("label"), "val").mapInArrow(run, "what long, value double")


def _epochs(spark: SparkSession, folder: str) -> list:
    """The rows of the history that a folder holds so far."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return []
    return spark.read.schema(HISTORY).parquet(f"{folder}/*").orderBy("epoch").collect()


def train(examples: DataFrame, epochs: int, classes: int = 10, width: int = 64, rate: float = 0.5, share: int = HELD, folder: str | None = None) -> DataFrame:
    """The history: a row an epoch with the rate, the metrics before its step, and the weights it began with; the last row made no step.

    ``examples``: idx, tensor (``width`` doubles), label. An epoch is one job: each task adds up the gradient of its examples, Spark adds up the
    tasks', and what reaches the driver are ``classes * (width + 1)`` sums. With a ``folder`` each epoch's row is written
    as it ends; a run that finds rows there goes on after the last, with its weights.
    """
    spark = examples.sparkSession
    told = examples.withColumn("val", held_out("idx", share))
    rows = _epochs(spark, folder) if folder else []
    done = [tuple(r) for r in rows[: epochs + 1]]
    weights = np.array(done[-1][-1]).reshape(classes, width + 1) if done else np.zeros((classes, width + 1))
    first = len(done) - 1 if done else 0
    for epoch in range(first, epochs + 1):
        if done and epoch == first and epoch == epochs:
            break
        found = {r["what"]: r["value"] for r in partial_sums(told, weights).groupBy("what").agg(F.sum("value").alias("value")).collect()}
        loss, right, n, val_loss, val_right, val_n = (found.get(-1 - k, 0.0) for k in range(6))
        step = rate_of(epoch, rate)
        row = (epoch, step, loss / max(n, 1), right / max(n, 1), val_loss / max(val_n, 1), val_right / max(val_n, 1), int(n), int(val_n), classes, weights.ravel().tolist())
        if len(done) <= epoch:
            done.append(row)
            if folder:
                spark.createDataFrame([row], HISTORY).coalesce(1).write.mode("overwrite").parquet(f"{folder}/epoch-{epoch:05d}")
        gradient = np.array([found.get(k, 0.0) for k in range(weights.size)]).reshape(weights.shape)
        weights = weights - step * gradient / max(n, 1)
    return spark.createDataFrame(done, HISTORY)
