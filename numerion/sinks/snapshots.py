"""Files that appear all at once: a Spark sink that writes in tasks and publishes with a manifest.

Rows are ``name, content``. Each task writes its rows as files under names of its own; only when all tasks have ended does a
manifest, one small file, say which file stands for which name. Readers go by manifests, so a job that fails, or a task that is
tried again, shows nothing of what it wrote. A micro-batch's manifest bears its number: a batch that is repeated after a failure
replaces it and shows once. Frame, annotated image and result of a snapshot are rows of one batch and appear together.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

FILES, MANIFESTS = "files", "manifests"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class Tasks:
    """What tasks do and what is done with what they did, for batches and streams alike."""

    def __init__(self, path: str) -> None:
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        store, root = fs.FileSystem.from_uri(self.path)
        folder = f"{FILES}/{self.job}"
        store.create_dir(f"{root}/{folder}")
        done = []
        for row in rows:
            place = f"{folder}/{uuid.uuid4().hex}"
            with store.open_output_stream(f"{root}/{place}") as f:
                f.write(bytes(row["content"] or b""))
            done.append((row["name"], place))
        return Written(done)

    def publish(self, messages: list, name: str) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(f"{root}/{MANIFESTS}")
        aside = f"{root}/{FILES}/{self.job}-manifest"
        store.create_dir(f"{root}/{FILES}")
        with store.open_output_stream(aside) as f:
            f.write(json.dumps({"name": name, "files": [list(x) for m in messages if m is not None for x in m.files]}).encode())
        store.move(aside, f"{root}/{MANIFESTS}/{name}.json")

    def discard(self, messages: list) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        with contextlib.suppress(FileNotFoundError):
            store.delete_dir(f"{root}/{FILES}/{self.job}")


class BatchWriter(Tasks, DataSourceWriter):
    def commit(self, messages: list) -> None:
        self.publish(messages, f"job-{self.job}")

    def abort(self, messages: list) -> None:
        self.discard(messages)


class StreamWriter(Tasks, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self.publish(messages, f"batch-{batchId:09d}")

    def abort(self, messages: list, batchId: int) -> None:
        """Files of earlier batches lie in the same folder, so those of this one stay, unseen."""


class SnapshotSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "numerion_snapshots"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options["path"])

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options["path"])


def save(rows: DataFrame, path: str) -> None:
    """Writes ``rows`` (name, content) under ``path`` (a URI), to appear together or not at all."""
    rows.sparkSession.dataSource.register(SnapshotSink)
    rows.select("name", F.col("content").cast("binary").alias("content")).write.format("numerion_snapshots").mode("append").save(path)


def stream(rows: DataFrame, path: str, checkpoint: str):
    """A stream writer of ``rows`` (name, content); a micro-batch appears as a whole."""
    rows.sparkSession.dataSource.register(SnapshotSink)
    return rows.select("name", F.col("content").cast("binary").alias("content")).writeStream.format("numerion_snapshots").option("path", path).option("checkpointLocation", checkpoint)


def published(spark: SparkSession, path: str) -> DataFrame:
    """manifest, name, content of all that has been published under ``path``; a name of several manifests comes once for each."""
    told = spark.read.schema("name string, files array<array<string>>").json(f"{path}/{MANIFESTS}")
    listed = told.select(F.col("name").alias("manifest"), F.explode("files").alias("f")).select("manifest", F.get("f", F.lit(0)).alias("name"), F.get("f", F.lit(1)).alias("place"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/{FILES}").select(F.regexp_extract("path", rf"({FILES}/[^/]+/[^/]+)$", 1).alias("place"), "content")
    return listed.join(files, "place").select("manifest", "name", "content")


def snapshot(camera: Column, k: Column, frame: Column, annotated: Column, result: Column) -> Column:
    """name, content of the three files of a snapshot, to be exploded: the frame, the annotated image and the result as JSON."""
    base = F.concat(camera.cast("string"), F.lit("/"), F.lpad(k.cast("string"), 9, "0"))
    one = lambda end, content: F.struct(F.concat(base, F.lit(end)).alias("name"), content.cast("binary").alias("content"))
    return F.array(one(".png", frame), one("-annotated.png", annotated), one(".json", F.to_json(result)))
