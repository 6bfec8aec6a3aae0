"""Frames of cameras as a stream: a Spark data source over folders that cameras write numbered files to.

``path`` holds a folder for each camera, and it the frames; their names sort by time ("000017.png") and end in a number, the frame's ``k``.
An offset is the last name handed out of each camera, so what a checkpoint has seen is not read again after a restart, whatever has come
since. A micro-batch is cut into partitions of ``per_task`` frames, whose files the tasks read themselves. With ``frames`` the stream
of a camera ends at that many: nothing later is offered. Paths may be of any file system that Arrow opens.

Frames must be whole when their name appears (written aside, then renamed) and must not be named before ones that were handed out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "camera string, k long, name string, written timestamp, content binary"
NUMBER = re.compile(r"(\d+)(?:\.\w+)?$")


@dataclass
class Part(InputPartition):
    camera: str
    names: list[str]


class Frames(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.per_task = options["path"], int(options.get("per_task", 64))
        self.most = int(options["frames"]) if "frames" in options else None

    def _opened(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def _names(self) -> dict[str, list[str]]:
        """The frames of each camera in order; files without a number are none."""
        store, root = self._opened()
        out: dict[str, list[str]] = {}
        for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            inner = f.path[len(root) :].strip("/").split("/")
            if f.type == fs.FileType.File and len(inner) == 2 and NUMBER.search(inner[1]):
                out.setdefault(inner[0], []).append(inner[1])
        return {c: sorted(names)[: self.most] for c, names in out.items()}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {c: names[-1] for c, names in self._names().items()}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        parts = []
        for camera, names in sorted(self._names().items()):
            new = [n for n in names if start.get(camera, "") < n <= end.get(camera, "")]
            parts += [Part(camera, new[i : i + self.per_task]) for i in range(0, len(new), self.per_task)]
        return parts

    def read(self, partition: Part) -> Iterator[tuple]:
        store, root = self._opened()
        for name in partition.names:
            path = f"{root}/{partition.camera}/{name}"
            with store.open_input_file(path) as f:
                yield partition.camera, int(NUMBER.search(name).group(1)), name, store.get_file_info(path).mtime, f.read()

    def commit(self, end: dict) -> None:
        pass


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "numerion_frames"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Frames:
        return Frames(dict(self.options))


def frames(spark: SparkSession, path: str, **options):
    """A stream of camera, k, name, written, content from ``path`` (a URI)."""
    spark.dataSource.register(FrameSource)
    return spark.readStream.format("numerion_frames").options(path=path, **{k: str(v) for k, v in options.items()}).load()
