"""Session logs as a data source of their own: spark.read.format('session_log').load(folder)."""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class SessionFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class SessionReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[SessionFile]:
        return [SessionFile(p) for p in sorted(glob.glob(os.path.join(self.folder, "**", "*.jsonl"), recursive=True))]

    def read(self, partition: SessionFile) -> Iterator[tuple]:
        """Lines that are JSON objects; others are left out."""
        with open(partition.path, encoding="utf-8", errors="replace") as lines:
            for number, line in enumerate(lines):
                try:
                    entry = json.loads(line)
                except ValueError:
                    continue
                if isinstance(entry, dict):
                    yield partition.path, number, entry.get("type"), line.rstrip("\n")


class SessionLog(DataSource):
    """One partition a file, for folders that the driver and all executors see."""

    @classmethod
    def name(cls) -> str:
        return "session_log"

    def schema(self) -> str:
        return "session string, line_no long, type string, line string"

    def reader(self, schema) -> SessionReader:
        return SessionReader(self.options["path"])

    def streamReader(self, schema) -> SessionStreamReader:
        """As a stream, line_no is the place of a line's first byte."""
        return SessionStreamReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SessionLog)


class Grown(InputPartition):
    """What has been added to a file: the bytes from `start` to `end`."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class SessionStreamReader(DataSourceStreamReader):
    """Session files that grow: an offset is the size of each file. A line belongs to the batch in which its end lies, so that
    a line that is written in parts comes once and whole, and a batch that is run again has the same lines."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = glob.glob(os.path.join(self.folder, "**", "*.jsonl"), recursive=True)
        return {path: os.path.getsize(path) for path in sorted(found)}

    def partitions(self, start: dict, end: dict) -> list[Grown]:
        return [Grown(path, start.get(path, 0), size) for path, size in end.items() if size > start.get(path, 0)]

    def read(self, partition: Grown) -> Iterator[tuple]:
        with open(partition.path, "rb") as file:
            begin = _line_start(file, partition.start)
            file.seek(begin)
            while (raw := file.readline()) and file.tell() <= partition.end and raw.endswith(b"\n"):
                text = raw.decode("utf-8", "replace").rstrip("\r\n")
                try:
                    entry = json.loads(text)
                except ValueError:
                    entry = None
                if isinstance(entry, dict):
                    yield partition.path, begin, entry.get("type"), text
                begin = file.tell()


def _line_start(file, at: int, step: int = 4096) -> int:
    """Where the line begins that the byte before `at` doesn't end."""
    while at > 0:
        low = max(0, at - step)
        file.seek(low)
        place = file.read(at - low).rfind(b"\n")
        if place >= 0:
            return low + place + 1
        at = low
    return 0
