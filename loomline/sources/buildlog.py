"""Binary build logs (gzip, records with lengths of seven bits a byte): errors, warnings, and when a build ran."""

from __future__ import annotations

import gzip
import io
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values of the format: kinds of records, flags of an event's fields, the oldest version whose records have
#: lengths, the number of the first string, and ticks (of 100 ns) before 1970.
END, STARTED, FINISHED, ERROR, WARNING, ARCHIVE, NAMES, STRING = 0, 1, 2, 9, 10, 17, 23, 24
CONTEXT, HELP, MESSAGE, SENDER, THREAD, TIMESTAMP = 1, 2, 4, 8, 16, 32
OLDEST, FIRST_STRING, EPOCH = 18, 10, 621_355_968_000_000_000
EVENTS = "path string, kind string, code string, file string, line int, column int, project string, message string, at long, problem string"


class LogError(ValueError):
    """Bytes that are not a build log of a known version."""


class Records:
    """A log's records, read as a stream: one record and the strings met so far are held."""

    def __init__(self, content: bytes):
        self.stream = gzip.GzipFile(fileobj=io.BytesIO(content))
        try:
            self.version, _ = struct.unpack("<ii", self.exactly(8))
        except (OSError, EOFError) as e:
            raise LogError("not a compressed log") from e
        if self.version < OLDEST:
            raise LogError(f"version {self.version}")
        self.strings: list[str] = []

    def exactly(self, n: int) -> bytes:
        data = self.stream.read(n)
        if len(data) < n:
            raise LogError("cut off")
        return data

    def number(self) -> int:
        return _number(lambda: self.exactly(1)[0])

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        """Kinds and contents of the events; strings go to the table, and lists and archives are passed over."""
        try:
            while kind := self.number():
                data = self.exactly(self.number())
                if kind == STRING:
                    self.strings.append(data.decode("utf-8", "replace"))
                elif kind not in (NAMES, ARCHIVE):
                    yield kind, data
        except (OSError, EOFError) as e:
            raise LogError("cut off") from e


def _number(byte) -> int:
    """A number of seven bits a byte, the lowest first, of 32 bits with a sign."""
    value = shift = 0
    while True:
        b = byte()
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value - (1 << 32) if value >= 1 << 31 else value
        if shift > 28:
            raise LogError("a number of more than 32 bits")


class Fields:
    """The fields of one event."""

    def __init__(self, data: bytes, strings: list[str]):
        self.data, self.strings, self.at = data, strings, 0

    def byte(self) -> int:
        if self.at >= len(self.data):
            raise LogError("an event is cut off")
        self.at += 1
        return self.data[self.at - 1]

    def number(self) -> int:
        return _number(self.byte)

    def text(self) -> str | None:
        n = self.number()
        if n < FIRST_STRING:
            return "" if n == 1 else None
        if n - FIRST_STRING >= len(self.strings):
            raise LogError(f"string {n} is missing")
        return self.strings[n - FIRST_STRING]

    def head(self) -> tuple[str | None, int | None]:
        """Message and time (milliseconds since 1970), in the format's order of fields."""
        flags = self.number()
        message = self.text() if flags & MESSAGE else None
        for _ in range(7 if flags & CONTEXT else 0):
            self.number()
        if flags & THREAD:
            self.number()
        for flag in (HELP, SENDER):
            if flags & flag:
                self.text()
        at = None
        if flags & TIMESTAMP:
            ticks = int.from_bytes(bytes(self.byte() for _ in range(8)), "little")
            self.number()
            at = (ticks - EPOCH) // 10_000
        return message, at


KINDS = {STARTED: "started", FINISHED: "finished", ERROR: "error", WARNING: "warning"}


def parse(content: bytes) -> Iterator[tuple]:
    """(kind, code, file, line, column, project, message, at) of the events that are reported."""
    records = Records(content)
    for kind, data in records:
        if kind not in KINDS:
            continue
        fields = Fields(data, records.strings)
        message, at = fields.head()
        if kind in (ERROR, WARNING):
            fields.text()
            code, file, project = fields.text(), fields.text(), fields.text()
            yield KINDS[kind], code, file, fields.number(), fields.number(), project, message, at
        else:
            yield KINDS[kind], None, None, None, None, None, message, at


def build_events(logs: DataFrame) -> DataFrame:
    """EVENTS of logs (path, content: binary); a log that can't be read to its end gives what it has, and one row whose
    `problem` says why."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in EVENTS.split(", ")]
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [(path, *event, None) for event in parse(bytes(content or b""))]
                except LogError as e:
                    rows.append((path, *[None] * 8, str(e)))
            frame = pd.DataFrame(rows, columns=names, dtype=object)
            for name in ("line", "column", "at"):
                frame[name] = frame[name].astype("Int64")
            yield frame

    return logs.select("path", "content").mapInPandas(read, EVENTS)
