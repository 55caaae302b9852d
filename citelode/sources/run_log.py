"""Run logs as a stream: JSON lines of append-only files, by byte offsets.

An offset is how many bytes of each file are done with. It only ever stands after a newline, so
a line that is still being written waits for the next batch, and a restart goes on at the very
byte it stopped at. Ranges of files are cut into partitions; each begins after the first newline
at or past its start, so lines belong to one partition. The tail of a log is the same source
started near its end.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from citelode.operators.schemas import RUN_LOG

#: Bytes of a partition, and of a look for newlines.
SPAN, LOOK = 32 * 1024 * 1024, 64 * 1024
#: The tail's window: so many bytes an entry, and its bounds.
TAIL_BYTES, TAIL_LEAST, TAIL_MOST = 2048, 64 * 1024, 4 * 1024 * 1024


def tail_bytes(most: int) -> int:
    """Bytes of a log's end in which its last ``most`` entries are looked for."""
    return min(max(TAIL_BYTES * most, TAIL_LEAST), TAIL_MOST)


@dataclass
class Span(InputPartition):
    """Bytes of a file, from the beginning of a line on."""

    path: str
    start: int
    end: int


class LogReader(DataSourceStreamReader):
    """Reads files ``*.jsonl`` and ``*.json`` under a folder, hidden ones left out, or one file."""

    def __init__(self, path: str, tail: int | None):
        self.path, self.tail = path, tail

    def _system(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), self.path

    def _files(self) -> list[fs.FileInfo]:
        system, path = self._system()
        at = system.get_file_info(path)
        if at.type == fs.FileType.Directory:
            return sorted((f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and f.path.endswith((".jsonl", ".json")) and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)
        return [at] if at.type == fs.FileType.File else []

    def _after_newline(self, path: str, start: int, end: int, last: bool) -> int | None:
        """The place after the first newline in a range, or after its last one; None without any."""
        with self._system()[0].open_input_file(path) as f:
            at = end if last else start
            while (at > start) if last else (at < end):
                low = max(start, at - LOOK) if last else at
                block = f.read_at(min(LOOK, (at if last else end) - low), low)
                i = block.rfind(b"\n") if last else block.find(b"\n")
                if i >= 0:
                    return low + i + 1
                at = low if last else at + len(block)
        return None

    def initialOffset(self) -> dict:  # noqa: N802 (Spark's names)
        if self.tail is None:
            return {}
        begin = {}
        for f in self._files():
            if f.size > self.tail:
                begin[f.path] = self._after_newline(f.path, f.size - self.tail - 1, f.size, False) or f.size
        return begin

    def latestOffset(self, *args) -> dict:  # noqa: N802
        end = {}
        for f in self._files():
            if (at := self._after_newline(f.path, 0, f.size, True)) is not None:
                end[f.path] = at
        return end

    def partitions(self, start: dict, end: dict) -> list[Span]:
        out = []
        for path, stop in sorted(end.items()):
            at = start.get(path, 0)
            while at < stop:
                cut = stop if stop - at <= SPAN else self._after_newline(path, at + SPAN, stop, False) or stop
                out.append(Span(path, at, cut))
                at = cut
        return out

    def read(self, partition: Span) -> Iterator[tuple]:
        with self._system()[0].open_input_file(partition.path) as f:
            at, rest = partition.start, b""
            while at < partition.end:
                block = f.read_at(min(LOOK, partition.end - at), at)
                begin = at - len(rest)
                at += len(block)
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    yield partition.path, begin, line.decode("utf-8", "replace")
                    begin += len(line) + 1

    def commit(self, end: dict) -> None:
        """Nothing to let go of: the files stay as they are."""


class RunLogLines(DataSource):
    """Format ``run_log_lines``: ``path, at, line``, where ``at`` is the byte a line begins at.

    Options: ``path``; ``tail``, bytes of each file's end to begin with.
    """

    @classmethod
    def name(cls) -> str:
        return "run_log_lines"

    def schema(self) -> str:
        return "path string, at long, line string"

    def streamReader(self, schema) -> LogReader:  # noqa: N802
        tail = self.options.get("tail")
        return LogReader(self.options["path"], None if tail is None else int(tail))


def entries(lines: DataFrame) -> DataFrame:
    """Entries of log lines, broken ones left out: ``path, at, ts, event``."""
    row = F.from_json("line", RUN_LOG)
    return lines.select("path", "at", row.alias("__e")).where("__e.ts is not null").select("path", "at", "__e.ts", "__e.event")


def stream(spark: SparkSession, path: str, tail: int | None = None) -> DataFrame:
    """A log's entries as they are appended, from its beginning, or from the last ``tail`` entries' window on."""
    spark.dataSource.register(RunLogLines)
    read = spark.readStream.format("run_log_lines").option("path", path)
    return entries((read if tail is None else read.option("tail", str(tail_bytes(tail)))).load())


def tail(spark: SparkSession, path: str, most: int = 200) -> DataFrame:
    """The last ``most`` entries of a log's files together, in order, read from the bounded window at each file's end."""
    reader = LogReader(path, tail_bytes(most))
    spans = [(json.dumps([s.path, s.start, s.end]),) for s in reader.partitions(reader.initialOffset(), reader.latestOffset())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for span in batch["span"]:
                rows = list(reader.read(Span(*json.loads(span))))
                yield pd.DataFrame(rows, columns=["path", "at", "line"])

    lines = spark.createDataFrame(spans, "span string").mapInPandas(run, "path string, at long, line string")
    last = entries(lines).orderBy(F.desc("ts"), F.desc("path"), F.desc("at")).limit(most)
    return last.orderBy("ts", "path", "at")
