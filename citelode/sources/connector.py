"""A Spark data source over captured provider answers; ``live`` has the one that asks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Request(InputPartition):
    """One captured answer."""

    def __init__(self, path: str):
        self.path = path


class CapturedReader(DataSourceReader):
    """A partition for each file, so that answers are read where there is room."""

    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Request]:
        return [Request(str(p)) for p in sorted(Path(self.folder).rglob("*")) if p.suffix in (".json", ".xml", ".html")] or [Request("")]

    def read(self, partition: Request) -> Iterator[tuple]:
        if not partition.path:
            return
        p = Path(partition.path)
        about = p.with_suffix(".request")
        asked = json.loads(about.read_text()) if about.exists() else {}
        yield p.parent.name, asked.get("sub_query"), int(asked.get("page", 0)), p.read_text(errors="replace")


class CapturedAnswers(DataSource):
    """``source_id, sub_query, page, payload``: answers under ``path``, a folder for each source.

    Register with ``spark.dataSource.register(CapturedAnswers)`` and read format
    ``captured_answers``. The folder must be one that all executors see.
    """

    @classmethod
    def name(cls) -> str:
        return "captured_answers"

    def schema(self) -> str:
        return "source_id string, sub_query string, page int, payload string"

    def reader(self, schema) -> CapturedReader:
        return CapturedReader(self.options["path"])
