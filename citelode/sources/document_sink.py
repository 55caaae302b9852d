"""Downloaded documents as files, each there whole or not at all.

Rows are checked in the plan (size, content type, magic bytes; ``checked``); the sink only moves
bytes. A task writes into a folder of its own under ``_temporary``; when all tasks are done, the
driver renames what they wrote into place, file by file from each task's own list, and what a
failed or lost attempt left goes with the folder. So a file's name never stands for part of its
bytes, and a job that fails leaves none. Paths are any that Arrow's file systems know.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import RecordBatch, fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from citelode.functions import content
from citelode.functions.text import slug
from citelode.operators.staging import shared_folder

OUTCOME = "url string, path string, size_bytes long, error string"


def checked(df: DataFrame) -> DataFrame:
    """Adds ``name`` and ``error`` to ``url, title, content_type, content``: what to store a download as, or why not.

    ``target``, where there is such a column, is the address that answered; ``problem`` says why
    nothing did. Checks go in order: problem, content type, size, magic bytes. A file that claims
    no binary type and has no magic bytes is text or a page; one that claims a type and isn't a
    document is refused.
    """
    at = F.coalesce(F.col("target"), F.col("url")) if "target" in df.columns else F.col("url")
    problem = F.col("problem") if "problem" in df.columns else F.lit(None).cast("string")
    kind, head, size = F.coalesce("content_type", F.lit("")), F.substring("content", 1, content.HEAD), F.coalesce(F.octet_length("content"), F.lit(0))
    ext = content.reconcile_doc_ext(head, content.ext_from(at, kind), content.claims_binary(at, kind))
    error = F.coalesce(problem, content.reject_content_type(at, kind), content.reject_size(size), F.when(ext.isNull(), content.NOT_THE_DOCUMENT))
    return df.withColumn("error", error).withColumn("name", F.when(error.isNull(), F.concat(slug(F.coalesce("title", F.lit("")), F.col("url")), ext)))


@dataclass
class Written(WriterCommitMessage):
    """Where a task's list of files is."""

    task: str


class DocumentWriter(DataSourceArrowWriter):
    """Writes ``url, name, error, content``; see the module."""

    def __init__(self, folder: str, job: str):
        self.folder, self.job = folder, job

    def _at(self) -> tuple[fs.FileSystem, str]:
        system, path = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)
        return system, path.rstrip("/")

    def write(self, iterator: Iterator[RecordBatch]) -> Written:
        system, base = self._at()
        task = uuid.uuid4().hex
        own = f"{base}/_temporary/{self.job}/{task}"
        system.create_dir(own, recursive=True)
        with system.open_output_stream(f"{own}.jsonl") as told:
            for batch in iterator:
                for url, name, error, body in zip(*(batch.column(c) for c in ("url", "name", "error", "content")), strict=True):
                    name, size = name.as_py(), None
                    if error.as_py() is None:
                        raw = body.as_buffer()
                        size = raw.size
                        with system.open_output_stream(f"{own}/{name}.part") as out:
                            out.write(raw)
                    told.write((json.dumps({"url": url.as_py(), "name": name, "size_bytes": size, "error": error.as_py()}) + "\n").encode())
        return Written(task)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = self._at()
        system.create_dir(f"{base}/_outcomes/{self.job}", recursive=True)
        for m in messages:
            if m is None:
                continue
            own = f"{base}/_temporary/{self.job}/{m.task}"
            # a line at a time: the list may be long
            with system.open_input_stream(f"{own}.jsonl") as raw, system.open_output_stream(f"{base}/_outcomes/{self.job}/{m.task}.jsonl") as out:
                for line in _lines(raw):
                    row = json.loads(line)
                    path = None
                    if row["error"] is None:
                        path = f"{base}/{row['name']}"
                        system.move(f"{own}/{row['name']}.part", path)
                    out.write((json.dumps({"url": row["url"], "path": path, "size_bytes": row["size_bytes"], "error": row["error"]}) + "\n").encode())
        system.delete_dir(f"{base}/_temporary/{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        system, base = self._at()
        if system.get_file_info(f"{base}/_temporary/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/_temporary/{self.job}")


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while block := stream.read(1 << 16):
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


class DocumentFiles(DataSource):
    """Format ``document_files``: appends files to the folder ``path``. Options: ``path``, ``job``, a name of its own."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "url string, name string, error string, content binary"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], self.options["job"])


def save_documents(downloads: DataFrame, folder: str | None = None) -> DataFrame:
    """Stores downloads (``url, title, content_type, content``) and tells of each: ``url, path, size_bytes, error``.

    Of downloads that would have the same name, the one of the least address and content hash is
    stored, the others aren't told. A file that is already there is replaced.
    """
    spark = downloads.sparkSession
    folder, job = folder or f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}", uuid.uuid4().hex
    spark.dataSource.register(DocumentFiles)
    rows = checked(downloads.where("url is not null"))
    key = F.coalesce("name", F.concat(F.lit("\0"), "url"))
    first = rows.select(key.alias("__key"), F.struct("url", F.xxhash64("content").alias("h")).alias("__v")).groupBy("__key").agg(F.min("__v").alias("__v"))
    rows = rows.withColumn("__key", key).withColumn("__v", F.struct("url", F.xxhash64("content").alias("h"))).join(first, ["__key", "__v"], "left_semi").dropDuplicates(["__key"])
    rows.select("url", "name", "error", "content").write.format("document_files").mode("append").option("path", folder).option("job", job).save()
    return spark.read.schema(OUTCOME).json(f"{folder}/_outcomes/{job}")
