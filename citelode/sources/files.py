"""Readers of what runs leave behind: libraries, manifests, logs and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelode.functions.content import MAX_BYTES, MAX_ENTRY
from citelode.operators.schemas import LIBRARY_DOCUMENTS, MANIFEST, RUN_LOG, RUNS


def manifests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Legacy manifests, one JSON file each; ``library`` is the folder's name."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True).withColumn("library", F.element_at(F.split(F.input_file_name(), "/"), -2))


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a run's log, broken lines left out; ``seq`` orders entries of one moment."""
    rows = spark.read.schema(RUN_LOG).json(path, mode="DROPMALFORMED")
    return rows.where("ts is not null").withColumn("seq", F.monotonically_increasing_id())


def run_log_stream(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of entries as they are written."""
    return spark.readStream.schema(RUN_LOG).json(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder, hidden ones left out by Spark: ``path, length``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def contents(spark: SparkSession, path: str) -> DataFrame:
    """Files with their bytes: PDFs and EPUBs whole, of all others what their text may hold.

    A library holds no file beyond ``MAX_BYTES``, so none is left out for its size.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= MAX_BYTES)
    whole = F.lower("path").rlike(r"\.(pdf|epub)$")
    return rows.select("path", "length", F.when(whole, F.col("content")).otherwise(F.substring("content", 1, MAX_ENTRY)).alias("content"))


def library(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Runs and documents of libraries kept as Parquet, broken files skipped; ``library`` is the folder's name."""

    def read(name: str, schema: str) -> DataFrame:
        out = spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(f"{path}/*/{name}.parquet")
        return out.withColumn("library", F.regexp_extract(F.input_file_name(), rf"([^/]+)/{name}\.parquet", 1))

    return read("runs", RUNS), read("documents", LIBRARY_DOCUMENTS)
