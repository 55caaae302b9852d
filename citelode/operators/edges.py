"""The citation graph as a stored table that grows by what isn't in it yet.

Edges of a document are asked for once, whichever runs want them: what is wanted is held against
the store by an anti-join, only the rest is fetched, and what came is appended as one more folder
that appears whole. Documents without edges are stored too, as an empty list, so they aren't
asked for again. Failed requests aren't stored.
"""

from __future__ import annotations

import importlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelode.functions.urls import extract_doi
from citelode.operators.rerank import SEEDS

EDGES = "kind string, doi string, related array<string>"
#: Both ways of an edge.
KINDS = ("references", "citations")


def _batches(spark: SparkSession, store: str) -> list[str]:
    """Folders of the store that are whole."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(store)
    system = at.getFileSystem(context._jsc.hadoopConfiguration())
    if not system.exists(at):
        return []
    return sorted(s.getPath().toString() for s in system.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("batch-"))


def stored(spark: SparkSession, store: str) -> DataFrame:
    """All edges in the store; of a document stored twice, by runs at one time, one list."""
    folders = _batches(spark, store)
    if not folders:
        return spark.createDataFrame([], EDGES)
    return spark.read.schema(EDGES).parquet(*folders).groupBy("kind", "doi").agg(F.max("related").alias("related"))


def wanted(ranked: DataFrame) -> DataFrame:
    """``kind, doi`` of the first rows of each run, both ways, each once."""
    doi = F.coalesce(extract_doi(F.col("identifier")), extract_doi(F.col("url")))
    heads = ranked.where(F.col("pos") <= SEEDS).select(doi.alias("doi")).where("doi is not null").distinct()
    return heads.select(F.explode(F.array(*[F.lit(k) for k in KINDS])).alias("kind"), "doi")


def _named(path: str) -> Callable[[str, str], list[str]]:
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def fetched(missing: DataFrame, fetch: str) -> DataFrame:
    """Edges of ``kind, doi`` by a fetcher ``module:function`` from kind and DOI to DOIs; rows whose request fails are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = _named(fetch)
        for batch in batches:
            out = []
            for kind, doi in zip(batch["kind"], batch["doi"], strict=True):
                try:
                    out.append((kind, doi, list(get(kind, doi))))
                except OSError:
                    continue
            yield pd.DataFrame(out, columns=["kind", "doi", "related"])

    return missing.mapInPandas(run, EDGES)


def materialise(want: DataFrame, store: str, fetch: str) -> int:
    """Fetches what the store lacks of ``kind, doi`` and appends it; gives the number of rows stored."""
    spark = want.sparkSession
    missing = want.select("kind", "doi").distinct().join(stored(spark, store), ["kind", "doi"], "left_anti")
    name = f"batch-{uuid.uuid4().hex}"
    fetched(missing, fetch).write.parquet(f"{store}/_writing-{name}")
    context = spark.sparkContext
    paths = [context._jvm.org.apache.hadoop.fs.Path(f"{store}/{p}{name}") for p in ("_writing-", "")]
    n = spark.read.schema(EDGES).parquet(f"{store}/_writing-{name}").count()
    system = paths[0].getFileSystem(context._jsc.hadoopConfiguration())
    if not n:
        system.delete(paths[0], True)
    elif not system.rename(*paths):
        raise RuntimeError(f"the new edges can't be put into {store}")
    return n


def as_pairs(edges: DataFrame) -> DataFrame:
    """``src_doi, dst_doi`` for ``rerank.citation_boost``, references and citations alike, repeats kept."""
    return edges.select(F.col("doi").alias("src_doi"), F.explode("related").alias("dst_doi"))
