"""Second-stage ranking: embeddings, a model's verdicts, the citation graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType

from citelode.functions.urls import extract_doi
from citelode.operators.rank import flag_rejects

LEXICAL, SEMANTIC = 0.6, 0.4
BAND = (50, 70)
SEEDS, STEP, MOST = 30, 0.10, 5
OFF_TOPIC = "LLM judged off-topic"


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 where sizes differ or are zero."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-9))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def pool_size(max_total: Column) -> Column:
    """Rows of a run that are reranked: a quarter of its cap, between 100 and 400."""
    return F.least(F.greatest(F.floor(max_total / 4), F.lit(100)), F.lit(400))


def embed(docs: DataFrame, embedder: Callable[[list[str]], list[list[float]]], text: str, out: str = "vector") -> DataFrame:
    """Adds vectors by an injected model, batch by batch; a batch of the wrong size is an error."""
    schema = StructType([*docs.schema.fields]).add(out, ArrayType(FloatType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors = embedder(pdf[text].fillna("").tolist())
            if len(vectors) != len(pdf):
                raise ValueError("the model returned another number of vectors")
            yield pdf.assign(**{out: vectors})

    return docs.mapInPandas(run, schema)


def semantic_rerank(ranked: DataFrame, pool: Column | None = None) -> DataFrame:
    """Re-sorts each run's head by its lexical score blended with ``cosine``; the tail stays below.

    The head is the first ``pool`` rows, rejected ones included. Scores of the head become the
    blend; a head of equal scores counts as 1. ``pos`` is renewed.
    """
    pool = pool_size(F.lit(500)) if pool is None else pool
    df = ranked.withColumn("__head", F.col("pos") <= pool)
    w = Window.partitionBy("run_id", "__head")
    low, high = F.min("score").over(w), F.max("score").over(w)
    df = df.withColumn("__low", low).withColumn("__high", high)
    lexical = F.when(F.col("__high") > F.col("__low"), (F.col("score") - F.col("__low")) / (F.col("__high") - F.col("__low"))).otherwise(1.0)
    blend = LEXICAL * lexical + SEMANTIC * F.least(F.greatest(F.coalesce("cosine", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    df = df.withColumn("score", F.when(F.col("__head"), blend).otherwise(F.col("score")))
    order = Window.partitionBy("run_id").orderBy(F.desc("__head"), F.when(F.col("__head"), F.col("score")).desc(), "pos")
    return df.withColumn("pos", F.row_number().over(order)).drop("__head", "__low", "__high")


def _in_band(ranked: DataFrame) -> DataFrame:
    """Adds ``__asked``, whether a row stands in its run's band; windows, so the rows are made once."""
    run = Window.partitionBy("run_id")
    kept = F.col("reject_reason").isNull()
    number = F.when(kept, 1).otherwise(0)
    before = F.sum(number).over(run.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - 1
    df = ranked.withColumn("__i", before).withColumn("__n", F.sum(number).over(run)).withColumn("__all", F.count(F.lit(1)).over(run))
    low = F.floor(F.col("__n") * BAND[0] / 100)
    high = F.greatest(F.floor(F.col("__n") * BAND[1] / 100), low + 1)
    asked = kept & F.col("run_id").isNotNull() & (F.col("__all") >= 4) & (F.col("__n") >= 4) & (F.col("__i") >= low) & (F.col("__i") < high)
    return df.withColumn("__asked", asked).drop("__i", "__n", "__all")


def borderline(ranked: DataFrame) -> DataFrame:
    """The kept rows between the 50th and 70th percentile of each run, at least one.

    Runs of fewer than four rows, or four kept ones, have none.
    """
    return _in_band(ranked).where("__asked").drop("__asked")


def llm_filter(ranked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rejects borderline rows with a false verdict; without a verdict a row stays.

    ``verdicts`` has ``run_id, url, verdict``. An address that a run has twice is judged as one.
    """
    asked = F.max("__asked").over(Window.partitionBy("run_id", "url"))
    no = verdicts.where("not verdict").select("run_id", "url").distinct().withColumn("__no", F.lit(True))
    reason = F.when(F.col("__no") & F.col("__asked") & F.col("reject_reason").isNull(), OFF_TOPIC).otherwise(F.col("reject_reason"))
    return _in_band(ranked).withColumn("__asked", asked).join(no, ["run_id", "url"], "left").withColumn("reject_reason", reason).select(*ranked.columns)


def citation_boost(ranked: DataFrame, edges: DataFrame, compat: bool = True) -> DataFrame:
    """Raises rows that the run's first 30 documents cite or are cited by, and re-sorts.

    ``edges`` has ``src_doi, dst_doi``, references and citations alike, repeats counting. A row
    gains a tenth for each edge, at most half; of rows with one DOI the last gains. All rows are
    re-sorted by score alone; ``compat=False`` keeps what stood above the head's end above it.
    Rejects are flagged again.
    """
    doi = F.coalesce(extract_doi(F.col("identifier")), extract_doi(F.col("url")))
    df = ranked.withColumn("__doi", doi)
    seeds = df.where((F.col("pos") <= SEEDS) & F.col("__doi").isNotNull()).select("run_id", F.col("__doi").alias("src_doi")).distinct()
    hits = edges.where("src_doi <> dst_doi").join(seeds, "src_doi").groupBy("run_id", F.col("dst_doi").alias("__gains")).agg(F.count(F.lit(1)).alias("__hits"))
    # of the head's rows of one DOI only the last looks for hits
    last = F.max(F.when(F.col("pos") <= SEEDS, F.col("pos"))).over(Window.partitionBy("run_id", "__doi"))
    df = df.withColumn("__gains", F.when(F.col("pos") == last, F.col("__doi"))).join(hits, ["run_id", "__gains"], "left")
    gain = 1 + STEP * F.least(F.coalesce("__hits", F.lit(0)), F.lit(MOST))
    df = df.withColumn("score", F.col("score") * gain).withColumn("authority", F.col("authority") * gain)
    order = [F.desc("score"), "pos"] if compat else [F.when(F.col("pos") <= SEEDS, 0).otherwise(1), F.desc("score"), "pos"]
    df = df.withColumn("pos", F.row_number().over(Window.partitionBy("run_id").orderBy(*order))).select(*ranked.columns)
    return flag_rejects(df)
