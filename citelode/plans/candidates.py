"""The search pipeline as one plan: discoveries in, ranked candidates out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citelode.functions.text import strip_html
from citelode.functions.urls import url_key
from citelode.operators import dedup, rank, rerank


def candidates(
    discoveries: DataFrame, keywords: DataFrame, max_total: int = 500, vectors: DataFrame | None = None, verdicts: DataFrame | None = None, edges: DataFrame | None = None
) -> DataFrame:
    """Ranked candidates of every run, in order: the engine's output rows.

    Stages that have no input are left out: ``vectors`` (``run_id, url, cosine``) reranks the
    head, ``verdicts`` filters the borderline band, ``edges`` boosts by citations.
    """
    # terms and counts meet the merged rows before the texts do, so a text is exchanged once and counted there
    merged = dedup.merged(discoveries, max_total)
    asked = merged.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("run_id"))).drop("source_ranks").join(rank.asked_terms(keywords), "run_id")
    scores = rank.weighed(dedup.with_fields(discoveries, asked))
    out = rank.flag_rejects(rank.placed(dedup.with_fields(discoveries, merged), scores))
    if vectors is not None:
        out = rerank.semantic_rerank(out.join(vectors, ["run_id", "url"], "left"), rerank.pool_size(F.lit(max_total))).drop("cosine")
    if verdicts is not None:
        out = rerank.llm_filter(out, verdicts)
    if edges is not None:
        out = rerank.citation_boost(out, edges)
    return rank.final_rank(out).withColumn("sources", F.array_distinct(F.col("source_ranks.source")))


def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as discovered documents: title and whole text, eight sources."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    source = F.concat(F.lit("s"), (F.col("page_id") % 8).cast("string"))
    first = F.row_number().over(Window.partitionBy(url_key(F.col("url"))).orderBy("page_id"))
    kept = pages.withColumn("first", first).where("first = 1")
    rank_in_source = F.row_number().over(Window.partitionBy(source).orderBy("page_id"))
    return kept.select("page_id", "url", title.alias("title"), strip_html(F.col("html"), native=True).alias("abstract"), source.alias("source"), rank_in_source.alias("rank_in_source"))


def flagship(spark: SparkSession, sf_dir: str, words: tuple[str, ...] = ("the", "and", "tion", "la")) -> DataFrame:
    """Pages deduplicated by address and ranked for a few keywords, as candidates with their final rank.

    Each of eight sources is a run of its own.
    """
    docs = page_documents(spark, sf_dir).withColumn("run_id", F.col("page_id") % 8).withColumn("insert_idx", F.col("page_id"))
    docs = docs.withColumn("source_ranks", F.array(F.struct("source", F.col("rank_in_source").alias("rank"))))
    keywords = spark.range(8).select(F.col("id").alias("run_id"), F.explode(F.array(*[F.lit(w) for w in words])).alias("keyword"))
    out = rank.final_rank(rank.flag_rejects(rank.rank_candidates(docs, keywords)))
    numbers = [F.round(c, 6).alias(c) for c in ("tfidf", "rrf", "authority", "score")]
    return out.select("page_id", "title", "url", "source", *numbers, "status", "reject_reason", "final_rank")
