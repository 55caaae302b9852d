"""Ranking of merged documents: TF-IDF, reciprocal rank fusion, authority, rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelode.functions.text import pieces, tokenize
from citelode.functions.urls import authority_multiplier

RRF_K, TITLE_BOOST, EPSILON = 60.0, 3, 0.001
ABSOLUTE_CUT, RELATIVE_CUT = 0.05, 0.02


def document_frequency(docs: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """In how many rows each token occurs: ``keys, term, df``."""
    return docs.select(*keys, F.explode(F.array_distinct(tokens)).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    """Smoothed inverse document frequency, defined for terms in no document."""
    return F.log((n + 1.0) / (df + 1.0)) + 1.0


def rrf(source_ranks: Column) -> Column:
    """Reciprocal rank fusion over a document's ranks, repeats included."""
    return F.aggregate(source_ranks, F.lit(0.0), lambda acc, s: acc + 1.0 / (F.lit(RRF_K) + s["rank"]))


def asked_terms(keywords: DataFrame) -> DataFrame:
    """``run_id, terms``: the terms of each run's keywords, with how often they are asked for."""
    terms = keywords.select("run_id", F.explode(tokenize(F.col("keyword"))).alias("term")).groupBy("run_id", "term").agg(F.count(F.lit(1)).alias("q"))
    return terms.groupBy("run_id").agg(F.collect_list(F.struct("term", "q")).alias("terms"))


def weighed(rows: DataFrame) -> DataFrame:
    """``run_id, insert_idx, tfidf`` of rows that carry their run's ``terms`` and its number of documents, ``n``."""

    def counted(d: Column) -> Column:
        # each document counts the few terms asked for in place, so no token becomes a row
        times = lambda tokens, t: F.size(tokens) - F.size(F.array_remove(tokens, t["term"]))
        return F.transform("terms", lambda t: F.struct(t["term"].alias("term"), t["q"].alias("q"), (TITLE_BOOST * times(d["title"], t) + times(d["body"], t)).alias("tf")))

    # one array of one struct, so that a text is split once and not for each term
    once = F.transform(F.array(F.struct(pieces(F.col("title")).alias("title"), pieces(F.col("abstract")).alias("body"))), counted)
    per_doc = rows.select("run_id", "insert_idx", "n", F.explode(F.filter(F.get(once, F.lit(0)), lambda t: t["tf"] > 0)).alias("t")).select("run_id", "insert_idx", "n", "t.*")
    scored = per_doc.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("run_id", "term")))
    return scored.groupBy("run_id", "insert_idx").agg(F.sum(F.col("tf") * F.col("q") * idf(F.col("n"), F.col("df"))).alias("tfidf"))


def tfidf(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """``run_id, insert_idx, tfidf`` of merged documents against each run's keywords.

    ``keywords`` has ``run_id, keyword``, a row for each time a sub-query names one, so repeated
    keywords weigh more. A title's tokens count three times.
    """
    asked = asked_terms(keywords).join(docs.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")), "run_id")
    return weighed(docs.select("run_id", "insert_idx", "title", "abstract").join(asked, "run_id"))


def rank_candidates(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """Merged documents with ``tfidf, rrf, authority, score`` and ``pos``, their place in the run."""
    return placed(docs, tfidf(docs, keywords))


def placed(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """``rank_candidates`` where ``scores``, as from ``tfidf``, are there; a document without one has 0."""
    scored = docs.join(scores, ["run_id", "insert_idx"], "left").withColumn("tfidf", F.coalesce("tfidf", F.lit(0.0)))
    scored = scored.withColumn("rrf", rrf(F.col("source_ranks"))).withColumn("authority", authority_multiplier(F.col("url")))
    scored = scored.withColumn("score", combined(F.col("tfidf"), F.col("rrf"), F.col("authority")))
    return scored.withColumn("pos", place("run_id"))


def combined(tfidf: Column, rrf: Column, authority: Column) -> Column:
    """The product that documents are ranked by."""
    return (tfidf + EPSILON) * (rrf + EPSILON) * authority


def place(*partition: str) -> Column:
    """1-based place by score, fusion and authority, earlier documents first on ties."""
    return F.row_number().over(Window.partitionBy(*partition).orderBy(F.desc("score"), F.desc("rrf"), F.desc("authority"), "insert_idx"))


def flag_rejects(ranked: DataFrame) -> DataFrame:
    """Sets ``reject_reason`` where ``tfidf`` lies below the run's cutoff; earlier reasons stay.

    A run in which nothing matches rejects nothing.
    """
    if "reject_reason" not in ranked.columns:
        ranked = ranked.withColumn("reject_reason", F.lit(None).cast("string"))
    top = F.max("tfidf").over(Window.partitionBy("run_id"))
    cut = F.greatest(F.lit(ABSOLUTE_CUT), RELATIVE_CUT * F.col("__top"))
    reason = F.format_string("TF-IDF %.2f below cutoff %.2f", F.col("tfidf"), cut)
    below = (F.col("__top") > 0) & (F.col("tfidf") < cut)
    return ranked.withColumn("__top", top).withColumn("reject_reason", F.when(below, reason).otherwise(F.col("reject_reason"))).drop("__top")


def final_rank(ranked: DataFrame) -> DataFrame:
    """Adds ``status`` and ``final_rank``, the place among the kept, null for the rejected."""
    kept = F.col("reject_reason").isNull()
    running = F.sum(F.when(kept, 1).otherwise(0)).over(Window.partitionBy("run_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("status", F.when(kept, "kept").otherwise("rejected")).withColumn("final_rank", F.when(kept, running.cast("int")))


def totals(ranked: DataFrame) -> DataFrame:
    """Documents, kept and rejected, of each run."""
    kept = F.count_if(F.col("reject_reason").isNull())
    return ranked.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"), kept.alias("kept"), (F.count(F.lit(1)) - kept).alias("rejected"))
