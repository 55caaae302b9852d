"""Fan-out of sub-queries over sources, caps, and set operations on sources."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelode.functions.display import COVERED, SOURCES


@dataclass
class RunRequest:
    """What a run is asked to do."""

    query: str
    sources: list[str] = field(default_factory=lambda: ["arxiv", "openalex"])
    per_source: int = 100
    max_total: int = 500
    concurrency: int = 8
    extract: bool = True
    semantic: bool = True
    llm_filter: bool = False
    citations: bool = True
    cross_run_reuse: bool = True


#: Search widths: results of each source, of a run, and downloads at once.
INTENSITY = {"light": (25, 75, 4), "balanced": (100, 500, 8), "deep": (250, 1500, 12), "exhaustive": (500, 4000, 16)}
# Sources that are only asked two things at a time.
GENTLE = ("meta_search", "searxng", "web", "semantic_scholar", "zenodo")
#: Stages that a quality setting turns on: semantic reranking, expansion and filtering by a model.
QUALITY = {"fast": (False, False, False), "balanced": (True, True, False), "thorough": (True, True, True)}


def intensity_of(per_source: int, max_total: int, concurrency: int) -> str | None:
    """Name of the width with these numbers."""
    return next((k for k, v in INTENSITY.items() if v == (per_source, max_total, concurrency)), None)


def wave_deadlines(max_total: Column) -> tuple[Column, Column]:
    """Seconds that the first and second wave of discovery may take."""
    first = F.least(F.lit(15) + F.floor(max_total / 40), F.lit(60))
    return first, F.least(F.greatest(F.lit(12) + F.floor(max_total / 50), F.lit(12)), F.lit(45))


def backend_timeout(limit: Column) -> Column:
    """Seconds that one web engine may take for so many results."""
    return F.least(F.greatest(F.lit(8) + F.floor(limit / 12), F.lit(8)), F.lit(20))


def effective_sources(requested: DataFrame) -> DataFrame:
    """``run_id, source_idx, source_id``: known sources, without those that the aggregator covers."""
    known = requested.where(F.col("source_id").isin(*SOURCES))
    has = F.max(F.col("source_id") == "meta_search").over(Window.partitionBy("run_id"))
    return known.withColumn("__meta", has).where(~F.col("__meta") | ~F.col("source_id").isin(*COVERED)).drop("__meta")


def unknown_sources(requested: DataFrame) -> DataFrame:
    """An error row for each source that isn't known."""
    return requested.where(~F.col("source_id").isin(*SOURCES)).select("run_id", "source_id", F.format_string("unknown source: %s", "source_id").alias("error"), F.lit("other").alias("kind"))


def fan_out(sub_queries: DataFrame, sources: DataFrame) -> DataFrame:
    """A task for each sub-query and source of a run: an equi-join on the run, no cross product."""
    return sub_queries.join(sources, "run_id")


def novel_extras(extras: DataFrame, base: DataFrame, text: str = "sub_query") -> DataFrame:
    """Sub-queries that the first wave doesn't have, letter case aside."""
    have = base.select("run_id", F.lower(text).alias("__have"))
    return extras.join(have, (extras["run_id"] == have["run_id"]) & (F.lower(extras[text]) == have["__have"]), "left_anti")


def arrival(results: DataFrame) -> DataFrame:
    """Adds ``arrival_seq``: by wave, sub-query, source and rank, the order in which a run takes them in."""
    w = Window.partitionBy("run_id").orderBy("wave", "sub_idx", "source_idx", "rank_in_source")
    return results.withColumn("arrival_seq", F.row_number().over(w).cast("long"))


def cap_per_source(results: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` results of each sub-query and source."""
    return results.where(F.col("rank_in_source") <= limit)


def cap_rows(df: DataFrame, partition: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def meta_union(engines: dict[str, DataFrame], key: Column, limit: int) -> DataFrame:
    """Results of several engines as one source: each capped, first of each address kept, relabelled."""
    out: DataFrame | None = None
    for name, df in engines.items():
        part = df.where(F.col("rank_in_source") <= max(limit, 8)).withColumn("source", F.lit(f"meta_search/{name}"))
        out = part if out is None else out.unionByName(part)
    first = F.row_number().over(Window.partitionBy(key).orderBy("arrival_seq"))
    out = out.withColumn("__first", first).where("__first = 1").drop("__first")
    return out.orderBy("arrival_seq").limit(limit)


def acceptable_instances(df: DataFrame) -> DataFrame:
    """Search instances that may be asked: plain network, good TLS, https, major version 1 or none given."""
    ok = F.coalesce(F.col("network_type"), F.lit("")).isin("", "normal") & F.col("tls_grade").isin("A", "A+") & F.lower("url").startswith("https://")
    major = F.try_to_number(F.regexp_extract(F.coalesce("version", F.lit("")), r"^(\d+)", 1), F.lit("999999"))
    return df.where(ok & (F.col("version").isNull() | (major >= 1)))


def choose_instances(instances: DataFrame, asked: DataFrame, health: DataFrame | None = None) -> DataFrame:
    """Which search instances each of ``asked`` (``run_id, seed``) goes to: ``run_id, turn, url``.

    A local instance (``local``) comes first, as turn 0; then two different ones of the rest, by
    the seed: instances stand in the order of their address, the first is the seed's remainder,
    the second so far on as its higher bits say. ``health`` (``url, open``) leaves out those whose
    breaker is open. With one instance there is no second; with none there are no rows.
    """
    rows = instances.select("url", F.coalesce("local", F.lit(False)).alias("local")).distinct()
    if health is not None:
        rows = rows.join(health.where("open").select("url").distinct(), "url", "left_anti")
    # instances are a public list of some hundreds; a run needs three of them by their number
    ranked = rows.where("not local").select("url", (F.row_number().over(Window.orderBy("url")) - 1).alias("at"))
    n = ranked.agg(F.count(F.lit(1)).alias("n"))
    seeds = asked.select("run_id", F.col("seed").cast("long").alias("seed")).crossJoin(F.broadcast(n)).where("n > 0")
    first = F.expr("pmod(seed, n)")
    second = F.expr("pmod(pmod(seed, n) + 1 + pmod(shiftright(seed, 8), n - 1), n)")
    picks = seeds.select("run_id", F.posexplode(F.when(F.col("n") > 1, F.array(first, second)).otherwise(F.array(first))).alias("turn", "at"))
    public = picks.join(F.broadcast(ranked), "at").select("run_id", (F.col("turn") + 1).alias("turn"), "url")
    local = asked.select("run_id").crossJoin(F.broadcast(rows.where("local").agg(F.min("url").alias("url")).where("url is not null")))
    return local.select("run_id", F.lit(0).alias("turn"), "url").unionByName(public)


def source_concurrency(source: Column) -> Column:
    """Requests that may be under way at a source at once."""
    return F.when(source.isin(*GENTLE), 2).otherwise(4)


def search_answer(results: DataFrame, query: Column, page: Column) -> DataFrame:
    """Answers of the search interface: ``status, number_of_results`` and the results, as it gives them.

    ``results`` has ``request`` and the scored results of it as an array ``results``. A blank query
    is a bad request (400) without results; pages past the first are empty.
    """
    blank = ~F.coalesce(query, F.lit("")).rlike(r"(?U)\S")
    empty = F.array().cast(results.schema["results"].dataType)
    out = results.withColumn("status", F.when(blank, 400).otherwise(200)).withColumn("results", F.when(blank | (page > 1), empty).otherwise(F.coalesce("results", empty)))
    return out.withColumn("number_of_results", F.size("results"))


def instance_scores(results: DataFrame) -> DataFrame:
    """Results as the search interface gives them: score one over rank, engine the source."""
    return results.select(F.col("title"), F.col("url"), F.col("source").alias("engine"), (1.0 / F.col("rank_in_source")).alias("score"))


#: Attempts in all, and the statuses that are worth another one.
ATTEMPTS, RETRIED = 3, (429, 502, 503, 504)


def retry_delays(status: Column, attempt: Column, retry_after: Column) -> Column:
    """Seconds before the attempt after ``attempt`` (from 1), without jitter; null if there is none.

    Only ``RETRIED`` statuses and transport errors (a null status) are tried again. The wait is
    what the server asks for, else by status, doubling unless it limits the rate; 8 at most.
    """
    own = F.when(status == 429, 5.0 * attempt).otherwise(F.pow(F.lit(2.0), attempt))
    asked = F.when(status.isNotNull(), retry_after.cast("double"))
    again = (attempt < ATTEMPTS) & (status.isNull() | status.isin(*RETRIED))
    return F.when(again, F.least(F.coalesce(asked, own), F.lit(8.0)))
