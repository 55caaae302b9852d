"""A session's tables: settings, source toggles, runs, the run's state after its events, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelode.functions.display import SOURCES, base_source_id
from citelode.operators.scan import scan

# Defaults of settings, and sources that the bulk toggles leave alone.
DEFAULTS = {"per_source": 100, "max_total": 500, "concurrency": 8}
DEFAULT_SOURCES = ("arxiv", "openalex")
QUALITIES = ("fast", "balanced", "thorough")
MAX_BODY = 16 * 1024 * 1024

#: What ends a run, and what moves a download.
ENDS, MOVES = ("complete", "cancelled"), ("download_started", "download_progress", "download_done", "download_failed")


def positive(value: Column, fallback: int) -> Column:
    """A number as a whole one if it is finite and above zero, else ``fallback``."""
    v = value.cast("double")
    fine = v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < float("inf"))
    return F.when(fine, F.floor(v)).otherwise(fallback).cast("long")


def known_sources(sources: Column, fallback: tuple[str, ...] = DEFAULT_SOURCES) -> Column:
    """The known ones of some sources; ``fallback`` if none is."""
    kept = F.filter(F.coalesce(sources, F.array().cast("array<string>")), lambda s: s.isin(*SOURCES))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(*[F.lit(s) for s in fallback]))


def quality(saved: Column, semantic: Column, expansion: Column, filtering: Column) -> Column:
    """A search's quality; settings older than it tell it by their flags."""
    own = F.when(saved.isin(*QUALITIES), saved).otherwise("balanced")
    on = lambda c: F.coalesce(c, F.lit(False))
    told = F.when(on(expansion) | on(filtering), "thorough").when(on(semantic), "balanced").when(semantic.isNotNull(), "fast").otherwise("balanced")
    return F.when(saved.isNotNull(), own).otherwise(told)


def sanitized(settings: DataFrame) -> DataFrame:
    """Settings as they are safe to use; ``settings`` has the saved ones, unusable ones included."""
    out = settings
    for name, fallback in DEFAULTS.items():
        out = out.withColumn(name, positive(F.col(name), fallback))
    told = quality(F.col("quality"), F.col("use_semantic"), F.col("use_expansion"), F.col("use_filter"))
    return out.withColumn("sources", known_sources(F.col("sources"))).withColumn("quality", told).drop("use_semantic", "use_expansion", "use_filter")


def enable_all(chosen: Column, bulk: Column) -> Column:
    """The chosen sources and all those that bulk toggles cover."""
    return F.array_union(chosen, bulk)


def disable_all(chosen: Column, primary: Column) -> Column:
    """The chosen sources without the primary ones."""
    return F.filter(chosen, lambda s: ~F.array_contains(primary, s))


def inverted(chosen: Column, bulk: Column) -> Column:
    """The chosen sources with those that bulk toggles cover turned over."""
    return F.concat(F.filter(F.array_distinct(chosen), lambda s: ~F.array_contains(bulk, s)), F.filter(bulk, lambda s: ~F.array_contains(chosen, s)))


def insert_runs(existing: DataFrame, incoming: DataFrame, library: str = "library") -> DataFrame:
    """``existing`` with further runs, their ids counted on within each library in the order of ``seq``."""
    last = existing.groupBy(library).agg(F.max("id").alias("__last"))
    number = F.row_number().over(Window.partitionBy(library).orderBy("seq"))
    fresh = incoming.withColumn("__n", number).join(last, library, "left").withColumn("id", F.coalesce("__last", F.lit(0)) + F.col("__n")).drop("__n", "__last", "seq")
    return existing.unionByName(fresh)


def bar_percent(running: Column, finished: Column, cancelled: Column, started: Column, done: Column, failed: Column, total: Column, count: Column, of: Column) -> Column:
    """Percent of a run's bar: downloads once they started, else the active stage; full when it ended unstopped."""
    share = lambda a, b: F.least(F.lit(100), F.floor(100.0 * a / b + 0.5)).cast("int")
    by_files = F.when(total > 0, share(done + failed, total)).otherwise(0)
    by_stage = F.when(F.coalesce(of, F.lit(0)) > 0, share(F.coalesce(count, F.lit(0)), of)).otherwise(by_files)
    return F.when(~running & finished & ~cancelled, 100).when(started, by_files).otherwise(by_stage)


def phase_label(running: Column, started: Column, stage: Column, count: Column, of: Column) -> Column:
    """What a run is doing before its downloads; null afterwards and when it does nothing."""
    named = F.when(F.coalesce(of, F.lit(0)) > 0, F.concat(stage, F.lit(" "), F.coalesce(count, F.lit(0)).cast("string"), F.lit("/"), of.cast("string"))).otherwise(F.concat(stage, F.lit("…")))
    return F.when(~started, F.when(stage.isNotNull(), named).when(running, F.lit("Working…")))


def capped(body: Column, most: int = MAX_BODY) -> Column:
    """A response's body, null where it is larger than may be read."""
    return F.when(F.octet_length(body) <= most, body)


def cached(entries: DataFrame, asked: DataFrame, ttl: float, keys: list[str], value: str = "value") -> DataFrame:
    """``asked`` (``keys, at``) with the latest entry (``keys, stored_at, value``) no older than ``ttl`` then; null where none is.

    An as-of join: both are one sequence for each key, in which every question sees the last
    entry before it. What is asked can only hit an entry of its own stretch of ``ttl`` or of the
    one before, so each entry stands in two stretches and a key with very many rows is dealt out
    over them. Of entries stored at once the greatest value counts; a null key hits nothing.
    """
    stretch = lambda c: F.floor(F.col(c) / ttl)
    entry = F.struct(F.col("stored_at").cast("double").alias("at"), F.col(value).alias("value"))
    stored = entries.where("stored_at is not null").select(*keys, F.explode(F.array(stretch("stored_at"), stretch("stored_at") + 1)).alias("__stretch"), F.col("stored_at").cast("double").alias("__t"), F.lit(0).alias("__asks"), entry.alias("__entry"))
    own = [c for c in asked.columns if c not in keys]
    asks = asked.select(*keys, stretch("at").alias("__stretch"), F.col("at").cast("double").alias("__t"), F.lit(1).alias("__asks"), F.struct(*own).alias("__own"))
    w = Window.partitionBy(*keys, "__stretch").orderBy("__t", "__asks", "__entry").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = stored.unionByName(asks, allowMissingColumns=True).withColumn("__last", F.last("__entry", ignorenulls=True).over(w)).where("__asks = 1")
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    fresh = known & (F.col("__t") - F.col("__last.at") < ttl)
    return seen.select(*[F.col(c) if c in keys else F.col("__own")[c].alias(c) for c in asked.columns], F.when(fresh, F.col("__last.value")).alias(value))


def reduce_run(events: DataFrame) -> DataFrame:
    """Each run's state after its events since the last ``start``: the latest word on each count, and how it ended.

    ``events`` has ``run_id, seq, type`` and, where their type tells them, ``url, source, kind,
    count, done, failed, total, kept, rejected, folder, message``. Types that say nothing of a
    count leave it; a ``found`` gives the running total in ``total``.
    """
    since = F.max(F.when(F.col("type") == "start", F.col("seq"))).over(Window.partitionBy("run_id"))
    live = events.withColumn("__since", F.coalesce(since, F.lit(-1))).where(F.col("seq") >= F.col("__since"))

    def last(column: str, *types: str) -> Column:
        told = F.col("type").isin(*types) & F.col(column).isNotNull()
        return F.max_by(F.when(told, F.col(column)), F.when(told, F.col("seq")))

    files = ("download_done", "download_failed", *ENDS)
    flow = F.when(F.col("type").isin("start", "error", *ENDS), F.col("type"))
    per = live.groupBy("run_id").agg(
        F.max_by(flow, F.when(flow.isNotNull(), F.col("seq"))).alias("flow"),
        F.coalesce(last("total", "found"), F.lit(0)).alias("found"),
        F.coalesce(F.max_by(F.when(F.col("type") == "found_total", F.col("count")).when(F.col("type").isin(*files), F.col("total")), F.when(F.col("type").isin("found_total", *files), F.col("seq"))), F.lit(0)).alias("total"),
        *[F.coalesce(last(c, *files), F.lit(0)).alias(c) for c in ("done", "failed")],
        *[F.coalesce(last(c, "ranking_done"), F.lit(0)).alias(c) for c in ("kept", "rejected")],
        F.max(F.col("type") == "ranking_done").alias("ranked"),
        last("folder", *ENDS).alias("folder"),
        last("message", "error").alias("__message"),
        F.count_distinct(F.when(F.col("type") == "candidate", F.col("url"))).alias("candidates"),
        F.count_distinct(F.when(F.col("type") == "source_error", F.struct("source", "kind"))).alias("issues"),
        F.max(F.when(F.col("type").isin("error", *ENDS), F.col("seq"))).alias("__cleared"),
    )
    moves = live.where(F.col("type").isin("download_started", "download_done", "download_failed")).groupBy("run_id", "url").agg(F.max_by("type", "seq").alias("type"), F.max("seq").alias("seq"))
    flying = moves.where("type = 'download_started'").join(per.select("run_id", "__cleared"), "run_id").where("__cleared is null or seq > __cleared").groupBy("run_id").agg(F.count(F.lit(1)).alias("active"))
    out = per.join(flying, "run_id", "left").fillna(0, ["active"])
    out = out.withColumn("running", F.coalesce(F.col("flow") == "start", F.lit(False))).withColumn("cancelled", F.coalesce(F.col("flow") == "cancelled", F.lit(False)))
    return out.withColumn("fatal_error", F.when(F.col("flow") == "error", F.col("__message"))).drop("flow", "__message", "__cleared")


def source_states(events: DataFrame, run_sources: Column) -> DataFrame:
    """Each source's ``status, hits, active`` after a run's events, ``run_id, seq, type, source``.

    A source is querying while a task of it runs, then done, or in error if it gave an error and
    nothing else. The end of discovery (``found_total``) ends all that still query. Engines of the
    aggregator count as it. A source's events stream through in order.
    """
    kinds = ("source_start", "source_done", "source_error", "found")
    own = F.when(F.col("type") == "found", base_source_id(F.col("source"), run_sources)).otherwise(F.col("source"))
    moves = events.where(F.col("type").isin(*kinds)).select("run_id", own.alias("source"), "seq", "type")
    over = events.where("type = 'found_total'").select("run_id", "seq", "type").join(moves.select("run_id", "source").distinct(), "run_id").select("run_id", "source", "seq", "type")

    def step(state: tuple[str, int, int], kind: str) -> tuple[tuple[str, int, int], tuple[str, int, int]]:
        status, hits, active = state
        bad = status == "error"
        if kind == "source_start":
            status, active = "querying", active + 1
        elif kind == "source_error":
            status = "error"
        elif kind == "found_total":
            status, active = "done" if status == "querying" else status, 0
        else:
            active = max(active - 1, 0) if kind == "source_done" else active
            heard = kind == "found" or active > 0
            status = "error" if bad and (heard or hits == 0) else "querying" if heard else "done"
            hits += kind == "found"
        return (status, hits, active), (status, hits, active)

    rows = scan(moves.unionByName(over), ["run_id", "source"], ["seq", "type"], ["type"], "status string, hits long, active long", lambda: ("idle", 0, 0), step)
    last = rows.groupBy("run_id", "source").agg(F.max(F.struct("seq", "type", "status", "hits", "active")).alias("s"))
    return last.select("run_id", "source", "s.status", "s.hits", "s.active")
