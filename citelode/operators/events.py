"""Folds of run events: issues, lanes, bytes, throughput, the breaker and the run's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelode.functions.display import base_source_id, ftype_from_path, lane_key
from citelode.operators.scan import scan

OPEN_AFTER, OPEN_FOR = 3, 300.0
TICK, SAMPLES = 0.6, 32
ISSUES, LOG_ROWS, COMPLETED, SHOWN = 50, 200, 8000, 40


def source_issues(errors: DataFrame, most: int = ISSUES) -> DataFrame:
    """Errors by run, source and kind: count, latest message and time; the last ``most`` kinds to appear."""
    out = errors.groupBy("run_id", "source", "kind").agg(F.count(F.lit(1)).alias("count"), F.max_by("error", "seq").alias("error"), F.min("seq").alias("__first"), F.max("ts").alias("ts"))
    n = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("__first")))
    return out.withColumn("__n", n).where(F.col("__n") <= most).drop("__n", "__first")


def task_errors(errors: DataFrame, scrapers: tuple[str, ...]) -> DataFrame:
    """One error of each kind from each sub-query and source; scrapers' parse errors are left out."""
    shown = errors.where(~(F.col("source").isin(*scrapers) & (F.col("kind") == "parse_error")))
    first = F.row_number().over(Window.partitionBy("run_id", "sub_idx", "source", "kind").orderBy("seq"))
    return shown.withColumn("__n", first).where("__n = 1").drop("__n")


def latest_health(health: DataFrame) -> DataFrame:
    """Latest status, results and latency of each engine."""
    last = F.max_by(F.struct("status", "result_count", "latency_ms"), F.struct("ts", "seq")).alias("h")
    return health.groupBy("backend").agg(last).select("backend", "h.*")


def new_per_source(outcomes: DataFrame) -> DataFrame:
    """New documents from each source and sub-query; copies count for nothing."""
    return outcomes.groupBy("run_id", "source", "sub_idx").agg(F.count_if(F.col("outcome") == "new").alias("new_docs"))


def source_stats(hits: DataFrame, run_sources: Column) -> DataFrame:
    """Hits of each enabled source."""
    return hits.groupBy("run_id", base_source_id(F.col("source"), run_sources).alias("source")).agg(F.sum("count").alias("hits"))


def lanes(rows: DataFrame, run_sources: Column) -> DataFrame:
    """Found, done and in-flight documents of each lane; ``rows`` has ``source, state``."""
    count = lambda state: F.count_if(F.col("state") == state).alias(state)
    return rows.groupBy("run_id", lane_key(F.col("source"), run_sources).alias("lane")).agg(count("found"), count("done"), count("inflight"))


def run_counters(completed: DataFrame) -> DataFrame:
    """Done, failed, all, and the share finished in percent, of each run."""
    done, failed = F.count_if(F.col("status") == "done"), F.count_if(F.col("status") == "failed")
    pct = F.when(F.count(F.lit(1)) > 0, F.round(100 * (done + failed) / F.count(F.lit(1)))).otherwise(0).cast("int")
    return completed.groupBy("run_id").agg(done.alias("done"), failed.alias("failed"), F.count(F.lit(1)).alias("total"), pct.alias("pct"))


def filetype_counts(completed: DataFrame) -> DataFrame:
    """Done documents by file type; types without any count zero."""
    kinds = completed.sparkSession.createDataFrame([(k,) for k in ("pdf", "epub", "html", "txt")], "ftype string")
    n = completed.where("status = 'done'").select(ftype_from_path(F.col("local_path")).alias("ftype")).where("ftype is not null").groupBy("ftype").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(kinds).join(n, "ftype", "left").fillna(0, ["n"])


def no_text(completed: DataFrame) -> DataFrame:
    """Done documents of each run whose text couldn't be extracted."""
    return completed.groupBy("run_id").agg(F.count_if((F.col("status") == "done") & F.col("extract_error").isNotNull()).alias("no_text"))


def diagnosis(runs: DataFrame) -> DataFrame:
    """Why a finished run has nothing: ``no_results``, ``cancelled_empty``, ``all_off_topic`` or null."""
    none = F.col("saved") == 0
    why = F.when(none & F.col("cancelled"), "cancelled_empty").when(none & (F.col("found") == 0), "no_results").when(none & (F.col("found") > 0) & (F.col("kept") == 0), "all_off_topic")
    return runs.withColumn("diagnosis", why)


def reconcile_bytes(progress: DataFrame) -> DataFrame:
    """Bytes that each run moved: a finished file's size unless cached, a running one's largest report, none of a failed one.

    ``progress`` has ``run_id, url, seq, status, bytes, cached``.
    """
    per = progress.groupBy("run_id", "url").agg(F.max_by(F.struct("status", "bytes", "cached"), "seq").alias("last"), F.max(F.when(F.col("status") == "progress", F.col("bytes"))).alias("most"))
    moved = F.when(F.col("last.status") == "done", F.when(F.col("last.cached"), 0).otherwise(F.col("last.bytes"))).when(F.col("last.status") == "progress", F.col("most")).otherwise(0)
    return per.groupBy("run_id").agg(F.sum(F.greatest(moved, F.lit(0))).alias("bytes"))


def throttle(progress: DataFrame, gap_ms: int = 200) -> DataFrame:
    """Reports at least ``gap_ms`` after the last one of the same file that was let through, and all final ones.

    A file's first report passes, and a final one counts as let through. ``progress`` has
    ``run_id, url, seq, ms, status``. A file's reports stream through in order.
    """

    def step(last: int | None, ms: int, status: str) -> tuple[int | None, tuple[bool]]:
        goes = status != "progress" or last is None or ms - last >= gap_ms
        return (ms if goes else last), (goes,)

    return scan(progress, ["run_id", "url"], ["seq"], ["ms", "status"], "__goes boolean", lambda: None, step).where("__goes").drop("__goes")


def throughput(samples: DataFrame) -> DataFrame:
    """MB a second in each 0.6 s tick of a run, and the mean of the last 32 ticks that were sampled.

    ``samples`` has ``run_id, seconds`` (from the start) and ``bytes`` moved then.
    """
    tick = F.floor(F.col("seconds") / TICK).cast("long")
    per = samples.groupBy("run_id", tick.alias("tick")).agg((F.sum("bytes") / (1e6 * TICK)).alias("mbps"))
    w = Window.partitionBy("run_id").orderBy("tick").rowsBetween(-(SAMPLES - 1), 0)
    return per.withColumn("avg_mbps", F.avg("mbps").over(w))


def eta_seconds(total: Column, done: Column, failed: Column, bytes_moved: Column, network_done: Column, avg_mbps: Column) -> Column:
    """Seconds to go; null with nothing left or no speed."""
    left = F.greatest(total - done - failed, F.lit(0))
    size = F.when(network_done > 0, F.greatest(F.lit(0.1), bytes_moved / 1e6 / network_done)).otherwise(2.0)
    return F.when((left > 0) & (avg_mbps > 0), F.floor(left * size / avg_mbps + 0.5).cast("long"))


def breaker_step(failures: int, until: float, ts: float, outcome: str) -> tuple[int, float, bool]:
    """One event of an engine's breaker: failures in a row, when it closes, whether the call was skipped."""
    if ts < until:
        return failures, until, True
    if outcome == "success":
        return 0, 0.0, False
    if outcome == "failure":
        failures += 1
        return failures, ts + OPEN_FOR if failures >= OPEN_AFTER else until, False
    return failures, until, False


#: Calls of an engine, by ``seq``, that one window looks at.
STRETCH = 100_000


def _segments(calls: DataFrame, width: int) -> DataFrame:
    """``calls`` with ``__segment``: an engine's calls, cut where its breaker is surely closed and reset.

    That is at a success more than 300 s after all failures before it: it can't have been
    skipped. Failures are looked up within stretches of ``seq`` and by one row for each stretch
    before, so an engine with very many calls is no single window.
    """
    rows = calls.withColumn("__stretch", F.floor(F.col("seq") / width).cast("long"))
    within = Window.partitionBy("backend", "__stretch").orderBy("seq")
    failed = F.when(F.col("outcome") == "failure", F.col("ts"))
    earlier = Window.partitionBy("backend").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    known = rows.groupBy("backend", "__stretch").agg(F.max(failed).alias("__f")).select("backend", "__stretch", F.max("__f").over(earlier).alias("__before"))
    rows = rows.join(known, ["backend", "__stretch"])
    last = F.greatest("__before", F.max(failed).over(within.rowsBetween(Window.unboundedPreceding, -1)))
    sure = (F.col("outcome") == "success") & (last.isNull() | (F.col("ts") - last >= OPEN_FOR))
    # a segment is named by the call that begins it
    rows = rows.withColumn("__begins", F.when(sure, F.col("seq")))
    known = rows.groupBy("backend", "__stretch").agg(F.max("__begins").alias("__b")).select("backend", "__stretch", F.max("__b").over(earlier).alias("__begun"))
    begins = F.max("__begins").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("__begins", begins).join(known, ["backend", "__stretch"]).withColumn("__segment", F.coalesce("__begins", "__begun"))


def circuit_breaker(calls: DataFrame, width: int = STRETCH) -> DataFrame:
    """Each engine's calls in order with the breaker's state after them: ``failures, open, skipped``.

    Three failures in a row open it for 300 s, in which calls are skipped and change nothing;
    neutral outcomes don't count. ``calls`` has ``backend, seq, ts`` (seconds) and ``outcome``,
    ``seq`` distinct within an engine. An engine's calls are cut into segments that begin with a
    closed breaker and are folded apart, each streaming through in order.
    """

    def step(state: tuple[int, float], ts: float, outcome: str) -> tuple[tuple[int, float], tuple]:
        failures, until, skipped = breaker_step(*state, ts, outcome)
        return (failures, until), (failures, ts < until, skipped)

    rows = _segments(calls.select("backend", "seq", "ts", "outcome"), width).select("backend", F.col("seq").cast("long").alias("seq"), "__segment", "ts", "outcome")
    out = scan(rows, ["backend", "__segment"], ["seq"], ["ts", "outcome"], "failures long, open boolean, skipped boolean", lambda: (0, 0.0), step)
    return out.select("backend", "seq", "failures", "open", "skipped")


def call_outcome(count: Column, timed_out: Column, rate_limited: Column, error: Column) -> tuple[Column, Column]:
    """Status of an engine's call, and what it means to the breaker."""
    status = F.when(timed_out & (count == 0), "timeout").when(timed_out, "partial").when((count == 0) & rate_limited, "throttled").when((count == 0) & error, "error").when(count == 0, "empty").otherwise("ok")
    return status, F.when(status.isin("timeout", "error"), "failure").when(status == "ok", "success").otherwise("neutral")


TRANSITIONS = {"start": "querying", "ranking_done": "downloading", "complete": "done", "cancelled": "done", "failed": "error"}


def run_state(events: DataFrame) -> DataFrame:
    """Each run's phase after its events, with found, done, failed and active documents.

    ``events`` has ``run_id, seq, type``; a start resets the counts, an error stays until the next
    start. Only events that change the state matter, so each run is a few aggregates over the
    rows since its last start.
    """
    run = Window.partitionBy("run_id")
    since = F.max(F.when(F.col("type") == "start", F.col("seq"))).over(run)
    live = events.withColumn("__start", F.coalesce(since, F.lit(-1))).where(F.col("seq") >= F.col("__start"))
    names = F.create_map(*[F.lit(x) for pair in TRANSITIONS.items() for x in pair])
    phase = F.try_element_at(names, F.col("type"))
    failed_once = F.max(F.col("type") == "failed")
    count = lambda t: F.count_if(F.col("type") == t)
    return live.groupBy("run_id").agg(
        F.when(failed_once, "error").otherwise(F.coalesce(F.max_by(F.when(phase.isNotNull(), phase), F.when(phase.isNotNull(), F.col("seq"))), F.lit("idle"))).alias("phase"),
        count("found").alias("found"),
        count("download_done").alias("done"),
        count("download_failed").alias("failed"),
        F.greatest(count("download_start") - count("download_done") - count("download_failed"), F.lit(0)).alias("active"),
    )


def stage_state(stages: DataFrame, order: list[str]) -> DataFrame:
    """Latest state of each stage, and of each run the last stage in ``order`` that is under way."""
    latest = stages.groupBy("run_id", "stage").agg(F.max_by("state", "seq").alias("state"))
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("stage"))
    running = F.col("state").isin("started", "progress")
    active = F.max_by("stage", F.when(running, place)).over(Window.partitionBy("run_id"))
    return latest.withColumn("active", active)


def issue_feed(issues: DataFrame, completed: DataFrame) -> DataFrame:
    """Source issues, failed documents and those without text, as one list."""
    a = issues.select("run_id", F.lit("source").alias("type"), F.col("source").alias("subject"), F.col("error").alias("message"))
    b = completed.where("status = 'failed'").select("run_id", F.lit("failed").alias("type"), F.col("title").alias("subject"), F.col("error").alias("message"))
    c = completed.where("status = 'done' and extract_error is not null").select("run_id", F.lit("not_indexed").alias("type"), F.col("title").alias("subject"), F.col("extract_error").alias("message"))
    return a.unionByName(b).unionByName(c)


def newest(df: DataFrame, partition: list[str], order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each group."""
    w = Window.partitionBy(*partition).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def runlog_tail(log: DataFrame, n: int) -> DataFrame:
    """The last ``n`` entries of a log, in order."""
    return log.orderBy(F.desc("ts"), F.desc("seq")).limit(n).orderBy("ts", "seq")
