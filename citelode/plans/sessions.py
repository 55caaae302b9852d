"""Registered queries of sessions, sources and messages, each with its DuckDB SQL; see ``registry``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelode import commands
from citelode.functions import content, display, query, text, urls
from citelode.operators import discovery, events, library, rerank, session
from citelode.plans import candidates, registry
from citelode.plans.registry import _discoveries, _errors, _KEYWORDS, _micros, register, table
from citelode.sources import document_sink, live, scholarly, web


def pick(values: tuple, n: Column) -> Column:
    """The n-th of some values, counted round."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def sql_pick(values: tuple, n: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else "NULL" if v is None else str(v) for v in values)
    return f"list_value({quoted})[CAST({n} % {len(values)} AS INT) + 1]"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


# --- settings and toggles -----------------------------------------------------------------------

_NUMBERS, _SAVED, _FLAGS = (25.7, 0, -3, None, 1500), ("fast", "thorough", "odd", None, None, None, None), (True, False, None)
_SQL_SOURCES = ", ".join(f"'{s}'" for s in display.SOURCES)


@register(f"""WITH s AS (SELECT event_id, {sql_pick(_NUMBERS, 'event_id')} AS n, {sql_pick(_SAVED, 'event_id')} AS q, {sql_pick(_FLAGS, 'event_id // 7')} AS sem, {sql_pick(_FLAGS, 'event_id // 21')} AS ex, {sql_pick(_FLAGS, 'event_id // 63')} AS fi,
  list_filter([{sql_pick((*display.SOURCES, 'odd'), 'event_id')}, 'other'], lambda x: x IN ({_SQL_SOURCES})) AS src FROM events)
SELECT event_id, CAST(CASE WHEN n > 0 THEN floor(n) ELSE 100 END AS BIGINT) AS per_source, CAST(CASE WHEN n > 0 THEN floor(n) ELSE 500 END AS BIGINT) AS max_total, CAST(CASE WHEN n > 0 THEN floor(n) ELSE 8 END AS BIGINT) AS concurrency,
  CASE WHEN len(src) > 0 THEN src ELSE ['arxiv', 'openalex'] END AS sources,
  CASE WHEN q IS NOT NULL THEN CASE WHEN q IN ('fast', 'balanced', 'thorough') THEN q ELSE 'balanced' END WHEN coalesce(ex, false) OR coalesce(fi, false) THEN 'thorough' WHEN sem THEN 'balanced' WHEN NOT sem THEN 'fast' ELSE 'balanced' END AS quality FROM s""")
def q_settings(spark, sf_dir):
    """Saved settings made safe to use, older ones told by their flags."""
    e = F.col("event_id")
    n = pick(_NUMBERS, e).cast("double")
    flag = lambda k: pick(_FLAGS, F.floor(e / k))
    s = _events(spark, sf_dir).select(
        "event_id", n.alias("per_source"), n.alias("max_total"), n.alias("concurrency"), F.array(pick((*display.SOURCES, "odd"), e), F.lit("other")).alias("sources"),
        pick(_SAVED, e).alias("quality"), flag(7).alias("use_semantic"), flag(21).alias("use_expansion"), flag(63).alias("use_filter"),
    )
    return session.sanitized(s)


@register("""WITH s AS (SELECT event_id, list_filter(['arxiv', 'doaj', 'zenodo', 'web'], lambda x, i: (event_id >> (i - 1)) % 2 = 1) AS c FROM events)
SELECT event_id, list_sort(list_distinct(list_concat(c, ['arxiv', 'doaj', 'bing']))) AS all_on, list_sort(list_filter(c, lambda x: x NOT IN ('arxiv', 'zenodo'))) AS off,
  list_sort(list_concat(list_filter(c, lambda x: x NOT IN ('arxiv', 'doaj', 'bing')), list_filter(['arxiv', 'doaj', 'bing'], lambda x: NOT list_contains(c, x)))) AS turned FROM s""")
def q_bulk_sources(spark, sf_dir):
    """Chosen sources after the bulk toggles."""
    chosen = F.filter(F.array(*[F.lit(x) for x in ("arxiv", "doaj", "zenodo", "web")]), lambda x, i: F.expr("event_id").cast("long").bitwiseAND(F.pow(F.lit(2), i).cast("long")) > 0)
    bulk, primary = F.array(*[F.lit(x) for x in ("arxiv", "doaj", "bing")]), F.array(F.lit("arxiv"), F.lit("zenodo"))
    e = _events(spark, sf_dir).select("event_id", chosen.alias("c"))
    c = F.col("c")
    return e.select("event_id", F.sort_array(session.enable_all(c, bulk)).alias("all_on"), F.sort_array(session.disable_all(c, primary)).alias("off"), F.sort_array(session.inverted(c, bulk)).alias("turned"))


@register("SELECT CASE WHEN item_id % 3 = 0 THEN '' WHEN item_id % 3 = 1 THEN '!?' ELSE text END AS q, item_id, item_id % 3 = 2 AND regexp_matches(text, '[\\pL\\pN]{2,}') AND item_id % 2 > 0 AS ok FROM benchmark")
def q_request_valid(spark, sf_dir):
    """Which requests can be run."""
    k = F.col("item_id") % 3
    q = F.when(k == 0, "").when(k == 1, "!?").otherwise(F.col("text"))
    return table(spark, sf_dir, "benchmark").select(q.alias("q"), "item_id", query.is_valid_request(q, F.col("item_id") % 2).alias("ok"))


# --- runs and their events ----------------------------------------------------------------------


@register("""WITH o AS (SELECT o_orderkey, o_custkey % 20 AS library, o_orderpriority AS query FROM orders), old AS (SELECT library, 10 * row_number() OVER (PARTITION BY library ORDER BY o_orderkey) AS id, query, o_orderkey FROM o WHERE o_orderkey % 4 = 0),
fresh AS (SELECT o.library, coalesce((SELECT max(id) FROM old WHERE old.library = o.library), 0) + row_number() OVER (PARTITION BY o.library ORDER BY o_orderkey) AS id, query, o_orderkey FROM o WHERE o_orderkey % 4 <> 0)
SELECT * FROM old UNION ALL SELECT * FROM fresh""")
def q_insert_runs(spark, sf_dir):
    """Runs of libraries, ids counted on for each new one."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("library"), F.col("o_orderpriority").alias("query"), "o_orderkey")
    old = o.where("o_orderkey % 4 = 0").withColumn("id", (10 * F.row_number().over(Window.partitionBy("library").orderBy("o_orderkey"))).cast("long"))
    return session.insert_runs(old, o.where("o_orderkey % 4 <> 0").withColumn("seq", F.col("o_orderkey"))).select("library", "id", "query", "o_orderkey")


_TYPES = ("found", "download_started", "source_error", "found", "download_done", "candidate", "download_failed", "ranking_done", "found_total", "found", "complete", "download_started", "error", "start", "cancelled", "candidate", "download_progress")


def _run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all types, one run for each user."""
    e, n = F.col("event_id"), F.col("n")
    return _events(spark, sf_dir).withColumn("n", F.floor(F.col("value") * 10).cast("long")).select(
        F.col("user_id").alias("run_id"), e.alias("seq"), pick(_TYPES, F.floor(e / 3) + n).alias("type"), F.concat(F.lit("u"), (e % 11).cast("string")).alias("url"), pick(("arxiv", "doaj", "meta_search/bing"), e).alias("source"),
        pick(("timeout", "other"), n).alias("kind"), n.alias("count"), (n % 7).alias("done"), (n % 5).alias("failed"), (n % 50).alias("total"), (n % 9).alias("kept"), (n % 4).alias("rejected"), F.concat(F.lit("f"), (n % 3).cast("string")).alias("folder"), F.concat(F.lit("m"), (n % 8).cast("string")).alias("message"),
    )


_RUN_EVENTS_SQL = f"""ev AS (SELECT user_id AS run_id, event_id AS seq, CAST(floor(value * 10) AS BIGINT) AS n, 'u' || event_id % 11 AS url, {sql_pick(('arxiv', 'doaj', 'meta_search/bing'), 'event_id')} AS source FROM events),
typed AS (SELECT *, {sql_pick(_TYPES, '(seq // 3 + n)')} AS type, {sql_pick(('timeout', 'other'), 'n')} AS kind FROM ev)"""


@register(f"""WITH {_RUN_EVENTS_SQL}, l AS (SELECT * FROM typed QUALIFY seq >= coalesce(max(seq) FILTER (type = 'start') OVER (PARTITION BY run_id), -1)),
p AS (SELECT run_id, arg_max(type, seq) FILTER (type IN ('start', 'error', 'complete', 'cancelled')) AS flow, coalesce(arg_max(n % 50, seq) FILTER (type = 'found'), 0) AS found,
  coalesce(arg_max(CASE WHEN type = 'found_total' THEN n ELSE n % 50 END, seq) FILTER (type IN ('found_total', 'download_done', 'download_failed', 'complete', 'cancelled')), 0) AS total,
  coalesce(arg_max(n % 7, seq) FILTER (type IN ('download_done', 'download_failed', 'complete', 'cancelled')), 0) AS done, coalesce(arg_max(n % 5, seq) FILTER (type IN ('download_done', 'download_failed', 'complete', 'cancelled')), 0) AS failed,
  coalesce(arg_max(n % 9, seq) FILTER (type = 'ranking_done'), 0) AS kept, coalesce(arg_max(n % 4, seq) FILTER (type = 'ranking_done'), 0) AS rejected, bool_or(type = 'ranking_done') AS ranked,
  'f' || arg_max(n % 3, seq) FILTER (type IN ('complete', 'cancelled')) AS folder, 'm' || arg_max(n % 8, seq) FILTER (type = 'error') AS message, count(DISTINCT url) FILTER (type = 'candidate') AS candidates,
  count(DISTINCT source || kind) FILTER (type = 'source_error') AS issues, max(seq) FILTER (type IN ('error', 'complete', 'cancelled')) AS cleared FROM l GROUP BY run_id),
f AS (SELECT run_id, url, arg_max(type, seq) AS type, max(seq) AS seq FROM l WHERE type IN ('download_started', 'download_done', 'download_failed') GROUP BY run_id, url)
SELECT run_id, found, total, done, failed, kept, rejected, ranked, folder, candidates, issues, (SELECT count(*) FROM f WHERE f.run_id = p.run_id AND type = 'download_started' AND (cleared IS NULL OR f.seq > cleared)) AS active,
  coalesce(flow = 'start', false) AS running, coalesce(flow = 'cancelled', false) AS cancelled, CASE WHEN flow = 'error' THEN message END AS fatal_error FROM p""")
def q_run_reduce(spark, sf_dir):
    """State of each run after events of all types."""
    return session.reduce_run(_run_events(spark, sf_dir))


_SOURCE_TYPES = ("source_start", "found", "source_done", "found", "source_error", "source_start", "found", "found_total", "source_done", "keywords")


@register(f"""WITH RECURSIVE ev AS (SELECT user_id AS run_id, event_id AS seq, {sql_pick(_SOURCE_TYPES, '(event_id // 3 + CAST(floor(value) AS BIGINT))')} AS type, {sql_pick(('arxiv', 'doaj', 'meta_search/bing', 'meta_search'), 'event_id')} AS source FROM events),
m AS (SELECT run_id, CASE WHEN type = 'found' AND source LIKE 'meta_search%' THEN 'meta_search' ELSE source END AS source, seq, type FROM ev WHERE type IN ('source_start', 'source_done', 'source_error', 'found')),
a AS (SELECT * FROM m UNION ALL SELECT d.run_id, d.source, e.seq, e.type FROM ev e JOIN (SELECT DISTINCT run_id, source FROM m) d USING (run_id) WHERE e.type = 'found_total'),
o AS (SELECT *, row_number() OVER (PARTITION BY run_id, source ORDER BY seq) AS k, count(*) OVER (PARTITION BY run_id, source) AS n FROM a),
s AS (SELECT DISTINCT run_id, source, CAST(0 AS BIGINT) AS k, n, 'idle' AS status, CAST(0 AS BIGINT) AS hits, CAST(0 AS BIGINT) AS active FROM o
  UNION ALL SELECT run_id, source, k, n, CASE WHEN type = 'source_start' THEN 'querying' WHEN type = 'source_error' THEN 'error' WHEN type = 'found_total' THEN CASE WHEN status = 'querying' THEN 'done' ELSE status END
      WHEN status = 'error' AND (type = 'found' OR active > 0 OR hits = 0) THEN 'error' WHEN type = 'found' OR active > 0 THEN 'querying' ELSE 'done' END, hits, active
    FROM (SELECT o.run_id, o.source, o.k, o.n, o.type, s.status, s.hits + CAST(o.type = 'found' AS BIGINT) AS hits,
      CASE o.type WHEN 'source_start' THEN s.active + 1 WHEN 'source_done' THEN greatest(s.active - 1, 0) WHEN 'found_total' THEN 0 ELSE s.active END AS active FROM s JOIN o ON o.run_id = s.run_id AND o.source = s.source AND o.k = s.k + 1))
SELECT run_id, source, status, hits, active FROM s WHERE k = n""")
def q_source_states(spark, sf_dir):
    """State of each source of a run after its events."""
    e = F.col("event_id")
    moves = _events(spark, sf_dir).select(F.col("user_id").alias("run_id"), e.alias("seq"), pick(_SOURCE_TYPES, F.floor(e / 3) + F.floor("value")).alias("type"), pick(("arxiv", "doaj", "meta_search/bing", "meta_search"), e).alias("source"))
    return session.source_states(moves, F.array(F.lit("arxiv"), F.lit("meta_search")))


@register("""WITH o AS (SELECT o_orderkey, o_custkey % 3 = 0 AS running, o_custkey % 4 > 0 AS finished, o_custkey % 5 = 0 AS cancelled, o_orderkey % 2 = 0 AS started, o_orderkey % 40 AS done, o_orderkey % 9 AS failed, o_custkey % 60 AS total, o_orderkey % 70 AS count, o_custkey % 80 AS of_, CASE WHEN o_orderkey % 6 > 0 THEN 'Ranking' END AS stage FROM orders),
b AS (SELECT *, CASE WHEN total > 0 THEN CAST(least(100, floor(100.0 * (done + failed) / total + 0.5)) AS INT) ELSE 0 END AS files FROM o)
SELECT o_orderkey, CASE WHEN NOT running AND finished AND NOT cancelled THEN 100 WHEN started THEN files WHEN of_ > 0 THEN CAST(least(100, floor(100.0 * count / of_ + 0.5)) AS INT) ELSE files END AS pct,
  CASE WHEN NOT started THEN CASE WHEN stage IS NOT NULL THEN CASE WHEN of_ > 0 THEN stage || ' ' || count || '/' || of_ ELSE stage || '…' END WHEN running THEN 'Working…' END END AS label FROM b""")
def q_progress(spark, sf_dir):
    """Bar and label of made-up runs."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    running, finished, cancelled, started = c % 3 == 0, c % 4 > 0, c % 5 == 0, k % 2 == 0
    pct = session.bar_percent(running, finished, cancelled, started, k % 40, k % 9, c % 60, k % 70, c % 80)
    return table(spark, sf_dir, "orders").select("o_orderkey", pct.alias("pct"), session.phase_label(running, started, F.when(k % 6 > 0, "Ranking"), k % 70, c % 80).alias("label"))


@register("""WITH e AS (SELECT event_type AS key, epoch_us(ts) / 1e6 AS t, event_id, user_id FROM events), s AS (SELECT * FROM e WHERE event_id % 3 = 0), a AS (SELECT * FROM e WHERE event_id % 3 = 1)
SELECT a.event_id, (SELECT arg_max(s.event_id, s.t) FROM s WHERE s.key = a.key AND s.user_id = a.user_id AND s.t <= a.t AND a.t - s.t < 86400) AS value FROM a""")
def q_ttl_cache(spark, sf_dir):
    """The latest entry of a key that is less than a day old when it is asked for."""
    e = _events(spark, sf_dir).select(F.col("event_type").alias("key"), "user_id", (_micros("ts") / 1e6).alias("t"), "event_id")
    stored = e.where("event_id % 3 = 0").select("key", "user_id", F.col("t").alias("stored_at"), F.col("event_id").alias("value"))
    asked = e.where("event_id % 3 = 1").select("key", "user_id", F.col("t").alias("at"), "event_id")
    return session.cached(stored, asked, 86400.0, ["key", "user_id"]).select("event_id", "value")


_KIND_ROW = "QUALIFY row_number() OVER (PARTITION BY run_id, sub_idx, source, kind ORDER BY seq) = 1"


@register(f"""WITH e AS (SELECT user_id AS run_id, event_id % 3 AS sub_idx, {sql_pick(display.SOURCES, 'event_id // 8')} AS source, event_id AS seq, {sql_pick(('rate_limit', 'forbidden', 'server_error', 'timeout', 'parse_error', 'other', 'forbidden', 'timeout'), 'event_id')} AS kind FROM events)
SELECT run_id, sub_idx, source, kind, seq FROM e WHERE NOT (source IN ('bing', 'brave') AND kind = 'parse_error') {_KIND_ROW}""")
def q_task_errors(spark, sf_dir):
    """One error of each kind from each task, without scrapers' parse errors."""
    e = _errors(spark, sf_dir).withColumn("sub_idx", F.col("seq") % 3)
    return events.task_errors(e, ("bing", "brave")).select("run_id", "sub_idx", "source", "kind", "seq")


@register("SELECT user_id AS run_id, event_type AS source, event_id % 4 AS sub_idx, count(*) FILTER (value > 10) AS new_docs FROM events GROUP BY ALL")
def q_new_per_source(spark, sf_dir):
    """New documents from each source and sub-query."""
    o = _events(spark, sf_dir).select(F.col("user_id").alias("run_id"), F.col("event_type").alias("source"), (F.col("event_id") % 4).alias("sub_idx"), F.when(F.col("value") > 10, "new").otherwise("copy").alias("outcome"))
    return events.new_per_source(o)


@register("SELECT user_id AS run_id, count(*) FILTER (event_type = 'purchase' AND event_id % 3 = 0) AS no_text FROM events GROUP BY user_id")
def q_no_text(spark, sf_dir):
    """Done documents of each run whose text couldn't be read."""
    c = _events(spark, sf_dir).select(F.col("user_id").alias("run_id"), F.when(F.col("event_type") == "purchase", "done").alias("status"), F.when(F.col("event_id") % 3 == 0, "x").alias("extract_error"))
    return events.no_text(c)


@register("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 3 = 0 THEN 'cancelled_empty' WHEN o_orderkey % 2 = 0 AND o_custkey % 4 = 0 THEN 'no_results' WHEN o_orderkey % 2 = 0 AND o_custkey % 5 = 0 THEN 'all_off_topic' END AS diagnosis FROM orders""")
def q_diagnosis(spark, sf_dir):
    """Why finished runs have nothing."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return events.diagnosis(table(spark, sf_dir, "orders").select("o_orderkey", (k % 2).alias("saved"), (c % 3 == 0).alias("cancelled"), (c % 4).alias("found"), (c % 5).alias("kept"))).select("o_orderkey", "diagnosis")


@register("""WITH o AS (SELECT o_orderkey, o_orderkey % 3 AS n, o_custkey % 4 = 0 AS late, o_custkey % 5 = 0 AS slow, o_custkey % 7 = 0 AS bad FROM orders),
s AS (SELECT *, CASE WHEN late AND n = 0 THEN 'timeout' WHEN late THEN 'partial' WHEN n = 0 AND slow THEN 'throttled' WHEN n = 0 AND bad THEN 'error' WHEN n = 0 THEN 'empty' ELSE 'ok' END AS status FROM o)
SELECT o_orderkey, status, CASE WHEN status IN ('timeout', 'error') THEN 'failure' WHEN status = 'ok' THEN 'success' ELSE 'neutral' END AS outcome FROM s""")
def q_call_outcome(spark, sf_dir):
    """Status of engines' calls and what it means to the breaker."""
    c = F.col("o_custkey")
    status, outcome = events.call_outcome(F.col("o_orderkey") % 3, c % 4 == 0, c % 5 == 0, c % 7 == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), outcome.alias("outcome"))


_STAGES, _STATES = ("discover", "rank", "download", "extract"), ("started", "progress", "done", "skipped")


@register(f"""WITH e AS (SELECT user_id AS run_id, event_id AS seq, {sql_pick(_STAGES, 'event_id')} AS stage, {sql_pick(_STATES, 'CAST(floor(value) AS BIGINT)')} AS state FROM events),
l AS (SELECT run_id, stage, arg_max(state, seq) AS state FROM e GROUP BY ALL)
SELECT *, arg_max(stage, list_position([{', '.join(repr(s) for s in _STAGES)}], stage)) FILTER (state IN ('started', 'progress')) OVER (PARTITION BY run_id) AS active FROM l""")
def q_stage_state(spark, sf_dir):
    """Latest state of each stage, and the last one under way."""
    e = F.col("event_id")
    return events.stage_state(_events(spark, sf_dir).select(F.col("user_id").alias("run_id"), e.alias("seq"), pick(_STAGES, e).alias("stage"), pick(_STATES, F.floor("value")).alias("state")), list(_STAGES))


@register("""WITH c AS (SELECT user_id AS run_id, event_type, 't' || event_id AS title, CASE WHEN event_id % 4 = 0 THEN 'x' END AS bad FROM events)
SELECT run_id, 'failed' AS type, title AS subject, 'e' AS message FROM c WHERE event_type = 'error' UNION ALL SELECT run_id, 'not_indexed', title, bad FROM c WHERE event_type = 'purchase' AND bad IS NOT NULL
UNION ALL SELECT user_id, 'source', event_type, 'late' FROM events WHERE event_type = 'view' GROUP BY user_id, event_type""")
def q_issue_feed(spark, sf_dir):
    """Source issues, failed documents and those without text, as one list."""
    e = _events(spark, sf_dir)
    done = e.select(F.col("user_id").alias("run_id"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("title"), F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done").alias("status"), F.lit("e").alias("error"), F.when(F.col("event_id") % 4 == 0, "x").alias("extract_error"))
    issues = e.where("event_type = 'view'").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("source"), F.lit("late").alias("error")).distinct()
    return events.issue_feed(issues, done)


# --- discovery ----------------------------------------------------------------------------------


@register("""WITH o AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 429 WHEN 2 THEN 502 WHEN 3 THEN 500 WHEN 4 THEN 404 WHEN 5 THEN 504 ELSE 200 END AS st, o_custkey % 4 + 1 AS a, CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 20 END AS ra FROM orders)
SELECT o_orderkey, CASE WHEN a < 3 AND (st IS NULL OR st IN (429, 502, 503, 504)) THEN least(CASE WHEN st IS NOT NULL AND ra IS NOT NULL THEN CAST(ra AS DOUBLE) WHEN st = 429 THEN 5.0 * a ELSE pow(2.0, a) END, 8.0) END AS wait FROM o""")
def q_retry_delays(spark, sf_dir):
    """Seconds before another attempt, by status and attempt."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = pick((None, 429, 502, 500, 404, 504, 200), k).cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", discovery.retry_delays(status, c % 4 + 1, F.when(c % 3 == 0, c % 20)).alias("wait"))


_URL_KEY = "lower(regexp_replace(regexp_replace(url, '(?s)#.*$', ''), '/+$', ''))"


@register(f"""WITH p AS (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN 'bing' WHEN 1 THEN 'brave' ELSE 'mojeek' END AS engine, row_number() OVER (PARTITION BY page_id % 3 ORDER BY page_id) AS r FROM pages), c AS (SELECT * FROM p WHERE r <= 60),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY {_URL_KEY} ORDER BY page_id) = 1)
SELECT page_id, 'meta_search/' || engine AS source FROM f QUALIFY row_number() OVER (ORDER BY page_id) <= 60""")
def q_meta_union(spark, sf_dir):
    """Three engines' results as one source (caps are the feature)."""
    from pyspark.sql import Window

    p = table(spark, sf_dir, "pages").select("page_id", "url", F.row_number().over(Window.partitionBy(F.col("page_id") % 3).orderBy("page_id")).alias("rank_in_source"), F.col("page_id").alias("arrival_seq"))
    engines = {name: p.where(F.col("page_id") % 3 == k) for k, name in enumerate(("bing", "brave", "mojeek"))}
    return discovery.meta_union(engines, urls.url_key(F.col("url")), 60).select("page_id", "source")


_VERSIONS, _GRADES, _NETS = ("1.2", None, "2024.1", "0.9", "x"), ("A", "A+", "B"), (None, "normal", "tor")


@register(f"""WITH o AS (SELECT o_orderkey, {sql_pick(_VERSIONS, 'o_orderkey')} AS v, {sql_pick(_GRADES, 'o_custkey')} AS g, {sql_pick(_NETS, 'o_custkey // 3')} AS n, CASE WHEN o_orderkey % 2 = 0 THEN 'HTTPS://' ELSE 'http://' END || 'h' || o_orderkey AS url FROM orders)
SELECT o_orderkey FROM o WHERE coalesce(n, '') IN ('', 'normal') AND g IN ('A', 'A+') AND lower(url) LIKE 'https://%' AND (v IS NULL OR try_cast(regexp_extract(v, '^(\\d+)', 1) AS INT) >= 1)""")
def q_instances(spark, sf_dir):
    """Search instances that may be asked."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    i = table(spark, sf_dir, "orders").select("o_orderkey", pick(_VERSIONS, k).alias("version"), pick(_GRADES, c).alias("tls_grade"), pick(_NETS, F.floor(c / 3)).alias("network_type"), F.concat(F.when(k % 2 == 0, "HTTPS://").otherwise("http://"), F.lit("h"), k.cast("string")).alias("url"))
    return discovery.acceptable_instances(i).select("o_orderkey")


@register("SELECT doc_id, source AS engine, round(1.0 / row_number() OVER (PARTITION BY source ORDER BY doc_id), 9) AS score FROM documents")
def q_instance_scores(spark, sf_dir):
    """Results as the search interface gives them."""
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("title"), F.lit("u").alias("url"), "source", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("rank_in_source"))
    return discovery.instance_scores(d).select(F.col("title").cast("long").alias("doc_id"), "engine", F.round("score", 9).alias("score"))


# --- messages and small functions ---------------------------------------------------------------

_RAW = (None, "You're offline", "x (HTTP 404)", "HTTP 400", "http 403", "HTTP 429 slow", "HTTP 503", "a landing page", "Too large", "empty response", "no signature", "text is empty", "timed out", "DNS failure", "cancelled", "odd")
_RAW_KINDS = ("none", None, "gone", "rejected", "blocked", "busy", "server", "page", "large", "small", "damaged", "no_text", "timeout", "network", "cancelled", None)
# What the messages have to be, written out so that a wrong text in the module shows.
_SAID = (
    "The download didn't complete.",
    "You're offline",
    "The document is no longer available at this link.",
    "The download link was rejected by the server — it may have expired or need a login. Skipped.",
    "This source blocked the download — it may require a subscription or sign-in.",
    "The source was busy and rate-limited us — we backed off and retried.",
    "The source's server had a temporary problem.",
    "This link opened a web page, not a downloadable file — skipped.",
    "The file was larger than the download size limit.",
    "The server returned an empty or tiny response — likely an error page.",
    "The downloaded file was corrupted or wasn't really a document.",
    "Downloaded, but no readable text could be pulled out (it may be a scanned image).",
    "The download timed out.",
    "Couldn't reach the server — check your internet connection.",
    "Cancelled.",
    "odd",
)


@register(f"SELECT event_id, {sql_pick(_RAW_KINDS, 'event_id')} AS kind, {sql_pick(_SAID, 'event_id')} AS said FROM events")
def q_download_messages(spark, sf_dir):
    """Failed downloads by kind and in plain words."""
    raw = pick(_RAW, F.col("event_id"))
    return _events(spark, sf_dir).select("event_id", display.download_error_kind(raw).alias("kind"), display.humanize_download_error(raw).alias("said"))


_KINDS = ("rate_limit", "forbidden", "server_error", "timeout", "parse_error", "other", "odd")
_OF_SOURCES = ("arxiv", "meta_search/web", "", "zz")
_NAMES = ("arXiv", "DuckDuckGo", "This source", "zz")
_PROBLEMS = (
    "%s is rate-limiting us right now — we'll back off and keep going.",
    "%s blocked the request (it may need a sign-in or be region-locked).",
    "%s had a temporary server error.",
    "%s took too long to respond.",
    "Couldn't read %s's response.",
    "%s reported a problem.",
    "%s reported a problem.",
)
_TAGS = ("rate limited", "blocked", "server error", "timed out", "unreadable", "issue", "issue")


@register(f"SELECT event_id, replace({sql_pick(_PROBLEMS, 'event_id')}, '%s', {sql_pick(_NAMES, 'event_id // 7')}) AS said, {sql_pick(_TAGS, 'event_id')} AS tag FROM events")
def q_source_messages(spark, sf_dir):
    """Sources' problems in plain words, and their tags."""
    e = F.col("event_id")
    kind = pick(_KINDS, e)
    return _events(spark, sf_dir).select("event_id", display.humanize_source_kind(kind, pick(_OF_SOURCES, F.floor(e / 7))).alias("said"), display.issue_kind_tag(kind).alias("tag"))


_STATUS = (400, 401, 403, 404, 410, 408, 429, 500, 599, 418, 600)
_STATUS_SAID = (
    "The download link was rejected by the server — it may have expired or need a sign-in",
    "This source blocked the download — it may need a subscription or sign-in",
    "This source blocked the download — it may need a subscription or sign-in",
    "The document is no longer available at this link",
    "The document is no longer available at this link",
    "The server took too long to respond",
    "The source is busy and asked us to slow down",
    "The source's server had a temporary problem",
    "The source's server had a temporary problem",
    "The server refused to send the file",
    "The server refused to send the file",
)
_NETWORK_SAID = ("The download timed out — the server was too slow to respond.", "Couldn't reach the server — check your internet connection.", "Couldn't reach the server (network error).")
_SIZES = (0, 2000, 4095, 4096, 524288000, 524288001)
_SIZE_SAID = (
    "The server returned no data.",
    "The server returned only 2000 bytes — likely an error page, not the document.",
    "The server returned only 4095 bytes — likely an error page, not the document.",
    None,
    None,
    "This file is too large to download (over 500 MB).",
)


@register(f"SELECT event_id, {sql_pick(_STATUS_SAID, 'event_id')} AS http, {sql_pick(_NETWORK_SAID, 'event_id')} AS network, {sql_pick(_SIZE_SAID, 'event_id')} AS size FROM events")
def q_status_messages(spark, sf_dir):
    """Status codes, transport errors and sizes in plain words."""
    e = F.col("event_id")
    return _events(spark, sf_dir).select("event_id", content.http_status_message(pick(_STATUS, e)).alias("http"), content.network_error_message(pick(("timeout", "connect", "reset"), e)).alias("network"), content.reject_size(pick(_SIZES, e).cast("long")).alias("size"))


@register("""SELECT doc_id, sha256(text) AS hash, doc_id % 2 = 0 AS fits, strlen(text) <= 2000 AS whole, CASE WHEN strlen(text) <= 1000 THEN md5(text) END AS body FROM documents WHERE text IS NOT NULL""")
def q_content_checks(spark, sf_dir):
    """Hashes verified, whole texts told from truncated ones, bodies capped."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    expected = F.when(F.col("doc_id") % 2 == 0, F.upper(F.sha2("text", 256))).otherwise("0")
    return d.select("doc_id", F.sha2("text", 256).alias("hash"), content.verify_sha256(F.col("text").cast("binary"), expected).alias("fits"), (F.col("text") == text.truncated(F.col("text"), 2000)).alias("whole"), F.md5(session.capped(F.col("text"), 1000)).alias("body"))


_LIMITS = (1, 100, 1001, 5002)


@register(f"""WITH c AS (SELECT doc_id, generate_subscripts(string_split(text, ''), 1) AS n, unnest(list_transform(string_split(text, ''), lambda x: strlen(x))) AS w FROM documents WHERE text <> ''),
b AS (SELECT doc_id, n, sum(w) OVER (PARTITION BY doc_id ORDER BY n) AS bytes FROM c),
p AS (SELECT doc_id, {", ".join(f"coalesce(max(n) FILTER (bytes <= {k}), 0) AS n{k}" for k in _LIMITS)} FROM b GROUP BY doc_id)
SELECT doc_id, {", ".join(f"md5(left(text, n{k})) AS cut{k}" for k in _LIMITS)} FROM p JOIN documents USING (doc_id)""")
def q_truncated(spark, sf_dir):
    """Whole texts cut to several numbers of bytes, at characters."""
    d = table(spark, sf_dir, "documents").where("text <> ''")
    return d.select("doc_id", *[F.md5(text.truncated(F.col("text"), k)).alias(f"cut{k}") for k in _LIMITS])


_HREFS = ("https://a/x.pdf", "//b/y", "https://d/l/?uddg=https%3A%2F%2Fc%2Fz.pdf&rut=1", "/rel", "https://zenodo.org/r/1", "https://www.zenodo.org/r/2")
_UNWRAPPED = ("https://a/x.pdf", "https://b/y", "https://c/z.pdf", "/rel", "https://zenodo.org/r/1", "https://www.zenodo.org/r/2")


@register(f"SELECT event_id, {sql_pick(_UNWRAPPED, 'event_id')} AS target, event_id % 6 >= 4 AS honest, {sql_pick(('https://a/', None, 'https://d/', None, 'https://zenodo.org/', 'https://www.zenodo.org/'), 'event_id')} AS referer FROM events")
def q_links(spark, sf_dir):
    """Redirects unwrapped, hosts that want a plain client, referers."""
    href = pick(_HREFS, F.col("event_id"))
    return _events(spark, sf_dir).select("event_id", urls.unwrap_redirect(href).alias("target"), urls.host_needs_honest_ua(href).alias("honest"), urls.referer_for(href).alias("referer"))


_V6 = ("::1", "fe80::1", "2001:db8::1", "::ffff:10.0.0.1", "2606:4700::1111", "fd00::2", "ff02::1", "64:ff9b::7f00:1", "8.8.8.8", "10.1.2.3", "odd")


@register(f"SELECT event_id, {sql_pick(('true', 'true', 'false', 'true', 'false', 'true', 'true', 'true', 'false', 'true', None), 'event_id')} AS private FROM events")
def q_private_ip_any(spark, sf_dir):
    """Which addresses of either version aren't publicly routable."""
    return _events(spark, sf_dir).select("event_id", urls.is_private_ip(pick(_V6, F.col("event_id"))).cast("string").alias("private"))


@register("""WITH p AS (SELECT page_id, lower(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS t FROM pages)
SELECT page_id, t <> '' AND (page_id % 2 = 0) AS strong, page_id % 3 = 0 OR page_id % 4 = 0 AS weak, page_id % 5 = 0 AS sentinel FROM p""")
def q_corroborate(spark, sf_dir):
    """Whether titles, years and authors speak for one document."""
    k, t = F.col("page_id"), F.lower(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    other = F.when(k % 2 == 0, F.concat(t, F.lit(" more"))).otherwise(F.concat(F.lit("not "), t))
    year = F.when(k % 3 == 0, "2001").otherwise("1999")
    name = F.array(F.when(k % 4 == 0, "Doe, J").otherwise("Roe, R"))
    return table(spark, sf_dir, "pages").select("page_id", text.titles_corroborate(t, other).alias("strong"), text.weak_corroborates(F.lit("2001"), F.array(F.lit("Jane Doe")), year, name).alias("weak"), text.is_sentinel_title(F.when(k % 5 == 0, "untitled").otherwise("x")).alias("sentinel"))


@register("""WITH b AS (SELECT item_id, substr(md5(text), 1, 8) AS q FROM benchmark)
SELECT item_id, q || '-7-8' AS folder, 'file:///a%20b/' || q || '.pdf' AS uri, 'Topic: ' || q AS asks FROM b""")
def q_names(spark, sf_dir):
    """Folders and addresses of files, and the topic line of the three prompts."""
    q = F.substring(F.md5("text"), 1, 8)
    line = F.regexp_extract(query.expansion_prompt(q), "Topic: [^\n]*", 0)
    same = (F.regexp_extract(query.filter_prompt(q, F.lit("t"), F.lit("")), "Topic: [^\n]*", 0) == line) & F.contains(query.spellfix_prompt(q), q)
    return table(spark, sf_dir, "benchmark").select("item_id", text.safe_folder(q, F.lit("7-8")).alias("folder"), urls.file_uri(F.concat(F.lit("/a b/"), q, F.lit(".pdf"))).alias("uri"), F.when(same, line).alias("asks"))


@register("""WITH l AS (SELECT 'q-' || c_nationkey || CASE WHEN c_nationkey % 4 = 0 THEN '' ELSE '-' || (1000 + c_nationkey * 7 % 25) || '-1' END AS name, c_nationkey, count(*) AS n_docs, CAST(sum(c_custkey) AS BIGINT) AS size_bytes FROM customer GROUP BY c_nationkey)
SELECT c_nationkey, row_number() OVER (ORDER BY CASE WHEN c_nationkey % 4 = 0 THEN 0 ELSE 1000 + c_nationkey * 7 % 25 END DESC, name) AS recent FROM l WHERE contains(name, '-1')""")
def q_libraries(spark, sf_dir):
    """Libraries whose name holds a text, newest first."""
    from pyspark.sql import Window

    k = F.col("c_nationkey")
    stamp = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("-"), (1000 + k * 7 % 25).cast("string"), F.lit("-1")))
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("c_custkey").alias("size_bytes"))
    rows = library.filter_libraries(c.withColumn("name", F.concat(F.lit("q-"), k.cast("string"), stamp)).withColumn("query", F.upper("name")), " -1 ")
    return rows.select("c_nationkey", F.row_number().over(Window.orderBy(*library.recency(F.col("name")), "name")).cast("long").alias("recent"))


@register("SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS cosine FROM embeddings WHERE embedding IS NOT NULL")
def q_self_cosine(spark, sf_dir):
    """The cosine of every vector with itself."""
    return table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.round(rerank.cosine(F.col("embedding"), F.col("embedding")), 6).alias("cosine"))


# --- connectors over captured answers -----------------------------------------------------------

_SAFE = "regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g')"


def _captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer's title and number for each benchmark text."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]", "").alias("t"))


def _answer(df: DataFrame, shape: str, *values: Column) -> DataFrame:
    return df.select("item_id", F.format_string(shape, *values).alias("payload"))


def _digest(out: DataFrame) -> DataFrame:
    return out.select("item_id", F.col("rank_in_source").cast("long").alias("rank"), F.md5("title").alias("title"), "url", F.array_join("authors", ";").alias("authors"), "year")


def _connector_sql(url: str, authors: str = "'A B'", year: str = "'2001'", title: str = "t", where: str = "true") -> str:
    return f"WITH c AS (SELECT item_id, {_SAFE} AS t FROM benchmark) SELECT item_id, CAST(1 AS BIGINT) AS rank, md5({title}) AS title, {url} AS url, {authors} AS authors, {year} AS year FROM c WHERE {where}"


def _item() -> Column:
    return F.col("item_id")


def _text() -> Column:
    return F.col("t")


@register(_connector_sql("'https://a/' || item_id || '.pdf'"))
def q_openalex(spark, sf_dir):
    """OpenAlex over captured answers: a work with a redirector first and one without a PDF."""
    shape = '{"results": [{"id": "W0", "title": "none", "best_oa_location": {"pdf_url": null}}, {"id": "W1", "title": "%s", "publication_year": 2001, "best_oa_location": {"pdf_url": "https://doi.org/x"}, "primary_location": {"pdf_url": "https://a/%d.pdf"}, "authorships": [{"author": {"display_name": "A B"}}]}]}'
    return _digest(scholarly.openalex(_answer(_captured(spark, sf_dir), shape, _text(), _item())))


@register(_connector_sql("'https://a/' || item_id"))
def q_semantic_scholar(spark, sf_dir):
    """Semantic Scholar over captured answers."""
    shape = '{"data": [{"title": "closed"}, {"title": "%s", "year": 2001, "openAccessPdf": {"url": "https://a/%d"}, "authors": [{"name": "A B"}]}]}'
    return _digest(scholarly.semantic_scholar(_answer(_captured(spark, sf_dir), shape, _text(), _item())))


@register(_connector_sql("'https://p/' || item_id", "'Doe J;Roe R'"))
def q_europe_pmc(spark, sf_dir):
    """Europe PMC over captured answers."""
    shape = '{"resultList": {"result": [{"title": "%s", "authorString": "Doe J., Roe R.", "pubYear": "2001", "fullTextUrlList": {"fullTextUrl": [{"documentStyle": "html", "url": "h"}, {"documentStyle": "PDF", "url": "https://p/%d"}]}}]}}'
    return _digest(scholarly.europe_pmc(_answer(_captured(spark, sf_dir), shape, _text(), _item())))


@register(_connector_sql("CASE WHEN item_id % 2 = 0 THEN 'https://g/' || item_id ELSE 'https://f/' || item_id END"))
def q_doaj(spark, sf_dir):
    """DOAJ over captured answers."""
    shape = '{"results": [{"bibjson": {"title": "%s", "year": 2001, "author": [{"name": "A B"}], "link": [{"type": "fulltext", "url": "https://f/%d"}, {"type": "%s", "content_type": "PDF", "url": "https://g/%d"}]}}]}'
    return _digest(scholarly.doaj(_answer(_captured(spark, sf_dir), shape, _text(), _item(), F.when(_item() % 2 == 0, "fulltext").otherwise("homepage"), _item())))


@register(_connector_sql("'https://s/' || item_id"))
def q_zenodo(spark, sf_dir):
    """Zenodo over captured answers."""
    shape = '{"hits": {"hits": [{"metadata": {"title": "%s", "publication_date": "2001-02", "creators": [{"name": "A B"}]}, "files": [{"key": "a.csv", "links": {"self": "n"}}, {"key": "b.PDF", "links": {"download": "d", "self": "https://s/%d"}}]}]}}'
    return _digest(scholarly.zenodo(_answer(_captured(spark, sf_dir), shape, _text(), _item())))


@register(_connector_sql("'https://x/' || item_id", year="CAST(NULL AS VARCHAR)"))
def q_gutenberg(spark, sf_dir):
    """Gutendex over captured answers."""
    shape = '{"results": [{"id": 5, "title": "%s", "authors": [{"name": "A B"}], "formats": {"application/pdf": "p", "text/plain": "https://x/%d"}}]}'
    return _digest(scholarly.gutenberg(_answer(_captured(spark, sf_dir), shape, _text(), _item())))


@register(_connector_sql("'https://archive.org/download/i%20' || item_id || '/m%20n.pdf'", "'C'", "'1900'"))
def q_internet_archive(spark, sf_dir):
    """Internet Archive over captured answers and file lists."""
    c = _captured(spark, sf_dir)
    shape = '{"response": {"docs": [{"identifier": "i %d", "title": ["%s", "B"], "creator": "C", "format": ["PDF", "x"], "year": 1900}, {"identifier": "j", "format": "DjVu"}]}}'
    meta = c.select(F.concat(F.lit("i "), _item().cast("string")).alias("identifier"), F.lit('{"files": [{"name": "n.epub", "format": "EPUB"}, {"name": "m n.pdf", "format": "Text PDF"}]}').alias("payload"))
    return _digest(scholarly.internet_archive(_answer(c, shape, _item(), _text()), meta))


@register(_connector_sql("'https://arxiv.org/pdf/' || item_id || 'v1.pdf'", title="trim(regexp_replace(t, '\\s+', ' ', 'g'))"))
def q_arxiv(spark, sf_dir):
    """arXiv over captured feeds."""
    shape = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/%dv1</id><title>%s</title><published>2001-01-01</published><author><name>A B</name></author></entry></feed>'
    return _digest(scholarly.arxiv(_answer(_captured(spark, sf_dir), shape, _item(), _text())))


_MARKS = {
    "web": '<a class="r result__a" href="//d/l/?uddg=https%%3A%%2F%%2Fa%%2F{0}.pdf&amp;y">{1}</a>', "brave": '<a href="https://a/{0}.pdf" class="result-header">{1}</a>', "bing": '<h2><a h="1" href="https://a/{0}.pdf">{1}</a></h2>',
    "mojeek": '<a class="ob" href="https://a/{0}.pdf">{1}</a>', "marginalia": '<h2><a href="https://a/{0}.pdf">{1}</a></h2>', "startpage": '<a class="w-gl__result-title" href="https://a/{0}.pdf">{1}</a>',
}


@register(f"WITH c AS (SELECT item_id, trim(regexp_replace({_SAFE}, '\\s+', ' ', 'g')) AS t FROM benchmark) SELECT item_id, e AS source, CAST(1 AS BIGINT) AS rank, md5(t) AS title, 'https://a/' || item_id || '.pdf' AS url FROM c, (VALUES {', '.join(f'({m!r})' for m in _MARKS)}) v(e) WHERE t <> ''")
def q_engines(spark, sf_dir):
    """The six web engines over captured result pages."""
    out: DataFrame | None = None
    for engine, mark in _MARKS.items():
        page = '<a href="https://n/y.pdf">menu</a>' + mark.format("%1$d", "%2$s")
        df = _captured(spark, sf_dir).select("item_id", F.format_string(page, _item(), _text()).alias("html"))
        found = web.results(df, engine).select("item_id", "source", F.col("rank_in_source").cast("long").alias("rank"), F.md5("title").alias("title"), "url")
        out = found if out is None else out.unionByName(found)
    return out


@register()
def q_search_run(spark, sf_dir):
    """The whole search as one plan: matched, ranked, reranked, judged, boosted, placed."""
    found = _discoveries(spark, sf_dir)
    words = found.select("run_id").distinct().select("run_id", F.explode(F.array(*[F.lit(k) for k in _KEYWORDS])).alias("keyword"))
    keys = found.select("run_id", "url").distinct()
    vectors = keys.withColumn("cosine", F.pmod(F.xxhash64("url"), F.lit(1000)) / 1000.0)
    verdicts = keys.withColumn("verdict", F.pmod(F.xxhash64("url", F.lit(1)), F.lit(3)) > 0)
    doi = lambda n: F.concat(F.lit("10.1234/x"), (n % 211).cast("string"))
    edges = table(spark, sf_dir, "documents").select(doi(F.col("doc_id")).alias("src_doi"), doi(F.col("doc_id") * 7).alias("dst_doi")).distinct()
    out = candidates.candidates(found, words, 500, vectors, verdicts, edges)
    return out.select("run_id", "insert_idx", "url", F.round("score", 6).alias("score"), "status", "reject_reason", "final_rank", F.size("sources").alias("n_sources"))


# --- exact forms, choices and stores ------------------------------------------------------------


@register(registry.SQL["q_strip_html"])
def q_strip_html_exact(spark, sf_dir):
    """Text of every page by the exact form, which decodes in one pass."""
    out = text.strip_html(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(out).alias("digest"), F.length(out).cast("long").alias("n"))


@register(registry.SQL["q_clean_title"])
def q_clean_title_exact(spark, sf_dir):
    """Clean title of every page by the exact form."""
    return table(spark, sf_dir, "pages").select("page_id", text.clean_title(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("title"))


@register("""WITH p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, lead(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY vec_id // 100 ORDER BY vec_id) AS b FROM embeddings WHERE embedding IS NOT NULL)
SELECT vec_id, round(list_cosine_similarity(a, b), 6) AS cosine FROM p WHERE b IS NOT NULL""")
def q_cosine_pairs(spark, sf_dir):
    """The cosine of every vector with the next one, in runs of a hundred."""
    from pyspark.sql import Window

    after = F.lead("embedding").over(Window.partitionBy(F.floor(F.col("vec_id") / 100)).orderBy("vec_id"))
    e = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "embedding", after.alias("after")).where("after is not null")
    return e.select("vec_id", F.round(rerank.cosine(F.col("embedding"), F.col("after")), 6).alias("cosine"))


@register("""WITH h AS (SELECT DISTINCT 'https://v' || vendor_id || '.example' AS url FROM vendors WHERE vendor_id IS NOT NULL AND (nation_id IS NULL OR nation_id % 7 <> 0)),
i AS (SELECT url, row_number() OVER (ORDER BY url) - 1 AS place, count(*) OVER () AS n FROM h),
s AS (SELECT c_custkey AS run_id, c_custkey * 7919 % 1000003 AS seed, max(n) AS n FROM customer, i GROUP BY ALL),
p AS (SELECT run_id, 1 AS turn, seed % n AS place FROM s UNION ALL SELECT run_id, 2, (seed % n + 1 + (seed // 256) % (n - 1)) % n FROM s WHERE n > 1)
SELECT run_id, turn, url FROM p JOIN i USING (place) UNION ALL SELECT c_custkey, 0, 'http://127.0.0.1:8888' FROM customer""")
def q_instance_choice(spark, sf_dir):
    """Search instances that runs go to: the local one, then two by the run's seed, those out of service left out."""
    v = table(spark, sf_dir, "vendors").where("vendor_id is not null")
    url = F.concat(F.lit("https://v"), F.col("vendor_id").cast("string"), F.lit(".example"))
    own = v.sparkSession.range(1).select(F.lit("http://127.0.0.1:8888").alias("url"), F.lit(True).alias("local"))
    instances = v.select(url.alias("url"), F.lit(False).alias("local")).unionByName(own)
    health = v.groupBy(url.alias("url")).agg(F.bool_and(F.coalesce(F.col("nation_id") % 7 == 0, F.lit(False))).alias("open"))
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), (F.col("c_custkey") * 7919 % 1000003).alias("seed"))
    return discovery.choose_instances(instances, runs, health).select("run_id", "turn", "url")


_ASKED = ("rust book", "", "  ", None, "whales")


@register(f"""WITH a AS (SELECT event_id, {sql_pick(_ASKED, 'event_id')} AS q, event_id % 3 + 1 AS page FROM events)
SELECT event_id, CASE WHEN trim(coalesce(q, '')) = '' THEN 400 ELSE 200 END AS status, CASE WHEN trim(coalesce(q, '')) = '' OR page > 1 THEN 0 ELSE event_id % 5 END AS number_of_results FROM a""")
def q_search_answers(spark, sf_dir):
    """What the search interface answers: blank queries are refused, later pages empty."""
    e = F.col("event_id")
    a = _events(spark, sf_dir).select("event_id", pick(_ASKED, e).alias("q"), (e % 3 + 1).alias("page"), F.array_repeat(F.lit("x"), (e % 5).cast("int")).alias("results"))
    return discovery.search_answer(a, F.col("q"), F.col("page")).select("event_id", "status", F.col("number_of_results").cast("long").alias("number_of_results"))


@register(f"SELECT event_id, CASE WHEN {sql_pick(display.SOURCES, 'event_id')} IN ('meta_search', 'searxng', 'web', 'semantic_scholar', 'zenodo') THEN 2 ELSE 4 END AS at_once FROM events")
def q_source_concurrency(spark, sf_dir):
    """Requests that may be under way at a source."""
    return _events(spark, sf_dir).select("event_id", discovery.source_concurrency(pick(display.SOURCES, F.col("event_id"))).alias("at_once"))


@register("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def q_latest_candidates(spark, sf_dir):
    """The last row of each key, as candidates are sent again."""
    return library.latest_by(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@register("SELECT doc_id, CAST(length(source || ' ' || coalesce(text, '')) AS DOUBLE) AS length, CAST(len(regexp_extract_all(source || ' ' || coalesce(text, ''), '[aeiou]')) AS DOUBLE) AS vowels FROM documents")
def q_embed(spark, sf_dir):
    """Vectors of documents by an injected model, here two counts."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(" "), F.coalesce("text", F.lit(""))).alias("said"))
    out = rerank.embed(d, lambda texts: [[float(len(t)), float(sum(t.count(v) for v in "aeiou"))] for t in texts], "said")
    return out.select("doc_id", F.col("vector")[0].cast("double").alias("length"), F.col("vector")[1].cast("double").alias("vowels"))


@register()
def q_document_sink(spark, sf_dir):
    """Every page stored as a file, whole or not at all, or told why not."""
    kinds = ("text/html", "application/pdf", None, "application/json", "text/plain")
    p = table(spark, sf_dir, "pages").where("url is not null").select("url", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), pick(kinds, F.col("page_id")).alias("content_type"), F.col("html").cast("binary").alias("content"))
    out = document_sink.save_documents(p)
    return out.select("url", "size_bytes", "error", F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("ext"))


# --- providers over several pages ---------------------------------------------------------------

_PAGED = ("openalex", "semantic_scholar", "europe_pmc", "doaj", "zenodo", "gutenberg")


def _hits(url: Column, title: Column, year: Column) -> dict[str, tuple[Column, Callable[[Column], Column]]]:
    """Each provider's form of a hit, and of an answer that holds a page of them."""
    results = lambda hits: F.struct(hits.alias("results"))
    file = F.array(F.struct(F.lit("x.csv").alias("key"), F.struct(F.lit("https://n/").alias("download")).alias("links")), F.struct(F.lit("x.PDF").alias("key"), F.struct(url.alias("download")).alias("links")))
    return {
        "openalex": (F.struct(title.alias("title"), year.alias("publication_year"), F.struct(url.alias("pdf_url")).alias("primary_location")), results),
        "semantic_scholar": (F.struct(title.alias("title"), year.alias("year"), F.when(url.isNotNull(), F.struct(url.alias("url"))).alias("openAccessPdf")), lambda hits: F.struct(hits.alias("data"))),
        "europe_pmc": (F.struct(title.alias("title"), year.cast("string").alias("pubYear"), F.struct(F.array(F.struct(F.lit("pdf").alias("documentStyle"), url.alias("url"))).alias("fullTextUrl")).alias("fullTextUrlList")), lambda hits: F.struct(F.struct(hits.alias("result")).alias("resultList"))),
        "doaj": (F.struct(F.struct(title.alias("title"), year.alias("year"), F.array(F.struct(F.lit("fulltext").alias("type"), url.alias("url"))).alias("link")).alias("bibjson")), results),
        "zenodo": (F.struct(F.struct(title.alias("title"), F.concat(year.cast("string"), F.lit("-03")).alias("publication_date")).alias("metadata"), file.alias("files")), lambda hits: F.struct(F.struct(hits.alias("hits")).alias("hits"))),
        "gutenberg": (F.struct(title.alias("title"), F.struct(url.alias("application/pdf")).alias("formats")), results),
    }


@register(f"""WITH d AS (SELECT doc_id, source AS sub_query, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents WHERE source IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY sub_query ORDER BY doc_id) AS place FROM d WHERE doc_id % 5 <> 3),
p AS (SELECT unnest([{", ".join(f"'{s}'" for s in _PAGED)}]) AS source_id)
SELECT source_id, sub_query, CAST(n // 25 AS INTEGER) AS page, CAST(place AS INTEGER) AS rank_in_source, CASE WHEN doc_id % 7 = 0 THEN 'Untitled' ELSE 't' || doc_id END AS title, 'https://f.example/' || doc_id || '.pdf' AS url,
  CASE WHEN doc_id % 4 <> 0 AND source_id <> 'gutenberg' THEN CAST(2000 + doc_id % 20 AS VARCHAR) END AS year FROM k, p WHERE place <= 60""")
def q_provider_pages(spark, sf_dir):
    """Documents out of several pages of six providers' answers, with hits that don't count and fields that are missing; 60 of a task (a limit is the feature)."""
    from pyspark.sql import Window

    i, limit = F.col("doc_id"), 60
    d = table(spark, sf_dir, "documents").where("source is not null").select("doc_id", F.col("source").alias("sub_query"))
    d = d.withColumn("page", F.floor((F.row_number().over(Window.partitionBy("sub_query").orderBy("doc_id")) - 1) / 25).cast("int"))
    url = F.when(i % 5 != 3, F.concat(F.lit("https://f.example/"), i.cast("string"), F.lit(".pdf")))
    title, year = F.when(i % 7 != 0, F.concat(F.lit("t"), i.cast("string"))), F.when(i % 4 != 0, 2000 + i % 20)
    out: DataFrame | None = None
    for source, (hit, answer) in _hits(url, title, year).items():
        pages = d.select("sub_query", "page", F.struct("doc_id", hit.alias("hit")).alias("h"), url.alias("url")).groupBy("sub_query", "page").agg(F.array_sort(F.collect_list("h")).alias("h"), F.count("url").alias("given"))
        before = F.sum("given").over(Window.partitionBy("sub_query").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
        pages = pages.withColumn("room", (limit - F.coalesce(before, F.lit(0))).cast("int")).where("room > 0")
        none = F.lit(None).cast("string")
        answers = pages.select(F.lit(source).alias("source_id"), "sub_query", "page", none.alias("item"), "room", F.to_json(answer(F.col("h.hit"))).alias("payload"), none.alias("error"))
        found = live.documents(answers, source).select("source_id", "sub_query", "page", "rank_in_source", "title", "url", "year")
        out = found if out is None else out.unionByName(found)
    return out


@register(f"""WITH e AS ({registry.SQL["q_expand_broad"]}),
w AS (SELECT item_id AS run_id, 1 AS wave, sub_idx, sub_query FROM e
  UNION ALL SELECT item_id, 2, 1, 'Zebra fish' FROM benchmark WHERE item_id % 2 = 0),
s AS (SELECT unnest([0, 1]) AS source_idx, unnest(['arxiv', 'meta_search']) AS source_id)
SELECT run_id, wave, sub_idx, sub_query, source_idx, source_id FROM w, s""")
def q_run_tasks(spark, sf_dir):
    """Tasks of requested runs in two waves: sub-queries by sources, without unknown and covered sources and extras that are there already."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    asked = F.concat(F.array_join(F.slice(words, 1, 5), " "), F.lit(", "), F.array_join(F.slice(words, 6, 3), " "))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("run_id"), asked.alias("query"))
    requests = b.withColumn("sources", F.array(*[F.lit(s) for s in ("arxiv", "meta_search", "web", "odd")]))
    first = F.upper(F.element_at(query.expand_query(F.col("query")), 1))
    extras = b.where("run_id % 2 = 0").select("run_id", F.posexplode(F.array(first, F.lit("Zebra fish"))).alias("idx", "sub_query"))
    return commands.plan_run(requests, extras).select("run_id", "wave", "sub_idx", "sub_query", "source_idx", "source_id")
