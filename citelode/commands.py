"""The engine's commands: starting a run, listing and opening libraries, logs, exports, deletion.

Each library is a folder with ``runs.parquet`` and ``documents.parquet`` under one root; a folder
with a legacy ``manifest.json`` counts as one too. Commands that read give DataFrames.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citelode.functions import query
from citelode.functions.urls import url_key
from citelode.operators import dedup, discovery, library, session, staging
from citelode.plans import candidates
from citelode.sources import download, files, live, run_log
from citelode.sources.web import ENGINES


class CommandError(ValueError):
    """A command that can't be carried out, and why."""


def plan_run(requests: DataFrame, extras: DataFrame | None = None) -> DataFrame:
    """Tasks of requested runs: ``run_id, wave, sub_idx, sub_query, keywords, source_idx, source_id``.

    Requests (``run_id, query, sources``) that aren't valid are left out, as are unknown sources
    and those that the aggregator covers. ``extras`` (``run_id, idx, sub_query``), a model's
    further sub-queries, make the second wave where the first doesn't have them.
    """
    fine = requests.where(query.is_valid_request(F.col("query"), F.size("sources")))
    subs = query.expand_query_broad(fine, "run_id", "query").withColumn("wave", F.lit(1))
    if extras is not None:
        novel = discovery.novel_extras(extras, subs).withColumn("keywords", query.keywords_or_words(F.col("sub_query")))
        subs = subs.unionByName(novel.where(F.size("keywords") > 0).select("run_id", F.col("idx").cast("int").alias("sub_idx"), "sub_query", "keywords", F.lit(2).alias("wave")))
    sources = discovery.effective_sources(fine.select("run_id", F.posexplode("sources").alias("source_idx", "source_id")))
    return discovery.fan_out(subs, sources).select("run_id", "wave", "sub_idx", "sub_query", "keywords", "source_idx", "source_id")


def _keywords(tasks: DataFrame) -> DataFrame:
    """All keywords of the sub-queries asked, repeats kept: what a run is ranked by."""
    subs = tasks.groupBy("run_id", "wave", "sub_idx").agg(F.first("keywords").alias("keywords"))
    return subs.select("run_id", F.explode("keywords").alias("keyword"))


def start_run(requests: DataFrame, discoveries: DataFrame, max_total: int = 500, per_source: int = 100, extras: DataFrame | None = None, **stages: DataFrame) -> DataFrame:
    """Ranked candidates of requested runs from what the sources answered.

    ``discoveries`` has ``run_id, source_id, rank_in_source`` and the document's fields, and
    either ``sub_query``, by which they belong to a task of ``plan_run``, or ``arrival_seq`` in
    its place. Each task gives ``per_source`` documents at most. ``stages`` may hold ``vectors``,
    ``verdicts`` and ``edges``.
    """
    tasks = plan_run(requests, extras)
    if "sub_query" in discoveries.columns:
        own = tasks.select("run_id", "sub_query", "source_id", "wave", "sub_idx", "source_idx")
        answered = discovery.arrival(discovery.cap_per_source(discoveries.join(own, ["run_id", "sub_query", "source_id"]), per_source))
    else:
        answered = discovery.cap_per_source(discoveries, per_source).join(tasks.select("run_id", "source_id").distinct(), ["run_id", "source_id"], "left_semi")
    return candidates.candidates(answered, _keywords(tasks), max_total, **stages)


def _answers(tasks: DataFrame, per_source: int, fetch: str) -> DataFrame:
    """Documents of tasks by asking their sources, at most ``per_source`` of each, ranked within their task.

    The aggregator's task asks all its engines and keeps the first of each address.
    """
    about = ["run_id", "wave", "sub_idx", "source_idx"]
    meta = tasks.where("source_id = 'meta_search'").select(*about, "sub_query", "keywords", F.explode(F.array(*[F.lit(e) for e in ENGINES])).alias("source_id"), F.lit(True).alias("meta"))
    own = tasks.where("source_id <> 'meta_search'").select(*about, "sub_query", "keywords", "source_id", F.lit(False).alias("meta"))
    # the sources asked, at most all there are: the others need no parser in the plan
    wanted = {r.source_id for r in tasks.select("source_id").distinct().collect()}
    out = None
    for rows, limit, sources in ((own, per_source, wanted & set(live.PROVIDERS) or {"zenodo"}), (meta, max(per_source, 8), ENGINES if "meta_search" in wanted else ())):
        if not sources:
            continue
        answers = staging.written(live.ask(rows.repartition("run_id", "sub_idx", "source_id"), limit, fetch), "answers")
        for source in sorted(sources):
            one = live.documents(answers, source)
            out = one if out is None else out.unionByName(one)
    engine = F.when(F.col("meta"), F.array_position(F.array(*[F.lit(e) for e in ENGINES]), F.col("source_id"))).otherwise(0)
    out = out.withColumn("__engine", engine).withColumn("source", F.when(F.col("meta"), F.concat(F.lit("meta_search/"), "source_id")).otherwise(F.col("source")))
    out = out.withColumn("source_id", F.when(F.col("meta"), "meta_search").otherwise(F.col("source_id")))
    key = F.when(F.col("meta"), url_key(F.col("url"))).otherwise(F.concat_ws("\0", "__engine", "rank_in_source"))
    task = ["run_id", "wave", "sub_idx", "source_id"]
    first = F.row_number().over(Window.partitionBy(*task, key).orderBy("__engine", "rank_in_source"))
    out = out.withColumn("__first", first).where("__first = 1")
    rank = F.row_number().over(Window.partitionBy(*task).orderBy("__engine", "rank_in_source"))
    return discovery.cap_per_source(out.withColumn("rank_in_source", rank), per_source).drop("meta", "page", "__engine", "__first")


def search(requests: DataFrame, fetch: str = "citelode.sources.live:http_fetch", max_total: int = 500, per_source: int = 100, extras: DataFrame | None = None, **stages: DataFrame) -> DataFrame:
    """The whole loop of requested runs: both waves are asked, matched, ranked, reranked and filtered.

    The second wave only asks for runs that the first left room in. Sources' answers are kept in
    the shared folder, so nothing is asked twice. See ``start_run`` for ``stages``.
    """
    tasks = staging.written(plan_run(requests, extras), "tasks")
    found = _answers(tasks.where("wave = 1"), per_source, fetch)
    if extras is not None:
        found = staging.written(found, "wave")
        full = dedup.resolve(discovery.arrival(found), max_total).groupBy("run_id").count().where(F.col("count") >= max_total)
        tasks = tasks.join(full, "run_id", "left_anti").unionByName(tasks.where("wave = 1").join(full, "run_id", "left_semi"))
        found = found.unionByName(_answers(tasks.where("wave = 2"), per_source, fetch))
    return candidates.candidates(discovery.arrival(found), _keywords(tasks), max_total, **stages)


def download_run(ranked: DataFrame, folder: str, fetch: str = "citelode.sources.download:http_download", locations: DataFrame | None = None) -> DataFrame:
    """Downloads the kept candidates of runs into ``folder``: ``url, path, size_bytes, error``; see ``download.download``."""
    return download.download(ranked.where("status = 'kept'"), fetch, folder, locations)


def cancel_run(events: str, run_id: int) -> None:
    """Cancels a run's waves: one more row for the stream of events (JSON lines) under the folder ``events``.

    The file appears whole, so a stream that reads the folder sees the row or nothing.
    """
    name = f"cancel-{run_id}-{uuid.uuid4().hex}.json"
    part = os.path.join(events, f".{name}.part")
    with open(part, "w") as f:
        json.dump({"run_id": run_id, "event": "cancel", "arrival_seq": 2**62}, f)
    os.rename(part, os.path.join(events, name))


def retry_run(outcomes: DataFrame, documents: DataFrame) -> DataFrame:
    """The documents of a run that failed and didn't succeed later, to be downloaded again."""
    return documents.join(library.retry_failed(outcomes).select("run_id", "url"), ["run_id", "url"], "left_semi")


def _legacy(root: str) -> list[str]:
    """Folders under ``root`` that only have a manifest."""
    with os.scandir(root) as found:
        return sorted(e.name for e in found if e.is_dir(follow_symlinks=False) and os.path.exists(os.path.join(e.path, "manifest.json")) and not os.path.exists(os.path.join(e.path, "documents.parquet")))


def list_libraries(spark: SparkSession, root: str, text: str = "", mode: str = "recent") -> DataFrame:
    """Libraries under ``root``: ``library, query, n_docs, size_bytes``, those whose query holds ``text``, sorted.

    Folders that only have a legacy manifest are listed as it says; broken manifests aren't.
    """
    sizes = files.listing(spark, root).select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.regexp_extract("path", r"/([^/]+)/[^/]+\.parquet/", 1).alias("holder"), "length")
    sizes = sizes.select(F.when(F.col("holder") != "", F.col("holder")).otherwise(F.col("folder")).alias("library"), "length")
    legacy = _legacy(root)
    parts = []
    if any(os.path.exists(os.path.join(root, name, "runs.parquet")) for name in os.listdir(root)):
        parts.append(library.library_summary(*files.library(spark, root), sizes))
    if legacy:
        held = files.manifests(spark, [os.path.join(root, name, "manifest.json") for name in legacy]).where("query is not null")
        counts = held.select("library", F.explode("documents.url").alias("url")).groupBy("library").agg(F.count_distinct("url").alias("n_docs"))
        total = sizes.groupBy("library").agg(F.sum("length").alias("size_bytes"))
        rows = held.select("library", "query").join(counts, "library", "left").join(total, "library", "left")
        parts.append(rows.fillna(0, ["n_docs", "size_bytes"]))
    if not parts:
        return spark.createDataFrame([], "library string, query string, n_docs long, size_bytes long")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return library.sort_libraries(library.filter_libraries(rows.withColumn("name", F.col("library")), text), mode).drop("name")


def open_library(spark: SparkSession, root: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Runs and documents of one library; a legacy manifest is migrated as it is read."""
    folder = os.path.join(root, name)
    if not library.confined(root, name) or not os.path.isdir(folder):
        raise CommandError(f"no library: {name}")
    if os.path.exists(os.path.join(folder, "documents.parquet")):
        runs, documents = files.library(spark, root)
        return runs.where(F.col("library") == name), documents.where(F.col("library") == name)
    manifest = files.manifests(spark, os.path.join(folder, "manifest.json"))
    return manifest.select("library", "query"), library.migrate_manifest(manifest, "library")


def list_library_docs(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Documents of one library with a stored file that is there, in title order."""
    _, documents = open_library(spark, root, name)
    return library.library_docs(documents)


def run_log_info(path: str) -> dict:
    """Where the run log is, whether it is there, and its bytes."""
    there = os.path.exists(path)
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names) if os.path.isdir(path) else os.path.getsize(path) if there else 0
    return {"path": path, "exists": there, "size_bytes": size}


def run_log_tail(spark: SparkSession, path: str, most: int = 200) -> DataFrame:
    """The last entries of the run log (a file, or a folder of JSON lines), in order, from a bounded window at its end."""
    return run_log.tail(spark, path, most)


def export_library_zip(spark: SparkSession, root: str, name: str, target: str, include_text: bool = True, include_originals: bool = True) -> tuple[int, int]:
    """Writes a library's files to a zip: files and bytes."""
    folder = os.path.join(root, name)
    if not library.confined(root, name) or library.is_sensitive_root(folder):
        raise CommandError(f"not a library: {name}")
    inside = files.listing(spark, folder).select(F.expr(f"substring(path, instr(path, '/{name}/') + {len(name) + 2})").alias("path"), "length")
    chosen = library.export_selection(inside, include_text, include_originals)
    return library.export_zip(folder, [r.path for r in chosen.select("path").toLocalIterator()], target)


def delete_library(root: str, name: str) -> None:
    """Removes a library's folder; only one that is inside ``root`` and holds a library."""
    folder = os.path.join(root, name)
    if not library.confined(root, name) or os.path.islink(folder) or library.is_sensitive_root(folder) or os.path.realpath(folder) == os.path.realpath(root):
        raise CommandError(f"not a library: {name}")
    if not library.is_library(folder) and not os.path.exists(os.path.join(folder, "documents.parquet")):
        raise CommandError(f"not a library: {name}")
    shutil.rmtree(folder)


def save_settings(settings: DataFrame) -> DataFrame:
    """Settings as they are safe to keep."""
    return session.sanitized(settings)
