"""Run events out of the plan itself: metrics that stages observe while they run.

``Watch.count`` adds an observation to a DataFrame; the action that uses it fills it, at no extra
job. ``Watch.events`` then gives the metrics as event rows of each run, which
``session.reduce_run`` folds as it folds any others. Metrics are kept per run as a bounded map:
as many runs as are named when the watch is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

COLUMNS = "run_id long, seq long, type string, url string, source string, kind string, count long, done long, failed long, total long, kept long, rejected long, folder string, message string"


class Watch:
    """Observations of the stages of some runs; each stage is watched once and read after its action."""

    def __init__(self, spark: SparkSession, runs: list[int]):
        self.spark, self.runs, self.seen = spark, sorted(runs), {}

    def count(self, df: DataFrame, stage: str, **metrics: Column) -> DataFrame:
        """``df``, observed: rows of each run where each condition of ``metrics`` holds."""
        if stage in self.seen:
            raise ValueError(f"{stage} is watched already")
        observation = Observation(stage)
        self.seen[stage] = (observation, tuple(metrics))
        each = [F.count_if((F.col("run_id") == run) & F.coalesce(c, F.lit(False))).alias(f"{name}_{run}") for name, c in metrics.items() for run in self.runs]
        return df.observe(observation, *each)

    def get(self, stage: str) -> dict[int, dict[str, int]]:
        """Figures of a stage whose action is done, by run and metric."""
        observation, names = self.seen[stage]
        got = observation.get
        return {run: {name: got[f"{name}_{run}"] for name in names} for run in self.runs}

    def events(self) -> DataFrame:
        """Event rows of all stages so far: found, ranking_done, and complete with the downloads' counts."""
        rows: list[dict] = []
        for run in self.runs:
            seq = 0

            def add(kind: str, **values) -> None:
                nonlocal seq
                seq += 1
                rows.append({"run_id": run, "seq": seq, "type": kind, **values})  # noqa: B023 (used at once)

            add("start")
            if "discovery" in self.seen:
                add("found", total=self.get("discovery")[run]["found"])
            if "ranking" in self.seen:
                n = self.get("ranking")[run]
                add("ranking_done", kept=n["kept"], rejected=n["rejected"])
                add("found_total", count=n["kept"])
            if "download" in self.seen:
                n = self.get("download")[run]
                add("complete", done=n["done"], failed=n["failed"], total=n["done"] + n["failed"])
        names = [c.split(" ")[0] for c in COLUMNS.split(", ")]
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], COLUMNS)


def watched_candidates(watch: Watch, merged: DataFrame, ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two stages of a search, observed: documents found, and rows kept and rejected."""
    return watch.count(merged, "discovery", found=F.lit(True)), watch.count(ranked, "ranking", kept=F.col("status") == "kept", rejected=F.col("status") == "rejected")
