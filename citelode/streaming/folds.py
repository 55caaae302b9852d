"""The order-dependent folds over streams: the same steps as in batch, state kept by run or engine."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from citelode.operators.dedup import MAX_TOTAL, Matcher, with_keys
from citelode.operators.events import breaker_step

_KEYS = ("url", "doi", "norm", "surname", "fingerprint", "year")


def resolve_stream(discoveries: DataFrame, max_total: int = MAX_TOTAL) -> DataFrame:
    """Outcome of each discovery as it arrives: ``run_id, arrival_seq, outcome, insert_idx``.

    ``outcome`` is new, merged, or capped once the run is full. Rows of a micro-batch are taken
    in ``arrival_seq``, batches as they come; so a stream that delivers in order gives what the
    batch fold gives. State is one matcher for each run, bounded by ``max_total``.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        matcher: Matcher = pickle.loads(state.get[0]) if state.exists else Matcher()
        rows = pd.concat(list(parts)).sort_values("arrival_seq", kind="stable")
        rows = rows.astype(object).where(rows.notna(), None)
        out = []
        for row in rows.to_dict("records"):
            if len(matcher.kept) >= max_total:
                out.append((row["arrival_seq"], "capped", None))
                continue
            idx, new = matcher.add({k: row[k] for k in _KEYS})
            out.append((row["arrival_seq"], "new" if new else "merged", idx if new else None))
        state.update((pickle.dumps(matcher),))
        done = pd.DataFrame(out, columns=["arrival_seq", "outcome", "insert_idx"])
        done.insert(0, "run_id", key[0])
        yield done.astype({"arrival_seq": "int64", "insert_idx": "Int64"})

    schema = "run_id long, arrival_seq long, outcome string, insert_idx long"
    return with_keys(discoveries).groupBy("run_id").applyInPandasWithState(step, schema, "matcher binary", "append", GroupStateTimeout.NoTimeout)


def breaker_stream(calls: DataFrame) -> DataFrame:
    """The circuit breaker's state after each call, as calls arrive."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, until = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
        out = []
        for seq, ts, outcome in zip(rows["seq"], rows["ts"], rows["outcome"], strict=True):
            failures, until, skipped = breaker_step(failures, until, ts, outcome)
            out.append((key[0], seq, failures, ts < until, skipped))
        state.update((failures, until))
        yield pd.DataFrame(out, columns=["backend", "seq", "failures", "open", "skipped"])

    schema = "backend string, seq long, failures long, open boolean, skipped boolean"
    return calls.groupBy("backend").applyInPandasWithState(step, schema, "failures long, until double", "append", GroupStateTimeout.NoTimeout)


def throughput_stream(samples: DataFrame, late: str = "10 seconds") -> DataFrame:
    """MB a second in windows of 0.6 s of event time; ``samples`` has ``run_id, ts, bytes``."""
    w = F.window("ts", "600 milliseconds")
    out = samples.withWatermark("ts", late).groupBy("run_id", w).agg((F.sum("bytes") / 0.6e6).alias("mbps"))
    return out.select("run_id", F.col("window.start").alias("start"), "mbps")


def unique_urls_stream(results: DataFrame, late: str = "1 hour") -> DataFrame:
    """Results whose address hasn't come within the watermark; ``results`` has ``url, ts``."""
    from citelode.functions.urls import url_key

    return results.withColumn("url_key", url_key(F.col("url"))).withWatermark("ts", late).dropDuplicatesWithinWatermark(["url_key"])


def append_log(entries: DataFrame, path: str, checkpoint: str):
    """Appends a stream of log entries as JSON lines, each once."""
    return entries.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
