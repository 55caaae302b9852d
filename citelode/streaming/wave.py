"""A discovery wave over a stream: shared matching that ends by drain, cap, cancel or deadline.

Each run is a key with its own state: what is known of the wave, and one map for each kind of
matching key. Maps grow by the rows that bring new keys and are read by key, so a batch costs
what its rows need, whatever a run holds. A processing-time timer ends a wave that hangs. A
second wave goes on in the same state, if the run wasn't cancelled and has room.

Needs a state store that holds maps: set ``spark.sql.streaming.stateStore.providerClass`` to
Spark's RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from citelode.operators.dedup import MAX_TOTAL, SHORT_TITLE, with_keys
from citelode.operators.schemas import DOCUMENT

#: What a stream of waves holds: a discovery's columns, and what kind of row it is.
EVENTS = f"run_id long, event string, tasks int, arrival_seq long, source_id string, rank_in_source int, {DOCUMENT}"
OUTCOMES = "run_id long, wave int, arrival_seq long, outcome string, insert_idx int, total int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def deadlines(max_total: int) -> tuple[int, int]:
    """Milliseconds that the first and the second wave may take."""
    return 1000 * min(15 + max_total // 40, 60), 1000 * min(12 + max_total // 50, 45)


def _none(x):
    return None if x is None or x != x else x


class Wave(StatefulProcessor):
    """The waves of one run: its events in, an outcome for each discovery and each end out."""

    def __init__(self, max_total: int, limits: tuple[int, int]):
        self.max_total, self.limits = max_total, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.wave = handle.getValueState("wave", "wave int, open boolean, cancelled boolean, left int, total int, timer long")
        self.urls = handle.getMapState("urls", "key string", "idx int")
        self.dois = handle.getMapState("dois", "key string", "idx int")
        self.titles = handle.getMapState("titles", "key string", "idx int, year string, surname string")
        self.marks = handle.getMapState("marks", "key string", "idx int, norm string")

    @staticmethod
    def _at(state, key: str | None):
        return state.getValue((key,)) if key is not None and state.containsKey((key,)) else None

    def _match(self, row: dict) -> tuple[int, bool] | None:
        """The document that a row is another copy of, and whether its DOI gets known by it."""
        if at := self._at(self.urls, row["url"]):
            return at[0], False
        if at := self._at(self.dois, row["doi"]):
            return at[0], False
        norm, year = row["norm"], row["year"]
        if norm not in ("", "untitled") and (at := self._at(self.titles, norm)):
            same_year = year is not None and len(year.encode()) == 4 and year == at[1]
            if len(norm.split()) >= SHORT_TITLE or same_year or (row["surname"] is not None and row["surname"] == at[2]):
                return at[0], True
        if (at := self._at(self.marks, row["fingerprint"])) and norm and at[1] and (norm.startswith(at[1]) or at[1].startswith(norm)):
            return at[0], True
        return None

    def _add(self, row: dict, total: int) -> tuple[str, int]:
        """Takes a row in: new or merged, and its document's number."""
        found = self._match(row)
        idx = total if found is None else found[0]
        if not self.urls.containsKey((row["url"],)):
            self.urls.updateValue((row["url"],), (idx,))
        if row["doi"] is not None and (found is None or found[1]) and not self.dois.containsKey((row["doi"],)):
            self.dois.updateValue((row["doi"],), (idx,))
        if found is not None:
            return "merged", idx
        if row["norm"] not in ("", "untitled") and not self.titles.containsKey((row["norm"],)):
            self.titles.updateValue((row["norm"],), (idx, row["year"], row["surname"]))
        if row["fingerprint"] is not None and not self.marks.containsKey((row["fingerprint"],)):
            self.marks.updateValue((row["fingerprint"],), (idx, row["norm"]))
        return "new", idx

    def _start(self, now: dict, tasks: int | None, clock: int) -> None:
        due = clock + self.limits[min(now["wave"], 1)]
        self.handle.registerTimer(due)
        now |= {"wave": now["wave"] + 1, "open": True, "left": -1 if tasks is None else tasks, "timer": due}

    def _end(self, now: dict, reason: str) -> tuple:
        now["open"] = False
        if now["timer"]:
            self.handle.deleteTimer(now["timer"])
            now["timer"] = 0
        return now["wave"], None, reason, None, now["total"]

    def _load(self) -> dict:
        names = ("wave", "open", "cancelled", "left", "total", "timer")
        return dict(zip(names, self.wave.get() if self.wave.exists() else (0, False, False, 0, 0, 0), strict=True))

    def _frame(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["wave", "arrival_seq", "outcome", "insert_idx", "total"])
        frame.insert(0, "run_id", key[0])
        return frame.astype({"wave": "int32", "arrival_seq": "Int64", "insert_idx": "Int32", "total": "int32"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        now, out = self._load(), []
        frame = pd.concat(list(rows)).sort_values("arrival_seq", kind="stable")
        clock = timerValues.getCurrentProcessingTimeInMs()
        for raw in frame.to_dict("records"):
            row = {k: _none(v) for k, v in raw.items()}
            event, seq = row["event"], row["arrival_seq"]
            if event == "cancel":
                if not now["cancelled"]:
                    now["cancelled"] = True
                    out.append(self._end(now, "cancelled"))
            elif event == "start":
                if now["cancelled"] or now["total"] >= self.max_total:
                    out.append((now["wave"] + 1, None, "skipped", None, now["total"]))
                elif not now["open"]:
                    self._start(now, _none(row["tasks"]), clock)
            elif event == "done":
                if now["open"] and now["left"] > 0:
                    now["left"] -= 1
                    if now["left"] == 0:
                        out.append(self._end(now, "drained"))
            else:
                if not now["open"] and now["wave"] == 0 and not now["cancelled"]:
                    self._start(now, None, clock)
                if now["total"] >= self.max_total:
                    out.append((now["wave"], seq, "capped", None, now["total"]))
                elif not now["open"]:
                    out.append((now["wave"], seq, "late", None, now["total"]))
                else:
                    outcome, idx = self._add(row, now["total"])
                    now["total"] += outcome == "new"
                    out.append((now["wave"], seq, outcome, idx, now["total"]))
                    if now["total"] >= self.max_total:
                        out.append(self._end(now, "full"))
        self.wave.update(tuple(now.values()))
        if out:
            yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        now = self._load()
        if now["open"] and now["timer"] == expiredTimerInfo.getExpiryTimeInMs():
            now["timer"] = 0
            out = [self._end(now, "deadline")]
            self.wave.update(tuple(now.values()))
            yield self._frame(key, out)

    def close(self) -> None:
        pass


def wave_stream(events: DataFrame, max_total: int = MAX_TOTAL, limits: tuple[int, int] | None = None) -> DataFrame:
    """Outcomes of a stream of ``EVENTS``: ``run_id, wave, arrival_seq, outcome, insert_idx, total``.

    ``event`` is start (``tasks`` that will report; null where unknown), found, done (one task
    is), or cancel. A discovery is new, merged, capped once the run is full, or late after its
    wave's end. A wave's end has no ``arrival_seq``: drained, full, cancelled or deadline; a
    second start is skipped where it can't add anything. Within a batch rows count in
    ``arrival_seq``, those of control too. ``limits`` are the waves' milliseconds. With timers a
    stream never runs dry, so its query needs a processing-time trigger, not ``availableNow``.
    """
    columns = ["run_id", "event", "tasks", "arrival_seq", "url", "doi", "norm", "surname", "fingerprint", "year"]
    keyed = with_keys(events).withColumn("url", F.coalesce("url", F.lit(""))).select(*columns)
    wave = Wave(max_total, limits or deadlines(max_total))
    return keyed.groupBy("run_id").transformWithStateInPandas(wave, OUTCOMES, "append", "processingTime")


class Remembered(StatefulProcessor):
    """Answers kept for a while: the state itself forgets them."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "value string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        out = []
        for row in pd.concat(list(rows)).sort_values("seq", kind="stable").to_dict("records"):
            if (value := _none(row["value"])) is not None:
                self.kept.update((value,))
            else:
                out.append((key[0], row["seq"], self.kept.get()[0] if self.kept.exists() else None))
        if out:
            yield pd.DataFrame(out, columns=["key", "seq", "value"]).astype({"seq": "int64"})

    def close(self) -> None:
        pass


def cached_stream(rows: DataFrame, ttl_ms: int) -> DataFrame:
    """Questions of a stream of ``key, seq, value`` (null: a question) with the answer stored last, null once it is older than ``ttl_ms``.

    Processing time, as the cache it stands for; ``session.cached`` is the same over event time.
    """
    return rows.groupBy("key").transformWithStateInPandas(Remembered(ttl_ms), "key string, seq long, value string", "append", "processingTime")
