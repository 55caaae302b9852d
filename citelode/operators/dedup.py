"""Entity resolution of discovered documents.

``resolve`` reproduces the order-dependent, five-step matcher exactly: a fold over each run's
discoveries in arrival order. A run's rows are bounded by its caps on sources and sub-queries,
which come before, so a fold's state is small, and runs are folded in parallel;
``matching.resolve_large`` is the same for runs of any size. ``resolve_relational`` is a different
operator for one corpus: the same keys, each as a keep-first pass without a fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citelode.functions.text import author_year_fingerprint, first_author_surname, is_sentinel_title, normalize_title
from citelode.functions.urls import extract_doi, url_key
from citelode.operators.scan import scan
from citelode.operators.schemas import DOCUMENT_FIELDS

SHORT_TITLE = 5
MAX_TOTAL = 500


def with_keys(df: DataFrame) -> DataFrame:
    """Adds ``doi, norm, surname, fingerprint``, the keys that the matcher compares."""
    doi = F.coalesce(extract_doi(F.col("url")), extract_doi(F.col("identifier")))
    return (
        df.withColumn("doi", doi)
        .withColumn("norm", normalize_title(F.col("title")))
        .withColumn("surname", first_author_surname(F.col("authors")))
        .withColumn("fingerprint", author_year_fingerprint(F.col("authors"), F.col("year"), F.col("title")))
    )


class Matcher:
    """The fold's state: documents kept so far and an index for each key."""

    def __init__(self) -> None:
        self.kept: list[dict] = []
        self.at: dict[str, dict[str, int]] = {"url": {}, "doi": {}, "norm": {}, "fingerprint": {}}

    def _find(self, row: dict) -> tuple[int, bool] | None:
        """The kept document that a row is another copy of, and whether its DOI gets known by it."""
        if (i := self.at["url"].get(row["url"])) is not None:
            return i, False
        if row["doi"] is not None and (i := self.at["doi"].get(row["doi"])) is not None:
            return i, False
        if row["norm"] not in ("", "untitled") and (i := self.at["norm"].get(row["norm"])) is not None:
            other = self.kept[i]
            same_year = row["year"] is not None and len(row["year"].encode()) == 4 and row["year"] == other["year"]
            same_name = row["surname"] is not None and row["surname"] == other["surname"]
            if len(row["norm"].split()) >= SHORT_TITLE or same_year or same_name:
                return i, True
        if row["fingerprint"] is not None and (i := self.at["fingerprint"].get(row["fingerprint"])) is not None:
            a, b = row["norm"], self.kept[i]["norm"]
            if a and b and (a.startswith(b) or b.startswith(a)):
                return i, True
        return None

    def add(self, row: dict) -> tuple[int, bool]:
        """Takes a row in; its document's number, and whether that is new."""
        if found := self._find(row):
            i, learns_doi = found
            self.at["url"].setdefault(row["url"], i)
            if learns_doi and row["doi"] is not None:
                self.at["doi"][row["doi"]] = i
            return i, False
        i = len(self.kept)
        self.kept.append(row)
        self.at["url"][row["url"]] = i
        for key in ("doi", "norm", "fingerprint"):
            if row[key] is not None and not (key == "norm" and row[key] in ("", "untitled")):
                self.at[key].setdefault(row[key], i)
        return i, True


_KEYS = ("url", "doi", "norm", "surname", "fingerprint", "year")


def merged(discoveries: DataFrame, max_total: int = MAX_TOTAL) -> DataFrame:
    """``run_id, insert_idx, first_seq, source_ranks`` of each run's merged documents, without their fields.

    Rows are taken in ``arrival_seq``, distinct within a run. Once a run has ``max_total``
    documents, what arrives later counts for nothing, copies included. Only keys go through the
    fold.
    """

    def step(matcher: Matcher, *values) -> tuple[Matcher, tuple[int | None, bool | None]]:
        if len(matcher.kept) >= max_total:
            return matcher, (None, None)
        return matcher, matcher.add(dict(zip(_KEYS, values, strict=True)))

    keys = with_keys(discoveries).select("run_id", "arrival_seq", "source_id", "rank_in_source", *_KEYS)
    rows = scan(keys, ["run_id"], ["arrival_seq"], list(_KEYS), "insert_idx int, new boolean", Matcher, step).where("insert_idx is not null")
    rank = F.struct("arrival_seq", F.col("source_id").alias("source"), F.col("rank_in_source").alias("rank"))
    out = rows.groupBy("run_id", "insert_idx").agg(F.max(F.when(F.col("new"), F.col("arrival_seq"))).alias("first_seq"), F.array_sort(F.collect_list(rank)).alias("__ranks"))
    return out.select("run_id", "insert_idx", "first_seq", F.transform("__ranks", lambda r: F.struct(r["source"].alias("source"), r["rank"].alias("rank"))).alias("source_ranks"))


def with_fields(discoveries: DataFrame, documents: DataFrame) -> DataFrame:
    """``documents`` (rows of ``merged``, more columns may follow) with the fields of the copies that came first."""
    more = [c for c in documents.columns if c not in ("run_id", "insert_idx", "first_seq")]
    d = documents.withColumnsRenamed({"run_id": "__run", "first_seq": "__first"})
    out = discoveries.select("run_id", "arrival_seq", *DOCUMENT_FIELDS).join(d, F.col("run_id").eqNullSafe(F.col("__run")) & (F.col("arrival_seq") == F.col("__first")))
    return out.select("run_id", "insert_idx", *DOCUMENT_FIELDS, *more)


def resolve(discoveries: DataFrame, max_total: int = MAX_TOTAL) -> DataFrame:
    """Merged documents of each run: ``run_id, insert_idx``, the first copy's fields, ``source_ranks``.

    See ``merged``; fields are joined back to the rows that became documents.
    """
    return with_fields(discoveries, merged(discoveries, max_total))


def resolve_relational(discoveries: DataFrame, key: str = "arrival_seq") -> DataFrame:
    """Documents left by keep-first passes over address, DOI, long title and fingerprint.

    Not the fold: each pass sees what the one before left, anchors are the earliest rows, and no
    key is learned from a copy. Shuffles once a pass; rows without the pass's key stay. A title
    counts from five words on; a fingerprint needs one title to start with the other.
    """
    df = with_keys(discoveries)

    def first_of(df: DataFrame, column: str, counts) -> DataFrame:
        # rows without the key are dealt by their own number, so they never gather in one task
        spread = F.when(counts, F.col(column)).otherwise(F.concat(F.lit("\0"), F.col(key).cast("string")))
        w = Window.partitionBy("run_id", spread).orderBy(key)
        return df.withColumn("__first", F.row_number().over(w)).where("__first = 1").drop("__first")

    df = first_of(df, "url", F.col("url").isNotNull())
    df = first_of(df, "doi", F.col("doi").isNotNull())
    df = first_of(df, "norm", ~is_sentinel_title(F.col("norm")) & (F.size(F.split("norm", " ")) >= SHORT_TITLE))
    spread = F.coalesce("fingerprint", F.concat(F.lit("\0"), F.col(key).cast("string")))
    anchor = F.first("norm").over(Window.partitionBy("run_id", spread).orderBy(key))
    number = F.row_number().over(Window.partitionBy("run_id", spread).orderBy(key))
    df = df.withColumn("__anchor", anchor).withColumn("__n", number)
    copy = (F.col("__n") > 1) & (F.col("norm") != "") & (F.col("norm").startswith(F.col("__anchor")) | F.col("__anchor").startswith(F.col("norm")))
    return df.where(~copy).drop("__anchor", "__n", "doi", "norm", "surname", "fingerprint")


def dedup_by_url_key(df: DataFrame, url: str, order: str, partition: list[str] | None = None) -> DataFrame:
    """The first row of each address, fragment, trailing slash and letter case aside."""
    w = Window.partitionBy(*(partition or []), url_key(F.col(url))).orderBy(order)
    return df.withColumn("__first", F.row_number().over(w)).where("__first = 1").drop("__first")


def dedup_first(df: DataFrame, keys: list, order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__first", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__first = 1").drop("__first")
