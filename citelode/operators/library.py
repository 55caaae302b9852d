"""The library of finished runs: upserts, listings, reuse, exports."""

from __future__ import annotations

import os
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Extensions of a reusable file, in the order they are taken.
EXTENSIONS = (".pdf", ".epub", ".html", ".txt")
MIN_BYTES = 4096
ORIGINALS = ("pdf", "epub", "html", "htm")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(x: Column) -> Column:
    """Only A-Z lower-cased, as a NOCASE order compares."""
    return F.translate(x, _UPPER, _LOWER)


def upsert_documents(existing: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """One row for each address, all columns of the latest run's last row; ids stay.

    ``incoming`` has the columns of ``existing`` without ``id``, and ``seq``, its order.
    """
    both = existing.withColumn(seq, F.lit(-1).cast("long")).unionByName(incoming.withColumn("id", F.lit(None).cast("long")))
    w = Window.partitionBy("url")
    latest = F.row_number().over(w.orderBy(F.desc("run_id"), F.desc(seq)))
    return both.withColumn("id", F.max("id").over(w)).withColumn("__n", latest).where("__n = 1").drop("__n", seq)


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def migrate_manifest(manifests: DataFrame, order: str) -> DataFrame:
    """Documents of legacy manifests, the first of each address, size 0, authors joined by commas."""
    rows = manifests.select(order, F.posexplode("documents").alias("pos", "d")).select(order, "pos", "d.*")
    first = F.row_number().over(Window.partitionBy("url").orderBy(order, "pos"))
    rows = rows.withColumn("__n", first).where("__n = 1").drop("__n")
    return rows.withColumn("authors", F.array_join("authors", ", ")).withColumn("size_bytes", F.lit(0).cast("long"))


def library_summary(runs: DataFrame, documents: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Libraries by name, descending: latest query, documents, bytes. Libraries without a run are left out.

    All tables carry ``library``; ``files`` has ``length``.
    """
    latest = runs.groupBy("library").agg(F.max_by("query", F.struct("created_at", "id")).alias("query"))
    out = latest.join(documents.groupBy("library").agg(F.count(F.lit(1)).alias("n_docs")), "library", "left")
    if files is not None:
        out = out.join(files.groupBy("library").agg(F.sum("length").alias("size_bytes")), "library", "left").fillna(0, ["size_bytes"])
    return out.fillna(0, ["n_docs"]).orderBy(F.desc("library"))


def library_docs(documents: DataFrame, files: DataFrame | None = None, library: str | None = None) -> DataFrame:
    """Documents with a stored file that is there, in title order (ASCII letter case aside).

    With the column that names the ``library``, their ``place`` within it is added.
    """
    rows = documents.where(F.coalesce("local_path", F.lit("")) != "")
    if files is not None:
        rows = rows.join(files.select(F.col("path").alias("local_path")).distinct(), "local_path", "left_semi")
    order = (ascii_lower(F.col("title")), F.col("url"))
    if library is not None:
        return rows.withColumn("place", F.row_number().over(Window.partitionBy(library).orderBy(*order)))
    return rows.orderBy(*order)


def filter_libraries(libraries: DataFrame, text: str) -> DataFrame:
    """Libraries whose query contains a text, letter case aside."""
    return libraries.where(F.contains(F.lower("query"), F.lower(F.lit(text.strip()))))


def recency(name: Column) -> tuple[Column, Column]:
    """Sort keys of a library's name, newest first; names without a time stamp last."""
    part = lambda i: F.coalesce(F.try_to_number(F.regexp_extract(name, r"-(\d+)-(\d+)$", i), F.lit("9" * 19)), F.lit(0))
    return F.desc(part(1)), F.desc(part(2))


def sort_libraries(libraries: DataFrame, mode: str = "recent") -> DataFrame:
    """By ``recent``, ``size`` or ``docs``, largest first."""
    keys = recency(F.col("name")) if mode == "recent" else (F.desc("size_bytes" if mode == "size" else "n_docs"),)
    return libraries.orderBy(*keys, "name")


def lifetime_stats(libraries: DataFrame) -> DataFrame:
    """Number of libraries, their bytes and documents."""
    return libraries.agg(F.count(F.lit(1)).alias("libraries"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"))


def reuse_from_siblings(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """For each slug wanted, the file of another library that serves: pdf, epub, html, txt in this order.

    ``wanted`` has ``library, slug``; ``files`` has ``library, slug, ext, length, valid``.
    """
    order = F.array_position(F.array(*[F.lit(e) for e in EXTENSIONS]), F.col("ext"))
    good = files.where((F.col("length") >= MIN_BYTES) & F.col("valid") & F.col("ext").isin(*EXTENSIONS)).withColumnRenamed("library", "from_library")
    found = wanted.join(good, "slug").where("library <> from_library")
    first = F.row_number().over(Window.partitionBy("library", "slug").orderBy(order, "from_library"))
    return found.withColumn("__n", first).where("__n = 1").drop("__n", "valid")


def open_access_fallback(failed: DataFrame, locations: DataFrame) -> DataFrame:
    """Failed downloads with an open-access address to try once, null where there is none or it is the same.

    ``failed`` has ``url, doi``; ``locations`` has ``doi, url_for_pdf``.
    """
    best = locations.groupBy("doi").agg(F.first("url_for_pdf", ignorenulls=True).alias("url_for_pdf"))
    out = failed.join(best, "doi", "left")
    return out.withColumn("retry_url", F.when(F.col("url_for_pdf") != F.col("url"), F.col("url_for_pdf"))).drop("url_for_pdf")


def retry_failed(outcomes: DataFrame) -> DataFrame:
    """Documents that failed and didn't succeed later: ``url`` with its last failure.

    ``outcomes`` has ``run_id, url, seq, status``.
    """
    done = outcomes.where("status = 'done'").groupBy("run_id", "url").agg(F.max("seq").alias("done_seq"))
    failed = outcomes.where("status = 'failed'").groupBy("run_id", "url").agg(F.max("seq").alias("failed_seq"))
    return failed.join(done, ["run_id", "url"], "left").where("done_seq is null or done_seq < failed_seq").select("run_id", "url", "failed_seq")


def write_texts(extracted: DataFrame, path: str) -> None:
    """Writes texts by file stem, Parquet partition-free; Spark's committer renames when all is there."""
    extracted.where("text is not null").select("stem", "text").write.mode("overwrite").parquet(path)


def is_sensitive_root(path: str) -> bool:
    """Whether a folder is too general to write to or remove: a root, a home, or a standard folder of one."""
    p, home = Path(path).resolve(), Path.home().resolve()
    standard = {home / n for n in ("Desktop", "Documents", "Downloads", "Music", "Pictures", "Videos", "Public", "Templates")}
    return p == Path(p.anchor) or p == home or p in home.parents or p in standard


def confined(root: str, path: str) -> bool:
    """Whether a path, ``..`` resolved, lies inside a folder."""
    top = os.path.realpath(root)
    return os.path.commonpath([top, os.path.realpath(os.path.join(top, path))]) == top


def is_library(folder: str) -> bool:
    """Whether a folder may be deleted as a library: it holds a database or a manifest."""
    return any((Path(folder) / n).is_file() for n in ("library.db", "manifest.json"))


def export_selection(files: DataFrame, include_text: bool = True, include_originals: bool = True) -> DataFrame:
    """The files of a library that an export takes; ``path`` is relative, with slashes."""
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") | (p == "_index"))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    text = F.get(parts, F.lit(0)) == "_text"
    return files.where(~hidden & (F.lit(include_text) | ~text) & (F.lit(include_originals) | text | ~ext.isin(*ORIGINALS)))


def export_zip(folder: str, paths: list[str], target: str) -> tuple[int, int]:
    """Writes the selected files of one library to a zip, under a temporary name first: files and bytes."""
    part = f"{target}.part"
    with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
        for p in sorted(paths):
            if confined(folder, p) and not os.path.islink(os.path.join(folder, p)):
                z.write(os.path.join(folder, p), p)
        n = len(z.namelist())
    os.replace(part, target)
    return n, os.path.getsize(target)
