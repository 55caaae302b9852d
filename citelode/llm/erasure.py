"""Cascading erasure: tables as files of consecutive rows, from which clients vanish without a trace.

``layout`` sorts a table over all executors, numbers its rows by each partition's place, and
writes exactly one Parquet file for each number: a partition for each file, sorted inside, into
a staging folder which is renamed when it is whole. ``erase`` finds the files that hold victims
by semi-joins on key columns alone, reads only those files' partitions and replaces them by
dynamic partition overwrite; files of which nothing is left are deleted. A file is written by
one task, which streams through rows that Spark has sorted with spilling.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citelode.llm.common import discard, shared_dir, stage

#: A table has at most so many files.
FILES = 150


def rows_a_file(n: int) -> int:
    """Rows of each file but the last of a table of ``n`` rows."""
    return 1 + n // FILES


def _fs(spark: SparkSession, path: str):
    """Hadoop's file system and path object of a path."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()), at


def _free(name: str, taken: list[str]) -> str:
    """The name, with underscores until no column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


class Laid:
    """A table's files: the folder, the columns in them, how many files were written, and the folders' column."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, files: int, number: str):
        self.spark, self.folder, self.schema, self.files, self.number = spark, folder, schema, files, number

    def read(self) -> DataFrame:
        """All rows as written, and the number of their file."""
        return self.spark.read.schema(StructType([*self.schema.fields]).add(self.number, "long")).parquet(self.folder)

    def by_file(self, rows: DataFrame) -> DataFrame:
        """``rows``, which have ``__at``, one partition for each file and in order."""
        return rows.repartitionById(max(1, self.files), F.col(self.number).cast("int")).sortWithinPartitions(self.number, "__at")


def _numbered(df: DataFrame, keep: list[str], key: Column) -> tuple[DataFrame, int]:
    """Columns ``keep`` with ``__at``, a row's place from 0 by ``key`` and then all of them, and the number of rows.

    A range sort deals rows out by all columns, so a hot key spreads over partitions. They are
    written once, each partition's rows counted, and the running sum of the counts, one row for
    each partition, says where a partition begins.
    """
    columns = [F.col(f"`{c}`") for c in keep]
    rows = df.select(*columns, key.alias("__key")).orderBy("__key", *(c.asc_nulls_first() for c in columns))
    # the lower bits of this number count the rows of a partition, which come sorted
    rows = stage(rows.select(*columns, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__in"), F.spark_partition_id().alias("__part")), "erasure-sorted")
    starts, n = [], 0
    for part, count in sorted((r[0], r[1]) for r in rows.groupBy("__part").count().collect()):
        starts.append((part, n))
        n += count
    begin = F.broadcast(df.sparkSession.createDataFrame(starts, "__part int, __from long"))
    out = rows.join(begin, "__part").withColumn("__at", F.col("__from") + F.col("__in"))
    out._staged = rows._staged
    return out, n


def layout(df: DataFrame, folder: str, key: Column, keep: list[str] | None = None) -> Laid:
    """Writes ``df`` under ``folder`` as files of consecutive rows, ``file_no`` from 0.

    Rows are sorted by ``key``, then by the columns ``keep`` (all) from left to right, nulls
    first; repeated rows stay as they are. The folder appears whole: files go to a folder beside
    it, which is then renamed. An empty table gives a folder without files. Where the table has a
    column ``file_no``, the folders' column is ``file_no_``.
    """
    spark, keep = df.sparkSession, keep or df.columns
    columns = [F.col(f"`{c}`") for c in keep]
    rows, n = _numbered(df, keep, key)
    size = rows_a_file(n)
    out = Laid(spark, folder, df.select(*columns).schema, -(-n // size), _free("file_no", keep))
    staging = f"{folder}.staging-{uuid.uuid4().hex}"
    dealt = out.by_file(rows.withColumn(out.number, F.expr(f"__at div {size}")))
    dealt.select(*columns, out.number).write.option("maxRecordsPerFile", 0).partitionBy(out.number).parquet(staging)
    discard(rows)
    fs, at = _fs(spark, staging)
    target = _fs(spark, folder)[1]
    fs.mkdirs(target.getParent())
    if not fs.rename(at, target):
        raise RuntimeError(f"{folder} can't be put in place")
    return out


def erase(table: Laid, victims: DataFrame, on: str) -> dict[int, int]:
    """Rewrites the files that hold rows whose ``on`` is in ``victims``; erased rows by file number.

    ``victims`` has one column of distinct values without null, of any number. Survivors keep
    their order and their file's number; a file without any is deleted; others aren't touched. A
    null ``on`` is no victim. May be repeated: what an earlier attempt left is found again.
    """
    number, ids, own = table.number, victims.toDF("__victim"), F.col(f"`{on}`") == F.col("__victim")
    # a row for each file, at most FILES of them
    erased = {r[0]: r[1] for r in table.read().join(ids, own, "left_semi").groupBy(number).count().collect()}
    if not erased:
        return {}
    part = table.read().where(F.col(number).isin(sorted(erased)))
    held = {r[0]: r[1] for r in part.groupBy(number).count().collect()}
    left = part.withColumn("__at", F.col("_metadata.row_index")).join(ids, own, "left_anti")
    left = table.by_file(left).drop("__at")
    left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 0).partitionBy(number).parquet(table.folder)
    for file_no, n in erased.items():
        if n == held[file_no]:
            fs, at = _fs(table.spark, f"{table.folder}/{number}={file_no}")
            fs.delete(at, True)
    return erased


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each file's ids, which come file by file and in order."""
    now, sha = None, hashlib.sha256()

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([sha.hexdigest()], pa.string())], names=["file_no", "ids_sha256"])

    for batch in batches:
        numbers, ids = batch.column("file_no").to_numpy(), batch.column("id").to_pylist()
        cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if numbers[a] != now:
                if now is not None:
                    yield row()
                now, sha = int(numbers[a]), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(",".join(ids[a:b]).encode())
    if now is not None:
        yield row()


def report(table: Laid, name: str, amount: str, erased: dict[int, int]) -> DataFrame:
    """One row for each file of the folder, read back from it.

    ``file_no, n_rows, n_erased, cents, rewritten, table_name, ids_sha256, columns, path``:
    ``cents`` sums ``amount``, rounded, null as 0; the hash is of the first column in file order.
    """
    rows = table.read()
    first = rows.columns[0]
    rows = rows.select(F.col(table.number).alias("file_no"), F.col(f"`{first}`").alias("id"), F.col(f"`{amount}`").alias("amount"), F.col("_metadata.row_index").alias("__at"), F.col("_metadata.file_path").alias("path"))
    cents = F.coalesce(F.floor(100 * F.col("amount") + 0.5), F.lit(0))
    sums = rows.groupBy("file_no").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(cents).cast("long").alias("cents"), F.min("path").alias("path"))
    ids = Laid(table.spark, table.folder, table.schema, table.files, "file_no").by_file(rows.select("file_no", "__at", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id")))
    hashes = ids.mapInArrow(_hashed, "file_no long, ids_sha256 string")
    gone = table.spark.createDataFrame(sorted(erased.items()), "file_no long, n_erased long")
    out = sums.join(hashes, "file_no").join(F.broadcast(gone), "file_no", "left")
    return out.select(
        "file_no",
        "n_rows",
        F.coalesce("n_erased", F.lit(0)).cast("long").alias("n_erased"),
        "cents",
        F.col("n_erased").isNotNull().alias("rewritten"),
        F.lit(name).alias("table_name"),
        "ids_sha256",
        F.lit(",".join(table.schema.names)).alias("columns"),
        F.regexp_replace("path", "^file:/+", "/").alias("path"),
    )


def victim_masters(clients: DataFrame, clicks: DataFrame) -> DataFrame:
    """``master_id`` of every hundredth by hash, and the one whose clients have most clicks (of equals the smallest)."""
    owned = clients.where("master_id is not null").select("client_id", "master_id").distinct()
    counted = clicks.where("client_id is not null").groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))
    most = owned.join(counted, "client_id", "left").groupBy("master_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    most = most.orderBy(F.desc("n"), "master_id").limit(1).select("master_id")
    return owned.select("master_id").where(F.crc32(F.col("master_id").cast("string")) % 100 == 0).unionByName(most).distinct()


def erase_clients(clients: DataFrame, clicks: DataFrame, sales: DataFrame, sale_lines: DataFrame) -> DataFrame:
    """Lays the four tables out in a new folder and erases the victim masters from all of them.

    Victims are their clients, these clients' clicks and sales, and these sales' lines. Rows are
    sorted by the checksum of their client's id (a line's: its sale's; the smallest where a sale
    has several), none as the empty string. Nulls are never victims. Gives ``report`` of each
    file that is left; empty tables give no rows. The folder stays in the shared folder.
    """
    spark = clients.sparkSession
    folder = f"{shared_dir(spark)}/erasure-{uuid.uuid4().hex}"

    def checksum(column: str) -> Column:
        return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))

    owner = sales.where("sale_id is not null").groupBy(F.col("sale_id").alias("__sale")).agg(F.min("client_id").alias("__client"))
    # written first: Spark splits a hot sale's lines only where both sides of a join are exchanged as they are
    owner = stage(owner, "erasure-owners")
    lines = sale_lines.join(owner, F.col("sale_id") == F.col("__sale"), "left")
    laid = {
        "clients": layout(clients, f"{folder}/clients", checksum("client_id")),
        "clicks": layout(clicks, f"{folder}/clicks", checksum("client_id")),
        "sales": layout(sales, f"{folder}/sales", checksum("client_id")),
        "sale_lines": layout(lines, f"{folder}/sale_lines", checksum("__client"), sale_lines.columns),
    }
    discard(owner)
    masters = stage(victim_masters(clients, clicks), "erasure-masters", clean=False)
    people = clients.join(masters, "master_id", "left_semi").where("client_id is not null").select("client_id").distinct()
    people = stage(people, "erasure-clients", clean=False)
    sold = stage(sales.join(people, "client_id", "left_semi").where("sale_id is not null").select("sale_id").distinct(), "erasure-sales", clean=False)
    erased = {
        "clients": erase(laid["clients"], masters, "master_id"),
        "clicks": erase(laid["clicks"], people, "client_id"),
        "sales": erase(laid["sales"], people, "client_id"),
        "sale_lines": erase(laid["sale_lines"], sold, "sale_id"),
    }
    discard(masters, people, sold)
    amounts = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}
    parts = [report(laid[t], t, amounts[t], erased[t]) for t in laid]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
