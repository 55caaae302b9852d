"""Cutting a plan's lineage, numbering rows and finding components, for operators of several passes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``; a new temporary one on a local master without it."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(f"file://{tempfile.mkdtemp(prefix='citelode-')}")
    return _LOCAL[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: what comes later doesn't depend on what came before."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes what ``written`` wrote for these, once nothing reads it."""
    for df in frames:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that one window of ``numbered`` holds, about.
STRETCH = 50_000


def numbered(df: DataFrame, by: str, order: str, name: str) -> DataFrame:
    """Adds ``name``: a row's number from 0 within ``by``, in the order of the distinct longs ``order``.

    A group's range of ``order`` is cut into stretches, rows are numbered within their stretch,
    and only the counts of stretches are summed up along the group; so a group may be of any size.
    """
    sizes = df.groupBy(by).agg(F.min(order).alias("__low"), (F.max(order) - F.min(order)).alias("__span"), F.count(F.lit(1)).alias("__n"))
    width = F.expr(f"greatest(1, __span div greatest(1, __n div {STRETCH}))")
    at = df.alias("d").join(sizes.select(F.col(by).alias("__by"), "__low", width.alias("__width")), F.col(by).eqNullSafe(F.col("__by"))).drop("__by")
    at = at.withColumn("__stretch", F.expr(f"(`{order}` - __low) div __width")).drop("__low", "__width")
    within = F.row_number().over(Window.partitionBy(by, "__stretch").orderBy(order))
    at = at.withColumn("__in", within)
    counts = at.groupBy(by, "__stretch").agg(F.max("__in").alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(by).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col(by).alias("__by"), F.col("__stretch").alias("__s"), F.coalesce(before, F.lit(0)).alias("__before"))
    out = at.join(starts, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__stretch") == F.col("__s")))
    return out.withColumn(name, F.col("__before") + F.col("__in") - 1).drop("__by", "__s", "__stretch", "__in", "__before")


def components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph of longs ``a``, ``b``: ``node, root``, root the smallest node reachable.

    Each round points every node at its smallest neighbour and then at the smallest of what it
    points at, until nothing changes; both are minima with partial sums, so a node of any degree
    is fine. Rounds grow with the logarithm of the longest path. The last round stays in the
    shared folder, since the result is read from it.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, "components")
        sign = tuple(after.select(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())
        forget(now)
        now = after
        if sign == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = sign
