"""What the operators of this subpackage share: staging, word hashes and graph components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: the space and the controls tab to carriage return, which is
#: also what ``bytes.split()`` cuts at.
SPACES = "\\x20\\x09-\\x0D"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
LOWER_TABLE = bytes.maketrans(_UPPER, _LOWER)

_OWN_DIR: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a temporary folder stands in if the master is local; on a cluster that
    is an error, since executors would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="citelode-"))
    return f"file://{_OWN_DIR[0]}"


def stage(df: DataFrame, name: str, clean: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage: executors lost later make no one recompute what stands before. With
    ``clean`` the shuffle files of what was written go at once, else at the driver's next
    collection: each removal takes a thread of every executor, which small ones aren't worth.
    ``discard`` deletes what was written; the rest goes with the shared folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, str(clean).lower())
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def discard(*staged: DataFrame) -> None:
    """Deletes what ``stage`` wrote for these, once nothing lazy reads it any more."""
    for df in staged:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._staged)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Ways over which rows of one key are dealt where they meet others.
SALTS = 8


def meet(left: DataFrame, right: DataFrame, on: str, deal: Column, how: str = "inner") -> DataFrame:
    """An equi-join whose left rows of one key are dealt over salts by ``deal``; ``right`` has each key but few times."""
    spread = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("__salt", F.pmod(deal, F.lit(SALTS)).cast("int")).join(spread, [on, "__salt"], how).drop("__salt")


def trim() -> None:
    """Gives freed memory of this worker process back, so that the next stage finds it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own ways
        pass


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    if not words:
        return np.empty(0, np.uint64)
    codes, uniques = pd.factorize(np.array(words, dtype=object))
    return pd.util.hash_array(np.asarray(uniques, dtype=object), categorize=False)[codes]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the result (unsigned 64-bit, wraps)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words of a text as UTF-8; A-Z lower-cased on request; none for null."""
    if text is None:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.translate(LOWER_TABLE) if lower else raw).split()


def with_columns(batch: pa.RecordBatch, **new: pa.Array) -> pa.RecordBatch:
    """The batch with further columns at its end."""
    return pa.RecordBatch.from_arrays([*batch.columns, *new.values()], names=[*batch.schema.names, *new])


def union_find(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots of 0..n-1 under the links a-b, each the smallest member."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        if (lo == hi).all():
            return root
        np.minimum.at(root, hi, lo)
        while (root[root] != root).any():
            root = root[root]


#: Edges that one task resolves at once; more of them first shrink in distributed rounds.
LOCAL_EDGES = 2_000_000


def connected_components(edges: DataFrame, name: str, local: int = LOCAL_EDGES) -> DataFrame:
    """Components of an undirected graph: ``(node, root)``, root the smallest node reachable.

    ``edges`` has two long columns ``a`` and ``b``; edges from a node to itself don't count. Up
    to ``local`` edges, a fixed bound, go through union-find in one executor task. More are
    rewritten round by round: every node is pointed at the smallest neighbour (large star), then
    at the smallest of what it points at (small star), until no edge changes; both are
    aggregations with map-side combining, so a node with very many edges meets as one partial
    minimum from each task. Rounds grow with the logarithm of the longest chain. Edges never
    reach the driver, and the result is the same either way.
    """
    cur = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name, clean=False)
    if cur.count() <= local:

        def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [(x.column("u").to_numpy(), x.column("v").to_numpy()) for x in batches]
            if held:
                nodes, code = np.unique(np.concatenate([c for pair in zip(*held, strict=True) for c in pair]), return_inverse=True)
                half = len(code) // 2
                roots = union_find(len(nodes), code[:half], code[half:])
                for at in range(0, len(nodes), 100_000):
                    some = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[roots[some]])], names=["node", "root"])

        out = stage(cur.coalesce(1).mapInArrow(resolve, "node long, root long"), name, clean=False)
        discard(cur)
        return out
    previous = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        new = stage(large.join(low2, "u").select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u <> v").distinct(), name)
        sign = new.select(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if (sign.n, sign.x) == previous:
            roots = new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return new.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        discard(cur)
        previous, cur = (sign.n, sign.x), new
