"""Nearest neighbours by vantage-point trees, one for each shard of the vectors.

A node's vantage point splits its vectors at the median distance. By the triangle inequality no
vector beyond the split can be nearer than the query's distance to it, so a side is left out
where that gap exceeds the distance of the k-th best found, divided by ``relax``. With ``relax``
1 the search is exact; larger values leave out more.

* Shards are the leaves of a small vantage-point tree over a bounded sample (``SAMPLE`` vectors,
  ``SHARDS`` leaves at most), by which every vector is placed; a shard with many vectors is dealt
  over parts by a hash of the key. The sample only says where vectors are kept, never which.
* A query is first taken through its own shard, which bounds the distance of its k-th
  neighbour. Then it visits those other shards alone that the ball of this radius meets.
* A part's tree is built once, from rows that a task reads before the part's queries, and the
  queries stream past it; parts that very many queries visit are held by several tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citelode.llm.common import discard, stage

LEAF = 512
#: Vectors of a shard's part, and queries that one task takes through a part's tree, on average.
SHARD = 8192
QUERIES = 100_000
#: Vectors that the shards are laid out by, and shards, at most.
SAMPLE, SHARDS = 16_384, 1024
#: The smaller side of a split has this share of the rows at least, so depth is logarithmic.
BALANCE = 0.125
_NOBODY = np.iinfo(np.int64).max
_SLACK = 1e-9  # rounding must not leave out a tie


def distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, components summed in their order."""
    out = np.zeros((len(queries), len(points)))
    with np.errstate(over="ignore"):
        for d in range(queries.shape[1]):
            gap = queries[:, d, None] - points[None, :, d]
            out += gap * gap
    return np.sqrt(out)


class VantageTree:
    """A tree over the rows of ``points``; ``ids`` break ties of distance.

    ``nodes`` holds a vantage row, the split, and the numbers of the inner and outer node; a
    leaf's rows stand in ``leaves`` under its number.
    """

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.points, self.ids = points[order], ids[order]
        self.nodes: list[tuple[int, float, int, int] | None] = [None]
        self.leaves: dict[int, np.ndarray] = {}
        todo = [(0, np.arange(len(ids)))]
        while todo:
            at, rows = todo.pop()
            cut = self._split(rows) if len(rows) > leaf else None
            if cut is None:
                self.leaves[at] = rows
                continue
            vantage, split, inner = cut
            self.nodes[at] = (vantage, split, len(self.nodes), len(self.nodes) + 1)
            todo += [(len(self.nodes), rows[inner]), (len(self.nodes) + 1, rows[~inner])]
            self.nodes += [None, None]

    def _split(self, rows: np.ndarray) -> tuple[int, float, np.ndarray] | None:
        """A vantage point and its split; None where most rows lie at one distance, as copies do."""
        vantage = rows[len(rows) // 2]  # rows are in order of id, which says nothing of place
        d = distances(self.points[vantage][None], self.points[rows])[0]
        split = float(np.median(d))
        inner = d <= split
        if not math.isfinite(split) or min(inner.sum(), (~inner).sum()) < BALANCE * len(rows):
            return None
        return int(vantage), split, inner

    def leaf_of(self, queries: np.ndarray) -> np.ndarray:
        """The number of the leaf that each query falls in."""
        out = np.zeros(len(queries), np.int64)
        todo = [(0, np.arange(len(queries)))]
        while todo:
            at, active = todo.pop()
            if at in self.leaves:
                out[active] = at
            elif len(active):
                vantage, split, inner, outer = self.nodes[at]
                near = distances(queries[active], self.points[vantage][None])[:, 0] <= split
                todo += [(inner, active[near]), (outer, active[~near])]
        return out

    def leaves_within(self, queries: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and a leaf that the ball of its radius meets."""
        who, where = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        todo = [(0, np.arange(len(queries)))]
        while todo:
            at, active = todo.pop()
            if at in self.leaves:
                who.append(active)
                where.append(np.full(len(active), at, np.int64))
            elif len(active):
                vantage, split, inner, outer = self.nodes[at]
                d = distances(queries[active], self.points[vantage][None])[:, 0]
                reach = radius[active] + _SLACK * (d + split)
                todo += [(inner, active[d - split <= reach]), (outer, active[split - d <= reach])]
        return np.concatenate(who), np.concatenate(where)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, relax: float = 1.0, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of each query, nearest first, ties to the smaller id: (ids, distances).

        ``own`` are the queries' ids, which they never find; missing ones have the largest id and
        distance inf. Beyond ``bound``, where given, nothing needs to be found.
        """
        best = np.full((len(queries), k), np.inf)
        who = np.full((len(queries), k), _NOBODY)
        limit = np.full(len(queries), np.inf) if bound is None else bound
        todo: list[tuple[int, np.ndarray, np.ndarray]] = [(0, np.arange(len(queries)), np.zeros(len(queries)))]
        while todo:
            at, active, gap = todo.pop()
            active = active[gap <= np.minimum(best[active, k - 1], limit[active]) / relax]
            if not len(active):
                continue
            if at in self.leaves:
                rows = self.leaves[at]
                for lo in range(0, len(rows), 1024):
                    some = rows[lo : lo + 1024]
                    d = distances(queries[active], self.points[some])
                    ids = np.broadcast_to(self.ids[some], d.shape)
                    mine = ids == own[active, None]
                    d, ids = np.where(mine, np.inf, d), np.where(mine, _NOBODY, ids)
                    d, ids = np.concatenate((best[active], d), axis=1), np.concatenate((who[active], ids), axis=1)
                    order = np.lexsort((ids, d))[:, :k]
                    best[active], who[active] = np.take_along_axis(d, order, 1), np.take_along_axis(ids, order, 1)
                continue
            vantage, split, inner, outer = self.nodes[at]
            d = distances(queries[active], self.points[vantage][None])[:, 0]
            gap = np.maximum(np.abs(d - split) - _SLACK * (d + split), 0)
            near, none = d <= split, np.zeros(len(active))
            # the side a query is on comes off the stack first, so the other meets a smaller bound
            todo += [(inner, active[~near], gap[~near]), (outer, active[near], gap[near])]
            todo += [(inner, active[near], none[near]), (outer, active[~near], none[~near])]
        return who, best


def _vectors(column: pa.Array) -> np.ndarray:
    """Equally long lists as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _layout(rows: DataFrame, number: int, shard: int) -> dict[int, VantageTree]:
    """A small tree for each of the commonest vector lengths; its leaves are the shards."""
    leaves = min(SHARDS, 1 << max(0, math.ceil(math.log2(max(1, number / shard)))))
    if leaves < 2:
        return {}
    every = max(1, number // (SAMPLE // 2))
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(every)) == 0).select("id", "v").limit(SAMPLE).toPandas()
    out = {}
    for dim, group in sample.groupby(sample["v"].map(len)):
        if len(group) * leaves >= 2 * len(sample):
            size = max(1, -(-len(group) // max(1, leaves * len(group) // len(sample))))
            out[int(dim)] = VantageTree(np.stack(group["v"].to_numpy()), group["id"].to_numpy(np.int64), size)
    return out


def _placed(rows: DataFrame, trees: dict[int, VantageTree]) -> DataFrame:
    """``rows`` with ``dim`` and the ``shard`` that each vector falls in."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = np.array([len(x) for x in batch.column("v")], np.int32)
            shard = np.zeros(len(dim), np.int64)
            for d, tree in trees.items():
                at = np.flatnonzero(dim == d)
                if len(at):
                    shard[at] = tree.leaf_of(_vectors(batch.column("v").take(pa.array(at))))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(dim), pa.array(shard)], names=["id", "v", "dim", "shard"])

    return rows.select("id", "v").mapInArrow(place, "id long, v array<double>, dim int, shard long")


def _visit(asked: DataFrame, placed: DataFrame, sizes: DataFrame, k: int, relax: float) -> DataFrame:
    """``query_id, vec_id, score`` of what ``asked`` (``id, v, dim, shard, bound``) finds in the shards it names."""
    asks = asked.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks"))
    plan = asks.join(sizes, ["dim", "shard"])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    left = placed.join(plan, ["dim", "shard"]).withColumn("part", deal("parts", "part")).withColumn("block", every("blocks")).select("dim", "shard", "part", "block", F.lit(0).alias("asks"), "id", "v", F.lit(0.0).alias("bound"))
    right = asked.join(plan, ["dim", "shard"]).withColumn("block", deal("blocks", "block")).withColumn("part", every("parts")).select("dim", "shard", "part", "block", F.lit(1).alias("asks"), "id", "v", "bound")
    keys = ["dim", "shard", "part", "block"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tree = None, [], None
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in (*keys, "asks")]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(batch)], strict=True):
                key = tuple(int(c[lo]) for c in cols[:4])
                if key != now:
                    now, held, tree = key, [], None
                ids, v = batch.column("id").to_numpy()[lo:hi], _vectors(batch.column("v").slice(lo, hi - lo))
                if not cols[4][lo]:
                    held.append((ids, v))
                    continue
                if not held:
                    continue
                if tree is None:
                    tree = VantageTree(np.concatenate([x for _, x in held]), np.concatenate([i for i, _ in held]))
                bound = batch.column("bound").to_numpy()[lo:hi]
                for at in range(0, len(ids), 1024):
                    some = slice(at, at + 1024)
                    who, best = tree.search(v[some], ids[some], k, relax, bound[some])
                    there = who != _NOBODY
                    asking = np.broadcast_to(ids[some, None], who.shape)[there]
                    yield pa.RecordBatch.from_arrays([pa.array(asking), pa.array(who[there]), pa.array(best[there])], names=["query_id", "vec_id", "score"])

    return left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "asks").mapInArrow(search, "query_id long, vec_id long, score double")


def nearest(df: DataFrame, k: int = 10, every: int = 100, relax: float = 1.0, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of every row whose key ``every`` divides.

    All rows but the query's own are candidates, those with the same key included in "own".
    Distances are Euclidean, in double precision on the vectors as stored; ties go to the smaller
    key; with fewer candidates all come. Rows with a null key and vectors that are null, empty,
    zero, or hold a null or non-finite component take no part. Vectors meet those of their own
    length only. Rows that repeat a key and vector count once. Other columns play no part.
    """
    x = F.col("v")
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    fine = rows.where("id is not null and v is not null and size(v) > 0")
    fine = fine.where(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf))) & F.exists(x, lambda c: c != 0))
    fine = stage(fine.distinct(), "vectors")
    trees = _layout(fine, fine.count(), shard)
    placed = stage(_placed(fine, trees), "vector-shards")
    discard(fine)
    sizes = placed.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard)).cast("int").alias("parts"))

    asked = placed.where(F.col("id") % every == 0).withColumn("bound", F.lit(math.inf))
    home = stage(_visit(asked, placed, sizes, k, relax), "vector-home")
    kth = home.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.get(F.sort_array(F.collect_list("score")), F.lit(k - 1))).alias("kth"))
    known = asked.drop("bound").join(kth, asked["id"] == kth["query_id"], "left").select("id", "v", "dim", "shard", F.coalesce("kth", F.lit(math.inf)).alias("bound"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, bound, at_home = (batch.column(c).to_numpy() for c in ("dim", "bound", "shard"))
            for d, tree in trees.items():
                at = np.flatnonzero(dim == d)
                if not len(at):
                    continue
                who, where = tree.leaves_within(_vectors(batch.column("v").take(pa.array(at))), bound[at] / relax)
                away = where != at_home[at[who]]
                who, where = at[who[away]], where[away]
                some = batch.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("v"), some.column("dim"), pa.array(where), some.column("bound")], names=["id", "v", "dim", "shard", "bound"])

    found = home
    if trees:
        beyond = known.mapInArrow(route, "id long, v array<double>, dim int, shard long, bound double")
        found = home.unionByName(_visit(beyond, placed, sizes, k, relax))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
