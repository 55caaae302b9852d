"""Exact Jaccard self-join on word n-grams by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes. Cutting that order into
fragments cuts every document's set in the same places, so a pair's overlap is the sum of the
overlaps of its fragments.

* Candidates. Two sets with Jaccard at least t differ in at most ``d = (1/t - 1) * smaller``
  elements. Of ``d + k`` fragments at least k are then the same in both. Fragments have one global
  order, those with most uncommon n-grams first, so both sets have one of their equal fragments
  among their first ``d + 1``, and those alone are dealt out: what boilerplate fills comes last
  and is left out. The number of fragments depends on a size class; a set near the upper
  neighbour's sizes uses the cut of the class below too, so every pair that can link has one cut
  in common. Sets that share a fragment are pairs; beyond ``SMALL`` sets, a hot fragment ties its
  sets to its first one only.
* Counting. The sets of all pairs are cut in ``PARTS`` fragments, of which ``ROUNDS`` rounds take a
  few each. Every fragment of a bucket of pairs is one task's, which counts the pairs' partial
  overlaps; they are summed per pair and held against the threshold in whole numbers. A set goes to
  every bucket that asks for it, the more of them the larger the input, so no round exchanges whole
  sets. Only links that hold are closed into components.
* Hot fragments. Sets tied by hot fragments that are not in one component by then are cut into
  blocks. For each pair of blocks, fragment after fragment of the order gives partial overlap
  counts, summed per pair; a task returns a spanning forest of its links, not its pairs.

Equal sets are one class, represented by its smallest document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelode.llm.common import connected_components, discard, hash_words, meet, mix64, stage, trim, union_find, words_of

#: Sets tied by hot fragments in one block; two blocks meet in one task.
BLOCK = 512
#: Sizes of a class lie within this factor of each other.
CLASS_FACTOR = 1.4
#: Fragments beyond the differences of a class, as their share and at least.
SPARE, SPARE_LEAST = 0.7, 8
#: Entries of a packed row at most, and about as many of one group of packed rows.
PACK = 500_000
#: Sets of one fragment that meet as pairs, over all and within one task; more are tied to the first.
SMALL, SMALL_HERE = 16, 8
#: Rows whose sets a task holds at once.
ROWS = 500
#: Vertical fragments that pairs are counted in, rounds that take them in turn, and pairs of one bucket on average.
PARTS, ROUNDS = 8, 4
PAIRS = 10_000
#: An n-gram is common when this share of the documents or more hold it; only so many of the most
#: common are told apart. Both change which fragments come first, never which pairs link.
COMMON, COMMON_LEAST, COMMON_MOST = 1 / 256, 8, 100_000
#: Ways over which the rows of one set are dealt when they meet their component.
SALTS = 16
_TRIES = 4
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_NONE = np.empty(0, np.uint64)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams.

    A text with fewer words has one: the whole sequence. None without a word.
    """
    words = words_of(text, lower=True)
    if not words:
        return _NONE
    h = hash_words(words)
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, np.uint64(width), np.uint64)
    for k in range(width):
        out = mix64(out * np.uint64(_ODD[0]) + h[k : k + len(out)])
    return np.unique(out)


def set_class(grams: np.ndarray) -> int | None:
    """A 64-bit hash of a whole set, as a signed long; None for the empty set."""
    if not len(grams):
        return None
    with np.errstate(over="ignore"):
        total = mix64(grams * np.uint64(_ODD[1])).sum(dtype=np.uint64) + mix64(np.full(1, len(grams), np.uint64))[0]
    return int(np.int64(total))


def _classes(largest: int) -> list[int]:
    """Lower bounds of the size classes up to ``largest``."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, int(out[-1] * CLASS_FACTOR)))
    return out


_BOUNDS = np.array(_classes(1 << 40), np.int64)


def _differences(size: int, percent: int) -> int:
    """Elements by which two sets can differ at most when they link and the smaller has ``size``."""
    return size * (100 - percent) // percent


def _held(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of ``values`` a sorted ``table`` holds."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def fragment_keys(grams: np.ndarray, percent: int, common: np.ndarray = _NONE) -> np.ndarray:
    """Hashes of a set's first fragments, under each cut that a partner may use.

    A pair of size s <= s' meets under the cut of s's class. Under a cut of ``d + k`` fragments for
    at most d differences k are equal, so the first of those, in the order of uncommon n-grams,
    n-grams and hash, is among the first ``d + 1`` of both. A set with fewer than that many
    non-empty fragments is cut again after another permutation of the n-grams, up to four times,
    and at last also emits empty ones; a partner without that need shares a non-empty one, another
    is cut again too, so no pair is lost.
    """
    size = len(grams)
    own = int(np.searchsorted(_BOUNDS, size, side="right")) - 1
    least = -(-size * percent // 100)  # no partner is smaller
    first = int(np.searchsorted(_BOUNDS, least, side="right")) - 1
    often = _held(grams, common)
    out = []
    with np.errstate(over="ignore"):
        for c in range(first, own + 1):
            d = _differences(int(_BOUNDS[c + 1]) - 1, percent)
            m = d + 1 + (max(SPARE_LEAST, int(SPARE * d)) if d else 0)
            order, rare = grams, ~often
            for attempt in range(_TRIES):
                if attempt:
                    order = mix64(order * np.uint64(_ODD[2]))
                    by = np.argsort(order)
                    order, rare = order[by], rare[by]
                place = (((order >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
                n = np.bincount(place, minlength=m)
                ends = np.cumsum(n)
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(order ^ np.uint64(_ODD[0])), dtype=np.uint64)))
                tag = np.uint64((c * _TRIES + attempt + 1) * _ODD[1] & 0xFFFFFFFFFFFFFFFF)
                keys = mix64(mix64(sums[ends] - sums[ends - n] + np.arange(m, dtype=np.uint64) * np.uint64(_ODD[2])) ^ tag)
                top = np.lexsort((keys, -n, -np.bincount(place[rare], minlength=m)))[: d + 1]
                full = n[top] > 0
                out.append(keys[top] if attempt == _TRIES - 1 else keys[top[full]])
                if full.all():
                    break
    return np.concatenate(out)


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal rows in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(new)))


def _pairs(members: np.ndarray, starts: np.ndarray, sizes: np.ndarray, star: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of the groups' members, smaller first, and whether they are of a star.

    Members ascend within a group. Groups that ``star`` marks only have pairs with their first.
    """
    found = []
    for size in np.unique(sizes[~star]).tolist():
        rows = members[starts[~star & (sizes == size)][:, None] + np.arange(size)]
        x, y = np.triu_indices(size, 1)
        found.append((rows[:, x].ravel(), rows[:, y].ravel(), False))
    lead = np.repeat(starts[star], sizes[star])
    at = np.arange(len(lead)) - np.repeat(np.cumsum(sizes[star]) - sizes[star], sizes[star])
    found.append((members[lead[at > 0]], members[lead[at > 0] + at[at > 0]], True))
    hot = np.concatenate([np.full(len(a), h) for a, _, h in found])
    a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    order = np.lexsort((~hot, b, a))
    first, _ = _groups(a[order], b[order])
    kept = order[first]
    return a[kept], b[kept], hot[kept]


def links_of_blocks(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, fragments: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked sets, right ones counted on after the left ones.

    The n-grams that occur twice in the two blocks are cut in ``fragments`` along the order;
    each fragment's partial overlaps are one matrix product, added to the sums.
    """
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, code, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = n > 1
    owner, code = owner[often[code]], (np.cumsum(often) - 1)[code[often[code]]]
    total, cut = int(often.sum()), len(left)
    rows, cols = (cut, len(sets) - cut) if right else (cut, cut)
    overlap = np.zeros((rows, cols), np.float32)
    for at in range(0, total, width := min(8192, max(256, -(-total // fragments)))):
        inside = (code >= at) & (code < at + width)
        x = np.zeros((len(sets), min(width, total - at)), np.float32)
        x[owner[inside], code[inside] - at] = 1
        overlap += x[:cut] @ (x[cut:] if right else x).T
    s = sizes[:cut, None] + (sizes[None, cut:] if right else sizes[None, :])
    both = np.rint(overlap).astype(np.int64)
    a, b = np.nonzero(100 * both >= percent * (s - both))
    return (a, b + cut) if right else (a[a < b], b[a < b])


def _read(docs: DataFrame, n: int) -> DataFrame:
    """``id, n, cls`` of every row; rows of ``gram`` true hold an n-gram in ``cls`` and in how many of a task's sets it is."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def often() -> Iterator[pa.RecordBatch]:
            grams, times = np.unique(np.concatenate(held), return_counts=True)
            many = times >= max(4, int(len(held) * COMMON))
            k = int(many.sum())
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(times[many].astype(np.int64)), pa.array(grams[many].view(np.int64)), pa.array(np.ones(k, bool))], names=["id", "n", "cls", "gram"])
            held.clear()

        for batch in batches:
            sizes, classes = [], []
            for t in batch.column("text"):
                grams = shingles(t.as_py(), n)
                sizes.append(len(grams))
                classes.append(set_class(grams))
                if len(grams):
                    held.append(grams)
                    count += len(grams)
                if count >= PACK:
                    yield from often()
                    count = 0
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(np.zeros(len(sizes), bool))], names=["id", "n", "cls", "gram"])
        if held:
            yield from often()
        trim()

    return docs.mapInArrow(read, "id long, n long, cls long, gram boolean")


def _common(read: DataFrame, documents: int) -> np.ndarray:
    """The most common n-grams, sorted: ``COMMON_MOST`` at most."""
    counted = read.where("gram").groupBy("cls").agg(F.sum("n").alias("n")).where(F.col("n") >= max(COMMON_LEAST, documents * COMMON))
    rows = counted.orderBy(F.desc("n"), "cls").limit(COMMON_MOST).select("cls").toPandas()
    return np.sort(rows["cls"].to_numpy(np.int64).view(np.uint64))


def _candidates(texts: DataFrame, entries: int, n: int, percent: int, common: np.ndarray) -> DataFrame:
    """Pairs ``(a, b, hot)`` of classes that have a fragment in common, ``a`` the smaller."""
    parts = max(64, entries // PACK + 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Deals out a task's fragments by part; what many of its own sets share is tied here."""
        held: dict[int, np.ndarray] = {}
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            names = np.array(list(held), np.int64)
            keys = np.concatenate(list(held.values()))
            owner = names[np.repeat(np.arange(len(names)), [len(k) for k in held.values()])]
            held.clear()
            part, key = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64) % parts, (keys >> np.uint64(32)).astype(np.uint32)
            order = np.lexsort((owner, key, part))
            part, key, owner = part[order], key[order], owner[order]
            starts, sizes = _groups(part, key)
            many = sizes > SMALL_HERE
            a, b, _ = _pairs(owner, starts[many], sizes[many], np.ones(int(many.sum()), bool))
            goes = np.repeat(~many, sizes)
            goes[starts] = True
            flag = np.repeat(many, sizes)[goes]
            part, key, owner = part[goes], key[goes], owner[goes]
            rows = [(-1, a.tobytes(), b"", b"", b.tobytes())]
            for at, k in zip(*(x.tolist() for x in _groups(part)), strict=True):
                own, code = np.unique(owner[at : at + k], return_inverse=True)
                rows.append((int(part[at]), own.tobytes(), key[at : at + k].tobytes(), np.packbits(flag[at : at + k]).tobytes(), code.astype(np.uint32).tobytes()))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "names", "key", "flag", "code"])

        for batch in batches:
            for t in batch.column("text"):
                grams = shingles(t.as_py(), n)
                cls = set_class(grams)
                if cls is not None and cls not in held:
                    held[cls] = fragment_keys(grams, percent, common)
                    count += len(held[cls])
                if count >= PACK:
                    yield from flush()
                    count = 0
        yield from flush()
        trim()

    def tie(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["part"].iloc[0] == -1:
            a, b = (np.concatenate([np.frombuffer(x, np.int64) for x in rows[c]]) for c in ("names", "code"))
            return pd.DataFrame({"a": a, "b": b, "hot": np.ones(len(a), bool)}).drop_duplicates()
        key = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["key"]])
        owner = np.concatenate([np.frombuffer(x, np.int64)[np.frombuffer(c, np.uint32)] for x, c in zip(rows["names"], rows["code"], strict=True)])
        flag = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=len(k) // 4) for f, k in zip(rows["flag"], rows["key"], strict=True)]).astype(bool)
        order = np.lexsort((owner, key))
        key, owner, flag = key[order], owner[order], flag[order]
        starts, _ = _groups(key, owner)
        flag = np.logical_or.reduceat(flag, starts)
        key, owner = key[starts], owner[starts]
        starts, sizes = _groups(key)
        star = (sizes > SMALL) | np.logical_or.reduceat(flag, starts)
        met = sizes > 1
        a, b, hot = _pairs(owner, starts[met], sizes[met], star[met])
        return pd.DataFrame({"a": a, "b": b, "hot": hot})

    # The rows of part -1 are finished pairs: dealt over salts, they never meet in one task.
    packed = texts.mapInArrow(pack, "part int, names binary, key binary, flag binary, code binary").withColumn("salt", F.when(F.col("part") < 0, F.pmod(F.xxhash64("names"), F.lit(256))).otherwise(0))
    tied = packed.groupBy("part", "salt").applyInPandas(lambda rows: tie(rows), "a long, b long, hot boolean")
    return tied.groupBy("a", "b").agg(F.max("hot").alias("hot"))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def _sets(docs: DataFrame, first: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """``cls, grams`` of every class in ``pairs``, read from its first document's text."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(first, "cls")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            found = [shingles(t.as_py(), n) for t in batch.column("text")]
            right = pa.array([set_class(s) == c for s, c in zip(found, batch.column("cls").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array([s.tobytes() for s in found], pa.binary())], names=["cls", "grams"]).filter(right)

    # The wanted ones grow with the documents, so they are never broadcast, however few here.
    return docs.join(wanted.hint("merge"), "id").select("cls", "text").mapInArrow(again, "cls long, grams binary")


def _pieces(sets: DataFrame, where: DataFrame, parts: range) -> DataFrame:
    """``bucket, part, cls, n, grams``: those fragments of every set, for each of its buckets in ``where``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.arange(1, PARTS, dtype=np.uint64) << np.uint64(64 - PARTS.bit_length() + 1)
        for batch in _sliced(batches):
            out = []
            for cls, raw in zip(batch.column("cls").to_pylist(), batch.column("grams"), strict=True):
                grams = np.frombuffer(raw.as_buffer(), np.uint64)
                pieces = np.split(grams, np.searchsorted(grams, bounds))
                out += [(f, cls, len(grams), pieces[f].tobytes()) for f in parts]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.nulls(0, k) for k in kinds], names=["part", "cls", "n", "grams"])

    met = sets.select("cls", "grams").mapInArrow(cut, "part int, cls long, n long, grams binary").join(where.hint("merge"), "cls")
    return met.select(F.explode("buckets").alias("bucket"), "part", "cls", "n", "grams")


def _counted(pairs: DataFrame, sets: DataFrame, percent: int, number: int) -> DataFrame:
    """The pairs ``(a, b)`` that link, by partial overlaps of each fragment, summed per pair; staged."""
    buckets = max(1, -(-number // PAIRS))
    hot = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS).alias("salts")).where("salts > 1")
    salt = F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1)))
    dealt = stage(pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("a", salt), F.lit(buckets)).cast("int").alias("bucket")), "ngram-dealt", clean=False)
    where = dealt.select(F.explode(F.array("a", "b")).alias("cls"), "bucket").groupBy("cls").agg(F.collect_set("bucket").alias("buckets"))

    def partial(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held = held.drop_duplicates("cls").sort_values("cls")
        cls, size = held["cls"].to_numpy(), held["n"].to_numpy()
        pieces = [np.frombuffer(x, np.uint64) for x in held["grams"]]
        lengths = np.array([len(x) for x in pieces], np.int64)
        a, b = asked["a"].to_numpy(), asked["b"].to_numpy()
        known = _held(a, cls) & _held(b, cls)
        a, b = a[known], b[known]
        x, y = np.searchsorted(cls, a), np.searchsorted(cls, b)
        n = np.zeros(len(a), np.int64)
        if lengths.sum():
            flat, starts = np.concatenate(pieces), np.cumsum(lengths) - lengths
            table = np.sort(mix64(flat ^ mix64(np.repeat(np.arange(len(cls), dtype=np.uint64), lengths) + np.uint64(_ODD[0]))))
            each = np.cumsum(lengths[y])
            for lo, hi in _slices(each, 4_000_000):
                own = np.repeat(np.arange(lo, hi), lengths[y[lo:hi]])
                at = starts[y[own]] + np.arange(len(own)) - np.repeat((each - lengths[y])[lo:hi] - (each[lo - 1] if lo else 0), lengths[y[lo:hi]])
                n += np.bincount(own[_held(mix64(flat[at] ^ mix64(x[own].astype(np.uint64) + np.uint64(_ODD[0]))), table)], minlength=len(a))
        return pd.DataFrame({"a": a, "b": b, "sizes": size[x] + size[y], "n": n})[n > 0]

    counts = []
    for at in range(0, PARTS, PARTS // ROUNDS):
        parts = range(at, at + PARTS // ROUNDS)
        asked = dealt.withColumn("part", F.explode(F.array(*[F.lit(f) for f in parts])))
        met = asked.groupBy("bucket", "part").cogroup(_pieces(sets, where, parts).groupBy("bucket", "part"))
        counts.append(stage(met.applyInPandas(lambda q, h: partial(q, h), "a long, b long, sizes long, n long"), "ngram-counts"))
    summed = reduce(DataFrame.unionByName, counts).groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("sizes").alias("sizes"))
    links = stage(summed.where(100 * F.col("n") >= percent * (F.col("sizes") - F.col("n"))).select("a", "b"), "ngram-links")
    discard(dealt, *counts)
    return links


def _slices(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lengths, summed up to ``ends``, come to about ``most`` each."""
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most)))
        yield lo, hi
        lo = hi


def _blocks(members: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links ``(a, b)`` among the members ``(root, cls)`` of each root: a forest for each pair of blocks."""
    many = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    placed = (
        sets.join(meet(members, many, "root", F.xxhash64("cls")).hint("merge"), "cls")
        .withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("root", "cls", "grams", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("cls").sort_values("own", kind="stable")
        cls = rows["cls"].to_numpy()
        sets_ = [np.frombuffer(x, np.uint64) for x in rows["grams"]]
        i, j = rows["i"].iloc[0], rows["j"].iloc[0]
        cut = int((rows["own"] == i).sum())
        if len(cls) < 2 or (i != j and cut in (0, len(cls))):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        a, b = links_of_blocks(sets_[:cut], sets_[cut:] if i != j else None, percent)
        root = union_find(len(cls), a, b)
        tied = np.flatnonzero(root != np.arange(len(cls)))
        return pd.DataFrame({"a": cls[root[tied]], "b": cls[tied]})

    return placed.groupBy("root", "i", "j").applyInPandas(lambda rows: verify(rows), "a long, b long")


def ngram_jaccard_join(df: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Per row: ``key``, ``n_shingles`` (size of its set) and ``component_id``.

    Words are maximal runs of other than space and U+0009-U+000D, A-Z lower-cased; a set holds
    the distinct ``n``-word shingles of the whole text, or the whole sequence where there are
    fewer words. Rows link when ``100 * intersection >= percent * union``; ``component_id`` is
    the smallest key reachable. Null and empty texts have an empty set and link with nothing;
    rows with a null key link with nothing and get a null component, unless their set equals
    another's. Rows that share a key are one node. Sets, fragments and shingles are told apart
    by 64-bit hashes. Extra columns are ignored, whatever their names.
    """
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    read = stage(_read(docs, n), "ngram-sets")
    sets = read.where("not gram").drop("gram")
    known = sets.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("n") * ((100 - percent) / percent) * CLASS_FACTOR * 1.5 + 4).alias("entries")).first()
    common = _common(read, known.rows)

    pairs = stage(_candidates(docs.select("text"), int(known.entries or 0), n, percent, common), "ngram-pairs")
    first = sets.where("cls is not null and id is not null").groupBy("cls").agg(F.min("id").alias("id"))
    grams = stage(_sets(docs, first, pairs, n), "ngram-grams")
    links = _counted(pairs, grams, percent, pairs.count())
    linked = connected_components(links, "ngram-linked")

    tied = connected_components(pairs.where("hot").select("a", "b"), "ngram-hot")
    members = tied.join(linked.select(F.col("node"), F.col("root").alias("same")), "node", "left").select("root", F.col("node").alias("cls"), F.coalesce("same", "node").alias("same"))
    open_ = members.groupBy("root").agg(F.min("same").alias("low"), F.max("same").alias("high")).where("low < high").select("root")
    members = stage(meet(members, open_, "root", F.xxhash64("cls"), "left_semi").select("root", "cls"), "ngram-members")
    if not members.isEmpty():
        more = stage(_blocks(members, grams, percent, block), "ngram-more")
        linked = connected_components(links.unionByName(more), "ngram-linked")
        discard(more)
    discard(pairs, grams, links, members)

    # Only classes that repeat or link need a look-up; equal sets are dealt over salts.
    repeated = sets.where("cls is not null").groupBy("cls").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"))
    smallest = linked.join(first, linked.node == first.cls).groupBy("root").agg(F.min("id").alias("component"))
    component = repeated.join(meet(linked, smallest, "root", F.xxhash64("node")).withColumnRenamed("node", "cls"), "cls", "left").where("rows > 1 or component is not null")
    component = component.select("cls", F.coalesce("component", "id").alias("component"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    placed = sets.where("cls is not null").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(component, ["cls", "salt"], "left")
    out = placed.select("id", "n", "component").unionByName(sets.where("cls is null").select("id", "n", F.lit(None).cast("long").alias("component")))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_one(df: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, one of each component: that with the smallest key.

    Rows without words stay, as do rows with a null key whose set no other row has. Of rows
    that share the smallest key all stay.
    """
    found = ngram_jaccard_join(df, n, percent, key, text).where(f"{key} <> component_id").select(F.col(key).alias("__gone")).distinct()
    return df.join(found, df[key] == F.col("__gone"), "left_anti")
