"""Removal of repeated word passages, by prefix-partitioned suffix trees.

A document's suffixes start at its words. Two suffixes meet in a node of depth ``window`` of
the corpus's suffix tree when their first ``window`` words agree; every leaf below such a node
but the first in corpus order starts a repeat, and the union of the repeats' windows are the
maximal repeated passages. The tree is never held as a whole:

* Which suffixes. Every window is represented by the smallest fingerprint of the short prefixes
  (``SHORT`` words) that start in it, so only suffixes with such a prefix (about one word in seven at
  20-word windows) are looked at; equal windows have equal representatives, so no repeat is lost.
  Prefixes with a single suffix are leaves above any deep node and go.
* Groups. The others are dealt out by their short prefix. A group that holds more than ``FIT``
  suffixes is dealt again by longer prefixes (``DEPTHS`` lengths up to ``window``), and so on until
  it fits; under a prefix of ``window`` words each task sends a single leaf, so that one always does.
* Subtrees. A group's suffixes are sorted by their prefixes of all lengths, which lays out its
  subtree's leaves; the longest length in which neighbours agree is the depth of the node they
  meet in. Below the deep nodes, those of ``window`` words, the first leaf is the one that stays.

Prefixes are compared by 64-bit fingerprints. Every task first merges what it holds under one
prefix, so a passage that millions of documents share reaches its group as one entry from each
task. Equal texts are one document, at the smallest ``doc_id``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from citelode.llm.common import discard, hash_words, mix64, stage, trim, words_of

WINDOW = 20
SHORT = 8
#: Characters of text for each group that suffixes are dealt into.
GROUP_CHARS = 8_000_000
#: Suffixes that a task holds before it deals them out.
HOLD = 2_000_000
#: Suffixes of a group that one task takes at once, and lengths of prefixes that groups are dealt by.
FIT = 1_500_000
DEPTHS = 4
#: Ways over which copies of one text are dealt where they meet their first.
SALTS = 8
_LAST = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def prefix_fingerprints(words: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of the ``length``-word prefixes of all suffixes that are so long."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(words) * _powers(_BASE, len(words)), dtype=np.uint64)))
    return mix64((sums[length:] - sums[:-length]) * _powers(_INVERSE, n) + np.uint64(length))


def representatives(short: np.ndarray, span: int) -> np.ndarray:
    """For each window, the smallest fingerprint among the ``span`` short prefixes in it."""
    out, done = short, 1
    while done < span:
        step = min(done, span - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def _unsigned(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.uint64)


def _joined(parts: list, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in parts]) if len(parts) else np.empty(0, kind)


def _cuts(part: np.ndarray) -> list[tuple[int, int]]:
    at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else np.zeros(1, int)
    return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def depths(window: int) -> list[int]:
    """Lengths of the prefixes that suffixes are dealt and sorted by, from short to the window's."""
    short = min(SHORT, window)
    return sorted({short + (window - short) * k // (DEPTHS - 1) for k in range(DEPTHS)})


def met_at(columns: list[np.ndarray]) -> np.ndarray:
    """For sorted suffixes, the number of prefix lengths in which each agrees with the one before.

    That is the level of the internal node where two neighbouring leaves of the subtree meet.
    """
    level = np.zeros(len(columns[0]), np.int64)
    still = np.ones(len(level), bool)
    still[:1] = False
    for c in columns:
        still[1:] &= c[1:] == c[:-1]
        level += still
    return level


def repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", fit: int = FIT) -> DataFrame:
    """Starts of windows that also start earlier: ``(rk, starts)``, one row per distinct text.

    ``rk`` is ``row_key`` of the text, ``starts`` a list of binaries of unsigned 32-bit word
    numbers. Earlier means a smaller key (null last), or the same text and a smaller start.
    """
    lengths = depths(window)
    short_len = lengths[0]
    span = window - short_len + 1
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), row_key(text).alias("rk")).where("text is not null")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(64, chars // GROUP_CHARS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Short prefixes by part, one entry for each that a task holds; where it holds several suffixes they are marked here."""
        held: dict[int, np.ndarray] = {}
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            h = np.concatenate(list(held.values()))
            rk = np.repeat(np.array(list(held), np.int64), [len(x) for x in held.values()])
            held.clear()
            order = np.lexsort((rk, h))
            h, rk = h[order], rk[order]
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            several = np.diff(np.append(starts, len(h))) > 1
            marked = np.repeat(several, np.diff(np.append(starts, len(h))))
            done_h, done_rk = h[marked], rk[marked]
            order = np.argsort(done_rk, kind="stable")
            done_h, done_rk = done_h[order], done_rk[order]
            out = [(-1, done_h[x:y].tobytes(), b"", done_rk[x : x + 1].tobytes(), b"") for x, y in _cuts(done_rk)]
            h, rk = h[starts], rk[starts]
            part = (h % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            h, rk, part, several = h[order], rk[order], part[order], several[order]
            for x, y in _cuts(part):
                own, local = np.unique(rk[x:y], return_inverse=True)
                out.append((int(part[x]), h[x:y].tobytes(), local.astype(np.uint32).tobytes(), own.tobytes(), np.packbits(several[x:y]).tobytes()))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["part", "h", "doc", "names", "several"])

        for batch in batches:
            for t, rk in zip(batch.column("text"), batch.column("rk").to_pylist(), strict=True):
                if rk in held:
                    continue
                short = prefix_fingerprints(hash_words(words_of(t.as_py())), short_len)
                if len(short) < span:
                    continue
                picked = np.unique(representatives(short, span))
                values, times = np.unique(short, return_counts=True)
                twice = picked[times[np.searchsorted(values, picked)] > 1]
                held[rk] = np.concatenate((picked, twice))  # a prefix the text has twice branches by itself
                count += len(held[rk])
                if count >= HOLD:
                    yield from flush()
                    count = 0
        yield from flush()
        trim()

    def branching(group: pd.DataFrame) -> pd.DataFrame:
        """The texts' short prefixes that more than one suffix has."""
        if group["part"].iloc[0] < 0:
            return pd.DataFrame({"rk": [int.from_bytes(n, "little", signed=True) for n in group["names"]], "h": group["h"].to_numpy()})
        h = _joined(list(group["h"]), np.uint64)
        rk = np.concatenate([np.frombuffer(n, np.int64)[np.frombuffer(d, np.uint32)] for n, d in zip(group["names"], group["doc"], strict=True)])
        several = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=len(x) // 8) for f, x in zip(group["several"], group["h"], strict=True)]).astype(bool)
        order = np.lexsort((rk, h))
        h, rk, several = h[order], rk[order], several[order]
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        sizes = np.diff(np.append(starts, len(h)))
        branch = np.logical_or.reduceat(several, starts) | (rk[starts] != rk[starts + sizes - 1])
        keep = np.repeat(branch, sizes) & ~several
        h, rk = h[keep], rk[keep]
        order = np.argsort(rk, kind="stable")
        h, rk = h[order], rk[order]
        cuts = _cuts(rk)
        return pd.DataFrame({"rk": [int(rk[x]) for x, _ in cuts], "h": [np.unique(h[x:y]).tobytes() for x, y in cuts]})

    # Marks that a task already made have part -1 and are dealt over salts.
    dealt = rows.mapInArrow(deal, "part int, h binary, doc binary, names binary, several binary").withColumn("salt", F.when(F.col("part") < 0, F.pmod(F.xxhash64("names"), F.lit(parts))).otherwise(0))
    marks = dealt.groupBy("part", "salt").applyInPandas(lambda g: branching(g), "rk long, h binary").groupBy("rk").agg(F.collect_list("h").alias("marks"))
    first = rows.groupBy("rk").agg(F.min("id").alias("id"))
    marked = stage(marks.join(first, "rk"), "passage-prefixes")

    below = rows.join(marked.withColumnRenamed("rk", "mark_rk"), (F.col("rk") == F.col("mark_rk")) & rows["id"].eqNullSafe(marked["id"])).select(rows["id"], "text", "rk", "marks")

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Marked suffixes with their prefixes of all lengths, by part of the short one; one leaf for each window."""
        held: dict[int, tuple[int, np.ndarray, list[np.ndarray]]] = {}
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            sizes = [len(x[1]) for x in held.values()]
            ids, rks = np.array([x[0] for x in held.values()], np.int64), np.array(list(held), np.int64)
            rank = np.empty(len(held), np.int64)
            rank[np.lexsort((rks, ids))] = np.arange(len(held))
            doc = np.repeat(np.arange(len(held)), sizes)
            at = np.concatenate([x[1] for x in held.values()])
            prefixes = [np.concatenate([x[2][k] for x in held.values()]) for k in range(len(lengths))]
            held.clear()
            order = np.lexsort((at, rank[doc], prefixes[-1]))
            at, doc, prefixes = at[order], doc[order], [c[order] for c in prefixes]
            lead = np.concatenate(([True], prefixes[-1][1:] != prefixes[-1][:-1]))
            late = np.argsort(doc[~lead], kind="stable")
            late_at, late_doc = at[~lead][late], doc[~lead][late]
            out = [(-1, 0, y - x, late_at[x:y].tobytes(), b"", int(rks[late_doc[x]]), b"", b"") for x, y in _cuts(late_doc)]
            at, doc, prefixes = at[lead], doc[lead], [c[lead] for c in prefixes]
            part = (prefixes[0] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            at, doc, part, prefixes = at[order], doc[order], part[order], [c[order] for c in prefixes]
            for x, y in _cuts(part):
                own, local = np.unique(doc[x:y], return_inverse=True)
                names = np.stack([ids[own], rks[own]], axis=1)
                out.append((int(part[x]), 0, y - x, at[x:y].tobytes(), _packed([c[x:y] for c in prefixes]), None, local.astype(np.uint32).tobytes(), names.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _PIECE, strict=True)], names=_NAMES)

        for batch in batches:
            for t, rk, i, m in zip(batch.column("text"), batch.column("rk").to_pylist(), batch.column("id").to_pylist(), batch.column("marks"), strict=True):
                if rk in held:
                    continue
                words = hash_words(words_of(t.as_py()))
                short = prefix_fingerprints(words, short_len)
                named = np.concatenate([_unsigned(x) for x in m.values])
                at = np.flatnonzero(np.isin(representatives(short, span), named)).astype(np.uint32)
                held[rk] = (_LAST if i is None else i, at, [prefix_fingerprints(words, n)[at] for n in lengths])
                count += len(at)
                if count >= HOLD:
                    yield from flush()
                    count = 0
        yield from flush()
        trim()

    def leaves(group: pd.DataFrame) -> pd.DataFrame:
        """Leaves below the deep nodes of a group's subtree, without the first of each."""
        prefixes = [np.concatenate(c) for c in zip(*(_unpacked(x, len(lengths)) for x in group["prefixes"]), strict=True)]
        at = _joined(list(group["at"]), np.uint32)
        names = [np.frombuffer(n, np.int64).reshape(-1, 2)[np.frombuffer(d, np.uint32)] for n, d in zip(group["names"], group["doc"], strict=True)]
        ids, rk = np.concatenate(names).T
        order = np.lexsort((at, rk, ids, *reversed(prefixes)))
        later = met_at([c[order] for c in prefixes]) == len(lengths)
        at, rk = at[order][later], rk[order][later]
        order = np.argsort(rk, kind="stable")
        at, rk = at[order], rk[order]
        cuts = _cuts(rk)
        return pd.DataFrame({"rk": [int(rk[x]) for x, _ in cuts], "starts": [at[x:y].tobytes() for x, y in cuts]})

    pieces = stage(below.mapInArrow(descend, _SCHEMA), "passage-leaves")
    for level in range(1, len(lengths)):
        sizes = pieces.where("part >= 0").groupBy("part", "sub").agg(F.sum("n").alias("total")).where(F.col("total") > fit)
        if sizes.isEmpty():
            break
        last, pieces = pieces, stage(_dealt_again(pieces, sizes, level, len(lengths), fit), "passage-leaves")
        discard(last)
    done = pieces.where("part < 0").select("rk", F.col("at").alias("starts"))
    found = pieces.where("part >= 0").groupBy("part", "sub").applyInPandas(lambda g: leaves(g), "rk long, starts binary")
    return done.unionByName(found).groupBy("rk").agg(F.collect_list("starts").alias("starts"))


_NAMES = ["part", "sub", "n", "at", "prefixes", "rk", "doc", "names"]
_PIECE = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
_SCHEMA = "part int, sub long, n long, at binary, prefixes binary, rk long, doc binary, names binary"


def _packed(prefixes: list[np.ndarray]) -> bytes:
    """Fingerprints of the shorter prefixes, which only deal and sort, in 32 bits, and of the longest in 64."""
    return prefixes[-1].tobytes() + b"".join((c & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() for c in prefixes[:-1])


def _unpacked(raw: bytes, levels: int) -> list[np.ndarray]:
    n = len(raw) // (8 + 4 * (levels - 1))
    return [*(np.frombuffer(raw, np.uint32, n, 8 * n + 4 * n * k) for k in range(levels - 1)), np.frombuffer(raw, np.uint64, n)]


def _dealt_again(pieces: DataFrame, sizes: DataFrame, level: int, levels: int, fit: int) -> DataFrame:
    """The pieces, those of groups in ``sizes`` dealt anew by the prefixes of the next length."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                total = row.pop("total")
                if total is None:
                    out.append(tuple(row[c] for c in _NAMES))
                    continue
                prefixes = _unpacked(row["prefixes"], levels)
                bucket = (prefixes[level] % prefixes[level].dtype.type(-(-total // fit))).astype(np.int64)
                at, doc = np.frombuffer(row["at"], np.uint32), np.frombuffer(row["doc"], np.uint32)
                for b in np.unique(bucket).tolist():
                    mine = bucket == b
                    sub = int(mix64(np.array([(row["sub"] & 0xFFFFFFFFFFFFFFFF) ^ (b + 1)], np.uint64))[0].view(np.int64))
                    out.append((row["part"], sub, int(mine.sum()), at[mine].tobytes(), _packed([c[mine] for c in prefixes]), None, doc[mine].tobytes(), row["names"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _PIECE, strict=True)] if out else [pa.nulls(0, k) for k in _PIECE], names=_NAMES)

    return pieces.join(sizes, ["part", "sub"], "left").select(*_NAMES, "total").mapInArrow(split, _SCHEMA)


def row_key(text: str = "text") -> Column:
    """The 64-bit key under which equal texts are one."""
    return F.xxhash64(F.lit("passage"), F.col(text))


def cut_words(text: str, starts: np.ndarray | None, window: int) -> tuple[str, int, int]:
    """The text without the words in windows at ``starts``; its words, and how many went.

    ``starts`` None removes all words. What stands between kept words stays; where words went,
    the white space before the next kept word stands for the gap.
    """
    raw = text.encode("utf-8", "surrogatepass")
    if starts is not None and not len(starts):
        return text, len(raw.split()), 0
    spans = np.array([m.span() for m in _WORD.finditer(raw)], np.int64).reshape(-1, 2)
    n = len(spans)
    if starts is None:
        return ("", n, n) if n >= window else (text, n, 0)
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + window, -1)
    gone = np.cumsum(depth)[:n] > 0
    kept = np.flatnonzero(~gone)
    runs = _cuts(kept - np.arange(len(kept)))
    ends = np.concatenate(([0], spans[:, 1]))
    out = b"".join(raw[ends[kept[x]] : ends[kept[y - 1] + 1]] for x, y in runs)
    out = out.lstrip() if n and gone[0] else out
    out += raw[ends[n] :] if n and not gone[-1] else b""
    return out.decode("utf-8", "surrogatepass"), n, int(gone.sum())


def drop_repeats(df: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``df`` with ``text`` cut, and ``n_words`` and ``n_removed`` added.

    Words are maximal runs of other than space and U+0009-U+000D, compared as they are. Each
    word in a window of ``window`` words that also starts earlier goes; windows are judged on
    the input. A null text stays null, with no words. Rows with equal key and text are one
    document and keep the same; a null key comes last. Columns of ``df`` with the two new names
    are replaced; its names must not begin with two underscores.
    """
    df = df.drop(*({"n_words", "n_removed"} - {key, text}))
    found = repeats(df, window, key, text)
    number = F.col(key).cast("long")
    first = df.where(F.col(text).isNotNull()).groupBy(row_key(text).alias("__rk")).agg(F.min(number).alias("id"), F.max(number).alias("last"), F.count(F.lit(1)).alias("n"), F.count(key).alias("keys"))
    copied = (F.col("last") > F.col("id")) | ((F.col("keys") < F.col("n")) & (F.col("keys") > 0))
    plan = first.withColumn("copied", copied).join(found.withColumnRenamed("rk", "__rk"), "__rk", "left").where("copied or starts is not null")
    # copies of a text are dealt over salts; only the salt of the first gets what is cut there
    salt = lambda x: F.pmod(F.xxhash64(x), F.lit(SALTS)).cast("int")
    plan = plan.withColumn("__salt", F.explode(F.when(F.col("copied"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(salt(F.col("id"))))))
    starts = F.when(F.col("__salt") == salt(F.col("id")), F.col("starts"))
    plan = plan.select("__rk", "__salt", F.when(F.col("copied"), F.col("id")).alias("__first"), starts.alias("__starts"))
    rows = df.withColumn("__rk", F.when(F.col(text).isNotNull(), row_key(text)).otherwise(F.monotonically_increasing_id())).withColumn("__salt", salt(number))
    rows = rows.join(plan, ["__rk", "__salt"], "left")
    later = F.col("__first").isNotNull() & ~number.eqNullSafe(F.col("__first"))
    rows = rows.withColumn("__later", later).drop("__rk", "__first", "__salt")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, later_, starts in zip(batch.column(text), batch.column("__later").to_pylist(), batch.column("__starts"), strict=True):
                at = np.empty(0, np.int64)
                if starts.is_valid and not later_:
                    at = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in starts.values]).astype(np.int64)
                out.append((None, 0, 0) if not t.is_valid else cut_words(t.as_py(), None if later_ else at, window))
            new = {text: pa.array([o[0] for o in out], pa.string()), "n_words": pa.array([o[1] for o in out], pa.int64()), "n_removed": pa.array([o[2] for o in out], pa.int64())}
            names = [c for c in batch.schema.names if not c.startswith("__")] + ["n_words", "n_removed"]
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names=names)

    fields = [StructField(f.name, StringType()) if f.name == text else f for f in df.schema.fields]
    return rows.mapInArrow(cut, StructType([*fields, StructField("n_words", LongType()), StructField("n_removed", LongType())]))
