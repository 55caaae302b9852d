"""Best-fit packing of tokenised documents into fixed-length sequences.

Hierarchical residual packing: every task packs its own pieces by best fit, longest first, and
lets go of the bins that are nearly full. What is left, the underfull bins, are the items of the
next round, in which as many groups as they need each pack what several tasks left; round after
round the tree narrows until one group holds what no other could use, or until a round leaves
about as much as it got. A round's item is a whole bin, so a piece keeps its place in it.

A group never leaves two bins that are at most half full, since the second one's items would
have gone into the first; and bins more than half full don't go into each other. So rounds after
the first save at most one bin for each group of the round before, and ending the tree where
bins don't combine costs no more than that.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelode.llm.common import stage

LENGTH = 1024
END_ID = 2
#: Bins with at most this many free places are done.
SLACK = 8
#: Items that one group packs, on average; what share of the groups the next round may need.
GROUP = 50_000
NARROWER = 0.75
CACHE = 800_000
#: Characters of the pre-tokens whose ids are kept.
CACHE_CHARS = 32_000_000
#: Texts of these characters alone are cut into pre-tokens by ``_SIMPLE``; the tokenizer cuts others itself.
_PLAIN = re.compile(r"[\t\n\r -~¡-©«-±´¶-¸»¿-ÿĀ-ɏ–—‘-“”„…€]*")
_SIMPLE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class TokenCounter:
    """Token ids by a ``tokenizers`` file, as bytes of little-endian unsigned 32-bit integers.

    Byte-level BPE never merges across pre-tokens, so the ids of each distinct pre-token are kept
    (``CACHE`` of them at most, then all are forgotten) and put together. Where the ids of the
    file's merges rise with their ranks, pre-tokens are merged by rank with ``tiktoken``, which
    then gives the same ids sooner. Texts with characters outside ``_PLAIN`` or with an added
    token's string in them go to the tokenizer whole, as do all if it isn't plain byte-level BPE.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept: dict[str, bytes] = {}
        self.size = 0
        self.words = self._by_rank(json.loads(self.tokenizer.to_str()))

    def _by_rank(self, said: dict):
        """An encoder of single pre-tokens; None if the file isn't one of the simple kind."""
        import tiktoken

        pre, model = said.get("pre_tokenizer") or {}, said["model"]
        if said.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("type") != "BPE" or model.get("ignore_merges"):
            return None
        # the usual stand-ins of bytes: printable ones are themselves, others count on from 256
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.added}
        merged = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", ""), -1) for m in model["merges"]]
        if len(vocab) != 256 + len(merged) or any(x >= y for x, y in zip([max(vocab.get(c, -1) for c in byte), *merged], merged, strict=False)) or not all(c in byte for t in vocab for c in t):
            return None
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
        return tiktoken.Encoding("by-rank", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def ids(self, texts: list[str]) -> list[bytes]:
        simple = [self.words is not None and bool(_PLAIN.fullmatch(t)) and not any(a in t for a in self.added) for t in texts]
        cut = [_SIMPLE.findall(t) if s else None for t, s in zip(texts, simple, strict=True)]
        if len(self.kept) > CACHE or self.size > CACHE_CHARS:
            self.kept.clear()
            self.size = 0
        kept = self.kept
        for w in {w for c in cut if c is not None for w in c} - kept.keys():
            self.size += len(w)
            kept[w] = struct.pack(f"<{len(found)}I", *found) if (found := self.words.encode_ordinary(w)) else b""
        get = kept.__getitem__
        whole = iter(self._whole([t for t, s in zip(texts, simple, strict=True) if not s]))
        return [next(whole) if c is None else b"".join(map(get, c)) for c in cut]


@lru_cache(maxsize=2)
def counter_of(path: str) -> TokenCounter:
    """One counter for all tasks of a worker process."""
    return TokenCounter(path)


def pieces_of(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens: only the first may be short."""
    first = n % length or min(n, length)
    return [(0, first), *((s, length) for s in range(first, n, length))]


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: bin and offset of every item, and the bins' fills.

    An item goes to the bin with the least room that takes it; of equal ones, the latest.
    """
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fills: list[int] = []
    rooms: list[int] = []  # the distinct rooms that some bin has, sorted
    having: dict[int, list[int]] = {}
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = having[room].pop()
            if not having[room]:
                del having[room], rooms[at]
        else:
            b, room = len(fills), length
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        if left := room - size:
            if left not in having:
                having[left] = []
                insort(rooms, left)
            having[left].append(b)
    return bins, offsets, np.array(fills, np.int64)


def token_pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per piece: ``key, piece, start, length, ids_crc32``, and ``item``, a number of its own."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counter, end, at = counter_of(path), np.array([END_ID], "<u4").tobytes(), TaskContext.get().partitionId() << 33
        for batch in batches:
            doc, rows = [], []
            for lo in range(0, len(batch), 256):
                part = batch.column("text").slice(lo, 256)
                for i, raw in enumerate(counter.ids([t.as_py() or "" for t in part]), lo):
                    raw += end
                    for p, (start, n) in enumerate(pieces_of(len(raw) // 4, length)):
                        doc.append(i)
                        rows.append((p, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)])))
            cols = np.array(rows, np.int64).reshape(-1, 4).T
            item = at + np.arange(len(doc))
            at += len(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(doc, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in (*cols[1:], item))],
                names=["id", "piece", "start", "length", "ids_crc32", "item"],
            )

    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(read, f"id {kind}, piece int, start long, length long, ids_crc32 long, item long").withColumnRenamed("id", key)


def _round(items: DataFrame, length: int, number: int) -> DataFrame:
    """Packs each group of ``(g, item, size)``: ``item, bin, offset, fill``."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item", kind="stable")
        bins, offsets, fills = best_fit(rows["size"].to_numpy(), length)
        base = (number << 56) + (int(rows["g"].iloc[0]) << 33)
        return pd.DataFrame({"item": rows["item"].to_numpy(), "bin": bins + base, "offset": offsets, "fill": fills[bins]})

    return items.groupBy("g").applyInPandas(lambda rows: pack(rows), "item long, bin long, offset long, fill long")


def pack(pieces: DataFrame, length: int = LENGTH, slack: int = SLACK, group: int = GROUP) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; every column of ``pieces`` stays.

    Needs ``item`` (distinct longs) and ``length`` (1 to ``length``). Groups of every round hold
    ``group`` items on average, dealt by a hash: their number follows from the items that are
    left, so no group grows with the input. The tree ends with one group, or where the next
    round would need more than ``NARROWER`` of the groups, since then bins don't combine. Pieces
    already of full length are bins by themselves. An empty table gives none.
    """
    open_ = pieces.where(F.col("length") < length).select("item", F.col("length").alias("size"))
    groups = max(1, -(-open_.count() // group))
    moves: list[DataFrame] = []
    number = 1
    while True:
        dealt = open_.withColumn("g", F.pmod(F.xxhash64("item", F.lit(number)), F.lit(groups)).cast("int"))
        packed = stage(_round(dealt, length, number), "packing")
        moves.append(packed)
        if groups == 1:
            break
        open_ = packed.where(F.col("fill") < length - slack).groupBy(F.col("bin").alias("item")).agg(F.max("fill").alias("size"))
        after = max(1, -(-open_.count() // group))
        if after > NARROWER * groups:
            break
        groups, number = after, number + 1
    # From the last round to the first, where each item ended.
    place: DataFrame | None = None
    for packed in reversed(moves):
        here = packed.select("item", "bin", "offset")
        if place is not None:
            up = place.select(F.col("item").alias("bin"), F.col("sequence_id"), F.col("offset").alias("more"))
            here = here.join(up, "bin", "left").select("item", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"))
        else:
            here = here.withColumnRenamed("bin", "sequence_id")
        place = here
    return pieces.join(place, "item", "left").withColumn("sequence_id", F.coalesce("sequence_id", "item")).withColumn("offset", F.coalesce("offset", F.lit(0).cast("long")))


def pack_documents(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per piece: ``key, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is the token ids of its whole text (null: empty) and the id 2. Documents of more
    than ``length`` tokens are cut into pieces of ``length``, of which the first may be shorter;
    no others are. Pieces stand in a sequence without gaps from offset 0. Repeated rows and rows
    with a null key are packed like any other.
    """
    pieces = stage(token_pieces(df, path, key, text, length), "pieces")
    return pack(pieces, length).select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
