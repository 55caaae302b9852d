"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The model file is read here; nothing of the library is used. Words, cut where no piece crosses,
are merged together: one flat array of symbols for all words, in each round the smallest rank
among each word's neighbouring pairs, the leftmost such pair of every word merged at once, and
the array compacted, until no word has a pair left. Where a piece has no continuation that
ranks before it, all its occurrences in a word merge in the same round.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

SPACE = "▁"
#: Words whose ids a worker keeps; beyond it all are forgotten.
CACHE = 600_000
#: Characters of the words whose ids are kept.
CACHE_CHARS = 32_000_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_NONE = np.iinfo(np.int64).max


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, raw[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield tag >> 3, struct.unpack("<d" if n == 8 else "<f", raw[at : at + n])[0]
            at += n


class PieceModel:
    """A BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces: list[str] = []
        scores, kinds = [], []
        trainer: dict[int, object] = {}
        normalizer: dict[int, object] = {}
        for number, value in _fields(raw):
            if number == 1:
                piece = {1: b"", 2: 0.0, 3: NORMAL} | dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(piece[2])
                kinds.append(piece[3])
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.kinds = kinds
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or USER in kinds or UNUSED in kinds:
            raise ValueError("only BPE models with byte fallback, identity normalisation and kept white space are read")
        self.prefix = bool(normalizer.get(3, 1))
        self.bos, self.eos = self.pieces.index("<s>"), self.pieces.index("</s>")
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == BYTE}
        own = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == NORMAL}
        order = sorted(own.values(), key=lambda i: -scores[i])
        rank, place = {}, -1
        for n, i in enumerate(order):  # equal scores have one rank: the leftmost pair goes first
            place = n if not n or scores[i] != scores[order[n - 1]] else place
            rank[i] = place
        # symbols: pieces by their id, then characters that pieces hold but that are none
        self.symbol = dict(own)
        for p in own:
            for c in p:
                self.symbol.setdefault(c, len(self.pieces) + len(self.symbol) - len(own))
        self.n = len(self.pieces) + len(self.symbol) - len(own) + 1
        pairs = {}
        best_next = np.full(self.n, _NONE, np.int64)
        for p, i in own.items():
            for cut in range(1, len(p)):
                left, right = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if left is not None and right is not None:
                    pairs[left * self.n + right] = (rank[i], i)
                    for s in (left, right):
                        best_next[s] = min(best_next[s], rank[i])
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        own_rank = np.full(self.n, _NONE, np.int64)
        own_rank[list(rank)] = list(rank.values())
        self.safe = best_next > own_rank
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in own)
        self.word = re.compile(".+" if crossing else f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.S)
        self.kept: dict[str, bytes] = {}
        self.size = 0
        self.surface = np.empty(len(self.pieces), object)
        for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)):
            self.surface[i] = b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode()

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of neighbouring symbols; the largest number where they don't merge."""
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], _NONE), self.merged[at]

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges the symbols of words (numbered, rising) to the end: symbols and their words."""
        done_s, done_w = [], []
        origin = np.arange(len(symbols))
        done_o = []
        while len(symbols) > 1:
            rank, made = self._look(symbols[:-1], symbols[1:])
            rank[word[:-1] != word[1:]] = _NONE
            rank, made = np.append(rank, _NONE), np.append(made, 0)
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lengths = np.diff(np.append(starts, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            live = least != _NONE
            if not live.all():  # words without a pair leave
                done_s.append(symbols[~live])
                done_w.append(word[~live])
                done_o.append(origin[~live])
                if not live.any():
                    symbols, word, origin = symbols[:0], word[:0], origin[:0]
                    break
                symbols, word, origin, rank, made, least = symbols[live], word[live], origin[live], rank[live], made[live], least[live]
            hit = np.flatnonzero(rank == least)
            first = np.concatenate(([True], word[hit[1:]] != word[hit[:-1]]))
            # of a run of overlapping hits every second one, from the left
            run = np.concatenate(([True], hit[1:] != hit[:-1] + 1))
            run_start = hit[np.flatnonzero(run)][np.cumsum(run) - 1]
            same = made[hit] == made[hit[np.flatnonzero(first)][np.cumsum(first) - 1]]
            all_safe = np.minimum.reduceat((self.safe[made[hit]] & same).astype(np.int8), np.flatnonzero(first))[np.cumsum(first) - 1] > 0
            hit = hit[first | (all_safe & ((hit - run_start) % 2 == 0))]
            symbols[hit] = made[hit]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            symbols, word, origin = symbols[stay], word[stay], origin[stay]
        done_s.append(symbols)
        done_w.append(word)
        done_o.append(origin)
        order = np.argsort(np.concatenate(done_o), kind="stable")
        return np.concatenate(done_s)[order], np.concatenate(done_w)[order]

    def _encode_words(self, words: list[str]) -> None:
        """Puts the ids of new words among the kept ones."""
        text = "".join(words)
        known = self.symbol
        chars = sorted(set(text))
        table = np.array([known.get(c, self.n - 1) for c in chars], np.int64)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = table[np.searchsorted(np.array([ord(c) for c in chars], np.uint32), codes)]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        # a character that no piece holds never merges, so those left stand in the text's order
        hidden = codes[symbols == self.n - 1].tolist()
        out, word = self.merge(symbols, np.repeat(np.arange(len(words)), lengths))
        raw = (out >= len(self.pieces)).nonzero()[0]
        if len(raw):
            others = {v: k for k, v in known.items() if v >= len(self.pieces)}
            hide = iter(hidden)
            parts, owner = [], []
            last = 0
            for at in raw.tolist():
                parts.append(out[last:at])
                owner.append(word[last:at])
                c = others[int(out[at])] if int(out[at]) in others else chr(next(hide))
                spelled = [self.byte[b] for b in c.encode("utf-8", "surrogatepass")]
                parts.append(np.array(spelled, np.int64))
                owner.append(np.full(len(spelled), word[at]))
                last = at + 1
            out, word = np.concatenate([*parts, out[last:]]), np.concatenate([*owner, word[last:]])
        count = np.bincount(word, minlength=len(words))
        ids = out.astype("<u4").tobytes()
        at = 0
        for w, n in zip(words, (count * 4).tolist(), strict=True):
            self.kept[w] = ids[at : at + n]
            at += n

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, begin and end ids included, as little-endian unsigned 32-bit integers."""
        cut = [self.word.findall(((SPACE if self.prefix else "") + t).replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.kept) > CACHE or self.size > CACHE_CHARS:
            self.kept.clear()
            self.size = 0
        new = list({w for c in cut for w in c} - self.kept.keys())
        size, some = 0, []
        for w in new:
            some.append(w)
            size += len(w)
            self.size += len(w)
            if size > 1_000_000:
                self._encode_words(some)
                size, some = 0, []
        if some:
            self._encode_words(some)
        get = self.kept.__getitem__
        begin, end = struct.pack("<I", self.bos), struct.pack("<I", self.eos)
        return [b"".join((begin, *map(get, c), end)) for c in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control ids are silent, bytes are read as UTF-8, the first space was added."""
        out = b"".join(self.surface[ids].tolist())
        text = out.decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def model_of(path: str) -> PieceModel:
    """One model for all tasks of a worker process."""
    return PieceModel(path)


def encode_column(df: DataFrame, path: str, text: str = "text", rows: int = 256) -> DataFrame:
    """``df`` without ``text``, with ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded``.

    Begin and end ids are included. Null and empty texts have those two alone and decode to the
    empty text. Whole texts are encoded; columns of ``df`` with the new names are replaced.
    """
    gone = {text, "ids", "decoded"}

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for whole in batches:
            for at in range(0, len(whole), rows):
                batch = whole.slice(at, rows)
                ids = model.encode([t.as_py() or "" for t in batch.column(text)])
                back = [model.decode(np.frombuffer(x, "<u4")) for x in ids]
                kept = [c for c in batch.schema.names if c not in gone]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(ids, pa.binary()), pa.array(back, pa.string())], names=[*kept, "ids", "decoded"])

    fields = [f for f in df.schema.fields if f.name not in gone]
    return df.mapInArrow(convert, StructType([*fields, StructField("ids", BinaryType()), StructField("decoded", StringType())]))

