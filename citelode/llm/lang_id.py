"""Language identification with hyperdimensional n-gram profiles.

Every letter has a random vector of +1 and -1. An n-gram is the product of its letters'
vectors, each rotated by its place in the n-gram (binding after permutation); a text is the sum
of its n-grams (bundling). A language's prototype is the sum of the unit vectors of its
training texts; a text gets the language whose prototype has the largest cosine.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from citelode.llm.common import trim, with_columns

DIM = 1024
NGRAM = 3
#: At most about so many labelled rows of each language are learned from.
MAX_PER_LANG = 4000
#: Languages learned at most, those of the most rows; other labels are taken for dirt.
MAX_LANGS = 1000
UND = "und"
#: Least cosines of known text, in standard deviations of chance ones (``dim ** -0.5``): for
#: texts up to so many characters, which share few n-grams with a prototype, and for longer ones.
SHORT, LEAST_SHORT, LEAST_LONG = 200, 4, 6
#: Texts of fewer different letters have too few n-grams to be told from chance and pass.
FEW = 5
#: Letter vectors kept; they are drawn again when more are met.
LETTERS = 4096
_SPACE = 0
_WINDOW = 1 << 20

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def letter_vector(code: int, dim: int) -> np.ndarray:
    """The +1/-1 vector of a code point, drawn from a hash of it; the same everywhere."""
    raw = hashlib.shake_128(f"letter {code}".encode()).digest(dim // 8)
    return np.unpackbits(np.frombuffer(raw, np.uint8)).astype(np.int8) * np.int8(2) - np.int8(1)


class Encoder:
    """Turns texts into bundled vectors; keeps the vectors of letters and n-grams it has met."""

    def __init__(self, dim: int = DIM, n: int = NGRAM, keep: int = 30_000):
        self.dim, self.n, self.keep = dim, n, keep
        self.letters: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.grams = np.empty((1024, dim), np.int8)

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) >= LETTERS:
                self.letters.clear()
            self.letters[code] = letter_vector(code, self.dim)
        return self.letters[code]

    def _bind(self, gram: int) -> np.ndarray:
        out = np.ones(self.dim, np.int8)
        for place in range(self.n):
            out *= np.roll(self._letter(gram & 0x1FFFFF), place)
            gram >>= 21
        return out

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """Row numbers of n-gram codes in the table of bound vectors."""
        if len(self.row) + len(grams) > self.keep:
            self.row.clear()
        out = np.empty(len(grams), np.int64)
        for i, g in enumerate(grams.tolist()):
            k = self.row.get(g)
            if k is None:
                k = self.row[g] = len(self.row)
                if k >= len(self.grams):
                    self.grams = np.concatenate([self.grams, np.empty_like(self.grams)])
                self.grams[k] = self._bind(g)
            out[i] = k
        return out

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Codes and counts of the n-grams of a whole text; None without a letter.

        Lower-cased; every run of other characters counts as one space, and one stands at
        either end. Long texts are counted window by window.
        """
        table, total, rest, seen = _letter_table(), {}, np.array([_SPACE], np.int64), False
        for at in range(0, len(text), _WINDOW):
            low = text[at : at + _WINDOW].lower()
            codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            is_letter = table[codes]
            seen = seen or bool(is_letter.any())
            codes = np.where(is_letter, codes, _SPACE)
            codes = np.concatenate([rest, codes, [_SPACE]] if at + _WINDOW >= len(text) else [rest, codes])
            codes = codes[np.concatenate(([True], (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)))]
            if len(codes) >= self.n:
                keys = np.zeros(len(codes) - self.n + 1, np.int64)
                for place in range(self.n):
                    keys |= codes[place : len(codes) - self.n + 1 + place] << (21 * place)
                values, n = np.unique(keys, return_counts=True)
                if not total and at + _WINDOW >= len(text):
                    return (values, n) if seen else None
                for v, c in zip(values.tolist(), n.tolist(), strict=True):
                    total[v] = total.get(v, 0) + c
            rest = codes[-(self.n - 1) :]
        if not seen:
            return None
        return np.fromiter(total, np.int64, len(total)), np.fromiter(total.values(), np.int64, len(total))

    def units(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Each text's bundle, scaled to length one; None where there is no letter."""
        found = [None if t is None else self.counts(t) for t in texts]
        own = [f[0] for f in found if f is not None]
        grams = np.unique(np.concatenate(own)) if own else np.empty(0, np.int64)
        bundles = np.zeros((len(texts), self.dim), np.float32)
        for at in range(0, len(grams), 8192):  # so many bound vectors are gathered at once
            some = grams[at : at + 8192]
            rows = self.rows(some)  # may move the table
            table = self.grams[rows].astype(np.float32)
            counts = np.zeros((len(texts), len(some)), np.float32)
            for i, f in enumerate(found):
                if f is not None:
                    where = np.searchsorted(some, f[0])
                    inside = (where < len(some)) & (some[np.minimum(where, len(some) - 1)] == f[0])
                    counts[i, where[inside]] = f[1][inside]
            bundles += counts @ table
        norms = np.linalg.norm(bundles, axis=1)
        return [bundles[i] / norms[i] if found[i] is not None and norms[i] > 0 else None for i in range(len(texts))]

    def batches(self, texts: Iterable[str | None], rows: int = 64, chars: int = 2_000_000) -> Iterator[np.ndarray | None]:
        """``units`` over any number of texts, a few at a time."""
        some: list[str | None] = []
        size = 0
        for t in texts:
            some.append(t)
            size += len(t or "")
            if len(some) >= rows or size >= chars:
                yield from self.units(some)
                some, size = [], 0
        yield from self.units(some)


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", dim: int = DIM, max_per_lang: int = MAX_PER_LANG) -> dict[str, np.ndarray]:
    """Unit prototypes by language, from the labelled rows of ``df``.

    Rows whose text or language is null, or whose text has no letter, teach nothing. Of each
    language, rows are taken by a hash of ``key`` so that about ``max_per_lang`` remain; this
    documented bound, and ``MAX_LANGS``, make the gathered partial sums (32 tasks by languages by
    ``dim``) small enough for the driver. An empty table gives no prototypes.
    """
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counted = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS)
    sizes = {r.lang: r.n for r in counted.collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, max_per_lang / n) * 2.0**20)])
    picked = rows.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < share[F.col("lang")])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sums = Encoder(dim), {}
        for batch in batches:
            for name, v in zip(batch.column("lang").to_pylist(), enc.batches(t.as_py() for t in batch.column("text")), strict=True):
                if v is not None:
                    sums[name] = sums.get(name, 0) + v.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["lang", "v"])

    parts = picked.select("lang", "text").repartition(32).mapInArrow(learn, "lang string, v binary")
    sums: dict[str, np.ndarray] = {}
    for r in parts.collect():
        sums[r.lang] = sums.get(r.lang, 0) + np.frombuffer(bytes(r.v))
    return {name: (s / np.linalg.norm(s)).astype(np.float32) for name, s in sorted(sums.items()) if np.linalg.norm(s) > 0}


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (cosine, 0 to 1) to the columns of ``df``.

    ``und`` and 0 where the text is null or has no letter, or where no language was learned.
    Equal cosines go to the language first in the alphabet. All other columns pass through
    untouched; columns of ``df`` with the two new names are replaced.
    """
    df = df.drop(*({"lang_pred", "score"} - {text}))
    names = list(prototypes)
    matrix = np.stack([prototypes[n] for n in names], axis=1) if names else None
    dim = len(matrix) if names else DIM

    def one(v: np.ndarray | None) -> tuple[str, float]:
        if v is None or matrix is None:
            return UND, 0.0
        cos = v @ matrix
        best = int(np.argmax(cos))
        return names[best], float(min(1.0, max(0.0, cos[best])))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(dim)
        for batch in batches:
            out = [one(v) for v in enc.batches(t.as_py() for t in batch.column(text))]
            yield with_columns(batch, lang_pred=pa.array([x for x, _ in out], pa.string()), score=pa.array([x for _, x in out], pa.float64()))
        trim()

    return df.mapInArrow(score, StructType([*df.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def held_out(key: str = "doc_id") -> F.Column:
    """Whether a row is kept from training: crc32 of the key as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(df: DataFrame, **kw) -> DataFrame:
    """Per document: ``doc_id, held_out, lang_pred, score``.

    A null ``doc_id`` is not held out and teaches; repeated rows are predicted one by one.
    """
    docs = df.select("doc_id", "text", "lang")
    out = predict(docs.select("doc_id", "text"), train(docs.where(~held_out()), **kw))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(df: DataFrame, min_score: float | None = None) -> DataFrame:
    """The rows of ``df``, columns unchanged, whose text has a language.

    Learned from the labelled rows of ``df`` itself. Rejected: null texts, texts without a
    letter, and texts whose best cosine is below ``min_score`` (unlike anything learned); without
    one, below ``LEAST_SHORT`` or ``LEAST_LONG`` deviations of chance, by length, if they have
    ``FEW`` different letters or more. Where no row is labelled, only the first two go.
    """
    model = train(df)
    if not model:
        return df.where(F.col("text").rlike("\\p{L}"))
    own = {c: f"__own_{c}" for c in df.columns if c in ("lang_pred", "score")}
    chance = len(next(iter(model.values()))) ** -0.5
    if min_score is None:
        letters = F.array_distinct(F.split(F.regexp_replace(F.lower("text"), "\\P{L}", ""), ""))
        least = F.when(F.length("text") <= SHORT, LEAST_SHORT * chance).otherwise(LEAST_LONG * chance)
        known = (F.col("score") >= least) | (F.size(F.filter(letters, lambda x: x != "")) < FEW)
    else:
        known = F.col("score") >= min_score
    out = predict(df.withColumnsRenamed(own), model).where((F.col("lang_pred") != UND) & (known))
    return out.drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in own.items()})
