"""The registered queries of the operators over the smallest tables."""

from pathlib import Path

import pytest

from citelode.llm import queries
from tests.llm.test_operators import brute_components, brute_passages
from tests.test_registry import SF, duck, same_rows  # noqa: F401

pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="the test tables aren't here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    same_rows(queries.queries()[name](spark, str(SF)), duck, queries.oracle_sql()[name])


def texts(spark):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())


def test_op4(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op4_ngram_jaccard(spark, str(SF)).collect()}
    assert got == brute_components(texts(spark), 3, 90)


def test_op9(spark):
    import hashlib

    want = {k: (n, gone, hashlib.sha256(kept).hexdigest()) for k, (n, gone, kept) in brute_passages(texts(spark), 20).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op9_substring_dedup(spark, str(SF)).collect()} == want


def test_op2(spark):
    """The pages of the test tables hold one article each, its blocks marked plainly."""
    import html
    import re

    want = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        found = re.search("(?s)<article>(.*)</article>", r.html or "")
        blocks = re.split("(?i)</?(?:p|h1|hr)[^>]*>", found[1]) if found else []
        plain = [" ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in blocks]
        want[r.page_id] = "\n\n".join(b for b in plain if b)
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op2_html_extraction(spark, str(SF)).collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}


def test_op3(spark):
    import zlib

    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.op3_language_id(spark, str(SF)).collect()
    assert len(out) == len(rows)
    tested = []
    for r in out:
        d = rows[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in d.text or ""))
        if r.held_out and r.lang_pred != "und" and d.lang:
            tested.append(r.lang_pred == d.lang)
    assert len(tested) > 30 and sum(tested) >= 0.95 * len(tested)


def test_op5(spark):
    import hashlib

    import numpy as np
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    want = {}
    for k, t in texts(spark):
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want[k] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op5_sentence_pieces(spark, str(SF)).collect()} == want


def test_op7(spark):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    want = set()
    for k, t in texts(spark):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)] if len(ids) > 1024 else [0, len(ids)]
        want |= {(k, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))}  # noqa: B905
    out = queries.op7_best_fit_packing(spark, str(SF)).toPandas()
    assert {(int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples()} == want and len(out) == len(want)
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s["length"].sum() <= 1024 and (s["offset"] == s["length"].cumsum() - s["length"]).all()
    assert out.sequence_id.nunique() <= -(-out["length"].sum() // 1024) * 1.02 + 1


def test_op8(spark):
    import hashlib
    import zlib

    from citelode.llm import webp

    used, want = set(), {}
    for k, t in texts(spark):
        raw = (t or "").encode()
        p = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        m = webp.store(p)
        used |= webp.parts_of(m)
        want[k] = (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest())
    out = {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in queries.op8_webp_columns(spark, str(SF)).collect()}
    assert out == want and used >= {"palette", "cache", "back-references", "prefix codes"}


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("op2_html_extraction", ["page_id", "url", "text", "n_chars"]),
        ("op3_language_id", ["doc_id", "held_out", "lang_pred", "score"]),
        ("op5_sentence_pieces", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]),
        ("op7_best_fit_packing", ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]),
        ("op8_webp_columns", ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]),
    ],
)
def test_columns_and_rows(spark, name, columns):
    out = queries.queries()[name](spark, str(SF))
    table, key = ("pages", "page_id") if name.startswith("op2") else ("documents", "doc_id")
    assert out.columns == columns
    assert out.select(key).distinct().count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
