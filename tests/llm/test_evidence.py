"""Prototypes, scores and features recomputed by hand; odd inputs of operators that other tests leave out."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from citelode.llm import html_text, lang_id, license_scan, packing, queries, webp
from citelode.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string"


def plain_bundle(text):
    """A text's vector, gram by gram, scaled to length one; None without a letter."""
    chars = [c if c.isalpha() else " " for c in f" {text.lower()} "]
    if all(c == " " for c in chars):
        return None
    chars = [c for i, c in enumerate(chars) if c != " " or i == 0 or chars[i - 1] != " "]
    total = np.zeros(lang_id.DIM)
    for i in range(len(chars) - 2):
        gram = np.ones(lang_id.DIM)
        for place, c in enumerate(chars[i : i + 3]):
            gram = gram * np.roll(lang_id.letter_vector(0 if c == " " else ord(c), lang_id.DIM), place)
        total += gram
    return total / np.linalg.norm(total)


def test_prototypes_and_scores_by_hand(spark):
    rows = [(0, "Abba, ab!  ab", "x"), (1, "baab 12 AB", "x"), (2, "zyx ñandú zyx", "y"), (3, "123", "y"), (4, None, "y"), (5, "words without a label", None)]
    df = spark.createDataFrame(rows, DOCS)
    model = lang_id.train(df)
    want = {}
    for name in ("x", "y"):
        own = [v for _, t, lang in rows if lang == name and t is not None and (v := plain_bundle(t)) is not None]
        want[name] = sum(own) / np.linalg.norm(sum(own))
    assert set(model) == set(want) and all(np.allclose(model[k], want[k], atol=1e-6) for k in want)
    for r in lang_id.predict(df, model).collect():
        v = None if r.text is None else plain_bundle(r.text)
        if v is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            cosines = {k: float(v @ p) for k, p in want.items()}
            best = max(sorted(cosines), key=cosines.get)
            assert r.lang_pred == best and r.score == pytest.approx(min(1, max(0, cosines[best])), abs=1e-5)


def plain_feature(payload, width, height):
    pixels = [[payload[3 * (y * width + x) : 3 * (y * width + x) + 3] for x in range(width)] for y in range(height)]
    channels = [[p[c] for row in pixels for p in row] for c in range(3)]
    means, spreads = [statistics.fmean(c) for c in channels], [statistics.pstdev(c) for c in channels]
    cells = []
    for i in range(8):
        ys = range(i * height // 8, max((i + 1) * height // 8, i * height // 8 + 1))
        for j in range(8):
            cells.append(sum(sum(pixels[y][x]) for y in ys for x in range(j * width // 8, (j + 1) * width // 8)) / len(ys))
    mean = math.fsum(cells) / 64
    bits = int("".join("1" if c > mean else "0" for c in cells), 2).to_bytes(8, "big").hex()
    return f"{width}x{height};" + ",".join(f"{v:.4f}" for v in (*means, *spreads)) + f";{bits}"


def test_features_by_hand(spark):
    texts = [None, "", "hello", "Some words of prose, again and again. " * 40, "é😀" * 500, "\x00\xff" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = {r.doc_id: r for r in webp.media_columns(df).collect()}
    for i, t in enumerate(texts):
        r, payload = out[i], webp.padded(t)
        assert bytes(r.pixels) == payload
        assert r.feature == plain_feature(payload, r.width, r.height)


def test_html_that_is_long_deep_or_null(spark):
    deep = "<div>" * 3000 + "<p>deep words here</p>" + "</div>" * 3000
    long = "<article>" + "".join(f"<p>Sentence number {i} of a long page.</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "https://a.example/1", f"<body><article>{deep}</article></body>"), (2, None, "<body><article><p>no address</p></article></body>"), (3, "https://a.example/3", long), (4, "https://a.example/3", None), (4, "https://a.example/3", None)]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [r.page_id for r in out] == [1, 2, 3, 4, 4]
    assert out[0].text == "deep words here" and out[1].text == "no address"
    assert out[2].text.count("\n\n") == 19_999 and out[2].n_chars == len(out[2].text)
    assert [(r.text, r.n_chars) for r in out[3:]] == [("", 0)] * 2


def test_licences_in_long_repeated_and_odd_rows(spark):
    import inspect

    docs = spark.createDataFrame([(1, "word " * 200_000), (2, None), (2, None), (3, ""), (None, "some text")], "doc_id long, text string").withColumn("license", F.lit("mine")).withColumn("score", F.lit(1))
    out = license_scan.scan(docs)
    assert out.count() == 0 and "doc_id" in out.columns and inspect.signature(license_scan.scan)
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_packing_of_columns_with_taken_names(spark):
    rows = [(i, "some words " * (i % 40)) for i in range(50)] + [(7, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit("a")).withColumn("item", F.lit(1)).withColumn("offset", F.lit("b"))
    out = packing.pack_documents(df, tokenizer_path("byte_bpe_50k.json"), length=64).toPandas()
    assert list(out.columns) == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert (out.groupby("sequence_id")["length"].sum() <= 64).all() and out["doc_id"].nunique() == 50 and (out["doc_id"] == 7).sum() >= 4


def test_every_operator_has_one_query():
    numbers = [int(name[2:].split("_")[0]) for name in queries.queries()]
    assert numbers == list(range(1, 14))


def test_pipeline_of_repeated_rows_extra_columns_and_nothing(spark, tmp_path):
    import corpus_pipeline

    from citelode.llm import common

    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words int, score string, item long, piece string"
    words = "the quick brown fox jumps over a lazy dog and runs through green woods every single morning before breakfast with friends".split()
    said = [" ".join(words[(i * 7 + k * (i + 3)) % len(words)] + "abcdefgh"[(i + k) % 8] for k in range(60)) for i in range(12)]
    rows = [(i, t, "aa", "s", len(t), 5, "high", 1, "p") for i, t in enumerate(said)]
    rows += [rows[3]] * 2 + [(None, said[4] + " more", None, None, None, None, None, None, None), (20, None, "aa", "s", 0, 0, "", 0, ""), (21, "", "aa", "s", 0, 0, "", 0, "")]
    for name, some in (("full", rows), ("empty", [])):
        folder = tmp_path / name
        spark.createDataFrame(some, schema).write.parquet(str(folder / "documents.parquet"))
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        columns = docs.columns
        for stage, step in corpus_pipeline.STAGES:
            docs = common.stage(step(spark, docs, str(folder)), "test")
            assert stage == "best_fit_packing" or docs.columns == columns
            if stage == "ngram_jaccard":
                # copies under one key are that document; both texts of a pair with a null key stay in one
                assert {r.doc_id for r in docs.select("doc_id").collect()} >= ({*range(12)} if some else set())
        out = corpus_pipeline.run(spark, str(folder))
        assert out.columns[0] == "doc_id" and (out.count() > 0) == bool(some)
