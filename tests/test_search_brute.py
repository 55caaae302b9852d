"""The whole search against a plain version of it: matched, ranked, reranked, judged, boosted, placed."""

import math

import pytest
import regex
from pyspark.sql import functions as F

from citelode.operators import dedup
from citelode.plans import registry, sessions
from tests.test_operators import plain_fold
from tests.test_registry import SF

pytestmark = pytest.mark.skipif(not SF.is_dir(), reason="the test tables aren't here")


def tokens(text):
    return [t for t in regex.split(r"[^\p{Alphabetic}\p{N}]+", (text or "").lower()) if len(t) >= 2]


def flagged(rows):
    top = max(r["tfidf"] for r in rows)
    cut = max(0.05, 0.02 * top)
    for r in rows:
        if top > 0 and r["tfidf"] < cut:
            r["reason"] = f"TF-IDF {r['tfidf']:.2f} below cutoff {cut:.2f}"


def plain_search(found, words, cosine, verdict, edges):
    """Rows of one run in their final order."""
    by_seq = {r["arrival_seq"]: r for r in found}
    rows = [{"insert_idx": i, **by_seq[seqs[0]], "from": [by_seq[s] for s in seqs], "reason": None} for i, seqs in enumerate(plain_fold(found))]
    asked = [t for w in words for t in tokens(w)]
    counts = [{t: 3 * tokens(r["title"]).count(t) + tokens(r["abstract"]).count(t) for t in set(asked)} for r in rows]
    df = {t: sum(c[t] > 0 for c in counts) for t in set(asked)}
    for r, c in zip(rows, counts, strict=True):
        r["tfidf"] = sum(c[t] * (math.log((len(rows) + 1) / (df[t] + 1)) + 1) for t in asked)
        r["rrf"] = sum(1 / (60 + x["rank_in_source"]) for x in r["from"])
        r["score"] = (r["tfidf"] + 0.001) * (r["rrf"] + 0.001)
    rows.sort(key=lambda r: (-round(r["score"], 12), -round(r["rrf"], 12), r["insert_idx"]))
    flagged(rows)
    head, tail = rows[:125], rows[125:]
    low, high = min(r["score"] for r in head), max(r["score"] for r in head)
    for r in head:
        lexical = (r["score"] - low) / (high - low) if high > low else 1.0
        r["score"] = 0.6 * lexical + 0.4 * min(1, max(0, cosine[r["url"]]))
    rows = sorted(head, key=lambda r: -round(r["score"], 12)) + tail
    kept = [r for r in rows if r["reason"] is None]
    if len(rows) >= 4 and len(kept) >= 4:
        at = len(kept) * 50 // 100
        for r in kept[at : max(len(kept) * 70 // 100, at + 1)]:
            if not verdict[r["url"]]:
                r["reason"] = "LLM judged off-topic"
    heads = {r["doi"]: r for r in rows[:30] if r["doi"]}
    hits = {doi: sum(dst == doi for src, dst in edges if src in heads and src != dst) for doi in heads}
    for doi, r in heads.items():
        r["score"] *= 1 + 0.1 * min(hits[doi], 5)
    rows.sort(key=lambda r: -round(r["score"], 12))
    flagged(rows)
    place = 0
    for r in rows:
        place += r["reason"] is None
        r["final_rank"] = place if r["reason"] is None else None
    return rows


def test_search_run_equals_the_plain_search(spark):
    found = dedup.with_keys(registry._discoveries(spark, str(SF)))
    about = found.withColumn("cosine", F.pmod(F.xxhash64("url"), F.lit(1000)) / 1000.0).withColumn("verdict", F.pmod(F.xxhash64("url", F.lit(1)), F.lit(3)) > 0)
    rows = [r.asDict() for r in about.orderBy("run_id", "arrival_seq").collect()]
    ids = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    edges = {(f"10.1234/x{i % 211}", f"10.1234/x{i * 7 % 211}") for i in ids}
    got = {}
    for r in sessions.q_search_run(spark, str(SF)).collect():
        got.setdefault(r.run_id, {})[r.insert_idx] = (r.url, r.score, r.status, r.reject_reason, r.final_rank, r.n_sources)
    assert set(got) == {r["run_id"] for r in rows}
    boosted = 0
    for run, mine in got.items():
        own = [r for r in rows if r["run_id"] == run]
        want = plain_search(own, registry._KEYWORDS, {r["url"]: r["cosine"] for r in own}, {r["url"]: r["verdict"] for r in own}, edges)
        plain = {r["insert_idx"]: (r["url"], round(r["score"], 6), "rejected" if r["reason"] else "kept", r["reason"], r["final_rank"], len({x["source_id"] for x in r["from"]})) for r in want}
        assert {k: (v[0], pytest.approx(v[1], abs=2e-6), *v[2:]) for k, v in plain.items()} == mine
        boosted += sum(r["reason"] == "LLM judged off-topic" for r in want)
    assert boosted > 0


def test_search_run_makes_its_rows_once(spark):
    """Of the tables' reads and folds there are a few, not one for each use of each stage's rows; texts are read for keys and for counts."""
    plan = sessions.q_search_run(spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 14 and plan.count("MapInArrow") <= 4
    one = registry._discoveries(spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert one.count("Scan parquet") == 1 and "Join" not in one


def test_document_sink_stores_every_page_that_may_be_one(spark):
    from citelode.functions import content

    kinds = ("text/html", "application/pdf", None, "application/json", "text/plain")
    out = {r.url: r for r in sessions.q_document_sink(spark, str(SF)).collect()}
    pages = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        pages.setdefault(r.url, []).append(r)
    assert set(out) == set(pages)
    for url, rows in pages.items():
        if len(rows) > 1:
            continue
        kind, size, html = kinds[rows[0].page_id % 5], len(rows[0].html.encode()), regex.sub(r"(?s)\?.*$", "", url.lower()).endswith((".html", ".htm"))
        page = not html and kind in ("text/html", "application/json")
        error = content.NOT_A_DOCUMENT if page else content.TOO_SMALL % size if size < 4096 else content.NOT_THE_DOCUMENT if kind == "application/pdf" else None
        assert (out[url].error, out[url].size_bytes) == (error, None if error else size)
        assert out[url].ext == (None if error else "html" if html or kind == "text/html" else "txt")
