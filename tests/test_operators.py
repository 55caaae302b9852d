"""Operators on rows: matching, ranking, reranking, folds of events, the library."""

import random

import pytest
from pyspark.sql import functions as F

from citelode.operators import dedup, discovery, events, library, rank, rerank
from citelode.operators.schemas import DISCOVERY

BASE = {"run_id": 1, "source_id": "s", "rank_in_source": 1, "source": "s", "authors": [], "year": None, "abstract": None, "identifier": None}


def found(spark, *rows):
    full = [{**BASE, "arrival_seq": i, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in DISCOVERY.split(", ")) for r in full], DISCOVERY)


def resolved(spark, *rows):
    return dedup.resolve(found(spark, *rows)).orderBy("insert_idx").collect()


def test_doi_merges_and_keeps_both_ranks(spark):
    out = resolved(spark, {"title": "A", "url": "https://doi.org/10.1234/x", "source_id": "a"}, {"title": "B", "url": "https://y/10.1234/x.full.pdf", "source_id": "b", "rank_in_source": 3})
    assert len(out) == 1 and [(r.source, r.rank) for r in out[0].source_ranks] == [("a", 1), ("b", 3)]


def test_titles(spark):
    long = "a study of very deep things"
    assert len(resolved(spark, {"title": long, "url": "u1"}, {"title": long.upper() + "!", "url": "u2"})) == 1
    assert len(resolved(spark, *[{"title": "Untitled", "url": f"u{i}"} for i in range(3)])) == 3
    bible = [{"title": "The Holy Bible", "url": "u1", "year": "1611"}, {"title": "The Holy Bible", "url": "u2", "year": "1752"}]
    assert len(resolved(spark, *bible)) == 2
    assert len(resolved(spark, {"title": "Deep Learning", "url": "u1", "year": "2016"}, {"title": "Deep Learning", "url": "u2", "year": "2016"})) == 1


def test_revised_edition_and_its_doi(spark):
    a = {"title": "The Art of Things", "url": "u1", "authors": ["Doe, J"], "year": "1999"}
    b = {"title": "The Art of Things Revised Edition", "url": "https://x/10.1234/rev", "authors": ["J Doe"], "year": "1999"}
    c = {"title": "Something else", "url": "https://y/10.1234/rev.pdf"}
    out = resolved(spark, a, b, c)
    assert len(out) == 1 and len(out[0].source_ranks) == 3


def test_cap_stops_ranks(spark):
    rows = [{"title": f"t{i}", "url": f"u{i}"} for i in range(4)] + [{"title": "t0", "url": "u0"}]
    out = dedup.resolve(found(spark, *rows), max_total=3).collect()
    assert len(out) == 3 and all(len(r.source_ranks) == 1 for r in out)


def plain_fold(rows):
    """The matcher once more, written apart from it: a linear search over all that was kept."""
    kept, seen = [], {"url": {}, "doi": {}}
    for r in rows:
        at = seen["url"].get(r["url"])
        learn = False
        if at is None and r["doi"]:
            at = seen["doi"].get(r["doi"])
        if at is None and r["norm"] not in ("", "untitled"):
            i = next((i for i, k in enumerate(kept) if k["norm"] == r["norm"]), None)
            if i is not None and (len(r["norm"].split()) >= 5 or (r["year"] and len(r["year"].encode()) == 4 and r["year"] == kept[i]["year"]) or (r["surname"] and r["surname"] == kept[i]["surname"])):
                at, learn = i, True
        if at is None and r["fingerprint"]:
            i = next((i for i, k in enumerate(kept) if k["fingerprint"] == r["fingerprint"]), None)
            if i is not None and r["norm"] and kept[i]["norm"] and (r["norm"].startswith(kept[i]["norm"]) or kept[i]["norm"].startswith(r["norm"])):
                at, learn = i, True
        new = at is None
        if new:
            at = len(kept)
            kept.append({**r, "ranks": []})
        seen["url"].setdefault(r["url"], at)
        if r["doi"] and (learn or (new and r["doi"] not in seen["doi"])):
            seen["doi"][r["doi"]] = at
        kept[at]["ranks"].append(r["arrival_seq"])
    return [k["ranks"] for k in kept]


def test_fold_equals_plain_fold_on_random_rows(spark):
    rng = random.Random(5)
    titles = ["Untitled", "Annual Report", "The Art of", "The Art of Things", "a study of very deep things", "a study of very deep thoughts", "!!"]
    rows = []
    for run in range(200):
        for i in range(rng.randint(1, 14)):
            doi = rng.choice(["", "", "10.1234/a", "10.1234/b.pdf", "10.1234/a.full"])
            rows.append({**BASE, "run_id": run, "arrival_seq": i, "rank_in_source": i, "title": rng.choice(titles), "url": f"https://h/{doi}" if doi else f"u{rng.randint(0, 6)}", "authors": rng.choice([[], ["Doe, J"], ["A Doe"], ["B Roe"]]), "year": rng.choice([None, "2000", "2001", "99"])})
    df = found(spark, *rows)
    got = {}
    for r in dedup.resolve(df).collect():
        got.setdefault(r.run_id, []).append((r.insert_idx, [x.rank for x in r.source_ranks]))
    keyed = {}
    for r in dedup.with_keys(df).orderBy("run_id", "arrival_seq").collect():
        keyed.setdefault(r.run_id, []).append(r.asDict())
    assert {k: [x for _, x in sorted(v)] for k, v in got.items()} == {k: plain_fold(v) for k, v in keyed.items()}


def test_relational_equals_fold_with_one_key(spark):
    rows = [{"title": f"t{i}", "url": f"https://h/10.1234/{i % 7}.pdf?{i}"} for i in range(40)]
    df = found(spark, *rows)
    assert dedup.resolve(df).count() == dedup.resolve_relational(df).count()


def ranked(spark, docs, words):
    rows = [(1, i, t, a, u, [("s", 1)] * n) for i, (t, a, u, n) in enumerate(docs)]
    df = spark.createDataFrame(rows, "run_id long, insert_idx int, title string, abstract string, url string, source_ranks array<struct<source:string, rank:int>>")
    keys = spark.createDataFrame([(1, w) for w in words], "run_id long, keyword string")
    return rank.flag_rejects(rank.rank_candidates(df, keys))


def test_ranking(spark):
    out = ranked(spark, [("deep nets", "x", "u", 1), ("x", "deep nets", "u", 1), ("garden", "flowers", "u", 1), ("deep nets", "x", "u", 3)], ["deep", "nets"]).orderBy("pos").collect()
    assert [r.insert_idx for r in out][:3] == [3, 0, 1]
    assert out[-1].insert_idx == 2 and out[-1].reject_reason.startswith("TF-IDF 0.00 below cutoff")
    assert [r.final_rank for r in rank.final_rank(ranked(spark, [("deep", "", "u", 1), ("no", "", "u", 1)], ["deep"])).orderBy("pos").collect()] == [1, None]
    assert ranked(spark, [("a", None, "u", 1)], ["zz"]).first().reject_reason is None
    assert ranked(spark, [], ["zz"]).count() == 0


def test_repeated_keywords_weigh_more(spark):
    once = ranked(spark, [("deep", "", "u", 1), ("x", "", "u", 1)], ["deep"]).orderBy("insert_idx").first().tfidf
    assert ranked(spark, [("deep", "", "u", 1), ("x", "", "u", 1)], ["deep", "deep"]).orderBy("insert_idx").first().tfidf == pytest.approx(2 * once)


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0], [1.0, 2.0]), ([0.0], [0.0]), ([], [])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(rerank.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_rerank_keeps_tail_below(spark):
    df = spark.createDataFrame([(1, i, 10.0 - i, float(i % 2)) for i in range(6)], "run_id int, pos int, score double, cosine double")
    df = df.withColumn("pos", F.col("pos") + 1).withColumn("old", F.col("pos"))
    out = rerank.semantic_rerank(df, F.lit(3)).orderBy("pos").collect()
    assert [r.old for r in out] == [2, 1, 3, 4, 5, 6]


def test_rerank_of_equal_scores_is_by_cosine(spark, tmp_path):
    from citelode.plans import registry

    # ids divisible by 97 have one lexical score, as the heads of large tables have
    rows = [(97 * i, [1.0, (7 * i % 30 - 15) / 10], i % 2) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    cosine = {i: max(0.0, (1 - 1.5 * v[1]) / (3.25**0.5 * (1 + v[1] ** 2) ** 0.5)) for i, v, _ in rows}
    want = {}
    for label in (0, 1):
        ids = [i for i, _, n in rows if n == label]
        head = sorted(ids[:20], key=lambda i: (-round(cosine[i], 6), i))
        want |= {i: (pytest.approx(0.6 + 0.4 * cosine[i], abs=2e-6), p) for p, i in enumerate(head, 1)} | {i: (1.0, p) for p, i in enumerate(ids[20:], 21)}
    assert {r.vec_id: (r.score, r.pos) for r in registry.q_semantic_rerank(spark, str(tmp_path)).collect()} == want


def test_band(spark):
    df = spark.createDataFrame([(1, f"u{i}", i, None) for i in range(10)], "run_id int, url string, pos int, reject_reason string")
    assert [r.url for r in rerank.borderline(df).orderBy("pos").collect()] == ["u5", "u6"]
    verdicts = spark.createDataFrame([(1, "u5", False), (1, "u6", True), (1, "u0", False)], "run_id int, url string, verdict boolean")
    assert [r.url for r in rerank.llm_filter(df, verdicts).where("reject_reason is not null").collect()] == ["u5"]
    assert rerank.borderline(df.where("pos < 3")).count() == 0


def test_band_of_odd_runs(spark):
    """An address that stands twice is judged as one; a run without a number, or of three kept rows, isn't asked about."""
    rows = [(1, f"u{i}", i, None) for i in range(10)] + [(1, "u5", 10, None), (1, "u5", 11, "old")] + [(None, f"u{i}", i, None) for i in range(10)] + [(2, f"u{i}", i, None if i < 3 else "old") for i in range(9)]
    df = spark.createDataFrame(rows, "run_id int, url string, pos int, reject_reason string")
    verdicts = spark.createDataFrame([(r, f"u{i}", False) for r in (1, 1, 2, None) for i in range(10)], "run_id int, url string, verdict boolean")
    out = rerank.llm_filter(df, verdicts)
    assert out.count() == len(rows) and out.columns == df.columns
    assert sorted((r.run_id, r.pos) for r in out.where(F.col("reject_reason") == rerank.OFF_TOPIC).collect()) == [(1, 5), (1, 6), (1, 10)]


def test_one_doi_twice_gains_once(spark):
    rows = [(1, i + 1, d, "", 10.0 - i, 1.0, 1.0, None) for i, d in enumerate(("10.1234/a", "10.1234/b", "10.1234/a", None, "10.1234/c"))]
    df = spark.createDataFrame(rows, "run_id int, pos int, identifier string, url string, score double, authority double, tfidf double, reject_reason string")
    edges = spark.createDataFrame([("10.1234/b", "10.1234/a"), ("10.1234/b", "10.1234/a"), ("10.1234/zz", "10.1234/c")], "src_doi string, dst_doi string")
    out = sorted((r.identifier or "", round(r.score, 6)) for r in rerank.citation_boost(df, edges).collect())
    assert out == [("", 7.0), ("10.1234/a", 9.6), ("10.1234/a", 10.0), ("10.1234/b", 9.0), ("10.1234/c", 6.0)]


def test_fingerprints_read_three_tokens(spark):
    from citelode.functions.text import author_year_fingerprint

    titles = ["a b c d e f", "...a, b", "  a-b  c.d ", "a", "a b c", "...", "", None, "¿Ä b; c?"]
    df = spark.createDataFrame([(t,) for t in titles], "t string").select(author_year_fingerprint(F.array(F.lit("Doe, J")), F.lit("2001"), F.col("t")))
    assert [r[0] for r in df.collect()] == [f"doe|2001|{h}" if h else None for h in ("a b c", "a b", "a b c", "a", "a b c", "", "", "", "ä b c")]


def test_citations(spark):
    df = spark.createDataFrame([(1, i + 1, f"10.1234/{i}", "", 10.0 - i, 1.0, 1.0, None) for i in range(4)], "run_id int, pos int, identifier string, url string, score double, authority double, tfidf double, reject_reason string")
    edges = spark.createDataFrame([("10.1234/0", "10.1234/3")] * 7 + [("10.1234/1", "10.1234/1")], "src_doi string, dst_doi string")
    out = {r.identifier: r.score for r in rerank.citation_boost(df, edges).collect()}
    assert out["10.1234/3"] == pytest.approx(7.0 * 1.5) and out["10.1234/1"] == 9.0


def test_sources(spark):
    df = spark.createDataFrame([(1, 0, "meta_search"), (1, 1, "bing"), (1, 2, "arxiv"), (1, 3, "zz"), (2, 0, "bing")], "run_id long, source_idx int, source_id string")
    assert sorted((r.run_id, r.source_id) for r in discovery.effective_sources(df).collect()) == [(1, "arxiv"), (1, "meta_search"), (2, "bing")]
    assert discovery.unknown_sources(df).first().error == "unknown source: zz"
    caps = spark.createDataFrame([(75,), (500,), (1500,), (4000,), (0,)], "m int")
    a, b = discovery.wave_deadlines(F.col("m"))
    assert [tuple(r) for r in caps.select(a, b).collect()] == [(16, 13), (27, 22), (52, 42), (60, 45), (15, 12)]
    assert discovery.intensity_of(100, 500, 8) == "balanced"


def test_breaker(spark):
    calls = [("failure", 0.0), ("failure", 1.0), ("neutral", 2.0), ("failure", 3.0), ("success", 4.0), ("failure", 400.0), ("success", 800.0), ("failure", 801.0)]
    df = spark.createDataFrame([("e", i, t, o) for i, (o, t) in enumerate(calls)], "backend string, seq long, ts double, outcome string")
    out = events.circuit_breaker(df).orderBy("seq").collect()
    assert [r.open for r in out] == [False, False, False, True, True, True, False, False]
    assert [r.skipped for r in out] == [False, False, False, False, True, False, False, False]


def test_run_state(spark):
    kinds = ["found", "start", "found", "found", "download_start", "download_start", "download_done", "ranking_done"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(kinds)] + [(2, 0, "start"), (2, 1, "failed"), (2, 2, "found")], "run_id int, seq int, type string")
    out = {r.run_id: r for r in events.run_state(df).collect()}
    assert (out[1].phase, out[1].found, out[1].done, out[1].active) == ("downloading", 2, 1, 1) and out[2].phase == "error"


def test_bytes(spark):
    rows = [(1, "a", 0, "progress", 10, False), (1, "a", 1, "done", 30, False), (1, "b", 0, "progress", 5, False), (1, "c", 0, "done", 99, True), (1, "d", 0, "progress", 7, False), (1, "d", 1, "failed", 0, False)]
    df = spark.createDataFrame(rows, "run_id int, url string, seq int, status string, bytes long, cached boolean")
    assert events.reconcile_bytes(df).first().bytes == 35


def test_upsert_keeps_id(spark):
    old = spark.createDataFrame([(7, 1, "u", "old"), (8, 1, "v", "old")], "id long, run_id long, url string, title string")
    new = spark.createDataFrame([(2, "u", "newer", 0), (2, "u", "newest", 1), (2, "w", "w", 2)], "run_id long, url string, title string, seq long")
    out = {r.url: (r.id, r.run_id, r.title) for r in library.upsert_documents(old, new).collect()}
    assert out == {"u": (7, 2, "newest"), "v": (8, 1, "old"), "w": (None, 2, "w")}


def test_library_guards(tmp_path):
    assert library.confined(str(tmp_path), "a/../b") and not library.confined(str(tmp_path), "../x")
    assert library.is_sensitive_root("/") and not library.is_sensitive_root(str(tmp_path / "x"))
    (tmp_path / "a.txt").write_text("hello")
    n, size = library.export_zip(str(tmp_path), ["a.txt"], str(tmp_path / "o.zip"))
    assert n == 1 and size > 0


def test_export_selection(spark):
    df = spark.createDataFrame([("a.pdf",), ("_text/a.txt",), (".x/y",), ("_index/z",), ("manifest.json",)], "path string")
    assert {r.path for r in library.export_selection(df, include_text=False).collect()} == {"a.pdf", "manifest.json"}
    assert {r.path for r in library.export_selection(df, include_originals=False).collect()} == {"_text/a.txt", "manifest.json"}


def test_native_plans_have_no_python(spark):
    out = ranked(spark, [("deep", "", "u", 1)], ["deep"])
    assert "Python" not in out._jdf.queryExecution().toString()
