"""What is kept: document files, edges, observed events; and folds over sorted rows."""

import random
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from citelode.functions import content, text
from citelode.operators import discovery, edges, events, observed, rerank, scan, session
from citelode.sources import document_sink, files
from tests.test_operators import found

PDF = b"%PDF-1.7\n" + b"x" * 5000


def downloads(spark, *rows):
    return spark.createDataFrame(rows, "url string, title string, content_type string, content binary")


def test_documents_are_stored_whole_or_told_why(spark, tmp_path):
    page = b"<html>" + b"y" * 5000
    rows = downloads(
        spark,
        ("https://a/1.pdf", "One", "application/pdf", PDF),
        ("https://a/2", "Two", None, PDF),
        ("https://a/3.pdf", "Three", "application/pdf", page),
        ("https://a/4", "Four", "text/plain", b"z" * 5000),
        ("https://a/5", "Five", "application/json", page),
        ("https://a/6", None, "application/pdf", b""),
        ("https://a/7.epub", "Seven", "", b"PK\x03\x04" + b"x" * 10),
        ("https://a/8.epub", "Eight", "", b"PK\x03\x04" + b"x" * 5000),
        ("https://a/9", "Nine", "application/pdf", None),
        ("https://a/1.pdf", "One", "application/pdf", PDF),
    )
    folder = tmp_path / "library"
    out = {r.url: r for r in document_sink.save_documents(rows.repartition(4), str(folder)).collect()}
    assert len(out) == 9
    assert {u[-6:]: Path(r.path).suffix for u, r in out.items() if r.path} == {"/1.pdf": ".pdf", "://a/2": ".pdf", "://a/4": ".txt", "8.epub": ".epub"}
    assert Path(out["https://a/1.pdf"].path).read_bytes() == PDF and out["https://a/1.pdf"].size_bytes == len(PDF)
    assert {u[-6:]: r.error for u, r in out.items() if r.error} == {
        "/3.pdf": content.NOT_THE_DOCUMENT, "://a/5": content.NOT_A_DOCUMENT, "://a/6": content.NO_DATA, "://a/9": content.NO_DATA, "7.epub": content.TOO_SMALL % 14,
    }
    stored = [p.name for p in folder.rglob("*") if p.is_file() and p.suffix in (".pdf", ".txt", ".epub", ".html", ".part")]
    assert len(stored) == 4 and not any((folder / "_temporary").rglob("*"))


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    rows = downloads(spark, *[(f"https://a/{i}.pdf", f"t{i}", "application/pdf", PDF) for i in range(20)]).repartition(4)
    fail = F.when(F.col("url") == "https://a/7.pdf", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content"))
    with pytest.raises(Exception, match="lost"):
        document_sink.save_documents(rows.withColumn("content", fail), str(tmp_path / "lib"))
    assert not [p for p in (tmp_path / "lib").rglob("*") if p.suffix in (".pdf", ".part")]
    assert document_sink.save_documents(downloads(spark), str(tmp_path / "none")).count() == 0


def test_writer_drops_what_lost_attempts_left(tmp_path):
    import pyarrow as pa

    names = ["url", "name", "error", "content"]
    batch = pa.RecordBatch.from_arrays([pa.array(["u", "v"]), pa.array(["a.pdf", None]), pa.array([None, "bad"]), pa.array([PDF, b"x"])], names=names)
    writer = document_sink.DocumentWriter(str(tmp_path), "job")
    lost, done = writer.write(iter([batch])), writer.write(iter([batch]))
    assert lost.task != done.task and not (tmp_path / "a.pdf").exists()
    writer.commit([done, None])
    assert (tmp_path / "a.pdf").read_bytes() == PDF and not (tmp_path / "_temporary/job").exists()
    again = document_sink.DocumentWriter(str(tmp_path), "job2")
    again.abort([again.write(iter([batch])), None])
    assert not (tmp_path / "_temporary/job2").exists()


def related(kind, doi):
    if doi.endswith("bad"):
        raise OSError("busy")
    return [] if doi.endswith("none") else [f"10.1234/{kind}", "10.1234/b"]


def test_edges_are_fetched_once(spark, tmp_path):
    store = str(tmp_path / "edges")
    docs = [(1, i, "t", [], None, None, f"10.1234/{k}", f"u{i}") for i, k in enumerate(("a", "b", "none", "bad"), 1)] + [(2, 1, "t", [], None, None, "10.1234/a", "v"), (2, 31, "t", [], None, None, "10.1234/late", "w")]
    ranked = spark.createDataFrame(docs, "run_id long, pos int, title string, authors array<string>, year string, abstract string, identifier string, url string")
    want = edges.wanted(ranked)
    assert {(r.kind, r.doi) for r in want.collect()} == {(k, f"10.1234/{d}") for k in edges.KINDS for d in ("a", "b", "none", "bad")}
    assert edges.materialise(want, store, "tests.test_stores:related") == 6
    first = {(r.kind, r.doi): r.related for r in edges.stored(spark, store).collect()}
    assert first["references", "10.1234/a"] == ["10.1234/references", "10.1234/b"] and first["citations", "10.1234/none"] == []
    # the second time only what failed is asked for, and nothing is stored
    assert edges.materialise(want, store, "tests.test_stores:related") == 0
    assert edges.materialise(ranked.selectExpr("'references' as kind", "'10.1234/new' as doi").limit(1), store, "tests.test_stores:related") == 1
    assert edges.stored(spark, store).count() == 7
    assert sorted(p.name[:6] for p in (tmp_path / "edges").iterdir()) == ["batch-", "batch-"]
    pairs = edges.as_pairs(edges.stored(spark, store))
    assert pairs.where("src_doi = '10.1234/a'").count() == 4 and pairs.where("src_doi = '10.1234/none'").count() == 0
    assert edges.stored(spark, str(tmp_path / "nothing")).count() == 0


def test_edges_feed_the_boost(spark, tmp_path):
    rows = [(1, i, f"t{i}", f"https://h/10.1234/{k}", f"10.1234/{k}", 1.0, 1.0, 0.5, None) for i, k in enumerate(("a", "b"), 1)]
    ranked = spark.createDataFrame(rows, "run_id long, pos int, title string, url string, identifier string, score double, authority double, tfidf double, reject_reason string")
    store = str(tmp_path / "edges")
    edges.materialise(edges.wanted(ranked), store, "tests.test_stores:related")
    out = {r.identifier: round(r.score, 6) for r in rerank.citation_boost(ranked, edges.as_pairs(edges.stored(spark, store))).collect()}
    assert out == {"10.1234/a": 1.0, "10.1234/b": 1.2}


def test_observed_events_reduce_to_the_totals(spark):
    rows = [{"run_id": r, "title": f"t{i}", "url": f"u{i}", "arrival_seq": i} for r, n in ((1, 7), (2, 3)) for i in range(n)]
    watch = observed.Watch(spark, [1, 2, 3])
    merged = found(spark, *rows)
    ranked = merged.withColumn("status", F.when(F.col("arrival_seq") % 3 == 0, "rejected").otherwise("kept"))
    one, two = observed.watched_candidates(watch, merged, ranked)
    done = watch.count(ranked.where("status = 'kept'").withColumn("ok", F.col("arrival_seq") % 2 == 0), "download", done=F.col("ok"), failed=~F.col("ok"))
    for df in (one, two, done):
        df.write.format("noop").mode("overwrite").save()
    state = {r.run_id: r for r in session.reduce_run(watch.events()).collect()}
    assert {k: (r.found, r.kept, r.rejected, r.done, r.failed, r.total, r.running) for k, r in state.items()} == {1: (7, 4, 3, 2, 2, 4, False), 2: (3, 2, 1, 1, 1, 2, False), 3: (0, 0, 0, 0, 0, 0, False)}
    with pytest.raises(ValueError, match="watched already"):
        watch.count(merged, "download")


# folds over sorted rows


def test_scan_carries_state_within_groups(spark):
    rows = [(k, i, i % 3) for k in ("a", None, "b") for i in range(40)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, x int")
    out = scan.scan(df, ["k"], ["i"], ["x"], "total long, even boolean", lambda: 0, lambda s, x: (s + x, (s + x, (s + x) % 2 == 0))).collect()
    sums = {}
    for r in sorted(out, key=lambda r: (str(r.k), r.i)):
        sums[r.k] = sums.get(r.k, 0) + r.x
        assert (r.total, r.even) == (sums[r.k], sums[r.k] % 2 == 0)
    assert len(out) == 120


@pytest.mark.parametrize("width", [7, 100_000])
def test_breaker_by_segments_equals_one_fold(spark, width):
    rng = random.Random(3)
    rows, want = [], {}
    for backend in ("a", "b", "hot"):
        ts, failures, until = 0.0, 0, 0.0
        for seq in range(600 if backend == "hot" else 60):
            ts += rng.choice([0, 1, 50, 120, 299, 300, 301, 900]) * rng.random() - (5 if rng.random() < 0.05 else 0)
            outcome = rng.choices(["failure", "success", "neutral"], [5, 2, 2])[0]
            failures, until, skipped = events.breaker_step(failures, until, ts, outcome)
            want[backend, seq] = (failures, ts < until, skipped)
            rows.append((backend, seq, ts, outcome))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "backend string, seq long, ts double, outcome string")
    out = events.circuit_breaker(df, width)
    assert {(r.backend, r.seq): (r.failures, r.open, r.skipped) for r in out.collect()} == want
    segments = events._segments(df, width).where("backend = 'hot'").select("__segment").distinct().count()
    assert segments > 5
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan


def test_cache_is_an_as_of_join(spark):
    rng = random.Random(8)
    entries = [(rng.choice(["a", "b", None]), rng.randint(0, 400) / 4, i) for i in range(300)]
    asked = [(rng.choice(["a", "b", "c", None]), rng.randint(0, 400) / 4, i) for i in range(300)]
    e = spark.createDataFrame(entries, "key string, stored_at double, value long")
    a = spark.createDataFrame(asked, "key string, at double, id long")
    out = session.cached(e, a, 2.5, ["key"])
    want = {}
    for k, t, i in asked:
        fit = [(s, v) for q, s, v in entries if q == k and q is not None and s <= t and t - s < 2.5]
        want[i] = max(fit)[1] if fit else None
    assert {r.id: r.value for r in out.collect()} == want and out.columns == ["key", "at", "id", "value"]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_truncated_cuts_bytes_at_characters(spark):
    texts = ["", "abc", "é" * 10, "aé€😀" * 5, "😀", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for limit in (0, 1, 2, 3, 4, 5, 9, 10, 13, 20, 100):
        got = [r[0] for r in df.select(text.truncated(F.col("t"), limit)).collect()]
        want = [None if t is None else t.encode()[:limit].decode("utf-8", "ignore") for t in texts]
        assert got == want, limit


def test_files_are_read_whatever_their_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MAX_ENTRY", 1000)
    (tmp_path / "a.txt").write_text("x" * 5000)
    (tmp_path / "b.pdf").write_bytes(PDF)
    with zipfile.ZipFile(tmp_path / "c.epub", "w") as z:
        z.writestr("a.xhtml", "<p>hello</p>" * 900)
    rows = {Path(r.path).name: len(r.content) for r in files.contents(spark, str(tmp_path)).collect()}
    assert rows["a.txt"] == 1000 and rows["b.pdf"] == len(PDF) and set(rows) == {"a.txt", "b.pdf", "c.epub"}
    monkeypatch.setattr(content, "MAX_PDF", 100)
    out = {Path(r.path).name: r for r in content.extract_files(files.contents(spark, str(tmp_path)), lambda b: "text").collect()}
    assert out["a.txt"].text == "x" * 1000 and out["c.epub"].text


def test_instances_are_chosen_by_seed(spark):
    urls = [f"https://i{i}" for i in range(5)]
    instances = spark.createDataFrame([(u, None) for u in urls] + [("http://127.0.0.1:1", True)], "url string, local boolean")
    asked = spark.createDataFrame([(s, s * 977 - 3000) for s in range(40)], "run_id long, seed long")
    health = spark.createDataFrame([("https://i2", True), ("https://i3", False)], "url string, open boolean")
    rows = discovery.choose_instances(instances, asked, health).collect()
    up = sorted(u for u in urls if u != "https://i2")
    for r in range(40):
        seed, n = r * 977 - 3000, len(up)
        first = seed % n
        second = (first + 1 + (seed >> 8) % (n - 1)) % n
        assert [x.url for x in sorted((x for x in rows if x.run_id == r), key=lambda x: x.turn)] == ["http://127.0.0.1:1", up[first], up[second]]
        assert first != second
    one = discovery.choose_instances(instances.where("url = 'https://i1'"), asked).collect()
    assert {(r.turn, r.url) for r in one} == {(1, "https://i1")}
    assert discovery.choose_instances(instances.limit(0), asked).count() == 0


def test_search_answers(spark):
    rows = spark.createDataFrame([("rust book", 1, ["a", "b"]), ("rust", 2, ["a"]), ("  \t", 1, ["a"]), (None, 1, None), ("none", 1, None)], "q string, page int, results array<string>")
    out = discovery.search_answer(rows, F.col("q"), F.col("page")).collect()
    assert [(r.status, r.number_of_results, r.results) for r in out] == [(200, 2, ["a", "b"]), (200, 0, []), (400, 0, []), (400, 0, []), (200, 0, [])]
    got = spark.createDataFrame([("web",), ("arxiv",), ("zenodo",)], "s string").select(discovery.source_concurrency(F.col("s"))).collect()
    assert [r[0] for r in got] == [2, 4, 2]


def test_embed_adds_vectors_batch_by_batch(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "id int, text string")
    out = rerank.embed(docs, lambda texts: [[float(len(t)), 1.0] for t in texts], "text").orderBy("id").collect()
    assert [list(r.vector) for r in out] == [[2.0, 1.0], [0.0, 1.0]]
    with pytest.raises(Exception, match="another number"):
        rerank.embed(docs, lambda texts: [], "text").collect()
