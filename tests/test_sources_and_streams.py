"""Parsers on captured answers, and streams against their batch twins."""

import json

import pytest

from citelode.operators import dedup, events
from citelode.operators.schemas import DISCOVERY
from citelode.sources import connector, files, scholarly, web
from citelode.streaming import folds
from tests.test_operators import BASE, found


def answers(spark, *payloads):
    return spark.createDataFrame([(i, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)], "id int, payload string")


def test_openalex(spark):
    works = [
        {"id": "W1", "title": None, "publication_year": 2020, "best_oa_location": {"pdf_url": "https://doi.org/x"}, "primary_location": {"pdf_url": "https://a/x.pdf"}, "authorships": [{"author": {"display_name": "J D"}}], "abstract_inverted_index": {"b": [1], "a": [0]}},
        {"id": "W2", "title": "t", "best_oa_location": {"pdf_url": "https://a/x.html"}},
    ]
    out = scholarly.openalex(answers(spark, {"results": works}, "not json")).collect()
    assert [(r.rank_in_source, r.title, r.url, r.authors, r.year, r.abstract) for r in out] == [(1, "Untitled", "https://a/x.pdf", ["J D"], "2020", "a b")]


def test_other_providers(spark):
    r = scholarly.semantic_scholar(answers(spark, {"data": [{"title": "x"}, {"title": "t", "year": 2001, "openAccessPdf": {"url": "u"}, "externalIds": {"DOI": "10.1/x"}, "authors": [{"name": "A"}]}]})).first()
    assert (r.rank_in_source, r.url, r.year, r.identifier, r.authors) == (1, "u", "2001", "10.1/x", ["A"])
    r = scholarly.europe_pmc(answers(spark, {"resultList": {"result": [{"title": "t", "authorString": "Doe J., Roe R.", "pubYear": "1999", "fullTextUrlList": {"fullTextUrl": [{"documentStyle": "html", "url": "h"}, {"documentStyle": "PDF", "url": "p"}]}}]}})).first()
    assert (r.url, r.authors, r.year) == ("p", ["Doe J", "Roe R"], "1999")
    items = [{"bibjson": {"title": "t", "year": y, "link": [{"type": "fulltext", "url": "f"}, {"type": "fulltext", "content_type": "PDF", "url": "g"}]}} for y in (2003, "2004")]
    assert [(r.url, r.year) for r in scholarly.doaj(answers(spark, {"results": items})).collect()] == [("g", "2003"), ("g", "2004")]
    hit = {"metadata": {"title": "t", "publication_date": "2010-01", "doi": "10.1/z"}, "files": [{"key": "a.csv", "links": {"self": "n"}}, {"key": "b.PDF", "links": {"download": "d", "self": "s"}}]}
    r = scholarly.zenodo(answers(spark, {"hits": {"hits": [hit]}})).first()
    assert (r.url, r.year) == ("s", "2010")
    r = scholarly.gutenberg(answers(spark, {"results": [{"id": 5, "title": "t", "authors": [], "formats": {"application/pdf": "p", "text/plain": "x"}}]})).first()
    assert (r.url, r.year, r.identifier) == ("x", None, "5")


def test_internet_archive(spark):
    docs = [{"identifier": "i 1", "title": ["A", "B"], "creator": "C", "format": ["PDF", "x"], "year": 1900}, {"identifier": "i2", "format": "DjVu"}, {"identifier": "i3", "format": "EPUB"}]
    meta = spark.createDataFrame([("i 1", json.dumps({"files": [{"name": "n.epub", "format": "EPUB"}, {"name": "m n.pdf", "format": "Text PDF"}]})), ("i3", json.dumps({"files": [{"name": "x.txt"}]}))], "identifier string, payload string")
    out = scholarly.internet_archive(answers(spark, {"response": {"docs": docs}}), meta).collect()
    assert [(r.rank_in_source, r.title, r.url, r.authors, r.year) for r in out] == [(1, "A", "https://archive.org/download/i%201/m%20n.pdf", ["C"], "1900")]


def test_arxiv(spark):
    xml = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/1</id><title>One
      two</title><summary> s </summary><published>2024-01-01</published><author><name>A B</name></author><link href="http://x/1" title="pdf"/></entry>
      <entry><id>http://arxiv.org/abs/2v1</id><title>T</title><published>2023-02-02</published></entry></feed>"""
    out = scholarly.arxiv(answers(spark, xml, "<broken")).orderBy("rank_in_source").collect()
    assert [(r.title, r.url, r.year, r.authors, r.abstract) for r in out] == [("One two", "http://x/1", "2024", ["A B"], "s"), ("T", "https://arxiv.org/pdf/2v1.pdf", "2023", [], None)]


@pytest.mark.parametrize(("engine", "page"), [("web", '<a rel="x" class="r result__a z" href="//d/l/?uddg=https%3A%2F%2Fa%2Fx.pdf&amp;y">T <b>b</b></a>'), ("brave", '<a href="https://a/x.pdf" class="result-header">T <b>b</b></a>'), ("bing", '<h2 class="q"><a h="1" href="https://a/x.pdf">T <b>b</b></a></h2>'), ("mojeek", '<a class="ob" href="https://a/x.pdf">T <b>b</b></a>'), ("marginalia", '<h2><a href="https://a/x.pdf">T <b>b</b></a></h2>'), ("startpage", '<a class="w-gl__result-title result-link" href="https://a/x.pdf">T <b>b</b></a>')])
def test_engines(spark, engine, page):
    noise = '<a href="https://n/y.pdf">menu</a>' + page.replace("x.pdf", "page.html").replace("T <b>b</b>", "page") + page.replace("T <b>b</b>", " ")
    df = spark.createDataFrame([(1, noise + page)], "id int, html string")
    assert [(r.rank_in_source, r.title, r.url) for r in web.results(df, engine).collect()] == [(1, "T b", "https://a/x.pdf")]


def test_captured_answers(spark, tmp_path):
    (tmp_path / "doaj").mkdir()
    (tmp_path / "doaj" / "1.json").write_text("{}")
    spark.dataSource.register(connector.CapturedAnswers)
    assert [(r.source_id, r.payload) for r in spark.read.format("captured_answers").load(str(tmp_path)).collect()] == [("doaj", "{}")]


def test_run_log_and_manifest(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text('{"ts": "2024-01-01T00:00:00Z", "event": {"SourceHit": {"source": "a", "count": 3}}}\nbroken\n')
    out = files.run_log(spark, str(tmp_path / "log")).collect()
    assert len(out) == 1 and out[0].event.SourceHit["count"] == 3
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "manifest.json").write_text(json.dumps({"query": "q", "documents": [{"title": "t", "url": "u", "authors": ["a", "b"]}] * 2}))
    m = files.manifests(spark, str(tmp_path / "lib"))
    from citelode.operators import library

    rows = library.migrate_manifest(m, "library").collect()
    assert [(r.library, r.url, r.authors, r.size_bytes) for r in rows] == [("lib", "u", "a, b", 0)]


def run_stream(spark, df, build, tmp_path, parts=3):
    folder = str(tmp_path / "in")
    rows = df.count()
    for i in range(parts):
        df.where(f"seq_ >= {i * rows // parts} and seq_ < {(i + 1) * rows // parts}").drop("seq_").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.drop("seq_").schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = build(stream).writeStream.format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table("out").collect()


def test_stream_equals_batch_matcher(spark, tmp_path):
    rows = [{**BASE, "title": f"a study of very deep things {i % 5}", "url": f"u{i % 9}", "rank_in_source": i} for i in range(30)]
    df = found(spark, *rows)
    out = run_stream(spark, df.withColumn("seq_", df.arrival_seq), lambda s: folds.resolve_stream(s, 4), tmp_path)
    batch = dedup.resolve(df, 4).collect()
    assert sorted(r.insert_idx for r in out if r.outcome == "new") == [r.insert_idx for r in sorted(batch, key=lambda r: r.insert_idx)]
    assert sum(r.outcome != "capped" for r in out) == sum(len(r.source_ranks) for r in batch) and DISCOVERY


def test_stream_equals_batch_breaker(spark, tmp_path):
    kinds = ["failure", "failure", "neutral", "failure", "success"]
    df = spark.createDataFrame([(f"e{i % 2}", i, i * 40.0, kinds[i // 2 % 5]) for i in range(40)], "backend string, seq long, ts double, outcome string")
    out = run_stream(spark, df.withColumn("seq_", df.seq), folds.breaker_stream, tmp_path)
    assert sorted(map(tuple, out)) == sorted(map(tuple, events.circuit_breaker(df).collect()))


def test_stream_windows_and_log(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    samples = spark.createDataFrame([(1, start + timedelta(milliseconds=100 * i), 60_000) for i in range(60)], "run_id long, ts timestamp, bytes long")
    folder = str(tmp_path / "samples")
    samples.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(samples.schema).parquet(folder)
    q = folds.throughput_stream(stream, "0 seconds").writeStream.format("memory").queryName("speed").option("checkpointLocation", str(tmp_path / "c1")).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    speed = [r.mbps for r in spark.table("speed").collect()]
    assert len(speed) >= 10 and max(speed) == pytest.approx(0.6) and sum(speed) * 0.6 == pytest.approx(3.6)

    results = spark.createDataFrame([(f"https://a/{i % 4}{'/' if i % 2 else ''}", start) for i in range(20)], "url string, ts timestamp")
    results.coalesce(1).write.parquet(str(tmp_path / "results"))
    q = folds.unique_urls_stream(spark.readStream.schema(results.schema).parquet(str(tmp_path / "results"))).writeStream.format("memory").queryName("urls").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.url_key for r in spark.table("urls").collect()) == [f"https://a/{i}" for i in range(4)]

    folds.append_log(spark.readStream.schema(results.schema).parquet(str(tmp_path / "results")), str(tmp_path / "log"), str(tmp_path / "c3")).awaitTermination(120)
    folds.append_log(spark.readStream.schema(results.schema).parquet(str(tmp_path / "results")), str(tmp_path / "log"), str(tmp_path / "c3")).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "log")).count() == 20


def test_texts_are_written_by_stem(spark, tmp_path):
    from citelode.operators import library

    df = spark.createDataFrame([("a", "x"), ("b", None)], "stem string, text string")
    library.write_texts(df, str(tmp_path / "_text"))
    assert [(r.stem, r.text) for r in spark.read.parquet(str(tmp_path / "_text")).collect()] == [("a", "x")]
