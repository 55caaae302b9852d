"""Live providers over a made-up network: requests, paging, limits, partitions and filters."""

import json

import pytest
from pyspark.sql import functions as F

from citelode.sources import live
from tests import fake_net

FETCH = "tests.fake_net:answer"


def run(source, words, limit):
    """Requests made, and how many documents each page gave."""
    asked = []

    def fetch(request):
        asked.append(request)
        return fake_net.answer(request)

    waits = []
    answers = list(live.pages(live.PROVIDERS[source], words, limit, fetch, waits.append))
    return asked, answers, waits


def at(asked, *names):
    return [tuple(dict(r.params).get(n) for n in names) for r in asked]


def test_arxiv_pages_by_start_and_waits_between():
    asked, answers, waits = run("arxiv", ["deep", "nets"], 300)
    # 200 entries give 160 documents, the next page asks for the 140 that are missing and gives 112
    assert at(asked, "search_query", "start", "max_results") == [("all:deep AND all:nets", "0", "200"), ("all:deep AND all:nets", "200", "140"), ("all:deep AND all:nets", "340", "28"), ("all:deep AND all:nets", "368", "5"), ("all:deep AND all:nets", "373", "1"), ("all:deep AND all:nets", "374", "1")]
    assert [a.room for a in answers] == [300, 140, 28, 5, 1, 1] and waits == [3.0] * 5
    asked, _, _ = run("arxiv", ["x"], 5000)
    assert at(asked, "start") == [("0",), ("200",), ("400",)]  # the third page is short


def test_openalex_follows_cursors_to_the_end():
    asked, answers, _ = run("openalex", ["a", "b"], 1000)
    assert at(asked, "search", "per-page", "filter", "cursor") == [("a b", "200", "is_oa:true", c) for c in ("*", "200", "400")]
    assert [a.room for a in answers] == [1000, 840, 680]
    asked, _, _ = run("openalex", ["a"], 1)
    assert at(asked, "per-page") == [("1",)]


def test_semantic_scholar_ends_on_a_page_without_next():
    asked, _, _ = run("semantic_scholar", ["a"], 500)
    assert at(asked, "limit", "offset") == [("50", "0"), ("50", "50"), ("50", "100")]


def test_europe_pmc_pages_until_nothing_comes():
    asked, _, _ = run("europe_pmc", ["a", "b"], 1000)
    assert at(asked, "query", "pageSize", "cursorMark") == [("a b AND (OPEN_ACCESS:Y)", "100", c) for c in ("*", "100", "200", "230")]


def test_internet_archive_looks_items_up_until_enough():
    asked, answers, _ = run("internet_archive", ["a", "b"], 60)
    pages = [r for r in asked if "metadata" not in r.url]
    assert at(pages, "q", "rows", "page", "sort[]") == [("a AND b AND mediatype:texts", "60", str(i), "downloads desc") for i in (1, 2)]
    # of 48 items with a PDF one has no answer and one no file
    assert sum(a.item is not None and a.page == 0 for a in answers) == 46 and sum(a.item is not None for a in answers) == 60


def test_doaj_keeps_its_page_size_and_escapes_the_path():
    asked, _, _ = run("doaj", ["c-d", "é"], 150)
    assert asked[0].url == "https://doaj.org/api/search/articles/c%2Dd%20AND%20%C3%A9"
    assert at(asked, "page", "pageSize") == [("1", "100"), ("2", "100")]
    asked, _, _ = run("doaj", ["x"], 1000)
    assert at(asked, "page") == [("1",), ("2",), ("3",)]


def test_zenodo_ends_on_a_short_page():
    asked, _, _ = run("zenodo", ["x"], 1000)
    assert at(asked, "size", "page") == [("25", "1"), ("25", "2"), ("25", "3")]
    assert [v for k, v in asked[0].params if k == "type"] == ["publication", "preprint"]


def test_gutenberg_follows_links_on_its_own_host_only():
    asked, answers, _ = run("gutenberg", ["x", "y"], 1000)
    assert [r.url for r in asked] == ["https://gutendex.com/books?search=x+y", "https://gutendex.com/books?page=2", "https://gutendex.com/books?page=3"]
    assert [json.loads(a.payload)["results"] == [] for a in answers] == [False, True, False]


@pytest.mark.parametrize(
    ("source", "name", "most", "values"),
    [("web", "s", 8, ["0", "30", "60"]), ("brave", "offset", 6, ["0", "1", "2"]), ("bing", "first", 10, ["1", "11", "21"]), ("mojeek", "s", 8, ["1", "11", "21"]), ("startpage", "page", 6, ["1", "2", "3"]), ("marginalia", "profile", 1, ["no-js"])],
)
def test_engines_page_until_a_page_without_results(source, name, most, values):
    asked, _, _ = run(source, ["short", "x"], 10_000)
    assert [v for (v,) in at(asked, name)] == values
    asked, _, _ = run(source, ["x"], 10_000)
    assert len(asked) == most
    words = dict(asked[0].params).get("q") or dict(asked[0].params).get("query")
    assert words == ("x filetype:pdf OR filetype:epub" if source in ("web", "bing") else "x")
    assert all(r.method == ("POST" if source == "web" else "GET") for r in asked)


def test_errors_end_the_pages_after_what_came():
    _, answers, _ = run("zenodo", ["fails"], 1000)
    assert [(a.page, a.error, a.payload is None) for a in answers] == [(0, None, False), (1, "HTTP 503", True)]
    _, answers, _ = run("openalex", ["broken"], 10)
    assert len(answers) == 1 and answers[0].error


def expected(source, limit):
    """Numbers of the documents that a task gives."""
    host = {"arxiv": "export.arxiv.org", "openalex": "api.openalex.org", "semantic_scholar": "api.semanticscholar.org", "europe_pmc": "www.ebi.ac.uk", "internet_archive": "archive.org", "doaj": "doaj.org", "zenodo": "zenodo.org"}
    fine = [i for i in range(fake_net.TOTAL[host[source]]) if not fake_net.dropped(i) and not (source == "internet_archive" and i in (7, 9))]
    return [f"t{i}" for i in fine[:limit]]


@pytest.mark.parametrize("source", ["arxiv", "openalex", "semantic_scholar", "europe_pmc", "internet_archive", "doaj", "zenodo"])
@pytest.mark.parametrize("limit", [1, 55])
def test_documents_are_ranked_over_pages_up_to_the_limit(spark, source, limit):
    out = live.discover(spark, [("some words", source)], limit, FETCH).orderBy("rank_in_source").collect()
    assert [r.title or "" for r in out] == (expected(source, limit) if source != "arxiv" else [t for t in expected(source, limit)])
    assert [r.rank_in_source for r in out] == list(range(1, len(out) + 1))


def test_plain_predicates_keep_what_the_parsers_keep(spark):
    """Every engine and provider: documents of a page are the hits that count."""
    limit = 15
    want = {}
    for source in live.PROVIDERS:
        answers = run(source, ["short", "x"], limit)[1]
        kept = sum(live.PROVIDERS[source].kept(h) for a in answers if a.item is None for h in live.PROVIDERS[source].hits(a.payload)[0])
        want[source] = min(limit, sum(a.item is not None for a in answers) if source == "internet_archive" else kept)
    out = live.discover(spark, [("short x", source) for source in live.PROVIDERS], limit, FETCH)
    assert {r.source_id: r["count"] for r in out.groupBy("source_id").count().collect()} == want and min(want.values()) > 10


def test_tasks_are_partitions_and_filters_reach_the_reader(spark):
    live.register(spark)
    tasks = [(q, s) for q in ("a", "b") for s in ("zenodo", "openalex", "nowhere")]
    df = spark.read.format("provider_answers").option("tasks", json.dumps(tasks)).option("limit", "5").option("fetch", FETCH).load()
    assert df.rdd.getNumPartitions() == 6
    assert {(r.sub_query, r.error) for r in df.where("source_id = 'nowhere'").collect()} == {(q, "unknown source: nowhere") for q in "ab"}
    one = df.where((F.col("sub_query") == "a") & F.col("source_id").isin("zenodo", "openalex"))
    assert one.rdd.getNumPartitions() == 2 and {r.source_id for r in one.collect()} == {"zenodo", "openalex"}


def test_ask_for_tasks_of_many_runs(spark):
    tasks = spark.createDataFrame([(1, "a b", "zenodo", ["a", "b"]), (2, "fails", "zenodo", ["fails"]), (2, "x", "web", ["x"])], "run_id long, sub_query string, source_id string, keywords array<string>")
    answers = live.ask(tasks.repartition(3), 30, FETCH)
    docs = live.documents(answers, "zenodo").groupBy("run_id").agg(F.count("*").alias("n"), F.max("rank_in_source").alias("m"))
    assert {(r.run_id, r.n, r.m) for r in docs.collect()} == {(1, 30, 30), (2, 20, 20)}
    assert [r.error for r in answers.where("error is not null").collect()] == ["HTTP 503"]


def test_http_fetch_retries_what_may_pass(monkeypatch):
    import io
    import urllib.error

    asked, waits = [], []

    def open_url(request, timeout):
        asked.append(request)
        if len(asked) < 3:
            raise urllib.error.HTTPError(request.full_url, (429, 503)[len(asked) - 1], "", {"Retry-After": "6"} if len(asked) == 1 else {}, io.BytesIO())
        return io.BytesIO("é".encode())

    monkeypatch.setattr(live.urllib.request, "urlopen", open_url)
    assert live.http_fetch(live.Request("https://x/y", (("q", "a b"),)), wait=waits.append) == "é"
    assert [r.full_url for r in asked] == ["https://x/y?q=a+b"] * 3 and waits == [6.0, 4.0]
    monkeypatch.setattr(live.urllib.request, "urlopen", lambda r, timeout: (_ for _ in ()).throw(urllib.error.HTTPError(r.full_url, 404, "", {}, io.BytesIO())))
    with pytest.raises(live.FetchError, match="HTTP 404"):
        live.http_fetch(live.Request("https://x/y"), wait=waits.append)
