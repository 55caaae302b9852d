"""Scalar functions against worked examples."""

import pytest
from pyspark.sql import functions as F

from citelode.functions import content, display, query, text, urls


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def each(spark, inputs, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["v"] for r in df.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


def test_parse_query(spark):
    got = each(spark, ["Please find all the books on therapy training.", "co2 emissions", "covid-19 vaccines 2021", "気候変動 2021", "café société", "we love AI", None], query.parse_query)
    assert got == [["therapy", "training"], ["co2", "emissions"], ["covid-19", "vaccines", "2021"], ["気候変動", "2021"], ["café", "société"], ["love", "ai"], []]


def test_has_searchable_token(spark):
    assert each(spark, ["AI", "a bc d", "a b c", "!!!", " ", None], text.has_searchable_token) == [True, True, False, False, False, False]


def test_expand_query(spark):
    got = each(spark, ["Christian bibles, scholarly texts, and patristic writings", "foo & bar", "one topic", ",;"], query.expand_query)
    assert got[0][:2] == ["Christian bibles", "scholarly texts"] and len(got[0]) == 3
    assert got[1:] == [["foo", "bar"], ["one topic"], [",;"]]


@pytest.mark.parametrize(
    ("asked", "n", "first"),
    [
        ("machine learning in healthcare", 4, "machine learning in healthcare"),
        ("climate change", 1, "climate change"),
        ("the therapy", 1, "the therapy"),
        ("alpha beta gamma delta epsilon zeta eta theta", 8, "alpha beta gamma delta epsilon zeta eta theta"),
        ("a1, b1, c1, d1, e1, f1, g1, h1, i1, j1", 10, "a1"),
        ("the of and a", 1, None),
    ],
)
def test_expand_query_broad(spark, asked, n, first):
    df = spark.createDataFrame([(1, asked)], "id int, q string")
    rows = query.expand_query_broad(df, "id", "q").orderBy("sub_idx").collect()
    assert len(rows) == n if first else len(rows) >= 1
    if first:
        assert rows[0].sub_query == first
    if n == 4:
        assert {r.sub_query for r in rows[1:]} == {"learning healthcare", "machine healthcare", "machine learning"}


def test_parse_expansion(spark):
    raw = '1. "Deep nets"\n\nQueries:\n- deep nets\n* my query\n• graph learning\nab\nTopic: other\nnever'
    df = spark.createDataFrame([(1, raw, "My query")], "id int, raw string, q string")
    assert [r.sub_query for r in query.parse_expansion(df, "id", "raw", "q").orderBy("idx").collect()] == ["Deep nets", "graph learning"]
    many = "\n".join(f"search number {i}" for i in range(80))
    assert query.parse_expansion(spark.createDataFrame([(1, many, "q")], "id int, raw string, q string"), "id", "raw", "q").count() == 48


def test_replies(spark):
    assert each(spark, ["Yes.", " no", "TRUE!", "y", "", None], query.parse_yes) == [True, False, True, True, False, False]
    got = each(spark, ['"machine learning"', "machin lerning", "Sorry, no", "", "x" * 60], lambda x: query.parse_spellfix(x, F.lit("machin lerning")))
    assert got == ["machine learning", None, None, None, None]


def test_extract_doi(spark):
    stacked = [f"https://doi.org/10.1234/abc{a}{b}" for a in (".full", ".pdf", ".abstract", ".xml") for b in ("", ".full", ".pdf", ".html")]
    assert set(each(spark, stacked, urls.extract_doi)) == {"10.1234/abc"}
    got = each(spark, ["https://x/10.1038/nature12373.full", "10.1234/journal.pone.0012345", "no doi", None, "(10.1234/ABC);"], urls.extract_doi)
    assert got == ["10.1038/nature12373", "10.1234/journal.pone.0012345", None, None, "10.1234/abc"]


def test_titles(spark):
    got = each(spark, ["  Foo: A  Study! ", "Política", None, "x" * 300], text.normalize_title)
    assert got[:3] == ["foo a study", "política", ""] and len(got[3]) == 200


def test_fingerprint(spark):
    df = spark.createDataFrame([(["Doe, Jane"], "2020", "The Role of X"), (["Jane Doe"], "2020", "The role-of"), ([], "2020", "t"), (["A B"], "20", "t"), (["A B"], "2020", "!!")], "a array<string>, y string, t string")
    got = [r[0] for r in df.select(text.author_year_fingerprint(F.col("a"), F.col("y"), F.col("t"))).collect()]
    assert got == ["doe|2020|the role of", "doe|2020|the role of", None, None, None]


def test_authority(spark):
    cases = ["https://nih.gov/x", "https://cs.mit.edu", "https://link.springer.com/a", "https://notnature.com", "nonsense", None, "https://WWW.Nature.com"]
    assert each(spark, cases, urls.authority_multiplier) == [1.4, 1.3, 1.2, 1.0, 1.0, 1.0, 1.3]


def test_looks_like_doc(spark):
    good = ["http://a/x.pdf", "http://a/x.epub?y", "http://a/bitstream/1", "http://a/abs/1", "http://a/article/2", "http://a/page"]
    bad = ["http://a/x.html", "http://a/x.html?y=1", "http://a/x.htm#z"]
    assert each(spark, good + bad, urls.looks_like_doc) == [True] * 6 + [False] * 3
    assert each(spark, ["https://doi.org/x.pdf", "https://a/x.pdf", "https://a/article/file?id=1", "https://a/abs/1"], urls.is_likely_pdf_url) == [False, True, True, False]


def test_urls(spark):
    assert each(spark, ["http://A.b/c//#x", "http://a.b/C"], urls.url_key) == ["http://a.b/c", "http://a.b/c"]
    assert each(spark, ["https://arxiv.org/abs/1"], urls.canonicalize_doc_url) == ["https://arxiv.org/pdf/1"]
    assert each(spark, ["https://a.b/c/d", "x", "https:///y"], urls.referer_for) == ["https://a.b/", None, None]
    assert each(spark, ["/a b/ü~"], urls.file_uri) == ["file:///a%20b/%C3%BC~"]
    shapes = ["https://a.b", "ftp://a.b", "https://u:p@a.b", "http://10.0.0.1/", "http://localhost/", "http://8.8.8.8/"]
    assert each(spark, shapes, urls.has_safe_shape) == [True, False, False, False, False, True]


def test_private_ip(spark):
    private = ["127.0.0.1", "10.1.2.3", "100.64.0.1", "169.254.1.1", "172.31.0.1", "192.168.1.1", "198.19.0.1", "224.0.0.1", "255.255.255.255", "0.0.0.0", "192.0.2.5"]
    public = ["8.8.8.8", "172.32.0.1", "100.128.0.1", "1.1.1.1"]
    assert each(spark, private + public, urls.is_private_ipv4) == [True] * len(private) + [False] * len(public)
    v6 = ["::1", "::", "fc00::1", "fe80::1", "ff02::1", "::ffff:10.0.0.1", "64:ff9b::a00:1", "2001:4860:4860::8888", "::ffff:8.8.8.8", "junk"]
    assert each(spark, private + v6, urls.is_private_ip) == [True] * len(private) + [True] * 7 + [False, False, None]


def test_strip_html(spark):
    got = each(spark, ["<script>x</script><p>a &amp; b</p>&#8217;&#233;&#x2014;&#39;", "a&#xD800;b&#0;c", "&copy;"], text.strip_html)
    assert got == ["\na & b\n’é—'", "abc", "&copy;"]


def test_clean_title(spark):
    got = each(spark, [" <b>A</b> &mdash;\n B&nbsp;C &unknown; &#8217;", "&amp;lt;"], text.clean_title)
    assert got == ["A — B C &unknown; ’", "&lt;"]


def test_reconstruct_abstract(spark):
    df = spark.createDataFrame([({"Deep": [0], "learning": [1, 3], "for": [2], "health": [4]},), ({},), ({"x": [200000]},)], "m map<string, array<bigint>>")
    assert [r[0] for r in df.select(text.reconstruct_abstract(F.col("m"))).collect()] == ["Deep learning for learning health", None, None]


def test_slugs(spark):
    assert each(spark, ["A  b: c!"], lambda x: text.slug(x, F.lit("u")))[0].startswith("A-b-c-")
    assert each(spark, ["!!", "My Query"], lambda x: text.safe_folder(x, F.lit("1-2"))) == ["library-1-2", "my-query-1-2"]


def test_content(spark):
    df = spark.createDataFrame([(bytearray(b"\xef\xbb\xbf%PDF-1.4"),), (bytearray(b"PK\x03\x04"),), (bytearray(b"<html>"),)], "b binary")
    b = F.col("b")
    assert [r[0] for r in df.select(content.sniff_doc_ext(b)).collect()] == [".pdf", ".epub", None]
    assert [r[0] for r in df.select(content.reconcile_doc_ext(b, F.lit(".html"), F.lit(False))).collect()] == [".pdf", ".epub", ".html"]
    assert [r[0] for r in df.select(content.reconcile_doc_ext(b, F.lit(".pdf"), F.lit(True))).collect()] == [".pdf", ".epub", None]
    assert [r[0] is None for r in df.select(content.check_magic_bytes(F.lit(".pdf"), b)).collect()] == [True, False, False]
    kinds = [("u.pdf", ""), ("u", "text/html"), ("u.html", ""), ("u", "application/epub+zip"), ("u", ""), ("u.txt?x", "")]
    df = spark.createDataFrame(kinds, "u string, c string")
    assert [r[0] for r in df.select(content.ext_from(F.col("u"), F.col("c"))).collect()] == [".pdf", ".html", ".html", ".epub", ".pdf", ".txt"]
    assert [r[0] is None for r in df.select(content.reject_content_type(F.col("u"), F.col("c"))).collect()] == [True, False, True, True, True, True]
    assert [x is None for x in values(spark, [(0,), (10,), (5000,), (600 * 2**20,)], "s long", content.reject_size(F.col("s")))] == [False, False, True, False]


def test_pdf_link(spark):
    pages = [
        ('<meta name="citation_pdf_url" content="/a.pdf"><a href="/z.pdf">', "https://h/a.pdf"),
        ('<link type="application/pdf" href="https://o/b.pdf">', "https://o/b.pdf"),
        ('<a href="https://o/c.pdf"><a href="d.pdf">', "https://h/x/d.pdf"),
        ('<div data-pdf="/e.pdf"><a href="/z.pdf">', "https://h/e.pdf"),
        ('<a href="/download/7">', "https://h/download/7"),
        ('<meta name="description" content="citation_pdf_url">', None),
    ]
    df = spark.createDataFrame([(i, h, "https://h/x/y") for i, (h, _) in enumerate(pages)], "i int, html string, u string")
    got = {r.i: r.pdf_url for r in content.pdf_link(df, "html", "u").collect()}
    assert [got[i] for i in range(len(pages))] == [want for _, want in pages]


def test_extract_files(spark):
    import io
    import zipfile

    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("a.xhtml", "<p>one</p>")
        z.writestr("b.css", "x")
    rows = [("f/a.txt", b"plain"), ("f/b.html", b"<p>x &amp; y</p>"), ("f/c.epub", b.getvalue()), ("f/d.pdf", b"%PDF"), ("f/e.txt", b"  "), ("f/g.epub", b"junk")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    got = {r.path: (r.text, r.extract_error) for r in content.extract_files(df).collect()}
    assert got["f/a.txt"] == ("plain", None) and got["f/b.html"][0].strip() == "x & y" and got["f/c.epub"][0].strip() == "one"
    assert got["f/e.txt"] == (None, "extracted text is empty") and got["f/d.pdf"][0] is None and got["f/g.epub"][1]


def test_errors(spark):
    got = each(spark, ["HTTP 429", "Forbidden", "503", "timed out", "non-json", "x", None], display.classify_source_error)
    assert got == ["rate_limit", "forbidden", "server_error", "timeout", "parse_error", "other", "other"]
    got = each(spark, [None, "You're offline", "x (HTTP 404)", "only 500 bytes: too small", "file text is empty", "odd"], display.humanize_download_error)
    said = display.DOWNLOAD_MESSAGES
    assert got == [said["none"], "You're offline", said["gone"], said["small"], said["no_text"], "odd"]
    got = each(spark, ["HTTP 400", "http 403", "(HTTP 410)", "HTTP 429", "HTTP 503", "landing page", "Too Large", "no signature", "timeout", "DNS", "Cancelled by you"], display.download_error_kind)
    assert got == ["rejected", "blocked", "gone", "busy", "server", "page", "large", "damaged", "timeout", "network", "cancelled"]
    got = each(spark, ["rate_limit", "parse_error", "odd"], lambda k: display.humanize_source_kind(k, F.lit("arxiv")))
    assert got == ["arXiv is rate-limiting us right now — we'll back off and keep going.", "Couldn't read arXiv's response.", "arXiv reported a problem."]
    got = values(spark, [(400,), (403,), (410,), (408,), (502,), (418,)], "n int", content.http_status_message(F.col("n")))
    assert got == [content.STATUS_MESSAGES[k] for k in (400, 401, 404, 408, 500)] + [content.OTHER_STATUS]
    assert each(spark, ["meta_search/web", "arxiv", "zz"], display.source_label) == ["DuckDuckGo", "arXiv", "zz"]


def test_formats(spark):
    assert values(spark, [(0,), (512,), (1536,), (300 * 1024,), (5 * 2**30,)], "n long", display.format_bytes(F.col("n"))) == ["—", "512 B", "1.5 KB", "300 KB", "5.0 GB"]
    assert values(spark, [(833.33,), (1500.0,), (61000.0,)], "n double", display.format_duration(F.col("n"))) == ["833ms", "1.5s", "1m 1s"]
    now = F.lit(10_000_000 * 1000)
    got = values(spark, [(10_000_000 - s,) for s in (5, 300, 7200, 200000)], "n long", display.format_relative_time(F.col("n"), now))
    assert got == ["just now", "5m ago", "2h ago", "2d ago"]
    assert each(spark, ["a-b-12-34", "ab"], display.library_timestamp) == [12, None]
    assert each(spark, ["x.PDF", "x.htm?y", "x.doc", None], display.ftype_from_path) == ["pdf", "html", None, None]
