"""Downloads over a made-up network."""

from pathlib import Path

from citelode import commands
from citelode.functions import content
from citelode.sources import download
from tests import fake_net

FETCH = "tests.fake_net:document"


def test_downloads_follow_pages_and_open_addresses(spark, tmp_path):
    urls = [
        "https://arxiv.org/abs/1", "https://a.example/wrong-type", "https://a.example/landing", "https://a.example/page", "https://a.example/loop", "https://a.example/page.html", "https://a.example/tiny.pdf",
        "https://gone.example/9", "https://gone.example/8", "https://slow.example/x", "https://refused.example/x", "file:///etc/passwd", "https://user:pw@a.example/x.pdf",
    ]
    doi = {"https://gone.example/9": "10.1234/nine", "https://gone.example/8": "10.1234/eight", "https://slow.example/x": "10.1234/same"}
    docs = spark.createDataFrame([(u, f"t {i}", doi.get(u)) for i, u in enumerate(urls)] + [(urls[0], "again", None), (None, "none", None)], "url string, title string, identifier string")
    places = spark.createDataFrame([("10.1234/nine", "https://open.example/9.pdf"), ("10.1234/eight", "https://open.example/gone.pdf"), ("10.1234/same", "https://slow.example/x")], "doi string, url_for_pdf string")
    out = {r.url: r for r in download.download(docs, FETCH, str(tmp_path / "lib"), places).collect()}
    assert set(out) == set(urls)
    stored = {u: Path(r.path).suffix for u, r in out.items() if r.path}
    assert stored == {urls[0]: ".pdf", urls[1]: ".pdf", urls[2]: ".pdf", urls[5]: ".html", urls[7]: ".pdf"}
    assert all(Path(out[u].path).read_bytes() == fake_net.PDF for u, ext in stored.items() if ext == ".pdf")
    gone = "The document is no longer available at this link (HTTP 404)"
    assert {u: r.error for u, r in out.items() if r.error} == {
        urls[3]: content.NOT_A_DOCUMENT, urls[4]: content.NOT_A_DOCUMENT, urls[6]: content.TOO_SMALL % 4, urls[8]: gone, urls[9]: content.NETWORK_MESSAGES["timeout"],
        urls[10]: content.NETWORK_MESSAGES["connect"], urls[11]: download.UNSAFE, urls[12]: download.UNSAFE,
    }


def test_only_kept_candidates_are_downloaded(spark, tmp_path):
    ranked = spark.createDataFrame([(1, "https://arxiv.org/abs/1", "t", None, "kept"), (1, "https://open.example/9.pdf", "u", None, "rejected")], "run_id long, url string, title string, identifier string, status string")
    assert [(r.url, r.error) for r in commands.download_run(ranked, str(tmp_path / "lib"), FETCH).collect()] == [("https://arxiv.org/abs/1", None)]
    assert commands.download_run(ranked.limit(0), str(tmp_path / "none"), FETCH).count() == 0


def test_answers_are_handed_on_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(download, "HELD", 6000)
    rows = spark.createDataFrame([(i, "https://arxiv.org/pdf/1" if i % 3 else None) for i in range(50)], "id int, url string").coalesce(1)
    out = download.fetched(rows, "url", FETCH).orderBy("id").collect()
    assert [(r.id, r.transport, r.content == fake_net.PDF) for r in out] == [(i, None if i % 3 else "unsafe", bool(i % 3)) for i in range(50)]
