"""A network of made-up providers: answers depend on the request alone."""

import json
import re

from citelode.sources.live import FetchError, Request

#: Hits of each provider in all; those whose number is in DROPPED give no document.
TOTAL = {"export.arxiv.org": 450, "api.openalex.org": 430, "api.semanticscholar.org": 120, "www.ebi.ac.uk": 230, "archive.org": 130, "doaj.org": 230, "zenodo.org": 60, "gutendex.com": 70}
PAGE = {"html.duckduckgo.com": 30, "search.brave.com": 20, "www.bing.com": 10, "www.mojeek.com": 10, "search.marginalia.nu": 25, "www.startpage.com": 10}


def dropped(i: int) -> bool:
    return i % 5 == 3


def answer(request: Request) -> str:
    host = re.match("https://([^/]+)", request.url)[1]
    p = dict(request.params)
    words = p.get("q") or p.get("query") or p.get("search") or p.get("search_query") or request.url
    if "fails" in words and p.get("page") == "2":
        raise FetchError("HTTP 503")
    if "broken" in words:
        return "<html>no JSON"
    url = lambda i: f"https://files.example/{i}.{'html' if dropped(i) else 'pdf'}"
    if host == "export.arxiv.org":
        some = range(int(p["start"]), min(TOTAL[host], int(p["start"]) + int(p["max_results"])))
        entries = "".join(f"<entry><title>t{i}</title>{'' if dropped(i) else f'<id>http://arxiv.org/abs/{i}</id>'}</entry>" for i in some)
        return f'<feed xmlns="http://www.w3.org/2005/Atom">{entries}</feed>'
    if host == "api.openalex.org":
        at = 0 if p["cursor"] == "*" else int(p["cursor"])
        some = range(at, min(TOTAL[host], at + int(p["per-page"])))
        after = at + len(some)
        return json.dumps({"meta": {"next_cursor": str(after) if after < TOTAL[host] else None}, "results": [{"id": f"W{i}", "title": f"t{i}", "primary_location": {"pdf_url": url(i)}} for i in some]})
    if host == "api.semanticscholar.org":
        at = int(p["offset"])
        some = range(at, min(TOTAL[host], at + int(p["limit"])))
        after = {"next": at + len(some)} if at + len(some) < TOTAL[host] else {}
        return json.dumps({"data": [{"title": f"t{i}", "openAccessPdf": None if dropped(i) else {"url": url(i)}} for i in some], **after})
    if host == "www.ebi.ac.uk":
        at = 0 if p["cursorMark"] == "*" else int(p["cursorMark"])
        some = range(at, min(TOTAL[host], at + int(p["pageSize"])))
        hits = [{"title": f"t{i}", "fullTextUrlList": {"fullTextUrl": [] if dropped(i) else [{"documentStyle": "pdf", "url": url(i)}]}} for i in some]
        return json.dumps({"nextCursorMark": str(at + len(some)), "resultList": {"result": hits}})
    if host == "archive.org":
        if "/metadata/" in request.url:
            i = int(request.url.rsplit("i", 1)[1])
            if i == 7:
                raise FetchError("HTTP 404")
            return json.dumps({"files": [{"name": f"{i}.{'txt' if i == 9 else 'pdf'}", "format": "x"}]})
        rows = int(p["rows"])
        some = range((int(p["page"]) - 1) * rows, min(TOTAL[host], int(p["page"]) * rows))
        return json.dumps({"response": {"docs": [{"identifier": f"i{i}", "title": f"t{i}", "format": ["DjVu"] if dropped(i) else ["Text PDF"]} for i in some]}})
    if host == "doaj.org":
        size = int(p["pageSize"])
        some = range((int(p["page"]) - 1) * size, min(TOTAL[host], int(p["page"]) * size))
        return json.dumps({"results": [{"bibjson": {"title": f"t{i}", "link": [] if dropped(i) else [{"type": "fulltext", "url": url(i)}]}} for i in some]})
    if host == "zenodo.org":
        some = range((int(p["page"]) - 1) * 25, min(TOTAL[host], int(p["page"]) * 25))
        return json.dumps({"hits": {"hits": [{"metadata": {"title": f"t{i}"}, "files": [{"key": "x.csv" if dropped(i) else "x.pdf", "links": {"self": url(i)}}]} for i in some]}})
    if host == "gutendex.com":
        page = int((re.search("page=([0-9]+)", request.url) or [0, "1"])[1])
        some = [] if page == 2 else range((page - 1) * 32, min(TOTAL[host], page * 32))
        after = f"https://gutendex.com/books?page={page + 1}" if page < 3 else "https://elsewhere.example/books?page=4"
        return json.dumps({"next": after, "results": [{"id": i, "title": f"t{i}", "formats": {} if dropped(i) else {"application/pdf": url(i)}} for i in some]})
    first = {"html.duckduckgo.com": p.get("s"), "search.brave.com": None, "www.bing.com": p.get("first"), "www.mojeek.com": p.get("s")}.get(host)
    size = PAGE[host]
    at = int(p["offset"]) * size if host == "search.brave.com" else (int(p["page"]) - 1) * size if host == "www.startpage.com" else int(first or 0)
    if "short" in words and at >= 2 * size:
        return "<p>nothing more</p>"
    mark = {"html.duckduckgo.com": "result__a", "search.brave.com": "result-header", "www.mojeek.com": "ob", "www.startpage.com": "w-gl__result-title"}.get(host)
    link = lambda i: f"//d/l/?uddg={url(i).replace(':', '%3A').replace('/', '%2F')}" if host == "html.duckduckgo.com" else url(i)
    one = lambda i: f'<a class="{mark}" href="{link(i)}">t{i}</a>' if mark else f'<h2><a href="{link(i)}">t{i}</a></h2>'
    return '<a href="https://menu.example/x.pdf">menu</a>' + "".join(one(i) for i in range(at, at + size))


PDF = b"%PDF-1.7\n" + b"x" * 5000
#: What made-up addresses answer: status, content type, body.
SITES = {
    "https://arxiv.org/pdf/1": (200, "application/pdf", PDF),
    "https://a.example/wrong-type": (200, "text/html; charset=utf-8", PDF),
    "https://a.example/landing": (200, "text/html", b'<html><a href="/files/paper.pdf">PDF</a></html>' + b" " * 5000),
    "https://a.example/files/paper.pdf": (200, "application/pdf", PDF),
    "https://a.example/page": (200, "text/html", b"<html>nothing here</html>" + b" " * 5000),
    "https://a.example/loop": (200, "text/html", b'<meta name="citation_pdf_url" content="https://a.example/page">'),
    "https://a.example/page.html": (200, "text/html", b"<html>" + b"y" * 5000),
    "https://a.example/tiny.pdf": (200, "application/pdf", b"%PDF"),
    "https://open.example/9.pdf": (200, "application/pdf", PDF),
}


def document(url: str) -> tuple[int, str, bytes]:
    if "slow" in url:
        raise TimeoutError
    if "refused" in url:
        raise ConnectionRefusedError
    return SITES.get(url, (404, "text/html", b""))
