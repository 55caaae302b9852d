"""Live providers as partitioned readers: one partition for each sub-query and source, pages by each one's own rules.

A provider says how its requests look, what counts on a page, and where the next page is; the
generator ``pages`` follows that until the provider is at its end or enough documents are there.
The limit counts documents given, not raw hits, so a page has to be looked into as it comes:
``kept`` repeats in plain Python what the column parsers in ``scholarly`` and ``web`` keep (a
test holds the two together). Payloads go on as they are; ``documents`` parses them as a plan.

The network is a parameter: a fetcher ``Request -> str`` named as ``module:function``, so that
executors can import it; ``http_fetch`` is the one for live use.
"""

from __future__ import annotations

import importlib
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import quote, unquote_plus, urlencode, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from citelode.functions.text import TITLE_ENTITIES, _decode
from citelode.functions.urls import REDIRECTORS
from citelode.operators.schemas import DOCUMENT_FIELDS
from citelode.sources import scholarly, web

ANSWERS = "source_id string, sub_query string, page int, item string, room int, payload string, error string"
LOOKUPS = 8
#: What providers are asked for, and how a plain client names itself.
OPENALEX_FIELDS = "id,title,publication_year,best_oa_location,primary_location,authorships,abstract_inverted_index"
SCHOLAR_FIELDS = "title,authors,year,abstract,openAccessPdf,externalIds"
ARCHIVE_FIELDS = ("identifier", "title", "creator", "year", "description", "format")
BROWSER = "Mozilla/5.0 (compatible; citelode)"


@dataclass(frozen=True)
class Request:
    """One request; ``params`` are the query, or a form's fields where ``method`` is POST."""

    url: str
    params: tuple[tuple[str, str], ...] = ()
    method: str = "GET"
    headers: tuple[tuple[str, str], ...] = ()


Fetch = Callable[[Request], str]


class FetchError(Exception):
    """A request that failed for good."""


@dataclass(frozen=True)
class Step:
    """Where a provider stands: the next page's token, pages asked so far, documents given so far."""

    token: Any
    page: int = 0
    given: int = 0


@dataclass(frozen=True)
class Provider:
    """A provider's rules.

    ``request(keywords, step, limit)`` makes the next page's request; ``hits(body)`` are the
    page's raw hits and what else ``after(step, hits, rest, limit)`` needs to find the next
    page's token, None at the end; ``kept(hit)`` is whether a document comes of a hit.
    ``lookup`` fetches a second answer for each hit that is kept, and ``found`` says whether it
    has what is needed.
    """

    first: Callable[[list[str]], Any]
    request: Callable[[list[str], Step, int], Request]
    hits: Callable[[str], tuple[list, Any]]
    kept: Callable[[Any], bool]
    after: Callable[[Step, list, Any, int], Any]
    most_pages: int | None = None
    pause: float = 0.0
    ends_when_empty: bool = True
    lookup: Callable[[Any], tuple[str, Request]] | None = None
    found: Callable[[str], bool] = field(default=lambda body: True)


def _likely_pdf(url: str | None) -> bool:
    if url is None:
        return False
    u = url.lower()
    if any(h in u for h in REDIRECTORS):
        return False
    good = any(m in u for m in (".pdf", "/pdf/", "/pdf?", "download=pdf", "/bitstream/", "/download/", "getfile"))
    return good or not (u.endswith((".html", ".htm")) or "/abs/" in u)


def _plausible(url: str) -> bool:
    u = url.lower()
    strong = (".pdf", ".epub", "/pdf/", "/pdf?", "download=pdf", "filetype=pdf", "/bitstream/", "/download/", "getfile", "/abs/", "/article/")
    return any(m in u for m in strong) or not re.split("[?#]", u, maxsplit=1)[0].endswith((".html", ".htm"))


def _get(x: Any, *path: str) -> Any:
    for p in path:
        x = x.get(p) if isinstance(x, dict) else None
    return x


def _json(*path: str, rest: tuple[str, ...] = ()) -> Callable[[str], tuple[list, Any]]:
    def read(body: str) -> tuple[list, Any]:
        data = json.loads(body)
        return _get(data, *path) or [], _get(data, *rest) if rest else None

    return read


def _listed(x: Any) -> list[str]:
    return [str(v) for v in x] if isinstance(x, list) else [] if x is None else [str(x)]


# What each provider keeps of a hit.


def _europe_kept(hit: dict) -> bool:
    return any(u.get("url") is not None for u in _get(hit, "fullTextUrlList", "fullTextUrl") or [])


def _doaj_kept(hit: dict) -> bool:
    full = [x for x in _get(hit, "bibjson", "link") or [] if x.get("type") == "fulltext"]
    best = next((x for x in full if "pdf" in (x.get("content_type") or "").lower()), full[0] if full else {})
    return best.get("url") is not None


def _zenodo_kept(hit: dict) -> bool:
    file = next((f for f in hit.get("files") or [] if (f.get("key") or "").lower().endswith((".pdf", ".epub"))), {})
    return any(_get(file, "links", k) is not None for k in ("self", "download", "content"))


def _archive_kept(hit: dict) -> bool:
    formats = " ".join(_listed(hit.get("format"))).lower()
    return bool(_listed(hit.get("identifier"))) and ("pdf" in formats or "epub" in formats)


def _archive_found(body: str) -> bool:
    try:
        files = json.loads(body).get("files") or []
    except ValueError:
        return False
    return any(ext in (f.get("format") or "").lower() or (f.get("name") or "").lower().endswith("." + ext) for f in files for ext in ("pdf", "epub"))


def _anchors(engine: str) -> Callable[[str], tuple[list, Any]]:
    """Anchors of a page of results: attributes and inner markup."""
    mark, anchor = web.ENGINES[engine], re.compile(web.ANCHOR)
    own = re.compile(rf'(?i)class="[^"]*\b{mark}\b[^"]*"') if mark else None

    def read(body: str) -> tuple[list, Any]:
        if own:
            return [m.groups() for m in anchor.finditer(body) if own.search(m[1])], None
        heads = (anchor.search(h) for h in re.findall(r"(?is)<h2\b[^>]*>(.*?)</h2>", body))
        return [m.groups() for m in heads if m], None

    return read


def _web_kept(engine: str) -> Callable[[tuple[str, str]], bool]:
    link = re.compile(r'(?i)href="([^"]+)"' if engine == "web" else r'(?i)href="(https?://[^"]+)"')

    def kept(hit: tuple[str, str]) -> bool:
        found = link.search(hit[0])
        title = " ".join(_decode(re.sub("(?s)<[^>]*>", "", hit[1]), TITLE_ENTITIES, True).split())
        if not found or not title:
            return False
        url = found[1]
        if engine == "web" and "uddg=" in url:
            url = unquote_plus(re.search("uddg=([^&]*)", url)[1])
        return bool(url) and _plausible(url)

    return kept


def _engine(name: str, url: str, params: Callable[[str, int], list[tuple[str, str]]], most: int, files_only: bool = False, method: str = "GET", headers: tuple[tuple[str, str], ...] = ()) -> Provider:
    """A web engine: pages by number up to ``most``, ended by a page without results."""
    words = lambda k: " ".join(k) + (" filetype:pdf OR filetype:epub" if files_only else "")
    accept = (("User-Agent", BROWSER), ("Accept", "text/html"), *headers)
    return Provider(
        first=lambda k: 0,
        request=lambda k, s, n: Request(url, tuple(params(words(k), s.token)), method, accept),
        hits=_anchors(name),
        kept=_web_kept(name),
        after=lambda s, hits, rest, n: s.token + 1,
        most_pages=most,
    )


def _room(step: Step, limit: int, most: int) -> int:
    """A page's size: what is still wanted, at least one and at most ``most``."""
    return min(most, max(1, limit - step.given))


PROVIDERS: dict[str, Provider] = {
    "arxiv": Provider(
        first=lambda k: 0,
        request=lambda k, s, n: Request("https://export.arxiv.org/api/query", (("search_query", " AND ".join(f"all:{w}" for w in k)), ("start", str(s.token)), ("max_results", str(_room(s, n, 200))))),
        hits=lambda body: (scholarly._arxiv_hits(body), None),
        kept=lambda hit: hit is not None,
        after=lambda s, hits, rest, n: s.token + _room(s, n, 200) if len(hits) >= _room(s, n, 200) else None,
        pause=3.0,
    ),
    "openalex": Provider(
        first=lambda k: "*",
        request=lambda k, s, n: Request("https://api.openalex.org/works", (("search", " ".join(k)), ("per-page", str(_room(s, n, 200))), ("filter", "is_oa:true"), ("select", OPENALEX_FIELDS), ("cursor", s.token))),
        hits=_json("results", rest=("meta", "next_cursor")),
        kept=lambda w: any(_likely_pdf(_get(w, at, "pdf_url")) for at in ("best_oa_location", "primary_location")),
        after=lambda s, hits, rest, n: rest,
    ),
    "semantic_scholar": Provider(
        first=lambda k: 0,
        request=lambda k, s, n: Request("https://api.semanticscholar.org/graph/v1/paper/search", (("query", " ".join(k)), ("limit", str(_room(s, n, 50))), ("offset", str(s.token)), ("fields", SCHOLAR_FIELDS))),
        hits=_json("data", rest=("next",)),
        kept=lambda p: _get(p, "openAccessPdf", "url") is not None,
        after=lambda s, hits, rest, n: rest if len(hits) >= _room(s, n, 50) else None,
    ),
    "europe_pmc": Provider(
        first=lambda k: "*",
        request=lambda k, s, n: Request("https://www.ebi.ac.uk/europepmc/webservices/rest/search", (("query", f"{' '.join(k)} AND (OPEN_ACCESS:Y)"), ("resultType", "core"), ("format", "json"), ("pageSize", str(_room(s, n, 100))), ("cursorMark", s.token))),
        hits=_json("resultList", "result", rest=("nextCursorMark",)),
        kept=_europe_kept,
        after=lambda s, hits, rest, n: rest if rest != s.token else None,
    ),
    "internet_archive": Provider(
        first=lambda k: 1,
        request=lambda k, s, n: Request(
            "https://archive.org/advancedsearch.php",
            (("q", " AND ".join([*k, "mediatype:texts"])), *(("fl[]", f) for f in ARCHIVE_FIELDS), ("rows", str(min(100, max(50, n)))), ("page", str(s.token)), ("output", "json"), ("sort[]", "downloads desc")),
        ),
        hits=_json("response", "docs"),
        kept=_archive_kept,
        after=lambda s, hits, rest, n: s.token + 1 if len(hits) >= min(100, max(50, n)) else None,
        lookup=lambda hit: (_listed(hit["identifier"])[0], Request(f"https://archive.org/metadata/{quote(_listed(hit['identifier'])[0], safe='')}")),
        found=_archive_found,
    ),
    "doaj": Provider(
        first=lambda k: 1,
        request=lambda k, s, n: Request(f"https://doaj.org/api/search/articles/{quote(' AND '.join(k), safe='').replace('-', '%2D').replace('.', '%2E').replace('_', '%5F').replace('~', '%7E')}", (("page", str(s.token)), ("pageSize", str(min(100, max(1, n)))))),
        hits=_json("results"),
        kept=_doaj_kept,
        after=lambda s, hits, rest, n: s.token + 1 if len(hits) >= min(100, max(1, n)) else None,
    ),
    "zenodo": Provider(
        first=lambda k: 1,
        request=lambda k, s, n: Request(
            "https://zenodo.org/api/records",
            (("q", " ".join(k)), ("size", "25"), ("page", str(s.token)), ("sort", "bestmatch"), ("access_status", "open"), ("type", "publication"), ("type", "preprint")),
            headers=(("User-Agent", "citelode (research tool)"), ("Accept", "application/json")),
        ),
        hits=_json("hits", "hits"),
        kept=_zenodo_kept,
        after=lambda s, hits, rest, n: s.token + 1 if len(hits) >= 25 else None,
    ),
    "gutenberg": Provider(
        first=lambda k: "https://gutendex.com/books?" + urlencode({"search": " ".join(k)}),
        request=lambda k, s, n: Request(s.token),
        hits=_json("results", rest=("next",)),
        kept=lambda b: any(_get(b, "formats", f) is not None for f in scholarly.BOOK_FORMATS),
        # the next page is only followed on the provider's own host
        after=lambda s, hits, rest, n: rest if rest and urlsplit(rest).hostname == "gutendex.com" else None,
        ends_when_empty=False,
    ),
    "web": _engine("web", "https://html.duckduckgo.com/html/", lambda q, p: [("q", q), ("kl", "us-en"), ("s", str(30 * p))], 8, True, "POST", (("Referer", "https://html.duckduckgo.com/"),)),
    "brave": _engine("brave", "https://search.brave.com/search", lambda q, p: [("q", q), ("source", "web"), ("offset", str(p))], 6),
    "bing": _engine("bing", "https://www.bing.com/search", lambda q, p: [("q", q), ("first", str(10 * p + 1))], 10, True),
    "mojeek": _engine("mojeek", "https://www.mojeek.com/search", lambda q, p: [("q", q), ("s", str(10 * p + 1))], 8),
    "marginalia": _engine("marginalia", "https://search.marginalia.nu/search", lambda q, p: [("query", q), ("profile", "no-js"), ("js", "default")], 1),
    "startpage": _engine("startpage", "https://www.startpage.com/do/search", lambda q, p: [("query", q), ("cat", "web"), ("pl", "opensearch"), ("page", str(p + 1))], 6, headers=(("Referer", "https://www.startpage.com/"),)),
}


@dataclass(frozen=True)
class Answer:
    """A page's payload with the documents that still count on it, an item's second answer, or an error."""

    page: int
    item: str | None = None
    room: int | None = None
    payload: str | None = None
    error: str | None = None


def pages(provider: Provider, keywords: list[str], limit: int, fetch: Fetch, wait: Callable[[float], None] = time.sleep) -> Iterator[Answer]:
    """A provider's answers, page after page, until it is at its end or ``limit`` documents came.

    An error ends the pages, after what came before it. Pages are asked one after the other,
    items of a page a few at once; nothing is fetched before the page before has been taken.
    """
    step = Step(provider.first(keywords))
    while step.token is not None and step.given < limit and (provider.most_pages is None or step.page < provider.most_pages):
        if step.page and provider.pause:
            wait(provider.pause)
        try:
            body = fetch(provider.request(keywords, step, limit))
            hits, rest = provider.hits(body)
        except (FetchError, ValueError, OSError) as e:
            yield Answer(step.page, error=str(e))
            return
        if not hits and provider.ends_when_empty:
            return
        kept = [h for h in hits if provider.kept(h)]
        given = len(kept)
        if provider.lookup:
            given = 0
            with ThreadPoolExecutor(LOOKUPS) as pool:
                for item, answer in pool.map(lambda h: _looked_up(provider, h, fetch), kept):
                    if answer is not None and step.given + given < limit:
                        given += 1
                        yield Answer(step.page, item=item, payload=answer)
        yield Answer(step.page, room=limit - step.given, payload=body)
        step = Step(provider.after(step, hits, rest, limit), step.page + 1, step.given + given)


def _looked_up(provider: Provider, hit: Any, fetch: Fetch) -> tuple[str, str | None]:
    """A hit's second answer; None where it can't be had or has nothing to offer."""
    item, request = provider.lookup(hit)
    try:
        body = fetch(request)
    except (FetchError, OSError):
        return item, None
    return item, body if provider.found(body) else None


def http_fetch(request: Request, attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> str:
    """The answer over HTTP; busy and failing servers are asked again after a while."""
    query = urlencode(request.params)
    headers = {"User-Agent": BROWSER, **dict(request.headers)}
    for n in range(1, attempts + 1):
        post = request.method == "POST"
        url = request.url if post or not query else f"{request.url}?{query}"
        try:
            with urllib.request.urlopen(urllib.request.Request(url, query.encode() if post else None, headers, method=request.method), timeout=30) as answer:  # noqa: S310
                return answer.read(16 * 1024 * 1024 + 1)[: 16 * 1024 * 1024].decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            if n == attempts or not (e.code == 429 or e.code >= 500):
                raise FetchError(f"HTTP {e.code}") from e
            asked = e.headers.get("Retry-After") or ""
            wait(min(8.0, max(5.0 * n if e.code == 429 else 2.0**n, float(asked) if asked.isdigit() else 0.0)))
        except OSError as e:
            if n == attempts:
                raise FetchError(str(e)) from e
            wait(min(8.0, 2.0**n))
    raise FetchError("no attempt was allowed")


def _named(path: str) -> Fetch:
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def _rows(source: str, sub_query: str, keywords: list[str], limit: int, fetch: Fetch) -> Iterator[tuple]:
    if source not in PROVIDERS:
        yield source, sub_query, 0, None, None, None, f"unknown source: {source}"
        return
    for a in pages(PROVIDERS[source], keywords, limit, fetch):
        yield source, sub_query, a.page, a.item, a.room, a.payload, a.error


class Task(InputPartition):
    """One sub-query at one source."""

    def __init__(self, sub_query: str, source: str):
        self.sub_query, self.source = sub_query, source


class AnswersReader(DataSourceReader):
    """A partition for each task that the query's filters leave."""

    def __init__(self, tasks: list[tuple[str, str]], limit: int, fetch: str):
        self.tasks, self.limit, self.fetch = tasks, limit, fetch

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 (Spark's name)
        """Takes equality and membership on source and sub-query, so that no one asks what isn't wanted."""
        at = {("sub_query",): 0, ("source_id",): 1}
        for f in filters:
            if isinstance(f, (EqualTo, In)) and tuple(f.attribute) in at:
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tasks = [t for t in self.tasks if t[at[tuple(f.attribute)]] in wanted]
            else:
                yield f

    def partitions(self) -> list[Task]:
        return [Task(*t) for t in self.tasks] or [Task("", "")]

    def read(self, partition: Task) -> Iterator[tuple]:
        if partition.source:
            yield from _rows(partition.source, partition.sub_query, partition.sub_query.split(), self.limit, _named(self.fetch))


class ProviderAnswers(DataSource):
    """Format ``provider_answers``: payloads of live providers, ``ANSWERS``.

    Options: ``tasks``, a JSON list of ``[sub_query, source]``; ``limit``, documents of a task;
    ``fetch``, ``module:function``. ``register`` makes it known.
    """

    @classmethod
    def name(cls) -> str:
        return "provider_answers"

    def schema(self) -> str:
        return ANSWERS

    def reader(self, schema) -> AnswersReader:
        tasks = [tuple(t) for t in json.loads(self.options["tasks"])]
        return AnswersReader(tasks, int(self.options.get("limit", "100")), self.options.get("fetch", "citelode.sources.live:http_fetch"))


def ask(tasks: DataFrame, limit: int, fetch: str = "citelode.sources.live:http_fetch") -> DataFrame:
    """Answers for tasks of any number of runs: their columns, which include ``source_id, sub_query, keywords``, and ``ANSWERS``.

    The tasks' partitions are what runs at once: ``repartition`` them first.
    """
    own = [f for f in tasks.schema if f.name not in ("source_id", "sub_query", "keywords")]
    names = ["source_id", "sub_query", "page", "item", "room", "payload", "error"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), ANSWERS])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = _named(fetch)
        for batch in batches:
            for task in batch.to_dict("records"):
                for row in _rows(task["source_id"], task["sub_query"], list(task["keywords"]), limit, get):
                    one = pd.DataFrame([[*(task[f.name] for f in own), *row]], columns=[*(f.name for f in own), *names])
                    yield one.astype({"room": "Int32"})

    return tasks.mapInPandas(run, schema)


def documents(answers: DataFrame, source: str) -> DataFrame:
    """Documents of one provider's answers, in rank order and no more than each task's limit.

    All columns of ``answers`` but the payloads' stay; ``rank_in_source`` counts over a task's pages.
    """
    kept = [c for c in answers.columns if c not in ("payload", "item", "error")]
    own = answers.where((F.col("source_id") == source) & F.col("payload").isNotNull())
    first = own.where("item is null").select(*kept, "payload")
    if source == "internet_archive":
        rows = scholarly.internet_archive(first, own.where("item is not null").select(F.col("item").alias("identifier"), "payload").dropDuplicates(["identifier"]))
    elif source in web.ENGINES:
        rows = web.results(first.withColumnRenamed("payload", "html"), source)
        more = {"authors": F.array().cast("array<string>"), "year": F.lit(None).cast("string"), "abstract": F.lit(None).cast("string"), "identifier": F.lit(None).cast("string")}
        rows = rows.withColumns(more)
    else:
        rows = getattr(scholarly, source)(first)
    task = [c for c in kept if c not in ("page", "room")]
    rows = rows.where(F.col("rank_in_source") <= F.col("room"))
    # documents of earlier pages of the task, a row for each page
    before = F.sum("__n").over(Window.partitionBy(*task).orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    per_page = rows.groupBy(*task, "page").agg(F.max("rank_in_source").alias("__n")).select(*task, "page", F.coalesce(before, F.lit(0)).alias("__before"))
    rows = rows.join(per_page, [*task, "page"])
    return rows.select(*task, "page", (F.col("rank_in_source") + F.col("__before")).cast("int").alias("rank_in_source"), *DOCUMENT_FIELDS)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ProviderAnswers)


def discover(spark: SparkSession, tasks: list[tuple[str, str]], limit: int, fetch: str) -> DataFrame:
    """Documents of all tasks: ``source_id, sub_query, page, rank_in_source`` and the document's fields."""
    register(spark)
    out = None
    for source in sorted({s for _, s in tasks} & set(PROVIDERS)):
        # loaded anew for each: scans of one loaded table share its reader, and so its filters
        read = spark.read.format("provider_answers").option("tasks", json.dumps(tasks)).option("limit", str(limit)).option("fetch", fetch).load()
        one = documents(read.where(F.col("source_id") == source), source)
        out = one if out is None else out.unionByName(one)
    return out
