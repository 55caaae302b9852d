"""Parsers of providers' JSON answers: a column of payloads in, documents out.

Each takes a DataFrame with a payload column and returns its other columns, ``rank_in_source``
(from 1, counting documents given, not raw hits) and the document's fields. Unknown fields are
ignored, missing ones null; a payload that isn't JSON gives no rows.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelode.functions.text import reconstruct_abstract, trimmed
from citelode.functions.urls import is_likely_pdf_url
from citelode.operators.schemas import DOCUMENT, DOCUMENT_FIELDS

# Formats of a book in the order they are taken.
BOOK_FORMATS = ("text/plain; charset=utf-8", "text/plain; charset=us-ascii", "text/plain", "application/epub+zip", "application/pdf")
NAMES = "array<struct<name: string>>"
OPENALEX = (
    "results array<struct<id: string, title: string, publication_year: long, best_oa_location: struct<pdf_url: string>, primary_location: struct<pdf_url: string>, "
    "authorships: array<struct<author: struct<display_name: string>>>, abstract_inverted_index: map<string, array<bigint>>>>"
)
SEMANTIC_SCHOLAR = f"data array<struct<title: string, authors: {NAMES}, year: long, abstract: string, openAccessPdf: struct<url: string>, externalIds: struct<DOI: string>>>"
EUROPE_PMC = (
    "resultList struct<result: array<struct<title: string, authorString: string, pubYear: string, abstractText: string, doi: string, "
    "fullTextUrlList: struct<fullTextUrl: array<struct<documentStyle: string, url: string>>>>>>"
)
DOAJ = f"results array<struct<bibjson: struct<title: string, year: string, abstract: string, author: {NAMES}, link: array<struct<type: string, content_type: string, url: string>>>>>"
ZENODO = f"hits struct<hits: array<struct<metadata: struct<title: string, publication_date: string, description: string, doi: string, creators: {NAMES}>, files: array<struct<key: string, links: map<string, string>>>>>>"
GUTENDEX = f"results array<struct<id: long, title: string, authors: {NAMES}, formats: map<string, string>>>"
ARCHIVE = "response struct<docs: array<struct<identifier: string, title: string, creator: string, year: string, description: string, format: string>>>"
ARCHIVE_FILES = "files array<struct<name: string, format: string>>"


def _names(people: Column, name: Callable[[Column], Column] = lambda p: p["name"]) -> Column:
    return F.coalesce(F.filter(F.transform(people, name), lambda n: n.isNotNull()), F.array().cast("array<string>"))


def _documents(df: DataFrame, payload: str, schema: str, items: str, source: str, fields: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """Items of each payload that have an address, as ranked documents."""
    kept = [c for c in df.columns if c != payload]
    rows = F.transform(F.from_json(payload, schema)[items] if "." not in items else F.from_json(payload, schema)[items.split(".")[0]][items.split(".")[1]], lambda x: _row(fields(x), source))
    good = F.filter(rows, lambda d: d["url"].isNotNull())
    return df.select(*kept, F.posexplode(good).alias("__at", "__d")).select(*kept, (F.col("__at") + 1).alias("rank_in_source"), "__d.*")


def _row(values: dict[str, Column], source: str) -> Column:
    values = {"source": F.lit(source), "year": F.lit(None), "abstract": F.lit(None), "identifier": F.lit(None)} | values
    kinds = dict(f.split(" ", 1) for f in DOCUMENT.split(", "))
    return F.struct(*[values[f].cast(kinds[f]).alias(f) for f in DOCUMENT_FIELDS])


def _title(x: Column) -> Column:
    return F.coalesce(x, F.lit("Untitled"))


def _first(items: Column, good: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(items, good), F.lit(0))


def openalex(df: DataFrame, payload: str = "payload") -> DataFrame:
    """OpenAlex: the first of the two locations that is worth trying; abstracts from their index."""

    def fields(w: Column) -> dict[str, Column]:
        url = _first(F.array(w["best_oa_location"]["pdf_url"], w["primary_location"]["pdf_url"]), lambda u: u.isNotNull() & is_likely_pdf_url(u))
        return {"title": _title(w["title"]), "url": url, "authors": _names(w["authorships"], lambda a: a["author"]["display_name"]), "year": w["publication_year"], "abstract": reconstruct_abstract(w["abstract_inverted_index"]), "identifier": w["id"]}

    return _documents(df, payload, OPENALEX, "results", "openalex", fields)


def semantic_scholar(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Semantic Scholar: papers with an open PDF, known by their DOI."""
    return _documents(
        df, payload, SEMANTIC_SCHOLAR, "data", "semantic_scholar",
        lambda p: {"title": _title(p["title"]), "url": p["openAccessPdf"]["url"], "authors": _names(p["authors"]), "year": p["year"], "abstract": p["abstract"], "identifier": p["externalIds"]["DOI"]},
    )


def europe_pmc(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Europe PMC: a PDF's address, else the first; authors from one string."""

    def fields(h: Column) -> dict[str, Column]:
        urls = h["fullTextUrlList"]["fullTextUrl"]
        url = F.coalesce(_first(urls, lambda u: F.lower(u["documentStyle"]) == "pdf")["url"], _first(urls, lambda u: u["url"].isNotNull())["url"])
        people = F.filter(F.transform(F.split(F.coalesce(h["authorString"], F.lit("")), ","), lambda a: trimmed(F.regexp_replace(trimmed(a), r"\.+$", ""))), lambda a: a != "")
        return {"title": _title(h["title"]), "url": url, "authors": people, "year": h["pubYear"], "abstract": h["abstractText"], "identifier": h["doi"]}

    return _documents(df, payload, EUROPE_PMC, "resultList.result", "europe_pmc", fields)


def doaj(df: DataFrame, payload: str = "payload") -> DataFrame:
    """DOAJ: a full text's PDF link, else any full text; years as text or number."""

    def fields(item: Column) -> dict[str, Column]:
        b = item["bibjson"]
        full = F.filter(b["link"], lambda x: x["type"] == "fulltext")
        link = F.coalesce(_first(full, lambda x: F.lower(x["content_type"]).contains("pdf")), F.get(full, F.lit(0)))
        return {"title": _title(b["title"]), "url": link["url"], "authors": _names(b["author"]), "year": b["year"], "abstract": b["abstract"]}

    return _documents(df, payload, DOAJ, "results", "doaj", fields)


def zenodo(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Zenodo: the first PDF or EPUB of a record, by its links self, download, content."""

    def fields(h: Column) -> dict[str, Column]:
        m, links = h["metadata"], _first(h["files"], lambda f: F.lower(f["key"]).rlike(r"\.(pdf|epub)$"))["links"]
        year = F.regexp_extract(F.coalesce(m["publication_date"], F.lit("")), r"^(\d{4})", 1)
        url = F.coalesce(*[F.try_element_at(links, F.lit(k)) for k in ("self", "download", "content")])
        return {"title": _title(m["title"]), "url": url, "authors": _names(m["creators"]), "year": F.when(year != "", year), "abstract": m["description"], "identifier": m["doi"]}

    return _documents(df, payload, ZENODO, "hits.hits", "zenodo", fields)


def gutenberg(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Gutendex: the first format in the fixed order; no year."""
    return _documents(
        df, payload, GUTENDEX, "results", "gutenberg",
        lambda b: {"title": _title(b["title"]), "url": F.coalesce(*[F.try_element_at(b["formats"], F.lit(k)) for k in BOOK_FORMATS]), "authors": _names(b["authors"]), "identifier": b["id"]},
    )


def coerce_list(x: Column) -> Column:
    """A JSON value read as text, as a list: an array's members, or the value alone."""
    return F.when(x.startswith("["), F.from_json(x, "array<string>")).when(x.isNotNull(), F.array(x)).otherwise(F.array().cast("array<string>"))


def coerce_string(x: Column) -> Column:
    """A JSON value read as text, as one string: the first of an array."""
    return F.when(x.startswith("["), F.get(F.from_json(x, "array<string>"), F.lit(0))).otherwise(x)


def find_file(files: Column, ext: str) -> Column:
    """Name of the first file of a type, by its format, else by its name."""
    by_format = _first(files, lambda f: F.lower(f["format"]).contains(ext))
    return F.coalesce(by_format["name"], F.when(by_format.isNull(), _first(files, lambda f: F.lower(f["name"]).endswith("." + ext))["name"]))


def internet_archive(df: DataFrame, metadata: DataFrame, payload: str = "payload") -> DataFrame:
    """Internet Archive: items with a PDF or EPUB, joined to their files.

    ``metadata`` has ``identifier`` and its own ``payload``; items without a usable file go.
    """
    kept = [c for c in df.columns if c != payload]
    items = df.withColumn("__row", F.monotonically_increasing_id()).select(*kept, "__row", F.posexplode(F.from_json(payload, ARCHIVE)["response"]["docs"]).alias("__at", "i")).withColumn("__id", coerce_string(F.col("i.identifier")))
    formats = F.lower(F.array_join(coerce_list(F.col("i.format")), " "))
    items = items.where(F.col("__id").isNotNull() & (formats.contains("pdf") | formats.contains("epub")))
    files = F.from_json("payload", ARCHIVE_FILES)["files"]
    named = metadata.select(F.col("identifier").alias("__id"), F.coalesce(find_file(files, "pdf"), find_file(files, "epub")).alias("__file")).where("__file is not null")
    escape = lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    row = _row(
        {
            "title": F.coalesce(coerce_string(F.col("i.title")), F.col("__id")),
            "url": F.concat(F.lit("https://archive.org/download/"), escape(F.col("__id")), F.lit("/"), escape(F.col("__file"))),
            "authors": coerce_list(F.col("i.creator")),
            "year": coerce_string(F.col("i.year")),
            "abstract": coerce_string(F.col("i.description")),
            "identifier": F.col("__id"),
        },
        "internet_archive",
    )
    rank = F.row_number().over(Window.partitionBy("__row").orderBy("__at"))
    return items.join(named, "__id").select(*kept, rank.alias("rank_in_source"), row.alias("__d")).select(*kept, "rank_in_source", "__d.*")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _arxiv_hits(xml: str) -> list[dict | None]:
    """The feed's entries as documents, None for one without a link or id."""
    out: list[dict | None] = []
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return out
    for entry in (e for e in root if _local(e.tag) == "entry"):
        text = lambda name: next((" ".join((e.text or "").split()) for e in entry if _local(e.tag) == name), None)  # noqa: B023, E731
        pdf = next((e.get("href") for e in entry if _local(e.tag) == "link" and (e.get("title") == "pdf" or e.get("type") == "application/pdf")), None)
        ident, published = text("id"), text("published")
        url = pdf or (f"https://arxiv.org/pdf/{ident.rsplit('/', 1)[-1]}.pdf" if ident else None)
        if url:
            people = [" ".join((n.text or "").split()) for a in entry if _local(a.tag) == "author" for n in a if _local(n.tag) == "name"]
            out.append({"title": text("title") or "", "url": url, "source": "arxiv", "authors": people, "year": (published or "")[:4] or None, "abstract": text("summary") or None, "identifier": ident})
        else:
            out.append(None)
    return out


def _arxiv_entries(xml: str) -> list[dict]:
    return [d for d in _arxiv_hits(xml) if d]


def arxiv(df: DataFrame, payload: str = "payload") -> DataFrame:
    """arXiv's Atom feed: the PDF link, or the one that the id implies."""
    kept = [c for c in df.columns if c != payload]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != payload), "rank_in_source int", DOCUMENT])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{**{c: getattr(r, c) for c in kept}, "rank_in_source": i, **d} for r in pdf.itertuples() for i, d in enumerate(_arxiv_entries(getattr(r, payload) or ""), 1)]
            yield pd.DataFrame(rows, columns=[*kept, "rank_in_source", *DOCUMENT_FIELDS])

    return df.mapInPandas(read, schema)
