"""Downloads as a plan: answers are fetched once, landing pages followed once, failures retried at an open address.

The network is a parameter, ``module:function`` from an address to ``(status, content_type,
bytes)``; timeouts and broken connections are errors that it raises. Each round of requests is
written to the shared folder as it comes, since no answer is sure to come twice; what follows
reads it from there. Checks are those of the sink, ``document_sink``, which stores the files.
"""

from __future__ import annotations

import importlib
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelode.functions import content
from citelode.functions.urls import canonicalize_doc_url, extract_doi, has_safe_shape
from citelode.operators.library import open_access_fallback
from citelode.operators.staging import forget, written
from citelode.sources.document_sink import checked, save_documents

#: Requests of a task under way at once, and bytes of answers that it holds before it hands them on.
AT_ONCE, HELD = 8, 64 * 1024 * 1024
UNSAFE = "Blocked for safety: this address may not be asked."
ANSWER = "status int, content_type string, content binary, transport string"

Fetch = Callable[[str], tuple[int, str, bytes]]


def http_download(url: str) -> tuple[int, str, bytes]:
    """One request over HTTP, its body read up to one byte beyond what may be stored."""
    request = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0 (compatible; citelode)", "Accept": "*/*"})
    try:
        with urllib.request.urlopen(request, timeout=60) as answer:  # noqa: S310 (addresses are checked before)
            return answer.status, answer.headers.get("Content-Type") or "", answer.read(content.MAX_BYTES + 1)
    except urllib.error.HTTPError as e:
        return e.code, e.headers.get("Content-Type") or "", b""


def _named(path: str) -> Fetch:
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def fetched(rows: DataFrame, url: str, fetch: str) -> DataFrame:
    """``rows`` with ``ANSWER``, what each one's ``url`` answered; a null address isn't asked.

    ``transport`` is timeout, connect or another word where no answer came.
    """

    def one(get: Fetch, address: str | None) -> tuple[int | None, str | None, bytes | None, str | None]:
        if address is None:
            return None, None, None, "unsafe"
        try:
            return *get(address), None
        except TimeoutError:
            return None, None, None, "timeout"
        except ConnectionError:
            return None, None, None, "connect"
        except OSError:
            return None, None, None, "other"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _named(fetch)
        kinds = (pa.int32(), pa.string(), pa.binary(), pa.string())
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for batch in batches:
                begun, out, size = 0, [], 0
                addresses = batch.column(url).to_pylist()
                for at in range(0, len(addresses), AT_ONCE):
                    for answer in pool.map(lambda a: one(get, a), addresses[at : at + AT_ONCE]):
                        out.append(answer)
                        size += len(answer[2] or b"")
                    if size >= HELD or at + AT_ONCE >= len(addresses):
                        part = batch.slice(begun, len(out))
                        new = [pa.array([a[i] for a in out], k) for i, k in enumerate(kinds)]
                        yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, "status", "content_type", "content", "transport"])
                        begun, out, size = begun + len(out), [], 0

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), ANSWER])
    return rows.mapInArrow(run, schema)


def _attempt(rows: DataFrame, fetch: str) -> DataFrame:
    """Answers for ``url, title, identifier, target``: landing pages are followed to the document they name, once.

    Adds ``content_type, content`` and ``problem``, why there is nothing to check.
    """
    safe = F.when(has_safe_shape(F.col("target")), F.col("target"))
    first = written(fetched(rows.withColumn("__ask", safe), "__ask", fetch), "downloads")
    page = content.reject_content_type(F.col("target"), F.col("content_type")).isNotNull()
    is_file = content.sniff_doc_ext(F.substring("content", 1, content.HEAD)).isNotNull()
    # a document under a wrong content type is taken as what it is
    first = first.withColumn("content_type", F.when(page & is_file, F.lit(None)).otherwise(F.col("content_type"))).withColumn("__page", F.coalesce((F.col("status") < 400) & page & ~is_file, F.lit(False)))
    named = content.pdf_link(first.where("__page").withColumn("__html", F.col("content").cast("string")), "__html", "target", "__link").drop("__html")
    follow = named.where("__link is not null and __link <> target")
    again = follow.select("url", "title", "identifier", F.col("__link").alias("target")).withColumn("__ask", F.when(has_safe_shape(F.col("target")), F.col("target")))
    second = fetched(again, "__ask", fetch)
    stay = first.join(follow.select("url").distinct(), "url", "left_anti")
    columns = ["url", "title", "identifier", "target", "status", "content_type", "content", "transport"]
    both = stay.select(*columns).unionByName(second.select(*columns))
    problem = F.when(F.col("transport") == "unsafe", UNSAFE).when(F.col("transport").isNotNull(), content.network_error_message(F.col("transport")))
    problem = F.coalesce(problem, F.when(F.col("status") >= 400, F.concat(content.http_status_message(F.col("status")), F.format_string(" (HTTP %d)", "status"))))
    return both.withColumn("problem", problem).drop("status", "transport")


def download(documents: DataFrame, fetch: str = "citelode.sources.download:http_download", folder: str | None = None, locations: DataFrame | None = None) -> DataFrame:
    """Stores documents (``url, title, identifier``) as files: ``url, path, size_bytes, error`` of each address.

    What fails and has a DOI is tried once more at its open-access address in ``locations``
    (``doi, url_for_pdf``), if that is another one. Addresses that repeat are asked once; null
    addresses are left out.
    """
    docs = documents.where("url is not null").groupBy("url").agg(F.min(F.struct(F.coalesce("title", F.lit("")).alias("title"), "identifier")).alias("d")).select("url", "d.*")
    got = written(_attempt(docs.withColumn("target", canonicalize_doc_url(F.col("url"))), fetch), "downloads")
    if locations is None:
        return save_documents(got, folder)
    failed = checked(got).where("error is not null").select("url", "title", "identifier", extract_doi(F.col("identifier")).alias("doi"))
    retry = open_access_fallback(failed, locations).where("retry_url is not null").select("url", "title", "identifier", canonicalize_doc_url(F.col("retry_url")).alias("target"))
    more = written(_attempt(retry, fetch), "downloads")
    better = written(checked(more).where("error is null").select(*got.columns), "downloads")
    stay = got.join(better.select("url"), "url", "left_anti")
    out = save_documents(stay.unionByName(better), folder)
    forget(more)
    return out
