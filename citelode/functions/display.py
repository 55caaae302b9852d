"""Columns that put figures, errors and sources into words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citelode.functions.urls import any_of

# Names of sources, and sources that the aggregator covers.
SOURCE_LABELS = {
    "arxiv": "arXiv", "openalex": "OpenAlex", "semantic_scholar": "Semantic Scholar", "europe_pmc": "Europe PMC", "internet_archive": "Internet Archive",
    "doaj": "DOAJ", "zenodo": "Zenodo", "gutenberg": "Gutenberg", "meta_search": "Meta Search", "searxng": "SearXNG", "web": "DuckDuckGo", "brave": "Brave",
    "bing": "Bing", "mojeek": "Mojeek", "marginalia": "Marginalia", "startpage": "Startpage",
}
SOURCES = tuple(SOURCE_LABELS)
COVERED = ("web", "brave", "bing", "mojeek", "marginalia", "startpage", "searxng")
# Short tags of the kinds of problems.
KIND_TAGS = {"rate_limit": "rate limited", "forbidden": "blocked", "server_error": "server error", "timeout": "timed out", "parse_error": "unreadable"}


def classify_source_error(msg: Column) -> Column:
    """Kind of a source's error by its message, the first that fits."""
    low = F.lower(F.coalesce(msg, F.lit("")))
    return (
        F.when(any_of(low, ("429", "rate limit", "too many requests")), "rate_limit")
        .when(any_of(low, ("403", "401", "forbidden", "unauthorized", "blocked")), "forbidden")
        .when(any_of(low, ("500", "502", "503", "504", "server error")), "server_error")
        .when(any_of(low, ("timeout", "timed out", "operation took")), "timeout")
        .when(any_of(low, ("parse", "regex", "decode", "non-json", "missing")), "parse_error")
        .otherwise("other")
    )


# What is said of a failed download, by its kind, and of a source's problem.
DOWNLOAD_MESSAGES = {
    "none": "The download didn't complete.",
    "rejected": "The download link was rejected by the server — it may have expired or need a login. Skipped.",
    "blocked": "This source blocked the download — it may require a subscription or sign-in.",
    "gone": "The document is no longer available at this link.",
    "busy": "The source was busy and rate-limited us — we backed off and retried.",
    "server": "The source's server had a temporary problem.",
    "page": "This link opened a web page, not a downloadable file — skipped.",
    "large": "The file was larger than the download size limit.",
    "small": "The server returned an empty or tiny response — likely an error page.",
    "damaged": "The downloaded file was corrupted or wasn't really a document.",
    "no_text": "Downloaded, but no readable text could be pulled out (it may be a scanned image).",
    "timeout": "The download timed out.",
    "network": "Couldn't reach the server — check your internet connection.",
    "cancelled": "Cancelled.",
}
SOURCE_MESSAGES = {
    "rate_limit": "%s is rate-limiting us right now — we'll back off and keep going.",
    "forbidden": "%s blocked the request (it may need a sign-in or be region-locked).",
    "server_error": "%s had a temporary server error.",
    "timeout": "%s took too long to respond.",
    "parse_error": "Couldn't read %s's response.",
    "other": "%s reported a problem.",
}
# Status codes and words by which a failed download's kind is told, first fit first.
STATUS_KINDS = {"400": "rejected", "401": "blocked", "403": "blocked", "404": "gone", "410": "gone", "429": "busy"}
WORD_KINDS = (
    ("page", ("landing page", "text/html", "not a document")),
    ("large", ("too large",)),
    ("small", ("too small", "empty response")),
    ("damaged", ("valid pdf", "valid epub", "signature")),
    ("no_text", ("no readable text", "text is empty")),
    ("timeout", ("timed out", "timeout")),
    ("network", ("network", "dns", "connect", "reach")),
    ("cancelled", ("cancel",)),
)


def download_error_kind(raw: Column) -> Column:
    """Kind of a failed download by its message: by status code, else by words; null for unknown ones and for being offline."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    code = F.regexp_extract(low, r"\bhttp\s*(\d{3})\b", 1)
    by_code = F.try_element_at(F.create_map(*[F.lit(x) for pair in STATUS_KINDS.items() for x in pair]), code)
    by_words = F.coalesce(*[F.when(any_of(low, words), kind) for kind, words in WORD_KINDS])
    return F.when(low == "", "none").when(~low.contains("offline"), F.coalesce(by_code, F.when(code.startswith("5"), "server"), by_words))


def humanize_download_error(raw: Column) -> Column:
    """A download error in plain words; unknown ones and those about being offline stay as they are."""
    said = F.create_map(*[F.lit(x) for pair in DOWNLOAD_MESSAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(said, download_error_kind(raw)), raw)


def source_label(source: Column) -> Column:
    """Name of a source, engines of the aggregator by their own."""
    names = F.create_map(*[F.lit(x) for pair in SOURCE_LABELS.items() for x in pair])
    key = F.regexp_replace(source, "^meta_search/", "")
    return F.coalesce(F.try_element_at(names, key), F.try_element_at(names, source), source)


def humanize_source_kind(kind: Column, source: Column) -> Column:
    """A source's problem in plain words."""
    name = F.when(F.coalesce(source, F.lit("")) == "", "This source").otherwise(source_label(source))
    said = F.create_map(*[F.lit(x) for pair in SOURCE_MESSAGES.items() for x in pair])
    return F.replace(F.coalesce(F.try_element_at(said, kind), F.lit(SOURCE_MESSAGES["other"])), F.lit("%s"), name)


def issue_kind_tag(kind: Column) -> Column:
    """Short tag of an error kind."""
    out = F.when(F.lit(False), F.lit(""))
    for k, tag in KIND_TAGS.items():
        out = out.when(kind == k, F.lit(tag))
    return out.otherwise("issue")


def base_source_id(source: Column, run_sources: Column) -> Column:
    """The enabled source that a row's source belongs to."""
    pool = F.when(F.array_contains(run_sources, "meta_search"), "meta_search").otherwise("searxng")
    return F.when(source.startswith("meta_search/"), "meta_search").when(source.isin("searxng_local", "searxng_pool"), pool).otherwise(source)


def lane_key(source: Column, run_sources: Column) -> Column:
    """The lane that a row counts in: covered engines in the aggregator's."""
    pool = F.when(F.array_contains(run_sources, "meta_search"), "meta_search").otherwise("searxng")
    return F.when(source.isin("searxng_local", "searxng_pool"), pool).when(source.startswith("meta_search") | source.isin(*COVERED), "meta_search").otherwise(source)


def format_bytes(n: Column) -> Column:
    """Bytes with a unit; a dash for none."""
    n = n.cast("double")
    power = F.when(n >= 1024.0**3, 3).when(n >= 1024.0**2, 2).when(n >= 1024.0, 1).otherwise(0)
    v = n / F.pow(F.lit(1024.0), power)
    unit = F.get(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB")]), power)
    text = F.when((v >= 100) | (power == 0), F.format_string("%.0f %s", v, unit)).otherwise(F.format_string("%.1f %s", v, unit))
    return F.when(n.isNull() | (n == 0) | F.isnan(n) | (F.abs(n) == float("inf")), "—").otherwise(text)


def format_duration(ms: Column) -> Column:
    """Milliseconds as ms, seconds, or minutes and seconds."""
    s = ms / 1000
    return F.when(ms < 1000, F.format_string("%dms", F.floor(ms + 0.5))).when(s < 60, F.format_string("%.1fs", s)).otherwise(F.format_string("%dm %ds", F.floor(s / 60), F.floor(s % 60)))


def format_relative_time(secs: Column, now_ms: Column) -> Column:
    """Age of a moment: minutes, hours or days, the date beyond a week."""
    minutes = (now_ms - secs * 1000) / 60000
    return (
        F.when(minutes < 1, "just now")
        .when(minutes < 60, F.format_string("%dm ago", F.floor(minutes)))
        .when(minutes < 1440, F.format_string("%dh ago", F.floor(minutes / 60)))
        .when(minutes < 10080, F.format_string("%dd ago", F.floor(minutes / 1440)))
        .otherwise(F.date_format(F.timestamp_seconds(secs), "MMM d, yyyy"))
    )


def library_timestamp(name: Column) -> Column:
    """Unix seconds in a library folder's name; null without the suffix."""
    return F.when(name.rlike(r"-\d+-\d+$"), F.regexp_extract(name, r"-(\d+)-\d+$", 1).cast("long"))


def ftype_from_path(path: Column) -> Column:
    """pdf, epub, html or txt by a path's or address's extension; null otherwise."""
    ext = F.regexp_extract(F.lower(F.coalesce(path, F.lit(""))), r"\.(pdf|epub|html?|txt)(?:[?#].*)?$", 1)
    return F.when(ext.startswith("htm"), "html").when(ext != "", ext)
