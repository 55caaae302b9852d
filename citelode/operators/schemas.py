"""Row types of the engine. Every table carries ``run_id``, so many runs are processed at once."""

from __future__ import annotations

DOCUMENT = "title string, url string, source string, authors array<string>, year string, abstract string, identifier string"
SOURCE_RANKS = "array<struct<source: string, rank: int>>"
DISCOVERY = f"run_id long, arrival_seq long, source_id string, rank_in_source int, {DOCUMENT}"
MERGED = f"run_id long, insert_idx int, {DOCUMENT}, source_ranks {SOURCE_RANKS}"
RUNS = "id long, query string, folder_path string, created_at timestamp"
LIBRARY_DOCUMENTS = (
    "id long, run_id long, title string, url string, source string, authors string, year string, abstract string, "
    "local_path string, text_path string, extract_error string, size_bytes long"
)
DOCUMENT_FIELDS = tuple(f.split(" ")[0] for f in DOCUMENT.split(", "))
MANIFEST = "query string, documents array<struct<" + ", ".join(f.replace(" ", ": ", 1) for f in DOCUMENT.split(", ")) + ", local_path: string, text_path: string, extract_error: string>>"
_VARIANTS = {
    "RunStarted": "query: string, sources: array<string>",
    "SourceHit": "source: string, count: long",
    "SourceError": "source: string, error: string",
    "Found": "url: string, title: string, source: string",
    "DownloadDone": "url: string, title: string, source: string, size_bytes: long, local_path: string",
    "DownloadFailed": "url: string, title: string, source: string, error: string",
    "ExtractDone": "url: string, text_path: string",
    "RunComplete": "total: long, done: long, failed: long",
}
RUN_LOG = "ts string, event struct<" + ", ".join(f"{k}: struct<{v}>" for k, v in _VARIANTS.items()) + ">"
