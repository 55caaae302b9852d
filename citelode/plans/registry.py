"""Registered queries over the test tables, each with the SQL that gives the same rows in DuckDB.

The tables have no documents of the engine's own kind, so each query first derives what its
operator needs: titles are first lines, sources and hosts follow from ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citelode.functions import content, display, query, text, urls
from citelode.operators import dedup, discovery, events, library, matching, rank, rerank
from citelode.plans import candidates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    """Adds a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def six(x: Column | str) -> Column:
    return F.round(x, 6)


def _micros(column: str) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


#: Title, abstract, key and rank of a document, derived alike on both sides.
_DOCS_SQL = """docs AS (SELECT doc_id, source, md5(text) AS item, string_split(text, chr(10))[1] AS title, text FROM documents)"""
_TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^\\pL\\pN]+'), lambda t: length(t) >= 2)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", F.md5("text").alias("item"), F.substring_index("text", "\n", 1).alias("title"), "text")


# --- tokens, frequencies, ranking ---------------------------------------------------------------


@register(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY term")
def q_tokenize_df(spark, sf_dir):
    """Document frequency of every token of the texts."""
    return rank.document_frequency(table(spark, sf_dir, "documents"), [], text.tokenize(F.col("text")))


@register(f"""WITH f AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY term)
SELECT term, df, round(ln(((SELECT count(*) FROM documents) + 1.0) / (df + 1.0)) + 1.0, 6) AS idf FROM f""")
def q_idf(spark, sf_dir):
    """Smoothed inverse document frequency of every token."""
    docs = table(spark, sf_dir, "documents")
    freq = rank.document_frequency(docs, [], text.tokenize(F.col("text")))
    return freq.select("term", "df", six(rank.idf(F.lit(docs.count()), F.col("df"))).alias("idf"))


_KEYWORDS = ("the", "and", "the", "nicht", "que", "tion")
_RANK_SQL = f"""
{_DOCS_SQL},
q AS (SELECT term, count(*) AS q FROM (VALUES {", ".join(f"('{k}')" for k in _KEYWORDS)}) t(term) GROUP BY term),
tok AS (SELECT doc_id, source, unnest({_TOKENS.format('title')}) AS term, 3 AS w FROM docs UNION ALL SELECT doc_id, source, unnest({_TOKENS.format('text')}), 1 FROM docs),
tf AS (SELECT doc_id, source, term, sum(w) AS tf, any_value(q.q) AS q FROM tok JOIN q USING (term) GROUP BY doc_id, source, term),
df AS (SELECT source, term, count(*) AS df FROM tf GROUP BY source, term), n AS (SELECT source, count(*) AS n FROM docs GROUP BY source),
sc AS (SELECT doc_id, sum(tf * q * (ln((n + 1.0) / (df + 1.0)) + 1.0)) AS tfidf FROM tf JOIN df USING (source, term) JOIN n USING (source) GROUP BY doc_id),
ranked AS (SELECT d.doc_id, d.source, coalesce(tfidf, 0.0) AS tfidf, 1.0 / (60.0 + row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id)) AS rrf
  FROM docs d LEFT JOIN sc USING (doc_id)),
flagged AS (SELECT *, (tfidf + 0.001) * (rrf + 0.001) AS score, greatest(0.05, 0.02 * max(tfidf) OVER (PARTITION BY source)) AS cut, max(tfidf) OVER (PARTITION BY source) AS top FROM ranked)"""


def _run_of(source: str) -> Column:
    """The number in a source's name."""
    return F.substring(source, 4, 10).cast("long")


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents ranked for fixed keywords, each source a run of its own that lists them by id."""
    d = _docs(spark, sf_dir)
    number = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    merged = d.select(
        _run_of("source").alias("run_id"), F.col("doc_id").alias("insert_idx"), "title", F.col("text").alias("abstract"), F.lit("").alias("url"), F.array(F.struct(F.col("source"), number.alias("rank"))).alias("source_ranks")
    )
    words = merged.select("run_id").distinct().select("run_id", F.explode(F.array(*[F.lit(k) for k in _KEYWORDS])).alias("keyword"))
    return rank.rank_candidates(merged, words)


@register(f"WITH {_RANK_SQL} SELECT doc_id, round(tfidf, 6) AS tfidf, round(rrf, 9) AS rrf, row_number() OVER (PARTITION BY source ORDER BY score DESC, rrf DESC, doc_id) AS pos FROM flagged")
def q_tfidf_rank(spark, sf_dir):
    """Title-boosted TF-IDF, fusion and place of every document."""
    return _ranked(spark, sf_dir).select(F.col("insert_idx").alias("doc_id"), six("tfidf").alias("tfidf"), F.round("rrf", 9).alias("rrf"), F.col("pos").cast("long").alias("pos"))


@register(f"""WITH {_RANK_SQL} SELECT doc_id, round(tfidf, 6) AS tfidf,
CASE WHEN top > 0 AND tfidf < cut THEN 'TF-IDF ' || printf('%.2f', tfidf) || ' below cutoff ' || printf('%.2f', cut) END AS reject_reason FROM flagged""")
def q_flag_rejects(spark, sf_dir):
    """Documents below the run's relative cutoff, with the reason."""
    return rank.flag_rejects(_ranked(spark, sf_dir)).select(F.col("insert_idx").alias("doc_id"), six("tfidf").alias("tfidf"), "reject_reason")


@register(f"""WITH {_RANK_SQL}, s AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY score DESC, rrf DESC, doc_id) AS pos, NOT (top > 0 AND tfidf < cut) AS kept FROM flagged)
SELECT doc_id, CASE WHEN kept THEN 'kept' ELSE 'rejected' END AS status, CASE WHEN kept THEN CAST(sum(CAST(kept AS INT)) OVER (PARTITION BY source ORDER BY pos) AS INT) END AS final_rank FROM s""")
def q_final_rank(spark, sf_dir):
    """Place of every document among those kept."""
    return rank.final_rank(rank.flag_rejects(_ranked(spark, sf_dir))).select(F.col("insert_idx").alias("doc_id"), "status", "final_rank")


@register(f"""WITH {_RANK_SQL} SELECT CAST(substr(source, 4) AS BIGINT) AS run_id, count(*) AS total, count(*) FILTER (NOT (top > 0 AND tfidf < cut)) AS kept, count(*) FILTER (top > 0 AND tfidf < cut) AS rejected FROM flagged GROUP BY source""")
def q_keep_totals(spark, sf_dir):
    """Documents kept and rejected in each run."""
    return rank.totals(rank.flag_rejects(_ranked(spark, sf_dir)))


@register(f"""WITH {_DOCS_SQL}, r AS (SELECT item, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rk FROM docs)
SELECT item, count(*) AS n, round(sum(1.0 / (60 + rk)), 9) AS rrf FROM r GROUP BY item""")
def q_rrf_fusion(spark, sf_dir):
    """Reciprocal rank fusion of equal texts over the sources that list them."""
    d = _docs(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    grouped = d.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("rank", "source"))).alias("source_ranks"))
    return grouped.select("item", F.size("source_ranks").cast("long").alias("n"), F.round(rank.rrf(F.col("source_ranks")), 9).alias("rrf"))


_HOSTS = ("www.nature.com", "cs.mit.edu", "nih.gov", "dl.acm.org", "example.com", "export.arxiv.org", "notnature.com", "archive.org")
_HOST_SQL = f"list_value({', '.join(repr(h) for h in _HOSTS)})[CAST(page_id % 8 AS INT) + 1]"
_AUTHORITY_SQL = (
    "CASE "
    + " ".join(f"WHEN h LIKE '%{t}' THEN {b}" for t, b in urls.TLD_AUTHORITY)
    + " "
    + " ".join(f"WHEN h = '{s}' OR h LIKE '%.{s}' THEN {b}" for s, b in urls.PUBLISHERS)
    + " ELSE 1.0 END"
)


def _hosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with one of eight hosts, by id, in their address."""
    p = table(spark, sf_dir, "pages")
    name = F.element_at(F.array(*[F.lit(h) for h in _HOSTS]), (F.col("page_id") % 8 + 1).cast("int"))
    return p.withColumn("url", F.concat(F.lit("https://"), name, F.lit("/p/"), F.col("page_id").cast("string")))


@register(f"WITH p AS (SELECT page_id, {_HOST_SQL} AS h FROM pages) SELECT page_id, h AS host, CAST({_AUTHORITY_SQL} AS DOUBLE) AS authority FROM p")
def q_authority(spark, sf_dir):
    """Boost of every page's host."""
    return _hosted(spark, sf_dir).select("page_id", urls.host(F.col("url")).alias("host"), urls.authority_multiplier(F.col("url")).alias("authority"))


_TITLE_SQL = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"


@register(f"""WITH p AS (SELECT page_id, {_HOST_SQL} AS h, {_TITLE_SQL} AS title FROM pages),
s AS (SELECT page_id, len({_TOKENS.format('title')}) * 1.0 AS t, 1.0 / (60 + page_id % 50 + 1) AS r, {_AUTHORITY_SQL} AS a FROM p),
c AS (SELECT *, (t + 0.001) * (r + 0.001) * a AS score FROM s)
SELECT page_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, r DESC, a DESC, page_id) AS pos FROM c QUALIFY pos <= 100""")
def q_combined_score_topk(spark, sf_dir):
    """The hundred best pages by the combined score (a top-k report)."""
    p = _hosted(spark, sf_dir).withColumn("title", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    p = p.withColumn("tfidf", F.size(text.tokenize(F.col("title"))) * 1.0).withColumn("rrf", 1.0 / (60 + F.col("page_id") % 50 + 1)).withColumn("authority", urls.authority_multiplier(F.col("url")))
    p = p.withColumn("score", rank.combined(F.col("tfidf"), F.col("rrf"), F.col("authority")))
    return p.orderBy(F.desc("score"), F.desc("rrf"), F.desc("authority"), "page_id").limit(100).withColumn(
        "pos", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("rrf"), F.desc("authority"), "page_id")).cast("long")
    ).select("page_id", six("score").alias("score"), "pos")


# --- query text ---------------------------------------------------------------------------------

_STOP_SQL = ", ".join(f"'{w}'" for w in query.STOPWORDS)
_PARSE_SQL = "list_filter(regexp_extract_all(lower({0}), '[\\pL\\pN][\\pL\\pN\\pM''-]+'), lambda w: w NOT IN (" + _STOP_SQL + "))"


@register(f"SELECT item_id, {_PARSE_SQL.format('text')} AS keywords FROM benchmark")
def q_parse_query(spark, sf_dir):
    """Keywords of every benchmark text, read as a query."""
    return table(spark, sf_dir, "benchmark").select("item_id", query.parse_query(F.col("text")).alias("keywords"))


_SPLIT_SQL = "list_filter(list_transform(regexp_split_to_array({0}, '(?i)[,;]|\\s+and\\s+|\\s+&\\s+'), lambda s: trim(s, ' .')), lambda s: s <> '')"


@register(f"SELECT item_id, {_SPLIT_SQL.format('text')} AS topics FROM benchmark")
def q_expand_query(spark, sf_dir):
    """Topics of every benchmark text, read as a query."""
    return table(spark, sf_dir, "benchmark").select("item_id", query.expand_query(F.col("text")).alias("topics"))


@register(f"""WITH b AS (SELECT item_id, array_to_string(list_slice(regexp_extract_all(text, '[A-Za-z]+'), 1, 5), ' ') || ', ' || array_to_string(list_slice(regexp_extract_all(text, '[A-Za-z]+'), 6, 8), ' ') AS q FROM benchmark),
p AS (SELECT item_id, unnest({_SPLIT_SQL.format('q')}) AS part, generate_subscripts({_SPLIT_SQL.format('q')}, 1) AS topic FROM b),
k0 AS (SELECT *, {_PARSE_SQL.format('part')} AS k1 FROM p), k AS (SELECT item_id, topic, part, CASE WHEN len(k1) > 0 THEN k1 ELSE regexp_split_to_array(part, '\\s+') END AS kws FROM k0),
d AS (SELECT item_id, 1 AS pass, topic, kws, unnest(generate_series(1, len(kws))) AS dr FROM k WHERE len(kws) >= 3),
e AS (SELECT item_id, 0 AS pass, topic, 0 AS dr, part AS sub_query, kws FROM k WHERE topic <= 16
  UNION ALL SELECT item_id, pass, topic, dr, array_to_string(list_filter(kws, lambda x, i: i <> dr), ' '), list_filter(kws, lambda x, i: i <> dr) FROM d),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY item_id, array_to_string(list_sort(list_transform(kws, lambda x: lower(x))), ' ') ORDER BY pass, topic, dr) = 1),
g AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pass, topic, dr) - 1 AS sub_idx, greatest(8, count(*) FILTER (pass = 0) OVER (PARTITION BY item_id)) AS cap FROM f)
SELECT item_id, CAST(sub_idx AS INT) AS sub_idx, sub_query FROM g WHERE sub_idx < cap""")
def q_expand_broad(spark, sf_dir):
    """Sub-queries of queries made of a benchmark text's first words."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.array_join(F.slice(words, 1, 5), " "), F.lit(", "), F.array_join(F.slice(words, 6, 3), " ")).alias("q"))
    return query.expand_query_broad(b, "item_id", "q").select("item_id", "sub_idx", "sub_query")


@register("SELECT doc_id, regexp_matches(string_split(text, chr(10))[1], '[\\pL\\pN]{2,}') AS ok, length(string_split(text, chr(10))[1]) AS n FROM documents")
def q_has_token(spark, sf_dir):
    """Whether a document's first line could be searched for."""
    return _docs(spark, sf_dir).select("doc_id", text.has_searchable_token(F.col("title")).alias("ok"), F.length("title").cast("long").alias("n"))


_REPLY_SQL = "regexp_replace(regexp_replace(trim(regexp_replace(trim(line), '^[0-9.)*•-]+', '')), '^\"+|\"+$', '', 'g'), '^''+|''+$', '', 'g')"


@register(f"""WITH c AS (SELECT conv_id * 1000 + turn AS reply, conv_id, string_split('1. ' || text || chr(10) || '- ' || role || ' search' || chr(10) || chr(10) || 'Topic: next' || chr(10) || text, chr(10)) AS ls FROM conversations),
l AS (SELECT reply, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM c),
o AS (SELECT *, max(CAST(starts_with(lower(trim(line)), 'topic:') AS INT)) OVER (PARTITION BY reply ORDER BY pos) AS over_ FROM l),
s AS (SELECT reply, pos, trim({_REPLY_SQL}) AS sub_query FROM o WHERE over_ = 0 AND trim(line) <> '' AND NOT starts_with(lower(trim(line)), 'queries:')),
u AS (SELECT * FROM s WHERE strlen(sub_query) BETWEEN 3 AND 200 AND lower(sub_query) <> 'user search' QUALIFY row_number() OVER (PARTITION BY reply, lower(sub_query) ORDER BY pos) = 1)
SELECT reply, CAST(row_number() OVER (PARTITION BY reply ORDER BY pos) - 1 AS INT) AS idx, sub_query FROM u QUALIFY idx < 48""")
def q_expansion_parse(spark, sf_dir):
    """Sub-queries in replies made of conversation turns."""
    c = table(spark, sf_dir, "conversations")
    raw = F.concat(F.lit("1. "), "text", F.lit("\n- "), "role", F.lit(" search\n\nTopic: next\n"), "text")
    c = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("reply"), raw.alias("raw"), F.lit("User search").alias("asked"))
    return query.parse_expansion(c, "reply", "raw", "asked")


@register("""WITH b AS (SELECT item_id, text, list_slice(regexp_extract_all(text, '[A-Za-z]+'), 1, 4) AS w FROM benchmark),
r AS (SELECT item_id, array_to_string(w, ' ') AS asked, CASE item_id % 4 WHEN 0 THEN array_to_string(w, ' ') WHEN 1 THEN '"' || array_to_string(w, '  ') || '"' WHEN 2 THEN 'Sorry, ' || w[1] ELSE w[2] || ' ' || w[1] || 'x' END AS line FROM b),
t AS (SELECT item_id, asked, trim(line, '"') AS line FROM r)
SELECT item_id, CASE WHEN strlen(line) <= strlen(asked) + 24 AND lower(line) <> lower(asked) AND NOT regexp_matches(lower(line), 'query|corrected|sorry|cannot|i ') THEN line END AS fixed FROM t""")
def q_spellfix(spark, sf_dir):
    """Corrections accepted from made-up replies."""
    w = F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), 1, 4)
    k = F.col("item_id") % 4
    reply = F.when(k == 0, F.array_join(w, " ")).when(k == 1, F.concat(F.lit('"'), F.array_join(w, "  "), F.lit('"'))).when(k == 2, F.concat(F.lit("Sorry, "), F.get(w, F.lit(0)))).otherwise(F.concat(F.get(w, F.lit(1)), F.lit(" "), F.get(w, F.lit(0)), F.lit("x")))
    return table(spark, sf_dir, "benchmark").select("item_id", query.parse_spellfix(reply, F.array_join(w, " ")).alias("fixed"))


# --- titles, DOIs, addresses, deduplication -----------------------------------------------------

_NORM_SQL = "substr(trim(regexp_replace(regexp_replace(lower({0}), '[^\\pL\\pM\\pN_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 200)"


@register(f"SELECT page_id, {_NORM_SQL.format(_TITLE_SQL)} AS norm FROM pages")
def q_normalize_title(spark, sf_dir):
    """Normalised title of every page."""
    return table(spark, sf_dir, "pages").select("page_id", text.normalize_title(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("norm"))


@register(f"WITH {_DOCS_SQL} SELECT doc_id, {_NORM_SQL.format('title')} AS norm FROM docs QUALIFY row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1")
def q_title_dedup(spark, sf_dir):
    """The first document of each normalised title."""
    d = _docs(spark, sf_dir).select("doc_id", text.normalize_title(F.col("title")).alias("norm"))
    return dedup.dedup_first(d, ["norm"], "doc_id")


_SUFFIXES = ("", ".pdf", ".full", ".full.pdf", ".abstract.xml", ").", ".html")
_DOI_URL_SQL = f"'https://doi.org/10.1234/X' || (doc_id % 211) || list_value({', '.join(repr(s) for s in _SUFFIXES)})[CAST(doc_id % {len(_SUFFIXES)} AS INT) + 1]"
_DOI_SQL = r"regexp_replace(regexp_replace(lower(regexp_extract(u, '(?i)\b(10\.\d{4,9}/[-._;()/:A-Z0-9]+)', 1)), '[.,);]+$', ''), '(?:\.(?:full|abstract|pdf|html|xml)|\.)+$', '')"


def _doi_url() -> Column:
    """The address that a document's id stands for."""
    suffix = F.element_at(F.array(*[F.lit(s) for s in _SUFFIXES]), (F.col("doc_id") % len(_SUFFIXES) + 1).cast("int"))
    return F.concat(F.lit("https://doi.org/10.1234/X"), (F.col("doc_id") % 211).cast("string"), suffix)


def _doi_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", _doi_url().alias("url"))


@register(f"WITH d AS (SELECT doc_id, {_DOI_URL_SQL} AS u FROM documents) SELECT doc_id, {_DOI_SQL} AS doi FROM d")
def q_extract_doi(spark, sf_dir):
    """DOI in addresses with stacked suffixes."""
    return _doi_urls(spark, sf_dir).select("doc_id", urls.extract_doi(F.col("url")).alias("doi"))


@register(f"WITH d AS (SELECT doc_id, {_DOI_URL_SQL} AS u FROM documents) SELECT min(doc_id) AS doc_id, {_DOI_SQL} AS doi, count(*) AS copies FROM d GROUP BY 2")
def q_doi_dedup(spark, sf_dir):
    """First document and number of copies of each DOI."""
    d = _doi_urls(spark, sf_dir).withColumn("doi", urls.extract_doi(F.col("url")))
    return d.groupBy("doi").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


_URL_KEY_SQL = "lower(regexp_replace(regexp_replace(url, '(?s)#.*$', ''), '/+$', ''))"


@register(f"SELECT page_id, {_URL_KEY_SQL} AS url_key FROM pages QUALIFY row_number() OVER (PARTITION BY url_key ORDER BY page_id) = 1")
def q_url_key_dedup(spark, sf_dir):
    """The first page of each address, fragment, slash and letter case aside."""
    return dedup.dedup_by_url_key(table(spark, sf_dir, "pages"), "url", "page_id").select("page_id", urls.url_key(F.col("url")).alias("url_key"))


@register("""WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Doe, ' || c_name ELSE c_name || ' Smith' END AS author, CAST(year(o_orderdate) AS VARCHAR) AS y, o_orderpriority || ' of ' || c_mktsegment AS title
  FROM orders JOIN customer ON o_custkey = c_custkey),
p AS (SELECT o_orderkey, lower(CASE WHEN contains(author, ',') THEN trim(string_split(author, ',')[1]) ELSE string_split(author, ' ')[-1] END) AS surname, y,
  lower(array_to_string(list_slice(list_filter(regexp_split_to_array(title, '[^\\pL\\pN]+'), lambda t: t <> ''), 1, 3), ' ')) AS head FROM c)
SELECT o_orderkey, surname || '|' || y || '|' || head AS fingerprint FROM p""")
def q_author_year_fp(spark, sf_dir):
    """Fingerprints of made-up authors, years and titles."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    author = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Doe, "), "c_name")).otherwise(F.concat("c_name", F.lit(" Smith")))
    title = F.concat("o_orderpriority", F.lit(" of "), "c_mktsegment")
    return o.select("o_orderkey", text.author_year_fingerprint(F.array(author), F.year("o_orderdate").cast("string"), title).alias("fingerprint"))


def _discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as discoveries of runs of 200, with titles, authors and DOIs that repeat."""
    d = _docs(spark, sf_dir).withColumn("url", _doi_url())
    some = F.col("doc_id") % 3 == 0
    return d.select(
        F.floor(F.col("doc_id") / 200).cast("long").alias("run_id"), F.col("doc_id").alias("arrival_seq"), F.col("source").alias("source_id"), (F.col("doc_id") % 40 + 1).cast("int").alias("rank_in_source"),
        "title", F.when(some, F.col("url")).otherwise(F.concat(F.lit("https://a.example/"), (F.col("doc_id") % 500).cast("string"))).alias("url"), "source",
        F.array(F.concat(F.lit("Jane Doe"), (F.col("doc_id") % 7).cast("string"))).alias("authors"), (F.lit(2000) + F.col("doc_id") % 5).cast("string").alias("year"), F.col("text").alias("abstract"), F.lit(None).cast("string").alias("identifier"),
    )


def _fold_sql(run: str) -> str:
    """The matcher as a recursion over each run's rows, its keys kept in maps."""
    put = "CASE WHEN {on} AND NOT map_contains({m}, {k}) THEN map_concat({m}, MAP([{k}], [{v}])) ELSE {m} END"
    return f"""WITH RECURSIVE d AS (SELECT {run} AS run_id, doc_id AS arrival_seq, coalesce(string_split(text, chr(10))[1], '') AS title, {_DOI_URL_SQL} AS u, doc_id FROM documents),
k AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY arrival_seq) AS n, CASE WHEN doc_id % 3 = 0 THEN u ELSE 'https://a.example/' || doc_id % 500 END AS url, CASE WHEN doc_id % 3 = 0 THEN {_DOI_SQL} END AS doi, {_NORM_SQL.format('title')} AS norm,
  'doe' || doc_id % 7 AS surname, CAST(2000 + doc_id % 5 AS VARCHAR) AS year,
  'doe' || doc_id % 7 || '|' || (2000 + doc_id % 5) || '|' || nullif(lower(array_to_string(list_slice(list_filter(regexp_split_to_array(title, '[^\\pL\\pN]+'), lambda t: t <> ''), 1, 3), ' ')), '') AS fp FROM d),
s AS (SELECT DISTINCT run_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS INTEGER) AS idx, 0 AS total, CAST(NULL AS VARCHAR) AS first_url, CAST(MAP() AS MAP(VARCHAR, INTEGER)) AS mu, CAST(MAP() AS MAP(VARCHAR, INTEGER)) AS md,
    CAST(MAP() AS MAP(VARCHAR, STRUCT(i INTEGER, y VARCHAR, s VARCHAR))) AS mt, CAST(MAP() AS MAP(VARCHAR, STRUCT(i INTEGER, m VARCHAR))) AS mf FROM k
  UNION ALL SELECT run_id, n, i, total + CAST(hit IS NULL AS INTEGER), CASE WHEN hit IS NULL THEN url END, {put.format(on="true", m="mu", k="url", v="i")},
    {put.format(on="doi IS NOT NULL AND by_key IS NULL", m="md", k="coalesce(doi, '')", v="i")},
    {put.format(on="hit IS NULL AND norm NOT IN ('', 'untitled')", m="mt", k="norm", v="{'i': i, 'y': year, 's': surname}")},
    {put.format(on="hit IS NULL AND fp IS NOT NULL", m="mf", k="coalesce(fp, '')", v="{'i': i, 'm': norm}")}
  FROM (SELECT *, coalesce(by_key, by_title, by_mark) AS hit, coalesce(by_key, by_title, by_mark, total) AS i FROM (
    SELECT s.* EXCLUDE (n, idx, first_url), k.* EXCLUDE (run_id), coalesce(map_extract(mu, url)[1], map_extract(md, doi)[1]) AS by_key,
      CASE WHEN norm NOT IN ('', 'untitled') AND (len(string_split(norm, ' ')) >= 5 OR map_extract(mt, norm)[1].y = year OR map_extract(mt, norm)[1].s = surname) THEN map_extract(mt, norm)[1].i END AS by_title,
      CASE WHEN norm <> '' AND map_extract(mf, fp)[1].m <> '' AND (starts_with(norm, map_extract(mf, fp)[1].m) OR starts_with(map_extract(mf, fp)[1].m, norm)) THEN map_extract(mf, fp)[1].i END AS by_mark
    FROM s JOIN k ON k.run_id = s.run_id AND k.n = s.n + 1)))
SELECT run_id, idx AS insert_idx, max(first_url) AS url, CAST(count(*) AS INTEGER) AS n_ranks FROM s WHERE n > 0 GROUP BY run_id, idx"""


@register(_fold_sql("doc_id // 200"))
def q_dedup_exact(spark, sf_dir):
    """The exact five-step matcher over runs of documents."""
    out = dedup.resolve(_discoveries(spark, sf_dir))
    return out.select("run_id", "insert_idx", "url", F.size("source_ranks").alias("n_ranks"))


@register(_fold_sql("CAST(0 AS BIGINT)"))
def q_dedup_components(spark, sf_dir):
    """The same matcher over all documents as one run, by components of shared keys."""
    rows = matching.matched(_discoveries(spark, sf_dir).withColumn("run_id", F.lit(0).cast("long")))
    urls = _discoveries(spark, sf_dir).select(F.col("arrival_seq").alias("doc_seq"), "url")
    return rows.groupBy("run_id", "insert_idx", "doc_seq").agg(F.count(F.lit(1)).cast("int").alias("n_ranks")).join(urls, "doc_seq").select("run_id", "insert_idx", "url", "n_ranks")


@register(f"""WITH d AS (SELECT doc_id // 200 AS run_id, doc_id AS arrival_seq, coalesce(string_split(text, chr(10))[1], '') AS title, {_DOI_URL_SQL} AS u, doc_id FROM documents),
k AS (SELECT run_id, arrival_seq, CASE WHEN doc_id % 3 = 0 THEN u ELSE 'https://a.example/' || doc_id % 500 END AS url, CASE WHEN doc_id % 3 = 0 THEN {_DOI_SQL} END AS doi, {_NORM_SQL.format('title')} AS norm,
  'doe' || doc_id % 7 || '|' || (2000 + doc_id % 5) || '|' || nullif(lower(array_to_string(list_slice(list_filter(regexp_split_to_array(title, '[^\\pL\\pN]+'), lambda t: t <> ''), 1, 3), ' ')), '') AS fp FROM d),
a AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY run_id, url ORDER BY arrival_seq) = 1),
b AS (SELECT * FROM a QUALIFY doi IS NULL OR row_number() OVER (PARTITION BY run_id, doi ORDER BY arrival_seq) = 1),
c AS (SELECT * FROM b QUALIFY norm IN ('', 'untitled') OR len(string_split(norm, ' ')) < 5 OR row_number() OVER (PARTITION BY run_id, norm ORDER BY arrival_seq) = 1),
e AS (SELECT *, first_value(norm) OVER w AS anchor, row_number() OVER w AS n FROM c WINDOW w AS (PARTITION BY run_id, fp ORDER BY arrival_seq))
SELECT run_id, arrival_seq, url FROM e WHERE fp IS NULL OR n = 1 OR norm = '' OR NOT (starts_with(norm, anchor) OR starts_with(anchor, norm))""")
def q_dedup_relational(spark, sf_dir):
    """The keep-first passes over the same rows."""
    return dedup.resolve_relational(_discoveries(spark, sf_dir)).select("run_id", "arrival_seq", "url")


# --- reranking ----------------------------------------------------------------------------------


@register("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v AS qv FROM e WHERE vec_id = (SELECT min(vec_id) FROM e)),
s AS (SELECT vec_id, label, 1.0 / (1 + vec_id % 97) AS lex, list_cosine_similarity(v, qv) AS cs FROM e, q),
p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY lex DESC, vec_id) AS pos FROM s), h AS (SELECT *, pos <= 20 AS head FROM p),
b AS (SELECT vec_id, label, pos, head, CASE WHEN head THEN 0.6 * (lex - min(lex) OVER (PARTITION BY label, head)) / (max(lex) OVER (PARTITION BY label, head) - min(lex) OVER (PARTITION BY label, head)) + 0.4 * least(greatest(cs, 0.0), 1.0) ELSE lex END AS score FROM h)
SELECT vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY label ORDER BY head DESC, CASE WHEN head THEN score END DESC, pos) AS pos FROM b""")
def q_semantic_rerank(spark, sf_dir):
    """Vectors of each label re-sorted by a made-up lexical score blended with the cosine to the first vector."""
    e = table(spark, sf_dir, "embeddings")
    asked = F.array(*[F.lit(float(x)) for x in e.orderBy("vec_id").select("embedding").first().embedding])
    r = e.select(F.col("label").alias("run_id"), "vec_id", (1.0 / (1 + F.col("vec_id") % 97)).alias("score"), rerank.cosine(F.col("embedding"), asked).alias("cosine"))
    r = r.withColumn("pos", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("score"), "vec_id")))
    return rerank.semantic_rerank(r, F.lit(20)).select("vec_id", six("score").alias("score"), F.col("pos").cast("long").alias("pos"))


@register("""WITH k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, doc_id % 5 = 0 AS bad FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM k WHERE NOT bad),
band AS (SELECT doc_id FROM n WHERE n >= 4 AND i >= n * 50 // 100 AND i < greatest(n * 70 // 100, n * 50 // 100 + 1))
SELECT k.doc_id, CASE WHEN bad THEN 'TF-IDF' WHEN b.doc_id IS NOT NULL AND l.quality = 0 THEN 'LLM judged off-topic' END AS reject_reason
FROM k LEFT JOIN band b USING (doc_id) LEFT JOIN labels l USING (doc_id)""")
def q_llm_band(spark, sf_dir):
    """Borderline documents of each source rejected by a verdict, here the quality label."""
    k = table(spark, sf_dir, "documents").select(F.col("source").alias("run_id"), F.col("doc_id").alias("url"), F.when(F.col("doc_id") % 5 == 0, "TF-IDF").alias("reject_reason"))
    k = k.withColumn("pos", F.row_number().over(Window.partitionBy("run_id").orderBy("url")))
    v = table(spark, sf_dir, "labels").join(k.select("run_id", F.col("url").alias("doc_id")), "doc_id").select("run_id", F.col("doc_id").alias("url"), (F.col("quality") == 1).alias("verdict"))
    return rerank.llm_filter(k, v).select(F.col("url").alias("doc_id"), "reject_reason")


@register("""WITH p AS (SELECT p_partkey, p_size % 5 AS run, '10.1234/p' || p_partkey AS doi, 1000.0 / (1 + p_partkey % 331) AS score, row_number() OVER (PARTITION BY p_size % 5 ORDER BY 1000.0 / (1 + p_partkey % 331) DESC, p_partkey) AS pos FROM part),
e AS (SELECT '10.1234/p' || a.l_partkey AS src, '10.1234/p' || b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
h AS (SELECT p.run, dst AS doi, count(*) AS hits FROM e JOIN p ON p.doi = e.src AND p.pos <= 30 WHERE src <> dst GROUP BY ALL),
b AS (SELECT p_partkey, run, pos, score * (1 + 0.1 * CASE WHEN pos <= 30 THEN least(coalesce(hits, 0), 5) ELSE 0 END) AS score FROM p LEFT JOIN h USING (run, doi))
SELECT p_partkey, round(score, 6) AS score, row_number() OVER (PARTITION BY run ORDER BY score DESC, pos) AS pos FROM b""")
def q_citation_boost(spark, sf_dir):
    """Parts as documents of five runs, raised where one of a run's first thirty stands beside them in an order."""
    doi = lambda c: F.concat(F.lit("10.1234/p"), F.col(c).cast("string"))
    p = table(spark, sf_dir, "part").select((F.col("p_size") % 5).alias("run_id"), "p_partkey", doi("p_partkey").alias("identifier"), F.lit("").alias("url"), (1000.0 / (1 + F.col("p_partkey") % 331)).alias("score"))
    p = p.withColumn("pos", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("score"), "p_partkey"))).withColumn("tfidf", F.lit(1.0)).withColumn("authority", F.lit(1.0)).withColumn("reject_reason", F.lit(None).cast("string"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", doi("l_partkey").alias("doi"))
    after = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("doi").alias("dst_doi"))
    edges = li.withColumnRenamed("doi", "src_doi").join(after, ["l_orderkey", "l_linenumber"]).select("src_doi", "dst_doi")
    return rerank.citation_boost(p, edges).select("p_partkey", six("score").alias("score"), F.col("pos").cast("long").alias("pos"))


# --- pages and downloads ------------------------------------------------------------------------


def _decode_sql(x: str, names: tuple[str, ...]) -> str:
    for name in sorted(names, key=lambda n: n == "amp"):
        value = text.TITLE_ENTITIES[name].replace("'", "''")
        x = f"replace({x}, '&{name};', '{value}')"
    return x


_STRIP_SQL = "html"
for _tag in ("script", "style", "noscript"):
    _STRIP_SQL = f"regexp_replace({_STRIP_SQL}, '(?is)<\\s*{_tag}\\b[^>]*>.*?<\\s*/\\s*{_tag}\\s*>', '', 'g')"
_STRIP_SQL = f"regexp_replace({_STRIP_SQL}, '(?i)<\\s*(p|div|br|h[1-6]|li|tr|section|article|header|footer|hr|blockquote)\\b[^>]*/?>', chr(10), 'g')"
_STRIP_SQL = f"regexp_replace({_STRIP_SQL}, '(?i)<\\s*/\\s*(p|div|h[1-6]|li|tr|section|article|header|footer|blockquote)\\s*>', chr(10), 'g')"
_STRIP_SQL = _decode_sql(f"regexp_replace({_STRIP_SQL}, '<[^>]+>', '', 'g')", text.BODY_ENTITIES)


@register(f"SELECT page_id, md5({_STRIP_SQL}) AS digest, length({_STRIP_SQL}) AS n FROM pages")
def q_strip_html(spark, sf_dir):
    """Text of every page, as a digest."""
    out = text.strip_html(F.col("html"), native=True)
    return table(spark, sf_dir, "pages").select("page_id", F.md5(out).alias("digest"), F.length(out).cast("long").alias("n"))


@register(f"""SELECT page_id, trim(regexp_replace({_decode_sql(f"regexp_replace({_TITLE_SQL}, '<[^>]*>', '', 'g')", tuple(text.TITLE_ENTITIES))}, '\\s+', ' ', 'g')) AS title FROM pages""")
def q_clean_title(spark, sf_dir):
    """Clean title of every page."""
    return table(spark, sf_dir, "pages").select("page_id", text.clean_title(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), native=True).alias("title"))


_HEADS = (
    '<meta name="citation_pdf_url" content="https://x.example/a.pdf">', '<link rel="alternate" type="application/pdf" href="https://y.example/b.pdf">', '<a href="/c.pdf?x=1">c</a>',
    '<a href="https://other.example/d.pdf">d</a>', '<div data-pdf-url="/e.pdf"></div>', '<a href="/download/7">f</a>', "<p>none</p>",
)


@register(f"""WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS o, page_id % {len(_HEADS)} AS k FROM pages)
SELECT page_id, CASE k WHEN 0 THEN 'https://x.example/a.pdf' WHEN 1 THEN 'https://y.example/b.pdf' WHEN 2 THEN o || '/c.pdf?x=1' WHEN 4 THEN o || '/e.pdf' WHEN 5 THEN o || '/download/7' END AS pdf_url FROM p""")
def q_pdf_link(spark, sf_dir):
    """The PDF that pages with made-up heads link to."""
    head = F.element_at(F.array(*[F.lit(h) for h in _HEADS]), (F.col("page_id") % len(_HEADS) + 1).cast("int"))
    p = table(spark, sf_dir, "pages").withColumn("html", F.concat(head, "html"))
    return content.pdf_link(p, "html", "url").select("page_id", "pdf_url")


_EXT = ("", ".pdf", ".html", "/abs/1", "/download/2", ".htm?x=1", ".epub", ".txt")
_EXT_SQL = f"'https://arxiv.org' || list_value({', '.join(repr(e) for e in _EXT)})[CAST(page_id % {len(_EXT)} AS INT) + 1]"


def _ext_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXT]), (F.col("page_id") % len(_EXT) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://arxiv.org"), ext).alias("u"))


@register(f"""WITH p AS (SELECT page_id, {_EXT_SQL} AS u FROM pages) SELECT page_id, regexp_matches(u, '\\.pdf|\\.epub|/pdf/|/download/|/abs/|/article/|/bitstream/|getfile') OR NOT regexp_matches(regexp_replace(u, '[?#].*$', ''), '\\.html?$') AS is_doc,
NOT regexp_matches(u, 'doi\\.org|hdl\\.handle\\.net|purl\\.org') AND (regexp_matches(u, '\\.pdf|/pdf/|/download/|/bitstream/|getfile') OR NOT (regexp_matches(u, '\\.html?$') OR contains(u, '/abs/'))) AS is_pdf FROM p""")
def q_looks_like_doc(spark, sf_dir):
    """Which addresses plausibly lead to documents."""
    return _ext_urls(spark, sf_dir).select("page_id", urls.looks_like_doc(F.col("u")).alias("is_doc"), urls.is_likely_pdf_url(F.col("u")).alias("is_pdf"))


@register(f"""WITH p AS (SELECT page_id, {_EXT_SQL} AS u, CASE page_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN '' ELSE 'application/epub+zip' END AS ct FROM pages), q AS (SELECT *, regexp_replace(u, '\\?.*$', '') AS b FROM p)
SELECT page_id, CASE WHEN contains(ct, 'pdf') OR b LIKE '%.pdf' THEN '.pdf' WHEN contains(ct, 'epub') OR b LIKE '%.epub' THEN '.epub' WHEN contains(ct, 'html') OR b LIKE '%.html' OR b LIKE '%.htm' THEN '.html' WHEN contains(ct, 'text') OR b LIKE '%.txt' THEN '.txt' ELSE '.pdf' END AS ext,
CASE WHEN ct = 'text/html' AND NOT (b LIKE '%.html' OR b LIKE '%.htm') THEN '{content.NOT_A_DOCUMENT}' END AS reason FROM q""")
def q_ext_from(spark, sf_dir):
    """Extension to store under, and why a response is no document."""
    k = F.col("page_id") % 3
    ct = F.when(k == 0, "text/html").when(k == 1, "").otherwise("application/epub+zip")
    return _ext_urls(spark, sf_dir).select("page_id", content.ext_from(F.col("u"), ct).alias("ext"), content.reject_content_type(F.col("u"), ct).alias("reason"))


@register(f"WITH p AS (SELECT page_id, {_EXT_SQL} AS u FROM pages) SELECT page_id, replace(u, 'arxiv.org/abs/', 'arxiv.org/pdf/') AS url, regexp_extract(u, '^(.*?://[^/]+)', 1) || '/' AS referer FROM p")
def q_canonical_url(spark, sf_dir):
    """Addresses rewritten, and the referer sent with them."""
    return _ext_urls(spark, sf_dir).select("page_id", urls.canonicalize_doc_url(F.col("u")).alias("url"), urls.referer_for(F.col("u")).alias("referer"))


@register(f"""WITH p AS (SELECT page_id, url, substr(regexp_replace(trim(regexp_replace({_TITLE_SQL}, '[^\\pL\\pM\\pN_\\s-]', '', 'g')), '[-\\s]+', '-', 'g'), 1, 80) AS b FROM pages)
SELECT page_id, CASE WHEN b = '' THEN 'doc' ELSE b END || '-' || substr(md5(url), 1, 6) AS slug FROM p""")
def q_slug(spark, sf_dir):
    """File stem of every page."""
    return table(spark, sf_dir, "pages").select("page_id", text.slug(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), F.col("url")).alias("slug"))


@register("SELECT item_id, array_to_string(regexp_extract_all(text, '[^\\s]+'), ' ') AS abstract FROM benchmark")
def q_inverted_index_roundtrip(spark, sf_dir):
    """Texts rebuilt from an inverted index of their words."""
    words = F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(words).alias("p", "w")).groupBy("item_id", "w").agg(F.collect_list(F.col("p").cast("long")).alias("ps"))
    m = b.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("m"))
    return m.select("item_id", text.reconstruct_abstract(F.col("m")).alias("abstract"))


@register("""WITH e AS (SELECT event_id, (event_id * 2654435761) % 4294967296 AS n FROM events), o AS (SELECT event_id, n // 16777216 AS a, n // 65536 % 256 AS b, n // 256 % 256 AS c, n % 256 AS d FROM e)
SELECT event_id, (a = 10 OR a = 127 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 192 AND b = 88 AND c = 99)
OR (a = 192 AND b = 168) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) OR a BETWEEN 224 AND 239 OR (a = 0 AND b = 0 AND c = 0 AND d = 0) OR (a = 255 AND b = 255 AND c = 255 AND d = 255)) AS private FROM o""")
def q_private_ip(spark, sf_dir):
    """Which of many addresses aren't publicly routable."""
    n = (F.col("event_id") * 2654435761) % 4294967296
    part = lambda k: (F.floor(F.col("n") / k) % 256).cast("string")
    ip = F.concat_ws(".", part(16777216), part(65536), part(256), part(1))
    return table(spark, sf_dir, "events").select("event_id", n.alias("n")).select("event_id", urls.is_private_ipv4(ip).alias("private"))


# --- fan-out and caps ---------------------------------------------------------------------------


def _requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve runs ask for sources named after nations and a few real ones."""
    names = F.array(*[F.lit(s) for s in (*display.SOURCES, "unknown_one")])
    n = table(spark, sf_dir, "nation")
    return n.select((F.col("n_nationkey") % 12).cast("long").alias("run_id"), F.explode(F.filter(names, lambda x, i: (i + F.col("n_nationkey")) % 3 == 0)).alias("source_id")).distinct()


_REQUESTED_SQL = f"""names AS (SELECT list_value({', '.join(repr(s) for s in (*display.SOURCES, 'unknown_one'))}) AS l),
req AS (SELECT DISTINCT CAST(n_nationkey % 12 AS BIGINT) AS run_id, unnest(list_filter(l, lambda x, i: (i - 1 + n_nationkey) % 3 = 0)) AS source_id FROM nation, names),
eff AS (SELECT * FROM req r WHERE source_id <> 'unknown_one' AND NOT (source_id IN ({', '.join(repr(c) for c in display.COVERED)}) AND EXISTS (SELECT 1 FROM req m WHERE m.run_id = r.run_id AND m.source_id = 'meta_search')))"""


@register(f"WITH {_REQUESTED_SQL} SELECT run_id, source_id FROM eff")
def q_effective_sources(spark, sf_dir):
    """Sources of each run without unknown and covered ones."""
    return discovery.effective_sources(_requested(spark, sf_dir)).select("run_id", "source_id")


@register(f"WITH {_REQUESTED_SQL} SELECT run_id, source_id, 'unknown source: ' || source_id AS error, 'other' AS kind FROM req WHERE source_id = 'unknown_one'")
def q_unknown_sources(spark, sf_dir):
    """Error rows of unknown sources."""
    return discovery.unknown_sources(_requested(spark, sf_dir))


@register(f"WITH {_REQUESTED_SQL}, s AS (SELECT CAST(item_id % 12 AS BIGINT) AS run_id, item_id AS sub_idx FROM benchmark) SELECT run_id, sub_idx, source_id FROM s JOIN eff USING (run_id)")
def q_fanout(spark, sf_dir):
    """A task for each sub-query and source of a run."""
    subs = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 12).cast("long").alias("run_id"), F.col("item_id").alias("sub_idx"))
    return discovery.fan_out(subs, discovery.effective_sources(_requested(spark, sf_dir))).select("run_id", "sub_idx", "source_id")


@register("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents QUALIFY rank <= 25")
def q_source_cap(spark, sf_dir):
    """The first 25 results of each source (a cap is the feature)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long").alias("rank_in_source"))
    return discovery.cap_per_source(d, 25).select("doc_id", "source", F.col("rank_in_source").alias("rank"))


@register("""WITH d AS (SELECT doc_id // 200 AS run_id, doc_id, 'https://a.example/' || doc_id % 90 AS url FROM documents),
f AS (SELECT run_id, url, min(doc_id) AS first FROM d GROUP BY run_id, url QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY min(doc_id)) <= 60),
c AS (SELECT run_id, count(*) AS n, max(first) AS last FROM f GROUP BY run_id)
SELECT run_id, f.url, row_number() OVER (PARTITION BY run_id ORDER BY first) - 1 AS insert_idx, (SELECT count(*) FROM d WHERE d.run_id = f.run_id AND d.url = f.url AND (c.n < 60 OR d.doc_id <= c.last)) AS n_ranks FROM f JOIN c USING (run_id)""")
def q_global_cap(spark, sf_dir):
    """The matcher under a cap of 60 documents a run, where only addresses match; what comes later counts for nothing (a cap is the feature)."""
    none = lambda kind: F.lit(None).cast(kind)
    d = _discoveries(spark, sf_dir).withColumn("url", F.concat(F.lit("https://a.example/"), (F.col("arrival_seq") % 90).cast("string")))
    d = d.withColumn("title", F.lit("")).withColumn("authors", F.array().cast("array<string>")).withColumn("year", none("string"))
    out = dedup.resolve(d, 60)
    return out.select("run_id", "url", F.col("insert_idx").cast("long").alias("insert_idx"), F.size("source_ranks").cast("long").alias("n_ranks"))


@register("""WITH b AS (SELECT item_id % 6 AS run_id, lower(string_split(text, ' ')[1]) AS s FROM benchmark WHERE item_id % 2 = 0), e AS (SELECT item_id, item_id % 6 AS run_id, string_split(text, ' ')[1] AS sub_query FROM benchmark)
SELECT item_id, sub_query FROM e WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.run_id = e.run_id AND b.s = lower(e.sub_query))""")
def q_novel_extras(spark, sf_dir):
    """Sub-queries that the first wave doesn't have."""
    e = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 6).alias("run_id"), F.get(F.split("text", " "), F.lit(0)).alias("sub_query"))
    return discovery.novel_extras(e, e.where("item_id % 2 = 0").drop("item_id")).select("item_id", "sub_query")


@register("SELECT CAST(floor(o_totalprice / 100) AS BIGINT) AS m, o_orderkey, CAST(least(15 + m // 40, 60) AS BIGINT) AS w1, CAST(least(12 + m // 50, 45) AS BIGINT) AS w2, CAST(least(greatest(8 + m // 12, 8), 20) AS BIGINT) AS t, CAST(least(greatest(m // 4, 100), 400) AS BIGINT) AS pool FROM orders")
def q_deadlines(spark, sf_dir):
    """Budgets of runs by their cap."""
    m = F.floor(F.col("o_totalprice") / 100).cast("long")
    w1, w2 = discovery.wave_deadlines(m)
    return table(spark, sf_dir, "orders").select(m.alias("m"), "o_orderkey", w1.cast("long").alias("w1"), w2.cast("long").alias("w2"), discovery.backend_timeout(m).cast("long").alias("t"), rerank.pool_size(m).cast("long").alias("pool"))


# --- library ------------------------------------------------------------------------------------


@register("""WITH old AS (SELECT * FROM events WHERE user_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)
SELECT CASE WHEN user_id % 2 = 0 THEN 1000 + user_id END AS id, user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def q_upsert_latest(spark, sf_dir):
    """Upsert onto a library that has half of the keys: the latest row of each owns it, known ids stay."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("string").alias("url"), F.col("event_id").alias("run_id"), "event_type", "value", "user_id")
    old = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) == 1) & (F.col("user_id") % 2 == 0)
    rows = e.select("event_id", (F.when(old, 1000 + F.col("user_id"))).alias("id")).join(rows, F.col("event_id") == F.col("run_id")).drop("event_id")
    existing = rows.where("id is not null").select("id", "url", "run_id", "event_type", "value")
    incoming = rows.where("id is null").select("url", "run_id", "event_type", "value", F.col("run_id").alias("seq"))
    return library.upsert_documents(existing, incoming).select("id", F.col("url").cast("long").alias("user_id"), F.col("run_id").alias("event_id"), "event_type", "value")


@register("""SELECT user_id % 40 AS manifest, 'u' || event_id % 300 AS url, event_type AS title, 'A B, ' || event_type AS authors, CAST(0 AS BIGINT) AS size_bytes FROM events
QUALIFY row_number() OVER (PARTITION BY event_id % 300 ORDER BY user_id % 40, event_id) = 1""")
def q_migrate_first(spark, sf_dir):
    """Documents of legacy manifests: the first of each address stays."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("manifest"), "event_id", F.concat(F.lit("u"), (F.col("event_id") % 300).cast("string")).alias("url"), F.col("event_type").alias("title"))
    doc = F.struct("event_id", "url", "title", F.array(F.lit("A B"), "title").alias("authors"))
    manifests = e.groupBy("manifest").agg(F.array_sort(F.collect_list(doc)).alias("documents"))
    return library.migrate_manifest(manifests, "manifest").select("manifest", "url", "title", "authors", "size_bytes")


@register("""SELECT CAST(o_custkey % 50 AS VARCHAR) AS library, arg_max(o_orderpriority, o_orderkey) AS query, (SELECT count(*) FROM lineitem l WHERE CAST(l.l_orderkey % 50 AS VARCHAR) = CAST(o.o_custkey % 50 AS VARCHAR)) AS n_docs
FROM (SELECT o_custkey % 50 AS o_custkey, o_orderpriority, CAST(epoch(o_orderdate) AS BIGINT) * 1000000 + o_orderkey AS o_orderkey FROM orders) o GROUP BY o_custkey""")
def q_library_summary(spark, sf_dir):
    """Latest query and number of documents of each library."""
    runs = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).cast("string").alias("library"), F.col("o_orderpriority").alias("query"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("id"))
    docs = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).cast("string").alias("library"))
    return library.library_summary(runs, docs)


@register("""WITH d AS (SELECT *, CASE WHEN c_custkey % 3 <> 0 THEN 'f' || c_custkey % 1000 ELSE '' END AS path FROM customer), f AS (SELECT DISTINCT 'f' || s_suppkey * 7 % 1000 AS path FROM supplier)
SELECT c_custkey, c_mktsegment AS title, row_number() OVER (PARTITION BY c_nationkey ORDER BY translate(c_mktsegment, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), c_name || c_custkey) AS place FROM d WHERE path <> '' AND path IN (SELECT path FROM f)""")
def q_library_docs(spark, sf_dir):
    """Documents of each library with a stored file that is there, in title order."""
    path = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("f"), (F.col("c_custkey") % 1000).cast("string"))).otherwise("")
    d = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("title"), F.concat("c_name", F.col("c_custkey").cast("string")).alias("url"), path.alias("local_path"))
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), (F.col("s_suppkey") * 7 % 1000).cast("string")).alias("path"))
    return library.library_docs(d, files, "c_nationkey").select("c_custkey", "title", F.col("place").cast("long").alias("place"))


@register("SELECT count(*) AS libraries, CAST(sum(n) AS BIGINT) AS docs, round(sum(b), 2) AS bytes FROM (SELECT c_nationkey, count(*) AS n, sum(c_acctbal) AS b FROM customer GROUP BY c_nationkey)")
def q_lifetime_stats(spark, sf_dir):
    """Libraries, documents and bytes in all."""
    libs = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("c_acctbal").alias("size_bytes"))
    return library.lifetime_stats(libs).select("libraries", "docs", F.round("bytes", 2).alias("bytes"))


@register("""WITH f AS (SELECT 'lib' || (doc_id % 7) AS library, 's' || (doc_id % 97) AS slug, list_value('.pdf', '.epub', '.html', '.txt', '.doc')[CAST(doc_id % 5 AS INT) + 1] AS ext, n_chars * 4 AS length, doc_id % 11 <> 0 AS valid FROM documents),
w AS (SELECT DISTINCT library, slug FROM f)
SELECT w.library, w.slug, f.library AS from_library, f.ext FROM w JOIN f USING (slug) WHERE w.library <> f.library AND f.length >= 4096 AND f.valid AND f.ext <> '.doc'
QUALIFY row_number() OVER (PARTITION BY w.library, w.slug ORDER BY list_position(['.pdf', '.epub', '.html', '.txt'], f.ext), f.library) = 1""")
def q_reuse_join(spark, sf_dir):
    """Files of other libraries that serve a document wanted."""
    ext = F.element_at(F.array(*[F.lit(e) for e in (".pdf", ".epub", ".html", ".txt", ".doc")]), (F.col("doc_id") % 5 + 1).cast("int"))
    f = table(spark, sf_dir, "documents").select(F.concat(F.lit("lib"), (F.col("doc_id") % 7).cast("string")).alias("library"), F.concat(F.lit("s"), (F.col("doc_id") % 97).cast("string")).alias("slug"), ext.alias("ext"), (F.col("n_chars") * 4).alias("length"), (F.col("doc_id") % 11 != 0).alias("valid"))
    return library.reuse_from_siblings(f.select("library", "slug").distinct(), f).select("library", "slug", "from_library", "ext")


@register("""WITH f AS (SELECT doc_id, 'https://a/' || (doc_id % 300) AS url, '10.1/' || (doc_id % 400) AS doi FROM documents), l AS (SELECT DISTINCT '10.1/' || (doc_id % 200) AS doi, 'https://a/' || (doc_id % 200) AS u FROM documents)
SELECT doc_id, CASE WHEN l.u <> f.url THEN l.u END AS retry_url FROM f LEFT JOIN l USING (doi)""")
def q_unpaywall_fallback(spark, sf_dir):
    """Open-access addresses to try for failed downloads."""
    d, mod = table(spark, sf_dir, "documents"), lambda p, k: F.concat(F.lit(p), (F.col("doc_id") % k).cast("string"))
    f = d.select("doc_id", mod("https://a/", 300).alias("url"), mod("10.1/", 400).alias("doi"))
    return library.open_access_fallback(f, d.select(mod("10.1/", 200).alias("doi"), mod("https://a/", 200).alias("url_for_pdf")).distinct()).select("doc_id", "retry_url")


@register("""WITH e AS (SELECT user_id, event_type, event_id, value FROM events WHERE event_type IN ('error', 'purchase')),
g AS (SELECT user_id, CAST(floor(value) AS INT) % 5 AS url, max(event_id) FILTER (event_type = 'error') AS f, max(event_id) FILTER (event_type = 'purchase') AS d FROM e GROUP BY ALL)
SELECT user_id AS run_id, url, f AS failed_seq FROM g WHERE f IS NOT NULL AND (d IS NULL OR d < f)""")
def q_retry_failed(spark, sf_dir):
    """Documents that failed and didn't succeed later."""
    e = table(spark, sf_dir, "events").where("event_type in ('error', 'purchase')")
    e = e.select(F.col("user_id").alias("run_id"), (F.floor("value").cast("int") % 5).alias("url"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"))
    return library.retry_failed(e)


# --- events -------------------------------------------------------------------------------------

_MESSAGES = ("HTTP 429 Too Many Requests", "403 forbidden", "502 bad gateway", "operation took too long", "missing field", "strange", "Blocked by host", "network timeout while connecting")
_MSG_SQL = f"list_value({', '.join(repr(m) for m in _MESSAGES)})[CAST(event_id % {len(_MESSAGES)} AS INT) + 1]"
_KIND_SQL = """CASE WHEN regexp_matches(m, '429|rate limit|too many requests') THEN 'rate_limit' WHEN regexp_matches(m, '403|401|forbidden|unauthorized|blocked') THEN 'forbidden' WHEN regexp_matches(m, '500|502|503|504|server error') THEN 'server_error'
WHEN regexp_matches(m, 'timeout|timed out|operation took') THEN 'timeout' WHEN regexp_matches(m, 'parse|regex|decode|non-json|missing') THEN 'parse_error' ELSE 'other' END"""


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    msg = F.element_at(F.array(*[F.lit(m) for m in _MESSAGES]), (F.col("event_id") % len(_MESSAGES) + 1).cast("int"))
    e = table(spark, sf_dir, "events").withColumn("error", msg)
    return e.select(F.col("user_id").alias("run_id"), F.element_at(F.array(*[F.lit(s) for s in display.SOURCES]), (F.floor(F.col("event_id") / 8) % len(display.SOURCES) + 1).cast("int")).alias("source"), F.col("event_id").alias("seq"), "ts", "error", display.classify_source_error(F.col("error")).alias("kind"))


@register(f"WITH e AS (SELECT event_id, lower({_MSG_SQL}) AS m FROM events) SELECT event_id AS seq, {_KIND_SQL} AS kind FROM e")
def q_error_class(spark, sf_dir):
    """Kind of every error message."""
    return _errors(spark, sf_dir).select("seq", "kind")


_SOURCE_SQL = f"list_value({', '.join(repr(s) for s in display.SOURCES)})[CAST(event_id // 8 % {len(display.SOURCES)} AS INT) + 1]"


@register(f"""WITH e AS (SELECT user_id AS run_id, {_SOURCE_SQL} AS source, event_id, {_MSG_SQL} AS error, lower({_MSG_SQL}) AS m FROM events), k AS (SELECT *, {_KIND_SQL} AS kind FROM e),
g AS (SELECT run_id, source, kind, count(*) AS count, arg_max(error, event_id) AS error, min(event_id) AS f FROM k GROUP BY ALL)
SELECT run_id, source, kind, count, error FROM g QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY f DESC) <= 50""")
def q_issue_dedup(spark, sf_dir):
    """Issues by source and kind of each run, the last fifty to appear."""
    return events.source_issues(_errors(spark, sf_dir)).drop("ts")


@register("SELECT event_type AS backend, arg_max(user_id, event_id) AS status, CAST(arg_max(value, event_id) AS BIGINT) AS result_count FROM events GROUP BY event_type")
def q_health_latest(spark, sf_dir):
    """Latest report of each engine."""
    h = table(spark, sf_dir, "events").select(F.col("event_type").alias("backend"), F.col("user_id").alias("status"), F.round("value").cast("long").alias("result_count"), F.lit(0).alias("latency_ms"), "ts", F.col("event_id").alias("seq"))
    return events.latest_health(h).select("backend", "status", "result_count")


_RUN_SOURCES = ("arxiv", "meta_search", "doaj")


@register(f"""WITH h AS (SELECT user_id AS run_id, CASE event_id % 4 WHEN 0 THEN 'meta_search/bing' WHEN 1 THEN 'searxng_pool' WHEN 2 THEN 'arxiv' ELSE 'doaj' END AS s, event_id % 3 AS c FROM events)
SELECT run_id, CASE WHEN s IN ('meta_search/bing', 'searxng_pool') THEN 'meta_search' ELSE s END AS source, CAST(sum(c) AS BIGINT) AS hits FROM h GROUP BY ALL""")
def q_source_stats(spark, sf_dir):
    """Hits of each enabled source."""
    k = F.col("event_id") % 4
    s = F.when(k == 0, "meta_search/bing").when(k == 1, "searxng_pool").when(k == 2, "arxiv").otherwise("doaj")
    h = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), s.alias("source"), (F.col("event_id") % 3).alias("count"))
    return events.source_stats(h, F.array(*[F.lit(x) for x in _RUN_SOURCES]))


@register("""WITH h AS (SELECT user_id AS run_id, CASE event_id % 5 WHEN 0 THEN 'meta_search/bing' WHEN 1 THEN 'searxng_local' WHEN 2 THEN 'arxiv' WHEN 3 THEN 'brave' ELSE 'doaj' END AS s, CASE event_type WHEN 'view' THEN 'found' WHEN 'purchase' THEN 'done' ELSE 'inflight' END AS st FROM events)
SELECT run_id, CASE WHEN s IN ('arxiv', 'doaj') THEN s ELSE 'meta_search' END AS lane, count(*) FILTER (st = 'found') AS found, count(*) FILTER (st = 'done') AS done, count(*) FILTER (st = 'inflight') AS inflight FROM h GROUP BY ALL""")
def q_lanes(spark, sf_dir):
    """Documents found, done and in flight in each lane."""
    k = F.col("event_id") % 5
    s = F.when(k == 0, "meta_search/bing").when(k == 1, "searxng_local").when(k == 2, "arxiv").when(k == 3, "brave").otherwise("doaj")
    st = F.when(F.col("event_type") == "view", "found").when(F.col("event_type") == "purchase", "done").otherwise("inflight")
    h = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), s.alias("source"), st.alias("state"))
    return events.lanes(h, F.array(*[F.lit(x) for x in _RUN_SOURCES]))


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Download reports: twelve documents of each user, bytes from the event's value."""
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("progress")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), (F.col("event_id") % 12).alias("url"), F.col("event_id").alias("seq"), status.alias("status"), F.round(F.col("value") * 1000).cast("long").alias("bytes"), (F.col("event_id") % 10 == 0).alias("cached"), "ts")


@register("""WITH p AS (SELECT user_id AS run_id, event_id % 12 AS url, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'progress' END AS status, CAST(round(value * 1000) AS BIGINT) AS bytes, event_id % 10 = 0 AS cached FROM events),
g AS (SELECT run_id, url, arg_max(status, seq) AS st, arg_max(bytes, seq) AS b, arg_max(cached, seq) AS c, max(bytes) FILTER (status = 'progress') AS m FROM p GROUP BY ALL)
SELECT run_id, CAST(sum(greatest(CASE WHEN st = 'done' THEN CASE WHEN c THEN 0 ELSE b END WHEN st = 'progress' THEN m ELSE 0 END, 0)) AS BIGINT) AS bytes FROM g GROUP BY run_id""")
def q_bytes_reconcile(spark, sf_dir):
    """Bytes that each run moved."""
    return events.reconcile_bytes(_progress(spark, sf_dir))


@register("""WITH s AS (SELECT user_id AS run_id, CAST(floor((epoch_us(ts) % 3600000000) / 1e6 / 0.6) AS BIGINT) AS tick, CAST(round(value * 1000) AS BIGINT) AS b FROM events), g AS (SELECT run_id, tick, sum(b) / 6e5 AS mbps FROM s GROUP BY ALL)
SELECT run_id, tick, round(mbps, 9) AS mbps, round(avg(mbps) OVER (PARTITION BY run_id ORDER BY tick ROWS BETWEEN 31 PRECEDING AND CURRENT ROW), 9) AS avg_mbps FROM g""")
def q_throughput(spark, sf_dir):
    """MB a second of each run's ticks and their moving mean."""
    p = _progress(spark, sf_dir).select("run_id", ((_micros("ts") % 3600000000) / 1e6).alias("seconds"), "bytes")
    return events.throughput(p).select("run_id", "tick", F.round("mbps", 9).alias("mbps"), F.round("avg_mbps", 9).alias("avg_mbps"))


@register("""SELECT o_orderkey, CASE WHEN greatest(o_orderkey % 90 - o_custkey % 40 - o_orderkey % 7, 0) > 0 AND o_custkey % 4 > 0 THEN CAST(floor(greatest(o_orderkey % 90 - o_custkey % 40 - o_orderkey % 7, 0) *
CASE WHEN o_custkey % 40 > 0 THEN greatest(0.1, o_totalprice / 1e6 / (o_custkey % 40)) ELSE 2.0 END / (o_custkey % 4) + 0.5) AS BIGINT) END AS eta FROM orders""")
def q_eta(spark, sf_dir):
    """Seconds to go of made-up runs."""
    k = lambda c, m: F.col(c) % m
    return table(spark, sf_dir, "orders").select("o_orderkey", events.eta_seconds(k("o_orderkey", 90), k("o_custkey", 40), k("o_orderkey", 7), F.col("o_totalprice"), k("o_custkey", 40), k("o_custkey", 4)).alias("eta"))


@register("""WITH c AS (SELECT 'a/b.' || list_value('pdf', 'epub', 'htm', 'html', 'doc')[CAST(event_id % 5 AS INT) + 1] AS p FROM events WHERE event_type = 'purchase'), k AS (SELECT CASE WHEN p LIKE '%.htm%' THEN 'html' ELSE regexp_extract(p, '\\.(pdf|epub|txt)$', 1) END AS f FROM c)
SELECT t.f AS ftype, count(k.f) AS n FROM (VALUES ('pdf'), ('epub'), ('html'), ('txt')) t(f) LEFT JOIN k USING (f) GROUP BY t.f""")
def q_filetype_counts(spark, sf_dir):
    """Done documents by file type, absent types included."""
    ext = F.element_at(F.array(*[F.lit(e) for e in ("pdf", "epub", "htm", "html", "doc")]), (F.col("event_id") % 5 + 1).cast("int"))
    c = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "purchase", "done").otherwise("x").alias("status"), F.concat(F.lit("a/b."), ext).alias("local_path"))
    return events.filetype_counts(c)


@register("""SELECT user_id AS run_id, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error') AS failed, count(*) AS total,
CAST(round(100 * (count(*) FILTER (event_type IN ('purchase', 'error')))::DOUBLE / count(*)) AS INT) AS pct FROM events GROUP BY user_id""")
def q_run_counters(spark, sf_dir):
    """Done, failed and finished share of each run."""
    return events.run_counters(_progress(spark, sf_dir))


_FINAL_SQL = "event_type IN ('purchase', 'error')"


@register(f"""WITH RECURSIVE p AS (SELECT event_id AS seq, user_id, event_id % 12 AS url, epoch_ms(ts) AS ms, {_FINAL_SQL} AS final, row_number() OVER (PARTITION BY user_id, event_id % 12 ORDER BY event_id) AS n FROM events),
k AS (SELECT seq, user_id, url, n, ms AS last, true AS goes FROM p WHERE n = 1
  UNION ALL SELECT p.seq, p.user_id, p.url, p.n, CASE WHEN p.final OR p.ms - k.last >= 864000000 THEN p.ms ELSE k.last END, p.final OR p.ms - k.last >= 864000000 FROM k JOIN p ON p.user_id = k.user_id AND p.url = k.url AND p.n = k.n + 1)
SELECT seq FROM k WHERE goes""")
def q_throttle(spark, sf_dir):
    """Reports far enough after the last one let through, here ten days, and all final ones."""
    return events.throttle(_progress(spark, sf_dir).withColumn("ms", F.floor(_micros("ts") / 1000).cast("long")), 864000000).select("seq")


@register("SELECT event_id AS seq, CAST(epoch_us(ts) AS BIGINT) AS t FROM events QUALIFY row_number() OVER (ORDER BY ts DESC, event_id DESC) <= 200")
def q_runlog_tail(spark, sf_dir):
    """The last 200 entries of a log (a limit is the feature)."""
    return events.runlog_tail(table(spark, sf_dir, "events").select("ts", F.col("event_id").alias("seq")), 200).select("seq", _micros("ts").alias("t"))


@register("""WITH RECURSIVE c AS (SELECT 'u' || user_id AS backend, event_id AS seq, epoch_us(ts) / 1e8 AS ts, event_type = 'error' AS bad, event_type = 'click' AS good, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT DISTINCT backend, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS failures, CAST(0 AS DOUBLE) AS until, false AS open, false AS skipped FROM c
  UNION ALL SELECT c.backend, c.seq, c.n, CASE WHEN c.ts < s.until THEN s.failures WHEN c.good THEN 0 ELSE s.failures + CAST(c.bad AS BIGINT) END,
    CASE WHEN c.ts < s.until THEN s.until WHEN c.good THEN 0 WHEN c.bad AND s.failures >= 2 THEN c.ts + 300 ELSE s.until END,
    c.ts < s.until OR (c.bad AND s.failures >= 2), c.ts < s.until FROM s JOIN c ON c.backend = s.backend AND c.n = s.n + 1)
SELECT backend, seq, failures, open, skipped FROM s WHERE n > 0""")
def q_circuit_breaker(spark, sf_dir):
    """The breaker of each engine, here each user, over its calls."""
    outcome = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "click", "success").otherwise("neutral")
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("backend"), F.col("event_id").alias("seq"), (_micros("ts") / 1e8).alias("ts"), outcome.alias("outcome"))
    return events.circuit_breaker(e)


_EVENT_MAP = {"signup": "start", "view": "found", "click": "download_start", "purchase": "download_done", "error": "download_failed"}


@register("""WITH e AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id) AS s FROM events), l AS (SELECT * FROM e WHERE event_id >= coalesce(s, -1))
SELECT user_id AS run_id, CASE WHEN max(s) IS NULL THEN 'idle' ELSE 'querying' END AS phase, count(*) FILTER (event_type = 'view') AS found, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error') AS failed,
greatest(count(*) FILTER (event_type = 'click') - count(*) FILTER (event_type = 'purchase') - count(*) FILTER (event_type = 'error'), 0) AS active FROM l GROUP BY user_id""")
def q_run_fsm(spark, sf_dir):
    """State of each run, here each user, after its events."""
    kind = F.create_map(*[F.lit(x) for pair in _EVENT_MAP.items() for x in pair])
    return events.run_state(table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.try_element_at(kind, F.col("event_type")).alias("type")))


@register("SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%.0f B', n_chars::DOUBLE) WHEN n_chars / 1024.0 >= 100 THEN printf('%.0f KB', n_chars / 1024.0) ELSE printf('%.1f KB', floor(n_chars / 1024.0 * 10 + 0.5) / 10) END AS size FROM documents")
def q_format_bytes(spark, sf_dir):
    """Sizes with a unit."""
    return table(spark, sf_dir, "documents").select("doc_id", display.format_bytes(F.col("n_chars")).alias("size"))


# --- the pipeline -------------------------------------------------------------------------------

_FLAG_WORDS = ("the", "and", "tion", "la")


@register(f"""WITH k AS (SELECT *, {_URL_KEY_SQL} AS uk FROM pages QUALIFY row_number() OVER (PARTITION BY uk ORDER BY page_id) = 1),
docs AS (SELECT page_id, url, {_TITLE_SQL} AS title, {_STRIP_SQL} AS abstract, 's' || (page_id % 8) AS source, row_number() OVER (PARTITION BY page_id % 8 ORDER BY page_id) AS rk, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS h FROM k),
q AS (SELECT unnest(list_value({', '.join(repr(w) for w in _FLAG_WORDS)})) AS term),
tok AS (SELECT page_id, source, unnest({_TOKENS.format('title')}) AS term, 3 AS w FROM docs UNION ALL SELECT page_id, source, unnest({_TOKENS.format('abstract')}), 1 FROM docs),
tf AS (SELECT page_id, source, term, sum(w) AS tf FROM tok JOIN q USING (term) GROUP BY ALL), df AS (SELECT source, term, count(*) AS df FROM tf GROUP BY ALL), n AS (SELECT source, count(*) AS n FROM docs GROUP BY ALL),
sc AS (SELECT page_id, sum(tf * (ln((n + 1.0) / (df + 1.0)) + 1.0)) AS tfidf FROM tf JOIN df USING (source, term) JOIN n USING (source) GROUP BY page_id),
r AS (SELECT d.*, coalesce(tfidf, 0.0) AS tfidf, 1.0 / (60.0 + rk) AS rrf, {_AUTHORITY_SQL} AS authority FROM docs d LEFT JOIN sc USING (page_id)),
s AS (SELECT *, (tfidf + 0.001) * (rrf + 0.001) * authority AS score, max(tfidf) OVER (PARTITION BY source) AS top, greatest(0.05, 0.02 * max(tfidf) OVER (PARTITION BY source)) AS cut FROM r),
f AS (SELECT *, CASE WHEN top > 0 AND tfidf < cut THEN 'TF-IDF ' || printf('%.2f', tfidf) || ' below cutoff ' || printf('%.2f', cut) END AS reject_reason, row_number() OVER (PARTITION BY source ORDER BY score DESC, rrf DESC, authority DESC, page_id) AS pos FROM s)
SELECT page_id, title, url, source, round(tfidf, 6) AS tfidf, round(rrf, 6) AS rrf, CAST(round(authority, 6) AS DOUBLE) AS authority, round(score, 6) AS score, CASE WHEN reject_reason IS NULL THEN 'kept' ELSE 'rejected' END AS status, reject_reason,
CASE WHEN reject_reason IS NULL THEN CAST(count(*) FILTER (reject_reason IS NULL) OVER (PARTITION BY source ORDER BY pos) AS INT) END AS final_rank FROM f""")
def q_flagship(spark, sf_dir):
    """Pages deduplicated, ranked, flagged and placed in one plan."""
    return candidates.flagship(spark, sf_dir, _FLAG_WORDS)
