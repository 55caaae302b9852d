"""Query text columns: keywords, sub-queries and model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelode.functions.text import has_searchable_token, trimmed

# Words that say nothing in a query.
STOPWORDS = (
    "please", "find", "all", "the", "a", "an", "to", "for", "of", "and", "or", "in", "on", "with", "about", "relating", "related", "documents",
    "document", "pdfs", "pdf", "books", "book", "papers", "paper", "texts", "text", "be", "how", "can", "you", "me", "my", "i", "are", "is",
    "scholarly", "academic", "articles", "article", "any", "some", "that", "which", "this", "these", "those", "etc", "every", "kind", "kinds", "at",
    "by", "it", "as", "we", "he", "do", "if", "so", "up", "am",
)
WORD = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}'-]+"
SPLIT = r"(?i)[,;]|(?U)\s+and\s+|(?U)\s+&\s+"
MAX_SUBQUERIES, MAX_TOPICS, MAX_EXPANSIONS = 8, 16, 48
#: Lines that a model may add to a search, by width of the search.
EXPANSION_DEPTH = {"light": 24, "balanced": 32, "deep": 40}


def parse_query(q: Column) -> Column:
    """Keywords: lower case, stop words out, repeats kept."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(q, F.lit(""))), F.lit(WORD), F.lit(0)), lambda w: ~F.array_contains(stop, w))


def keywords_or_words(q: Column) -> Column:
    """Keywords, or the words of a query that has none."""
    kws = parse_query(q)
    return F.when(F.size(kws) > 0, kws).otherwise(F.filter(F.split(q, r"(?U)\s+"), lambda w: w != ""))


def expand_query(q: Column) -> Column:
    """Topics of a query, split at commas, semicolons, "and" and "&"; never empty."""
    parts = F.filter(F.transform(F.split(q, SPLIT), lambda s: F.regexp_replace(s, r"^[ .]+|[ .]+$", "")), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(q))


def signature(keywords: Column) -> Column:
    """What two sub-queries share that ask for the same: their keywords, lower case, in order."""
    return F.array_join(F.array_sort(F.transform(keywords, lambda k: F.lower(k))), " ")


def expand_query_broad(df: DataFrame, key: str, query: str) -> DataFrame:
    """Sub-queries: ``key, sub_idx, sub_query, keywords``.

    Each topic's phrase first (16 at most), then phrases of three or more keywords with one left
    out, in order, until there are ``max(8, topics)``. Of those with the same keywords the
    first stays. A query that gives none is its own sub-query.
    """
    topics = df.select(key, F.col(query).alias("q"), F.posexplode(expand_query(F.col(query))).alias("topic", "part"))
    topics = topics.withColumn("phrase", trimmed(F.col("part"))).withColumn("kws", keywords_or_words(F.col("part")))
    full = topics.where((F.col("topic") < MAX_TOPICS) & (F.size("kws") > 0)).select(key, F.lit(0).alias("pass"), "topic", F.lit(-1).alias("drop"), F.col("phrase").alias("sub_query"), "kws")
    dropped = topics.where(F.size("kws") >= 3).select(key, "topic", "kws", F.posexplode("kws").alias("drop", "_"))
    dropped = dropped.withColumn("kws", F.filter("kws", lambda k, j: j != F.col("drop"))).select(key, F.lit(1).alias("pass"), "topic", "drop", F.array_join("kws", " ").alias("sub_query"), "kws")
    order = ["pass", "topic", "drop"]
    first = F.row_number().over(Window.partitionBy(key, "sig").orderBy(*order))
    every = full.unionByName(dropped).withColumn("sig", signature(F.col("kws"))).withColumn("first", first).where("first = 1")
    w = Window.partitionBy(key)
    every = every.withColumn("cap", F.greatest(F.lit(MAX_SUBQUERIES), F.sum(F.when(F.col("pass") == 0, 1).otherwise(0)).over(w)))
    every = every.withColumn("sub_idx", F.row_number().over(w.orderBy(*order)) - 1).where("sub_idx < cap")
    bare = df.select(key, F.lit(0).alias("sub_idx"), F.col(query).alias("sub_query"), keywords_or_words(F.col(query)).alias("keywords")).join(every.select(key).distinct(), key, "left_anti")
    return every.select(key, "sub_idx", "sub_query", F.col("kws").alias("keywords")).unionByName(bare)


def is_valid_request(q: Column, n_sources: Column) -> Column:
    """Whether a query isn't blank, has a token that can be ranked by, and a source."""
    return (trimmed(F.coalesce(q, F.lit(""))) != "") & has_searchable_token(q) & (n_sources > 0)


def _bare_line(x: Column) -> Column:
    quoted = trimmed(F.regexp_replace(trimmed(x), r"^[0-9.)\-*•]+", ""))
    return trimmed(F.regexp_replace(F.regexp_replace(quoted, '^"+|"+$', ""), "^'+|'+$", ""))


def parse_expansion(df: DataFrame, key: str, raw: str, original: str, most: int = MAX_EXPANSIONS) -> DataFrame:
    """Sub-queries in a model's reply: ``key, idx, sub_query``.

    One a line, up to a line that begins another topic; numbering, bullets and quotes go, as do
    blank lines, section headers, lines shorter than 3 or longer than 200 bytes, repeats and the
    query itself, letter case aside.
    """
    lines = df.select(key, original, F.posexplode(F.split(raw, "\r?\n")).alias("pos", "line")).withColumn("line", trimmed(F.col("line")))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("over", F.max(F.lower("line").startswith("topic:")).over(before)).where("not over")
    lines = lines.where((F.col("line") != "") & ~F.lower("line").startswith("queries:")).withColumn("sub_query", _bare_line(F.col("line")))
    lines = lines.where(F.octet_length("sub_query").between(3, 200) & (F.lower("sub_query") != F.lower(trimmed(F.col(original)))))
    once = F.row_number().over(Window.partitionBy(key, F.lower("sub_query")).orderBy("pos"))
    lines = lines.withColumn("once", once).where("once = 1")
    return lines.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1).where(F.col("idx") < most).select(key, "idx", "sub_query")


def parse_spellfix(raw: Column, original: Column) -> Column:
    """The corrected query in a model's reply; null unless it is a sane line that differs."""
    lines = F.transform(F.split(raw, "\r?\n"), lambda x: trimmed(F.regexp_replace(F.regexp_replace(trimmed(x), '^"+|"+$', ""), "^'+|'+$", "")))
    line = F.get(F.filter(lines, lambda x: x != ""), F.lit(0))
    low = F.lower(line)
    prose = F.lit(False)
    for word in ("query", "corrected", "sorry", "cannot", "i ", "the corrected"):
        prose = prose | low.contains(word)
    fits = (F.octet_length(line) <= F.octet_length(trimmed(original)) + 24) & (low != F.lower(trimmed(original))) & ~prose
    return F.when(fits, line)


def parse_yes(raw: Column) -> Column:
    """Whether a reply's first word is y, yes or true."""
    return F.lower(F.regexp_extract(trimmed(F.coalesce(raw, F.lit(""))), r"^(\p{IsAlphabetic}*)", 1)).isin("y", "yes", "true")


def filter_prompt(query: Column, title: Column, abstract: Column) -> Column:
    """A yes-or-no question on a document's fit; abstracts are cut to 800 characters."""
    body = F.when(F.coalesce(trimmed(abstract), F.lit("")) == "", "(none given)").otherwise(F.substring(abstract, 1, 800))
    return F.format_string("Is this document on the topic searched for?\nTopic: %s\nTitle: %s\nAbstract: %s\nAnswer yes or no:", query, title, body)


def expansion_prompt(query: Column) -> Column:
    """Asks for further searches on a topic, one a line."""
    return F.format_string("List different searches that would find documents on the topic, one a line.\nTopic: %s\nQueries:\n", query)


def spellfix_prompt(query: Column) -> Column:
    """Asks for a query with its spelling mended."""
    return F.format_string("Mend the spelling of this search and change nothing else. Give one line.\nSearch: %s\nMended:", query)
