"""Parsers of web engines' result pages: a column of HTML in, documents out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelode.functions.text import clean_title
from citelode.functions.urls import looks_like_doc

#: How each engine marks its results: the class of an anchor, or a heading that holds the first one.
ENGINES = {"web": "result__a", "brave": "result-header", "mojeek": "ob", "startpage": "w-gl__result-title", "bing": None, "marginalia": None}
ANCHOR = r"(?is)<a\s+([^>]*)>(.*?)</a>"


def unwrap(href: Column) -> Column:
    """The target of a wrapped result's link."""
    bare = F.regexp_replace(href, "^/+", "")
    target = F.regexp_extract(bare, r"uddg=([^&]*)", 1)
    return F.when(bare.contains("uddg="), F.try_url_decode(target)).when(bare.startswith("http"), bare).otherwise(F.concat(F.lit("https://"), bare))


def results(df: DataFrame, engine: str, html: str = "html", native: bool = False) -> DataFrame:
    """Documents on a page of results: those with a title whose address plausibly leads to a document.

    ``rank_in_source`` counts from 1 in page order; all other columns of ``df`` stay.
    """
    kept = [c for c in df.columns if c != html]
    x = F.col(html)
    mark = ENGINES[engine]
    if mark:
        anchors = F.filter(F.regexp_extract_all(x, F.lit(ANCHOR), F.lit(0)), lambda a: F.regexp_extract(a, ANCHOR, 1).rlike(rf'(?i)class="[^"]*\b{mark}\b[^"]*"'))
    else:
        heads = F.regexp_extract_all(x, F.lit(r"(?is)<h2\b[^>]*>(.*?)</h2>"), F.lit(1))
        anchors = F.filter(F.transform(heads, lambda h: F.regexp_extract(h, ANCHOR, 0)), lambda a: a != "")
    link = r'(?i)href="([^"]+)"' if engine == "web" else r'(?i)href="(https?://[^"]+)"'
    rows = df.select(*kept, F.posexplode(anchors).alias("__at", "__a"))
    href = F.regexp_extract(F.regexp_extract("__a", ANCHOR, 1), link, 1)
    rows = rows.withColumn("__h", href).where("__h <> ''").withColumn("url", unwrap(F.col("__h")) if engine == "web" else F.col("__h"))
    rows = rows.withColumn("title", clean_title(F.regexp_extract("__a", ANCHOR, 2), native)).where((F.col("title") != "") & looks_like_doc(F.col("url")))
    gathered = rows.groupBy(*kept).agg(F.array_sort(F.collect_list(F.struct("__at", "title", "url"))).alias("__r"))
    return gathered.select(*kept, F.posexplode("__r").alias("__i", "__d")).select(*kept, (F.col("__i") + 1).alias("rank_in_source"), "__d.title", "__d.url", F.lit(engine).alias("source"))
