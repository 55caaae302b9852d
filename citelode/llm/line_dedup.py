"""Removal of recurring lines with a log-template tree, in DataFrame operations alone.

A line's tokens that hold a digit become ``<*>``. The tree has a fixed depth: token count first,
then the leading tokens; its leaves hold the masked lines. A masked line that recurs across
documents is a template. Below a leaf, other fields
vary without a digit: a position whose token is the same in nearly all of the leaf's lines is
constant, the others are ``<*>``; where enough positions beyond the leading ones are constant,
the lines that agree with all of them share a template. The other lines of a leaf, and leaves
without a template, are split by further tokens, so a leaf holds any number of them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from citelode.llm.common import discard, meet, stage

DEPTH = 3
#: Distinct texts that a template must occur in.
MIN_DOCS = 10
#: Share of a leaf's lines that make a position constant, and of positions beyond the leading
#: tokens that must be.
AGREE, CONSTANT = 0.8, 0.6
#: A document with more than this share of its characters in recurring lines counts as one with
#: those whose longest recurring line is of the same template.
MOST = 0.5


def masked(line: Column) -> Column:
    """The line with single spaces between tokens, trimmed, tokens with a digit as ``<*>``."""
    odd = F.contains(line, F.lit("  "))
    for control in "\t\x0b\f\r":
        odd = odd | F.contains(line, F.lit(control))
    even = F.trim(F.when(odd, F.regexp_replace(line, "[\\x20\\x09-\\x0D]+", " ")).otherwise(line))
    return F.when(even.rlike("[0-9]"), F.regexp_replace(even, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(even)


def _lines(df: DataFrame, text: str) -> DataFrame:
    """Each line of each row that isn't blank: text key, place, template, leaf, token count."""
    exploded = df.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("rk"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    shaped = exploded.select("rk", "pos", F.length("line").alias("size"), masked(F.col("line")).alias("shape")).where("shape <> ''")
    n = F.length("shape") - F.length(F.replace("shape", F.lit(" "), F.lit(""))) + 1
    return shaped.withColumn("n", n).withColumn("leaf", F.xxhash64("n", F.substring_index("shape", " ", DEPTH))).withColumn("tpl", F.xxhash64("shape"))


def recurring(df: DataFrame, text: str = "text", min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """Lines ``(rk, pos, size, shape, n, leaf, tpl)``, and the masked lines ``tpl`` of each template ``grp`` that recurs.

    Equal texts count as one document. Recurrence is counted over all documents. Both are staged;
    what else was written on the way is deleted again.
    """
    keys = stage(_lines(df, text), "line-keys")
    per_tpl = keys.select("leaf", "n", "tpl", "rk").distinct().groupBy("leaf", "n", "tpl").agg(F.count(F.lit(1)).alias("docs"))
    per_tpl = stage(per_tpl, "line-templates")
    exact = per_tpl.where(F.col("docs") >= min_docs).select("tpl", F.col("tpl").alias("grp"))

    # written first, so its size is known and decides how the lines meet it
    leaves = per_tpl.where(F.col("n") > DEPTH).groupBy("leaf").agg(F.sum("docs").alias("total"), F.count(F.lit(1)).alias("kinds"))
    leaves = stage(leaves.where((F.col("total") >= min_docs) & (F.col("kinds") > 1)), "line-leaves", clean=False)
    shapes = meet(keys, leaves, "leaf", F.col("rk"), "left_semi").select("tpl", "shape").distinct()
    varied = per_tpl.join(leaves, "leaf").join(shapes, "tpl")
    lines = varied.select(F.col("leaf").alias("node"), F.lit(DEPTH).alias("given"), "n", "tpl", "docs", F.split("shape", " ").alias("tokens"))
    found = exact.select("tpl", F.col("tpl").alias("grp"))
    groups = []
    for group in _groups(stage(lines, "line-nodes", clean=False), min_docs):
        groups.append(group)
        found = found.unionByName(group)
    found = stage(found.distinct(), "line-recurring", clean=False)
    discard(per_tpl, leaves, *groups)
    return keys, found


def _groups(lines: DataFrame, min_docs: int) -> Iterator[DataFrame]:
    """Lines ``tpl`` that share a generalised template, and its group ``grp``, round by round.

    A node starts as a leaf. Where it is a template, the lines that agree with it leave and the
    others are looked at again; where it is none, it is split at one more position, by each token
    that ``min_docs`` texts or more have there. Constant positions count beyond the ``given``
    ones, which lead to the node. Nodes of fewer texts than ``min_docs`` end. Each round lets
    lines leave or splits at a position that isn't given, so rounds end. A node says at most a
    token for each of its lines' positions; its lines are dealt over salts where they meet it.
    Staged ``lines`` are deleted once the next round's are written.
    """
    by_line = F.col("tpl")
    while True:
        total = lines.groupBy("node").agg(F.sum("docs").alias("total"), F.max("n").alias("n"), F.max("given").alias("given")).where(F.col("total") >= min_docs)
        kinds = lines.select("node", "docs", F.posexplode("tokens").alias("at", "token")).groupBy("node", "at", "token").agg(F.sum("docs").alias("same"))
        kinds = stage(kinds.where(F.col("same") >= AGREE * min_docs).join(total, "node"), "line-kinds", clean=False)
        places = kinds.groupBy("node", "at").agg(F.max_by("token", "same").alias("token"), F.max("same").alias("top"), *[F.max(c).alias(c) for c in ("total", "n", "given")])
        fixed = F.col("top") >= AGREE * F.col("total")
        # where no token is constant, those that many lines hold tell lines apart
        apart = F.when(~fixed & (F.col("top") >= min_docs), F.struct("top", (-F.col("at")).alias("back")))
        nodes = places.groupBy("node").agg(F.collect_list(F.when(fixed, F.struct("at", "token"))).alias("fixed"), F.max(apart).alias("best"), F.max("n").alias("__n"), F.max("given").alias("__given"))
        enough = (F.size("fixed") - F.col("__given") >= CONSTANT * (F.col("__n") - F.col("__given"))) & (F.col("__n") > F.col("__given"))
        nodes = nodes.select("node", F.when(enough, F.col("fixed")).alias("fixed"), (-F.col("best.back")).alias("cut"))
        agrees = F.forall("fixed", lambda c: F.get("tokens", c["at"]) == c["token"])
        read = stage(meet(lines, nodes, "node", by_line).withColumn("agrees", F.coalesce(agrees, F.lit(False))).drop("fixed"), "line-held", clean=False)
        full = read.where("agrees").groupBy("node").agg(F.sum("docs").alias("support")).where(F.col("support") >= min_docs)
        held = meet(read, full, "node", by_line, "left")
        yield stage(held.where("agrees and support is not null").select("tpl", F.col("node").alias("grp")), "line-group", clean=False)

        left = held.where("(support is not null and not agrees) or (support is null and cut is not null)")
        way = F.xxhash64("node", "cut", F.get("tokens", F.col("cut")))
        ways = kinds.where(F.col("same") >= min_docs).select(F.xxhash64("node", "at", "token").alias("way"), F.lit(1).alias("more"))
        moved = meet(left.withColumn("way", F.when(F.col("support").isNull(), way).otherwise(by_line)), ways, "way", by_line, "left")
        split = F.col("more").isNotNull() & F.col("support").isNull()
        moved = moved.select(F.when(split, F.col("way")).otherwise(F.xxhash64("node", F.lit(-1))).alias("node"), F.when(split, F.col("given") + 1).otherwise(F.col("given")).alias("given"), "n", "tpl", "docs", "tokens")
        several = moved.groupBy("node").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1").select("node")
        last, lines = lines, stage(meet(moved, several, "node", by_line, "left_semi"), "line-nodes", clean=False)
        discard(last, kinds, read)
        if lines.isEmpty():
            discard(lines)
            return


def _framing(keys: DataFrame, found: DataFrame, sizes: DataFrame, min_docs: int, most: float) -> DataFrame:
    """Per text ``rk`` the lines ``__gone`` of templates that recur when a family of copies counts as one document; staged.

    A document of which more than ``most`` is recurring lines belongs to the family of its
    longest one's template (of equally long ones the last by name, a template's first line); any
    other is a family of its own.
    """
    by_text = F.col("rk")
    hit = stage(meet(keys.select("rk", "pos", "size", "shape", "tpl"), found, "tpl", by_text).drop("tpl"), "line-hits")
    names = hit.groupBy("grp").agg(F.min("shape").alias("name"))
    lines = meet(hit.select("rk", "pos", "size", "grp"), names, "grp", by_text).groupBy("rk", "pos").agg(F.max("size").alias("size"), F.min("name").alias("name"))
    docs = lines.groupBy("rk").agg(F.sum("size").alias("held"), F.max(F.struct("size", "name")).alias("longest")).join(sizes, "rk")
    family = docs.select("rk", F.when(F.col("held") > most * F.col("chars"), F.xxhash64(F.lit("family"), "longest.name")).otherwise(by_text).alias("family"))
    members = hit.select("rk", "grp").distinct().join(family, "rk").select("grp", "family").distinct()
    framing = members.groupBy("grp").agg(F.count(F.lit(1)).alias("families")).where(F.col("families") >= min_docs).select("grp")
    gone = meet(hit.select("rk", "pos", "grp"), framing, "grp", by_text, "left_semi").select("rk", "pos").distinct()
    gone = stage(gone.groupBy("rk").agg(F.collect_list("pos").alias("__gone")), "line-gone")
    discard(hit)
    return gone


def drop_recurring(df: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, most: float = MOST) -> DataFrame:
    """All rows and columns of ``df``, ``text`` without recurring lines; ``n_lines``, ``n_dropped`` added.

    Lines end at line feeds; blank ones stay. Every occurrence of a recurring template goes,
    whatever share of a document that is, so equal texts stay equal. Near copies don't make
    their own lines recur: documents of which more than ``most`` (characters) recurs count as
    one for each longest template among them. Null and empty texts stay, with no lines and one.
    Repeated rows fare alike; keys play no part. Columns of ``df`` with the new names are
    replaced; its names must not begin with two underscores.
    """
    df = df.drop(*({"n_lines", "n_dropped"} - {text}))
    keys, found = recurring(df, text, min_docs)
    sizes = df.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("rk"), F.length(text).alias("chars")).distinct()
    hit = _framing(keys, found, sizes, min_docs, most).withColumnRenamed("rk", "__rk")
    discard(keys, found)  # the rows are read again, but their lines no more
    # rows without a text, and copies of one text, don't gather in one task; a row's own hash
    # deals them out, which a recomputed task gives again
    own = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, MapType)])
    rows = meet(df.withColumn("__rk", F.when(F.col(text).isNull(), own).otherwise(F.xxhash64(text))), hit, "__rk", own, "left")
    cut = F.col("__gone").isNotNull() & F.col(text).isNotNull()
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    rows = rows.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(F.split(text, "\n"))))
    rows = rows.withColumn("n_dropped", F.when(cut, F.size("__gone")).otherwise(0)).withColumn(text, F.when(cut, kept).otherwise(F.col(text)))
    return rows.select(*df.columns, "n_lines", "n_dropped")


SQL = f"""
WITH texts AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
raw AS (SELECT text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM texts),
shaped AS (SELECT text, pos, length(line) AS size,
  regexp_replace(trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS shape FROM raw),
lines AS (SELECT *, len(string_split(shape, ' ')) AS n, array_to_string(list_slice(string_split(shape, ' '), 1, {DEPTH}), ' ') AS lead FROM shaped WHERE shape <> ''),
per_tpl AS (SELECT n, lead, shape, count(DISTINCT text) AS docs FROM lines GROUP BY ALL),
leaves AS (SELECT n, lead, sum(docs) AS total FROM per_tpl WHERE n > {DEPTH} GROUP BY ALL HAVING sum(docs) >= {MIN_DOCS} AND count(*) > 1),
tokens AS (SELECT n, lead, shape, docs, total, unnest(string_split(shape, ' ')) AS token, generate_subscripts(string_split(shape, ' '), 1) AS place
  FROM per_tpl JOIN leaves USING (n, lead)),
constant AS (SELECT n, lead, place, token FROM tokens GROUP BY ALL HAVING sum(docs) >= {AGREE} * max(total)),
enough AS (SELECT n, lead, count(*) AS fixed FROM constant GROUP BY ALL HAVING count(*) - {DEPTH} >= {CONSTANT} * (n - {DEPTH})),
agree AS (SELECT n, lead, shape, max(docs) AS docs FROM tokens JOIN constant USING (n, lead, place, token) JOIN enough USING (n, lead)
  GROUP BY n, lead, shape HAVING count(*) = max(fixed)),
found AS (SELECT shape, shape AS grp FROM per_tpl WHERE docs >= {MIN_DOCS}
  UNION SELECT shape, chr(10) || n || ' ' || lead FROM agree JOIN (SELECT n, lead FROM agree GROUP BY ALL HAVING sum(docs) >= {MIN_DOCS}) USING (n, lead)),
hit AS (SELECT text, pos, size, grp, min(shape) OVER (PARTITION BY grp) AS name FROM lines JOIN found USING (shape)),
held AS (SELECT text, pos, max(size) AS size, min(name) AS name FROM hit GROUP BY text, pos),
family AS (SELECT text, CASE WHEN sum(size) > {MOST} * length(text) THEN chr(10) || max({{'size': size, 'name': name}}).name ELSE text END AS family FROM held GROUP BY text),
framing AS (SELECT grp FROM hit JOIN family USING (text) GROUP BY grp HAVING count(DISTINCT family) >= {MIN_DOCS}),
gone AS (SELECT text, list(DISTINCT pos) AS gone FROM hit WHERE grp IN (SELECT grp FROM framing) GROUP BY text),
kept AS (SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS parts, g.gone FROM documents d LEFT JOIN gone g USING (text))
SELECT doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(parts) END AS INTEGER) AS n_lines, CAST(coalesce(len(gone), 0) AS INTEGER) AS n_dropped,
  sha256(CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(parts, lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END) AS kept_sha256
FROM kept
"""
