"""The five-step matcher for runs of any size: the same documents as the fold in ``dedup``, from its keys alone.

What the fold does to a row depends only on earlier rows that share a key with it, which lets
most rows leave it:

* rows of one address join the document of the first; likewise, among those, rows of one DOI:
  that DOI is known from its first row on, whatever became of it;
* of rows that agree in title, fingerprint, surname and year only the first can change what the
  fold knows about titles and fingerprints;
* rows without either key are new documents.

What is left are distinct tuples, linked by titles and fingerprints. Their components are found
by distributed rounds and folded one after the other from sorted partitions, each by itself. That
tells which tuples became documents, thereby each title's and fingerprint's anchor, and joins
with the anchors give every row its document. The cap is a place in the run's order: since no
row depends on a later one, rows after it are simply cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelode.functions.text import is_sentinel_title
from citelode.operators.dedup import SHORT_TITLE, with_keys
from citelode.operators.schemas import DOCUMENT_FIELDS
from citelode.operators.staging import components, numbered, written

_TUPLE = ("norm", "fingerprint", "surname", "year")


def _first_by(df: DataFrame, by: list[str], rest: list[str]) -> DataFrame:
    """The row of the least ``seq`` for each ``by``; partial minima, so a hot key meets as one row from each task."""
    return df.groupBy(*by).agg(F.min(F.struct("seq", *rest)).alias("r")).select(*by, "r.*")


def _same(a: DataFrame, b: DataFrame, on: list[str]) -> Column:
    out = F.lit(True)
    for c in on:
        out = out & a[c].eqNullSafe(b[c])
    return out


def _new_tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fold itself, over the tuples of one component after the other: those that become documents."""
    now, titles, marks = None, {}, {}
    for batch in batches:
        new = []
        for at, (component, norm, fingerprint, surname, year, titled) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("component", "norm", "fingerprint", "surname", "year", "titled")), strict=True)):
            if component != now:
                now, titles, marks = component, {}, {}
            if titled and (anchor := titles.get(norm)) is not None:
                same = (year is not None and year == anchor[0]) or (surname is not None and surname == anchor[1])
                if same or len(norm.split()) >= SHORT_TITLE:
                    continue
            if fingerprint is not None and (other := marks.get(fingerprint)) and norm and (norm.startswith(other) or other.startswith(norm)):
                continue
            new.append(at)
            if titled:
                titles.setdefault(norm, (year, surname))
            if fingerprint is not None:
                marks.setdefault(fingerprint, norm)
        yield batch.take(pa.array(new, pa.int64())).select(["run_id", "seq", "norm", "fingerprint", "surname", "year", "titled"])


def matched(discoveries: DataFrame, max_total: int | None = None) -> DataFrame:
    """Each discovery that counts, with its document: ``run_id, arrival_seq, doc_seq, insert_idx, source_id, rank_in_source``.

    ``doc_seq`` is the ``arrival_seq`` of the row that became the document, ``insert_idx`` its
    number. Rows after a run's document number ``max_total`` don't count. ``arrival_seq`` are
    distinct within a run; null addresses are one address, as in the fold; rows without a
    ``run_id`` are one run. An empty table gives no rows.
    """
    year = F.when(F.octet_length("year") == 4, F.col("year"))
    keyed = with_keys(discoveries).select("run_id", F.col("arrival_seq").alias("seq"), "url", "doi", "norm", "fingerprint", "surname", year.alias("year"), "source_id", "rank_in_source")
    rows = written(keyed, "matcher-keys")
    firsts = written(_first_by(rows, ["run_id", "url"], ["doi", *_TUPLE]), "matcher-addresses")
    with_doi = _first_by(firsts.where("doi is not null"), ["run_id", "doi"], list(_TUPLE))
    heads = with_doi.select("run_id", "seq", *_TUPLE).unionByName(firsts.where("doi is null").select("run_id", "seq", *_TUPLE))
    heads = written(heads.withColumn("titled", F.coalesce(~is_sentinel_title(F.col("norm")), F.lit(False))), "matcher-heads")

    tuples = heads.where("titled or fingerprint is not null").groupBy("run_id", *_TUPLE, "titled").agg(F.min("seq").alias("seq"))
    title = F.when(F.col("titled"), F.xxhash64("run_id", F.lit("title"), "norm"))
    mark = F.when(F.col("fingerprint").isNotNull(), F.xxhash64("run_id", F.lit("mark"), "fingerprint"))
    tuples = tuples.withColumn("a", F.coalesce(title, mark)).withColumn("b", F.coalesce(mark, title))
    roots = components(tuples.select("a", "b"))
    placed = tuples.join(roots.select(F.col("node").alias("a"), "root"), "a", "left").withColumn("component", F.coalesce("root", "a"))
    placed = placed.select("component", "run_id", "seq", *_TUPLE, "titled").repartition("component").sortWithinPartitions("component", "seq")
    kind = {f.name: f.dataType.simpleString() for f in placed.schema}
    new = placed.mapInArrow(_new_tuples, ", ".join(f"{c} {kind[c]}" for c in ("run_id", "seq", *_TUPLE, "titled")))
    new = written(new, "matcher-anchors")

    titles = _first_by(new.where("titled"), ["run_id", "norm"], ["year", "surname"]).select(F.col("run_id").alias("t_run"), F.col("norm").alias("t_norm"), F.col("seq").alias("t_seq"), F.col("year").alias("t_year"), F.col("surname").alias("t_surname"))
    marks = _first_by(new.where("fingerprint is not null"), ["run_id", "fingerprint"], ["norm"]).select(F.col("run_id").alias("m_run"), F.col("fingerprint").alias("m_mark"), F.col("seq").alias("m_seq"), F.col("norm").alias("m_norm"))
    out = heads.join(titles, heads.run_id.eqNullSafe(F.col("t_run")) & (heads.norm == F.col("t_norm")) & heads.titled, "left")
    out = out.join(marks, out.run_id.eqNullSafe(F.col("m_run")) & (out.fingerprint == F.col("m_mark")), "left")
    long = F.size(F.split("norm", " ")) >= SHORT_TITLE
    by_title = (F.col("t_seq") < F.col("seq")) & (long | (F.col("year") == F.col("t_year")) | (F.col("surname") == F.col("t_surname")))
    alike = (F.col("norm") != "") & (F.col("m_norm") != "") & (F.col("norm").startswith(F.col("m_norm")) | F.col("m_norm").startswith(F.col("norm")))
    by_mark = (F.col("m_seq") < F.col("seq")) & alike
    heads = out.select("run_id", F.col("seq").alias("head"), F.when(by_title, F.col("t_seq")).when(by_mark, F.col("m_seq")).otherwise(F.col("seq")).alias("doc_seq"))

    leads = with_doi.select(F.col("run_id").alias("h_run"), F.col("doi").alias("h_doi"), F.col("seq").alias("h_seq"))
    urls = firsts.join(leads, firsts.run_id.eqNullSafe(F.col("h_run")) & (firsts.doi == F.col("h_doi")), "left")
    urls = urls.select("run_id", "url", F.coalesce("h_seq", "seq").alias("head"))
    urls = urls.join(heads, _same(urls, heads, ["run_id", "head"])).select(urls.run_id.alias("u_run"), urls.url.alias("u_url"), "doc_seq")
    all_rows = rows.join(urls, rows.run_id.eqNullSafe(F.col("u_run")) & rows.url.eqNullSafe(F.col("u_url"))).select("run_id", F.col("seq").alias("arrival_seq"), "doc_seq", "source_id", "rank_in_source")
    documents = heads.where("head = doc_seq").select("run_id", "doc_seq")
    documents = numbered(documents, "run_id", "doc_seq", "insert_idx").select(F.col("run_id").alias("d_run"), F.col("doc_seq").alias("d_seq"), F.col("insert_idx").cast("int").alias("insert_idx"))
    out = all_rows.join(documents, all_rows.run_id.eqNullSafe(F.col("d_run")) & (F.col("doc_seq") == F.col("d_seq"))).drop("d_run", "d_seq")
    if max_total is not None:
        last = documents.where(F.col("insert_idx") == max_total - 1).select(F.col("d_run").alias("c_run"), F.col("d_seq").alias("c_seq"))
        out = out.where(F.col("insert_idx") < max_total).join(last, out.run_id.eqNullSafe(F.col("c_run")), "left").where("c_seq is null or arrival_seq <= c_seq").drop("c_run", "c_seq")
    return out


def resolve_large(discoveries: DataFrame, max_total: int | None = None) -> DataFrame:
    """``dedup.resolve`` for runs of any size: ``run_id, insert_idx``, the first copy's fields, ``source_ranks``.

    A document's ranks are one array in arrival order, as the fold gives them; ``matched`` has
    them as rows. Titles, abstracts and authors are only read for rows that became documents.
    """
    rows = written(matched(discoveries, max_total), "matcher-rows")
    rank = F.struct("arrival_seq", F.col("source_id").alias("source"), F.col("rank_in_source").alias("rank"))
    ranks = rows.groupBy("run_id", "doc_seq", "insert_idx").agg(F.array_sort(F.collect_list(rank)).alias("r"))
    ranks = ranks.select(F.col("run_id").alias("r_run"), "doc_seq", "insert_idx", F.transform("r", lambda x: F.struct(x["source"].alias("source"), x["rank"].alias("rank"))).alias("source_ranks"))
    out = discoveries.join(ranks, discoveries.run_id.eqNullSafe(F.col("r_run")) & (discoveries.arrival_seq == ranks.doc_seq))
    return out.select("run_id", "insert_idx", *DOCUMENT_FIELDS, "source_ranks")
