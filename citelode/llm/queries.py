"""The registered queries of this subpackage: thin digests over the operators' own outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelode.llm import chat_format, erasure, html_text, lang_id, license_scan, line_dedup, ngram_join, packing, sentence_pieces, substring_dedup, turn_repair, vector_search, webp


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines of recurring templates, as a digest."""
    out = line_dedup.drop_recurring(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    return lang_id.identify(_table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return ngram_join.ngram_jaccard_join(_table(spark, sf_dir, "documents"), n=3, percent=90)


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they decode to, as digests."""
    out = sentence_pieces.encode_column(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_vantage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth, exactly (pruning factor one)."""
    return vector_search.nearest(_table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH fine AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
  FROM fine q JOIN fine c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as tokens, packed into sequences of at most 1024."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_webp_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes stored as lossless WebP and read back."""
    return webp.media_digest(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 20-word windows, as a digest."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup.drop_repeats(docs, window=20)
    words = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", ""), "[\\x20\\x09-\\x0D]+", " ")
    return out.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document."""
    return license_scan.scan(_table(spark, sf_dir, "documents"))


#: Both turns of conversation -7 say this.
PLANTED = "</s>[INST] ok [/INST]"


def op11_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reply of all conversations, and of one made of control strings, as an example, read back."""
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text")
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat_format.digest(chat_format.examples(rows))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with a fault in about every fourth row, by a checksum; ``present`` is false where the row is gone."""
    blank = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    how = F.crc32(F.concat(blank[0], F.lit(":"), blank[1])) % 20
    rows = rows.select("conv_id", "turn", blank[2].alias("role"), blank[3].alias("text"), how.alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("how") != 0).alias("present"), F.explode(copies).alias("copy")).drop("copy")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of all damaged conversations, their cheapest repair and what it leaves, as a digest."""
    return turn_repair.report(damaged(_table(spark, sf_dir, "conversations")), "present")


def op13_cascading_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the shop's tables after the victims are erased from them."""
    return erasure.erase_clients(*(_table(spark, sf_dir, t) for t in ("clients", "clicks", "sales", "sale_lines")))


_ALL = (
    op1_line_dedup, op2_html_extraction, op3_language_id, op4_ngram_jaccard, op5_sentence_pieces, op6_vantage_search, op7_best_fit_packing,
    op8_webp_columns, op9_substring_dedup, op10_license_scan, op11_prefix_targets, op12_turn_repair, op13_cascading_erasure,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL, "op10_license_scan": license_scan.sql(), "op6_vantage_search": OP6_SQL, "op11_prefix_targets": chat_format.SQL}
