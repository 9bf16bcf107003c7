"""The corpus pipeline: documents pass language ID, near-duplicate and repeated-passage removal and mixing, and are packed.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of documents. docs of the first stage is the documents table.
Null and repeated doc_ids, null and empty texts, texts of any length, further columns of docs and empty tables are allowed in every stage. A null or empty text is
rejected by the first stage; reached by others it is no near-duplicate, is dropped by the passage stage and takes no words of a mix. Ties go to the smaller doc_id, null last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, language_id, mixing, ngram_join, packing, suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a posterior of at least a half stay, those in another language or in none go; lang becomes the language told."""
    r = docs.withColumns({"id": F.col("doc_id"), "declared": F.col("lang"), "host": F.col("source")})
    out = language_id.identify(r, keep_text=True)
    return out.where("lid_kept").withColumn("lang", F.col("lid_lang")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of rows linked by a 5-gram Jaccard similarity of 0.8 one row stays: the smallest doc_id, null last. Rows of a repeated or null doc_id are rows of their own."""
    d = common.stored(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered")
    j = ngram_join.join(d.select(F.col("row").alias("doc_id"), "text"), 5, 80).select(F.col("doc_id").alias("row"), F.col("component_id").alias("of"))
    j = common.stored(j, "near-components")
    copied = common.checked_broadcast(common.stored(j.where("of <> row").select("of").distinct(), "near-groups"), 8)
    j = common.stored(j.join(copied, "of", "left_semi"), "near-members")
    # of rows of one doc_id in a component the first by hash, so that the choice does not hang on how rows were dealt
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", F.xxhash64(*COLUMNS).alias("h"), "row")
    keep = d.join(j, "row").select("of", order.alias("o")).groupBy("of").agg(F.min("o").alias("o")).select(F.col("o.row").alias("row"))
    gone = common.checked_broadcast(common.stored(j.select("row").join(keep, "row", "left_anti"), "near-copies"), 8)
    return d.join(gone, "row", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str, words: int | None = None) -> DataFrame:
    """Bytes in strings of 400 bytes, and with `words` in runs of so many words, that also start elsewhere go, with the parts of characters that a cut leaves; documents
    without a word left go."""
    d = suffix_dedup.dedup(docs.select(*COLUMNS), words=words)
    text = F.when(F.col("sfx_n_removed") > 0, F.col("sfx_text")).otherwise(F.col("text"))
    out = d.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))
    return out.where(F.col("text").rlike(common.WORD))


def repeated_words(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """repeated_passages, with passages of over 50 words that have less than 400 bytes."""
    return repeated_passages(spark, docs, sf_dir, 51)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix reads them, in the order of the curriculum."""
    return mixing.by_position(mixing.mix(docs.select(*COLUMNS), whole=True)).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, each with its bin, capacity and offset, in words."""
    return packing.best_fit(docs.select("doc_id", common.n_words(F.col("text")).alias("size")))


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_words),
    ("mixing", mixture),
    ("best_fit_packing", packing_stage),
]

#: The trained language model, set similarity and packing order have no SQL form. tests/llm compares the near-duplicate and passage stages with brute-force versions
#: and holds the others to what they keep, drop and fill.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return docs
