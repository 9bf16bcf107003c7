"""Readers of the corpus, the examples and annotation sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pools import last_wins
from . import xlsx


def corpus(spark: SparkSession, path: str, domains: tuple[str, ...] = (), place: str | None = None) -> DataFrame:
    """domain, doc_id (string), text of a Parquet corpus (domain, id, content); of rows with an equal id the last by column `place`, if that is given, counts.

    One scan serves all domains; the filter reaches the files, or their folders where the corpus is partitioned by domain.
    """
    rows = spark.read.parquet(path)
    if domains:
        rows = rows.where(F.col("domain").isin(*domains))
    rows = rows.select("domain", F.col("id").cast("string").alias("doc_id"), F.col("content").alias("text"), *([place] if place else []))
    if not place:
        return rows
    keyed = rows.withColumn("k_", F.struct("domain", "doc_id"))
    return last_wins(keyed, "k_", place).drop("k_", place)


def examples(spark: SparkSession, path: str, domains: tuple[str, ...] = ()) -> DataFrame:
    """domain, item_id (string), text and the id lists that are there (as strings) of Parquet examples (domain, id, query, gold_ids_long, gold_ids, excluded_ids)."""
    rows = spark.read.parquet(path)
    if domains:
        rows = rows.where(F.col("domain").isin(*domains))
    lists = [F.col(c).cast("array<string>").alias(c) if c in rows.columns else F.lit(None).cast("array<string>").alias(c) for c in ("gold_ids_long", "gold_ids", "excluded_ids")]
    return rows.select("domain", F.col("id").cast("string").alias("item_id"), F.col("query").alias("text"), *lists)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet with a header, all columns strings: CSV if the name ends with .csv, else a workbook's first sheet. A missing file is an error that names it."""
    if not exists(spark, path):
        raise FileNotFoundError(f"{path} not found")
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    spark.dataSource.register(xlsx.Workbook)
    return spark.read.format("workbook").load(path)


def numbered(rows: DataFrame) -> DataFrame:
    """rows with row_no, ascending in the order of a file that is read by one task."""
    return rows.withColumn("row_no", F.monotonically_increasing_id())
