"""Localization of ranked grid coordinates against annotated cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .pools import last_wins


def alias(df: DataFrame, *names: str) -> list[str]:
    return [n for n in names if n in df.columns]


def first_of(df: DataFrame, *names: str):
    """The first column of these names that has a value; null, empty and 'nan' are none."""
    clean = [F.when(~F.lower(F.trim(F.col(f"`{n}`").cast("string"))).isin("", "nan"), F.col(f"`{n}`").cast("string")) for n in alias(df, *names)]
    return F.coalesce(*clean) if clean else F.lit(None).cast("string")


def predictions(wide: DataFrame, ranks: int = 10) -> DataFrame:
    """query_id, ranked: coordinates in first-seen order over the rank columns; blanks let later ranks move up. A query_id's last row (column row_no, if any) counts."""
    cells = [first_of(wide, f"Rank_{i}_Cell_Coord", f"Rank_{i}", f"rank_{i}") for i in range(1, ranks + 1)]
    out = wide.select(first_of(wide, "query_id", "Query_ID", "id").alias("query_id"), F.array_distinct(F.flatten(F.array(*[X.coordinates(c) for c in cells]))).alias("ranked"), *alias(wide, "row_no"))
    return last_wins(out, "query_id", "row_no").drop("row_no") if "row_no" in out.columns else out


def ground_truth(wide: DataFrame, cells: int = 7) -> DataFrame:
    """query_id, truth (all coordinates) and main: those of cell 1, or else of cells 2 and 3."""
    c = [X.coordinates(first_of(wide, f"cell_{i}_coords", f"cell_{i}")) for i in range(1, cells + 1)]
    return wide.select(first_of(wide, "query_id", "Query_ID", "id").alias("query_id"), F.array_distinct(F.flatten(F.array(*c))).alias("truth"), F.when(F.size(c[0]) > 0, c[0]).otherwise(F.array_union(c[1], c[2])).alias("main"))


def metrics(truth: DataFrame, preds: DataFrame) -> DataFrame:
    """The five scores per query, in exact hundredths rounded half up; a query without predictions scores as with none."""
    j = truth.join(preds, "query_id", "left").withColumn("ranked", F.coalesce("ranked", F.array().cast("array<string>")))
    n = F.greatest(F.size("truth"), F.lit(1))
    at = lambda i, s: F.coalesce(F.array_contains(s, F.get("ranked", F.lit(i))), F.lit(False))
    hits = lambda k: F.size(F.array_intersect(F.slice("ranked", F.lit(1), k), F.col("truth")))
    t, m = F.col("truth"), F.col("main")
    weighted = sum((F.when(at(i, t), F.lit(3 - i)).otherwise(F.lit(0)) for i in range(3)), F.lit(0))
    reward = F.when(at(0, m), 10000).when(at(1, m), 7500).when(at(2, m), 5000).when(F.arrays_overlap(F.slice("ranked", 1, 5), m), 3500).otherwise(0)
    j = j.select("query_id", X.percent_cents(hits(n), n).alias("a"), X.percent_cents(hits(F.lit(3)), F.lit(3)).alias("b"), X.percent_cents(weighted, F.lit(6)).alias("c"), reward.cast("long").alias("d"))
    total = F.floor((F.col("a") + F.col("b") + F.col("c") + F.col("d") + 2) / 4)
    names = ("Top_N_Overlap_Percentage", "Top3_Precision_Score", "Rank_Weighted_Top3_Score", "Priority_Cell_Target_Reward", "Overall_Composite_Score")
    return j.select("query_id", *[(c / F.lit(100.0)).alias(x) for x, c in zip(names, (F.col("a"), F.col("b"), F.col("c"), F.col("d"), total))])
