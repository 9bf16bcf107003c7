"""Quality rules: counts of surface features and a hashed n-gram log-likelihood ratio, all in DataFrame operations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Letters and digits in a row, or other visible characters in a row.
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def shifted(xs: Column, n: int) -> Column:
    """An array from its (n + 1)-th entry on."""
    return F.slice(xs, n + 1, F.size(xs))


def gram_buckets(t: Column, u: Column, buckets: int) -> tuple[Column, Column]:
    """Buckets of the grams that start at a token: itself, and with the next one (null after the last, which pairs with its end)."""
    at = lambda *x: F.pmod(F.xxhash64(*x), F.lit(buckets)).cast("int")
    return at(t), at(t, F.coalesce(u, F.lit("")))


def log_ratio_weights(docs: DataFrame, trusted_ids: DataFrame, buckets: int = 1 << 15, alpha: float = 1.0, trusted_rows: int = 50_000, scale: int = 10_000) -> list[int]:
    """One integer per bucket: scale x ln(p_trusted / p_raw), both multinomials smoothed by alpha a bucket.

    The raw counts cover every document. The trusted counts cover the documents of a bounded sample of the labelled ids:
    the trusted_rows smallest by hash, so that they can be broadcast whatever the number of labels. Two counts a bucket reach the driver.
    """
    ids = trusted_ids.select(F.col("doc_id").alias("t_id")).where("t_id is not null").distinct().orderBy(F.xxhash64("t_id"), "t_id").limit(trusted_rows)
    toks = docs.select("doc_id", tokens(F.col("text")).alias("ts")).join(F.broadcast(ids), F.col("doc_id") == F.col("t_id"), "left")
    # rows, not arrays, are hashed: that stays in generated code
    rows = toks.select(F.col("t_id").isNotNull().cast("long").alias("tr"), F.inline(F.arrays_zip(F.col("ts").alias("t"), shifted(F.col("ts"), 1).alias("u"))).alias("t", "u"))
    rows = rows.select("tr", F.explode(F.array(*gram_buckets(F.col("t"), F.col("u"), buckets))).alias("b"))
    counts = rows.groupBy("b").agg(F.count("*").alias("raw"), F.sum("tr").alias("trusted"))
    raw, trusted = [alpha] * buckets, [alpha] * buckets
    for b, r, t in counts.collect():  # at most one row a bucket
        raw[b], trusted[b] = raw[b] + r, trusted[b] + t
    r, t = sum(raw), sum(trusted)
    return [round(scale * (math.log(x / t) - math.log(y / r))) for x, y in zip(trusted, raw)]


def base_features(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), in columns q_*; all 0 for null or empty text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_IN))
    df = docs.withColumns({"q_w": common.words(F.col("text")), "q_l": lines})
    # hashes of 2, 4 and 8 words, each from two of half the length; what overhangs the end is cut off last
    pair = lambda xs, n: F.zip_with(xs, shifted(xs, n), lambda x, y: F.xxhash64(x, y))
    df = df.withColumn("q_h2", pair(F.col("q_w"), 1)).withColumn("q_h4", pair(F.col("q_h2"), 2)).withColumn("q_h8", pair(F.col("q_h4"), 4))
    df = df.withColumn("q_win", F.when(F.size("q_w") >= 8, F.slice("q_h8", 1, F.greatest(F.size("q_w") - 7, F.lit(0))))).drop("q_h2", "q_h4", "q_h8")
    # positions of windows whose hash occurs again: neighbours in the order of (hash, position)
    s = F.sort_array(F.zip_with(F.col("q_win"), F.sequence(F.lit(1), F.size("q_win")), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.transform(F.array(s), lambda a: F.sort_array(F.transform(
        F.filter(F.transform(a, lambda x, k: F.struct(x["i"].alias("i"), ((k > 0) & (F.get(a, k - 1)["h"] == x["h"]) | F.coalesce(F.get(a, k + 1)["h"] == x["h"], F.lit(False))).alias("d"))), lambda x: x["d"]), lambda x: x["i"])))
    covered = F.aggregate(F.transform(twice, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(8), F.coalesce(F.get(p, k + 1) - x, F.lit(8)))), F.lit(0), lambda u, v: u + v)), F.lit(0), lambda u, v: u + v)
    df = df.withColumn("q_n_repeat_words", F.when(F.size(F.array_distinct("q_win")) < F.size("q_win"), covered).otherwise(F.lit(0)).cast("long"))
    return df.withColumns({
        "q_n_words": F.size("q_w").cast("long"),
        "q_word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "q_n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "q_n_dup_lines": (F.size("q_l") - F.size(F.array_distinct("q_l"))).cast("long"),
    }).drop("q_w", "q_l", "q_win")


WORD_IN = r"[^\x20\x09-\x0D]"


def judge(docs: DataFrame, trusted_ids: DataFrame, threshold: float = -0.5, buckets: int = 1 << 15, min_words: int = 20, repeat_percent: int = 30, scale: int = 10_000) -> DataFrame:
    """docs with the base features, q_base_failed, q_n_grams, q_score (mean log ratio a gram) and q_kept.

    Kept: the base rules hold and the mean log ratio reaches the threshold. Weights and sums are integers, so the verdict does not
    depend on the order of addition. Null, empty or white-space texts have no grams, score 0 and fail the base rules; null ids
    match no label; repeated rows are judged alike; without labels both multinomials differ only by smoothing. Columns named q_* are ours, others are kept.
    """
    weights = log_ratio_weights(docs, trusted_ids, buckets, scale=scale)
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")  # folded into one literal of `buckets` numbers
    df = base_features(docs).withColumn("q_t", tokens(F.col("text")))
    both = lambda t, u: sum(F.get(table, b) for b in gram_buckets(t, u, buckets))
    each = F.zip_with("q_t", shifted(F.col("q_t"), 1), both)
    df = df.withColumns({"q_n_grams": (2 * F.size("q_t")).cast("long"), "q_sum": F.aggregate(each, F.lit(0).cast("long"), lambda u, v: u + v)})
    failed = (F.col("q_n_words") < min_words) | (100 * F.col("q_n_repeat_words") > repeat_percent * F.col("q_n_words"))
    good = F.col("q_sum") >= F.ceil(F.lit(threshold * scale) * F.col("q_n_grams"))
    return df.withColumns({
        "q_base_failed": failed, "q_kept": ~failed & good,
        "q_score": F.when(F.col("q_n_grams") > 0, F.col("q_sum") / (F.col("q_n_grams") * scale)).otherwise(F.lit(0.0)),
    }).drop("q_t", "q_sum")
