"""Mixing sources to target weights: a time-varying curriculum, all in DataFrame operations.

Each source's share of a token budget is found by water filling under a cap on repetition. Its documents stand in
a fixed pseudo-random order and are read cyclically; the cumulative token demand of a document, inverted through the
integral of the source's weight schedule, is its training position. Documents are then range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common


def _ordered(df: DataFrame, order: list[Column], sums: list[str], name: str) -> DataFrame:
    """df with, for each column x of sums, x_before: the sum of x over all rows before, in a total order.

    Rows are dealt out by range and stored with their range number; only one total per range meets in one task.
    """
    n = common.task_count(df.sparkSession)
    parts = common.stored(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), name)
    w = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.withColumns({f"{x}_before": F.coalesce(F.sum(x).over(w), F.lit(0)) for x in sums})
    totals = parts.groupBy("part").agg(*[F.sum(x).alias(x) for x in sums])
    wt = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    offsets = totals.select("part", *[F.coalesce(F.sum(x).over(wt), F.lit(0)).alias(f"{x}_at") for x in sums])
    out = local.join(F.broadcast(offsets), "part")
    return out.withColumns({f"{x}_before": F.col(f"{x}_before") + F.col(f"{x}_at") for x in sums}).drop("part", *[f"{x}_at" for x in sums])


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, cap: float, slopes: tuple[float, ...]) -> DataFrame:
    """One stored row per source: skey, source_size, target, slope. sized: skey, size.

    Sources in code-point order, null last, take the weights in turn; together they get share x all sizes. A target stops
    at cap x its source's size and the excess is shared again by weight: with lam the common level, target = min(cap, lam x weight).
    """
    totals = sized.groupBy("skey").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    k = len(weights)
    ranked = _ordered(totals, [F.col("skey").startswith("n"), F.col("skey")], ["one"], "source-rank")
    ranked = ranked.select("skey", "source_size", F.pmod(F.col("one_before"), F.lit(k)).alias("turn"))
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("turn") + 1).cast("int"))
    ranked = ranked.select("*", pick(weights).cast("long").alias("w"), pick([float(x) for x in slopes]).alias("slope"), (F.col("source_size") * F.lit(float(cap))).alias("cap"))
    ranked = common.stored(ranked.withColumn("level", F.col("cap") / F.col("w")), "source-weights")
    total, total_w = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    budget, total_w = float(share) * (total or 0), total_w or 0
    level = _ordered(ranked, [F.col("level"), F.col("skey")], ["cap", "w"], "source-levels")
    full = F.col("cap_before") + F.col("level") * (F.lit(total_w) - F.col("w_before")) <= F.lit(budget)
    caps, ws = level.where(full).agg(F.sum("cap"), F.sum("w")).first()
    caps, ws = caps or 0.0, ws or 0
    lam = (budget - caps) / (total_w - ws) if total_w > ws else float("inf")
    target = F.least(F.col("cap"), F.lit(lam) * F.col("w")) if lam != float("inf") else F.col("cap")
    return common.stored(ranked.select("skey", "source_size", target.alias("target"), "slope"), "source-targets")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, slopes: tuple[float, ...] = (0.6, 0.0, -0.6), whole: bool = False) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target, mix_taken and mix_positions (one per time the document is read, ascending).

    Size is the number of words; null text has 0. A null source is a source of its own, the last. A source is read in the order of
    md5(doc_id), doc_id, size: equal rows are interchangeable, a null doc_id counts as empty. With whole=False a source's demand is
    met to the word, so that one document per source may be read in part; with whole=True a document is read whole if its middle word is demanded.
    An empty table gives an empty result; further columns are kept and may have any name but those that start with mix_.
    A source of any size is read by 65536 buckets of its order, whose totals are added up in two levels of at most 256 rows a key.
    """
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = docs.withColumns({
        "mix_size": common.n_words(F.col("text")),
        "mix_skey": F.coalesce(F.concat(F.lit("a"), F.col("source")), F.lit("n")),
        "mix_h": h, "mix_b1": F.substring(h, 1, 2), "mix_b2": F.substring(h, 3, 2),
    })
    narrow = common.stored(keyed.groupBy("mix_skey", "mix_b1", "mix_b2").agg(F.sum("mix_size").alias("size")), "bucket-sizes")
    targets = source_targets(narrow.select(F.col("mix_skey").alias("skey"), "size"), weights, share, cap, slopes)
    targets = targets.select(F.col("skey").alias("mix_skey"), F.col("source_size").alias("mix_s"), F.col("target").alias("mix_t"), F.col("slope").alias("mix_a"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    b1 = narrow.groupBy("mix_skey", "mix_b1").agg(F.sum("size").alias("size"))
    b1 = b1.select("mix_skey", "mix_b1", F.coalesce(F.sum("size").over(before("mix_skey", "mix_b1")), F.lit(0)).alias("at1"))
    b2 = narrow.select("mix_skey", "mix_b1", "mix_b2", F.coalesce(F.sum("size").over(before("mix_skey", "mix_b1", "mix_b2")), F.lit(0)).alias("at2"))
    offsets = b2.join(b1, ["mix_skey", "mix_b1"]).join(targets, "mix_skey").withColumn("mix_at", F.col("at1") + F.col("at2")).drop("at1", "at2")
    w = Window.partitionBy("mix_skey", "mix_b1", "mix_b2").orderBy("mix_h", "doc_id", "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("mix_c", F.coalesce(F.sum("mix_size").over(w), F.lit(0))).join(offsets, ["mix_skey", "mix_b1", "mix_b2"])
    placed = placed.withColumn("mix_c", F.col("mix_c") + F.col("mix_at"))
    size, s, t, c, a = (F.col(x) for x in ("mix_size", "mix_s", "mix_t", "mix_c", "mix_a"))
    demand = F.floor(t + F.lit(0.5))
    passes = []
    for p in range(int(-(-cap // 1))):
        if whole:
            passes.append(F.when(2 * (c + p * s) + size < 2 * demand, size).otherwise(F.lit(None)))
        else:
            passes.append(F.when(c + p * s < demand, F.least(size, demand - c - p * s)).otherwise(F.lit(None)))
    taken = sum((F.coalesce(x, F.lit(0)) for x in passes), F.lit(0)).cast("long")
    # weight(t) = 1 + slope (2t - 1); its integral t + slope (t^2 - t) reaches the demanded fraction u at:
    at = []
    for p, x in enumerate(passes):
        u = F.least((c + p * s).cast("double") / F.greatest(t, F.lit(1.0)), F.lit(1.0))
        b = F.lit(1.0) - a
        at.append(F.when(x.isNotNull(), F.when(a == 0.0, u).otherwise((F.sqrt(b * b + F.lit(4.0) * a * u) - b) / (F.lit(2.0) * a))))
    out = placed.select(*[F.col(f"`{x}`") for x in docs.columns], size, s.alias("mix_source_size"), t.alias("mix_target"), taken.alias("mix_taken"), F.filter(F.array(*at), lambda x: x.isNotNull()).alias("mix_positions"))
    return out


def by_position(mixed: DataFrame) -> DataFrame:
    """One row per reading of a document, range-sorted by training position."""
    rows = mixed.withColumn("mix_position", F.explode("mix_positions")).drop("mix_positions")
    return rows.repartitionByRange(common.task_count(rows.sparkSession), "mix_position", "doc_id").sortWithinPartitions("mix_position", "doc_id")
