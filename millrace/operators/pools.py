"""Candidate pools: golds, full corpus, golds with pseudo-random negatives, and round robin over length buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def golds(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id) where the document's text contains the item's, a stand-in for judged relevance.

    A text inside another has its inner words there as whole words; the longest of them is the key of an equi-join, and only the
    documents that have it are searched. Items of fewer than three words have none; those are searched in every document.
    """
    q = queries.select("item_id", F.col("text").alias("q"), X.words(F.col("text")).alias("w")).where("q is not null and q <> ''")
    longest = F.element_at(F.array_sort(F.transform(F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0))), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), 1)["x"]
    q = q.select("item_id", "q", F.when(F.size("w") > 2, longest).alias("key"))
    held = docs.select("doc_id", F.explode(F.array_distinct(X.words(F.col("text")))).alias("key")).join(q.where("key is not null"), "key").select("doc_id", "item_id", "q")
    found = docs.join(held, "doc_id").where(F.contains("text", "q")).select("item_id", "doc_id").distinct()
    short = docs.join(q.where("key is null"), F.contains("text", "q")).select("item_id", "doc_id").distinct()
    return found.unionAll(short)


def resolved(examples: DataFrame, corpus: DataFrame, empty_falls_through: bool = False, most: int | None = None) -> DataFrame:
    """(item_id, doc_id) of the gold ids that the corpus has: those of gold_ids_long, or else of gold_ids.

    The fallback is taken where gold_ids_long is null, with empty_falls_through also where it is empty. most: only the first so many, in the list's order.
    Ids are compared as strings; a repeated id counts once, at its first place.
    """
    long, short = F.col("gold_ids_long").cast("array<string>"), F.col("gold_ids").cast("array<string>")
    ids = F.when(long.isNotNull() & (F.lit(not empty_falls_through) | (F.size(long) > 0)), long).otherwise(F.coalesce(short, F.array().cast("array<string>")))
    g = examples.select("item_id", F.posexplode(F.array_distinct(ids)).alias("at", "doc_id")).join(corpus.select(F.col("doc_id").cast("string").alias("doc_id")).distinct(), "doc_id", "left_semi")
    if most is not None:
        g = g.withColumn("rn", F.row_number().over(Window.partitionBy("item_id").orderBy("at"))).where(F.col("rn") <= most)
    return g.select("item_id", "doc_id")


def barred(examples: DataFrame) -> DataFrame:
    """(item_id, doc_id) that may not be negatives of an item: all its gold ids, chosen or not, and its excluded_ids."""
    none = F.array().cast("array<string>")
    lists = [F.coalesce(F.col(c).cast("array<string>"), none) for c in ("gold_ids_long", "gold_ids", "excluded_ids") if c in examples.columns]
    golds_ = F.when(F.size(lists[0]) > 0, lists[0]).otherwise(lists[1])
    return examples.select("item_id", F.explode(F.array_union(golds_, lists[2] if len(lists) > 2 else none)).alias("doc_id"))


def head(queries: DataFrame, n: int) -> DataFrame:
    """The n first queries by id; all of them for 0."""
    return queries.orderBy("item_id").limit(n) if n else queries


def sampled(queries: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n queries, drawn by a hash of seed and id."""
    return queries.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("item_id").cast("string"))), "item_id").limit(n)


def last_wins(rows: DataFrame, key: str, place: str) -> DataFrame:
    """Of rows with an equal key the one with the largest place."""
    w = Window.partitionBy(key).orderBy(F.desc(place))
    return rows.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def ring(docs: DataFrame, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by, doc_id, pos: positions 0.. in the order of md5(seed:doc_id), per value of by. Ranks are local to 4096 fixed hash buckets; only bucket counts are summed in one task."""
    d = docs.select(*by, "doc_id", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))).alias("h")).withColumn("b", F.substring("h", 1, 3))
    n = d.groupBy(*by, "b").agg(F.count("*").alias("n")).select(*by, "b", F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at"))
    return d.withColumn("r", F.row_number().over(Window.partitionBy(*by, "b").orderBy("h", "doc_id")) - 1).join(n, [*by, "b"]).select(*by, "doc_id", (F.col("at") + F.col("r")).alias("pos"))


def injected(queries: DataFrame, docs: DataFrame, gold: DataFrame, size: int = 50, seed: int = 42, excluded: DataFrame | None = None, own_excluded: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, item_id, doc_id, is_gold): all golds, and negatives up to `size`: those that follow the item's own place on the ring of documents.

    excluded (doc_id): documents that are on no ring; own_excluded (item_id, doc_id): those that are no negatives of an item. by: columns of queries and docs; each value has
    a ring of its own. Of the size + g + x places that follow an item's own at most its g golds and x exclusions are no negatives, so that a pool is only
    smaller than `size` if the ring has no more. No pair outside those places is made.
    """
    free = docs if excluded is None else docs.join(excluded.select("doc_id").distinct(), "doc_id", "left_anti")
    total = free.groupBy(*by).agg(F.count("*").alias("total"))
    bar = gold.select("item_id", "doc_id") if own_excluded is None else gold.select("item_id", "doc_id").union(own_excluded.select("item_id", "doc_id")).distinct()
    q = queries.select(*by, "item_id").join(bar.groupBy("item_id").agg(F.count("*").alias("x")), "item_id", "left").join(gold.groupBy("item_id").agg(F.count("*").alias("g")), "item_id", "left")
    q = q.join(total, list(by)) if by else q.withColumn("total", F.lit(total.first()[0]))
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("q"), F.col("item_id").cast("string"))), 1, 8), 16, 10).cast("long") % F.greatest("total", F.lit(1))
    q = q.withColumn("reach", F.least(F.col("total"), F.lit(size) + F.coalesce("x", F.lit(0)))).where("reach > 0")
    places = q.select(*by, "item_id", "g", F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("reach") - 1), lambda i: (start + i) % F.col("total"))).alias("turn", "pos"))
    cand = places.join(ring(free, seed, by), [*by, "pos"]).join(bar, ["item_id", "doc_id"], "left_anti")
    cand = cand.withColumn("rn", F.row_number().over(Window.partitionBy("item_id").orderBy("turn", "doc_id")))
    g = gold.select("item_id", "doc_id", F.lit(True).alias("is_gold"))
    g = g.join(queries.select(*by, "item_id"), "item_id").select(*by, "item_id", "doc_id", "is_gold") if by else g
    return g.union(cand.where(F.col("rn") + F.coalesce("g", F.lit(0)) <= size).select(*by, "item_id", "doc_id", F.lit(False)))


def round_robin(pool: DataFrame, docs: DataFrame, needed: int = 20) -> DataFrame:
    """The negatives of a pool taken in turn from the length buckets, without replacement, until `needed` or none is left."""
    d = docs.select("doc_id", X.length_bucket(F.size(X.words(F.col("text")))).alias("bucket"))
    order = F.create_map(*[y for i, (_, b) in enumerate(X.BUCKETS) for y in (F.lit(b), F.lit(i))])
    p = pool.where("not is_gold").join(d, "doc_id").withColumn("h", F.md5(F.concat_ws(":", "item_id", "doc_id")))
    p = p.withColumn("turn", F.row_number().over(Window.partitionBy("item_id", "bucket").orderBy("h", "doc_id")))
    p = p.withColumn("pick", F.row_number().over(Window.partitionBy("item_id").orderBy("turn", F.element_at(order, F.col("bucket")))))
    return p.where(F.col("pick") <= needed).select("item_id", "doc_id", "bucket", "pick")
