"""The store of results: scores as Parquet, appended per batch of queries, from which a run that was ended goes on.

A run's key (RankingRun.key) names its folder, so that scores of other settings are never taken for its own. Spark's commit protocol makes a
batch visible whole or not at all; a query whose batch is there is done.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCORES = "item_id string, doc_id string, mode string, score double, sent long, flops double, failed boolean, batch long"
DONE = "item_id string, batch long, seconds double"


class Store:
    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/{key}"

    def _read(self, part: str, schema: str) -> DataFrame:
        """What is stored; nothing if it is missing or cannot be read."""
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
            rows.limit(1).count()
            return rows
        except Exception as e:
            if isinstance(e, AnalysisException) or "parquet" in str(e).lower():
                return self.spark.createDataFrame([], schema)
            raise

    def scores(self) -> DataFrame:
        """The scores of finished batches."""
        return self._read("scores", SCORES).join(self.done().select("batch").distinct(), "batch", "left_semi")

    def done(self) -> DataFrame:
        return self._read("done", DONE)

    def pending(self, queries: DataFrame) -> DataFrame:
        """The queries without stored scores."""
        done = self.done().select(F.col("item_id").alias("done_id"))
        return queries.join(done, F.col("item_id").cast("string") == F.col("done_id"), "left_anti")

    def append(self, queries: DataFrame, score: Callable[[DataFrame], DataFrame]) -> int:
        """Scores the queries as one batch and stores it; the number of the batch. score: queries -> item_id, doc_id, mode, score, sent, flops, failed."""
        t, batch = time.time(), int(self.done().agg(F.coalesce(F.max("batch"), F.lit(-1)) + 1).first()[0])
        rows = score(queries).select(F.col("item_id").cast("string"), F.col("doc_id").cast("string"), "mode", F.col("score").cast("double"), F.col("sent").cast("long"), F.col("flops").cast("double"), "failed")
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("append").parquet(f"{self.path}/scores")
        # the batch counts once its queries are marked as done; scores without a mark are those of a batch that was ended
        queries.select(F.col("item_id").cast("string"), F.lit(batch).cast("long").alias("batch"), F.lit(time.time() - t).alias("seconds")).write.mode("append").parquet(f"{self.path}/done")
        return batch

    def counters(self) -> DataFrame:
        """One row: queries, docs, fails, calls, flops, seconds a query."""
        d = self.done().groupBy("batch").agg(F.count("*").alias("n"), F.max("seconds").alias("seconds")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("seconds"), F.lit(0.0))).first()
        s = self.scores().agg(F.count("*").alias("docs"), F.count_if("failed").alias("fails"), F.coalesce(F.sum("sent"), F.lit(0)).alias("calls"), F.coalesce(F.sum("flops"), F.lit(0.0)).alias("flops"))
        return s.withColumns({"queries": F.lit(d[0]), "latency": F.lit(d[1] / max(d[0], 1))})

    def finish(self, metrics: DataFrame) -> None:
        """Stores the metric rows of a complete run, which is not scored again."""
        metrics.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/metrics")

    def finished(self) -> DataFrame | None:
        """The metric rows of a complete run, else None."""
        try:
            return self.spark.read.parquet(f"{self.path}/metrics")
        except AnalysisException:
            return None

    def clear(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def resumed(store: Store, queries: DataFrame, score: Callable[[DataFrame], DataFrame], metrics: Callable[[DataFrame], DataFrame], batches: int = 1, overwrite: bool = False) -> DataFrame:
    """The metric rows of a run over queries: those stored if it is complete, else after its pending queries have been scored in so many batches."""
    if overwrite:
        store.clear()
    have = store.finished()
    if have is not None:
        return have
    for b in range(batches):
        left = store.pending(queries)
        part = left.where(F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(batches)) == b)
        if part.limit(1).count():
            store.append(part, score)
    store.finish(metrics(store.scores()))
    return store.finished()
