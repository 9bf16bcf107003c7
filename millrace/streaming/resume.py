"""Resume as a stream: each new query is scored once, whenever the run is started again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.store import Store


def catch_up(spark: SparkSession, folder: str, schema: str, store: Store, score: Callable[[DataFrame], DataFrame], checkpoint: str, files: int = 100) -> None:
    """Scores the queries in the Parquet files that were added to folder since the last call, `files` at a time, and stores each batch.

    The stream's checkpoint says which files are read, the store which queries are done: a batch that is run again after a loss adds nothing.
    """

    def batch(rows: DataFrame, _: int) -> None:
        left = store.pending(rows.dropDuplicates(["item_id"]))
        if left.limit(1).count():
            store.append(left, score)

    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    read.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
