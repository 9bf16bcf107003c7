"""What the training-data operators share: words, stored intermediates, checked broadcasts, components."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: A side is broadcast only if its measured rows times its row width stay under this.
BROADCAST_BYTES = 8 << 20
#: Bytes of an Arrow batch, so that a run of long texts fits in a worker's memory.
BATCH_BYTES = 4 << 20
#: With it Spark deletes the shuffle files of a query when it ends (from 4.1; other versions pass over it).
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Where that is unset a local master gets a temporary one; a cluster must name it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="millrace-"))
    return root.rstrip("/")


_local: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again: lineage is cut there and a lost executor costs nothing done before.

    While it is written, Python workers get batches of at most BATCH_BYTES. Once it is written its shuffle files go; else they fill the disks until the driver happens
    to collect its garbage. discard() deletes what is no longer read.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    with batches_of(spark), setting(spark, SHUFFLES_GO, "true"):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the files of stored frames that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """Within it the setting holds; the session's own comes back after it."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def batches_of(spark: SparkSession, most: int = BATCH_BYTES):
    """Within it Arrow batches hold at most so many bytes."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def slices(batches, column: str, most: int = BATCH_BYTES):
    """Record batches cut into slices whose text or binary column has about `most` bytes; a longer row is a slice of its own."""
    for b in batches:
        if b.nbytes <= most:
            yield b
            continue
        at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
            yield b.slice(lo, hi - lo)
            lo = hi


def lean(task):
    """A mapInArrow task after which the worker, which Spark keeps for later ones, gives freed memory back."""

    def run(batches):
        import ctypes

        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def checked_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A stored frame marked for broadcast if its counted rows fit the limit, unmarked (so: a shuffle join) otherwise."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def perhaps(df: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """df with a column `name`: false only where the row's key is none of the keys of `keys`, a stored frame; both have a column key.

    A bitmap of the keys' hashes, about eight bits to a key and BROADCAST_BYTES at most, goes to all tasks, so that rows that cannot meet a key need not be sent to
    meet it. Where it is true an exact join decides.
    """
    bits = 1 << min((8 * BROADCAST_BYTES).bit_length() - 1, max(15, (8 * keys.count()).bit_length()))
    at = F.xxhash64("key").bitwiseAND(F.lit(bits - 1))
    place, bit = F.shiftright(at, 15), at.bitwiseAND(F.lit(32767))
    maps = keys.select(place.alias("place"), bit.alias("bit")).groupBy("place").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (bit % 8 + 1).cast("int"))) > 0
    return df.join(F.broadcast(maps), place == F.col("place"), "left").withColumn(name, F.coalesce(held, F.lit(False))).drop("place", "bitmap")


def task_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b long): root is the smallest node reachable.

    Alternating large-star and small-star contraction; each round is a pre-aggregated minimum over neighbours and is
    stored, so no round recomputes another. It ends when each node has one smaller neighbour, which has none itself. Rounds grow with the logarithm of a component's diameter.
    """
    e = stored(edges.where("a <> b").selectExpr("greatest(a, b) hi", "least(a, b) lo").distinct(), "edges")
    while e.selectExpr("inline(array(struct(hi as node, 1 as up, 0 as down), struct(lo as node, 0 as up, 1 as down)))").groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").limit(1).count():
        both = e.selectExpr("inline(array(struct(hi as u, lo as v), struct(lo as u, hi as v)))")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").selectExpr("v hi", "m lo").where("hi <> lo")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        e, old = stored(small, "edges"), e
        discard(old)
    return e.toDF("node", "root").union(e.select(F.col("lo"), F.col("lo")).distinct())
