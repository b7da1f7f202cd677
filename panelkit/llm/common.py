"""Small helpers that several operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a maximal run of characters other than space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"

_made: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir, or of setCheckpointDir. Without either, `default_root` decides."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or default_root(spark)
    return root.rstrip("/")


def default_root(spark: SparkSession) -> str:
    """A temporary folder, for a session of one machine alone; on a cluster a shared folder has to be named."""
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="panelkit-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/panelkit-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean_at_exit, spark)
    _made.append(path)
    return path


def mark() -> int:
    """A point in the list of scratch tables, for `drop_since`."""
    return len(_made)


def drop_since(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Remove the scratch tables made since a mark, but for the last `keep`. What reads them has to be written by then."""
    conf = spark._jsc.hadoopConfiguration()
    for path in _made[since : len(_made) - keep]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        _made.remove(path)


def _clean_at_exit(spark: SparkSession) -> None:
    """At the end of the driver, remove what it wrote to the scratch folder."""
    try:
        drop_since(spark, 0)
    except Exception:  # the session is gone; the cluster's retention rule clears the folder
        return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    give_back()
    return spark.read.schema(df.schema).parquet(path)


def running(df: DataFrame, key: str, order: list[str], weight: str | None = None) -> DataFrame:
    """`df` with place (0, 1, ... in each key, by `order`) and before (sum of `weight` at lower places).

    Rows are dealt over all partitions by key and order, so one large key is spread over tasks; a window over the
    partitions of a key has one row for each of them.
    """
    value = F.col(weight) if weight else F.lit(1)
    spread = materialize(df.repartitionByRange(key, *order).withColumn("part", F.spark_partition_id()), "spread")
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = spread.groupBy(key, "part").agg(F.count("*").alias("rows_in_part"), F.sum(value).alias("weight_in_part"))
    held = held.select(key, "part", F.coalesce(F.sum("rows_in_part").over(earlier), F.lit(0)).alias("first_n"), F.coalesce(F.sum("weight_in_part").over(earlier), F.lit(0)).alias("first_w"))
    inner = Window.partitionBy(key, "part").orderBy(*order)
    sums = F.coalesce(F.sum(value).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = spread.withColumn("place", F.row_number().over(inner) - 1).withColumn("before", sums).join(held, [key, "part"])
    return placed.withColumn("place", F.col("first_n") + F.col("place")).withColumn("before", F.col("first_w") + F.col("before")).drop("part", "first_n", "first_w")


def quoted(name: str) -> Column:
    """The column of this very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or the first longer form of it that no column of `df` has."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def small_or_plain(df: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """Broadcast only when the counted rows are within `most`; otherwise leave the choice to Spark."""
    return F.broadcast(df) if rows <= most else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes of rows that Spark hands to Python at a time, about.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bound what Spark hands to a Python worker at a time by bytes, since texts have any length. The session's own
    setting stays if it is smaller."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if now > most or now <= 0:
        spark.conf.set(name, f"{most}b")


def slices(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 8 << 20, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in parts of at most `rows` rows whose texts in `column` have `most_bytes` bytes together, or
    of one row if its text alone has more."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            last = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most_bytes, "right"))
            last = max(at + 1, min(last, at + rows))
            yield batch.slice(at, last - at)
            at = last


def give_back() -> None:
    """Return what this process has freed to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def settled(rows: Iterator[pa.RecordBatch], *caches) -> Iterator[pa.RecordBatch]:
    """`rows`; at the end of the partition the caches are emptied and memory goes back to the system, since a worker
    process outlives its task."""
    try:
        yield from rows
    finally:
        for cache in caches:
            cache.clear()
        give_back()
