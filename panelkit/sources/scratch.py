"""Intermediate tables that several branches of a plan read."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir, or of setCheckpointDir. A session of one machine may do without: it gets
    a temporary folder; on a cluster a shared folder has to be named."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="panelkit-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def _clean(spark: SparkSession) -> None:
    try:
        conf = spark._jsc.hadoopConfiguration()
        for path in _made:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
    except Exception:  # the session is gone; the cluster's retention rule clears the folder
        return


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the scratch folder, removed when the driver ends."""
    path = f"{scratch_root(spark)}/panelkit-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean, spark)
    _made.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: computed once, lineage cut, lost executors do no harm. Removed
    when the driver ends."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
