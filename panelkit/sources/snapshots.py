"""Dated snapshots: root/<dataset>/[season=Y/]ingest_date=D/*.parquet; only the newest date of a season counts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Dataset:
    name: str
    schema: T.StructType | None = None
    seasonal: bool = False


class Registry:
    """Known datasets. Expands names and seasons to what has to be read; unknown names are refused."""

    def __init__(self, datasets: Iterable[Dataset]):
        self.datasets = {d.name: d for d in datasets}

    def resolve(self, names: Sequence[str] | None, seasons: Sequence[int]) -> list[tuple[Dataset, int | None]]:
        unknown = sorted(set(names or ()) - set(self.datasets))
        if unknown:
            raise KeyError(f"unknown datasets: {unknown}")
        chosen = [self.datasets[n] for n in (names or self.datasets)]
        return [(d, s) for d in chosen for s in (seasons if d.seasonal else [None])]


def _folders(spark: SparkSession, path: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(where) if s.isDirectory()) if files.exists(where) else []


def newest_folders(spark: SparkSession, root: str, name: str) -> list[tuple[str, str | None, str]]:
    """(path, season, ingest_date) of the newest snapshot of each season, decided from the listing, so older files are never read."""
    out = []
    top = _folders(spark, f"{root}/{name}")
    seasons = [f for f in top if f.startswith("season=")]
    for season in seasons or [None]:
        base = f"{root}/{name}/{season}" if season else f"{root}/{name}"
        dates = [f for f in (_folders(spark, base) if season else top) if f.startswith("ingest_date=")]
        if dates:
            out.append((f"{base}/{max(dates)}", season and season.split("=", 1)[1], max(dates).split("=", 1)[1]))
    return out


def scan_union(spark: SparkSession, paths: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """Union by column name; missing columns are null; with a schema, columns are cast file group by file group, so a
    column may be an integer in one and a double in another."""
    parts = []
    for path in paths:
        df = spark.read.parquet(path)
        if schema is not None:
            df = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema if f.name in df.columns), *(F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in df.columns))
        parts.append(df)
    if not parts:
        raise FileNotFoundError("no snapshot to read")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def latest_snapshot(spark: SparkSession, root: str, dataset: Dataset) -> DataFrame:
    """All rows of the newest snapshot of each season, with _ingest_date (and season, where the path has it)."""
    parts = []
    for path, season, day in newest_folders(spark, root, dataset.name):
        df = scan_union(spark, [path], dataset.schema).withColumn("_ingest_date", F.lit(day).cast("date"))
        parts.append(df.withColumn("season", F.lit(int(season))) if season else df)
    if not parts:
        raise FileNotFoundError(f"{dataset.name} has no snapshot")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def latest_version(df: DataFrame, version: str, partition: Sequence[str] = ()) -> DataFrame:
    """The same for a frame that carries its version: all rows of the newest version of each partition."""
    if not partition:
        newest = df.agg(F.max(version).alias("__v"))
        return df.join(F.broadcast(newest), F.col(version) == F.col("__v"), "left_semi")
    return df.withColumn("__v", F.max(version).over(Window.partitionBy(*partition))).where(F.col(version) == F.col("__v")).drop("__v")


def scan(spark: SparkSession, path: str, cols: Sequence[str]) -> DataFrame:
    """A narrow read of a wide file: only these columns leave the scan."""
    return spark.read.parquet(path).select(*cols)


def read_seed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A typed CSV reference table with a header; a malformed line is an error."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")
