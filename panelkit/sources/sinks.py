"""Materialising tables, write-once records, ledgers and nested documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import Check, gate
from ..operators.shape import same_rows
from . import claims


class Conflict(Exception):
    """A record exists with other figures."""


def materialize(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Replace a table and read it back, which cuts lineage at a point of reuse."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def lock_once(df: DataFrame, path: str, cols: Sequence[str], digits: int = 6, wait: float = 30.0, expires: float = 3600.0) -> DataFrame:
    """The first write wins. The same figures again return the record, other ones raise Conflict.

    A writer claims the record, writes the rows under a name of their own, and commits by creating the file `record`, which
    names them and which only one writer can create. Of writers at one moment, one commits and the others compare with it; the
    claim of a writer that died expires, and a late one that still commits finds the record there.
    """
    spark = df.sparkSession
    with claims.claimed(spark, f"{path}/claim", wait, expires):
        held = load_locked(spark, path)
        if held is None:
            name = f"rows-{uuid.uuid4().hex}"
            df.select(*cols).write.mode("errorifexists").parquet(f"{path}/{name}")
            if claims.create_new(spark, f"{path}/record", name):
                return spark.read.parquet(f"{path}/{name}")
            held = load_locked(spark, path)
    if held is None or not same_rows(held, df, cols, digits):
        raise Conflict(f"{path} is locked with other figures")
    return held


def load_locked(spark: SparkSession, path: str) -> DataFrame | None:
    """The locked rows; None before a record is committed."""
    name = claims.read_text(spark, f"{path}/record")
    return None if name is None else spark.read.parquet(f"{path}/{name}")


def ledger_append(entries: DataFrame, path: str, key: str = "entry_id", wait: float = 30.0, expires: float = 3600.0) -> DataFrame:
    """Append entries; one whose id is there already, or twice among the new ones, raises and nothing is written. Appends
    hold the ledger's claim, so of two writers of one id the second finds the first's entry."""
    spark, rows = entries.sparkSession, f"{path}/rows"
    with claims.claimed(spark, f"{path}/claim", wait, expires):
        repeated = entries.groupBy(key).count().where("count > 1").select(key)
        if claims.exists(spark, f"{rows}/_SUCCESS"):
            repeated = repeated.union(entries.select(key).join(spark.read.parquet(rows), key, "left_semi"))
        found = repeated.first()
        if found is not None:
            raise Conflict(f"entry {found[key]!r} is in the ledger")
        entries.write.mode("append").parquet(rows)
    return spark.read.parquet(rows)


def ordered_array(order: Sequence[str | Column], fields: Sequence[str]) -> Column:
    """Structs of the fields in this order, gathered per group. A group is one document."""
    keyed = F.struct(*(F.col(c) if isinstance(c, str) else c for c in order), F.struct(*fields).alias("__row"))
    return F.transform(F.array_sort(F.collect_list(keyed)), lambda x: x["__row"])


def publish_nested(df: DataFrame, group: Sequence[str], order: Sequence[str], fields: Sequence[str], name: str = "rows") -> DataFrame:
    """One JSON document per group with its rows in order."""
    nested = df.groupBy(*group).agg(ordered_array(order, fields).alias(name))
    return nested.select(*group, F.to_json(F.struct(*group, name)).alias("document"))


def publish_entity(df: DataFrame, breakdown: DataFrame, entity: str, order: Sequence[str], fields: Sequence[str], parts: Sequence[str], part_order: Sequence[str]) -> DataFrame:
    """One document per entity: its history, and the breakdown of the newest period, empty for one that is not in it."""
    last = F.struct(*order)
    history = df.groupBy(entity).agg(ordered_array(order, [*order, *fields]).alias("history"), F.max(last).alias("__last"))
    newest = df.agg(F.max(last).alias("__newest"))
    shown = breakdown.groupBy(entity, *order).agg(ordered_array(part_order, parts).alias("breakdown")).withColumn("__last", last).drop(*order)
    joined = history.crossJoin(F.broadcast(newest)).join(shown, [entity, "__last"], "left")
    empty = F.array().cast(shown.schema["breakdown"].dataType)
    part = F.when(F.col("__last") == F.col("__newest"), F.coalesce("breakdown", empty)).otherwise(empty)
    return joined.select(entity, F.to_json(F.struct(entity, "history", part.alias("breakdown"))).alias("document"))


def methodology(config: DataFrame, weights: DataFrame, group: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Configuration of each group with its weights nested."""
    nested = weights.groupBy(group).agg(ordered_array(order, fields).alias("weights"))
    return config.join(nested, group, "left").select(group, F.to_json(F.struct(*config.columns, "weights")).alias("document"))


def publish(files: Mapping[str, DataFrame], root: str, checks: Sequence[Check], pointer: str = "latest", stamp: Callable[[], str] = lambda: uuid.uuid4().hex) -> str:
    """All or nothing: run the gate, write everything under a new version, and name that version in a new pointer last.

    Pointers are numbered and never overwritten; readers follow the highest complete one. There is no moment without a
    pointer: a write that fails before, between or within its steps leaves what was published before.
    """
    gate(checks)
    if not files:
        raise ValueError("nothing to publish")
    version = stamp()
    for name, df in files.items():
        df.write.mode("errorifexists").parquet(f"{root}/{version}/{name}")
    claims.point_to(next(iter(files.values())).sparkSession, f"{root}/{pointer}", version)
    return version


def published(spark: SparkSession, root: str, name: str, pointer: str = "latest") -> DataFrame:
    version = claims.pointed_to(spark, f"{root}/{pointer}")
    if version is None:
        raise FileNotFoundError(f"nothing is published under {root}")
    return spark.read.parquet(f"{root}/{version}/{name}")
