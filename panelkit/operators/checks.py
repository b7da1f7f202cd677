"""Data-quality checks. Each returns the failing rows: empty means pass. The gate runs them and blocks a write."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .aggs import contiguity, duplicates


def unique(df: DataFrame, c: str) -> DataFrame:
    return duplicates(df.where(F.col(c).isNotNull()), [c])


def not_null(df: DataFrame, c: str) -> DataFrame:
    return df.where(F.col(c).isNull())


def accepted(df: DataFrame, c: str, values: Sequence) -> DataFrame:
    """Values outside of the list; null is not one."""
    return df.where(~F.col(c).isin(*values))


def orphans(df: DataFrame, c: str, parent: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(c).isNotNull()).join(parent.select(F.col(key).alias(c)), c, "left_anti")


def unique_combination(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return duplicates(df, cols)


def expression(df: DataFrame, expr: str | Column, where: str | Column | None = None) -> DataFrame:
    """Rows for which the expression is false; null passes."""
    kept = df if where is None else df.where(where)
    return kept.where(~(F.expr(expr) if isinstance(expr, str) else expr))


def not_empty(df: DataFrame) -> DataFrame:
    """One row if the table has none."""
    return df.agg(F.count("*").alias("n")).where("n = 0")


def adds_up(parts: DataFrame, totals: DataFrame, keys: Sequence[str], part: str, total: str, tol: float = 1e-5) -> DataFrame:
    summed = parts.groupBy(*keys).agg(F.sum(part).alias("__sum"))
    return totals.join(summed, list(keys)).where(F.abs(F.col("__sum") - F.col(total)) > tol)


def no_future(df: DataFrame, entity: Sequence[str], order: Sequence[str], prior: str, history: Sequence[str]) -> DataFrame:
    """Rows whose prior count is not their place less one, or that have a value although nothing came before."""
    n = F.row_number().over(Window.partitionBy(*entity).orderBy(*order)) - 1
    known = F.lit(False)
    for c in history:
        known = known | F.col(c).isNotNull()
    return df.withColumn("__before", n).where((F.col("__before") != F.col(prior)) | ((F.col("__before") == 0) & known)).drop("__before")


def outcome_iff_final(df: DataFrame, outcome: str, final: str) -> DataFrame:
    return df.where(F.col(outcome).isNotNull() != F.col(final))


def only_from(df: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys the other table does not have (projected rows on an active roster, metrics that are computed)."""
    return df.join(allowed, list(keys), "left_anti")


def details_from_latest(details: DataFrame, facts: DataFrame, key: str, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    latest = facts.groupBy(key).agg(*(F.max_by(c, F.struct(*order)).alias(f"__{c}") for c in cols))
    differs = F.lit(False)
    for c in cols:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    return details.join(latest, key).where(differs).select(details.columns)


def contiguous(df: DataFrame, keys: Sequence[str], rank: str) -> DataFrame:
    return contiguity(df, keys, rank)


def stale(games: DataFrame, start: str, done: str, now: Column, hours: int = 48, settled_week: str | None = None, ranked_week: int | None = None) -> DataFrame:
    """Games that began more than `hours` before `now` without a result, games without a start, and, if asked for, a
    settled week later than the last ranked one."""
    late = (F.col(start) < now - F.make_dt_interval(F.lit(0), F.lit(hours), F.lit(0), F.lit(0))) & ~F.col(done)
    reason = F.when(F.col(start).isNull(), "undated").when(late, "no result")
    found = games.withColumn("reason", reason)
    if settled_week is not None:
        found = found.withColumn("reason", F.coalesce("reason", F.when(F.col(done) & (F.col(settled_week) > ranked_week), "not ranked")))
    return found.where(F.col("reason").isNotNull())


def min_rows(df: DataFrame, group: str, minimums: Mapping[str, int]) -> DataFrame:
    """Groups with fewer rows than they should have, those without any included."""
    wanted = df.sparkSession.createDataFrame(list(minimums.items()), f"{group} string, least int")
    return wanted.join(df.groupBy(group).agg(F.count("*").alias("n")), group, "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < least")


def conforms(df: DataFrame, schema: T.StructType, ranges: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Raises if columns differ from the closed schema; returns rows with a value out of its range."""
    given, wanted = ({f.name: f.dataType for f in s} for s in (df.schema, schema))
    if given != wanted:
        raise ValueError(f"columns differ from the contract: {sorted(set(given.items()) ^ set(wanted.items()), key=str)}")
    bad = F.lit(False)
    for c, (low, high) in ranges.items():
        if low is not None:
            bad = bad | F.coalesce(F.col(c) < low, F.lit(False))
        if high is not None:
            bad = bad | F.coalesce(F.col(c) > high, F.lit(False))
    return df.where(bad)


def flag_agrees(df: DataFrame, flag: str, rank: str, score: str) -> DataFrame:
    """Ranked if and only if qualified; no score without a rank."""
    return df.where((F.col(flag) != F.col(rank).isNotNull()) | (F.col(rank).isNull() & F.col(score).isNotNull()))


@dataclass
class Check:
    name: str
    failing: DataFrame
    severity: str = "error"


class GateError(Exception):
    """Checks of severity error failed."""


def failures(checks: Sequence[Check]) -> DataFrame:
    """(name, severity, n) of all checks, counted in one job."""
    if not checks:
        raise ValueError("no check given")
    parts = [c.failing.agg(F.count("*").alias("n")).select(F.lit(c.name).alias("name"), F.lit(c.severity).alias("severity"), "n") for c in checks]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def gate(checks: Sequence[Check]) -> list[tuple[str, int]]:
    """Raises if a check of severity error has failing rows; returns the warnings."""
    found = [(r["name"], r["severity"], r["n"]) for r in failures(checks).collect() if r["n"]]
    errors = [(name, n) for name, severity, n in found if severity == "error"]
    if errors:
        raise GateError("; ".join(f"{name}: {n} rows" for name, n in sorted(errors)))
    return [(name, n) for name, _, n in found]
