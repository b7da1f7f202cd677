"""Projections, filters, unions and reshaping."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import col


def drop_cols(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.drop(*cols)


def curate(df: DataFrame, mapping: Mapping[str, str | Column]) -> DataFrame:
    """Keep only these columns, under these names."""
    return df.select(*(col(source).alias(name) for name, source in mapping.items()))


def require(df: DataFrame, *cols: str) -> DataFrame:
    """Rows in which no key is null."""
    for c in cols:
        df = df.where(F.col(c).isNotNull())
    return df


def non_blank(df: DataFrame, c: str) -> DataFrame:
    return df.where(F.col(c).isNotNull() & (F.col(c) != ""))


def isin(df: DataFrame, c: str, values: Sequence) -> DataFrame:
    return df.where(F.col(c).isin(*values))


def finite(df: DataFrame, c: str) -> DataFrame:
    return df.where(F.col(c).isNotNull() & ~F.isnan(c))


def flag(c: str, op: str, value) -> Column:
    """A comparison that stays null where the column is null."""
    x, v = F.col(c), F.lit(value)
    return {"=": x == v, "<>": x != v, "<": x < v, "<=": x <= v, ">": x > v, ">=": x >= v}[op]


def pad_to(df: DataFrame, schema: T.StructType, **constants) -> DataFrame:
    """The schema's columns in its order: cast where present, else the constant or a typed null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(constants.get(f.name))).cast(f.dataType).alias(f.name) for f in schema))


def period_range(df: DataFrame, c: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """A bare comparison on the stored column, so that it reaches the scan."""
    if low is not None:
        df = df.where(F.col(c) >= low)
    return df if high is None else df.where(F.col(c) <= high)


def trainable(df: DataFrame, prior: str = "prior_games", outcome: str = "actual", least: int = 3) -> DataFrame:
    return df.where((F.col(prior) >= least) & F.col(outcome).isNotNull())


def predictable(df: DataFrame, prior: str = "prior_games", least: int = 3) -> DataFrame:
    return df.where(F.col(prior) >= least)


def eligible(df: DataFrame, recent: str, min_recent: float = 4.0) -> DataFrame:
    """Recent mean of at least min_recent; null counts as 0."""
    return df.where(F.coalesce(F.col(recent), F.lit(0.0)) >= min_recent)


def reportable(df: DataFrame, season: int, week: int, recent: str, prior: str = "prior_games", min_recent: float = 4.0) -> DataFrame:
    return eligible(predictable(df.where((F.col("season") == season) & (F.col("week") == week)), prior), recent, min_recent)


def next_period(df: DataFrame, season: str, week: str, final: str) -> DataFrame:
    """One row: the newest season, and its earliest week that has something not final. No row if all is final."""
    last = df.agg(F.max(season).alias(season))
    return df.where(~F.col(final)).join(F.broadcast(last), season, "left_semi").groupBy(season).agg(F.min(week).alias(week))


def search_filter(df: DataFrame, query: str, team: str | None = None, name: str = "name", team_col: str = "team") -> DataFrame:
    """Name contains the trimmed query, or team equals it, without regard to case."""
    text = query.strip().lower()
    if team is not None:
        df = df.where(F.col(team_col) == team)
    return df if not text else df.where(F.lower(name).contains(text) | (F.lower(team_col) == text))


def distinct_values(df: DataFrame, c: str) -> DataFrame:
    return df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c)


def sides(df: DataFrame, shared: Sequence[str], home: Mapping[str, str], away: Mapping[str, str]) -> DataFrame:
    """Each row becomes two, one a side, in one scan: columns of `home` and `away` under common names, and is_home."""
    both = [F.struct(*(col(source).alias(name) for name, source in side.items()), F.lit(at_home).alias("is_home")) for side, at_home in ((home, True), (away, False))]
    return df.select(*shared, F.explode(F.array(*both)).alias("__side")).select(*shared, "__side.*")


def union_dims(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def tagged_union(parts: Mapping[str, DataFrame], tag: str = "kind") -> DataFrame:
    return union_dims(*(df.withColumn(tag, F.lit(name)) for name, df in parts.items()))


def to_long(df: DataFrame, ids: Sequence[str], metrics: Sequence[str], name: str = "metric", value: str = "metric_value") -> DataFrame:
    """One row per metric that is neither null nor NaN."""
    return finite(df.select(*ids, *(F.col(m).cast("double") for m in metrics)).unpivot(list(ids), list(metrics), name, value), value)


def same_rows(a: DataFrame, b: DataFrame, cols: Sequence[str], digits: int = 6) -> bool:
    """Equal as multisets after rounding."""

    def rounded(df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        return df.select(*(F.round(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in cols))

    x, y = rounded(a), rounded(b)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()
