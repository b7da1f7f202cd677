"""Scalar expressions on panel columns. All are built-in expressions, so they stay inside generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def path_part(key: str, path: str | Column = "_metadata.file_path") -> Column:
    """The value of `key=value` in a file path; null where the path has no such part."""
    found = F.regexp_extract(col(path), rf"/{key}=([^/]+)/", 1)
    return F.when(found != "", found)


def explode_list(df: DataFrame, name: str, sep: str = ";", alias: str | None = None) -> DataFrame:
    """One row per element of a delimited list. Null lists have none; empty elements go."""
    alias = alias or name
    rows = df.withColumn("__item", F.explode(F.split(name, F.lit(f"\\Q{sep}\\E")))).where(F.col("__item") != "")
    return rows.drop(name).withColumnRenamed("__item", alias)


def parse_local_ts(day: str | Column, time: str | Column) -> Column:
    """Wall-clock time without a zone; null where either part is null or the text is no time."""
    return F.try_to_timestamp(F.concat(col(day), F.lit(" "), col(time)), F.lit("yyyy-MM-dd HH:mm")).cast(T.TimestampNTZType())


def to_date_or_null(c: str | Column) -> Column:
    return col(c).try_cast("date")


def safe_ratio(n: str | Column, d: str | Column) -> Column:
    """Null for a zero or null denominator."""
    return col(n) / F.nullif(col(d), F.lit(0))


def positive_ratio(n: str | Column, d: str | Column) -> Column:
    return F.when(col(d) > 0, col(n) / col(d))


def stable(c: str | Column, digits: int = 6) -> Column:
    """Rounded, so that sums that differ in the last bits tie."""
    return F.round(col(c), digits)


def switch(c: str | Column, cases: Mapping[str, Column], default: Column | None = None) -> Column:
    out = F.lit(None) if default is None else default
    for value, result in reversed(list(cases.items())):
        out = F.when(col(c) == value, result).otherwise(out)
    return out


def score_points(kind: str | Column, special: str, weights: Mapping[str, float], given: str | Column) -> Column:
    """Rows of the special kind score a weighted sum of counts (null as 0); all others keep the given points."""
    total = sum((F.coalesce(col(c), F.lit(0)) * w for c, w in weights.items()), F.lit(0.0))
    return F.when(col(kind) == special, total).otherwise(F.coalesce(col(given), F.lit(0.0)))


def is_distinct(a: str | Column, b: str | Column) -> Column:
    return ~col(a).eqNullSafe(col(b))


def perspective(is_home: str | Column, home: str | Column, away: str | Column) -> Column:
    """The home side's figure for the home side, the away side's for the other."""
    return F.when(col(is_home), col(home)).otherwise(col(away))


def implied_total(total: str | Column, spread: str | Column) -> Column:
    return col(total) / 2 + col(spread) / 2


def override_when(flag: Column, c: str | Column, value) -> Column:
    return F.when(flag, F.lit(value)).otherwise(col(c))


def to_utc(ts: str | Column, day: str | Column, offset_h: int, fallback: str) -> Column:
    """Local wall clock plus a fixed offset; a day without a time stands at `fallback` ("HH:mm")."""
    local = F.coalesce(col(ts).cast("timestamp_ntz"), parse_local_ts(col(day).cast("string"), F.lit(fallback)))
    return local + F.make_dt_interval(F.lit(0), F.lit(offset_h), F.lit(0), F.lit(0))


def season_of(day: str | Column, first_month: int = 3) -> Column:
    d = col(day)
    return F.when(F.month(d) >= first_month, F.year(d)).otherwise(F.year(d) - 1)


def contains_flag(c: str | Column, text: str) -> Column:
    """Case-insensitive; null counts as no."""
    return F.coalesce(F.lower(col(c)).contains(text.lower()), F.lit(False))


def clean_category(c: str | Column) -> Column:
    """Trimmed and title-cased; blank is null."""
    tidy = F.initcap(F.trim(col(c)))
    return F.when(tidy != "", tidy)


def ordinal(c: str | Column, values: Sequence[str]) -> Column:
    """Place in a fixed list, as a number; null for others."""
    at = F.array_position(F.array(*map(F.lit, values)), col(c))
    return F.when(at > 0, (at - 1).cast("double"))


def json_number(c: str | Column, digits: int = 4) -> Column:
    """Rounded; null for what JSON cannot hold."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.round(x, digits))


def bin_right(c: str | Column, edges: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """Right-closed bins (e0, e1], (e1, e2], ...; null outside."""
    labels = labels or [f"({a:g}, {b:g}]" for a, b in zip(edges, edges[1:])]
    out = None
    for low, high, label in zip(edges, edges[1:], labels):
        held = (col(c) > low) & (col(c) <= high)
        out = F.when(held, label) if out is None else out.when(held, label)
    return out


def parity(c: str | Column) -> Column:
    return F.when(col(c) % 2 == 1, "odd").otherwise("even")


def to_doc(*cols: str | Column) -> Column:
    return F.to_json(F.struct(*cols))


def from_doc(c: str | Column, schema: T.StructType | str) -> Column:
    return F.from_json(col(c), schema)


def named_map(values: Mapping[str, str | Column]) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), col(v))))


def order_bounds(low: str | Column, high: str | Column, floor: float = 0.0) -> tuple[Column, Column]:
    """The smaller and the larger of two bounds, neither below the floor."""
    a, b = F.greatest(col(low), F.lit(floor)), F.greatest(col(high), F.lit(floor))
    return F.least(a, b), F.greatest(a, b)


def register(spark) -> None:
    """The same helpers for SQL text, as macros over built-in functions."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION safe_ratio(n DOUBLE, d DOUBLE) RETURNS DOUBLE RETURN n / nullif(d, 0)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION season_of(d DATE) RETURNS INT RETURN if(month(d) >= 3, year(d), year(d) - 1)")
