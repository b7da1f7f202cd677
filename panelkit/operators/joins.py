"""Joins of panels. Small lookups are left for Spark to broadcast by their size, large sides say so (`large`); no join lacks an
equality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def large(df: DataFrame) -> DataFrame:
    """A side that grows with the data: joined by shuffle. Compressed files look smaller than their rows are in memory, so Spark
    would broadcast millions of rows through the driver."""
    return df.hint("merge")


def std_code(df: DataFrame, c: str, map_df: DataFrame, raw: str = "raw", standard: str = "standard") -> DataFrame:
    """Replace a code by its standard one; codes that the map does not have stay."""
    lookup = map_df.select(F.col(raw).alias("__raw"), F.col(standard).alias("__std"))
    return df.join(lookup, F.col(c) == F.col("__raw"), "left").withColumn(c, F.coalesce("__std", c)).drop("__raw", "__std")


def map_category(df: DataFrame, c: str, map_df: DataFrame, raw: str, target: str, alias: str) -> DataFrame:
    """Adds the category; what the map does not have is null, for a check to find."""
    lookup = map_df.select(F.col(raw).alias("__raw"), F.col(target).alias(alias))
    return df.join(lookup, F.col(c) == F.col("__raw"), "left").drop("__raw")


def crosswalk(df: DataFrame, ids: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(ids, on, "inner")


def membership_join(df: DataFrame, games: DataFrame, keys: Sequence[str], member: str, sides: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows join the game of their period in which their member is on either side. Games become one row a side first,
    so the join is on equality alone."""
    per_side = games.withColumn(member, F.explode(F.array_distinct(F.array(*map(F.col, sides)))))
    return df.join(per_side, [*keys, member], how)


def attach(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    return df.join(other, list(keys), how)


def full_merge(dfs: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of all on common keys, which are coalesced."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.join(df, list(keys), "full")
    return out


def full_merge_first(dfs: Sequence[DataFrame], keys: Sequence[str], only_first: Sequence[str]) -> DataFrame:
    """As full_merge, for inputs that share further columns: those come from the first input alone, null where it has no row."""
    return full_merge([dfs[0], *(df.drop(*only_first) for df in dfs[1:])], keys)


def spine(df: DataFrame, entity: str, season: str, week: str, carry: Sequence[str] = ()) -> DataFrame:
    """Dense panel: each entity has a row for every period of a season from its first one on."""
    first = df.groupBy(entity, season, *carry).agg(F.min(week).alias("__first"))
    last = df.groupBy(season).agg(F.collect_set(week).alias("__weeks"))
    dense = first.join(last, season).withColumn(week, F.explode(F.filter("__weeks", lambda w: w >= F.col("__first"))))
    return dense.drop("__first", "__weeks")


def running_event_count(df: DataFrame, events: DataFrame, keys: Sequence[str], order: str, name: str = "n_events") -> DataFrame:
    """Events of the same keys at or before each row, by a running sum over both kinds of rows, not a range join."""
    marks = events.groupBy(*keys, order).agg(F.count("*").alias("__n"))
    asked = df.select(*keys, order).distinct()
    both = marks.join(asked.withColumn("__asked", F.lit(True)), [*keys, order], "full")
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn(name, F.coalesce(F.sum("__n").over(w), F.lit(0))).where("__asked").select(*keys, order, name)
    return df.join(counted, [*keys, order], "left")


def densify(dense: DataFrame, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return dense.join(df, list(keys), "left")


def prev_period(df: DataFrame, keys: Sequence[str], week: str, cols: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Values of exactly the period before; a gap gives null. One window, no self join."""
    w = Window.partitionBy(*keys).orderBy(week)
    near = F.lag(week).over(w) == F.col(week) - 1
    return df.select("*", *(F.when(near, F.lag(c).over(w)).alias(prefix + c) for c in cols))


def next_period_outcome(df: DataFrame, outcomes: DataFrame, keys: Sequence[str], week: str) -> DataFrame:
    """Inner join to the outcome of the following period."""
    return df.join(outcomes.withColumn(week, F.col(week) - 1), [*keys, week], "inner")


def anti(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other, list(on), "left_anti")


def semi(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other, list(on), "left_semi")


def with_config(df: DataFrame, config: DataFrame, group: str | Sequence[str]) -> DataFrame:
    return df.join(config, group, "inner")


def overlap(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that both have."""
    return a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_semi")


def paired_join(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return a.select(*keys, F.col(value).alias(f"{value}_a")).join(b.select(*keys, F.col(value).alias(f"{value}_b")), list(keys), "inner")


def enrich(rows: DataFrame, names: DataFrame, on: str, name: str) -> DataFrame:
    """Adds a name; the id stands in where there is none."""
    return rows.join(names.select(on, F.col(name).alias("__name")), on, "left").withColumn(name, F.coalesce("__name", F.col(on).cast("string"))).drop("__name")


def appeared_last(df: DataFrame, played: DataFrame, keys: Sequence[str], week: str, name: str = "played_last") -> DataFrame:
    shifted = played.select(*keys, (F.col(week) + 1).alias(week)).distinct().withColumn(name, F.lit(True))
    return df.join(shifted, [*keys, week], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def cross_one(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Adds the columns of a frame that has one row at most (taken by an aggregate, so its size is known)."""
    cols = one_row.columns
    single = one_row.agg(*(F.first(c).alias(c) for c in cols), F.count("*").alias("__n")).where("__n > 0").drop("__n")
    return df.crossJoin(F.broadcast(single))


def opponent_history(df: DataFrame, history: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], asof: bool = True) -> DataFrame:
    """The opponent's history for each row. With `asof`, rows of periods that have no history row yet (upcoming ones)
    take the latest earlier value; without it, they are null."""
    if not asof:
        return df.join(history, [*keys, *order], "left")
    # rows and history meet in one window per opponent: each row takes the last history value before it
    asked = df.select(*keys, *order).distinct().withColumn("__h", F.lit(None).cast(dict(history.dtypes)[value])).withColumn("__kind", F.lit(1))
    known = history.select(*keys, *order, F.col(value).alias("__h")).withColumn("__kind", F.lit(0))
    w = Window.partitionBy(*keys).orderBy(*order, "__kind").rowsBetween(Window.unboundedPreceding, 0)
    filled = asked.unionByName(known).withColumn(value, F.last("__h", ignorenulls=True).over(w)).where("__kind = 1")
    return df.join(filled.select(*keys, *order, value), [*keys, *order], "left")


def null_safe(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
