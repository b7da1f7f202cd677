"""Window operators over entity-by-period panels, ranking and top-k. Periods order by (season, week), never by arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.scalar import col
from ..sources.scratch import stored
from . import order_stats


def _order(order: Sequence[str | Column]) -> list[Column]:
    return [col(o) for o in order]


def past(entity: Sequence[str], order: Sequence[str], n: int | None = None) -> WindowSpec:
    """The n rows before this one (all, if None); never this one."""
    return Window.partitionBy(*entity).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding if n is None else -n, -1)


def so_far(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0)


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in this order, which has to be total to be repeatable."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def ladder(c: str, values: Sequence[str]) -> Column:
    """Place on a severity ladder, worst first; what it does not have comes last."""
    out = F.lit(len(values))
    for k, v in reversed(list(enumerate(values))):
        out = F.when(F.col(c) == v, k).otherwise(out)
    return out


def dedupe_max(df: DataFrame, keys: Sequence[str], x: str, tie: Sequence[str] = ()) -> DataFrame:
    return dedupe(df, keys, [F.col(x).desc_nulls_last(), *(F.col(t).asc_nulls_last() for t in tie)])


def keep_max(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    return df.withColumn("__max", F.max(x).over(Window.partitionBy(*keys))).where(F.col(x) == F.col("__max")).drop("__max")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], prefix: str = "cum_") -> DataFrame:
    """Running totals, null as 0, all in one window."""
    w = so_far(keys, order)
    return df.select("*", *(F.sum(F.coalesce(F.col(c), F.lit(0))).over(w).alias(prefix + c) for c in cols))


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    w = so_far(keys, order)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def running_count(df: DataFrame, keys: Sequence[str], order: Sequence[str], c: str, name: str) -> DataFrame:
    return df.withColumn(name, F.count(c).over(so_far(keys, order)))


def percentile_score(df: DataFrame, keys: Sequence[str], x: str, lower_is_better: Column, name: str = "percentile", large: bool = False) -> DataFrame:
    """percent_rank of the value, turned round where lower is better; 0.5 in a pool of one.

    A window holds a group in one task. With `large`, groups of any size are ranked over all tasks; a null value has no rank
    then."""
    signed = F.when(lower_is_better, -F.col(x)).otherwise(F.col(x))
    if large:
        at = order_stats.ranked(df, keys, signed, "__at")
        alone = F.col("__at.pool") == 1
        return at.withColumn(name, F.when(alone, 0.5).otherwise(F.col("__at.before") / F.nullif(F.col("__at.pool") - 1, F.lit(0)))).drop("__at")
    w = Window.partitionBy(*keys).orderBy(signed)
    ranked = F.percent_rank().over(w)
    alone = F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == 1  # in the same order: one sort
    return df.withColumn(name, F.when(alone, 0.5).otherwise(ranked))


def rank_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], only: str | None = None, name: str = "rank", large: bool = False) -> DataFrame:
    """1, 2, 3, ... without ties; with `only`, other rows have no rank. With `large`, a group is spread over all tasks."""
    if large:
        out = order_stats.numbered(df, [*keys, *([only] if only else [])], order, name)
        return out.withColumn(name, F.when(F.col(only), F.col(name))) if only else out
    w = Window.partitionBy(*keys, *([only] if only else [])).orderBy(*order)
    n = F.row_number().over(w)
    return df.withColumn(name, F.when(F.col(only), n) if only else n)


def over_group(df: DataFrame, keys: Sequence[str], fn: str, x: str, name: str) -> DataFrame:
    """min, max, sum or avg of the group on each of its rows."""
    return df.withColumn(name, getattr(F, fn)(x).over(Window.partitionBy(*keys)))


def n_distinct_over(df: DataFrame, keys: Sequence[str], x: str, name: str) -> DataFrame:
    """Distinct values of a group, on each row. For few values a group: they meet in a set."""
    return df.withColumn(name, F.size(F.collect_set(x).over(Window.partitionBy(*keys))))


def trailing(df: DataFrame, entity: Sequence[str], order: Sequence[str], specs: dict[str, tuple[str, str, int | None]]) -> DataFrame:
    """Strictly backward-looking aggregates: name -> (function, column, rows back or None for all). One sort serves all."""
    return df.select("*", *(getattr(F, fn)(x).over(past(entity, order, n)).alias(name) for name, (fn, x, n) in specs.items()))


def prior_count(df: DataFrame, entity: Sequence[str], order: Sequence[str], name: str = "prior_games") -> DataFrame:
    return df.withColumn(name, F.count("*").over(past(entity, order)))


def trailing_of_agg(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, n: int, name: str) -> DataFrame:
    """Sum per period first, then the mean of the n periods before."""
    summed = df.groupBy(*keys, *order).agg(F.sum(x).alias("__x"))
    return summed.withColumn(name, F.avg("__x").over(past(keys, order, n))).drop("__x")


def avg_rank(df: DataFrame, keys: Sequence[str], x: str, name: str, large: bool = False) -> DataFrame:
    """Ranks from 1, ties at their mean. Ties are counted in the order of the ranks, so one sort serves both. With `large`, a
    group is spread over all tasks, and a null has no rank."""
    if large:
        at = order_stats.ranked(df, keys, F.col(x), "__at")
        return at.withColumn(name, F.col("__at.before") + (F.col("__at.alike") + 1) / 2).drop("__at")
    w = Window.partitionBy(*keys).orderBy(F.col(x).asc_nulls_last())
    same = F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return df.withColumn(name, F.rank().over(w) + (same - 1) / 2)


def trailing_min(df: DataFrame, entity: Sequence[str], order: Sequence[str], x: str, n: int | None, min_periods: int, name: str) -> DataFrame:
    """Mean of the rows before if at least min_periods of them have a value."""
    w = past(entity, order, n)
    return df.withColumn(name, F.when(F.count(x).over(w) >= min_periods, F.avg(x).over(w)))


def ewm(df: DataFrame, entity: Sequence[str], order: Sequence[str], x: str, alpha: float, min_periods: int, name: str, block: int = 64) -> DataFrame:
    """Exponentially weighted mean of the values before, weights normalised, from `min_periods` values on.

    The k-th value of an entity is one of a block of `block` values. Within a block, values weighted by powers of 1 - alpha
    add up in a running sum; what earlier blocks hold is carried over block by block, as one pair of numbers each, so the
    work grows with the rows and not with their square. Rows without a value see those before them and add nothing.
    """
    keep = 1.0 - alpha
    own = Window.partitionBy(*entity).orderBy(*_order(order))
    seen = F.count(x).over(own.rowsBetween(Window.unboundedPreceding, -1))  # values before this row
    rows = df.withColumn("__k", seen).withColumn("__b", F.floor(F.col("__k") / block)).withColumn("__i", F.col("__k") % block)
    # inside its block, value i weighs keep^(-i) here, and a row at place i takes the sum times keep^(i - 1)
    up = F.pow(F.lit(keep), -F.col("__i"))
    inner = Window.partitionBy(*entity, "__b").orderBy(*_order(order))
    inside = lambda c: F.coalesce(F.sum(c).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    known = F.when(F.col(x).isNotNull(), up)
    rows = rows.withColumn("__s", inside(known * F.col(x))).withColumn("__w", inside(known))
    ends = rows.where(F.col(x).isNotNull()).groupBy(*entity, "__b").agg(*(F.sum(F.pow(F.lit(keep), block - 1 - F.col("__i")) * c).alias(n) for n, c in (("__bs", F.col(x)), ("__bw", F.lit(1.0)))))
    pairs = ends.groupBy(*entity).agg(F.array_sort(F.collect_list(F.struct("__b", "__bs", "__bw"))).alias("__ends"))  # a number pair for `block` rows
    whole = F.lit(keep**block)
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"), F.array().cast("array<struct<b: bigint, s: double, w: double>>").alias("out"))

    def carry(a: Column, e: Column) -> Column:
        s, w = a["s"] * whole + e["__bs"], a["w"] * whole + e["__bw"]
        return F.struct(s.alias("s"), w.alias("w"), F.concat(a["out"], F.array(F.struct((e["__b"] + 1).alias("b"), s.alias("s"), w.alias("w")))).alias("out"))

    carried = pairs.select(*entity, F.explode(F.aggregate("__ends", start, carry, lambda a: a["out"])).alias("__c")).select(*entity, F.col("__c.b").alias("__b"), F.col("__c.s").alias("__cs"), F.col("__c.w").alias("__cw"))
    rows = rows.join(carried, [*entity, "__b"], "left")
    into = F.pow(F.lit(keep), F.col("__i"))
    total = lambda inner_, before: F.col(inner_) * into / keep + F.coalesce(F.col(before), F.lit(0.0)) * into
    mean = total("__s", "__cs") / total("__w", "__cw")
    out = rows.withColumn(name, F.when((F.col("__k") >= min_periods) & (F.col("__k") > 0), mean))
    return out.select(*df.columns, name)


def cumcount(df: DataFrame, entity: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*entity).orderBy(*_order(order))) - 1)


def changed(df: DataFrame, entity: Sequence[str], order: Sequence[str], c: str, name: str) -> DataFrame:
    """Whether a value differs from the row before; false on the first row."""
    before = F.lag(c).over(Window.partitionBy(*entity).orderBy(*_order(order)))
    return df.withColumn(name, F.coalesce(before != F.col(c), F.lit(False)))


def deciles(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "decile", n: int = 10) -> DataFrame:
    return df.withColumn(name, F.ntile(n).over(Window.partitionBy(*keys).orderBy(*_order(order))))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "place") -> DataFrame:
    """The first k rows of each group; Spark keeps k rows a task before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def movers(df: DataFrame, group: Sequence[str], movement: str, rank: str, n: int = 5) -> DataFrame:
    """The n largest rises and the n largest falls of each group, ties by rank."""
    kind = F.when(F.col(movement) > 0, "riser").when(F.col(movement) < 0, "faller")
    moved = df.withColumn("kind", kind).where("kind is not null")
    return top_k(moved, [*group, "kind"], [F.abs(movement).desc(), F.col(rank)], n)


def sort_rows(df: DataFrame, key: str, descending: bool, tie: str) -> DataFrame:
    """Nulls last in both directions."""
    return df.orderBy(F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last(), F.col(tie).asc_nulls_last())


def display_order(df: DataFrame, rank: str, other: str) -> DataFrame:
    return df.orderBy(F.col(rank).asc_nulls_last(), F.col(other).asc_nulls_last())


def total_order(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """The place of every row, 1, 2, 3, ..., in a total order over the whole table.

    Rows are range-partitioned and numbered within their part, after what earlier parts hold (a row a part).
    """
    spread = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    held = spread.groupBy("__part").agg(F.count("*").alias("__n"))
    first = held.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    place = F.col("__first") + F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return spread.join(F.broadcast(first), "__part").withColumn(name, place).drop("__part", "__first")


def largest(df: DataFrame, x: str, n: int, tie: Sequence[str]) -> DataFrame:
    return df.orderBy(F.col(x).desc_nulls_last(), *tie).limit(n)


def extremes(df: DataFrame, x: str, n: int, tie: str) -> DataFrame:
    high, low = largest(df, x, n, [tie]), df.where(F.col(x).isNotNull()).orderBy(F.col(x).asc(), tie).limit(n)
    return high.withColumn("end", F.lit("high")).unionByName(low.withColumn("end", F.lit("low")))


def ranked_search(df: DataFrame, query: str, name: str, team: str, limit: int = 8) -> DataFrame:
    """Names of which a word starts with the query, then names that contain it or teams that equal it."""
    text = query.strip().lower()
    words = F.exists(F.split(F.lower(name), " "), lambda w: w.startswith(text))
    kind = F.when(words, 0).when(F.lower(name).contains(text) | (F.lower(team) == text), 1)
    return df.withColumn("match", kind).where("match is not null").orderBy("match", name).limit(limit)


def chrono_split(df: DataFrame, order: Sequence[str], share: float = 0.2, least_rows: int = 1000, least_held: int = 100) -> tuple[DataFrame, DataFrame | None]:
    """Oldest rows to train on, newest to calibrate with; none held out if too few rows. The cut lies between periods'
    rows by their total order: whole periods are counted, and only the period at the cut is ranked."""
    period, n = list(order[:2]), df.count()
    held = int(n * share)
    if n < least_rows or held < least_held:
        return df, None
    sizes = df.groupBy(*period).agg(F.count("*").alias("n"))
    before = sizes.withColumn("upto", F.sum("n").over(Window.orderBy(*period))).withColumn("first", F.col("upto") - F.col("n"))
    cut = n - held
    edge = before.where((F.col("first") <= cut) & (F.col("upto") > cut)).first()
    key, at = F.struct(*period), F.struct(*(F.lit(edge[c]).cast(dict(df.dtypes)[c]).alias(c) for c in period))
    inside = df.where(key == at).withColumn("__n", F.row_number().over(Window.partitionBy(*period).orderBy(*_order(order))))
    early, late = (inside.where(c).drop("__n") for c in (F.col("__n") <= cut - edge["first"], F.col("__n") > cut - edge["first"]))
    return df.where(key < at).unionByName(early), df.where(key > at).unionByName(late)
