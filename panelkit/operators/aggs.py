"""Aggregations: partial sums before every shuffle, exact statistics, no driver-side arithmetic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import bin_right, col
from . import order_stats
from .windows import avg_rank


def group_agg(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*(c.alias(name) for name, c in aggs.items()))


def rate(flag: str | Column) -> Column:
    """Share of true among known values."""
    return F.avg(col(flag).cast("int"))


def latest_by(df: DataFrame, key: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Values of each key's last row by a composite order."""
    return df.groupBy(*key).agg(*(F.max_by(c, F.struct(*order)).alias(c) for c in cols))


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(*(F.min_by(c, F.struct(*order)).alias(c) for c in cols))


def all_true(df: DataFrame, keys: Sequence[str], flag: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.bool_and(flag).alias(name))


def weighted_mean(w: str | Column, x: str | Column, where: Column | None = None) -> Column:
    """sum(w x) / sum(w) over rows where x is known (and the condition holds); null without any."""
    keep = col(x).isNotNull() if where is None else col(x).isNotNull() & where
    return F.sum(F.when(keep, col(w) * col(x))) / F.nullif(F.sum(F.when(keep, col(w))), F.lit(0))


def weighted_mean_by(df: DataFrame, keys: Sequence[str], component: str, values: Sequence[str], w: str, x: str, scale: float = 100.0) -> DataFrame:
    """A renormalised weighted mean per component, in columns named after the components."""
    return df.groupBy(*keys).agg(*((scale * weighted_mean(w, x, F.col(component) == v)).alias(f"{v}_score") for v in values))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def mean_se(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """n, mean (null for n = 0), se (null for n < 2) from the sample variance."""
    n = F.count(x)
    return df.groupBy(*keys).agg(n.alias("n"), F.avg(x).alias("mean"), F.when(n >= 2, F.stddev_samp(x) / F.sqrt(n)).alias("se"))


def pooled(x: str, n: str) -> Column:
    return F.sum(F.col(x) * F.col(n)) / F.nullif(F.sum(F.when(F.col(x).isNotNull(), F.col(n))), F.lit(0))


def pooled_rmse(x: str, n: str) -> Column:
    return F.sqrt(F.sum(F.col(x) * F.col(x) * F.col(n)) / F.nullif(F.sum(F.when(F.col(x).isNotNull(), F.col(n))), F.lit(0)))


def pearson(x: str | Column, y: str | Column, least: int = 3) -> Column:
    """Correlation of the complete pairs; null for fewer than `least` or where either side does not vary."""
    known = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(known, col(x).cast("double")), F.when(known, col(y).cast("double"))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    # a spread that is only rounding noise of a constant column counts as none
    varies = (F.max(a) > F.min(a)) & (F.max(b) > F.min(b))
    return F.when((F.count(a) >= least) & varies, F.try_divide(F.covar_pop(a, b), spread))


def pearson_by(df: DataFrame, keys: Sequence[str], x: str, y: str, name: str = "r") -> DataFrame:
    return df.groupBy(*keys).agg(pearson(x, y).alias(name))


def spearman_by(df: DataFrame, keys: Sequence[str], x: str, y: str, name: str = "rho") -> DataFrame:
    """Pearson on average ranks of the complete pairs."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = avg_rank(avg_rank(pairs, keys, x, "__rx"), keys, y, "__ry")
    return pearson_by(ranked, keys, "__rx", "__ry", name)


def lift_by(df: DataFrame, keys: Sequence[str], score: str, outcome: str, tie: str, k: int, name: str = "lift") -> DataFrame:
    """Mean outcome of the k best by score, less the mean of all; null unless a group has more than k rows."""
    placed = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), tie)))
    best = F.avg(F.when(F.col("__n") <= k, F.col(outcome)))
    return placed.groupBy(*keys).agg(F.when(F.count("*") > k, best - F.avg(outcome)).alias(name))


def quantile_exact(x: str | Column, q: float) -> Column:
    """Linear interpolation between order statistics."""
    return F.percentile(col(x), q)


def medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: the median of each column over the whole table, null for a column without a value. Values are ordered over all
    tasks; see `order_stats`."""
    found = order_stats.quantiles(df, [], cols, [0.5])
    return found.agg(*(F.max(F.when(F.col("column") == c, F.col("values")[0])).alias(c) for c in cols))


def error_metrics(y: str, p: str, low: str, high: str, within: float = 5.0) -> dict[str, Column]:
    """mae, rmse, coverage and the share within `within` of the outcome, bounds included."""
    miss = F.abs(F.col(y) - F.col(p))
    return {
        "n": F.count(F.col(y) - F.col(p)), "mae": F.avg(miss), "rmse": F.sqrt(F.avg(miss * miss)),
        "coverage": rate((F.col(y) >= F.col(low)) & (F.col(y) <= F.col(high))), "within": rate(miss <= within + 1e-9),
    }


def error_by(df: DataFrame, group: str | Column, y: str, model: str, baseline: str, name: str = "category") -> DataFrame:
    """Size, mean error of model and baseline, and the margin between them."""
    errors = df.groupBy(col(group).alias(name)).agg(F.count("*").alias("n"), F.avg(F.abs(F.col(y) - F.col(model))).alias("model_mae"), F.avg(F.abs(F.col(y) - F.col(baseline))).alias("baseline_mae"))
    return errors.withColumn("margin", F.col("baseline_mae") - F.col("model_mae"))


def error_by_tier(df: DataFrame, x: str, y: str, model: str, baseline: str, edges: Sequence[float] = (-0.01, 4, 8, 13, 100)) -> DataFrame:
    return error_by(df.withColumn("__tier", bin_right(x, edges)).where("__tier is not null"), "__tier", y, model, baseline, "tier")


def pivot_diff(df: DataFrame, keys: Sequence[str], side: str, values: tuple[str, str], x: str) -> DataFrame:
    """Mean of x on either side of each key, and the difference of first and second."""
    wide = df.groupBy(*keys).pivot(side, list(values)).agg(F.avg(x))
    return wide.withColumn("diff", F.col(values[0]) - F.col(values[1]))


def worst_share(df: DataFrame, x: str, percent: float, tie: str) -> DataFrame:
    """Share of the total that the worst `percent` of rows hold. The cut-off is exact: rows above it are summed, and as
    many of those equal to it as are still due, so nothing is sorted into one task."""
    n = df.where(F.col(x).isNotNull()).count()
    k = max(1, int(n * percent / 100))
    cut = order_stats.quantiles(df, [], [x], [1 - (k - 1) / max(1, n - 1) if n > 1 else 1.0]).select(F.col("values")[0].alias("__cut"))
    joined = df.crossJoin(F.broadcast(cut))
    above = F.col(x) > F.col("__cut") + 1e-12
    due = F.lit(k) - F.count_if(above)
    return joined.agg(((F.sum(F.when(above, F.col(x)).otherwise(0.0)) + due * F.first("__cut")) / F.sum(x)).alias("share"))


def with_total(df: DataFrame, group: str, aggs: Mapping[str, Column], total: str = "ALL") -> DataFrame:
    """A row per group and one for all."""
    rolled = df.rollup(group).agg(*(c.alias(name) for name, c in aggs.items()), F.grouping(group).alias("__all"))
    return rolled.withColumn(group, F.when(F.col("__all") == 1, total).otherwise(F.col(group))).drop("__all")


def accumulators(x: str, w: str) -> tuple[Column, Column]:
    """Terms of a volume-weighted mean: x w, and w where x is known; null as 0."""
    return F.coalesce(F.col(x) * F.col(w), F.lit(0.0)), F.when(F.col(x).isNotNull(), F.coalesce(F.col(w), F.lit(0))).otherwise(0)


def contiguity(df: DataFrame, keys: Sequence[str], rank: str) -> DataFrame:
    """Groups whose ranks are not 1..N: a gap, a repeat, or a start elsewhere."""
    seen = df.where(F.col(rank).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(rank).alias("distinct"), F.min(rank).alias("low"), F.max(rank).alias("high"))
    return seen.where("n <> distinct or low <> 1 or high <> n")


def best_of(named: Mapping[str, str | Column]) -> Column:
    """The name of the smallest value, ties by name; nulls do not count."""
    pairs = F.array(*(F.when(col(c).isNotNull(), F.struct(col(c).cast("double").alias("value"), F.lit(n).alias("name"))) for n, c in named.items()))
    return F.array_min(pairs)["name"]
