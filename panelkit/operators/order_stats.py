"""Exact order statistics at size: quantiles of many columns and groups, and ranks inside groups of any size.

Both rest on the same two steps. Values are put in order over range partitions by (group, column, value), so a group with
most of the rows is spread over all tasks; a count for each partition and group says how many rows lie before a part. Windows
over these counts have a row for each partition of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import stored


def _long(df: DataFrame, groups: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """groups, column, x: the values of all columns that are neither null nor NaN."""
    x = lambda c: F.col(c).cast("double")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), x(c).alias("x")) for c in cols))).alias("__v")
    told = df.select(*groups, each).select(*groups, F.col("__v.column").alias("column"), F.col("__v.x").alias("x"))
    return told.where(F.col("x").isNotNull() & ~F.isnan("x"))


def in_parts(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """`df` written in the order of range partitions, with `__part`, the number of its partition."""
    return stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), name)


def quantiles(df: DataFrame, groups: Sequence[str], cols: Sequence[str], levels: Sequence[float]) -> DataFrame:
    """groups, column, n, values: the linearly interpolated quantiles of each column in each group, at the given levels.

    Equal values are one row with their number first, so ties and repeated values cost nothing; then the two order statistics
    beside each level are picked from counts of what lies before. A column without a value in a group has no row.
    """
    keys = [*groups, "column"]
    tally = _long(df, groups, cols).groupBy(*keys, "x").agg(F.count("*").alias("k"))
    parts = in_parts(tally, [*keys, "x"], "order")
    held = parts.groupBy(*keys, "__part").agg(F.sum("k").alias("in_part"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("before", F.coalesce(F.sum("in_part").over(before), F.lit(0))).withColumn("n", F.sum("in_part").over(Window.partitionBy(*keys)))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"h.{c}")) for c in [*keys, "__part"]]
    joined = parts.alias("p").join(held.alias("h"), same).select(*(F.col(f"p.{c}") for c in [*keys, "__part", "x", "k"]), "before", "n")
    upto = F.sum("k").over(Window.partitionBy(*keys, "__part").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("before")
    placed = joined.withColumn("upto", upto)  # this value has the places upto - k + 1 to upto
    first, last = F.col("upto") - F.col("k"), F.col("upto")
    picks, shares = [], []
    for q in levels:
        at = F.lit(float(q)) * (F.col("n") - 1)
        low = F.floor(at)
        has = lambda place: (first <= place) & (place < last)
        picks += [F.max(F.when(has(low), F.col("x"))), F.max(F.when(has(F.least(low + 1, F.col("n") - 1)), F.col("x")))]
        shares.append(float(q))
    got = placed.groupBy(*keys).agg(F.first("n").alias("n"), *(c.alias(f"__s{i}") for i, c in enumerate(picks)))
    value = []
    for i, q in enumerate(shares):
        at = F.lit(q) * (F.col("n") - 1)
        value.append(F.col(f"__s{2 * i}") + (F.col(f"__s{2 * i + 1}") - F.col(f"__s{2 * i}")) * (at - F.floor(at)))
    return got.select(*keys, "n", F.array(*value).alias("values"))


def quantile_row(df: DataFrame, cols: Sequence[str], levels: Sequence[float]) -> dict[str, list[float]]:
    """{column: quantiles} over a whole table, one row a column on the driver; columns without a value are missing."""
    return {r["column"]: list(r["values"]) for r in quantiles(df, [], cols, levels).collect()}


def ranked(df: DataFrame, groups: Sequence[str], by: Column, name: str = "__at") -> DataFrame:
    """`df` with a struct `name`: before (rows of the group with a smaller value), alike (with this value), pool (all).

    Rows are placed by equal values, so that a group's size is no matter: values of a group are counted, the counts run over
    range partitions, and rows find theirs by (group, value). Percent rank is before / (pool - 1), rank is before + 1, average
    rank is before + (alike + 1) / 2. Null values are not ranked: all three are null.
    """
    keyed = df.withColumn("__by", by)
    tally = keyed.where(F.col("__by").isNotNull()).groupBy(*groups, "__by").agg(F.count("*").alias("alike"))
    parts = in_parts(tally, [*groups, "__by"], "ranked")
    held = parts.groupBy(*groups, "__part").agg(F.sum("alike").alias("in_part"))
    earlier = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("offset", F.coalesce(F.sum("in_part").over(earlier), F.lit(0))).withColumn("pool", F.sum("in_part").over(Window.partitionBy(*groups)))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"h.{c}")) for c in [*groups, "__part"]]
    inside = F.sum("alike").over(Window.partitionBy(*(F.col(c) for c in [*groups, "__part"])).orderBy("__by").rowsBetween(Window.unboundedPreceding, -1))
    counted = parts.alias("p").join(held.alias("h"), same).select(*(F.col(f"p.{c}") for c in [*groups, "__part", "__by", "alike"]), "offset", "pool")
    counted = counted.select(*groups, "__by", F.struct((F.coalesce(inside, F.lit(0)) + F.col("offset")).alias("before"), "alike", "pool").alias(name))
    match = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*groups, "__by"]]
    return keyed.alias("l").join(counted.alias("r"), match, "left").select("l.*", f"r.{name}").drop("__by")


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """`df` with 1, 2, ... in each group by `order`, a total order, also where a group is larger than a task: rows lie in range
    partitions by group and order, and the numbers of a part go on from those of the parts before it."""
    parts = in_parts(df, [*groups, *order], name.strip("_"))
    held = parts.groupBy(*groups, "__part").agg(F.count("*").alias("in_part"))
    earlier = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(*groups, "__part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("__offset"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*groups, "__part"]]
    joined = parts.alias("l").join(held.alias("r"), same).select("l.*", "r.__offset")
    inside = F.row_number().over(Window.partitionBy(*groups, "__part").orderBy(*order))
    return joined.withColumn(name, (F.col("__offset") + inside).cast("int")).drop("__part", "__offset")
