"""Does the rank of one period predict the outcome of the next? One declarative plan over all groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import aggs, joins, windows

GROUP = ["season", "week", "position"]
#: Percents of the first score that a blend may have.
SHARES = (0, 20, 40, 50, 60, 70, 80, 100)


def forward_pairs(rankings: DataFrame, outcomes: DataFrame, scores: Sequence[str], no_second: Sequence[str] = (), second: str | None = None) -> DataFrame:
    """Qualified rows with the outcome of exactly the next period; rows without one go. A second outcome is null for the
    groups in no_second."""
    rows = rankings.where("is_qualified").select(*GROUP, "player_id", *scores)
    pairs = joins.next_period_outcome(rows, outcomes, ["player_id", "season"], "week")
    if second and no_second:
        pairs = pairs.withColumn(second, F.when(~F.col("position").isin(*no_second), F.col(second)))
    return pairs


def score_methods(pairs: DataFrame, baselines: Mapping[str, str], shares: Sequence[int] = SHARES, a: str = "efficiency_score", b: str = "production_score") -> DataFrame:
    """One row per pair and method: blends of the two scores by percent of the first, and baseline columns. Where one of the
    two is missing, the other alone is the blend."""
    mixed = lambda s: F.coalesce(F.lit(s / 100) * F.col(a) + F.lit(1 - s / 100) * F.col(b), F.col(a), F.col(b))
    blends = [F.struct(F.lit(f"blend_{s}").alias("method"), mixed(s).alias("score")) for s in shares]
    plain = [F.struct(F.lit(name).alias("method"), F.col(c).cast("double").alias("score")) for name, c in baselines.items()]
    kept = [c for c in pairs.columns if c not in (a, b, *baselines.values())]
    return pairs.select(*kept, F.explode(F.array(*blends, *plain)).alias("__m")).select(*kept, "__m.*")


def score_groups(pairs: DataFrame, outcome: str, baselines: Mapping[str, str], shares: Sequence[int] = SHARES, min_pool: int = 8, k: Mapping[str, int] | int = 12) -> DataFrame:
    """Spearman and top-k lift of every group and method. Small pools go; so does a method with a null score in a group.
    k may differ by position. Scores are rounded first, so that equal ones tie in every run.

    The outcome is ranked before methods multiply the rows; a group's methods then share one shuffle and one sort.
    """
    keys = [*GROUP, "method"]
    pool = pairs.where(F.col(outcome).isNotNull()).withColumn("__n", F.count("*").over(Window.partitionBy(*GROUP))).where(F.col("__n") >= min_pool)
    long = score_methods(windows.avg_rank(pool, GROUP, outcome, "__ro"), baselines, shares).withColumn("score", F.round("score", 9))
    # in the order of (score, id from the last), the place from the end is the place by score, ties by id
    placed = long.withColumn("__place", F.col("__n") - F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").asc_nulls_last(), F.col("player_id").desc())) + 1)
    ranked = windows.avg_rank(placed, keys, "score", "__rs")
    top = F.lit(k) if isinstance(k, int) else F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for item in k.items() for x in item)), F.col("position")), F.lit(12))
    best, n = F.avg(F.when(F.col("__place") <= top, F.col(outcome))), F.count("*")
    found = ranked.groupBy(*keys).agg(n.alias("n"), F.count("score").alias("__known"), aggs.pearson("__rs", "__ro").alias("rho"), (best - F.avg(outcome)).alias("lift"))
    return found.where("__known = n").drop("__known").withColumn("lift", F.when(F.col("n") > top, F.col("lift")))


def summarize(groups: DataFrame, digits: int | None = 4) -> DataFrame:
    """Mean and standard error over weeks by position, and the plain mean over positions as ALL."""
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    se = lambda x: F.when(F.count(x) >= 2, F.stddev_samp(x) / F.sqrt(F.count(x)))
    per = groups.groupBy("position", "method").agg(F.count("rho").alias("weeks"), F.avg("rho").alias("rho"), se("rho").alias("rho_se"), F.avg("lift").alias("lift"), se("lift").alias("lift_se"))
    none = F.lit(None).cast("double")
    every = per.groupBy("method").agg(F.lit("ALL").alias("position"), F.sum("weeks").alias("weeks"), F.avg("rho").alias("rho"), none.alias("rho_se"), F.avg("lift").alias("lift"), none.alias("lift_se"))
    return per.unionByName(every).select("position", "method", "weeks", *(r(F.col(c)).alias(c) for c in ("rho", "rho_se", "lift", "lift_se")))


def paired_difference(groups: DataFrame, a: str, b: str, x: str = "rho") -> DataFrame:
    """By position: mean and standard error of the difference of two methods over the same groups."""
    pairs = joins.paired_join(groups.where(F.col("method") == a), groups.where(F.col("method") == b), GROUP, x)
    return aggs.mean_se(pairs.withColumn("d", F.col(f"{x}_a") - F.col(f"{x}_b")), ["position"], "d")


def split_seasons(seasons: DataFrame, season: str = "season", share: float = 0.6) -> DataFrame:
    """(season, part): of all but the newest season, the first ceil(share) tune and the rest test. One row a season, so the
    window over all of them is small."""
    every = seasons.select(season).distinct()
    placed = every.withColumn("__place", F.dense_rank().over(Window.orderBy(season))).withColumn("__n", F.count("*").over(Window.partitionBy()))
    part = F.when(F.col("__place") <= F.ceil((F.col("__n") - 1) * share), "tune").otherwise("test")
    return placed.where("__place < __n").select(season, part.alias("part"))


def choose_weight(summary: DataFrame, tol: float = 0.005) -> DataFrame:
    """Of the blends within tol of the best mean over positions, the one with the largest first share."""
    blends = summary.where((F.col("position") == "ALL") & F.col("method").startswith("blend_")).select(F.regexp_replace("method", "blend_", "").cast("int").alias("share"), "rho")
    best = blends.agg(F.max("rho").alias("best"))
    return blends.crossJoin(F.broadcast(best)).where(F.col("rho") >= F.col("best") - tol).agg(F.max("share").alias("share"))


def by_bucket(groups: DataFrame, digits: int = 4) -> DataFrame:
    """Mean over positions of each position's mean, by part of the season."""
    bucket = F.when(F.col("week") <= 5, "1-5").when(F.col("week") <= 11, "6-11").otherwise("12+")
    per = groups.groupBy(bucket.alias("bucket"), "method", "position").agg(F.count("rho").alias("weeks"), F.avg("rho").alias("rho"))
    return per.groupBy("bucket", "method").agg(F.sum("weeks").alias("weeks"), F.round(F.avg("rho"), digits).alias("rho"))


def headline(summary: DataFrame, methods: Mapping[str, str], x: str = "rho") -> DataFrame:
    """One row per position with chosen methods side by side."""
    return summary.where("position <> 'ALL'").groupBy("position").agg(*(F.max(F.when(F.col("method") == m, F.col(x))).alias(name) for name, m in methods.items()))


def trailing_groups(head: DataFrame, tol: float = 0.02, current: str = "current", baseline: str = "baseline") -> DataFrame:
    return head.where(F.col(baseline) - F.col(current) > tol)


def run_backtest(groups: Mapping[str, DataFrame], baseline: str, current: str = "blend_20") -> DataFrame:
    """The whole backtest as one table. groups: by name of the outcome, the first of which the blend is chosen for.

    Rows with kind "result" have each outcome, part, method and position (and their mean, ALL). "comparison" has, on test
    seasons of the first outcome, the chosen and the current blend less the baseline, by position; "bucket" has the means of
    those and the baseline by part of the season (in `position`). selected: the method is the one chosen on tune seasons.
    """
    first = next(iter(groups))
    parts = {name: df.join(F.broadcast(split_seasons(df)), "season") for name, df in groups.items()}
    chosen = choose_weight(summarize(parts[first].where("part = 'tune'"), digits=None)).select(F.concat(F.lit("blend_"), "share").alias("chosen"))
    held = parts[first].where("part = 'test'")
    none = F.lit(None).cast("double")
    tables = []
    for name, df in parts.items():
        for part in ("tune", "test"):
            tables.append(summarize(df.where(F.col("part") == part)).select(F.lit("result").alias("kind"), F.lit(name).alias("outcome"), F.lit(part).alias("part"), "method", "position", "weeks", "rho", "rho_se", "lift", "lift_se"))
    base = held.where(F.col("method") == baseline).select(*GROUP, F.col("rho").alias("base"))
    less = held.join(base, GROUP).where(F.col("method") != baseline).withColumn("d", F.col("rho") - F.col("base"))
    less = aggs.mean_se(less, ["position", "method"], "d")
    tables.append(less.select(F.lit("comparison").alias("kind"), F.lit(first).alias("outcome"), F.lit("test").alias("part"), "method", "position", F.col("n").alias("weeks"), F.round("mean", 4).alias("rho"), F.round("se", 4).alias("rho_se"), none.alias("lift"), none.alias("lift_se")))
    tables.append(by_bucket(held).select(F.lit("bucket").alias("kind"), F.lit(first).alias("outcome"), F.lit("test").alias("part"), "method", F.col("bucket").alias("position"), "weeks", "rho", none.alias("rho_se"), none.alias("lift"), none.alias("lift_se")))
    every = tables[0]
    for table in tables[1:]:
        every = every.unionByName(table)
    marked = every.crossJoin(F.broadcast(chosen)).withColumn("selected", F.col("method") == F.col("chosen")).drop("chosen")
    shown = (F.col("kind") == "result") | F.col("selected") | (F.col("method") == current) | ((F.col("kind") == "bucket") & (F.col("method") == baseline))
    return marked.where(shown)
