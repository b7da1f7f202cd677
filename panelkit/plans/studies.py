"""Statistical studies as reusable jobs on a panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import distributions
from ..functions.scalar import bin_right
from ..operators import aggs, windows
from ..sources.scratch import stored


def home_margin(games: DataFrame, season: str, home: str, away: str) -> DataFrame:
    """Mean home margin and win rate by season, and over all."""
    d = F.col(home) - F.col(away)
    return aggs.with_total(games.withColumn(season, F.col(season).cast("string")), season, {"n": F.count("*"), "margin": F.avg(d), "win_rate": aggs.rate(d > 0)})


def paired_within(df: DataFrame, entity: Sequence[str], side: Column, x: str, least: int = 4, min_mean: float = 0.0) -> DataFrame:
    """Mean difference between two conditions within the same entity, over entities with enough of both."""
    per = df.groupBy(*entity).agg(F.avg(F.when(side, F.col(x))).alias("a"), F.avg(F.when(~side, F.col(x))).alias("b"), F.count_if(side).alias("na"), F.count_if(~side).alias("nb"), F.avg(x).alias("m"))
    return aggs.mean_se(per.where((F.col("na") >= least) & (F.col("nb") >= least) & (F.col("m") >= min_mean)).withColumn("d", F.col("a") - F.col("b")), [], "d")


def heterogeneity(df: DataFrame, group: str, x: str) -> DataFrame:
    """One-way F of group means, its degrees of freedom and its p."""
    per = df.groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    total = per.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"), F.count("*").alias("k"))
    joined = per.crossJoin(F.broadcast(total.withColumnRenamed("n", "total")))
    between = F.sum(F.col("n") * (F.col("m") - F.col("gm")) ** 2) / (F.first("k") - 1)
    within = F.sum(F.col("n") * F.col("v")) / (F.first("total") - F.first("k"))
    return joined.agg((between / F.nullif(within, F.lit(0.0))).alias("f"), (F.first("k") - 1).alias("df1"), (F.first("total") - F.first("k")).alias("df2")).withColumn("p", distributions.p_of_f(F.col("f"), F.col("df1"), F.col("df2")))


def chi_square(df: DataFrame, group: str, event: Column) -> DataFrame:
    """Sum over groups of (seen - expected)^2 / expected events at the common rate."""
    per = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(event).alias("seen"))
    total = per.agg((F.sum("seen") / F.sum("n")).alias("rate"))
    e = F.col("n") * F.col("rate")
    return per.crossJoin(F.broadcast(total)).agg(F.sum((F.col("seen") - e) ** 2 / F.nullif(e, F.lit(0.0))).alias("chi2"), (F.count("*") - 1).alias("df")).withColumn("p", distributions.p_of_chi_square(F.col("chi2"), F.col("df")))


def repeatability(a: DataFrame, b: DataFrame, group: str, x: str) -> DataFrame:
    """Correlation of group means between two sets of rows, and its p."""
    mean = lambda df, name: df.groupBy(group).agg(F.avg(x).alias(name))
    return mean(a, "x").join(mean(b, "y"), group).agg(F.count("*").alias("n"), aggs.pearson("x", "y").alias("r")).withColumn("p", distributions.p_of_r(F.col("r"), F.col("n")))


def welch_t(df: DataFrame, flag: Column, x: str) -> DataFrame:
    s = df.agg(*(f(F.when(c, F.col(x))).alias(f"{n}{k}") for k, c in (("1", flag), ("0", ~flag)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    e1, e0 = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    return s.select((F.col("m1") - F.col("m0")).alias("difference"), ((F.col("m1") - F.col("m0")) / F.sqrt(e1 + e0)).alias("t"), ((e1 + e0) ** 2 / (e1**2 / (F.col("n1") - 1) + e0**2 / (F.col("n0") - 1))).alias("df")).withColumn("p", distributions.p_of_t(F.col("t"), F.col("df")))


def reliability(df: DataFrame, entity: str, season: str, week: str, metrics: Sequence[str]) -> DataFrame:
    """Per metric: correlation with the next season, and split-half reliability 2r / (1 + r) from odd and even periods."""
    long = df.select(entity, season, week, *(F.col(m).cast("double") for m in metrics)).unpivot([entity, season, week], list(metrics), "metric", "value")
    yearly = long.groupBy("metric", entity, season).agg(F.avg("value").alias("x"), F.avg(F.when(F.col(week) % 2 == 1, F.col("value"))).alias("odd"), F.avg(F.when(F.col(week) % 2 == 0, F.col("value"))).alias("even"))
    after = yearly.select("metric", entity, (F.col(season) - 1).alias(season), F.col("x").alias("y"))
    year = yearly.join(after, ["metric", entity, season]).groupBy("metric").agg(F.count("*").alias("pairs"), aggs.pearson("x", "y").alias("year_r"))
    half = yearly.groupBy("metric").agg(aggs.pearson("odd", "even").alias("r")).select("metric", (2 * F.col("r") / (1 + F.col("r"))).alias("split_half"))
    return year.join(half, "metric")


def expected_counts(train: DataFrame, df: DataFrame, keys: Sequence[str], kind: str, x: str, edges: Sequence[float], event: str) -> DataFrame:
    """Event rate by kind and bin, learned on `train`, summed over `df` as expected events beside those seen."""
    binned = lambda d: d.withColumn("__bin", bin_right(x, edges))
    rates = binned(train).groupBy(kind, "__bin").agg(aggs.rate(F.col(event)).alias("rate"))
    return binned(df).join(rates, [kind, "__bin"]).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(event)).alias("seen"), F.sum("rate").alias("expected"))


def dispersion(counts: DataFrame, seen: str = "seen", expected: str = "expected") -> DataFrame:
    return counts.agg((F.var_samp(seen) / F.avg(seen)).alias("var_to_mean"), (F.sum((F.col(seen) - F.col(expected)) ** 2 / F.nullif(F.col(expected), F.lit(0.0))) / F.count("*")).alias("pearson"))


def trailing_corr(df: DataFrame, entity: Sequence[str], order: Sequence[str], xs: Sequence[str], y: str, n: int, min_periods: int) -> DataFrame:
    """How well the trailing mean of each x predicts y."""
    for x in xs:
        df = windows.trailing_min(df, entity, order, x, n, min_periods, f"__{x}")
    return df.agg(*(aggs.pearson(f"__{x}", y).alias(x) for x in xs))


def binned_effect(df: DataFrame, x: str, y: str, edges: Sequence[float]) -> DataFrame:
    """Size, mean and standard error of y by bin of x."""
    return aggs.mean_se(df.withColumn("bin", bin_right(x, edges)).where("bin is not null"), ["bin"], y)


def line_effect(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), aggs.pearson(x, y).alias("r"))


def substitution(df: DataFrame, team: str, entity: str, season: str, week: str, usage: str, ruled_out: DataFrame, back: int = 5, min_periods: int = 3, least: float = 5.0, others: int = 3) -> DataFrame:
    """What the next options do when a team's first option is ruled out, and when it plays.

    A row's form is the mean usage of the `back` rows before it (of `min_periods` at least). Before each period of a team,
    every entity stands with the form of its latest row of an earlier period of the season; the first option is the one with
    the most (ties by entity), if it has `least` or more and there are two at least. state: "present" if it has a row in the
    period, "out" if it has none and is in `ruled_out` (entity, season, week). The next options are the `others` with the
    most form of those that play; two at least. Per state: team periods, mean and standard error of how far the usage of the
    next options, and of the whole team, is above form.
    """
    spot = [team, season, week]
    rows = windows.trailing_min(df.select(*spot, entity, usage), [entity], [season, week], usage, back, min_periods, "form")
    played = rows.select(*spot).distinct()
    # a row stands for its entity in the team's periods after it, up to its next row and including that period
    after = F.lead(week).over(Window.partitionBy(entity, team, season).orderBy(week))
    last = played.groupBy(team, season).agg(F.max(week).alias("__last"))
    stands = rows.withColumn("__until", after).join(last, [team, season]).withColumn("__until", F.coalesce("__until", "__last")).where((F.col("__until") > F.col(week)) & F.col("form").isNotNull())
    stands = stands.withColumn(week, F.explode(F.sequence(F.col(week) + 1, F.col("__until")))).join(played, spot, "left_semi")
    best = stands.groupBy(*spot).agg(F.count("*").alias("__n"), F.max_by(entity, F.struct("form", F.negative(F.col(entity)))).alias("__first"), F.max("form").alias("__top"))
    best = best.where((F.col("__n") >= 2) & (F.col("__top") >= least)).drop("__n", "__top")
    out = ruled_out.select(F.col(entity).alias("__first"), season, week).distinct().withColumn("__out", F.lit(True))
    now = rows.join(best, spot)
    is_first = F.col(entity) == F.col("__first")
    ranked = windows.rank_rows(now.withColumn("__other", ~is_first & F.col("form").isNotNull()), spot, [F.col("form").desc(), F.col(entity)], "__other", "__rank")
    next_ = F.when(F.col("__rank") <= others, F.col(usage) - F.col("form"))
    team_rows = ranked.groupBy(*spot, "__first").agg(F.bool_or(is_first).alias("__present"), F.avg(next_).alias("next"), F.count(next_).alias("__k"), (F.sum(usage) - F.sum(F.coalesce("form", F.lit(0.0)))).alias("team_total"))
    known = team_rows.where("__k >= 2").join(out, ["__first", season, week], "left")
    state = F.when(F.col("__present"), "present").when(F.col("__out"), "out")
    known = known.withColumn("state", state).where("state is not null")
    se = lambda c: F.stddev_samp(c) / F.sqrt(F.count(c))
    return known.groupBy("state").agg(F.count("*").alias("n"), F.avg("next").alias("next_mean"), se("next").alias("next_se"), F.avg("team_total").alias("team_mean"), se("team_total").alias("team_se"))


def r2(y: str, p: str) -> Column:
    """1 - SSE / SST."""
    return 1 - F.sum((F.col(y) - F.col(p)) ** 2) / F.nullif(F.var_pop(F.when(F.col(p).isNotNull(), F.col(y))) * F.count(F.col(y) - F.col(p)), F.lit(0.0))


def _period_index(graded: DataFrame, order: Sequence[str]) -> DataFrame:
    """(period, i): periods in order; one row each, so the window over all of them is small."""
    return graded.select(*order).distinct().withColumn("__i", F.row_number().over(Window.orderBy(*order)))


def weekly_learning(graded: DataFrame, group: str, order: Sequence[str], y: str, members: Mapping[str, float], frozen: str, naive: str, bias_periods: int = 4, weight_periods: int = 6) -> DataFrame:
    """Mean error of five strategies over graded rows.

    members: columns of predictions that are refitted each period, with their plain weights. retrain is their plain blend;
    retrain_bias adds the group's mean error of the last `bias_periods` graded periods; adaptive weighs members by the
    inverse square of their mean error over the last `weight_periods`, all groups together (plain weights until there are
    two), and adds the same bias; `frozen` and `naive` are columns that do not learn. All history ends one period before.
    """
    blend = sum((w * F.col(m) for m, w in members.items()), F.lit(0.0))
    rows = graded.withColumn("__retrain", blend).join(F.broadcast(_period_index(graded, order)), list(order))
    per = rows.groupBy(group, "__i").agg(F.sum(F.col(y) - F.col("__retrain")).alias("__s"), F.count("*").alias("__n"))
    recent = Window.partitionBy(group).orderBy("__i").rangeBetween(-bias_periods, -1)
    bias = per.select(group, "__i", F.coalesce(F.sum("__s").over(recent) / F.sum("__n").over(recent), F.lit(0.0)).alias("__bias"))
    misses = rows.groupBy("__i").agg(F.count("*").alias("__n"), *(F.sum(F.abs(F.col(y) - F.col(m))).alias(f"__e_{m}") for m in members))
    before, all_before = Window.orderBy("__i").rangeBetween(-weight_periods, -1), Window.orderBy("__i").rangeBetween(Window.unboundedPreceding, -1)
    inverse = {m: F.lit(1.0) / F.greatest(F.sum(f"__e_{m}").over(before) / F.sum("__n").over(before), F.lit(1e-6)) ** 2 for m in members}
    weighed = misses.select("__i", F.count("*").over(all_before).alias("__k"), *(c.alias(f"__v_{m}") for m, c in inverse.items()))
    total = sum((F.col(f"__v_{m}") for m in members), F.lit(0.0))
    weighed = weighed.select("__i", *(F.when(F.col("__k") >= 2, F.col(f"__v_{m}") / total).otherwise(w).alias(f"__w_{m}") for m, w in members.items()))
    shown = rows.join(bias, [group, "__i"]).join(F.broadcast(weighed), "__i")
    adaptive = sum((F.col(f"__w_{m}") * F.col(m) for m in members), F.lit(0.0)) + F.col("__bias")
    strategies = {"naive": F.col(naive), "frozen": F.col(frozen), "retrain": F.col("__retrain"), "retrain_bias": F.col("__retrain") + F.col("__bias"), "adaptive": adaptive}
    told = F.explode(F.array(*(F.struct(F.lit(k).alias("strategy"), F.abs(F.col(y) - c).alias("miss")) for k, c in strategies.items())))
    found = shown.select(*order, told.alias("t")).groupBy(F.col("t.strategy").alias("strategy"))
    late = F.col(order[-1]) > 9
    return found.agg(F.count("*").alias("n"), F.avg("t.miss").alias("mae"), F.avg(F.when(~late, F.col("t.miss"))).alias("first_half"), F.avg(F.when(late, F.col("t.miss"))).alias("second_half"))


def player_learning(graded: DataFrame, entity: Sequence[str], order: Sequence[str], y: str, p: str, form: tuple[str, str, str], k: float = 8.0, least: int = 3, turn: float = 0.35, follow: float = 0.45) -> DataFrame:
    """Mean error of predictions as they are, and with what an entity's own past adds to them.

    player_bias adds the mean error of its earlier rows times n / (n + k), from `least` rows on. role_change adds `follow` of
    the difference of short and long form (form: columns of a short, middle and long mean) where it is more than `turn` of
    the mean of middle and long. both adds both. oracle is the bound: each entity's bias over all rows, known beforehand.
    """
    rows = graded.withColumn("__e", F.col(y) - F.col(p))
    past, own = windows.past(entity, order), Window.partitionBy(*entity)
    short, middle, long = map(F.col, form)
    n, all_n = F.count("__e").over(past), F.count("__e").over(own)
    shift = F.when(n >= least, F.avg("__e").over(past) * n / (n + k)).otherwise(0.0)
    usual = F.coalesce((middle + long) / 2, middle, long)
    change = F.coalesce(short - long, F.lit(0.0))
    turned = F.coalesce(F.abs(change) > turn * F.greatest(usual, F.lit(1.0)), F.lit(False))
    rows = rows.select("*", shift.alias("__shift"), F.when(turned, follow * change).otherwise(0.0).alias("__role"), (F.avg("__e").over(own) * all_n / (all_n + k)).alias("__truth"))
    miss = lambda c: F.avg(F.abs(F.col("__e") - c))
    changed = lambda c: F.count_if(F.abs(F.col(c)) > 1e-9)  # noqa: E731 - errors that cancel out leave rounding noise
    return rows.agg(
        F.count("*").alias("n"), miss(F.lit(0.0)).alias("base"), miss(F.col("__shift")).alias("player_bias"), miss(F.col("__role")).alias("role_change"),
        miss(F.col("__shift") + F.col("__role")).alias("both"), miss(F.col("__truth")).alias("oracle"),
        changed("__shift").alias("with_bias"), changed("__role").alias("with_role_change"),
    )


def error_anatomy(graded: DataFrame, flags: Mapping[str, Column], y: str, p: str) -> DataFrame:
    """Per flag, and for rows with any of them: rows, mean error, what would be gained if flagged rows were as good as the
    others, and the share of all error that flagged rows hold."""
    rows = graded.withColumn("__e", F.abs(F.col(y) - F.col(p)))
    known = {name: F.coalesce(c, F.lit(False)) for name, c in flags.items()}
    any_ = F.lit(False)
    for c in known.values():
        any_ = any_ | c
    tags = F.array(*(F.struct(F.lit(n).alias("flag"), c.alias("on")) for n, c in [*known.items(), ("any", any_)]))
    long = rows.select("__e", F.explode(tags).alias("t")).select("__e", "t.flag", "t.on")
    on, off = F.avg(F.when(F.col("on"), F.col("__e"))), F.avg(F.when(~F.col("on"), F.col("__e")))
    share = F.sum(F.when(F.col("on"), F.col("__e")).otherwise(0.0)) / F.sum("__e")
    return long.groupBy("flag").agg(F.count_if("on").alias("n"), on.alias("mae"), (on - off).alias("excess"), ((on - off) * F.count_if("on") / F.count("*")).alias("prize"), share.alias("share"))


def availability_study(df: DataFrame, y: str, p: str, category: str, least: int = 40) -> DataFrame:
    """Outcome rate and mean squared error of a probability, by category with enough rows."""
    return df.groupBy(category).agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("rate"), F.avg((F.col(p) - F.col(y).cast("double")) ** 2).alias("brier")).where(F.col("n") >= least)


def auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """Area under the ROC curve by average ranks, counted per distinct score.

    Scores are range-partitioned: a running sum within each part, plus what lower parts hold, which is a row a part.
    """
    per = df.groupBy(p).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    spread = stored(per.repartitionByRange(p).withColumn("__part", F.spark_partition_id()), "scores")
    held = spread.groupBy("__part").agg(F.sum("neg").alias("__neg"))
    first = held.select("__part", F.coalesce(F.sum("__neg").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("__part").orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = spread.withColumn("below", inside).join(F.broadcast(first), "__part").withColumn("below", F.col("below") + F.col("__first"))
    return placed.agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def margin_by_cutoff(df: DataFrame, x: str, cuts: Sequence[float], y: str, model: str, base: str) -> DataFrame:
    """Rows and margin over the baseline among rows at or above each cut-off, in one pass."""
    each = df.withColumn("cut", F.explode(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col(x) >= c)))
    found = aggs.error_by(each, "cut", y, model, base, "cut")
    return found.select("cut", "n", "model_mae", "baseline_mae", "margin")


def relative_to_own_average(df: DataFrame, entity: Sequence[str], group: str, x: str, least: int = 15) -> DataFrame:
    """Mean over a group of each row's value less its entity's own mean."""
    own = windows.over_group(df, entity, "avg", x, "__own")
    return own.groupBy(group).agg(F.count("*").alias("n"), F.avg(F.col(x) - F.col("__own")).alias("relative")).where(F.col("n") >= least)


def _lines(df: DataFrame, season: str, x: str, y: str, trained: Column | None, name: str) -> DataFrame:
    """(season, <name>_slope, <name>_at): the line of y on x fitted on all earlier seasons. Sums per season, one row each,
    are added up over seasons, so every season's refit costs one pass over the table in all."""
    rows = df.where(trained) if trained is not None else df
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    per = rows.where(a.isNotNull() & b.isNotNull()).groupBy(season).agg(F.count("*").cast("double").alias("__n"), F.sum(a).alias("__x"), F.sum(b).alias("__y"), F.sum(a * a).alias("__xx"), F.sum(a * b).alias("__xy"))
    every = df.select(season).distinct().join(per, season, "left").fillna(0.0)
    before = Window.orderBy(season).rowsBetween(Window.unboundedPreceding, -1)
    sums = every.select(season, *(F.sum(c).over(before).alias(c) for c in ("__n", "__x", "__y", "__xx", "__xy")))
    slope = (F.col("__n") * F.col("__xy") - F.col("__x") * F.col("__y")) / F.nullif(F.col("__n") * F.col("__xx") - F.col("__x") * F.col("__x"), F.lit(0.0))
    return sums.select(season, slope.alias(f"{name}_slope"), ((F.col("__y") - slope * F.col("__x")) / F.col("__n")).alias(f"{name}_at")).where(f"{name}_slope is not null")


def line_replay(df: DataFrame, season: str, x: str, y: str, trained: Column | None = None, name: str = "points") -> DataFrame:
    """`df` with the prediction of a line of y on x that is fitted on all earlier seasons (of the rows `trained` alone, if
    given). Seasons without two different x before them are left out."""
    lines = _lines(df, season, x, y, trained, "__line")
    return df.join(F.broadcast(lines), season).withColumn(name, F.col("__line_at") + F.col("__line_slope") * F.col(x)).drop("__line_at", "__line_slope")


def wide_vs_narrow(df: DataFrame, season: str, x: str, y: str, base: str, eligible: Column) -> DataFrame:
    """The same model learned from everyone and from eligible rows alone, both graded on eligible rows: rows, error, margin
    over the baseline, and which of the two is better by it."""
    lines = _lines(df, season, x, y, None, "wide").join(_lines(df, season, x, y, eligible, "narrow"), season)
    both = df.where(eligible & F.col(x).isNotNull() & F.col(base).isNotNull()).join(F.broadcast(lines), season)
    told = F.explode(F.array(*(F.struct(F.lit(k).alias("population"), F.abs(F.col(y) - F.col(f"{k}_at") - F.col(f"{k}_slope") * F.col(x)).alias("miss")) for k in ("wide", "narrow"))))
    found = both.select(told.alias("t"), F.abs(F.col(y) - F.col(base)).alias("b")).groupBy(F.col("t.population").alias("population"))
    per = found.agg(F.count("*").alias("n"), F.avg("t.miss").alias("mae"), (F.avg("b") - F.avg("t.miss")).alias("margin"))
    return per.withColumn("better", F.col("margin") == F.max("margin").over(Window.partitionBy()))


def calibration_population(df: DataFrame, calibrates: Column, low: str, high: str, y: str, eligible: Column, offset) -> DataFrame:
    """Ranges moved by an offset learned from everyone, and from eligible rows alone; both graded on eligible rows that do
    not calibrate: rows, coverage and mean width. offset: a function of rows that gives one row with the column offset."""
    shown, tables = df.where(~calibrates & eligible), []
    for name, rows in (("everyone", df.where(calibrates)), ("eligible", df.where(calibrates & eligible))):
        moved = shown.crossJoin(F.broadcast(offset(rows).select(F.col("offset").alias("__o"))))
        lo, hi = F.col(low) - F.col("__o"), F.col(high) + F.col("__o")
        tables.append(moved.agg(F.lit(name).alias("population"), F.count("*").alias("n"), aggs.rate((F.col(y) >= lo) & (F.col(y) <= hi)).alias("coverage"), F.avg(hi - lo).alias("width")))
    return tables[0].unionByName(tables[1])


def study_panel(fact: DataFrame, games: DataFrame, entity: str, season: str, week: str, team: str, points: str, usage: Sequence[str], final: str = "is_final", back: int = 5) -> DataFrame:
    """What the studies share: rows of final periods, with the points and usage means of the `back` rows before, the season
    mean so far, prior rows, and what the team's rows have made on average over `back` periods before.

    games: season, week, and whether the period is final; rows of others go before any window looks at them.
    """
    done = games.groupBy(season, week).agg(F.bool_and(final).alias("__final")).where("__final").select(season, week)
    rows = fact.join(F.broadcast(done), [season, week], "left_semi")
    order = [season, week]
    specs = {f"{c}_mean{back}": ("avg", c, back) for c in (points, *usage)} | {"prior_games": ("count", points, None)}
    rows = windows.trailing(windows.trailing(rows, [entity], order, specs), [entity, season], [week], {f"{points}_season": ("avg", points, None)})
    allowed = windows.trailing_of_agg(rows, [team], order, points, back, f"team_{points}_mean{back}")
    return rows.join(allowed, [team, *order], "left")
