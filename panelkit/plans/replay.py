"""Walk-forward replay of every period, and the models that it, forecasts and the frozen control share.

Ridge of all periods comes from one pass: rows have a place in time, the places at which some fold's training rows end cut
them into segments, and each segment gives its sums of products. A fold's normal equations are the sums of the segments before
its end; missing values are kept as sums of their own, so that each fold can fill them with medians of its own past. All
penalties are tried on these sums alone. Boosted trees and their ranges are fitted again before every season,
and the trees of all seasons grow in step.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import order_bounds
from ..operators import order_stats, shape, windows
from ..sources import sinks
from ..sources.scratch import stored
from . import forecast
from .boosting import Boosted, Growth, cuts_below, fit_many, score_many
from .forecast import ALPHAS, NOMINAL, Spec


@dataclass(frozen=True)
class Fold:
    """A period to predict: rows before it, how many of these are trained on, and of those how many choose the penalty."""

    season: int
    week: int
    past: int
    cut: int
    inner: int


def _held(n: int, share: float = 0.2, least_rows: int = 1000, least_held: int = 100) -> int:
    """How many of the newest of n rows are held out; none of too few."""
    held = int(n * share)
    return 0 if n < least_rows or held < least_held else held


def folds_of(periods: Sequence[tuple[int, int, int]], least_history: int = 2000, least_players: int = 30) -> list[Fold]:
    """periods: (season, week, rows) in order. Those with enough rows, and enough before them."""
    out, past = [], 0
    for season, week, n in periods:
        if past >= least_history and n >= least_players:
            cut = past - _held(past)
            out.append(Fold(season, week, past, cut, cut - _held(cut)))
        past += n
    return out


def in_time(df: DataFrame, spec: Spec) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Trainable rows with `__n`, their place by season, week and id, written once; and the rows of each period."""
    rows = shape.trainable(df, spec.prior, spec.outcome)
    placed = stored(windows.total_order(rows, [F.col("season"), F.col("week"), F.col(spec.keys[0])], "__n"), "in-time")
    sizes = placed.groupBy("season", "week").agg(F.count("*").alias("n")).orderBy("season", "week").collect()  # a row a period
    return placed, [tuple(r) for r in sizes]


def _known(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def segment_sums(rows: DataFrame, features: Sequence[str], gaps: Sequence[str], y: str, ends: Sequence[int]) -> dict[int, np.ndarray]:
    """{end: sums of products over the rows up to it} of (1, features with 0 for a missing value, 1 where one of `gaps` is
    missing, y). The driver gets (features + gaps + 2)^2 / 2 numbers a segment, whatever the rows are."""
    values = [F.lit(1.0), *(F.coalesce(_known(c), F.lit(0.0)) for c in features), *(_known(c).isNull().cast("double") for c in gaps), F.col(y).cast("double")]
    k = len(values)
    wide = rows.select(cuts_below(F.col("__n"), list(ends)).alias("segment"), *(v.alias(f"v{i}") for i, v in enumerate(values)))
    sums = [F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    found = {r["segment"]: r for r in wide.groupBy("segment").agg(*sums).collect()}
    out, total = {}, np.zeros((k, k))
    for segment, end in enumerate(ends):
        if segment in found:
            for i in range(k):
                for j in range(i, k):
                    total[i, j] += found[segment][f"s{i}_{j}"]
        out[end] = np.triu(total) + np.triu(total, 1).T
    return out


def filled(sums: np.ndarray, features: Sequence[str], gaps: Sequence[str], medians: Mapping[str, float]) -> np.ndarray:
    """The sums of products of (1, features, y) after missing values have become medians."""
    d = len(features)
    turn = np.zeros((d + 2, len(sums)))
    turn[range(d + 1), range(d + 1)] = 1
    turn[-1, -1] = 1
    for k, c in enumerate(gaps):
        turn[1 + features.index(c), 1 + d + k] = medians.get(c, 0.0)
    return turn @ sums @ turn.T


def ridge_of(sums: np.ndarray, alpha: float) -> np.ndarray:
    """(intercept, coefficients) of ridge on standardised columns, by the closed form, from sums of (1, x, y)."""
    n = sums[0, 0]
    mean = sums[0, 1:] / n
    spread = sums[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(spread)[:-1], 0))
    sd[sd <= 1e-12 * np.maximum(1, np.abs(mean[:-1]))] = np.inf  # a constant column has no say
    inner = np.where(np.isfinite(np.outer(sd, sd)), spread[:-1, :-1] / np.outer(sd, sd), 0.0)
    weights = np.linalg.solve(n * inner + alpha * np.eye(len(sd)), n * spread[:-1, -1] / sd) / sd
    return np.array([mean[-1] - weights @ mean[:-1], *weights])


def squared_error(sums: np.ndarray, beta: np.ndarray) -> float:
    v = np.array([*beta, -1.0])
    return float(v @ sums @ v)


def chosen_ridge(train: np.ndarray, early: np.ndarray, alphas: Sequence[float] = ALPHAS) -> tuple[float, np.ndarray]:
    """The penalty with the least squared error on the rows that `train` has and `early` has not, the smaller on a tie; 10
    without such rows. Then the fit on all of `train`."""
    held = train - early
    alpha = 10.0 if held[0, 0] < 0.5 else min((squared_error(held, ridge_of(early, a)), a) for a in alphas)[1]
    return alpha, ridge_of(train, alpha)


def fold_medians(rows: DataFrame, folds: Sequence[Fold], gaps: Sequence[str]) -> dict[Fold, dict[str, float]]:
    """Medians for each fold from rows that it trains on: of the first season's folds each its own, later on those of the
    season's first fold. A row counts once for each season after it."""
    heads: dict[Fold, Fold] = {}
    first = {}
    for f in folds:
        head = f if f.season == folds[0].season else first.setdefault(f.season, f)
        heads[f] = head
    named = sorted(set(heads.values()), key=lambda f: f.cut)
    if not gaps or not named:
        return {f: {} for f in folds}
    ends = F.array(*(F.struct(F.lit(k).alias("fold"), F.lit(f.cut).alias("cut")) for k, f in enumerate(named)))
    each = rows.select("__n", *gaps).withColumn("__fold", F.explode(F.filter(ends, lambda e: F.col("__n") <= e["cut"]))).select(F.col("__fold.fold").alias("fold"), *gaps)
    found = {(r["fold"], r["column"]): r["values"][0] for r in order_stats.quantiles(each, ["fold"], gaps, [0.5]).collect()}
    return {f: {c: found.get((named.index(h), c), 0.0) for c in gaps} for f, h in heads.items()}


def ridge_folds(rows: DataFrame, folds: Sequence[Fold], spec: Spec, alphas: Sequence[float] = ALPHAS) -> list[tuple]:
    """(season, week, alpha, medians, coefficients with the intercept first) of every fold, from one pass over the rows."""
    features = list(spec.features)
    missing = rows.agg(*(F.count_if(_known(c).isNull()).alias(c) for c in features)).first()
    gaps = [c for c in features if missing[c]]
    medians = fold_medians(rows, folds, gaps)
    ends = sorted({n for f in folds for n in (f.past, f.cut, f.inner)})
    sums = segment_sums(rows, features, gaps, spec.outcome, ends)
    out = []
    for f in folds:
        train, early = (filled(sums[n], features, gaps, medians[f]) for n in (f.cut, f.inner))
        alpha, beta = chosen_ridge(train, early, alphas)
        out.append((f.season, f.week, float(alpha), [float(medians[f].get(c, 0.0)) for c in features], [float(b) for b in beta]))
    return out


FITTED = "season int, week int, alpha double, medians array<double>, beta array<double>"


def with_ridge(df: DataFrame, fitted: DataFrame, features: Sequence[str], name: str = "ridge") -> DataFrame:
    """`df` with the prediction of its period's fit; rows of periods without one go. `fitted` has a row a period."""
    joined = df.join(F.broadcast(fitted.select("season", "week", "medians", "beta")), ["season", "week"])
    said = F.col("beta")[0]
    for k, c in enumerate(features):
        said = said + F.col("beta")[k + 1] * F.coalesce(_known(c), F.col("medians")[k])
    return joined.withColumn(name, said).drop("medians", "beta")


def ridge_replay(df: DataFrame, spec: Spec, least_history: int = 2000, least_players: int = 30) -> DataFrame:
    """All trainable rows of all periods that have enough before them, with `points`: ridge fitted on what is before each."""
    rows, periods = in_time(df, spec)
    folds = folds_of(periods, least_history, least_players)
    if not folds:
        raise ValueError("no period has enough history")
    fitted = df.sparkSession.createDataFrame(ridge_folds(rows, folds, spec), FITTED)
    return with_ridge(rows, fitted, spec.features, "points").withColumn("points", F.greatest("points", F.lit(0.0))).drop("__n")


@dataclass
class Trees:
    """Boosted means and ranges. What a store keeps of them is `frame`; `of_frame` gives the same model back."""

    boost: Boosted
    low: Boosted
    high: Boosted
    offset: float = 0.0

    def predict(self, df: DataFrame) -> DataFrame:
        """boost, low and high; low and high in order and not below 0."""
        rows = score_many(df, {"boost": self.boost, "__low": self.low, "__high": self.high})
        low, high = order_bounds(F.least("__low", "__high") - self.offset, F.greatest("__low", "__high") + self.offset)
        return rows.withColumn("low", low).withColumn("high", high).drop("__low", "__high")

    def frame(self, spark: SparkSession) -> DataFrame:
        parts = {"boost": self.boost, "low": self.low, "high": self.high}
        rows = [(name, *r) for name, m in parts.items() for r in m.as_rows()] + [("offset", -1, 0, -1, -1, -1, -1, float(self.offset), [])]
        return spark.createDataFrame(rows, f"part string, {Boosted.SCHEMA}")

    @staticmethod
    def of_frame(df: DataFrame, features: Sequence[str], rate: float) -> Trees:
        rows = [tuple(r) for r in df.select("part", "tree", "node", "column", "bin", "left", "right", "value", "cuts").collect()]  # a row a node
        model = lambda name: Boosted.from_rows([r[1:] for r in rows if r[0] == name], features, rate)
        return Trees(model("boost"), model("low"), model("high"), next(r[7] for r in rows if r[0] == "offset"))


def growths_of(spec: Spec) -> list[Growth]:
    """How the boosted mean and the two ends of the nominal range grow."""
    o = spec.options
    growth = Growth(rounds=int(o["rounds"]), rate=o["rate"], leaves=int(o.get("leaves", 8)), least=int(o["leaf"]), share=o.get("share", 0.8), bins=int(o.get("bins", 31)))
    tail = (1 - NOMINAL) / 2
    return [growth, replace(growth, quantile=tail), replace(growth, quantile=1 - tail)]


def fit_trees(rows: DataFrame, ends: Sequence[tuple[int, int]], spec: Spec, at_once: int = 4) -> list[Trees]:
    """For each (cut, past): boosted mean and range on the rows with `__n` up to cut, widened on the eligible ones from there to
    past. All models grow in step."""
    kinds = growths_of(spec)
    models = [(g, F.col("__n") <= cut) for cut, _ in ends for g in kinds]
    fitted = fit_many(rows.where(F.col("__n") <= max(cut for cut, _ in ends)), spec.features, spec.outcome, models, [*spec.keys, "__n"])
    out = [Trees(*fitted[3 * k : 3 * k + 3]) for k in range(len(ends))]

    def widen(k: int) -> None:
        cut, past = ends[k]
        if cut < past:
            cal = rows.where((F.col("__n") > cut) & (F.col("__n") <= past))
            seen = out[k].predict(shape.eligible(cal, spec.recent, spec.min_recent))
            out[k].offset = forecast.conformal_offset(seen, "low", "high", spec.outcome)

    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(widen, range(len(ends))))
    return out


def walk_forward(df: DataFrame, spec: Spec, least_history: int = 2000, least_players: int = 30, at_once: int = 4) -> DataFrame:
    """Every period predicted from strictly earlier rows: points (half ridge of the period, half boosting, not below 0), low
    and high.

    Ridge is fitted for each period; trees and ranges at the first period that has enough before it and before every season
    after that, from what is earlier than it, all in step. The newest fifth of the rows before a fit is held
    back: it widens the ranges.
    """
    rows, periods = in_time(df, spec)
    folds = folds_of(periods, least_history, least_players)
    if not folds:
        raise ValueError("no period has enough history")
    fitted = df.sparkSession.createDataFrame(ridge_folds(rows, folds, spec), FITTED)
    seasons = {f.season: f for f in reversed(folds)}

    heads = [seasons[s] for s in sorted(seasons)]
    trees = fit_trees(rows, [(f.cut, f.past) for f in heads], spec, at_once)

    def season(k: int) -> DataFrame:
        got = trees[k].predict(with_ridge(rows.where(F.col("season") == heads[k].season), fitted, spec.features))
        return stored(got.withColumn("points", F.greatest((F.col("ridge") + F.col("boost")) / 2, F.lit(0.0))).drop("__n"), "replayed")

    with ThreadPoolExecutor(at_once) as pool:
        parts = list(pool.map(season, range(len(heads))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def frozen_trees(df: DataFrame, season: int, path: str, spec: Spec) -> Trees:
    """The model of a season's frozen control: fitted on earlier seasons alone, stored once under `path`, and read from there
    ever after, so that what later data say cannot change it."""
    spark, place = df.sparkSession, f"{path}/season={season}"
    held = sinks.load_locked(spark, place)
    if held is None:
        rows, periods = in_time(df.where(F.col("season") < season), spec)
        past = sum(n for _, _, n in periods)
        cut = past - _held(past)
        frame = fit_trees(rows, [(cut, past)], spec)[0].frame(spark)
        try:
            held = sinks.lock_once(frame, place, frame.columns)
        except sinks.Conflict:  # another writer was first
            held = sinks.load_locked(spark, place)
    return Trees.of_frame(held, spec.features, spec.options["rate"])


def graded_with_control(live: DataFrame, frozen: DataFrame, keys: Sequence[str], y: str, bases: Sequence[str]) -> DataFrame:
    """Weeks graded by their live forecasts and, beside them, by the frozen control's for the same rows: frozen_mae is null
    unless every graded row of the week has one."""
    told = live.join(frozen.select(*keys, F.col("points").alias("__frozen")), list(keys), "left").where(F.col(y).isNotNull())
    weeks = forecast.grade(told.select(*keys, "points", "low", "high"), told.select(*keys, y, *bases), keys, y, bases)
    miss = F.abs(F.col(y) - F.col("__frozen"))
    control = told.groupBy("season", "week").agg(F.when(F.count("__frozen") == F.count("*"), F.avg(miss)).alias("frozen_mae"))
    return weeks.join(control, ["season", "week"])


def control_to_date(weeks: DataFrame) -> DataFrame:
    """`season_to_date` with the frozen control, pooled only where all weeks have it, and what learning was worth: behind,
    even (within 0.05) or ahead of the control."""
    control = weeks.groupBy("season").agg(F.when(F.count("frozen_mae") == F.count("*"), F.sum(F.col("frozen_mae") * F.col("n")) / F.sum("n")).alias("frozen_mae"))
    out = forecast.season_to_date(weeks.drop("frozen_mae")).join(control, "season")
    gain = F.col("frozen_mae") - F.col("mae")
    return out.withColumn("gain", gain).withColumn("learning", F.when(gain.isNull(), "no control").when(gain < -0.05, "behind").when(gain <= 0.05, "even").otherwise("ahead"))
