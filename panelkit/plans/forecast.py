"""Forecasting on the panel with Spark ML: fit, conformal ranges, walk-forward replay, promotion, locking and grading."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import order_bounds
from ..operators import aggs, joins, shape, windows
from ..sources import sinks
from ..sources.scratch import stored

NOMINAL = 0.8
#: Penalties that ridge chooses from: 20 from 0.01 to 1,000, evenly on a log scale.
ALPHAS = tuple(10 ** (-2 + 5 * k / 19) for k in range(20))


@dataclass(frozen=True)
class Spec:
    """Columns of a modelling frame: keys, outcome, features, and the recent mean that decides who is published."""

    features: Sequence[str]
    outcome: str = "actual"
    prior: str = "prior_games"
    recent: str = "mean5"
    keys: tuple[str, ...] = ("player_id", "season", "week")
    least_rows: int = 400
    min_recent: float = 4.0
    options: Mapping[str, float] = field(default_factory=lambda: {"rounds": 20, "rate": 0.1, "trees": 20, "leaf": 60})


def impute(train: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Exact medians of the training rows; 0 for a column without a value."""
    row = aggs.medians(train, list(features)).first()
    return {c: float(row[c]) if row[c] is not None else 0.0 for c in features}


def fill(df: DataFrame, medians: Mapping[str, float]) -> DataFrame:
    return df.fillna(dict(medians)).withColumns({c: F.when(F.isnan(F.col(c).cast("double")), m).otherwise(F.col(c).cast("double")) for c, m in medians.items()})


def fit_ridge(df: DataFrame, features: str, outcome: str, alpha: float = 10.0, prediction: str = "ridge", known: tuple[int, float] | None = None):
    """Ridge with the penalty of the closed form: regParam is alpha * sd(y) / n. known: n and sd(y), if counted before."""
    n, sd = known or df.agg(F.count("*"), F.stddev_pop(outcome)).first()
    return LinearRegression(featuresCol=features, labelCol=outcome, predictionCol=prediction, elasticNetParam=0.0, regParam=alpha * (sd or 0.0) / max(1, n), solver="normal").fit(df)


def choose_alpha(train: DataFrame, held: DataFrame, features: str, outcome: str, alphas: Sequence[float]) -> float:
    """The penalty with the smallest squared error on held rows, of which all are tried in one pass; the smaller one on a tie."""
    shown, known = held, tuple(train.agg(F.count("*"), F.stddev_pop(outcome)).first())
    for k, alpha in enumerate(alphas):
        shown = fit_ridge(train, features, outcome, alpha, f"__ridge{k}", known).transform(shown)
    errors = shown.agg(*(F.avg((F.col(f"__ridge{k}") - F.col(outcome)) ** 2) for k in range(len(alphas)))).first()
    return min(zip(errors, alphas))[1]


@dataclass
class Model:
    spec: Spec
    medians: dict[str, float]
    assembler: PipelineModel
    ridge: object
    boost: object
    forest: object
    leaves: DataFrame
    offset: float

    def predict(self, df: DataFrame) -> DataFrame:
        """points (half ridge, half boosting, not below 0), low and high (leaf quantiles, widened, in order)."""
        rows = self.assembler.transform(fill(df, self.medians))
        rows = self.forest.transform(self.boost.transform(self.ridge.transform(rows)))
        rows = rows.withColumn("points", F.greatest((F.col("ridge") + F.col("boost")) / 2, F.lit(0.0)))
        key = list(self.spec.keys)
        leaf = rows.select(*key, F.posexplode(vector_to_array("leaf")).alias("tree", "leaf_id"))
        bounds = leaf.join(self.leaves, ["tree", "leaf_id"], "left").groupBy(*key).agg(F.avg("q_low").alias("raw_low"), F.avg("q_high").alias("raw_high"))
        low, high = order_bounds(F.col("raw_low") - self.offset, F.col("raw_high") + self.offset)
        out = rows.join(bounds, key).withColumn("low", low).withColumn("high", high)
        return out.drop("raw_features", "features", "ridge", "boost", "forest", "leaf", "raw_low", "raw_high")


def conformal_row(cal: DataFrame, low: str, high: str, y: str, nominal: float = NOMINAL, least: int = 100) -> DataFrame:
    """One row: n, and offset, how far ranges have to move, from how far outcomes of calibration rows lie outside of them;
    0 for too few rows. May be negative: ranges that are too wide shrink.

    The two order statistics around the quantile come from counts of equal misses, in a total order over all partitions.
    """
    known = cal.where(F.col(y).isNotNull() & F.col(low).isNotNull()).select(F.greatest(F.col(low) - F.col(y), F.col(y) - F.col(high)).cast("double").alias("miss"))
    placed = windows.total_order(known, [F.col("miss")], "__place")
    n = placed.count()
    at = min(0.999, nominal * (1 + 1 / n)) * (n - 1) if n else 0.0
    lower, part = int(at), at - int(at)
    pick = lambda k: F.max(F.when(F.col("__place") == k + 1, F.col("miss")))
    between = pick(lower) + (F.coalesce(pick(lower + 1), pick(lower)) - pick(lower)) * part
    return placed.agg(F.count("*").alias("n"), F.when(F.count("*") >= least, between).otherwise(0.0).alias("offset"))


def conformal_offset(cal: DataFrame, low: str, high: str, y: str, nominal: float = NOMINAL, least: int = 100) -> float:
    return float(conformal_row(cal, low, high, y, nominal, least).first()["offset"])


def reject_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> None:
    if not joins.overlap(a, b, keys).isEmpty():
        raise ValueError("calibration rows are training rows")


def fit(train: DataFrame, cal: DataFrame | None, spec: Spec) -> Model:
    """Fit on trainable rows; medians come from them alone; calibrate on eligible rows that are not among them. Unless
    the options have alpha, the penalty is chosen on the newest training rows, held back for that; 10 for too few rows."""
    rows = shape.trainable(train, spec.prior, spec.outcome)
    if rows.count() < spec.least_rows:
        raise ValueError(f"fewer than {spec.least_rows} rows to learn from")
    medians = impute(rows, spec.features)
    o = spec.options
    filled = fill(rows, medians).withColumn(spec.outcome, F.col(spec.outcome).cast("double"))
    assembler = Pipeline(stages=[VectorAssembler(inputCols=list(spec.features), outputCol="raw_features"), StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)]).fit(filled)
    ready = assembler.transform(filled).persist()
    alpha = o.get("alpha")
    if alpha is None:
        early, held = windows.chrono_split(ready, [*spec.keys[1:], spec.keys[0]])
        alpha = 10.0 if held is None else choose_alpha(early, held, "features", spec.outcome, ALPHAS)
    ridge = fit_ridge(ready, "features", spec.outcome, alpha)
    boost = GBTRegressor(featuresCol="features", labelCol=spec.outcome, predictionCol="boost", maxDepth=4, maxIter=int(o["rounds"]), stepSize=o["rate"], subsamplingRate=0.8, minInstancesPerNode=int(o["leaf"]), seed=7).fit(ready)
    forest = RandomForestRegressor(featuresCol="features", labelCol=spec.outcome, predictionCol="forest", leafCol="leaf", numTrees=int(o["trees"]), maxDepth=5, minInstancesPerNode=int(o["leaf"]), seed=7).fit(ready)
    seen = forest.transform(ready).select(spec.outcome, F.posexplode(vector_to_array("leaf")).alias("tree", "leaf_id"))
    q = (1 - NOMINAL) / 2
    leaves = seen.groupBy("tree", "leaf_id").agg(F.percentile(spec.outcome, q).alias("q_low"), F.percentile(spec.outcome, 1 - q).alias("q_high"))
    leaves = stored(leaves, "leaves")
    ready.unpersist()
    model = Model(spec, medians, assembler, ridge, boost, forest, leaves, 0.0)
    if cal is not None:
        reject_overlap(rows, cal, spec.keys)
        wide = model.predict(shape.eligible(shape.trainable(cal, spec.prior, spec.outcome), spec.recent, spec.min_recent))
        model.offset = conformal_offset(wide, "low", "high", spec.outcome)
    return model


def ablation(train: DataFrame, test: DataFrame, groups: Mapping[str, Sequence[str]], y: str, alpha: float = 10.0) -> DataFrame:
    """What groups of features are worth to ridge: kind "add" adds them one after another, "drop" leaves one out of all.

    Per row: kind, group, features, mae on the test rows. Medians come from the training rows; every fit and every grading is
    one Spark job over rows that are prepared once, and only the errors meet on the driver.
    """
    every = [c for cols in groups.values() for c in cols]
    medians = impute(train, every)
    prepared = [stored(fill(df, medians).select(*every, F.col(y).cast("double").alias(y)).where(F.col(y).isNotNull()), "ablation") for df in (train, test)]
    scaled = Pipeline(stages=[VectorAssembler(inputCols=[c], outputCol=f"__v_{c}") for c in every] + [StandardScaler(inputCol=f"__v_{c}", outputCol=f"__s_{c}", withMean=True) for c in every]).fit(prepared[0])
    ready = [scaled.transform(df) for df in prepared]
    lists, so_far = [], []
    for name, cols in groups.items():
        so_far = [*so_far, *cols]
        lists += [("add", name, list(so_far)), ("drop", name, [c for c in every if c not in cols])]
    found = []
    for kind, name, cols in lists:
        if cols:
            assemble = VectorAssembler(inputCols=[f"__s_{c}" for c in cols], outputCol="__x")
            model = fit_ridge(assemble.transform(ready[0]), "__x", y, alpha)
            mae = model.transform(assemble.transform(ready[1])).agg(F.avg(F.abs(F.col("ridge") - F.col(y)))).first()[0]
            found.append((kind, name, len(cols), float(mae)))
    return train.sparkSession.createDataFrame(found, "kind string, group string, features int, mae double")


def baselines(df: DataFrame, mean5: str = "mean5", mean10: str = "mean10", season: str = "season_mean") -> DataFrame:
    """base_recent, base_season, base_ten, each falling back on the others."""
    return df.withColumns({
        "base_recent": F.coalesce(F.col(mean5), F.col(mean10), F.col(season)),
        "base_season": F.coalesce(F.col(season), F.col(mean10), F.col(mean5)),
        "base_ten": F.coalesce(F.col(mean10), F.col(season), F.col(mean5)),
    })


@dataclass
class Availability:
    """Chance to play: 0 when ruled out, 1 when unlisted, and a fitted or base rate when questionable."""

    model: object | None
    rate: float
    flags: Sequence[str]

    @staticmethod
    def fit(df: DataFrame, flags: Sequence[str], played: str = "played", status: str = "injury_status", base: float = 0.63, least: int = 50) -> Availability:
        rows = df.where((F.col(status) == "Questionable") & F.col(played).isNotNull()).withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in flags}).withColumn("__y", F.col(played).cast("double"))
        n, mean = rows.agg(F.count("*"), F.avg("__y")).first()
        if n < least or mean in (0.0, 1.0):
            return Availability(None, float(mean) if n else base, flags)
        ready = VectorAssembler(inputCols=list(flags), outputCol="__x").transform(rows)
        return Availability(LogisticRegression(featuresCol="__x", labelCol="__y", probabilityCol="__p", rawPredictionCol="__r", predictionCol="__c", regParam=0.01).fit(ready), float(mean), flags)

    def transform(self, df: DataFrame, status: str = "injury_status", name: str = "probability") -> DataFrame:
        questionable = F.lit(self.rate)
        if self.model is not None:
            ready = VectorAssembler(inputCols=[f"__{f}" for f in self.flags], outputCol="__x").transform(df.withColumns({f"__{f}": F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in self.flags}))
            df = self.model.transform(ready).drop("__x", "__r", "__c", *(f"__{f}" for f in self.flags))
            questionable = vector_to_array("__p")[1]
        chance = F.when(F.col(status).isin("Out", "Doubtful"), 0.0).when(F.col(status) == "Questionable", questionable).otherwise(1.0)
        return df.withColumn(name, chance).drop("__p")


def expected(df: DataFrame, points: str = "points", p: str = "probability") -> DataFrame:
    """Points times the chance to play; rows that are ruled out go."""
    return df.where(F.col(p) > 0).withColumn("expected_points", F.col(points) * F.col(p))


def walk_forward(df: DataFrame, periods: Sequence[tuple[int, int]] | None, spec: Spec, factory: Callable[[DataFrame, DataFrame | None, Spec], Model] = fit, least_history: int = 2000, least_players: int = 30) -> DataFrame:
    """Predict each period (None: all periods of df) by a model fitted on strictly earlier ones. The loop is over periods;
    every fit and every prediction is distributed. Periods with too little before them or too few rows are left out."""
    key, out = F.struct("season", "week"), None
    if periods is None:
        periods = [tuple(r) for r in df.select("season", "week").distinct().orderBy("season", "week").collect()]
    for season, week in periods:
        at = F.struct(F.lit(season).alias("season"), F.lit(week).alias("week"))
        past, now = shape.trainable(df.where(key < at), spec.prior, spec.outcome), shape.trainable(df.where(key == at), spec.prior, spec.outcome)
        if past.count() < least_history or now.count() < least_players:
            continue
        train, cal = windows.chrono_split(past, ["season", "week", spec.keys[0]])
        got = factory(train, cal, spec).predict(now)
        got = stored(got, "replayed")
        out = got if out is None else out.unionByName(got)
    if out is None:
        raise ValueError("no period has enough history")
    return out


def summarize_replay(graded: DataFrame, y: str, bases: Sequence[str], p: str = "points") -> DataFrame:
    """One row: n, mae, rmse, coverage, within, the best baseline by name, its error and the margin to it."""
    found = graded.agg(*(c.alias(n) for n, c in aggs.error_metrics(y, p, "low", "high").items()), *(F.avg(F.abs(F.col(y) - F.col(b))).alias(f"mae_{b}") for b in bases))
    found = found.withColumn("best_baseline", aggs.best_of({b: f"mae_{b}" for b in bases})).withColumn("best_mae", F.least(*(F.col(f"mae_{b}") for b in bases)) if len(bases) > 1 else F.col(f"mae_{bases[0]}"))
    return found.withColumn("margin", F.col("best_mae") - F.col("mae")).drop(*(f"mae_{b}" for b in bases))


def score_published(graded: DataFrame, y: str, bases: Sequence[str], recent: str, min_recent: float = 4.0) -> DataFrame:
    return summarize_replay(shape.eligible(graded, recent, min_recent), y, bases)


def paired_evidence(a: DataFrame, b: DataFrame, keys: Sequence[str], y: str, p: str = "points", by: Sequence[str] = ()) -> DataFrame:
    """Mean difference in absolute error (a less b), its standard error, z, the share of rows that b improves, and, if b has
    low and high, the coverage of its ranges; over all rows or by some columns of b."""
    miss = lambda df: F.abs(df[y] - df[p]).alias("miss")
    ranges = {"low", "high"} <= set(b.columns)
    inside = ((F.col(y) >= F.col("low")) & (F.col(y) <= F.col("high"))) if ranges else F.lit(None).cast("boolean")
    right = b.select(*keys, *by, inside.alias("inside"), miss(b).alias("miss_b"))
    d = a.select(*keys, miss(a).alias("miss_a")).join(right, list(keys)).withColumn("d", F.col("miss_a") - F.col("miss_b"))
    out = d.groupBy(*by).agg(F.count("d").alias("n"), F.avg("d").alias("improvement"), (F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("se"), aggs.rate(F.col("d") > 0).alias("improved"), aggs.rate("inside").alias("coverage"))
    return out.withColumn("z", F.try_divide("improvement", "se"))


def promote(evidence: DataFrame, improvement: float = 0.05, coverage: tuple[float, float] = (0.75, 0.85), z: float = 2.0) -> DataFrame:
    """promoted and the first reason against it. evidence: improvement, coverage, z."""
    reason = F.when(~(F.col("improvement") > improvement), "improvement too small").when(~F.col("coverage").between(*coverage), "coverage out of bounds").when(~(F.coalesce(F.abs("z"), F.lit(0.0)) >= z), "not significant").otherwise("promoted")
    return evidence.withColumn("reason", reason).withColumn("promoted", reason == "promoted")


@dataclass(frozen=True)
class Candidate:
    """A feature plug-in: `build` adds the columns it declares."""

    name: str
    hypothesis: str
    adds: tuple[str, ...]
    build: Callable[[DataFrame], DataFrame]

    def apply(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Refuses a build that changes rows, redefines columns or does not add what it declares."""
        taken = set(self.adds) & set(df.columns)
        if taken:
            raise ValueError(f"{self.name} redefines {sorted(taken)}")
        out = self.build(df)
        missing, lost = set(self.adds) - set(out.columns), set(df.columns) - set(out.columns)
        if missing or lost:
            raise ValueError(f"{self.name} lacks {sorted(missing | lost)}")
        if not shape.same_rows(df, out, df.columns):
            raise ValueError(f"{self.name} changes rows")
        return out.select(*df.columns, *self.adds)

    def leaks(self, df: DataFrame, keys: Sequence[str], outcome: str, hidden: Column) -> DataFrame:
        """Keys whose added columns change when outcomes of the hidden rows are blanked. Empty means no leak."""
        plain = self.build(df).select(*keys, F.struct(*self.adds).alias("a"))
        blank = self.build(df.withColumn(outcome, F.when(~hidden, F.col(outcome)))).select(*keys, F.struct(*self.adds).alias("b"))
        return plain.join(blank, list(keys)).where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys)


def form_versus_baseline(recent: str = "mean3", base: str = "mean10") -> Candidate:
    return Candidate("form_versus_baseline", "recent form against the long run", ("form_ratio",), lambda df: df.withColumn("form_ratio", F.when(F.col(base) > 0.5, F.col(recent) / F.col(base))))


def evaluate(candidate: Candidate, champion: DataFrame, challenger: DataFrame, keys: Sequence[str], y: str, metric: str = "mae", by: Sequence[str] = ()) -> DataFrame:
    """Ledger entries of a candidate: the replay without it (champion) against the replay with it (challenger), on the same
    rows, then the promotion gate. One row, or one for each value of `by`: entry_id, candidate, metric, n, improvement, se,
    z, coverage, promoted, reason. An empty pairing raises: nothing was compared."""
    found = promote(paired_evidence(champion, challenger, keys, y, by=by))
    if found.where("n > 0").isEmpty():
        raise ValueError(f"{candidate.name}: champion and challenger share no rows")
    entry = F.sha2(F.concat_ws("|", F.lit(candidate.name), F.lit(metric), *by), 256)
    return found.select(entry.alias("entry_id"), F.lit(candidate.name).alias("candidate"), F.lit(metric).alias("metric"), *by, "n", "improvement", "se", "z", "coverage", "promoted", "reason")


def failure_report(graded: DataFrame, y: str, bases: Sequence[str], recent: str, names: DataFrame | None = None, worst: int = 10, p: str = "points") -> DataFrame:
    """Where the forecasts of the newest graded period failed, as one table by section.

    "summary", "position" and "tier" (of recent form, null as 0): rows, error of the model and of the best baseline of that
    period, and the margin. "worst": the rows with the largest errors, with their name, projection, outcome and error
    (ties by entity). names: player_id, name. Nothing graded raises.
    """
    known = graded.where(F.col(y).isNotNull())
    last = known.agg(F.max(F.struct("season", "week")).alias("x")).first()["x"]
    if last is None:
        raise ValueError("no graded rows to analyse")
    rows = known.where((F.col("season") == last["season"]) & (F.col("week") == last["week"]))
    means = rows.agg(*(F.avg(F.abs(F.col(y) - F.col(b))).alias(b) for b in bases)).first()
    best = min(bases, key=lambda b: (float("inf") if means[b] is None else means[b], b))
    rows = rows.withColumn("__tiered", F.coalesce(F.col(recent).cast("double"), F.lit(0.0)))
    parts = {
        "summary": aggs.error_by(rows, F.lit("ALL"), y, p, best, "label"),
        "position": aggs.error_by(rows, "position", y, p, best, "label"),
        "tier": aggs.error_by_tier(rows, "__tiered", y, p, best).withColumnRenamed("tier", "label"),
    }
    none = {"projected": "double", "actual": "double", "error": "double"}
    tables = [df.select(F.lit(section).alias("section"), "label", "n", "model_mae", "baseline_mae", "margin", *(F.lit(None).cast(t).alias(c) for c, t in none.items())) for section, df in parts.items()]
    top = windows.largest(rows.withColumn("__miss", F.abs(F.col(y) - F.col(p))), "__miss", worst, ["player_id"])
    named = joins.enrich(top, names, "player_id", "name") if names is not None else top.withColumn("name", F.col("player_id").cast("string"))
    empty = {"n": "bigint", "model_mae": "double", "baseline_mae": "double", "margin": "double"}
    shown = named.select(F.lit("worst").alias("section"), F.col("name").alias("label"), *(F.lit(None).cast(t).alias(c) for c, t in empty.items()), F.col(p).cast("double").alias("projected"), F.col(y).cast("double").alias("actual"), (F.col(y) - F.col(p)).cast("double").alias("error"))
    out = shown
    for table in tables:
        out = out.unionByName(table)
    return out


def next_to_predict(df: DataFrame, season: int, outcome: str) -> DataFrame:
    return df.where((F.col("season") == season) & F.col(outcome).isNull()).agg(F.min("week").alias("week"))


def first_start(games: DataFrame, start: str = "starts_at") -> DataFrame:
    """Earliest start of each week; null if any of its games has none."""
    return games.groupBy("season", "week").agg(F.when(~F.bool_or(F.col(start).isNull()), F.min(start)).alias("first_start"))


def lock_state(starts: DataFrame, now: Column, start: str = "first_start", open_h: int = 24, close_min: int = 30) -> DataFrame:
    """unknown, missed (less than half an hour left), lock (a day or less) or wait."""
    left = F.unix_micros(F.col(start).cast("timestamp")) - F.unix_micros(now.cast("timestamp"))
    minute = 60_000_000
    state = F.when(F.col(start).isNull(), "unknown").when(left < close_min * minute, "missed").when(left <= open_h * 60 * minute, "lock").otherwise("wait")
    return starts.withColumn("state", state)


def lock_actions(states: DataFrame, locked: DataFrame) -> DataFrame:
    """What may be done for each week of `lock_state`: keep (its forecast is locked, whatever the time), write (the window is
    open), refuse (missed, or a start is unknown), preview (too early; shown, not locked)."""
    told = states.join(locked.select("season", "week").distinct().withColumn("__locked", F.lit(True)), ["season", "week"], "left")
    action = F.when(F.col("__locked"), "keep").when(F.col("state") == "lock", "write").when(F.col("state") == "wait", "preview").otherwise("refuse")
    return told.withColumn("action", action).drop("__locked")


class Refused(Exception):
    """A forecast may not be locked now."""


def lock_in_window(rows: DataFrame, starts: DataFrame, season: int, week: int, now: Column, path: str, cols: Sequence[str]) -> tuple[str, DataFrame]:
    """The only way to a lock: asks `lock_state` before any write. Returns the action and the rows to publish.

    What was locked in time is published as it was locked, also after the start. In the window the rows are locked. Before it
    they are a preview. A week that is missed, or has a start that is not known, raises Refused and nothing is written.
    """
    spark, place = rows.sparkSession, f"{path}/season={season}/week={week}"
    held = sinks.load_locked(spark, place)
    if held is not None:
        return "keep", held
    state = lock_state(starts.where((F.col("season") == season) & (F.col("week") == week)), now).select("state").first()
    if state is None or state["state"] in ("unknown", "missed"):
        raise Refused(f"season {season}, week {week}: {state['state'] if state else 'unknown'}")
    if state["state"] == "wait":
        return "preview", rows.select(*cols)
    return "write", sinks.lock_once(rows, place, cols)


def grade(locked: DataFrame, facts: DataFrame, keys: Sequence[str], y: str, bases: Sequence[str] = ()) -> DataFrame:
    """Locked forecasts of each week against the rows that played: all weeks in one join."""
    rows = locked.join(facts.select(*keys, y, *bases), list(keys)).where(F.col(y).isNotNull())
    named = [F.avg(F.abs(F.col(y) - F.col(b))).alias(f"mae_{b}") for b in bases]
    return rows.groupBy("season", "week").agg(*(c.alias(n) for n, c in aggs.error_metrics(y, "points", "low", "high").items()), *named)


def season_to_date(weeks: DataFrame) -> DataFrame:
    """Graded weeks pooled by their size, with the verdict by fixed thresholds (margin .15, coverage .78 to .82, 4 weeks)."""
    bases = [c for c in weeks.columns if c.startswith("mae_")]
    pooled = weeks.groupBy("season").agg(F.count("*").alias("weeks"), F.sum("n").alias("n_rows"), aggs.pooled("mae", "n").alias("mae"), aggs.pooled_rmse("rmse", "n").alias("rmse"), aggs.pooled("coverage", "n").alias("coverage"), *(aggs.pooled(b, "n").alias(b) for b in bases))
    best = F.least(*(F.col(b) for b in bases)) if len(bases) > 1 else F.col(bases[0])
    margin = best - F.col("mae")
    verdict = F.when(F.col("weeks") < 4, "too early").when(margin <= 0, "losing").when(margin < 0.15, "noise").otherwise("winning")
    ranges = F.when(F.col("coverage") < 0.78, "too narrow").when(F.col("coverage") > 0.82, "too wide").otherwise("honest")
    return pooled.withColumn("margin", margin).withColumn("verdict", verdict).withColumn("ranges", ranges)


def accuracy_table(weeks: DataFrame) -> DataFrame:
    """Weeks in order, then each season's pooled row (week null)."""
    total = season_to_date(weeks).select("season", F.lit(None).cast("int").alias("week"), F.col("n_rows").alias("n"), "mae", "rmse", "coverage")
    return weeks.select("season", "week", "n", "mae", "rmse", "coverage").unionByName(total)


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """Per metric, so that scores of different metrics never add up: tried, kept, rejected, best kept improvement."""
    kept = F.col("promoted")
    return ledger.groupBy("metric").agg(F.count("*").alias("tried"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("rejected"), F.max(F.when(kept, F.col("improvement"))).alias("best"))


def within_series(weeks: DataFrame, baseline_map: str = "baseline_within") -> DataFrame:
    """Share within 5 points by week: the model's and the best baseline's, from a map of named baselines."""
    return weeks.select("season", "week", "within", F.array_max(F.map_values(baseline_map)).alias("best_baseline_within"))


def publish_rows(rows: DataFrame, names: DataFrame, n: int | None = None) -> DataFrame:
    """Forecasts by group in the order of expected points, named and rounded."""
    shown = joins.enrich(rows, names, "player_id", "name")
    place = F.row_number().over(Window.partitionBy("season", "week", "position").orderBy(F.col("expected_points").desc(), "player_id"))
    out = shown.withColumn("place", place).select("season", "week", "position", "place", "player_id", "name", *(F.round(c, 2).alias(c) for c in ("points", "low", "high", "expected_points")), F.round("probability", 3).alias("probability"))
    return out if n is None else out.where(F.col("place") <= n)


def predict_period(df: DataFrame, season: int, week: int, spec: Spec, availability: Availability | None = None, keep: DataFrame | None = None, before_season: bool = False) -> DataFrame:
    """Forecast of one period: fitted on what is before it (before_season: on earlier seasons alone, the frozen control),
    for eligible rows or exactly those of `keep`."""
    key = F.struct("season", "week")
    past = df.where(F.col("season") < season) if before_season else df.where(key < F.struct(F.lit(season).alias("season"), F.lit(week).alias("week")))
    train, cal = windows.chrono_split(shape.trainable(past, spec.prior, spec.outcome), ["season", "week", spec.keys[0]])
    now = df.where((F.col("season") == season) & (F.col("week") == week))
    rows = joins.semi(now, keep, list(spec.keys)) if keep is not None else shape.eligible(shape.predictable(now, spec.prior), spec.recent, spec.min_recent)
    got = fit(train, cal, spec).predict(rows)
    got = availability.transform(got) if availability else got.withColumn("probability", F.lit(1.0))
    return expected(got)
