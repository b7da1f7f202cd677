"""Queries of order statistics at size, tail probabilities, locks, ledgers, publishing and the frozen control."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import aggs, order_stats, windows
from ..operators.checks import Check
from ..sources import sinks
from ..sources.scratch import scratch_path, stored
from . import forecast, replay, studies
from .instances_core import E, G, panel_sql, r6
from .instances_forecast import SPEC, features
from .instances_more import over_panel
from .panel import order_panel, table
from .registry import oracle_sql_of, query

# ---- groups larger than a task -----------------------------------------------------------------------------------


@query(oracle_sql_of("w07_percentile"))
def w07_percentile_large(spark, sf_dir):
    return windows.percentile_score(order_panel(spark, sf_dir), [*G, "position"], "disc_amt", F.lit(True), large=True).select(*E, *G, r6("percentile"))


@query(oracle_sql_of("w08_rank_rows"))
def w08_rank_rows_large(spark, sf_dir):
    rows = order_panel(spark, sf_dir).withColumn("busy", F.col("n_orders") > 1)
    return windows.rank_rows(rows, G, [F.col("revenue").desc(), F.col("player_id")], "busy", large=True).select(*E, *G, "rank")


@query(panel_sql("SELECT player_id, season, week, CAST(rank() OVER (ORDER BY qty) + (count(*) OVER (PARTITION BY qty) - 1) / 2 AS DOUBLE) AS place FROM panel"))
def w17_avg_rank_large(spark, sf_dir):
    """Average ranks over the whole panel: one group of all rows."""
    return windows.avg_rank(order_panel(spark, sf_dir), [], "qty", "place", large=True).select(*E, *G, "place")


@query(panel_sql("""SELECT position, u.column, count(x) AS n, round(quantile_cont(x, 0.1), 5) AS low, round(quantile_cont(x, 0.5), 5) AS middle, round(quantile_cont(x, 0.9), 5) AS high
 FROM (SELECT position, unnest([{'column': 'qty', 'x': qty::DOUBLE}, {'column': 'revenue', 'x': revenue::DOUBLE}], recursive := true) FROM panel) u GROUP BY position, u.column"""))
def a15_quantiles_of_groups(spark, sf_dir):
    """Three quantiles of two columns in every position, in one pass."""
    got = order_stats.quantiles(order_panel(spark, sf_dir), ["position"], ["qty", "revenue"], [0.1, 0.5, 0.9])
    return got.select("position", "column", "n", *(F.round(F.col("values")[k], 5).alias(c) for k, c in enumerate(("low", "middle", "high"))))


# ---- tail probabilities ------------------------------------------------------------------------------------------

#: The same by Simpson's rule: the beta function's integral after t = sin(a)^2, the chi-square density after x = s^2.
P_SQL = """f AS (SELECT (sum(n * (m - gm) * (m - gm)) / (k - 1)) / (sum(n * v) / (total - k)) AS x, k - 1 AS d1, total - k AS d2 FROM (SELECT team, count(*) AS n, avg(qty) AS m, var_pop(qty) AS v FROM panel GROUP BY team),
  (SELECT count(*) AS total, avg(qty) AS gm, count(DISTINCT team) AS k FROM panel) GROUP BY k, total),
c AS (SELECT sum((seen - n * rate) * (seen - n * rate) / (n * rate)) AS x, count(*) - 1 AS d FROM (SELECT team, count(*) AS n, count(*) FILTER (qty > 60) AS seen FROM panel GROUP BY team), (SELECT count(*) FILTER (qty > 60) / count(*) AS rate FROM panel)),
r AS (SELECT corr(x, y) AS r, count(*) AS n FROM (SELECT team, avg(qty) AS x FROM panel WHERE season < 1998 GROUP BY team) JOIN (SELECT team, avg(qty) AS y FROM panel WHERE season >= 1998 GROUP BY team) USING (team)),
w AS (SELECT avg(qty) FILTER (b) - avg(qty) FILTER (NOT b) AS d, var_samp(qty) FILTER (b) / count(*) FILTER (b) AS e1, var_samp(qty) FILTER (NOT b) / count(*) FILTER (NOT b) AS e0, count(*) FILTER (b) AS n1, count(*) FILTER (NOT b) AS n0 FROM (SELECT qty, position = 'BUILDING' AS b FROM panel)),
t AS (SELECT d / sqrt(e1 + e0) AS t, (e1 + e0) ** 2 / (e1 ** 2 / (n1 - 1) + e0 ** 2 / (n0 - 1)) AS df FROM w),
betas AS (SELECT 'f' AS test, d2 / (d2 + d1 * x) AS z, d2 / 2 AS a, d1 / 2 AS b FROM f UNION ALL SELECT 'r', (n - 2) / (n - 2 + r * r * (n - 2) / (1 - r * r)), (n - 2) / 2, 0.5 FROM r UNION ALL SELECT 't', df / (df + t * t), df / 2, 0.5 FROM t),
points AS (SELECT range AS i, CASE WHEN range IN (0, 40000) THEN 1 WHEN range % 2 = 1 THEN 4 ELSE 2 END AS s FROM range(40001)),
beta AS (SELECT test, sum(s * exp((2 * a - 1) * ln(greatest(sin(asin(sqrt(z)) * i / 40000), 1e-300)) + (2 * b - 1) * ln(greatest(cos(asin(sqrt(z)) * i / 40000), 1e-300)) + lgamma(a + b) - lgamma(a) - lgamma(b))) * 2 * asin(sqrt(z)) / 40000 / 3 AS p FROM betas, points GROUP BY test, a, b, z),
chi AS (SELECT 'chi2' AS test, 1 - sum(s * exp((d - 1) * ln(greatest(sqrt(x) * i / 40000, 1e-300)) - x * i * i / 40000 / 40000 / 2 + ln(2) * (1 - d / 2) - lgamma(d / 2))) * sqrt(x) / 40000 / 3 AS p FROM c, points GROUP BY x, d)
SELECT test, round(p, 6) AS p FROM (FROM beta UNION ALL FROM chi)"""


@query(over_panel(P_SQL))
def x03_x04_x05_p_values(spark, sf_dir):
    """The p values of one-way F, chi-square, a correlation of group means and Welch's t."""
    p = stored(order_panel(spark, sf_dir), "panel")
    found = {
        "f": studies.heterogeneity(p, "team", "qty"), "chi2": studies.chi_square(p, "team", F.col("qty") > 60),
        "r": studies.repeatability(p.where("season < 1998"), p.where("season >= 1998"), "team", "qty"), "t": studies.welch_t(p, F.col("position") == "BUILDING", "qty"),
    }
    parts = [df.select(F.lit(test).alias("test"), F.round("p", 6).alias("p")) for test, df in found.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ---- records -----------------------------------------------------------------------------------------------------


@query("""SELECT season, week, state, CASE WHEN week % 5 = 0 THEN 'keep' WHEN state = 'lock' THEN 'write' WHEN state = 'wait' THEN 'preview' ELSE 'refuse' END AS action FROM (
 SELECT season, week, CASE WHEN bad THEN 'unknown' WHEN first < TIMESTAMP '1998-06-15 00:30:00' THEN 'missed' WHEN first <= TIMESTAMP '1998-06-16 00:00:00' THEN 'lock' ELSE 'wait' END AS state
 FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS season, CAST(dayofyear(o_orderdate) AS INTEGER) AS week, min(o_orderdate) AS first, bool_or(o_orderkey % 97 = 0) AS bad FROM orders GROUP BY ALL))""")
def m26_lock_actions(spark, sf_dir):
    """What may be done for every day of the orders, as of one moment, when every fifth day's forecast is locked."""
    o = table(spark, sf_dir, "orders")
    games = o.select(F.year("o_orderdate").alias("season"), F.dayofyear("o_orderdate").alias("week"), F.when(F.col("o_orderkey") % 97 != 0, F.col("o_orderdate")).alias("starts_at"))
    states = forecast.lock_state(forecast.first_start(games), F.lit("1998-06-15 00:00:00").cast("timestamp"))
    return forecast.lock_actions(states, states.where("week % 5 = 0")).select("season", "week", "state", "action")


@query(panel_sql("SELECT player_id, season, week, revenue FROM panel"))
def s10_s12_lock_once(spark, sf_dir):
    """The panel locked, locked again with the same figures, refused with others, and read back."""
    p, path, cols = stored(order_panel(spark, sf_dir), "panel"), scratch_path(spark, "lock"), [*E, *G, "revenue"]
    sinks.lock_once(p, path, cols)
    sinks.lock_once(p.repartition(3), path, cols)
    try:
        sinks.lock_once(p.withColumn("revenue", F.col("revenue") + 1), path, cols)
        raise AssertionError("other figures were locked")
    except sinks.Conflict:
        return sinks.load_locked(spark, path)


@query("SELECT o_orderpriority || '-' || year(o_orderdate) AS entry_id, count(*) AS n FROM orders GROUP BY 1")
def s11_ledger(spark, sf_dir):
    """An entry for every priority and year, appended in two parts; a part that repeats an entry is refused."""
    o = table(spark, sf_dir, "orders")
    entries = o.groupBy(F.concat("o_orderpriority", F.lit("-"), F.year("o_orderdate")).alias("entry_id")).agg(F.count("*").alias("n"))
    entries, path = stored(entries, "entries"), scratch_path(spark, "ledger")
    for early in (True, False):
        sinks.ledger_append(entries.where(F.col("entry_id").startswith("1-") == early), path)
    try:
        sinks.ledger_append(entries, path)
        raise AssertionError("entries were appended twice")
    except sinks.Conflict:
        return spark.read.parquet(f"{path}/rows")


@query(panel_sql("SELECT position, season, CAST(sum(revenue) AS BIGINT) AS revenue FROM panel GROUP BY position, season"))
def s15_publish(spark, sf_dir):
    """Published twice; what is read is what the newest pointer names. A third time fails its gate and changes nothing."""
    p, root = stored(order_panel(spark, sf_dir), "panel"), scratch_path(spark, "site")
    sums = stored(p.groupBy("position", "season").agg(F.sum("revenue").alias("revenue")), "sums")
    fine = [Check("positive", sums.where("revenue < 0"))]
    sinks.publish({"sums": sums.withColumn("revenue", F.lit(0).cast("bigint"))}, root, fine)
    sinks.publish({"sums": sums}, root, fine)
    try:
        sinks.publish({"sums": sums.limit(0)}, root, [Check("empty", sums)])
        raise AssertionError("a failed gate has published")
    except Exception as e:  # the gate's own error; anything else would leave the last version too
        if isinstance(e, AssertionError):
            raise
        return sinks.published(spark, root, "sums")


# ---- replay ------------------------------------------------------------------------------------------------------


@query()
def m03_ridge_replay(spark, sf_dir):
    """Every period predicted by ridge fitted on what is before it, penalty and medians included, from one pass of sums."""
    rows = stored(features(spark, sf_dir).where("not is_upcoming"), "features")
    return replay.ridge_replay(rows, SPEC).select(*E, *G, "actual", F.round("points", 4).alias("points"))


@query()
def m17_ridge_candidate(spark, sf_dir):
    """A candidate feature judged by the replay itself: ridge of every period without it and with it."""
    rows = stored(features(spark, sf_dir).where("not is_upcoming"), "features")
    candidate = forecast.form_versus_baseline("qty_mean3", "qty_mean10")
    built = stored(candidate.apply(rows, [*E, *G]), "built")
    wider = forecast.Spec([*SPEC.features, *candidate.adds], recent=SPEC.recent)
    champion, challenger = replay.ridge_replay(built, SPEC), replay.ridge_replay(built, wider)
    challenger = challenger.withColumns({"low": F.col("points") - 75, "high": F.col("points") + 75})
    found = forecast.evaluate(candidate, champion, challenger, [*E, *G], "actual", by=["position"])
    return found.select("entry_id", "position", "n", *(F.round(c, 5).alias(c) for c in ("improvement", "se")), F.round("coverage", 6).alias("coverage"), "reason")


@query()
def m19_m22_frozen_control(spark, sf_dir):
    """The newest full season's forecasts by ridge of every month, beside a model that has only seen earlier seasons, is stored
    once and read from its store."""
    rows = stored(features(spark, sf_dir).where("not is_upcoming"), "features")
    live = replay.ridge_replay(rows, SPEC).where("season = 2000").withColumns({"low": F.col("points") - 75, "high": F.col("points") + 75})
    live = stored(live, "live")
    frozen = replay.frozen_trees(rows, 2000, f"{scratch_path(spark, 'frozen')}-{uuid.uuid4().hex}", SPEC).predict(live).withColumn("points", F.greatest("boost", F.lit(0.0)))
    weeks = replay.graded_with_control(live, frozen, [*E, *G], "actual", ["qty_mean5", "qty_mean10"])
    return replay.control_to_date(weeks).select("season", "weeks", *(F.round(c, 5).alias(c) for c in ("mae", "frozen_mae", "gain")), "verdict", "learning")


@query(panel_sql("SELECT round(median(qty), 5) AS qty, round(median(revenue), 5) AS revenue FROM panel"))
def a16_medians_panel(spark, sf_dir):
    found = aggs.medians(order_panel(spark, sf_dir), ["qty", "revenue"])
    return found.select(F.round("qty", 5).alias("qty"), F.round("revenue", 5).alias("revenue"))
