"""Queries of forecasting and of the studies, on the order panel: quantity per customer and month is the outcome."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import shape, windows
from ..sources.scratch import stored
from . import forecast, ranking, replay, studies
from .instances_core import MODEL_SQL, E, G, model_rows
from .panel import order_panel, table
from .registry import query
from .slice import sql

FEATURES = ["qty_mean3", "qty_mean5", "qty_mean10", "qty_sd8", "qty_season", "revenue_mean5", "n_orders_mean5", "prior_games"]


def features(spark, sf_dir):
    """The feature store: past rows, and one upcoming row for each customer after the newest month."""
    p = order_panel(spark, sf_dir)
    last = p.agg(F.max(F.struct("season", "week")).alias("x")).select(F.col("x.season").alias("s"), F.col("x.week").alias("w"))
    who = p.groupBy("player_id").agg(F.first("position").alias("position"), F.first("team").alias("team"))
    upcoming = who.crossJoin(F.broadcast(last)).select("player_id", F.when(F.col("w") == 12, F.col("s") + 1).otherwise(F.col("s")).alias("season"), (F.col("w") % 12 + 1).alias("week"), "position", "team")
    rows = ranking.feature_store(p, upcoming, "qty", extra=["revenue", "n_orders"], opponent="team")
    return rows.withColumn("actual", F.col("qty").cast("double"))


SPEC = forecast.Spec(FEATURES, recent="qty_mean5")


@query(sql("panel", """, nxt AS (SELECT CASE WHEN w = 12 THEN s + 1 ELSE s END AS season, w % 12 + 1 AS week FROM (SELECT x[1] AS s, x[2] AS w FROM (SELECT max([season, week]) AS x FROM panel))),
 u AS (SELECT player_id, season, week, position, team, qty, revenue, n_orders FROM panel UNION ALL SELECT player_id, nxt.season, nxt.week, min(position), min(team), NULL, NULL, NULL FROM panel, nxt GROUP BY ALL)
 SELECT player_id, season, week, qty IS NULL AS is_upcoming, round(avg(qty) OVER (PARTITION BY player_id ORDER BY season, week ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS qty_mean3, round(avg(qty) OVER (PARTITION BY player_id, season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS qty_season,
  count(*) OVER (PARTITION BY player_id ORDER BY season, week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_games FROM u""").replace("GROUP BY ALL)\n,", "GROUP BY ALL),"))
def r10_feature_store(spark, sf_dir):
    return features(spark, sf_dir).select(*E, *G, "is_upcoming", F.round("qty_mean3", 6).alias("qty_mean3"), F.round("qty_season", 6).alias("qty_season"), "prior_games")


@query(sql("panel", "").rstrip() + f",\n{MODEL_SQL} SELECT season, count(*) AS n, round(avg(abs(qty - coalesce(p, base))), 5) AS recent, round(avg(abs(qty - coalesce(base, p))), 5) AS longest FROM model GROUP BY season")
def m11_baselines(spark, sf_dir):
    rows = forecast.baselines(model_rows(spark, sf_dir), "p", "p", "base")
    return rows.groupBy("season").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("qty") - F.col("base_recent"))), 5).alias("recent"), F.round(F.avg(F.abs(F.col("qty") - F.col("base_season"))), 5).alias("longest"))


@query(sql("panel", "").rstrip() + f""",\n{MODEL_SQL}, o AS (SELECT greatest(lo - qty, qty - hi) AS miss, row_number() OVER (ORDER BY greatest(lo - qty, qty - hi)) - 1 AS i, count(*) OVER () AS n FROM model), q AS (SELECT DISTINCT n, least(0.999, 0.8 * (1 + 1 / n)) * (n - 1) AS pos FROM o)
 SELECT q.n, round(a.miss + (b.miss - a.miss) * (pos - floor(pos)), 4) AS "offset" FROM q JOIN o a ON a.i = floor(pos) JOIN o b ON b.i = floor(pos) + 1""")
def m07_conformal_offset(spark, sf_dir):
    return forecast.conformal_row(model_rows(spark, sf_dir), "lo", "hi", "qty").select("n", F.round("offset", 4).alias("offset"))


@query(sql("panel", "").rstrip() + f",\n{MODEL_SQL} SELECT count(*) AS n, round(avg(abs(qty - p)), 5) AS mae, round(avg(CAST(qty >= lo AND qty <= hi AS INTEGER)), 6) AS coverage, 'base' AS best_baseline, round(avg(abs(qty - base)) - avg(abs(qty - p)), 5) AS margin FROM model WHERE p >= 4")
def m13_m14_summary(spark, sf_dir):
    rows = model_rows(spark, sf_dir).withColumn("points", F.col("p")).withColumnsRenamed({"lo": "low", "hi": "high"})
    found = forecast.score_published(rows, "qty", ["base"], "p")
    return found.select("n", F.round("mae", 5).alias("mae"), F.round("coverage", 6).alias("coverage"), "best_baseline", F.round("margin", 5).alias("margin"))


@query(sql("panel", "").rstrip() + f""",\n{MODEL_SQL}, e AS (SELECT position, count(*) AS n, avg(abs(qty - base) - abs(qty - p)) AS improvement, stddev_samp(abs(qty - base) - abs(qty - p)) / sqrt(count(*)) AS se,
  count(*) FILTER (abs(qty - base) > abs(qty - p)) / count(*) AS improved, count(*) FILTER (qty BETWEEN p - (if(position = 'BUILDING', 60, 20)) AND p + (if(position = 'BUILDING', 60, 20))) / count(*) AS coverage FROM model GROUP BY position)
 SELECT position, n, round(improvement, 5) AS improvement, round(se, 5) AS se, round(improvement / se, 3) AS z, round(improved, 6) AS improved, round(coverage, 6) AS coverage,
  CASE WHEN improvement <= 0.05 THEN 'improvement too small' WHEN coverage NOT BETWEEN 0.75 AND 0.85 THEN 'coverage out of bounds' WHEN abs(improvement / se) < 2 THEN 'not significant' ELSE 'promoted' END AS reason FROM e""")
def m15_m16_promotion(spark, sf_dir):
    """The recent mean as champion, the long one as challenger's opponent, by position; ranges differ by position."""
    rows = model_rows(spark, sf_dir)
    width = F.when(F.col("position") == "BUILDING", 60).otherwise(20)
    rows = rows.withColumns({"low": F.col("p") - width, "high": F.col("p") + width})
    a, b = rows.withColumn("points", F.col("base")), rows.withColumn("points", F.col("p"))
    found = forecast.promote(forecast.paired_evidence(a, b, [*E, *G], "qty", by=["position"]))
    return found.select("position", "n", *(F.round(c, 5).alias(c) for c in ("improvement", "se")), F.round("z", 3).alias("z"), *(F.round(c, 6).alias(c) for c in ("improved", "coverage")), "reason")


@query(sql("panel", "").rstrip() + f""",\n{MODEL_SQL}, g AS (SELECT season, week, count(*) AS n, avg(abs(qty - p)) AS mae, sqrt(avg((qty - p) * (qty - p))) AS rmse, avg(CAST(qty >= lo AND qty <= hi AS INTEGER)) AS coverage, avg(abs(qty - base)) AS b FROM model GROUP BY ALL),
 s AS (SELECT season, count(*) AS weeks, sum(n * mae) / sum(n) AS mae, sum(n * coverage) / sum(n) AS coverage, sum(n * b) / sum(n) AS b FROM g GROUP BY season)
 SELECT season, weeks, round(mae, 5) AS mae, round(b - mae, 5) AS margin, CASE WHEN weeks < 4 THEN 'too early' WHEN b - mae <= 0 THEN 'losing' WHEN b - mae < 0.15 THEN 'noise' ELSE 'winning' END AS verdict, CASE WHEN coverage < 0.78 THEN 'too narrow' WHEN coverage > 0.82 THEN 'too wide' ELSE 'honest' END AS ranges FROM s""")
def m20_m22_grading(spark, sf_dir):
    rows = model_rows(spark, sf_dir)
    locked = rows.select(*E, *G, F.col("p").alias("points"), F.col("lo").alias("low"), F.col("hi").alias("high"))
    weeks = forecast.grade(locked, rows.select(*E, *G, "qty", "base"), [*E, *G], "qty", ["base"])
    return forecast.season_to_date(weeks).select("season", "weeks", F.round("mae", 5).alias("mae"), F.round("margin", 5).alias("margin"), "verdict", "ranges")


@query("""SELECT season, week, CASE WHEN bad THEN 'unknown' WHEN first < TIMESTAMP '1998-06-15 00:30:00' THEN 'missed' WHEN first <= TIMESTAMP '1998-06-16 00:00:00' THEN 'lock' ELSE 'wait' END AS state
 FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS season, CAST(dayofyear(o_orderdate) AS INTEGER) AS week, min(o_orderdate) AS first, bool_or(o_orderkey % 97 = 0) AS bad FROM orders GROUP BY ALL)""")
def m25_m26_lock_state(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    games = o.select(F.year("o_orderdate").alias("season"), F.dayofyear("o_orderdate").alias("week"), F.when(F.col("o_orderkey") % 97 != 0, F.col("o_orderdate")).alias("starts_at"))
    return forecast.lock_state(forecast.first_start(games), F.lit("1998-06-15 00:00:00").cast("timestamp")).select("season", "week", "state")


@query("SELECT o_orderpriority AS metric, count(*) AS tried, count(*) FILTER (o_orderstatus = 'F') AS kept, count(*) FILTER (o_orderstatus <> 'F') AS rejected, max(o_totalprice) FILTER (o_orderstatus = 'F') AS best FROM orders GROUP BY 1")
def m28_ledger_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("metric"), (F.col("o_orderstatus") == "F").alias("promoted"), F.col("o_totalprice").alias("improvement"))
    return forecast.ledger_summary(o)


@query()
def m12_walk_forward(spark, sf_dir):
    """All periods replayed: ridge of every period, boosting and quantile ranges of every season, each fitted on what is before."""
    rows = features(spark, sf_dir).where("not is_upcoming")
    got = replay.walk_forward(stored(rows, "features"), SPEC)
    return got.select(*E, *G, "actual", *(F.round(c, 4).alias(c) for c in ("points", "low", "high")))


@query()
def m18_predict_period(spark, sf_dir):
    """Forecast of the upcoming month for all eligible customers."""
    rows = stored(features(spark, sf_dir), "features")
    at = rows.where("is_upcoming").select("season", "week").first()
    got = forecast.predict_period(rows, at["season"], at["week"], SPEC)
    return forecast.publish_rows(got, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("name")))


@query()
def m09_availability(spark, sf_dir):
    """Chance that a customer orders in the month after, by logistic regression for those marked questionable."""
    rows = features(spark, sf_dir).where("not is_upcoming")
    later = rows.select("player_id", "season", (F.col("week") - 1).alias("week"), F.lit(True).alias("played"))
    rows = rows.join(later, [*E, *G], "left").withColumn("played", F.coalesce("played", F.lit(False))).withColumn("injury_status", F.when(F.col("player_id") % 3 == 0, "Questionable").when(F.col("player_id") % 7 == 0, "Out"))
    fitted = forecast.Availability.fit(rows, ["n_orders", "prior_games"])
    return fitted.transform(rows).select(*E, *G, F.round("probability", 5).alias("probability"))


@query(sql("panel", """, seen AS (SELECT player_id, season, week, avg(qty) OVER w AS plain, avg(if(season >= 1999, NULL, qty)) OVER w AS blank FROM panel WINDOW w AS (PARTITION BY player_id ORDER BY season, week ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
 SELECT player_id, season, week FROM seen WHERE plain IS DISTINCT FROM blank""").replace("GROUP BY ALL)\n,", "GROUP BY ALL),"))
def e02_e04_candidate(spark, sf_dir):
    """Keys at which a candidate feature sees what it should not: its mean includes the row's own outcome. A sound candidate
    beside it passes its contract and the same probe."""
    rows = features(spark, sf_dir).where("not is_upcoming").select(*E, *G, "actual", "qty_mean3", "qty_mean10")
    rows, hidden = stored(rows, "candidate-rows"), F.col("season") >= 1999
    sound = forecast.form_versus_baseline("qty_mean3", "qty_mean10")
    sound.apply(rows, [*E, *G])
    if not sound.leaks(rows, [*E, *G], "actual", hidden).isEmpty():
        raise ValueError("the sound candidate leaks")
    near = Window.partitionBy(*E).orderBy(*G).rowsBetween(-2, 0)
    leaky = forecast.Candidate("own_mean", "a mean that includes the row itself", ("own_mean",), lambda df: df.withColumn("own_mean", F.avg("actual").over(near)))
    return leaky.leaks(rows, [*E, *G], "actual", hidden)


@query(sql("panel", "").rstrip() + f""",\n{MODEL_SQL}, last AS (SELECT model.* FROM model SEMI JOIN (SELECT arg_max(season, season * 100 + week) AS season, arg_max(week, season * 100 + week) AS week FROM model) USING (season, week)),
 pick AS (SELECT avg(abs(qty - base)) <= avg(abs(qty - ten)) AS first FROM last JOIN tens USING (player_id, season, week)),
 e AS (SELECT l.*, c_name, abs(qty - p) AS m, abs(qty - if(first, base, ten)) AS b FROM last l JOIN tens USING (player_id, season, week) JOIN customer ON c_custkey = l.player_id, pick),
 g AS (SELECT 'summary' AS section, 'ALL' AS label, m, b FROM e UNION ALL SELECT 'position', position, m, b FROM e
  UNION ALL SELECT 'tier', CASE WHEN p <= 4 THEN '(-0.01, 4]' WHEN p <= 8 THEN '(4, 8]' WHEN p <= 13 THEN '(8, 13]' ELSE '(13, 100]' END, m, b FROM e WHERE p <= 100)
 SELECT section, label, count(*) AS n, round(avg(m), 5) AS model_mae, round(avg(b), 5) AS baseline_mae, round(avg(b) - avg(m), 5) AS margin, NULL AS projected, NULL AS actual, NULL AS error FROM g GROUP BY section, label
 UNION ALL SELECT 'worst', c_name, NULL, NULL, NULL, NULL, round(p, 5), qty, round(qty - p, 5) FROM (FROM e ORDER BY m DESC, player_id LIMIT 10)""".replace("model AS (SELECT *, m5", "tens AS (SELECT player_id, season, week, avg(qty) OVER (PARTITION BY player_id ORDER BY season, week ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS ten FROM panel),\n model AS (SELECT *, m5"))
def m23_failure_report(spark, sf_dir):
    """The newest month of the trailing means, against a long mean and one of ten rows."""
    rows = windows.trailing(order_panel(spark, sf_dir), E, G, {"points": ("avg", "qty", 5), "base": ("avg", "qty", None), "ten": ("avg", "qty", 10)}).where("points is not null")
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("name"))
    found = forecast.failure_report(rows, "qty", ["base", "ten"], "points", names)
    return found.select("section", "label", "n", *(F.round(c, 5).alias(c) for c in ("model_mae", "baseline_mae", "margin", "projected", "actual", "error")))


REPLAY_SQL = """lines AS (SELECT s.season, regr_slope(m.qty, m.p) AS p_slope, regr_intercept(m.qty, m.p) AS p_at, regr_slope(m.qty, m.base) AS b_slope, regr_intercept(m.qty, m.base) AS b_at,
   regr_slope(m.qty, m.p) FILTER (m.p >= 30) AS n_slope, regr_intercept(m.qty, m.p) FILTER (m.p >= 30) AS n_at FROM (SELECT DISTINCT season FROM model) s JOIN model m ON m.season < s.season GROUP BY s.season)"""


@query(sql("panel", "").rstrip() + f""",\n{MODEL_SQL}, {REPLAY_SQL}, e AS (SELECT position, abs(qty - p_at - p_slope * p) AS a, abs(qty - b_at - b_slope * base) AS b, qty BETWEEN b_at + b_slope * base - 60 AND b_at + b_slope * base + 60 AS inside FROM model JOIN lines USING (season)),
 g AS (SELECT position, count(*) AS n, avg(a - b) AS improvement, stddev_samp(a - b) / sqrt(count(*)) AS se, avg(inside::INTEGER) AS coverage FROM e GROUP BY position)
 SELECT sha256('long_mean|mae|' || position) AS entry_id, position, n, round(improvement, 5) AS improvement, round(se, 5) AS se, round(improvement / se, 3) AS z, round(coverage, 6) AS coverage,
  CASE WHEN improvement > 0.05 THEN CASE WHEN coverage < 0.75 OR coverage > 0.85 THEN 'coverage out of bounds' WHEN abs(improvement / se) >= 2 THEN 'promoted' ELSE 'not significant' END ELSE 'improvement too small' END AS reason FROM g""")
def m17_evaluate(spark, sf_dir):
    """A line on the recent mean as champion, a line on the long mean, which the candidate adds, as challenger; both are
    refitted before every season."""
    rows = stored(model_rows(spark, sf_dir), "model-rows")
    candidate = forecast.Candidate("long_mean", "the long run says more than the last five months", ("long_mean",), lambda df: df.withColumn("long_mean", F.col("base")))
    built = candidate.apply(rows, [*E, *G])
    champion = studies.line_replay(rows, "season", "p", "qty")
    challenger = studies.line_replay(built, "season", "long_mean", "qty").withColumns({"low": F.col("points") - 60, "high": F.col("points") + 60})
    found = forecast.evaluate(candidate, champion, challenger, [*E, *G], "qty", by=["position"])
    return found.select("entry_id", "position", "n", *(F.round(c, 5).alias(c) for c in ("improvement", "se")), F.round("z", 3).alias("z"), F.round("coverage", 6).alias("coverage"), "reason")


# ---- studies -----------------------------------------------------------------------------------------------------


@query("SELECT coalesce(CAST(s AS VARCHAR), 'ALL') AS season, count(*) AS n, round(avg(a - b), 4) AS margin, round(avg(CAST(a > b AS INTEGER)), 6) AS win_rate FROM (SELECT year(l_shipdate) AS s, l_quantity AS a, l_discount * 500 AS b FROM lineitem) GROUP BY ROLLUP (s)")
def x01_home_margin(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("season"), F.col("l_quantity").alias("a"), (F.col("l_discount") * 500).alias("b"))
    return studies.home_margin(rows, "season", "a", "b").select("season", "n", F.round("margin", 4).alias("margin"), F.round("win_rate", 6).alias("win_rate"))


@query(sql("panel", """SELECT count(*) AS n, round(avg(a - b), 5) AS mean, round(stddev_samp(a - b) / sqrt(count(*)), 5) AS se FROM (SELECT player_id, season, avg(qty) FILTER (week <= 6) AS a, avg(qty) FILTER (week > 6) AS b, count(*) FILTER (week <= 6) AS na, count(*) FILTER (week > 6) AS nb FROM panel GROUP BY ALL) WHERE na >= 1 AND nb >= 1"""))
def x02_paired_within(spark, sf_dir):
    return studies.paired_within(order_panel(spark, sf_dir), ["player_id", "season"], F.col("week") <= 6, "qty", 1).select("n", F.round("mean", 5).alias("mean"), F.round("se", 5).alias("se"))


@query(sql("panel", """, g AS (SELECT team, count(*) AS n, avg(qty) AS m, var_pop(qty) AS v FROM panel GROUP BY team), t AS (SELECT sum(n) AS total, sum(n * m) / sum(n) AS gm, count(*) AS k FROM g)
 SELECT round((sum(n * (m - gm) * (m - gm)) / (k - 1)) / (sum(n * v) / (total - k)), 6) AS f, k - 1 AS df1, CAST(total - k AS BIGINT) AS df2 FROM g, t GROUP BY k, total""").replace("GROUP BY ALL)\n,", "GROUP BY ALL),"))
def x03_heterogeneity(spark, sf_dir):
    return studies.heterogeneity(order_panel(spark, sf_dir), "team", "qty").select(F.round("f", 6).alias("f"), "df1", "df2")


@query(sql("panel", "SELECT count(*) AS n, round(corr(x, y), 6) AS r FROM (SELECT team, avg(qty) AS x FROM panel WHERE season < 1998 GROUP BY team) JOIN (SELECT team, avg(qty) AS y FROM panel WHERE season >= 1998 GROUP BY team) USING (team)"))
def x04_repeatability(spark, sf_dir):
    p = order_panel(spark, sf_dir)
    return studies.repeatability(p.where("season < 1998"), p.where("season >= 1998"), "team", "qty").select("n", F.round("r", 6).alias("r"))


@query(sql("panel", "SELECT round(m1 - m0, 6) AS difference, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 5) AS t FROM (SELECT avg(qty) FILTER (c) AS m1, avg(qty) FILTER (NOT c) AS m0, var_samp(qty) FILTER (c) AS v1, var_samp(qty) FILTER (NOT c) AS v0, count(*) FILTER (c) AS n1, count(*) FILTER (NOT c) AS n0 FROM (SELECT qty, position = 'BUILDING' AS c FROM panel))"))
def x05_welch_t(spark, sf_dir):
    return studies.welch_t(order_panel(spark, sf_dir), F.col("position") == "BUILDING", "qty").select(F.round("difference", 6).alias("difference"), F.round("t", 5).alias("t"))


@query(sql("panel", """, y AS (SELECT player_id, season, avg(qty) AS x, avg(qty) FILTER (week % 2 = 1) AS odd, avg(qty) FILTER (week % 2 = 0) AS even FROM panel GROUP BY ALL)
 SELECT 'qty' AS metric, (SELECT count(*) FROM y a JOIN y b ON a.player_id = b.player_id AND b.season = a.season + 1) AS pairs, (SELECT round(corr(a.x, b.x), 5) FROM y a JOIN y b ON a.player_id = b.player_id AND b.season = a.season + 1) AS year_r, (SELECT round(2 * corr(odd, even) / (1 + corr(odd, even)), 5) FROM y) AS split_half""").replace("GROUP BY ALL)\n,", "GROUP BY ALL),"))
def x06_reliability(spark, sf_dir):
    return studies.reliability(order_panel(spark, sf_dir), "player_id", "season", "week", ["qty"]).select("metric", "pairs", F.round("year_r", 5).alias("year_r"), F.round("split_half", 5).alias("split_half"))


@query("""WITH e AS (SELECT *, CASE WHEN value > 0 AND value <= 10 THEN 0 WHEN value > 10 AND value <= 50 THEN 1 WHEN value > 50 AND value <= 100000 THEN 2 END AS b, user_id % 3 = 0 AS hit FROM events),
 r AS (SELECT event_type, b, avg(CAST(hit AS INTEGER)) AS rate FROM e WHERE day(ts) <= 15 AND b IS NOT NULL GROUP BY ALL)
 SELECT user_id, count(*) AS n, count(*) FILTER (hit) AS seen, round(sum(rate), 5) AS expected FROM e JOIN r USING (event_type, b) WHERE day(ts) > 15 GROUP BY user_id""")
def x07_expected_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("hit", F.col("user_id") % 3 == 0)
    found = studies.expected_counts(e.where(F.dayofmonth("ts") <= 15), e.where(F.dayofmonth("ts") > 15), ["user_id"], "event_type", "value", (0, 10, 50, 100000), "hit")
    return found.select("user_id", "n", "seen", F.round("expected", 5).alias("expected"))


@query(sql("panel", "SELECT bin, count(*) AS n, round(avg(qty), 5) AS mean, round(stddev_samp(qty) / sqrt(count(*)), 5) AS se FROM (SELECT qty, CASE WHEN week > 0 AND week <= 4 THEN '(0, 4]' WHEN week > 4 AND week <= 8 THEN '(4, 8]' ELSE '(8, 12]' END AS bin FROM panel) GROUP BY bin"))
def x10_binned_effect(spark, sf_dir):
    return studies.binned_effect(order_panel(spark, sf_dir), "week", "qty", (0, 4, 8, 12)).select("bin", "n", F.round("mean", 5).alias("mean"), F.round("se", 5).alias("se"))


@query(sql("panel", "SELECT round(regr_slope(revenue, qty), 2) AS slope, round(corr(qty, revenue), 6) AS r FROM panel"))
def x11_line_effect(spark, sf_dir):
    return studies.line_effect(order_panel(spark, sf_dir), "qty", "revenue").select(F.round("slope", 2).alias("slope"), F.round("r", 6).alias("r"))


@query(sql("panel", """, shaped AS (SELECT *, CASE WHEN count(*) OVER w >= 3 THEN avg(qty) OVER w END AS form FROM panel WINDOW w AS (PARTITION BY player_id ORDER BY season, week ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
 spots AS (SELECT DISTINCT team, season, week FROM panel),
 stands AS (SELECT s.team, s.season, s.week, x.player_id, arg_max(x.form, x.week, 1)[1] AS dummy, max(x.week) AS at FROM spots s JOIN shaped x ON x.team = s.team AND x.season = s.season AND x.week < s.week GROUP BY ALL),
 options AS (SELECT t.team, t.season, t.week, t.player_id, x.form FROM stands t JOIN shaped x ON x.player_id = t.player_id AND x.season = t.season AND x.week = t.at WHERE x.form IS NOT NULL),
 firsts AS (SELECT team, season, week, list(player_id ORDER BY form DESC, player_id)[1] AS first FROM options GROUP BY team, season, week HAVING count(*) >= 2 AND max(form) >= 5),
 now AS (SELECT f.team, f.season, f.week, f.first, bool_or(p.player_id = f.first) AS present, list(p.qty - p.form ORDER BY p.form DESC, p.player_id) FILTER (p.player_id <> f.first AND p.form IS NOT NULL)[1:3] AS d, sum(p.qty) - sum(coalesce(p.form, 0)) AS total
  FROM firsts f JOIN shaped p USING (team, season, week) GROUP BY ALL),
 told AS (SELECT CASE WHEN present THEN 'present' WHEN c_acctbal < 0 THEN 'out' END AS state, list_avg(d) AS d, total FROM now JOIN customer ON c_custkey = first WHERE len(d) >= 2)
 SELECT state, count(*) AS n, round(avg(d), 5) AS next_mean, round(stddev_samp(d) / sqrt(count(*)), 5) AS next_se, round(avg(total), 4) AS team_mean, round(stddev_samp(total) / sqrt(count(*)), 4) AS team_se FROM told WHERE state IS NOT NULL GROUP BY state""").replace("GROUP BY ALL)\n,", "GROUP BY ALL),").replace("arg_max(x.form, x.week, 1)[1] AS dummy, ", ""))
def x12_substitution(spark, sf_dir):
    """Customers in debt count as ruled out in months in which they do not order."""
    p = stored(order_panel(spark, sf_dir), "panel")
    debtors = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("player_id"))
    found = studies.substitution(p, "team", "player_id", "season", "week", "qty", debtors.crossJoin(F.broadcast(p.select("season", "week").distinct())))
    return found.select("state", "n", *(F.round(c, 5).alias(c) for c in ("next_mean", "next_se")), *(F.round(c, 4).alias(c) for c in ("team_mean", "team_se")))


@query(sql("panel", "").rstrip() + f",\n{MODEL_SQL} SELECT round(1 - sum((qty - p) * (qty - p)) / (var_pop(qty) * count(*)), 6) AS r2 FROM model")
def x13_x23_r2(spark, sf_dir):
    return model_rows(spark, sf_dir).agg(F.round(studies.r2("qty", "p"), 6).alias("r2"))


LEARN_SQL = """early AS (SELECT avg(qty) FILTER (season <= 1996) AS every FROM panel), own AS (SELECT player_id, avg(qty) AS x FROM panel WHERE season <= 1996 GROUP BY player_id),
 graded AS (SELECT m.*, coalesce(x, every) AS frozen FROM model m LEFT JOIN own USING (player_id), early WHERE season > 1996)"""


def graded_rows(spark, sf_dir):
    """From 1997 on: two trailing means as members that learn, the mean up to 1996 as one that is frozen."""
    rows = stored(order_panel(spark, sf_dir), "panel")
    early = rows.where("season <= 1996")
    own, every = early.groupBy("player_id").agg(F.avg("qty").alias("__x")), early.agg(F.avg("qty").alias("__every"))
    model = windows.trailing(rows, E, G, {"p": ("avg", "qty", 5), "base": ("avg", "qty", None), "mean3": ("avg", "qty", 3), "mean10": ("avg", "qty", 10)}).where("p is not null and season > 1996")
    return model.join(own, "player_id", "left").crossJoin(F.broadcast(every)).withColumn("frozen", F.coalesce("__x", "__every")).drop("__x", "__every")


@query(sql("panel", "").rstrip() + f""",\n{MODEL_SQL}, {LEARN_SQL}, i AS (SELECT season, week, row_number() OVER (ORDER BY season, week) AS i FROM (SELECT DISTINCT season, week FROM graded)),
 g AS (SELECT graded.*, i.i, (p + base) / 2 AS blend FROM graded JOIN i USING (season, week)),
 bias AS (SELECT x.position, x.i, sum(y.s) / sum(y.n) AS bias FROM (SELECT DISTINCT position, i FROM g) x JOIN (SELECT position, i, sum(qty - blend) AS s, count(*) AS n FROM g GROUP BY ALL) y ON y.position = x.position AND y.i BETWEEN x.i - 4 AND x.i - 1 GROUP BY ALL),
 mae AS (SELECT x.i, count(*) FILTER (y.i >= x.i - 6) AS n, avg(abs(y.qty - y.p)) FILTER (y.i >= x.i - 6) AS ep, avg(abs(y.qty - y.base)) FILTER (y.i >= x.i - 6) AS eb FROM i x JOIN g y ON y.i < x.i WHERE x.i > 2 GROUP BY x.i),
 shown AS (SELECT g.*, coalesce(bias, 0) AS shift, coalesce((1 / (ep * ep)) / (1 / (ep * ep) + 1 / (eb * eb)), 0.5) AS wp FROM g LEFT JOIN bias USING (position, i) LEFT JOIN mae USING (i)),
 missed AS (SELECT week, unnest([{{'strategy': 'naive', 'miss': abs(qty - base)}}, {{'strategy': 'frozen', 'miss': abs(qty - frozen)}}, {{'strategy': 'retrain', 'miss': abs(qty - blend)}},
   {{'strategy': 'retrain_bias', 'miss': abs(qty - blend - shift)}}, {{'strategy': 'adaptive', 'miss': abs(qty - wp * p - (1 - wp) * base - shift)}}], recursive := true) FROM shown)
 SELECT strategy, count(*) AS n, round(avg(miss), 5) AS mae, round(avg(miss) FILTER (week <= 9), 5) AS first_half, round(avg(miss) FILTER (week > 9), 5) AS second_half FROM missed GROUP BY strategy""")
def x14_weekly_learning(spark, sf_dir):
    found = studies.weekly_learning(graded_rows(spark, sf_dir), "position", G, "qty", {"p": 0.5, "base": 0.5}, "frozen", "base")
    return found.select("strategy", "n", *(F.round(c, 5).alias(c) for c in ("mae", "first_half", "second_half")))


@query(sql("panel", "").rstrip() + f""",\n{MODEL_SQL}, {LEARN_SQL}, means AS (SELECT player_id, season, week, avg(qty) OVER (PARTITION BY player_id ORDER BY season, week ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS mean3,
   avg(qty) OVER (PARTITION BY player_id ORDER BY season, week ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS mean10 FROM panel),
 g AS (SELECT *, qty - p AS e FROM graded JOIN means USING (player_id, season, week)),
 own AS (SELECT *, list(e) OVER (PARTITION BY player_id ORDER BY season, week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past, avg(e) OVER (PARTITION BY player_id) AS b, count(*) OVER (PARTITION BY player_id) AS k FROM g),
 v AS (SELECT e, CASE WHEN len(past) >= 3 THEN list_sum(past) / (len(past) + 8) ELSE 0 END AS s, CASE WHEN abs(mean3 - mean10) > 0.35 * greatest((p + mean10) / 2, 1) THEN 0.45 * (mean3 - mean10) ELSE 0 END AS r, b * k / (k + 8) AS t FROM own)
 SELECT count(*) AS n, round(avg(abs(e)), 5) AS base, round(avg(abs(e - s)), 5) AS player_bias, round(avg(abs(e - r)), 5) AS role_change, round(avg(abs(e - s - r)), 5) AS both, round(avg(abs(e - t)), 5) AS oracle,
  count(*) FILTER (abs(s) > 1e-9) AS with_bias, count(*) FILTER (abs(r) > 1e-9) AS with_role_change FROM v""".replace(", own AS (SELECT *, list", ", kept AS (SELECT *, list").replace(" own AS (SELECT *, list", " kept AS (SELECT *, list").replace("AS t FROM own)", "AS t FROM kept)"))
def x15_player_learning(spark, sf_dir):
    found = studies.player_learning(graded_rows(spark, sf_dir), E, G, "qty", "p", ("mean3", "p", "mean10"))
    return found.select("n", *(F.round(c, 5).alias(c) for c in ("base", "player_bias", "role_change", "both", "oracle")), "with_bias", "with_role_change")


@query(sql("panel", "").rstrip() + f""",\n{MODEL_SQL}, l AS (SELECT abs(qty - p) AS e, unnest([{{'flag': 'late', 'yes': week > 9}}, {{'flag': 'big', 'yes': p > 60}}, {{'flag': 'any', 'yes': week > 9 OR p > 60}}], recursive := true) FROM model),
 t AS (SELECT flag, count(*) AS k, count(*) FILTER (yes) AS n, sum(e) AS s, sum(e) FILTER (yes) AS sy FROM l GROUP BY flag)
 SELECT flag, n, round(sy / n, 5) AS mae, round(sy / n - (s - sy) / (k - n), 5) AS excess, round((sy / n - (s - sy) / (k - n)) * n / k, 5) AS prize, round(sy / s, 6) AS share FROM t""")
def x16_error_anatomy(spark, sf_dir):
    found = studies.error_anatomy(model_rows(spark, sf_dir), {"late": F.col("week") > 9, "big": F.col("p") > 60}, "qty", "p")
    return found.select("flag", "n", *(F.round(c, 5).alias(c) for c in ("mae", "excess", "prize")), F.round("share", 6).alias("share"))


@query(sql("panel", "").rstrip() + f""",\n{MODEL_SQL}, s AS (SELECT p, CAST(qty > 50 AS INTEGER) AS y FROM model), r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rk FROM s)
 SELECT round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r""")
def x17_auc(spark, sf_dir):
    rows = model_rows(spark, sf_dir).withColumn("y", (F.col("qty") > 50).cast("int"))
    return studies.auc(rows, "y", "p").select(F.round("auc", 6).alias("auc"))


@query(sql("panel", "").rstrip() + f",\n{MODEL_SQL} SELECT cut, count(*) AS n, round(avg(abs(qty - p)), 5) AS model_mae, round(avg(abs(qty - base)) - avg(abs(qty - p)), 5) AS margin FROM model, (VALUES (CAST(0.0 AS DOUBLE)), (30.0), (60.0)) c(cut) WHERE p >= cut GROUP BY cut")
def x18_margin_by_cutoff(spark, sf_dir):
    found = studies.margin_by_cutoff(model_rows(spark, sf_dir), "p", (0.0, 30.0, 60.0), "qty", "p", "base")
    return found.select("cut", "n", F.round("model_mae", 5).alias("model_mae"), F.round("margin", 5).alias("margin"))


@query(sql("panel", "SELECT team, count(*) AS n, round(avg(qty - m), 5) + 0.0 AS relative FROM (SELECT *, avg(qty) OVER (PARTITION BY player_id, season) AS m FROM panel) GROUP BY team HAVING count(*) >= 15"))
def x22_relative(spark, sf_dir):
    found = studies.relative_to_own_average(order_panel(spark, sf_dir), ["player_id", "season"], "team", "qty")
    return found.select("team", "n", (F.round("relative", 5) + 0.0).alias("relative"))


@query(sql("panel", "SELECT season, week, count(*) AS n FROM panel WHERE season = (SELECT max(season) FROM panel) GROUP BY ALL"))
def p10_newest_season(spark, sf_dir):
    p = order_panel(spark, sf_dir)
    top = p.agg(F.max("season")).first()[0]
    return shape.period_range(p, "season", top, top).groupBy("season", "week").agg(F.count("*").alias("n"))


@query(sql("panel", "").rstrip() + f""",\n{MODEL_SQL}, {REPLAY_SQL}, e AS (SELECT abs(qty - base) AS b, unnest([{{'population': 'wide', 'm': abs(qty - p_at - p_slope * p)}}, {{'population': 'narrow', 'm': abs(qty - n_at - n_slope * p)}}], recursive := true) FROM model JOIN lines USING (season) WHERE p >= 30),
 g AS (SELECT population, count(*) AS n, avg(m) AS mae, avg(b) - avg(m) AS margin FROM e GROUP BY population)
 SELECT population, n, round(mae, 5) AS mae, round(margin, 5) AS margin, margin = (SELECT max(margin) FROM g) AS better FROM g""")
def x19_wide_vs_narrow(spark, sf_dir):
    rows = stored(model_rows(spark, sf_dir), "model-rows")
    found = studies.wide_vs_narrow(rows, "season", "p", "qty", "base", F.col("p") >= 30)
    return found.select("population", "n", *(F.round(c, 5).alias(c) for c in ("mae", "margin")), "better")


@query(sql("panel", "").rstrip() + f""",\n{MODEL_SQL}, c AS (SELECT p, greatest(lo - qty, qty - hi)::DOUBLE AS miss FROM model WHERE season < 1999),
 every AS (SELECT 'everyone' AS population, list(miss ORDER BY miss) AS m FROM c UNION ALL SELECT 'eligible', list(miss ORDER BY miss) FROM c WHERE p >= 60),
 "at" AS (SELECT population, m, (len(m) - 1) * least(0.999, 0.8 * (1 + 1 / len(m))) AS i FROM every), o AS (SELECT population, m[floor(i)::INT + 1] + (i - floor(i)) * (m[floor(i)::INT + 2] - m[floor(i)::INT + 1]) AS o FROM "at")
 SELECT population, count(*) AS n, round(avg((qty BETWEEN lo - o AND hi + o)::INTEGER), 6) AS coverage, round(avg(hi - lo + 2 * o), 4) AS width FROM model, o WHERE season >= 1999 AND p >= 60 GROUP BY population""")
def x20_calibration_population(spark, sf_dir):
    rows = stored(model_rows(spark, sf_dir), "model-rows")
    found = studies.calibration_population(rows, F.col("season") < 1999, "lo", "hi", "qty", F.col("p") >= 60, lambda cal: forecast.conformal_row(cal, "lo", "hi", "qty"))
    return found.select("population", "n", F.round("coverage", 6).alias("coverage"), F.round("width", 4).alias("width"))


@query(sql("panel", """, closed AS (SELECT year(o_orderdate)::INTEGER AS season, month(o_orderdate)::INTEGER AS week FROM orders GROUP BY 1, 2 HAVING max(year(o_orderdate)) < 2001),
 kept AS (SELECT * FROM panel SEMI JOIN closed USING (season, week)),
 made AS (SELECT team, season, week, avg(x) OVER (PARTITION BY team ORDER BY season, week ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS t FROM (SELECT team, season, week, sum(qty) AS x FROM kept GROUP BY team, season, week))
 SELECT player_id, season, week, round(avg(qty) OVER w, 6) AS qty_mean5, round(avg(n_orders) OVER w, 6) AS n_orders_mean5, row_number() OVER (PARTITION BY player_id ORDER BY season, week) - 1 AS prior_games,
  round(avg(qty) OVER (PARTITION BY player_id, season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS qty_season, round(t, 5) AS team_qty_mean5
 FROM kept JOIN made USING (team, season, week) WINDOW w AS (PARTITION BY player_id ORDER BY season, week ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""").replace("GROUP BY ALL)\n,", "GROUP BY ALL),"))
def x21_study_panel(spark, sf_dir):
    """Orders before 2001 count as final."""
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"), (F.year("o_orderdate") < 2001).alias("is_final"))
    found = studies.study_panel(order_panel(spark, sf_dir), o, "player_id", "season", "week", "team", "qty", ["n_orders"])
    return found.select(*E, *G, *(F.round(c, 6).alias(c) for c in ("qty_mean5", "n_orders_mean5")), "prior_games", F.round("qty_season", 6).alias("qty_season"), F.round("team_qty_mean5", 5).alias("team_qty_mean5"))


@query()
def x09_ablation(spark, sf_dir):
    """Groups of the feature store, learned up to 1998 and graded from 1999 on."""
    rows = stored(features(spark, sf_dir).where("not is_upcoming"), "features")
    groups = {"form": ["qty_mean3", "qty_mean5", "qty_mean10"], "spread": ["qty_sd8", "qty_season"], "volume": ["revenue_mean5", "n_orders_mean5", "prior_games"]}
    found = forecast.ablation(rows.where("season < 1999"), rows.where("season >= 1999"), groups, "actual")
    return found.withColumn("mae", F.round("mae", 4))
