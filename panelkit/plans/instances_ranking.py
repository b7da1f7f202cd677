"""Queries of the composed ranking and of its checks and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, joins, windows
from ..sources import sinks
from ..sources.scratch import stored
from . import backtest, ranking
from .panel import order_panel
from .registry import query
from .slice import Slice, sql

RANK_COLS = "player_id, season, week, position, is_qualified, composite_score, rank, prev_rank, movement, is_new, fantasy_rank, prev_fantasy_rank, fantasy_movement, fantasy_is_new, week_complete"


@query(sql("ranks", f"SELECT {RANK_COLS} FROM ranks"))
def ranking_slice(spark, sf_dir):
    return Slice(spark, sf_dir).ranks.selectExpr(*RANK_COLS.split(", "))


@query(sql("panel", "SELECT * FROM panel"))
def r01_order_panel(spark, sf_dir):
    return order_panel(spark, sf_dir)


@query(sql("spine", "SELECT * FROM spine"))
def j09_spine(spark, sf_dir):
    return joins.spine(order_panel(spark, sf_dir), "player_id", "season", "week")


@query(sql("cum", "SELECT * FROM cum"))
def r03_cumulative_panel(spark, sf_dir):
    return Slice(spark, sf_dir).cum


@query(sql("metrics", "SELECT player_id, season, week, position, team_games, round(avg_order, 6) AS avg_order, revenue_total, round(return_rate, 6) AS return_rate, round(disc_rate, 6) AS disc_rate, is_qualified FROM metrics"))
def r04_rank_metrics(spark, sf_dir):
    return Slice(spark, sf_dir).metrics.select("player_id", "season", "week", "position", "team_games", F.round("avg_order", 6).alias("avg_order"), "revenue_total", F.round("return_rate", 6).alias("return_rate"), F.round("disc_rate", 6).alias("disc_rate"), "is_qualified")


@query(sql("percentiles", "SELECT player_id, season, week, position, metric, component, weight, round(percentile, 6) AS percentile FROM percentiles"))
def r05_rank_percentiles(spark, sf_dir):
    return Slice(spark, sf_dir).percentiles.select("player_id", "season", "week", "position", "metric", "component", "weight", F.round("percentile", 6).alias("percentile"))


@query(sql("scores", "SELECT player_id, season, week, efficiency_score, production_score, composite_score FROM scores"))
def r06_rank_scores(spark, sf_dir):
    return Slice(spark, sf_dir).scores.select("player_id", "season", "week", "efficiency_score", "production_score", "composite_score")


@query(sql("percentiles", """, each AS (SELECT player_id, season, week, sum(weight) FILTER (component = 'efficiency') AS e, sum(weight) FILTER (component = 'production') AS p FROM percentiles GROUP BY player_id, season, week)
 SELECT player_id, season, week, metric, round(percentile * weight * (CASE WHEN e IS NULL THEN 100 / p WHEN p IS NULL THEN 100 / e WHEN component = 'efficiency' THEN 20 / e ELSE 80 / p END), 5) AS contribution
 FROM percentiles JOIN each USING (player_id, season, week)"""))
def r08_breakdown(spark, sf_dir):
    return Slice(spark, sf_dir).breakdown.select("player_id", "season", "week", "metric", F.round("contribution", 5).alias("contribution"))


@query("""SELECT c_custkey AS player_id, c_name AS name, c_nationkey::VARCHAR AS team, false AS is_fallback FROM customer WHERE c_acctbal >= 0
 UNION ALL SELECT o_custkey, 'order ' || arg_max(o_orderkey, (o_orderdate, o_orderkey)), arg_max(o_orderpriority, (o_orderdate, o_orderkey)), true
 FROM orders ANTI JOIN (SELECT c_custkey AS o_custkey FROM customer WHERE c_acctbal >= 0) USING (o_custkey) GROUP BY o_custkey""")
def r09_player_dim(spark, sf_dir):
    """Customers without debts count as known; the others come from their latest order."""
    known = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal >= 0").select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("team"))
    facts = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("player_id"), F.col("o_orderdate").alias("season"), F.col("o_orderkey").alias("week"), F.concat(F.lit("order "), "o_orderkey").alias("name"), F.col("o_orderpriority").alias("team"))
    return ranking.player_dim(known, facts, cols=["name", "team"]).select("player_id", "name", "team", "is_fallback")


@query(sql("panel", "SELECT player_id, season, week, CASE WHEN position = 'MACHINERY' THEN round(n_orders * 3.0 + returned_qty * -1.0, 4) ELSE CAST(revenue AS DOUBLE) END AS points FROM panel"))
def r11_points(spark, sf_dir):
    given = order_panel(spark, sf_dir).withColumn("given", F.col("revenue").cast("double"))
    out = ranking.fantasy_points(given, "position", "MACHINERY", {"n_orders": 3.0, "returned_qty": -1.0}, "given")
    return out.select("player_id", "season", "week", F.round("points", 4).alias("points"))


@query(sql("ranks", """SELECT season, week, position, player_id, rank, movement, kind, place FROM (
 SELECT *, 'riser' AS kind, row_number() OVER (PARTITION BY season, week, position ORDER BY movement DESC, rank) AS place FROM ranks WHERE movement > 0
 UNION ALL SELECT *, 'faller', row_number() OVER (PARTITION BY season, week, position ORDER BY movement, rank) FROM ranks WHERE movement < 0) WHERE place <= 5"""))
def o03_movers(spark, sf_dir):
    return windows.movers(Slice(spark, sf_dir).ranks, ["season", "week", "position"], "movement", "rank").select("season", "week", "position", "player_id", "rank", "movement", "kind", "place")


@query(sql("ranks", "SELECT season, week, position, player_id, rank FROM ranks WHERE rank <= 5"))
def o10_top_ranked(spark, sf_dir):
    ranked = Slice(spark, sf_dir).ranks.where("rank is not null")
    return windows.top_k(ranked, ["season", "week", "position"], [F.col("rank")], 5).select("season", "week", "position", "player_id", "rank")


@query(sql("percentiles", """, each AS (SELECT player_id, season, week, sum(weight) FILTER (component = 'efficiency') AS e, sum(weight) FILTER (component = 'production') AS p,
  sum(weight * percentile) FILTER (component = 'efficiency') AS ge, sum(weight * percentile) FILTER (component = 'production') AS gp FROM percentiles GROUP BY player_id, season, week)
 SELECT player_id, season, week, round(CASE WHEN e IS NULL THEN 100 * gp / p WHEN p IS NULL THEN 100 * ge / e ELSE 20 * ge / e + 80 * gp / p END, 6) AS explained FROM each WHERE week = 12"""))
def q08_adds_up(spark, sf_dir):
    """Composites that their explanations do not add up to. The fault is planted: half a point more in every December."""
    s = Slice(spark, sf_dir)
    ranked = s.scores.where("composite_score is not null").select("player_id", "season", "week", (F.col("composite_score") + F.when(F.col("week") == 12, 0.5).otherwise(0.0)).alias("composite_score"))
    found = checks.adds_up(s.breakdown, ranked, ["player_id", "season", "week"], "contribution", "composite_score")
    return found.select("player_id", "season", "week", F.round("__sum", 6).alias("explained"))


@query(sql("ranks", """SELECT season, week, position, count(*) - 1 AS n FROM ranks WHERE rank IS NOT NULL AND position = 'BUILDING' GROUP BY season, week, position HAVING count(*) > 3"""))
def q11_contiguous(spark, sf_dir):
    """Ranks with a gap. The fault is planted: the third of BUILDING loses its rank, which is a gap where a fourth is."""
    ranks = Slice(spark, sf_dir).ranks.withColumn("rank", F.when((F.col("position") == "BUILDING") & (F.col("rank") == 3), None).otherwise(F.col("rank")))
    return checks.contiguous(ranks, ["season", "week", "position"], "rank").select("season", "week", "position", "n")


@query(sql("ranks", "SELECT player_id, season, week FROM ranks WHERE (week = 1 AND season = 1996) OR (position = 'MACHINERY' AND NOT is_qualified)"))
def q15_flag_agrees(spark, sf_dir):
    """Rows whose flag, rank and score disagree. Faults are planted: flags turned in one month, and scores that are shown
    for all of MACHINERY, ranked or not."""
    ranks = Slice(spark, sf_dir).ranks
    shown = ranks.withColumn("shown", F.when(F.col("position") == "MACHINERY", F.coalesce("composite_score", F.lit(0.0))).when(F.col("rank").isNotNull(), F.col("composite_score")))
    turned = shown.withColumn("is_qualified", (F.col("week") == 1) & (F.col("season") == 1996) != F.col("is_qualified"))
    return checks.flag_agrees(turned, "is_qualified", "rank", "shown").select("player_id", "season", "week")


@query(sql("ranks", """SELECT position, least, coalesce(n, 0) AS n FROM (VALUES ('AUTOMOBILE', 8), ('BUILDING', 8), ('MACHINERY', 100000), ('NOBODY', 1)) v(position, least)
 LEFT JOIN (SELECT position, count(*) AS n FROM ranks WHERE rank IS NOT NULL GROUP BY position) USING (position) WHERE coalesce(n, 0) < least"""))
def q13_min_rows(spark, sf_dir):
    ranked = Slice(spark, sf_dir).ranks.where("rank is not null")
    return checks.min_rows(ranked, "position", {"AUTOMOBILE": 8, "BUILDING": 8, "MACHINERY": 100_000, "NOBODY": 1})


@query(sql("ranks", """SELECT season, week, position, to_json({season: season, week: week, position: position, rows: list({player_id: player_id, rank: rank} ORDER BY rank)})::VARCHAR AS document
 FROM ranks WHERE rank <= 20 GROUP BY season, week, position"""))
def s13_publish_nested(spark, sf_dir):
    top = Slice(spark, sf_dir).ranks.where(F.col("rank") <= 20)
    return sinks.publish_nested(top, ["season", "week", "position"], ["rank"], ["player_id", "rank"])


@query(sql("metrics", """SELECT season, week, team, min(team_games) AS low, max(team_games) AS high FROM metrics GROUP BY ALL"""))
def j10_running_event_count(spark, sf_dir):
    s = Slice(spark, sf_dir)
    counted = joins.running_event_count(s.cum, s.finished, ["team", "season"], "week", "team_games")
    return counted.groupBy("season", "week", "team").agg(F.min("team_games").alias("low"), F.max("team_games").alias("high"))


TOP = {"BUILDING": 24, "HOUSEHOLD": 24}
BASE = {"season_points": "season_points", "per_game": "per_game"}

PAIRS_SQL = """pairs AS (SELECT season, week, position, player_id, efficiency_score, production_score, cum_revenue::DOUBLE AS season_points, cum_revenue / nullif(games, 0) AS per_game,
  paid.revenue::DOUBLE AS next_points, CASE WHEN position <> 'MACHINERY' THEN paid.qty::DOUBLE END AS next_qty
 FROM ranks SEMI JOIN (SELECT true AS yes) ON is_qualified = yes JOIN (SELECT player_id, season, week - 1 AS week, revenue, qty FROM panel) paid USING (player_id, season, week))"""
#: A row for each pair and method.
METHODS_SQL = """methods AS (SELECT season, week, position, player_id, next_points, next_qty, unnest([""" + ", ".join(f"{{'method': 'blend_{s}', 'score': coalesce({s / 100!r}::DOUBLE * efficiency_score + {1 - s / 100!r}::DOUBLE * production_score, efficiency_score, production_score)}}" for s in backtest.SHARES) + """,
   {'method': 'season_points', 'score': season_points}, {'method': 'per_game', 'score': per_game}], recursive := true) FROM pairs)"""


def groups_sql(outcome: str = "next_points", name: str = "groups") -> str:
    """Rank correlation and lift of each group and method: ranks are the mean place of equal values, best ones a list's head."""
    return f"""{name}_pool AS (SELECT season, week, position, player_id, method, round(score, 9) AS s, {outcome} AS y FROM methods WHERE {outcome} IS NOT NULL),
{name}_sorted AS (SELECT *, row_number() OVER (PARTITION BY season, week, position, method ORDER BY s) AS i, row_number() OVER (PARTITION BY season, week, position, method ORDER BY y) AS j FROM {name}_pool),
{name}_placed AS (SELECT *, avg(i) OVER (PARTITION BY season, week, position, method, s) AS rs, avg(j) OVER (PARTITION BY season, week, position, method, y) AS ro FROM {name}_sorted),
{name} AS (SELECT season, week, position, method, count(*) AS n, CASE WHEN max(rs) > min(rs) AND max(ro) > min(ro) THEN corr(rs, ro) END AS rho,
  CASE WHEN count(*) > if(position IN ('BUILDING', 'HOUSEHOLD'), 24, 12) THEN list_avg(list(y ORDER BY s DESC, player_id)[1:if(position IN ('BUILDING', 'HOUSEHOLD'), 24, 12)]) - avg(y) END AS lift
 FROM {name}_placed GROUP BY season, week, position, method HAVING count(*) >= 8 AND count(*) = count(s))"""


def _backtest_sql(select: str, groups: bool = True) -> str:
    return sql("ranks", "").rstrip() + ",\n" + PAIRS_SQL + (",\n" + METHODS_SQL + ",\n" + groups_sql() if groups else "") + "\n" + select


def _pairs(s: Slice):
    """Rows without a month after would find no outcome, so they do not go into the join."""
    outcomes = s.panel.select("player_id", "season", "week", F.col("revenue").cast("double").alias("next_points"), F.col("qty").cast("double").alias("next_qty"))
    ranks = s.ranks.where("ahead").withColumn("season_points", F.col("cum_revenue").cast("double")).withColumn("per_game", F.col("cum_revenue") / F.nullif(F.col("games"), F.lit(0)))
    return stored(backtest.forward_pairs(ranks, outcomes, ["efficiency_score", "production_score", *BASE], ["MACHINERY"], "next_qty"), "pairs")


def _groups(s: Slice, outcome: str = "next_points", pairs=None):
    return backtest.score_groups(_pairs(s) if pairs is None else pairs, outcome, BASE, k=TOP)


@query(_backtest_sql("SELECT season, week, position, player_id, efficiency_score, production_score, next_points, next_qty FROM pairs", False))
def b01_forward_pairs(spark, sf_dir):
    return _pairs(Slice(spark, sf_dir)).select("season", "week", "position", "player_id", "efficiency_score", "production_score", "next_points", "next_qty")


@query(_backtest_sql("SELECT method, count(*) AS n, count(score) AS known, round(avg(score), 3) AS mean FROM methods GROUP BY method"))
def b02_score_methods(spark, sf_dir):
    m = backtest.score_methods(_pairs(Slice(spark, sf_dir)), BASE)
    return m.groupBy("method").agg(F.count("*").alias("n"), F.count("score").alias("known"), F.round(F.avg("score"), 3).alias("mean"))


@query(_backtest_sql("SELECT season, week, position, method, n, round(rho, 6) + 0.0 AS rho, round(lift, 3) AS lift FROM groups"))
def b03_score_groups(spark, sf_dir):
    return _groups(Slice(spark, sf_dir)).select("season", "week", "position", "method", "n", (F.round("rho", 6) + 0.0).alias("rho"), F.round("lift", 3).alias("lift"))


SUMMARY_SQL = """(SELECT position, method, count(rho) AS weeks, round(avg(rho), {d}) + 0.0 AS rho, CASE WHEN count(rho) > 1 THEN round(stddev_samp(rho) / sqrt(count(rho)), {d}) END AS rho_se,
   round(avg(lift), {l}) AS lift, CASE WHEN count(lift) > 1 THEN round(stddev_samp(lift) / sqrt(count(lift)), {l}) END AS lift_se FROM {groups} GROUP BY position, method
  UNION ALL SELECT 'ALL', method, sum(weeks)::BIGINT, round(avg(r), {d}) + 0.0, NULL, round(avg(l), {l}), NULL FROM (SELECT method, count(rho) AS weeks, avg(rho) AS r, avg(lift) AS l FROM {groups} GROUP BY position, method) GROUP BY method)"""


@query(_backtest_sql("FROM " + SUMMARY_SQL.format(d=4, l=1, groups="groups")))
def b04_summarize(spark, sf_dir):
    return backtest.summarize(_groups(Slice(spark, sf_dir))).withColumns({"rho": F.col("rho") + 0.0, "lift": F.round("lift", 1), "lift_se": F.round("lift_se", 1)})


@query(_backtest_sql("""SELECT position, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x) / sqrt(count(*)), 6) AS se
 FROM (PIVOT (SELECT season, week, position, method, rho FROM groups) ON method IN ('blend_20', 'per_game') USING first(rho)) CROSS JOIN LATERAL (SELECT blend_20 - per_game AS x) WHERE x IS NOT NULL GROUP BY position"""))
def b05_paired_difference(spark, sf_dir):
    return backtest.paired_difference(_groups(Slice(spark, sf_dir)), "blend_20", "per_game").select("position", "n", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"))


@query(sql("panel", """, s AS (SELECT season, dense_rank() OVER (ORDER BY season) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT season FROM panel))
 SELECT season, CASE WHEN place <= ceil((n - 1) * 0.6) THEN 'tune' ELSE 'test' END AS part FROM s WHERE place < n""").replace("GROUP BY ALL)\n,", "GROUP BY ALL),"))
def b06_split_seasons(spark, sf_dir):
    return backtest.split_seasons(order_panel(spark, sf_dir).select("season"))


CHOSEN_SQL = """(WITH o AS (SELECT method, avg(r) AS r FROM (SELECT position, method, avg(rho) AS r FROM {groups} WHERE method LIKE 'blend%' GROUP BY position, method) GROUP BY method)
  SELECT max(substr(method, 7)::INTEGER) AS share FROM o WHERE r >= (SELECT max(r) - 0.005 FROM o))"""


@query(_backtest_sql("FROM " + CHOSEN_SQL.format(groups="groups")))
def b07_choose_weight(spark, sf_dir):
    return backtest.choose_weight(backtest.summarize(_groups(Slice(spark, sf_dir)), digits=None))


BUCKET_SQL = """(SELECT bucket, method, sum(weeks)::BIGINT AS weeks, round(avg(r), 4) AS rho FROM (
   SELECT CASE WHEN week > 11 THEN '12+' WHEN week > 5 THEN '6-11' ELSE '1-5' END AS bucket, method, position, count(rho) AS weeks, avg(rho) AS r FROM {groups} GROUP BY 1, 2, 3) GROUP BY bucket, method)"""


@query(_backtest_sql("FROM " + BUCKET_SQL.format(groups="groups")))
def b08_by_bucket(spark, sf_dir):
    return backtest.by_bucket(_groups(Slice(spark, sf_dir)))


@query(_backtest_sql("""SELECT position, max(rho) FILTER (method = 'blend_20') AS current, max(rho) FILTER (method = 'blend_50') AS chosen, max(rho) FILTER (method = 'per_game') AS baseline
 FROM (SELECT position, method, round(avg(rho), 4) AS rho FROM groups GROUP BY position, method) GROUP BY position"""))
def b09_headline(spark, sf_dir):
    return backtest.headline(backtest.summarize(_groups(Slice(spark, sf_dir))), {"current": "blend_20", "chosen": "blend_50", "baseline": "per_game"})


def _whole_sql() -> str:
    """The whole backtest: results of both outcomes by part, then comparisons and buckets of the first on test seasons."""
    parts = "split AS (SELECT season, CASE WHEN place <= ceil((n - 1) * 0.6) THEN 'tune' ELSE 'test' END AS part FROM (SELECT season, row_number() OVER (ORDER BY season) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT season FROM {g})) WHERE place < n)"
    views, tables = [], []
    for name, g in (("points", "groups"), ("qty", "other")):
        views.append(parts.format(g=g).replace("split AS", f"{g}_split AS"))
        for part in ("tune", "test"):
            views.append(f"{g}_{part} AS (SELECT * FROM {g} SEMI JOIN (SELECT season FROM {g}_split WHERE part = '{part}') USING (season))")
            tables.append(f"SELECT 'result' AS kind, '{name}' AS outcome, '{part}' AS part, method, position, weeks, rho, rho_se, lift, lift_se FROM {SUMMARY_SQL.format(d=4, l=1, groups=f'{g}_{part}')}")
    tables.append("""SELECT 'comparison', 'points', 'test', a.method, position, count(a.rho - b.rho), round(avg(a.rho - b.rho), 4), CASE WHEN count(a.rho - b.rho) > 1 THEN round(stddev_samp(a.rho - b.rho) / sqrt(count(a.rho - b.rho)), 4) END, NULL, NULL
 FROM groups_test a JOIN groups_test b USING (season, week, position) WHERE a.method <> 'per_game' AND b.method = 'per_game' GROUP BY a.method, position""")
    tables.append(f"SELECT 'bucket', 'points', 'test', method, bucket, weeks, rho, NULL, NULL, NULL FROM {BUCKET_SQL.format(groups='groups_test')}")
    whole = " UNION ALL ".join(tables)
    choice = f"chosen AS (SELECT 'blend_' || share AS best FROM {CHOSEN_SQL.format(groups='groups_tune')})"
    select = f"SELECT w.*, method = best AS selected FROM ({whole}) w, chosen WHERE kind = 'result' OR method IN (best, 'blend_20') OR (kind = 'bucket' AND method = 'per_game')"
    return sql("ranks", "").rstrip() + ",\n" + ",\n".join([PAIRS_SQL, METHODS_SQL, groups_sql(), groups_sql("next_qty", "other"), *views, choice]) + "\n" + select


@query(_whole_sql())
def b10_run_backtest(spark, sf_dir):
    """The blend is chosen on the tuning seasons for revenue; quantity, which one position lacks, is the second outcome."""
    s = Slice(spark, sf_dir)
    pairs = _pairs(s)
    groups = {"points": stored(_groups(s, "next_points", pairs), "groups"), "qty": stored(_groups(s, "next_qty", pairs), "groups")}
    return backtest.run_backtest(groups, "per_game").withColumns({"rho": F.col("rho") + 0.0, "lift": F.round("lift", 1), "lift_se": F.round("lift_se", 1)})


@query(_backtest_sql("""SELECT position, current, baseline FROM (SELECT position, max(rho) FILTER (method = 'blend_100') AS current, max(rho) FILTER (method = 'season_points') AS baseline
 FROM (SELECT position, method, round(avg(rho), 4) AS rho FROM groups GROUP BY position, method) GROUP BY position) WHERE baseline - current > 0.02"""))
def b11_trailing_groups(spark, sf_dir):
    h = backtest.headline(backtest.summarize(_groups(Slice(spark, sf_dir))), {"current": "blend_100", "baseline": "season_points"})
    return backtest.trailing_groups(h)
