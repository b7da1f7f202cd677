"""Queries of operators that the other instance modules do not reach, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import aggs, checks, joins, windows
from ..sources.scratch import stored
from . import forecast, ranking, studies
from .instances_core import GAMES_SQL, MODEL_SQL, E, G, games, model_rows
from .panel import order_panel, table
from .registry import query
from .slice import sql


def over_panel(select: str) -> str:
    """SQL with further common tables, or a plain query, over the panel."""
    return sql("panel", "").rstrip() + (",\n" if not select.lstrip().startswith("SELECT") else "\n") + select


def over_model(select: str) -> str:
    return sql("panel", "").rstrip() + f",\n{MODEL_SQL}" + (",\n" if not select.lstrip().startswith("SELECT") else "\n") + select


@query(over_panel(GAMES_SQL + """, lines AS (SELECT o_custkey AS player_id, year(o_orderdate)::INTEGER AS season, month(o_orderdate)::INTEGER AS week, n_name AS seller, count(*) AS snaps
   FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL),
 most AS (SELECT player_id, season, week, max(snaps) AS snaps FROM lines GROUP BY player_id, season, week),
 hurt AS (SELECT DISTINCT o_custkey AS player_id, year(o_orderdate)::INTEGER AS season, month(o_orderdate)::INTEGER AS week FROM orders WHERE o_orderpriority = '1-URGENT')
 SELECT p.season, p.week, p.team, count(*) AS n, count(g.home) AS with_game, sum(m.snaps)::BIGINT AS snaps, count(h.player_id) AS hurt FROM panel p LEFT JOIN games g ON g.season = p.season AND g.week = p.week AND p.team IN (g.home, g.away)
 LEFT JOIN most m ON m.player_id = p.player_id AND m.season = p.season AND m.week = p.week LEFT JOIN hurt h ON h.player_id = p.player_id AND h.season = p.season AND h.week = p.week GROUP BY p.season, p.week, p.team"""))
def r01_panel_fact(spark, sf_dir):
    """Customers' months with the games of their nation, the most lines that one nation sold them, and urgent orders."""
    p = order_panel(spark, sf_dir).select(*E, *G, "team", "qty")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("team"))
    sellers = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "team")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("other_id"), "o_custkey", F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"), "o_orderpriority")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    snaps = o.join(items, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("other_id", *G, "team").agg(F.count("*").alias("snaps"))
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player_id"), F.concat(F.lit("c"), "c_custkey").alias("other_id"))
    hurt = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("player_id"), *G).distinct().withColumn("injury_status", F.lit("Out"))
    fact = ranking.panel_fact(p, games(spark, sf_dir).withColumn("game_id", F.concat_ws("-", "home", "away")), ids, snaps, hurt)
    return fact.groupBy(*G, "team").agg(F.count("*").alias("n"), F.count("game_id").alias("with_game"), F.sum("snaps").alias("snaps"), F.count("injury_status").alias("hurt"))


@query(over_panel("""SELECT 2001 AS season, min(week) AS week FROM panel WHERE season = 2001 AND week > 5 AND qty IS NOT NULL"""))
def m24_next_to_predict(spark, sf_dir):
    """The outcome of months after May 2001 is taken as unknown."""
    rows = order_panel(spark, sf_dir).withColumn("outcome", F.when((F.col("season") < 2001) | (F.col("week") <= 5), F.col("qty")))
    return forecast.next_to_predict(rows, 2001, "outcome").select(F.lit(2001).alias("season"), "week")


WEEKS_SQL = """w AS (SELECT season, week, count(*) AS n, avg(abs(qty - p)) AS mae, avg((qty - p) * (qty - p)) AS mse, avg((qty BETWEEN lo AND hi)::INTEGER) AS coverage, avg((abs(qty - p) <= 5)::INTEGER) AS within,
  avg((abs(qty - base) <= 5)::INTEGER) AS by_base, avg((abs(qty - 60) <= 5)::INTEGER) AS by_sixty FROM model GROUP BY season, week)"""


def graded_weeks(spark, sf_dir):
    rows = stored(model_rows(spark, sf_dir), "model-rows")
    locked = rows.select(*E, *G, F.col("p").alias("points"), F.col("lo").alias("low"), F.col("hi").alias("high"))
    return rows, forecast.grade(locked, rows.select(*E, *G, "qty", "base"), [*E, *G], "qty", ["base"])


@query(over_model(WEEKS_SQL + """ SELECT season, week, n, round(mae, 5) AS mae, round(sqrt(mse), 5) AS rmse, round(coverage, 6) AS coverage FROM w
 UNION ALL SELECT season, NULL, sum(n)::BIGINT, round(sum(n * mae) / sum(n), 5), round(sqrt(sum(n * mse) / sum(n)), 5), round(sum(n * coverage) / sum(n), 6) FROM w GROUP BY season"""))
def m29_accuracy_table(spark, sf_dir):
    found = forecast.accuracy_table(graded_weeks(spark, sf_dir)[1])
    return found.select("season", "week", "n", F.round("mae", 5).alias("mae"), F.round("rmse", 5).alias("rmse"), F.round("coverage", 6).alias("coverage"))


@query(over_model(WEEKS_SQL + " SELECT season, week, round(within, 6) AS within, round(greatest(by_base, by_sixty), 6) AS best_baseline_within FROM w"))
def m30_within_series(spark, sf_dir):
    """Two baselines: the long mean, and always sixty."""
    rows, weeks = graded_weeks(spark, sf_dir)
    near = lambda c: aggs.rate(F.abs(F.col("qty") - c) <= 5)
    bases = rows.groupBy(*G).agg(near(F.col("base")).alias("b"), near(F.lit(60)).alias("s")).select(*G, scalar.named_map({"base": "b", "sixty": "s"}).alias("baseline_within"))
    found = forecast.within_series(weeks.join(bases, G))
    return found.select(*G, F.round("within", 6).alias("within"), F.round("best_baseline_within", 6).alias("best_baseline_within"))


@query(over_panel("""t AS (SELECT qty, CASE WHEN count(*) OVER w >= 3 THEN avg(revenue) OVER w END AS r, CASE WHEN count(*) OVER w >= 3 THEN avg(qty) OVER w END AS q FROM panel WINDOW w AS (PARTITION BY player_id ORDER BY season, week ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
 SELECT round(corr(r, qty), 6) AS revenue, round(corr(q, qty), 6) AS qty FROM t"""))
def x08_trailing_corr(spark, sf_dir):
    found = studies.trailing_corr(order_panel(spark, sf_dir), E, G, ["revenue", "qty"], "qty", 6, 3)
    return found.select(F.round("revenue", 6).alias("revenue"), F.round("qty", 6).alias("qty"))


@query(over_panel("""g AS (SELECT team, count(*) AS n, count(*) FILTER (qty > 60) AS seen FROM panel GROUP BY team), t AS (SELECT sum(seen) / sum(n) AS rate FROM g)
 SELECT round(sum((seen - n * rate) * (seen - n * rate) / (n * rate)), 5) AS chi2, count(*) - 1 AS df FROM g, t"""))
def x03_chi_square(spark, sf_dir):
    found = studies.chi_square(order_panel(spark, sf_dir), "team", F.col("qty") > 60)
    return found.select(F.round("chi2", 5).alias("chi2"), "df")


@query(over_panel("""e AS (SELECT team, sum(qty)::DOUBLE AS seen, count(*) * (SELECT avg(qty) FROM panel) AS expected FROM panel GROUP BY team)
 SELECT round(var_samp(seen) / avg(seen), 4) AS var_to_mean, round(avg((seen - expected) * (seen - expected) / expected), 5) AS pearson FROM e"""))
def x07_dispersion(spark, sf_dir):
    p = stored(order_panel(spark, sf_dir), "panel")
    rate = p.agg(F.avg("qty").alias("rate"))
    counts = p.groupBy("team").agg(F.sum("qty").cast("double").alias("seen"), F.count("*").alias("k")).crossJoin(F.broadcast(rate)).withColumn("expected", F.col("k") * F.col("rate"))
    found = studies.dispersion(counts)
    return found.select(F.round("var_to_mean", 4).alias("var_to_mean"), F.round("pearson", 5).alias("pearson"))


@query(over_model("SELECT position, count(*) AS n, round(avg((qty > 50)::INTEGER), 6) AS rate, round(avg((least(p / 100, 1) - (qty > 50)::INTEGER) ** 2), 6) AS brier FROM model GROUP BY position HAVING count(*) >= 40"))
def x17_availability_study(spark, sf_dir):
    rows = model_rows(spark, sf_dir).withColumns({"y": (F.col("qty") > 50).cast("int"), "chance": F.least(F.col("p") / 100, F.lit(1.0))})
    found = studies.availability_study(rows, "y", "chance", "position")
    return found.select("position", "n", F.round("rate", 6).alias("rate"), F.round("brier", 6).alias("brier"))


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS x, max(o_orderpriority) AS label FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS y FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
 SELECT coalesce(a.k, b.k) AS k, x, y, label FROM a FULL JOIN b ON a.k = b.k""")
def j07_full_merge_first(spark, sf_dir):
    """Both inputs have a label; it comes from the first alone."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey"))
    part = lambda status, name: o.where(F.col("o_orderstatus") == status).groupBy("k").agg(F.count("*").alias(name), F.max("o_orderpriority").alias("label"))
    return joins.full_merge_first([part("F", "x"), part("O", "y")], ["k"], ["label"]).select("k", "x", "y", "label")


@query("SELECT o_custkey FROM orders ANTI JOIN (SELECT c_custkey AS o_custkey FROM customer WHERE c_acctbal > 0) USING (o_custkey)")
def q10_only_from(spark, sf_dir):
    """Orders of customers that the other table, those with money, does not have."""
    people = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return checks.only_from(table(spark, sf_dir, "orders").select("o_custkey"), people, ["o_custkey"])


@query("""WITH newest AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s FROM orders GROUP BY o_custkey), noted AS (SELECT o_custkey, max(o_orderstatus) AS s FROM orders GROUP BY o_custkey)
 SELECT o_custkey, n.s AS o_orderstatus FROM noted n JOIN newest x USING (o_custkey) WHERE n.s <> x.s""")
def q10_details_from_latest(spark, sf_dir):
    """Notes that hold the largest status, where the latest order has another."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    notes = o.groupBy("o_custkey").agg(F.max("o_orderstatus").alias("o_orderstatus"))
    return checks.details_from_latest(notes, o, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderstatus"])


@query("""SELECT event_id, json_object('user_id', user_id, 'event_type', event_type)::VARCHAR AS doc, (event_id || '/kind=' || event_type || '/part-0') AS path, event_type AS kind FROM events WHERE event_type <> ''""")
def f01_f22_paths_and_documents(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type <> ''").select("event_id", "user_id", "event_type")
    e = e.withColumn("path", F.concat(F.col("event_id").cast("string"), F.lit("/kind="), "event_type", F.lit("/part-0")))
    return e.select("event_id", scalar.to_doc("user_id", "event_type").alias("doc"), "path", scalar.path_part("kind", "path").alias("kind"))


@query("SELECT o_orderkey, o_totalprice / nullif(o_custkey % 3, 0) AS ratio, CAST(CASE WHEN month(o_orderdate) < 3 THEN year(o_orderdate) - 1 ELSE year(o_orderdate) END AS INTEGER) AS season FROM orders")
def e01_sql_functions(spark, sf_dir):
    """The helpers as SQL macros."""
    scalar.register(spark)
    o = table(spark, sf_dir, "orders")
    return o.selectExpr("o_orderkey", "safe_ratio(CAST(o_totalprice AS DOUBLE), CAST(o_custkey % 3 AS DOUBLE)) AS ratio", "season_of(CAST(o_orderdate AS DATE)) AS season")
