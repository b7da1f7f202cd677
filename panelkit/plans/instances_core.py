"""One query per operator family, over the order panel and the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import aggs, checks, joins, shape, windows
from ..sources import snapshots
from .panel import order_panel, table
from .registry import query
from .slice import config, sql, weights

E, G = ["player_id"], ["season", "week"]


def r6(c, name=None):
    return F.round(c, 6).alias(name or c)


def panel_sql(select: str) -> str:
    return sql("panel", select)


# ---- projections, filters, unions --------------------------------------------------------------------------------


@query("SELECT c_custkey AS player_id, c_name AS name, c_mktsegment AS position FROM customer WHERE c_nationkey IS NOT NULL AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def p02_p03_p06_curate(spark, sf_dir):
    rows = shape.isin(shape.require(table(spark, sf_dir, "customer"), "c_nationkey"), "c_mktsegment", ["BUILDING", "MACHINERY"])
    return shape.curate(rows, {"player_id": "c_custkey", "name": "c_name", "position": "c_mktsegment"})


@query("SELECT * EXCLUDE (l_tax, l_shipdate) FROM lineitem WHERE l_linenumber BETWEEN 2 AND 4")
def p01_p10_drop_cols_range(spark, sf_dir):
    return shape.drop_cols(shape.period_range(table(spark, sf_dir, "lineitem"), "l_linenumber", 2, 4), ["l_tax", "l_shipdate"])


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS high, count(*) FILTER (value IS NULL) AS missing FROM events WHERE event_type IS NOT NULL AND event_type <> '' GROUP BY event_type")
def p05_p07_p08_flags(spark, sf_dir):
    rows = shape.non_blank(table(spark, sf_dir, "events"), "event_type").withColumn("high", shape.flag("value", ">", 50.0))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("high").alias("high"), F.count_if(F.col("value").isNull()).alias("missing"))


@query(panel_sql("SELECT season, min(week) AS week FROM (SELECT season, week, season < 2001 OR week < 6 AS done FROM panel) WHERE NOT done AND season = (SELECT max(season) FROM panel) GROUP BY season"))
def p12_next_period(spark, sf_dir):
    rows = order_panel(spark, sf_dir).withColumn("done", (F.col("season") < 2001) | (F.col("week") < 6))
    return shape.next_period(rows, "season", "week", "done")


@query(panel_sql(""", told AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season, week) - 1 AS prior, avg(n_orders) OVER (PARTITION BY player_id ORDER BY season, week ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS recent FROM panel)
 SELECT season, week, count(*) FILTER (qty > 20) AS trainable, count(*) AS predictable, count(*) FILTER (season = 1998 AND week = 6 AND recent >= 2) AS reportable FROM told WHERE prior >= 3 GROUP BY season, week""").replace("GROUP BY ALL)\n,", "GROUP BY ALL),"))
def p11_p13_populations(spark, sf_dir):
    """Who can be learned from and predicted, by month; who is reported, in one month. An outcome of 20 or less is unknown."""
    rows = windows.trailing(windows.prior_count(order_panel(spark, sf_dir), E, G), E, G, {"recent": ("avg", "n_orders", 5)})
    rows = rows.withColumn("outcome", F.when(F.col("qty") > 20, F.col("qty")))
    parts = {"trainable": shape.trainable(rows, outcome="outcome"), "predictable": shape.predictable(rows), "reportable": shape.reportable(rows, 1998, 6, "recent", min_recent=2.0)}
    each = shape.tagged_union({name: df.select(*G) for name, df in parts.items()})
    return each.groupBy(*G).agg(*(F.count_if(F.col("kind") == name).alias(name) for name in parts))


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%0012%' OR lower(c_mktsegment) = '0012'")
def p14_search_filter(spark, sf_dir):
    return shape.search_filter(table(spark, sf_dir, "customer"), " 0012 ", name="c_name", team_col="c_mktsegment").select("c_custkey", "c_name")


@query("SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL")
def p15_distinct_values(spark, sf_dir):
    return shape.distinct_values(table(spark, sf_dir, "customer"), "c_mktsegment")


GAMES_SQL = """games AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS season, CAST(month(o_orderdate) AS INTEGER) AS week, c.n_name AS home, s.n_name AS away
 FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation c ON c.n_nationkey = c_nationkey
 JOIN supplier ON s_suppkey = l_suppkey JOIN nation s ON s.n_nationkey = s_nationkey WHERE c.n_name <> s.n_name)"""


def games(spark, sf_dir):
    """Pairs of customer and supplier nation that meet in a month."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    buyers = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("home"))
    sellers = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("away"))
    rows = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).join(buyers, F.col("o_custkey") == F.col("c_custkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.where("home <> away").select(F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"), "home", "away").distinct()


@query(f"WITH {GAMES_SQL} SELECT team, is_home, count(*) AS n FROM (SELECT home AS team, true AS is_home FROM games UNION ALL SELECT away, false FROM games) GROUP BY ALL")
def u01_sides(spark, sf_dir):
    return shape.sides(games(spark, sf_dir), [], {"team": "home"}, {"team": "away"}).groupBy("team", "is_home").agg(F.count("*").alias("n"))


@query("SELECT kind, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM (SELECT 'customer' AS kind, c_custkey AS k FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier) GROUP BY kind")
def u02_u05_tagged_union(spark, sf_dir):
    both = shape.tagged_union({"customer": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "supplier": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))})
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query(panel_sql("SELECT player_id, season, week, metric, metric_value FROM (SELECT player_id, season, week, CAST(revenue AS DOUBLE) AS revenue, CAST(qty AS DOUBLE) AS qty, CAST(nullif(returned_qty, 0) AS DOUBLE) AS returned_qty FROM panel) UNPIVOT (metric_value FOR metric IN (revenue, qty, returned_qty))"))
def u04_to_long(spark, sf_dir):
    rows = order_panel(spark, sf_dir).withColumn("returned_qty", F.nullif("returned_qty", F.lit(0)))
    return shape.to_long(rows, [*E, *G], ["revenue", "qty", "returned_qty"])


@query(panel_sql("SELECT player_id, season, week, CAST(qty AS DOUBLE) AS qty, CAST(NULL AS VARCHAR) AS status, 'panel' AS kind FROM panel"))
def p09_pad_to(spark, sf_dir):
    from pyspark.sql import types as T

    wanted = T.StructType.fromDDL("player_id bigint, season int, week int, qty double, status string, kind string")
    return shape.pad_to(order_panel(spark, sf_dir), wanted, kind="panel")


# ---- joins -------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, coalesce(s, o_orderpriority) AS o_orderpriority FROM orders LEFT JOIN (VALUES ('1-URGENT', 'HIGH'), ('2-HIGH', 'HIGH')) m(r, s) ON r = o_orderpriority")
def j01_std_code(spark, sf_dir):
    codes = spark.createDataFrame([("1-URGENT", "HIGH"), ("2-HIGH", "HIGH")], "raw string, standard string")
    return joins.std_code(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", codes)


@query("SELECT p_partkey, grp FROM part LEFT JOIN (VALUES ('ECONOMY', 'cheap'), ('STANDARD', 'plain')) m(t, grp) ON t = p_type")
def j02_map_category(spark, sf_dir):
    groups = spark.createDataFrame([("ECONOMY", "cheap"), ("STANDARD", "plain")], "t string, g string")
    return joins.map_category(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", groups, "t", "g", "grp").select("p_partkey", "grp")


@query(sql("panel", "").rstrip() + f",\n{GAMES_SQL} SELECT p.season, p.week, p.team, count(*) AS n FROM panel p JOIN games g ON g.season = p.season AND g.week = p.week AND (p.team = g.home OR p.team = g.away) GROUP BY ALL")
def j04_membership_join(spark, sf_dir):
    people = order_panel(spark, sf_dir).groupBy("season", "week", "team").agg(F.count("*").alias("members"))
    met = joins.membership_join(people, games(spark, sf_dir), G, "team", ["home", "away"])
    return met.groupBy("season", "week", "team").agg(F.sum("members").alias("n"))


@query("""SELECT CAST(coalesce(a.d, b.d, c.d) AS VARCHAR) AS d, x, y, z FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a
 FULL JOIN (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS y FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON a.d = b.d
 FULL JOIN (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS z FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) c ON c.d = coalesce(a.d, b.d)""")
def j06_j07_full_merge(spark, sf_dir):
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    parts = [
        orders.where("o_orderstatus = 'F'").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("x")),
        items.where("l_returnflag = 'R'").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.count("*").alias("y")),
        orders.where("o_orderpriority = '1-URGENT'").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("z")),
    ]
    return joins.full_merge(parts, ["d"]).withColumn("d", F.col("d").cast("string"))


@query(panel_sql("SELECT a.player_id, a.season, a.week, b.revenue AS prev_revenue FROM panel a LEFT JOIN panel b ON a.player_id = b.player_id AND a.season = b.season AND b.week = a.week - 1"))
def j12_prev_period(spark, sf_dir):
    return joins.prev_period(order_panel(spark, sf_dir), ["player_id", "season"], "week", ["revenue"]).select(*E, *G, "prev_revenue")


@query(panel_sql("SELECT a.player_id, a.season, a.week, b.revenue AS next_revenue FROM panel a JOIN panel b ON a.player_id = b.player_id AND a.season = b.season AND b.week = a.week + 1"))
def j13_next_period(spark, sf_dir):
    p = order_panel(spark, sf_dir)
    return joins.next_period_outcome(p.select(*E, *G), p.select(*E, *G, F.col("revenue").alias("next_revenue")), ["player_id", "season"], "week")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS ordered FROM customer")
def j14_j15_anti_semi(spark, sf_dir):
    people, orders = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return joins.semi(people, orders, ["c_custkey"]).withColumn("ordered", F.lit(True)).unionByName(joins.anti(people, orders, ["c_custkey"]).withColumn("ordered", F.lit(False)))


@query(sql("metrics", "SELECT panel.player_id, panel.season, panel.week, min_role, efficiency_share FROM panel JOIN config ON config.position = panel.position"))
def j16_j17_with_config(spark, sf_dir):
    p = joins.with_config(order_panel(spark, sf_dir), config(spark), "position")
    weighted = joins.with_config(p.withColumn("metric", F.lit("avg_order")), weights(spark), ["position", "metric"])
    return weighted.select(*E, *G, "min_role", "efficiency_share")


@query(panel_sql("SELECT season, count(*) AS shared FROM (SELECT DISTINCT player_id, season FROM panel WHERE week <= 2) a SEMI JOIN (SELECT player_id, season FROM panel WHERE week >= 11) b USING (player_id, season) GROUP BY season"))
def j19_overlap(spark, sf_dir):
    p = order_panel(spark, sf_dir)
    return joins.overlap(p.where("week <= 2"), p.where("week >= 11"), ["player_id", "season"]).groupBy("season").agg(F.count("*").alias("shared"))


@query(panel_sql("SELECT a.player_id, a.season, a.qty AS qty_a, b.qty AS qty_b FROM panel a JOIN panel b USING (player_id, season) WHERE a.week = 1 AND b.week = 12"))
def j21_paired_join(spark, sf_dir):
    p = order_panel(spark, sf_dir)
    return joins.paired_join(p.where("week = 1"), p.where("week = 12"), ["player_id", "season"], "qty")


@query("SELECT s_suppkey, coalesce(n_name, CAST(k AS VARCHAR)) AS n_name FROM (SELECT s_suppkey, s_nationkey + CASE WHEN s_suppkey % 5 = 0 THEN 100 ELSE 0 END AS k FROM supplier) LEFT JOIN nation ON n_nationkey = k")
def j22_enrich(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") + F.when(F.col("s_suppkey") % 5 == 0, 100).otherwise(0)).alias("n_nationkey"))
    return joins.enrich(rows, table(spark, sf_dir, "nation"), "n_nationkey", "n_name").select("s_suppkey", "n_name")


@query(panel_sql("SELECT a.player_id, a.season, a.week, b.week IS NOT NULL AS played_last FROM panel a LEFT JOIN panel b ON a.player_id = b.player_id AND a.season = b.season AND b.week = a.week - 1"))
def j23_appeared_last(spark, sf_dir):
    p = order_panel(spark, sf_dir).select(*E, *G)
    return joins.appeared_last(p, p, ["player_id", "season"], "week")


@query("SELECT s_suppkey, last_day FROM supplier, (SELECT CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_day FROM orders)")
def j24_cross_one(spark, sf_dir):
    return joins.cross_one(table(spark, sf_dir, "supplier").select("s_suppkey"), table(spark, sf_dir, "orders").agg(F.to_date(F.max("o_orderdate")).cast("string").alias("last_day")))


@query(panel_sql("""SELECT team, position, season, week, round(h, 4) AS allowed FROM (SELECT *, avg(x) OVER (PARTITION BY team, position ORDER BY season, week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS h
 FROM (SELECT team, position, season, week, sum(revenue) AS x FROM panel GROUP BY ALL))"""))
def j25_w16_opponent_history(spark, sf_dir):
    p = order_panel(spark, sf_dir)
    history = windows.trailing_of_agg(p, ["team", "position"], G, "revenue", 8, "allowed")
    rows = p.select("team", "position", *G).distinct()
    return joins.opponent_history(rows, history, ["team", "position"], "allowed", G, asof=False).withColumn("allowed", F.round("allowed", 4))


# ---- aggregations ------------------------------------------------------------------------------------------------


@query(panel_sql("""SELECT position, CAST(sum(revenue) AS BIGINT) AS revenue, min(week) AS first, count(*) FILTER (n_orders > 1) AS busy, round(avg(CAST(returned_qty > 0 AS INTEGER)), 6) AS return_share, count(DISTINCT player_id) AS people FROM panel GROUP BY position"""))
def a01_a04_group_agg(spark, sf_dir):
    return aggs.group_agg(order_panel(spark, sf_dir), ["position"], {
        "revenue": F.sum("revenue"), "first": F.min("week"), "busy": F.count_if(F.col("n_orders") > 1), "return_share": F.round(aggs.rate(F.col("returned_qty") > 0), 6), "people": F.count_distinct("player_id"),
    })


@query(panel_sql("SELECT player_id, max_by(revenue, (season, week)) AS last, min_by(revenue, (season, week)) AS first, bool_and(n_orders < 4) AS calm FROM panel GROUP BY player_id"))
def a05_a06_a21_latest_first_all(spark, sf_dir):
    p = order_panel(spark, sf_dir)
    last = aggs.latest_by(p, E, G, ["revenue"]).withColumnRenamed("revenue", "last")
    first = aggs.first_by(p, E, G, ["revenue"]).withColumnRenamed("revenue", "first")
    return last.join(first, "player_id").join(aggs.all_true(p.withColumn("few", F.col("n_orders") < 4), E, "few", "calm"), "player_id")


@query(panel_sql("SELECT player_id, season, count(*) AS n FROM panel GROUP BY ALL HAVING count(*) > 1"))
def a07_a09_duplicates(spark, sf_dir):
    return aggs.duplicates(order_panel(spark, sf_dir), ["player_id", "season"])


@query(panel_sql("SELECT position, count(*) AS n, round(avg(qty), 6) AS mean, round(stddev_samp(qty) / sqrt(count(*)), 6) AS se FROM panel GROUP BY position"))
def a10_mean_se(spark, sf_dir):
    return aggs.mean_se(order_panel(spark, sf_dir), ["position"], "qty").select("position", "n", r6("mean"), r6("se"))


@query(panel_sql("SELECT season, round(sum(mae * n) / sum(n), 4) AS mae, round(sqrt(sum(mae * mae * n) / sum(n)), 4) AS rmse FROM (SELECT season, week, avg(qty) AS mae, count(*) AS n FROM panel GROUP BY ALL) GROUP BY season"))
def a11_pooled(spark, sf_dir):
    weekly = order_panel(spark, sf_dir).groupBy(*G).agg(F.avg("qty").alias("mae"), F.count("*").alias("n"))
    return weekly.groupBy("season").agg(F.round(aggs.pooled("mae", "n"), 4).alias("mae"), F.round(aggs.pooled_rmse("mae", "n"), 4).alias("rmse"))


@query(panel_sql("SELECT season, week, round(CASE WHEN count(*) >= 3 AND max(qty) > min(qty) AND max(revenue) > min(revenue) THEN corr(qty, revenue) END, 6) AS r FROM panel GROUP BY ALL"))
def a12_pearson(spark, sf_dir):
    return aggs.pearson_by(order_panel(spark, sf_dir), G, "qty", "revenue").withColumn("r", F.round("r", 6))


@query(panel_sql("""SELECT season, week, round(CASE WHEN count(*) >= 3 AND max(a) > min(a) AND max(b) > min(b) THEN corr(a, b) END, 6) AS rho FROM (SELECT season, week,
 rank() OVER (PARTITION BY season, week ORDER BY qty) + (count(*) OVER (PARTITION BY season, week, qty) - 1) / 2 AS a, rank() OVER (PARTITION BY season, week ORDER BY revenue) + (count(*) OVER (PARTITION BY season, week, revenue) - 1) / 2 AS b FROM panel) GROUP BY ALL"""))
def a13_w17_spearman(spark, sf_dir):
    return aggs.spearman_by(order_panel(spark, sf_dir), G, "qty", "revenue").withColumn("rho", F.round("rho", 6))


@query(panel_sql("""SELECT season, week, position, round(CASE WHEN count(*) > 5 THEN avg(revenue) FILTER (place <= 5) - avg(revenue) END, 3) AS lift FROM (SELECT *, row_number() OVER (PARTITION BY season, week, position ORDER BY qty DESC NULLS LAST, player_id) AS place FROM panel) GROUP BY ALL"""))
def a14_lift(spark, sf_dir):
    return aggs.lift_by(order_panel(spark, sf_dir), [*G, "position"], "qty", "revenue", "player_id", 5).withColumn("lift", F.round("lift", 3))


@query(panel_sql("SELECT position, round(quantile_cont(revenue, 0.8), 3) AS q80, round(quantile_cont(qty, 0.5), 3) AS median FROM panel GROUP BY position"))
def a15_a16_quantiles(spark, sf_dir):
    return order_panel(spark, sf_dir).groupBy("position").agg(F.round(aggs.quantile_exact("revenue", 0.8), 3).alias("q80"), F.round(aggs.quantile_exact("qty", 0.5), 3).alias("median"))


MODEL_SQL = """model AS (SELECT *, m5 AS p, mall AS base, least(m5 - 20, m5 + 20) AS lo, m5 + 20 AS hi FROM (SELECT *, avg(qty) OVER (PARTITION BY player_id ORDER BY season, week ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS m5,
 avg(qty) OVER (PARTITION BY player_id ORDER BY season, week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mall FROM panel) WHERE m5 IS NOT NULL)"""


def model_rows(spark, sf_dir):
    """Trailing means stand for a model and a baseline."""
    rows = windows.trailing(order_panel(spark, sf_dir), E, G, {"p": ("avg", "qty", 5), "base": ("avg", "qty", None)})
    return rows.where("p is not null").withColumn("lo", F.col("p") - 20).withColumn("hi", F.col("p") + 20)


@query(sql("panel", "").rstrip() + f",\n{MODEL_SQL} SELECT season, count(*) AS n, round(avg(abs(qty - p)), 5) AS mae, round(sqrt(avg((qty - p) * (qty - p))), 5) AS rmse, round(avg(CAST(qty >= lo AND qty <= hi AS INTEGER)), 6) AS coverage, round(avg(CAST(abs(qty - p) <= 5 + 1e-9 AS INTEGER)), 6) AS within FROM model GROUP BY season")
def a17_error_metrics(spark, sf_dir):
    found = model_rows(spark, sf_dir).groupBy("season").agg(*(c.alias(n) for n, c in aggs.error_metrics("qty", "p", "lo", "hi").items()))
    return found.select("season", "n", F.round("mae", 5).alias("mae"), F.round("rmse", 5).alias("rmse"), r6("coverage"), r6("within"))


@query(sql("panel", "").rstrip() + f",\n{MODEL_SQL} SELECT position AS category, count(*) AS n, round(avg(abs(qty - p)), 5) AS model_mae, round(avg(abs(qty - base)), 5) AS baseline_mae, round(avg(abs(qty - base)) - avg(abs(qty - p)), 5) AS margin FROM model GROUP BY position")
def a18_error_by(spark, sf_dir):
    found = aggs.error_by(model_rows(spark, sf_dir), "position", "qty", "p", "base")
    return found.select("category", "n", *(F.round(c, 5).alias(c) for c in ("model_mae", "baseline_mae", "margin")))


@query(sql("panel", "").rstrip() + f",\n{MODEL_SQL} SELECT tier, count(*) AS n, round(avg(abs(qty - p)), 5) AS model_mae FROM (SELECT *, CASE WHEN p > -0.01 AND p <= 40 THEN '(-0.01, 40]' WHEN p > 40 AND p <= 80 THEN '(40, 80]' WHEN p > 80 AND p <= 130 THEN '(80, 130]' WHEN p > 130 AND p <= 1000 THEN '(130, 1000]' END AS tier FROM model) WHERE tier IS NOT NULL GROUP BY tier")
def a19_error_by_tier(spark, sf_dir):
    found = aggs.error_by_tier(model_rows(spark, sf_dir), "p", "qty", "p", "base", (-0.01, 40, 80, 130, 1000))
    return found.select("tier", "n", F.round("model_mae", 5).alias("model_mae"))


@query(panel_sql("SELECT team, round(avg(qty) FILTER (week % 2 = 1), 5) AS odd, round(avg(qty) FILTER (week % 2 = 0), 5) AS even, round(avg(qty) FILTER (week % 2 = 1) - avg(qty) FILTER (week % 2 = 0), 5) AS diff FROM panel GROUP BY team"))
def a20_f21_pivot_diff(spark, sf_dir):
    rows = order_panel(spark, sf_dir).withColumn("half", scalar.parity("week"))
    return aggs.pivot_diff(rows, ["team"], "half", ("odd", "even"), "qty").select("team", *(F.round(c, 5).alias(c) for c in ("odd", "even", "diff")))


@query(panel_sql("SELECT round(CAST(sum(revenue) FILTER (place <= greatest(1, CAST(floor(n * 10.0 / 100) AS INTEGER))) AS DOUBLE) / CAST(sum(revenue) AS DOUBLE), 6) AS share FROM (SELECT revenue, row_number() OVER (ORDER BY revenue DESC, player_id, season, week) AS place, count(*) OVER () AS n FROM panel)"))
def a22_worst_share(spark, sf_dir):
    return aggs.worst_share(order_panel(spark, sf_dir).withColumn("x", F.col("revenue").cast("double")), "x", 10.0, "player_id").select(r6("share"))


@query(panel_sql("SELECT coalesce(position, 'ALL') AS position, count(*) AS n, CAST(sum(qty) AS BIGINT) AS qty FROM panel GROUP BY ROLLUP (position)"))
def a23_with_total(spark, sf_dir):
    return aggs.with_total(order_panel(spark, sf_dir), "position", {"n": F.count("*"), "qty": F.sum("qty")})


@query(panel_sql("SELECT position, round(100 * sum(qty * disc_amt) FILTER (season < 1998) / nullif(sum(qty) FILTER (season < 1998), 0), 2) AS early_score, round(100 * sum(qty * disc_amt) FILTER (season >= 1998) / nullif(sum(qty) FILTER (season >= 1998), 0), 2) AS late_score FROM panel GROUP BY position"))
def a08_a24_weighted_mean(spark, sf_dir):
    rows = order_panel(spark, sf_dir).withColumn("part", F.when(F.col("season") < 1998, "early").otherwise("late"))
    return aggs.weighted_mean_by(rows, ["position"], "part", ["early", "late"], "qty", "disc_amt").select("position", F.round("early_score", 2).alias("early_score"), F.round("late_score", 2).alias("late_score"))


@query(panel_sql("""SELECT season, round(sum(x), 2) AS x, sum(w)::BIGINT AS w, round(sum(x) / sum(w), 4) AS mean
 FROM (SELECT season, if(returned_qty > 0, returned_qty * n_orders, 0)::DOUBLE AS x, if(returned_qty > 0, n_orders, 0) AS w FROM panel) GROUP BY season"""))
def a24_accumulators(spark, sf_dir):
    """Months without returns do not count in the mean."""
    x, w = aggs.accumulators("x", "n_orders")
    rows = order_panel(spark, sf_dir).withColumn("x", F.nullif("returned_qty", F.lit(0)).cast("double")).select("season", x.alias("x"), w.alias("w"))
    return rows.groupBy("season").agg(F.round(F.sum("x"), 2).alias("x"), F.sum("w").cast("bigint").alias("w"), F.round(F.sum("x") / F.sum("w"), 4).alias("mean"))


@query(panel_sql("SELECT quantile_cont(revenue, 0.5) AS revenue, quantile_cont(qty, 0.5) AS qty FROM panel"))
def a16_medians(spark, sf_dir):
    return aggs.medians(order_panel(spark, sf_dir), ["revenue", "qty"])


@query(panel_sql("SELECT player_id, season, week, CASE WHEN disc_amt <= qty AND disc_amt <= returned_qty THEN 'disc' WHEN qty <= returned_qty THEN 'qty' ELSE 'returned' END AS best FROM panel"))
def a26_best_of(spark, sf_dir):
    return order_panel(spark, sf_dir).select(*E, *G, aggs.best_of({"disc": "disc_amt", "qty": "qty", "returned": "returned_qty"}).alias("best"))


@query(panel_sql("""SELECT player_id, season, len(w) AS n, len(list_distinct(w)) AS "distinct", list_min(w) AS low, list_max(w) AS high FROM (SELECT player_id, season, list(week) AS w FROM panel GROUP BY player_id, season)
 WHERE NOT (list_min(w) = 1 AND list_max(w) = len(list_distinct(w)) AND len(w) = len(list_distinct(w)))"""))
def a25_contiguity(spark, sf_dir):
    """Seasons in which a customer did not order in each of the first months: here gaps are expected."""
    return aggs.contiguity(order_panel(spark, sf_dir), ["player_id", "season"], "week")


# ---- windows -----------------------------------------------------------------------------------------------------


@query("""SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey) AS n FROM orders) WHERE n = 1""")
def w01_dedupe_ladder(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return windows.dedupe(rows, ["o_custkey"], [windows.ladder("o_orderpriority", ["1-URGENT", "2-HIGH"]), F.col("o_orderkey")])


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS n FROM orders) WHERE n = 1")
def w02_dedupe_max(spark, sf_dir):
    return windows.dedupe_max(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_orderdate = m")
def w03_s02_keep_max(spark, sf_dir):
    """All rows of the newest version of each partition."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return snapshots.latest_version(rows, "o_orderdate", ["o_custkey"]).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM orders SEMI JOIN (SELECT o_custkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY o_custkey) USING (o_custkey, o_totalprice)")
def w03_keep_max(spark, sf_dir):
    return windows.keep_max(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice").select("o_custkey", "o_orderkey")


@query(panel_sql("""SELECT player_id, season, week, CAST(sum(coalesce(revenue, 0)) OVER w AS BIGINT) AS cum_revenue, last_value(nullif(returned_qty, 0) IGNORE NULLS) OVER w AS last_return, count(nullif(returned_qty, 0)) OVER w AS returns, row_number() OVER w - 1 AS seen
 FROM panel WINDOW w AS (PARTITION BY player_id ORDER BY season, week ROWS UNBOUNDED PRECEDING)"""))
def w04_w06_w21_running(spark, sf_dir):
    rows = order_panel(spark, sf_dir).withColumn("last_return", F.nullif("returned_qty", F.lit(0)))
    rows = windows.running_count(windows.running_sum(rows, E, G, ["revenue"]), E, G, "last_return", "returns")
    return windows.cumcount(windows.carry_forward(rows, E, G, ["last_return"]), E, G, "seen").select(*E, *G, "cum_revenue", "last_return", "returns", "seen")


@query(panel_sql("SELECT player_id, season, week, round(CASE WHEN count(*) OVER p = 1 THEN 0.5 ELSE percent_rank() OVER (PARTITION BY season, week, position ORDER BY -disc_amt) END, 6) AS percentile FROM panel WINDOW p AS (PARTITION BY season, week, position)"))
def w07_percentile(spark, sf_dir):
    return windows.percentile_score(order_panel(spark, sf_dir), [*G, "position"], "disc_amt", F.lit(True)).select(*E, *G, r6("percentile"))


@query(panel_sql("SELECT player_id, season, week, CASE WHEN n_orders > 1 THEN row_number() OVER (PARTITION BY season, week, n_orders > 1 ORDER BY revenue DESC, player_id) END AS rank FROM panel"))
def w08_rank_rows(spark, sf_dir):
    rows = order_panel(spark, sf_dir).withColumn("busy", F.col("n_orders") > 1)
    return windows.rank_rows(rows, G, [F.col("revenue").desc(), F.col("player_id")], "busy").select(*E, *G, "rank")


@query(panel_sql("SELECT player_id, season, week, min(week) OVER s AS first, CAST(sum(qty) OVER s AS BIGINT) AS total, round(avg(qty) OVER s, 6) AS mean FROM panel WINDOW s AS (PARTITION BY player_id, season)"))
def w09_w10_w24_over_group(spark, sf_dir):
    p, k = order_panel(spark, sf_dir), ["player_id", "season"]
    rows = windows.over_group(windows.over_group(windows.over_group(p, k, "min", "week", "first"), k, "sum", "qty", "total"), k, "avg", "qty", "mean")
    return rows.select(*E, *G, "first", "total", r6("mean"))


@query(panel_sql("SELECT p.player_id, p.season, p.week, CAST(n AS INTEGER) AS positions FROM panel p JOIN (SELECT team, season, count(DISTINCT position) AS n FROM panel GROUP BY ALL) USING (team, season)"))
def w11_n_distinct_over(spark, sf_dir):
    return windows.n_distinct_over(order_panel(spark, sf_dir), ["team", "season"], "position", "positions").select(*E, *G, "positions")


@query(panel_sql("SELECT player_id, season, week, " + ", ".join(f"round(avg(qty) OVER (PARTITION BY player_id ORDER BY season, week ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 6) AS mean{n}" for n in (3, 5, 8, 10)) + """,
 round(avg(qty) OVER a, 6) AS mean_all, round(stddev_samp(qty) OVER (PARTITION BY player_id ORDER BY season, week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 5) AS sd8, count(*) OVER a AS prior,
 round(avg(qty) OVER (PARTITION BY player_id, season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS season_mean
 FROM panel WINDOW a AS (PARTITION BY player_id ORDER BY season, week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""))
def w12_w15_trailing(spark, sf_dir):
    specs = {f"mean{n}": ("avg", "qty", n) for n in (3, 5, 8, 10)} | {"mean_all": ("avg", "qty", None), "sd8": ("stddev_samp", "qty", 8), "prior": ("count", "qty", None)}
    rows = windows.trailing(order_panel(spark, sf_dir), E, G, specs)
    rows = windows.trailing(rows, ["player_id", "season"], ["week"], {"season_mean": ("avg", "qty", None)})
    return rows.select(*E, *G, *(r6(f"mean{n}") for n in (3, 5, 8, 10)), r6("mean_all"), F.round("sd8", 5).alias("sd8"), "prior", r6("season_mean"))


@query(panel_sql("SELECT player_id, season, week, round(CASE WHEN count(qty) OVER w >= 2 THEN avg(qty) OVER w END, 6) AS m FROM panel WINDOW w AS (PARTITION BY player_id ORDER BY season, week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)"))
def w18_w20_trailing_min(spark, sf_dir):
    return windows.trailing_min(order_panel(spark, sf_dir), E, G, "qty", 4, 2, "m").select(*E, *G, r6("m"))


@query(panel_sql("""SELECT a.player_id, a.season, a.week, round(CASE WHEN count(b.n) >= 2 THEN sum(b.qty * pow(0.7, a.n - 1 - b.n)) / sum(pow(0.7, a.n - 1 - b.n)) END, 5) AS ewm
 FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season, week) AS n FROM panel) a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season, week) AS n FROM panel) b ON a.player_id = b.player_id AND b.n < a.n GROUP BY ALL"""))
def w19_ewm(spark, sf_dir):
    return windows.ewm(order_panel(spark, sf_dir).withColumn("x", F.col("qty").cast("double")), E, G, "x", 0.3, 2, "ewm").select(*E, *G, F.round("ewm", 5).alias("ewm"))


@query("SELECT o_orderkey, coalesce(lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) <> o_orderpriority, false) AS moved FROM orders")
def w22_changed(spark, sf_dir):
    return windows.changed(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderpriority", "moved").select("o_orderkey", "moved")


@query(panel_sql("SELECT player_id, season, week, ntile(10) OVER (PARTITION BY season, week ORDER BY revenue, player_id) AS decile FROM panel"))
def w23_deciles(spark, sf_dir):
    return windows.deciles(order_panel(spark, sf_dir), G, ["revenue", "player_id"]).select(*E, *G, "decile")


# ---- order and top-k ---------------------------------------------------------------------------------------------


@query(panel_sql("SELECT player_id, season, week, revenue FROM panel ORDER BY revenue DESC, player_id, season, week LIMIT 25"))
def o04_o05_largest(spark, sf_dir):
    return windows.largest(order_panel(spark, sf_dir), "revenue", 25, [*E, *G]).select(*E, *G, "revenue")


@query(panel_sql("""SELECT team, week, x, row_number() OVER (ORDER BY x DESC NULLS LAST, team || '/' || week) AS shown, row_number() OVER (ORDER BY x NULLS LAST, team || '/' || week) AS placed
 FROM (SELECT team, week, nullif(sum(returned_qty), 0)::BIGINT AS x FROM panel GROUP BY team, week)"""))
def o01_o02_o05_orders(spark, sf_dir):
    """The places that rows have when they are sorted for display, either way; nulls last in both."""
    rows = order_panel(spark, sf_dir).groupBy("team", "week").agg(F.nullif(F.sum("returned_qty"), F.lit(0)).alias("x")).withColumn("tie", F.concat_ws("/", "team", "week"))
    down = windows.total_order(windows.sort_rows(rows, "x", True, "tie"), [F.col("x").desc_nulls_last(), F.col("tie")], "shown")
    up = windows.total_order(windows.display_order(rows, "x", "tie"), [F.col("x").asc_nulls_last(), F.col("tie")], "placed")
    return down.join(up.select("team", "week", "placed"), ["team", "week"]).select("team", "week", "x", "shown", "placed")


@query(panel_sql("""WITH t AS (SELECT team, CAST(sum(revenue) AS BIGINT) AS x FROM panel GROUP BY team) SELECT team, x, 'high' AS "end" FROM (SELECT * FROM t ORDER BY x DESC, team LIMIT 3) UNION ALL SELECT team, x, 'low' FROM (SELECT * FROM t ORDER BY x, team LIMIT 3)""").replace("\nWITH t AS", ",\nt AS", 1))
def o08_extremes(spark, sf_dir):
    return windows.extremes(order_panel(spark, sf_dir).groupBy("team").agg(F.sum("revenue").alias("x")), "x", 3, "team")


@query("""SELECT p_partkey, p_name, CASE WHEN len(list_filter(string_split(lower(p_name), ' '), lambda x: x LIKE 'ring%')) > 0 THEN 0 ELSE 1 END AS match FROM part
 WHERE lower(p_name) LIKE '%ring%' OR lower(p_brand) = 'ring' ORDER BY match, p_name, p_partkey LIMIT 8""")
def o07_ranked_search(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit("\x00"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("name"), "p_brand", "p_name")
    return windows.ranked_search(rows, "Ring", "name", "p_brand").select("p_partkey", "p_name", "match")


@query(panel_sql("SELECT count(*) FILTER (place <= n - CAST(floor(n * 0.2) AS BIGINT)) AS train, count(*) FILTER (place > n - CAST(floor(n * 0.2) AS BIGINT)) AS held, CAST(sum(CASE WHEN place > n - CAST(floor(n * 0.2) AS BIGINT) THEN revenue ELSE 0 END) AS BIGINT) AS held_revenue FROM (SELECT *, row_number() OVER (ORDER BY season, week, player_id) AS place, count(*) OVER () AS n FROM panel)"))
def o06_chrono_split(spark, sf_dir):
    train, held = windows.chrono_split(order_panel(spark, sf_dir), ["season", "week", "player_id"])
    return train.agg(F.count("*").alias("train")).crossJoin(held.agg(F.count("*").alias("held"), F.sum("revenue").alias("held_revenue")))


# ---- scalar functions --------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CAST(CASE WHEN month(o_orderdate) >= 3 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS INTEGER) AS season, round(o_totalprice / nullif(o_custkey % 4, 0), 4) AS ratio, CASE WHEN o_custkey % 4 > 1 THEN round(o_totalprice / (o_custkey % 4), 4) END AS positive,
 CASE o_orderpriority WHEN '1-URGENT' THEN 0.0 WHEN '2-HIGH' THEN 1.0 END AS urgency, lower(o_orderpriority) LIKE '%high%' AS high, o_orderstatus IS DISTINCT FROM 'F' AS not_f, o_orderstatus AS status FROM orders""")
def f05_f18_scalars(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey") % 4)
    return o.select(
        "o_orderkey", scalar.season_of("o_orderdate").alias("season"), F.round(scalar.safe_ratio("o_totalprice", "k"), 4).alias("ratio"), F.round(scalar.positive_ratio("o_totalprice", F.when(F.col("k") > 1, F.col("k")).otherwise(0)), 4).alias("positive"),
        scalar.ordinal("o_orderpriority", ["1-URGENT", "2-HIGH"]).alias("urgency"), scalar.contains_flag("o_orderpriority", "HIGH").alias("high"), scalar.is_distinct("o_orderstatus", F.lit("F")).alias("not_f"), F.upper(scalar.clean_category("o_orderstatus")).alias("status"),
    )


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CASE WHEN value > 0 AND value <= 10 THEN 'low' WHEN value > 10 AND value <= 50 THEN 'mid' WHEN value > 50 AND value <= 1000 THEN 'high' END AS bin, round(value, 1) AS shown, greatest(least(value, 20.0), 0) AS lo, greatest(value, 20.0) AS hi FROM events")
def f19_f24_documents(spark, sf_dir):
    low, high = scalar.order_bounds("value", F.lit(20.0))
    return table(spark, sf_dir, "events").select("event_id", scalar.from_doc("props", "k int")["k"].alias("k"), scalar.bin_right("value", (0, 10, 50, 1000), ("low", "mid", "high")).alias("bin"), scalar.json_number("value", 1).alias("shown"), low.alias("lo"), high.alias("hi"))


@query(r"""SELECT doc_id, count(*) AS sentences, CAST(sum(length(s)) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(string_split(text, '.')) AS s FROM documents) WHERE s <> '' GROUP BY doc_id""")
def f02_explode_list(spark, sf_dir):
    rows = scalar.explode_list(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ".", "s")
    return rows.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.length("s")).alias("chars"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + INTERVAL 13 HOUR + INTERVAL 5 MINUTE END AS starts_at,
 CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + INTERVAL 23 HOUR + INTERVAL 59 MINUTE ELSE CAST(o_orderdate AS DATE) + INTERVAL 13 HOUR + INTERVAL 5 MINUTE END + INTERVAL 5 HOUR AS utc FROM orders""")
def f03_f04_f14_times(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.when(F.col("o_orderkey") % 3 == 0, "soon").otherwise("13:05").alias("time"))
    starts = scalar.parse_local_ts("day", "time")
    return o.select("o_orderkey", starts.alias("starts_at"), scalar.to_utc(starts, scalar.to_date_or_null("day"), 5, "23:59").alias("utc"))


@query(panel_sql("SELECT player_id, season, week, CASE WHEN week % 2 = 0 THEN revenue ELSE qty END AS side, CASE WHEN position IN ('BUILDING') THEN 0 ELSE qty END AS wind, CASE position WHEN 'BUILDING' THEN qty WHEN 'MACHINERY' THEN n_orders END AS role, revenue / 2 + qty / 2 AS implied FROM panel"))
def f07_f12_f13_switches(spark, sf_dir):
    p = order_panel(spark, sf_dir)
    return p.select(*E, *G, scalar.perspective(F.col("week") % 2 == 0, "revenue", "qty").alias("side"), scalar.override_when(F.col("position").isin("BUILDING"), "qty", 0).alias("wind"), scalar.switch("position", {"BUILDING": F.col("qty"), "MACHINERY": F.col("n_orders")}).alias("role"), scalar.implied_total("revenue", "qty").alias("implied"))


# ---- checks ------------------------------------------------------------------------------------------------------


@query("""SELECT 'unique' AS name, (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS n UNION ALL SELECT 'not_null', (SELECT count(*) FROM orders WHERE o_custkey IS NULL)
 UNION ALL SELECT 'accepted', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')) UNION ALL SELECT 'orphans', (SELECT count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0))
 UNION ALL SELECT 'combination', (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)) UNION ALL SELECT 'expression', (SELECT count(*) FROM lineitem WHERE NOT l_quantity > 5 AND l_discount < 0.05) UNION ALL SELECT 'not_empty', 0""")
def q01_q07_checks(spark, sf_dir):
    """Failing rows of the generic checks; most are meant to find something."""
    orders, items, people = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    found = [
        checks.Check("unique", checks.unique(orders, "o_custkey")), checks.Check("not_null", checks.not_null(orders, "o_custkey")), checks.Check("accepted", checks.accepted(orders, "o_orderstatus", ["F", "O"])),
        checks.Check("orphans", checks.orphans(orders, "o_custkey", people.where("c_acctbal > 0"), "c_custkey")), checks.Check("combination", checks.unique_combination(items, ["l_orderkey", "l_linenumber"])),
        checks.Check("expression", checks.expression(items, "l_quantity > 5", "l_discount < 0.05")), checks.Check("not_empty", checks.not_empty(orders)),
    ]
    return checks.failures(found).select("name", "n")


@query(panel_sql(""", placed AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season, week) AS place FROM panel)
 SELECT player_id, season, week FROM placed WHERE week = 6 OR (place = 1 AND season = 1995)""").replace("GROUP BY ALL)\n,", "GROUP BY ALL),"))
def q09_no_future(spark, sf_dir):
    """Two planted faults: prior counts that are one too many in June, and a mean where nothing came before in 1995."""
    rows = windows.trailing(windows.prior_count(order_panel(spark, sf_dir), E, G), E, G, {"m3": ("avg", "qty", 3)})
    faulty = rows.withColumn("prior_games", F.col("prior_games") + (F.col("week") == 6).cast("int")).withColumn("m3", F.when(F.col("season") == 1995, F.coalesce("m3", F.lit(1.0))).otherwise(F.col("m3")))
    return checks.no_future(faulty, E, G, "prior_games", ["m3"]).select(*E, *G)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 0 THEN 'undated' ELSE 'no result' END AS reason FROM orders WHERE o_orderkey % 100 = 0 OR (o_orderdate < TIMESTAMP '1996-01-01' - INTERVAL 48 HOUR AND o_orderstatus <> 'F')""")
def q12_stale(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("start", F.when(F.col("o_orderkey") % 100 != 0, F.col("o_orderdate"))).withColumn("done", F.col("o_orderstatus") == "F")
    return checks.stale(o, "start", "done", F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")).select("o_orderkey", "reason")


@query("SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000")
def q14_conforms(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return checks.conforms(rows, rows.schema, {"c_acctbal": (0, 9000)}).select("c_custkey")


@query(panel_sql("SELECT count(*) AS n FROM panel WHERE (revenue > 1000000) <> (season < 1999)"))
def q10_outcome_iff_final(spark, sf_dir):
    rows = order_panel(spark, sf_dir).select(F.when(F.col("revenue") > 1000000, F.col("revenue")).alias("x"), (F.col("season") < 1999).alias("final"))
    return checks.outcome_iff_final(rows, "x", "final").agg(F.count("*").alias("n"))


# ---- sources -----------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 40")
def s05_narrow_scan(spark, sf_dir):
    return snapshots.scan(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"]).where("l_quantity > 40")


@query("SELECT c_mktsegment AS dataset, arg_max(c_name, c_custkey) AS as_of FROM customer GROUP BY 1")
def s08_data_as_of(spark, sf_dir):
    from ..sources.landing import data_as_of

    return data_as_of(table(spark, sf_dir, "customer"), "c_mktsegment", "c_name", "c_custkey").withColumnRenamed("c_mktsegment", "dataset")


@query("SELECT doc_id, source, lang FROM documents UNION ALL SELECT page_id, NULL, NULL FROM pages")
def s01_scan_union(spark, sf_dir):
    """Two files whose columns differ, united by name."""
    docs = snapshots.scan_union(spark, [f"{sf_dir}/documents.parquet"]).select("doc_id", "source", "lang")
    pages = snapshots.scan_union(spark, [f"{sf_dir}/pages.parquet"]).select(F.col("page_id").alias("doc_id"))
    return shape.union_dims(docs, pages)
