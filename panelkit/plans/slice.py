"""The ranking of the order panel, end to end, and the SQL that says the same."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import positive_ratio, safe_ratio
from ..sources.scratch import stored
from . import ranking
from .panel import PANEL_SQL, order_panel

POSITIONS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
STATS = ["n_orders", "revenue", "qty", "disc_amt", "returned_qty"]
#: metric: component, weight, lower is better
WEIGHTS = {"avg_order": ("production", 2.0, False), "revenue_total": ("production", 1.0, False), "return_rate": ("efficiency", 1.0, True), "disc_rate": ("efficiency", 3.0, True)}


def metrics() -> ranking.Metrics:
    return ranking.Metrics({
        "avg_order": safe_ratio("cum_revenue", "cum_n_orders"),
        "revenue_total": F.col("cum_revenue").cast("double"),
        "return_rate": positive_ratio("cum_returned_qty", "cum_qty"),
        "disc_rate": safe_ratio("cum_disc_amt", "cum_revenue"),
    })


def config(spark: SparkSession) -> DataFrame:
    rows = [(p, 0.05 + 0.01 * k, 0.2) for k, p in enumerate(POSITIONS)]
    return spark.createDataFrame(rows, "position string, min_role double, efficiency_share double")


def weights(spark: SparkSession) -> DataFrame:
    rows = [(p, m, c, w, low) for p in POSITIONS for m, (c, w, low) in WEIGHTS.items()]
    return spark.createDataFrame(rows, "position string, metric string, component string, weight double, lower_is_better boolean")


CONFIG_SQL = "config AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', CAST({0.05 + 0.01 * k!r} AS DOUBLE), CAST(0.2 AS DOUBLE))" for k, p in enumerate(POSITIONS)) + ") v(position, min_role, efficiency_share))"
WEIGHTS_SQL = "weights AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{m}', '{c}', CAST({w} AS DOUBLE), {str(low).lower()})" for p in POSITIONS for m, (c, w, low) in WEIGHTS.items()) + ") v(position, metric, component, weight, lower_is_better))"

# The check SQL states each stage by its rule, in other terms than the plans: totals by joining all earlier rows, percentiles
# from counts of smaller values, ranks as places in a sorted list.

SPINE_SQL = """calendar AS (SELECT season, list(DISTINCT week) AS weeks FROM panel GROUP BY season),
spine AS (SELECT player_id, season, unnest(list_filter(weeks, lambda w: w >= since)) AS week
 FROM calendar JOIN (SELECT player_id, season, min(week) AS since FROM panel GROUP BY player_id, season) USING (season))"""
CUM_SQL = """cum AS MATERIALIZED (
 SELECT here.player_id, here.season, here.week, arg_max(was.position, was.week) AS position, arg_max(was.team, was.week) AS team, count(*) AS games, max(was.week) = here.week AS active,
  """ + ", ".join(f"CAST(sum(was.{c}) AS BIGINT) AS cum_{c}" for c in STATS) + """
 FROM spine here JOIN panel was ON was.player_id = here.player_id AND was.season = here.season AND was.week <= here.week
 GROUP BY here.player_id, here.season, here.week)"""
METRICS_SQL = """schedule AS (SELECT team, season, list(DISTINCT week) AS played FROM panel GROUP BY team, season),
counted AS (SELECT cum.*, coalesce(len(list_filter(played, lambda w: w <= cum.week)), 0) AS team_games FROM cum LEFT JOIN schedule USING (team, season)),
metrics AS MATERIALIZED (SELECT counted.*, efficiency_share, cum_n_orders >= min_role * (CASE WHEN team_games < 1 THEN 1 ELSE team_games END) AS is_qualified,
  cum_revenue / nullif(cum_n_orders, 0) AS avg_order, cum_revenue::DOUBLE AS revenue_total,
  CASE WHEN cum_qty > 0 THEN cum_returned_qty / cum_qty END AS return_rate, cum_disc_amt / nullif(cum_revenue, 0) AS disc_rate
 FROM counted JOIN config ON config.position = counted.position)"""
PERCENTILES_SQL = """told AS (SELECT player_id, season, week, position, unnest([{'metric': 'avg_order', 'x': avg_order}, {'metric': 'revenue_total', 'x': revenue_total},
   {'metric': 'return_rate', 'x': return_rate}, {'metric': 'disc_rate', 'x': disc_rate}], recursive := true) FROM metrics WHERE is_qualified),
valued AS (SELECT told.*, component, weight, lower_is_better, x * (CASE WHEN lower_is_better THEN -1 ELSE 1 END) AS good FROM told JOIN weights USING (position, metric) WHERE x IS NOT NULL),
tally AS (SELECT season, week, position, metric, good, count(*) AS alike FROM valued GROUP BY season, week, position, metric, good),
beaten AS (SELECT *, sum(alike) OVER up - alike AS smaller, sum(alike) OVER pool AS pool FROM tally
 WINDOW up AS (PARTITION BY season, week, position, metric ORDER BY good), pool AS (PARTITION BY season, week, position, metric)),
percentiles AS MATERIALIZED (SELECT v.player_id, v.season, v.week, v.position, v.metric, v.x AS metric_value, component, weight, lower_is_better, if(pool > 1, smaller / (pool - 1), 0.5) AS percentile
 FROM valued v JOIN beaten b ON b.season = v.season AND b.week = v.week AND b.position = v.position AND b.metric = v.metric AND b.good = v.good)"""
SCORES_SQL = """means AS (SELECT player_id, season, week, component, 100 * sum(weight * percentile) / nullif(sum(weight), 0) AS mean FROM percentiles GROUP BY player_id, season, week, component),
sides AS (PIVOT means ON component IN ('efficiency', 'production') USING first(mean) AS mean GROUP BY player_id, season, week),
scores AS (SELECT metrics.*, round(efficiency_mean, 6) AS efficiency_score, round(production_mean, 6) AS production_score, round(CASE WHEN production_mean IS NULL THEN efficiency_mean
   WHEN efficiency_mean IS NULL THEN production_mean ELSE production_mean + efficiency_share * (efficiency_mean - production_mean) END, 6) AS composite_score
 FROM metrics LEFT JOIN sides USING (player_id, season, week))"""
RANKS_SQL = """best AS (SELECT season, week, position, list(player_id ORDER BY composite_score DESC NULLS LAST, cum_revenue DESC, games DESC, player_id) FILTER (is_qualified) AS qualified,
  list(player_id ORDER BY cum_revenue DESC, games DESC, player_id) AS everyone FROM scores GROUP BY season, week, position),
placed AS (SELECT season, week, position, unnest(qualified) AS player_id, generate_subscripts(qualified, 1) AS rank FROM best),
earning AS (SELECT season, week, position, unnest(everyone) AS player_id, generate_subscripts(everyone, 1) AS fantasy_rank FROM best),
placings AS (SELECT * FROM scores LEFT JOIN placed USING (season, week, position, player_id) JOIN earning USING (season, week, position, player_id)),
opened AS (SELECT season, min(week) AS opening FROM panel GROUP BY season),
settled AS (SELECT year(o_orderdate)::INTEGER AS season, month(o_orderdate)::INTEGER AS week, count(*) = count(*) FILTER (o_orderdate < DATE '2001-01-01') AS done FROM orders GROUP BY 1, 2),
ranks AS (SELECT now.*, was.rank AS prev_rank, was.rank - now.rank AS movement, now.rank IS NOT NULL AND was.rank IS NULL AND now.week > opening AS is_new,
  was.fantasy_rank AS prev_fantasy_rank, was.fantasy_rank - now.fantasy_rank AS fantasy_movement, was.fantasy_rank IS NULL AND now.week > opening AS fantasy_is_new, done IS TRUE AS week_complete
 FROM placings now JOIN opened ON opened.season = now.season LEFT JOIN settled ON settled.season = now.season AND settled.week = now.week
 LEFT JOIN placings was ON was.player_id = now.player_id AND was.position = now.position AND was.season = now.season AND was.week + 1 = now.week)"""


def with_sql(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


UP_TO = {
    "panel": [PANEL_SQL], "spine": [PANEL_SQL, SPINE_SQL], "cum": [PANEL_SQL, SPINE_SQL, CUM_SQL],
    "metrics": [PANEL_SQL, SPINE_SQL, CUM_SQL, CONFIG_SQL, METRICS_SQL],
    "percentiles": [PANEL_SQL, SPINE_SQL, CUM_SQL, CONFIG_SQL, METRICS_SQL, WEIGHTS_SQL, PERCENTILES_SQL],
    "scores": [PANEL_SQL, SPINE_SQL, CUM_SQL, CONFIG_SQL, METRICS_SQL, WEIGHTS_SQL, PERCENTILES_SQL, SCORES_SQL],
    "ranks": [PANEL_SQL, SPINE_SQL, CUM_SQL, CONFIG_SQL, METRICS_SQL, WEIGHTS_SQL, PERCENTILES_SQL, SCORES_SQL, RANKS_SQL],
}


def sql(stage: str, select: str) -> str:
    """The SQL of everything up to a stage, and a query on it."""
    return with_sql(*UP_TO[stage], select=select)


class Slice:
    """The stages as frames, each built from the one before. What several later stages read is written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.config, self.weights = config(spark), weights(spark)

    @cached_property
    def marks(self) -> DataFrame:
        """The panel with running totals, as all later stages read it."""
        return stored(ranking.cumulative_marks(order_panel(self.spark, self.sf_dir), STATS), "marks")

    @cached_property
    def panel(self) -> DataFrame:
        return self.marks.select("player_id", "season", "week", "position", "team", *STATS)

    @cached_property
    def finished(self) -> DataFrame:
        return self.panel.select("team", "season", "week").distinct()

    @cached_property
    def settled(self) -> DataFrame:
        """Whether each order of a month is final: those before 2001 are."""
        orders = self.spark.read.parquet(f"{self.sf_dir}/orders.parquet")
        return orders.select(F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"), (F.year("o_orderdate") < 2001).alias("is_final"))

    @cached_property
    def cum(self) -> DataFrame:
        return ranking.spread_marks(self.marks)

    @cached_property
    def metrics(self) -> DataFrame:
        """Also has `ahead`: whether the customer orders in the month after."""
        return ranking.rank_metrics(ranking.spread_marks(self.marks, ahead="ahead"), self.finished, self.config, metrics(), "cum_n_orders")

    @cached_property
    def told(self) -> DataFrame:
        return ranking.with_percentiles(self.metrics, self.weights, list(WEIGHTS))

    @cached_property
    def percentiles(self) -> DataFrame:
        return ranking.rank_percentiles(self.told, list(WEIGHTS))

    @cached_property
    def scores(self) -> DataFrame:
        return ranking.rank_scores(self.told, self.config, list(WEIGHTS))

    @cached_property
    def ranks(self) -> DataFrame:
        return ranking.rankings(self.scores, points="cum_revenue", finished=self.settled, opening=self.panel)

    @cached_property
    def breakdown(self) -> DataFrame:
        return ranking.breakdown(self.told, self.config, list(WEIGHTS))
