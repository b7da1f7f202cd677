"""The order panel: customers by month, from the order tables. Amounts are whole cents, so sums are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins

KEYS = ["player_id", "season", "week"]

PANEL_SQL = """panel AS MATERIALIZED (
 SELECT o_custkey AS player_id, CAST(year(o_orderdate) AS INTEGER) AS season, CAST(month(o_orderdate) AS INTEGER) AS week,
  c_mktsegment AS position, n_name AS team, count(DISTINCT o_orderkey) AS n_orders,
  CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS BIGINT) AS revenue,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
  CAST(sum(CAST(round(l_extendedprice * l_discount * 100) AS BIGINT)) AS BIGINT) AS disc_amt,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS returned_qty
 FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
 GROUP BY ALL)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c) -> "F.Column":
    return F.round(c * 100).cast("bigint")


def order_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """player_id, season, week, position, team, n_orders, revenue, qty, disc_amt, returned_qty.

    Lines are summed per order before they meet customers, so the large join carries five numbers an order. Orders are dealt out
    by customer once; months, customers and windows of a customer over the panel all go by that.
    """
    items = table(spark, sf_dir, "lineitem")
    per_order = items.groupBy("l_orderkey").agg(
        F.sum(cents(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("revenue"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
        F.sum(cents(F.col("l_extendedprice") * F.col("l_discount"))).alias("disc_amt"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("bigint")).otherwise(0)).alias("returned_qty"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("player_id"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"))
    sums = [F.sum(c).alias(c) for c in ("revenue", "qty", "disc_amt", "returned_qty")]
    facts = orders.join(joins.large(per_order), F.col("o_orderkey") == F.col("l_orderkey")).drop("o_orderkey", "l_orderkey").repartition("player_id").groupBy("player_id", "season", "week").agg(F.count("*").alias("n_orders"), *sums)
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    who = people.select(F.col("c_custkey").alias("player_id"), F.col("c_mktsegment").alias("position"), F.col("n_name").alias("team"))
    return facts.join(joins.large(who), "player_id").select("player_id", "season", "week", "position", "team", "n_orders", "revenue", "qty", "disc_amt", "returned_qty")
