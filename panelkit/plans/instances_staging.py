"""Queries of the staging functions, usage enrichment and stores, over the given tables in the shape of raw files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks, joins, shape
from ..sources import landing, sinks, snapshots
from ..sources.scratch import scratch_path, stored
from . import ranking
from .instances_core import E, G, panel_sql
from .panel import order_panel, table
from .registry import query

CODES_SQL = "(VALUES ('BUILDING', 'HOUSE'), ('1-URGENT', 'URGENT'), ('O', 'OPEN'), ('R', 'BACK'))"
GROUPS_SQL = "(VALUES ('HOUSE', 'home'), ('BUILDING', 'home'), ('MACHINERY', 'plant'))"


def codes(spark) -> DataFrame:
    return spark.createDataFrame([("BUILDING", "HOUSE"), ("1-URGENT", "URGENT"), ("O", "OPEN"), ("R", "BACK")], "raw string, standard string")


def groups(spark) -> DataFrame:
    return spark.createDataFrame([("HOUSE", "home"), ("BUILDING", "home"), ("MACHINERY", "plant")], "position string, position_group string")


def dated(df: DataFrame, c: str) -> DataFrame:
    return df.withColumns({"season": F.year(c), "week": F.month(c)})


# ---- staging -----------------------------------------------------------------------------------------------------


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS game_id, year(o_orderdate) AS season, month(o_orderdate) AS week,
 CASE WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS game_date,
 CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 13:05:00' END AS starts_at,
 coalesce(h.s, o_orderpriority) AS home, coalesce(a.s, o_orderstatus) AS away, CASE WHEN o_orderstatus <> 'O' THEN o_orderkey % 40 END AS home_score, o_custkey % 40 AS away_score,
 CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS overtime, o_custkey % 2 = 1 AS division_game, o_orderstatus <> 'O' AS is_final
 FROM orders LEFT JOIN {CODES_SQL} h(r, s) ON h.r = o_orderpriority LEFT JOIN {CODES_SQL} a(r, s) ON a.r = o_orderstatus WHERE o_orderkey % 13 <> 0""")
def r12_stage_games(spark, sf_dir):
    """Orders as a schedule: some without an id, with a day or time that is none, or without a score yet."""
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = dated(table(spark, sf_dir, "orders"), "o_orderdate").select(
        F.when(key % 13 != 0, key.cast("string")).alias("game_id"), "season", "week", F.when(key % 11 == 0, "soon").otherwise(day).alias("gameday"),
        F.when(key % 7 != 0, "13:05").alias("gametime"), F.col("o_orderpriority").alias("home_team"), F.col("o_orderstatus").alias("away_team"),
        F.when(F.col("o_orderstatus") != "O", key % 40).alias("home_score"), (F.col("o_custkey") % 40).alias("away_score"),
        F.when(key % 3 == 0, 1).when(key % 3 == 1, 0).alias("overtime"), (F.col("o_custkey") % 2).alias("div_game"),
    )
    games = ranking.stage_games(raw, codes(spark))
    return games.withColumns({c: F.col(c).cast("string") for c in ("game_date", "starts_at")})


@query(f"""SELECT c_custkey AS player_id, c_name AS name, CASE WHEN c_custkey % 40 BETWEEN 1 AND 31 THEN '1990-01-' || lpad(CAST(c_custkey % 40 AS VARCHAR), 2, '0') END AS birth_date,
 c_mktsegment AS position, grp AS position_group, coalesce(s, c_mktsegment) AS team, 'P' || c_custkey AS other_id
 FROM customer LEFT JOIN {CODES_SQL} c(r, s) ON r = c_mktsegment LEFT JOIN {GROUPS_SQL} g(p, grp) ON p = c_mktsegment WHERE c_custkey % 17 <> 0""")
def r13_stage_players(spark, sf_dir):
    """Customers as players: some without an id, some born on a day that no month has."""
    key = F.col("c_custkey")
    raw = table(spark, sf_dir, "customer").select(
        F.when(key % 17 != 0, key).alias("gsis_id"), F.col("c_name").alias("display_name"), F.concat(F.lit("1990-01-"), F.lpad((key % 40).cast("string"), 2, "0")).alias("birth_date"),
        F.col("c_mktsegment").alias("position"), F.col("c_mktsegment").alias("latest_team"), F.concat(F.lit("P"), key).alias("pfr_id"),
    )
    return ranking.stage_players(raw, codes(spark), groups(spark)).withColumn("birth_date", F.col("birth_date").cast("string"))


@query(panel_sql(f"""SELECT player_id, season, week, team, coalesce(s, position) AS opponent_team, position, grp AS position_group, qty
 FROM panel LEFT JOIN {CODES_SQL} c(r, s) ON r = position LEFT JOIN {GROUPS_SQL} g(p, grp) ON p = position WHERE player_id % 19 <> 0"""))
def r13_stage_stats(spark, sf_dir):
    """The panel as weekly figures with columns to drop and a group of its own that is replaced."""
    p = order_panel(spark, sf_dir).withColumn("player_id", F.when(F.col("player_id") % 19 != 0, F.col("player_id")))
    raw = p.select("player_id", "season", "week", "team", F.col("position").alias("opponent_team"), "position", F.lit("?").alias("position_group"), "qty", "revenue")
    return ranking.stage_stats(raw, codes(spark), groups(spark), ["revenue"])


@query(f"""SELECT o_custkey AS player_id, year(o_orderdate) AS season, month(o_orderdate) AS week, coalesce(s, o_orderpriority) AS team, o_orderstatus AS position,
 CASE o_orderstatus WHEN 'F' THEN 'ACT' WHEN 'O' THEN 'RES' END AS status, o_orderstatus = 'F' AS is_active
 FROM orders LEFT JOIN {CODES_SQL} c(r, s) ON r = o_orderpriority WHERE o_custkey % 17 <> 0""")
def r14_stage_rosters(spark, sf_dir):
    """Orders as rosters; who has no status is not active."""
    raw = dated(table(spark, sf_dir, "orders"), "o_orderdate").select(
        F.when(F.col("o_custkey") % 17 != 0, F.col("o_custkey")).alias("gsis_id"), "season", "week", F.col("o_orderpriority").alias("team"), F.col("o_orderstatus").alias("position"),
        F.when(F.col("o_orderstatus") == "F", "ACT").when(F.col("o_orderstatus") == "O", "RES").alias("status"),
    )
    return ranking.stage_rosters(raw, codes(spark))


@query(f"""SELECT l_suppkey AS other_id, l_orderkey AS game_id, year(l_shipdate) AS season, month(l_shipdate) AS week, coalesce(s, l_returnflag) AS team, l_quantity AS snaps, l_discount AS snap_pct
 FROM lineitem LEFT JOIN {CODES_SQL} c(r, s) ON r = l_returnflag WHERE l_suppkey % 7 <> 0""")
def r14_stage_snaps(spark, sf_dir):
    raw = dated(table(spark, sf_dir, "lineitem"), "l_shipdate").select(
        F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey")).alias("pfr_player_id"), F.col("l_orderkey").alias("game_id"), "season", "week",
        F.col("l_returnflag").alias("team"), F.col("l_quantity").alias("offense_snaps"), F.col("l_discount").alias("offense_pct"),
    )
    return ranking.stage_snaps(raw, codes(spark))


def listed_plays(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Lines as plays, those of one order and number as one: who is on them is a list of the order's customer, the supplier
    and the part; some have none."""
    last = [F.max(c).alias(c) for c in ("l_returnflag", "l_quantity", "l_linestatus", "l_suppkey", "l_partkey")]
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*last).join(joins.large(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")), "l_orderkey")
    rows = dated(lines, "o_orderdate").select(F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("play_id"), "season", "week", "l_returnflag", "l_quantity", "l_linestatus", "o_custkey", "l_suppkey", "l_partkey")
    rows = stored(rows, "lines")  # both files are made from it
    listed = F.concat_ws(";", F.col("o_custkey"), F.col("l_suppkey"), F.lit(""), F.col("l_partkey"))
    raw = rows.select("game_id", "play_id", F.when(F.col("play_id") % 5 == 0, F.lit("")).when(F.col("play_id") % 7 != 0, listed).alias("offense_players"))
    plays = rows.select("game_id", "play_id", "season", "week", F.when(F.col("play_id") % 6 != 0, F.col("l_linestatus")).alias("team"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "R").alias("dropback"), "l_quantity", (F.col("l_quantity") > 25).alias("motion"))
    return raw, plays


LISTED_SQL = """plays AS MATERIALIZED (SELECT l_orderkey AS game_id, l_linenumber AS play_id, year(o_orderdate) AS season, month(o_orderdate) AS week, CASE WHEN l_linenumber % 6 <> 0 THEN l_linestatus END AS team,
  l_returnflag = 'R' AS dropback, l_quantity, o_custkey, l_suppkey, l_partkey
  FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag, max(l_quantity) AS l_quantity, max(l_linestatus) AS l_linestatus, max(l_suppkey) AS l_suppkey, max(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL) JOIN orders ON o_orderkey = l_orderkey),
listed AS (SELECT plays.*, CAST(who AS VARCHAR) AS player_id FROM plays, (VALUES (1), (2), (3)) k(i), LATERAL (SELECT CASE i WHEN 1 THEN o_custkey WHEN 2 THEN l_suppkey ELSE l_partkey END AS who) WHERE play_id % 5 <> 0 AND play_id % 7 <> 0)"""


@query(f"WITH {LISTED_SQL} SELECT game_id, play_id, player_id, dropback FROM listed")
def r15_stage_participation(spark, sf_dir):
    raw, plays = listed_plays(spark, sf_dir)
    return ranking.stage_participation(raw, plays).select("game_id", "play_id", "player_id", "dropback")


def three_files(spark, sf_dir, player: str) -> list[DataFrame]:
    """Lines by supplier and month, a file a return flag."""
    lines = dated(table(spark, sf_dir, "lineitem"), "l_shipdate")
    sums = lines.groupBy("season", "week", F.col("l_suppkey").alias(player), "l_returnflag").agg(F.max("l_linestatus").alias("team"), F.sum(F.col("l_quantity").cast("bigint")).alias("x"))
    sums = stored(sums, "files")
    return [sums.where(F.col("l_returnflag") == f).drop("l_returnflag").withColumnRenamed("x", f"x_{f.lower()}") for f in "RAN"]


FILES_SQL = "f AS MATERIALIZED (SELECT year(l_shipdate) AS season, month(l_shipdate) AS week, l_suppkey AS who, l_returnflag AS flag, max(l_linestatus) AS team, CAST(sum(l_quantity) AS BIGINT) AS x FROM lineitem GROUP BY ALL)"
MERGED_SQL = "season, week, who, max(x) FILTER (flag = 'R') AS x_r, max(x) FILTER (flag = 'A') AS x_a, max(x) FILTER (flag = 'N') AS x_n"


@query(f"WITH {FILES_SQL} SELECT {MERGED_SQL.replace('who,', 'who AS pfr_player_id,')}, max(team) FILTER (flag = 'R') AS team FROM f WHERE week <= 9 GROUP BY season, week, who")
def r16_stage_advstats(spark, sf_dir):
    """Three files in one row; the team is the first file's, and late months are no regular season."""
    files = [df.withColumn("game_type", F.when(F.col("week") <= 9, "REG").otherwise("POST")) for df in three_files(spark, sf_dir, "pfr_player_id")]
    return ranking.stage_advstats(*files)


@query(f"WITH {FILES_SQL} SELECT {MERGED_SQL.replace('week, who,', 'week - 1 AS week, who AS player_gsis_id,')} FROM f WHERE week BETWEEN 2 AND 9 GROUP BY season, week, who")
def r17_stage_tracking(spark, sf_dir):
    """Three files in one row; week 0 is a total of the season and goes."""
    files = [df.drop("team").withColumns({"season_type": F.when(F.col("week") <= 9, "REG").otherwise("POST"), "week": F.col("week") - 1}) for df in three_files(spark, sf_dir, "player_gsis_id")]
    return ranking.stage_tracking(*files)


@query("SELECT l_orderkey AS game_id, l_linenumber AS play_id, year(l_shipdate) AS season, month(l_shipdate) AS week, l_discount > 0.05 AS is_motion, l_quantity AS n_rushers, l_linestatus AS qb_location FROM lineitem")
def r18_stage_charting(spark, sf_dir):
    raw = dated(table(spark, sf_dir, "lineitem"), "l_shipdate")
    renamed = {"is_motion": F.col("l_discount") > 0.05, "n_rushers": F.col("l_quantity"), "qb_location": F.col("l_linestatus")}
    return ranking.stage_charting(raw.withColumns(renamed), "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def r18_stage_plays(spark, sf_dir):
    """The filter and three columns reach the scan."""
    raw = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "season_type")
    return ranking.stage_plays(raw, ["l_orderkey", "l_linenumber", "l_quantity"], "R")


@query("""SELECT o_custkey AS player_id, year(o_orderdate) AS season, month(o_orderdate) AS week, arg_min(status, place * 10 + team) AS injury_status, min(place * 10 + team) % 10 || '' AS practice_status
 FROM (SELECT *, CASE o_orderpriority[1] WHEN '1' THEN 'Out' WHEN '2' THEN 'Doubtful' WHEN '3' THEN 'Questionable' ELSE 'Note' END AS status, least(ascii(o_orderpriority) - 49, 3) AS place, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS team FROM orders)
 WHERE o_custkey % 17 <> 0 GROUP BY o_custkey, year(o_orderdate), month(o_orderdate)""")
def r18_stage_injuries(spark, sf_dir):
    """Orders as reports: the most severe of a customer's month, then the first team's."""
    first, status = F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus")
    raw = dated(table(spark, sf_dir, "orders"), "o_orderdate").select(
        F.when(F.col("o_custkey") % 17 != 0, F.col("o_custkey")).alias("gsis_id"), "season", "week", status.alias("team"),
        F.when(first == "1", "Out").when(first == "2", "Doubtful").when(first == "3", "Questionable").otherwise("Note").alias("report_status"),
        F.when(status == "F", "1").when(status == "O", "2").otherwise("3").alias("practice_status"),
    )
    return ranking.stage_injuries(raw)


# ---- usage enrichment --------------------------------------------------------------------------------------------


@query(f"""WITH {LISTED_SQL},
fact AS (SELECT CAST(o_custkey AS VARCHAR) AS player_id, season, week, team, CAST(sum(l_quantity) AS BIGINT) AS targets FROM plays GROUP BY ALL),
own AS (SELECT player_id, season, week, count(*) AS snaps, count(*) FILTER (dropback) AS pass_snaps, avg(l_quantity) AS box FROM listed GROUP BY ALL),
t AS (SELECT season, week, team, count(DISTINCT game_id || ':' || play_id) AS n FROM listed GROUP BY ALL),
style AS (SELECT season, week, team, avg(CAST(l_quantity > 25 AS INTEGER)) AS motion_rate FROM plays WHERE team IS NOT NULL GROUP BY ALL),
late AS (SELECT player_id, season, week, sum(targets) AS more FROM fact WHERE week > 6 GROUP BY ALL)
SELECT f.player_id, f.season, f.week, f.team, targets, snaps, pass_snaps, round(box, 6) AS avg_l_quantity, round(snaps / nullif(n, 0), 6) AS snap_share, round(targets / nullif(pass_snaps, 0), 6) AS target_per_pass_snap, round(motion_rate, 6) AS motion_rate, CAST(more AS BIGINT) AS more
FROM fact f LEFT JOIN own o USING (player_id, season, week) LEFT JOIN t ON t.season = f.season AND t.week = f.week AND t.team = f.team LEFT JOIN style s ON s.season = f.season AND s.week = f.week AND s.team = f.team LEFT JOIN late l ON l.player_id = f.player_id AND l.season = f.season AND l.week = f.week""")
def r02_panel_advanced(spark, sf_dir):
    """Who was on which line, of all lines of the team; figures by line with a return; how the team plays."""
    raw, plays = listed_plays(spark, sf_dir)
    who = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("game_id"), F.col("o_custkey").cast("string").alias("player_id"))
    fact = stored(plays.join(joins.large(who), "game_id").groupBy(*E, *G, "team").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("targets")), "fact")
    on_play = ranking.stage_participation(raw, plays, carry=[*G, "team", "l_quantity"])
    late = fact.where("week > 6").groupBy(*E, *G).agg(F.sum("targets").alias("more"))
    out = ranking.panel_advanced(fact, on_play, plays, means=["l_quantity"], per_pass={"target_per_pass_snap": "targets"}, style=["motion"], more=[late])
    return out.withColumns({c: F.round(c, 6) for c in ("avg_l_quantity", "snap_share", "target_per_pass_snap", "motion_rate")})


# ---- joins, filters and stores -----------------------------------------------------------------------------------


@query("SELECT o_orderkey, l_linenumber, o_orderstatus FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag IN ('R', 'A') AND l_quantity > 0")
def p04_j08_j18_inner(spark, sf_dir):
    """Lines of some kinds with their order; an order without any goes."""
    lines = shape.isin(table(spark, sf_dir, "lineitem"), "l_returnflag", ["R", "A"]).where("l_quantity > 0").withColumnRenamed("l_orderkey", "o_orderkey")
    return joins.attach(table(spark, sf_dir, "orders"), lines, ["o_orderkey"], "inner").select("o_orderkey", "l_linenumber", "o_orderstatus")


@query("SELECT c_custkey, c_name, round(c_acctbal, 4) AS c_acctbal FROM customer")
def s04_read_seed(spark, sf_dir):
    """Customers written as CSV with a header and read back by a schema."""
    path = scratch_path(spark, "seed")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.round("c_acctbal", 4).alias("c_acctbal")).write.csv(path, header=True)
    return snapshots.read_seed(spark, path, "c_custkey bigint, c_name string, c_acctbal double")


@query("SELECT year(o_orderdate) AS season, o_orderkey, o_orderpriority FROM orders")
def s09_materialize(spark, sf_dir):
    """A table in folders by season, replaced by its newest form and read back."""
    o, path = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("season"), "o_orderkey", "o_orderpriority"), scratch_path(spark, "model")
    sinks.materialize(o.withColumn("o_orderpriority", F.lit("old")), path, ["season"])
    return sinks.materialize(o, path, ["season"]).select("season", "o_orderkey", "o_orderpriority")


@query(panel_sql("""SELECT player_id, season, week, revenue, CASE WHEN season * 100 + week = (SELECT max(season * 100 + week) FROM panel) AND mine = (SELECT max(season * 100 + week) FROM panel) THEN disc_amt END AS part
 FROM (SELECT *, max(season * 100 + week) OVER (PARTITION BY player_id) AS mine FROM panel)"""))
def s14_publish_entity(spark, sf_dir):
    """A document a customer, read back: the whole history, and a breakdown for those of the newest month alone."""
    p = stored(order_panel(spark, sf_dir), "panel")
    parts = p.select(*E, *G, F.lit("disc_amt").alias("name"), F.col("disc_amt").alias("x"))
    docs = sinks.publish_entity(p, parts, "player_id", G, ["revenue"], ["name", "x"], ["name"])
    form = "struct<history: array<struct<season: int, week: int, revenue: bigint>>, breakdown: array<struct<name: string, x: bigint>>>"
    read = docs.select("player_id", F.from_json("document", form).alias("d"))
    rows = read.select("player_id", F.element_at("d.history", -1).alias("last"), F.explode("d.history").alias("h"), F.get("d.breakdown", 0)["x"].alias("x"))
    return rows.select("player_id", "h.season", "h.week", "h.revenue", F.when(F.col("h.week") + 100 * F.col("h.season") == F.col("last.week") + 100 * F.col("last.season"), F.col("x")).alias("part"))


@query("SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) - 1 AS place FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderpriority, o_orderstatus)")
def s16_methodology(spark, sf_dir):
    """A document a priority with what it consists of in order, read back."""
    weights = stored(table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n")), "weights")
    docs = sinks.methodology(weights.groupBy("o_orderpriority").agg(F.sum("n").alias("orders")), weights, "o_orderpriority", ["o_orderstatus"], ["o_orderstatus", "n"])
    read = docs.select("o_orderpriority", F.from_json("document", "struct<weights: array<struct<o_orderstatus: string, n: bigint>>>").alias("d"))
    return read.select("o_orderpriority", F.posexplode("d.weights").alias("place", "w")).select("o_orderpriority", "w.o_orderstatus", "w.n", "place")


@query("""SELECT s AS status, count(o_orderkey) AS n FROM (VALUES ('ingested'), ('skipped_unchanged'), ('not_available'), ('failed')) v(s)
 LEFT JOIN orders ON s = CASE o_orderstatus WHEN 'F' THEN 'ingested' WHEN 'O' THEN 'skipped_unchanged' WHEN 'P' THEN 'failed' END GROUP BY s""")
def s07_manifest_counts(spark, sf_dir):
    """Orders as files of a run; a status without any counts as 0."""
    status = F.when(F.col("o_orderstatus") == "F", "ingested").when(F.col("o_orderstatus") == "O", "skipped_unchanged").when(F.col("o_orderstatus") == "P", "failed")
    return landing.manifest_counts(table(spark, sf_dir, "orders").select(status.alias("status")))


@query("SELECT 'large' AS name, count(*) AS n FROM lineitem WHERE l_quantity > 49 HAVING count(*) > 0 UNION ALL SELECT 'back', count(*) FROM lineitem WHERE l_returnflag = 'R' HAVING count(*) > 0")
def q16_gate(spark, sf_dir):
    """Warnings pass a gate and are named; the same finding as an error closes it."""
    lines = table(spark, sf_dir, "lineitem")
    found = [checks.Check("large", lines.where("l_quantity > 49"), "warn"), checks.Check("back", lines.where("l_returnflag = 'R'"), "warn"), checks.Check("none", lines.where("l_quantity < 0"))]
    try:
        checks.gate([checks.Check("back", lines.where("l_returnflag = 'R'"))])
        raise AssertionError("the gate is open")
    except checks.GateError:
        return spark.createDataFrame(checks.gate(found), "name string, n bigint")
