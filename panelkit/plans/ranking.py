"""Ranking of a panel: cumulative panel, metrics and qualification, percentiles, composite, ranks, explanation; and the
staging of raw tables that feeds it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import explode_list, parse_local_ts, safe_ratio, score_points, stable, to_date_or_null
from ..operators import aggs, joins, shape, windows


@dataclass(frozen=True)
class Names:
    """Column names of a panel."""

    entity: str = "player_id"
    season: str = "season"
    week: str = "week"
    group: str = "position"
    team: str = "team"

    @property
    def keys(self) -> list[str]:
        return [self.entity, self.season, self.week]


@dataclass(frozen=True)
class Metrics:
    """Derived metrics by name: an expression on the cumulative panel."""

    expressions: Mapping[str, Column] = field(default_factory=dict)


def panel_fact(stats: DataFrame, games: DataFrame, ids: DataFrame, snaps: DataFrame, injuries: DataFrame, n: Names = Names(), snap_order: str = "snaps") -> DataFrame:
    """One row per entity and period: stats with their game, the snap count with the most snaps (by crosswalk id), and
    the injury status. games: season, week, home, away, game_id; ids: entity, other_id."""
    counted = windows.dedupe_max(joins.crosswalk(snaps, ids, "other_id").drop("other_id"), n.keys, snap_order, [n.team])
    fact = joins.membership_join(stats, games, [n.season, n.week], n.team, ["home", "away"], "left")
    fact = joins.attach(fact, counted.drop(n.team), n.keys)
    return joins.attach(fact, injuries, n.keys)


def panel_advanced(fact: DataFrame, on_play: DataFrame, plays: DataFrame, n: Names = Names(), means: Sequence[str] = (), per_pass: Mapping[str, str] | None = None, style: Sequence[str] = (), more: Sequence[DataFrame] = ()) -> DataFrame:
    """The panel with how its entities and teams were used.

    on_play: a row an entity on a play (game_id, play_id, entity, team, dropback and the columns of `means`; season and week, if
    they are known there); plays: game_id, play_id, season, week, team and the flags of `style`. Adds snaps, pass_snaps, snap_share (of the distinct plays of the
    team), the means, what `per_pass` names (name: column) by pass snap, the team's rate of each flag, and the further frames
    by entity and period. Ratios without a denominator are null.
    """
    team = [n.season, n.week, n.team]
    told = {n.season, n.week} <= set(on_play.columns)
    placed = on_play if told else on_play.join(joins.large(plays.select("game_id", "play_id", n.season, n.week)), ["game_id", "play_id"])
    own = placed.groupBy(*n.keys).agg(F.count("*").alias("snaps"), F.count_if("dropback").alias("pass_snaps"), *(F.avg(c).alias(f"avg_{c}") for c in means))
    had = placed.groupBy(*team).agg(F.count_distinct("game_id", "play_id").alias("team_plays"))
    out = fact
    for df in (own, *more):  # all by the same keys, so the panel is dealt out once
        out = joins.attach(out, joins.large(df), n.keys)
    out = joins.attach(out, F.broadcast(had), team)  # a row a team and period
    if style:
        out = joins.attach(out, F.broadcast(shape.require(plays, n.team).groupBy(*team).agg(*(aggs.rate(c).alias(f"{c}_rate") for c in style))), team)
    ratios = {name: safe_ratio(c, "pass_snaps") for name, c in (per_pass or {}).items()}
    return out.withColumns({"snap_share": safe_ratio("snaps", "team_plays")} | ratios).drop("team_plays")


def fantasy_points(fact: DataFrame, kind: str, special: str, weights: Mapping[str, float], given: str, name: str = "points") -> DataFrame:
    return fact.withColumn(name, score_points(kind, special, weights, given))


def cumulative_marks(fact: DataFrame, cols: Sequence[str], n: Names = Names(), carry: Sequence[str] = ("position", "team"), weighted: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """`fact`, a row per entity and period, with running totals cum_<col>, games so far, carried-forward labels (`carry`, in
    place), active, and __until: the entity's next period of the season, null for its last."""
    weighted = weighted or {}
    terms = {}
    for name, (x, w) in weighted.items():
        terms[f"{name}_x"], terms[f"{name}_w"] = aggs.accumulators(x, w)
    rows = fact.withColumns(terms) if terms else fact
    w = windows.so_far([n.entity, n.season], [n.week])
    totals = {f"cum_{c}": F.sum(F.coalesce(F.col(c), F.lit(0))).over(w) for c in [*cols, *terms]}
    labels = {c: F.last(c, ignorenulls=True).over(w) for c in carry}
    after = F.lead(n.week).over(Window.partitionBy(n.entity, n.season).orderBy(n.week))
    kept = [c for c in fact.columns if c not in carry]
    return rows.select(*kept, *(c.alias(k) for k, c in labels.items()), F.count(cols[0]).over(w).alias("games"), F.col(cols[0]).isNotNull().alias("active"), *(c.alias(k) for k, c in totals.items()), after.alias("__until"))


def spread_marks(marks: DataFrame, carry: Sequence[str] = ("position", "team"), n: Names = Names(), ahead: str | None = None) -> DataFrame:
    """Dense panel: each row of `cumulative_marks` stands for its entity until the next one, so nothing is shuffled or joined but
    the calendar, a row a season. ahead: name of a flag that says whether the entity has a row in the period after."""
    calendar = marks.groupBy(n.season).agg(F.collect_set(n.week).alias("__weeks"))
    stands = lambda w: (w >= F.col(n.week)) & (F.col("__until").isNull() | (w < F.col("__until")))
    dense = marks.join(F.broadcast(calendar), n.season).withColumn("__week", F.explode(F.filter("__weeks", stands)))
    totals = [c for c in marks.columns if c.startswith("cum_")]
    flags = [F.coalesce(F.col("__until") == F.col("__week") + 1, F.lit(False)).alias(ahead)] if ahead else []
    active = (F.col("active") & (F.col("__week") == F.col(n.week))).alias("active")
    return dense.select(n.entity, n.season, F.col("__week").alias(n.week), *carry, "games", active, *totals, *flags)


def cumulative_panel(fact: DataFrame, cols: Sequence[str], n: Names = Names(), carry: Sequence[str] = ("position", "team"), weighted: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """Dense panel with running totals cum_<col>, games so far and carried-forward labels. Periods without activity keep
    the totals. `weighted` maps a name to (value, weight): cum_<name>_x and cum_<name>_w accumulate its weighted mean."""
    return spread_marks(cumulative_marks(fact, cols, n, carry, weighted), carry, n)


def rank_metrics(cumulative: DataFrame, finished: DataFrame, config: DataFrame, metrics: Metrics, role: str, n: Names = Names()) -> DataFrame:
    """Metrics and is_qualified: role volume of at least min_role for each game that the team has finished (one at
    least). finished: one row per team, season and week played. config: group, min_role, ...

    Rows are dealt out by their pool (season, period, group), before metrics are made: what ranks them all goes by that."""
    played = finished.groupBy(n.team, n.season).agg(F.collect_list(n.week).alias("__played"))  # a row a team and season
    counted = cumulative.join(F.broadcast(played), [n.team, n.season], "left")
    counted = counted.withColumn("team_games", F.coalesce(F.size(F.filter("__played", lambda w: w <= F.col(n.week))), F.lit(0)).cast("bigint")).drop("__played")
    known = joins.with_config(counted, F.broadcast(config), n.group)
    need = F.col("min_role") * F.greatest(F.col("team_games"), F.lit(1))
    told = known.withColumn("is_qualified", F.coalesce(F.col(role) >= need, F.lit(False))).repartition(n.season, n.week, n.group)
    return told.withColumns(dict(metrics.expressions)).select(*(c for c in told.columns if c != "is_qualified"), *metrics.expressions, "is_qualified")


def with_percentiles(metrics: DataFrame, weights: DataFrame, names: Sequence[str], n: Names = Names()) -> DataFrame:
    """`metrics` with a struct __<metric> for each name: value, component, weight, lower_is_better and percentile within period
    and group, of qualified rows; null where the metric is not known or has no weight. weights: group, metric, component,
    weight, lower_is_better; a row a group and metric. One row stays one row, so its metrics share one shuffle."""
    given = F.struct("component", F.col("weight").cast("double").alias("weight"), "lower_is_better")
    told = weights.groupBy(n.group).agg(*(F.max(F.when(F.col("metric") == m, given)).alias(f"__{m}") for m in names))
    rows = metrics.join(F.broadcast(told), n.group, "left")
    for m in names:
        x, w = F.col(m).cast("double"), F.col(f"__{m}")
        known = F.coalesce(F.col("is_qualified") & x.isNotNull() & ~F.isnan(x) & w.isNotNull(), F.lit(False))
        ranked = windows.percentile_score(rows.withColumn("__known", known), [n.season, n.week, n.group, "__known"], m, w["lower_is_better"], "__p")
        rows = ranked.withColumn(f"__{m}", F.when(F.col("__known"), F.struct(x.alias("metric_value"), w["component"].alias("component"), w["weight"].alias("weight"), w["lower_is_better"].alias("lower_is_better"), F.col("__p").alias("percentile")))).drop("__known", "__p")
    return rows


def rank_percentiles(told: DataFrame, names: Sequence[str], n: Names = Names()) -> DataFrame:
    """`with_percentiles` as a long table: metric, metric_value, component, weight, lower_is_better, percentile."""
    each = F.explode(F.filter(F.array(*(F.when(F.col(f"__{m}").isNotNull(), F.struct(F.lit(m).alias("metric"), f"__{m}.*")) for m in names)), lambda x: x.isNotNull()))
    return told.select(*n.keys, n.group, each.alias("__v")).select(*n.keys, n.group, "__v.*")


def _weight(names: Sequence[str], component: str | Column) -> Column:
    """The weight of a component's known metrics together."""
    return sum((F.when(F.col(f"__{m}.component") == component, F.col(f"__{m}.weight")).otherwise(0.0) for m in names), F.lit(0.0))


def rank_scores(told: DataFrame, config: DataFrame, names: Sequence[str], n: Names = Names(), components: tuple[str, str] = ("efficiency", "production"), share: str = "efficiency_share") -> DataFrame:
    """Component scores of `with_percentiles`, renormalised over the metrics that are there, blended by the group's share; if one
    is missing, the other alone. Rounded to 6 digits, so ties are ties."""
    part = lambda m, v: F.when(F.col(f"__{m}.component") == v, F.col(f"__{m}.weight") * F.col(f"__{m}.percentile")).otherwise(0.0)
    means = {f"{v}_score": 100.0 * sum((part(m, v) for m in names), F.lit(0.0)) / F.nullif(_weight(names, F.lit(v)), F.lit(0.0)) for v in components}
    rows = told.withColumns(means).drop(*(f"__{m}" for m in names))
    if share not in rows.columns:
        rows = rows.join(F.broadcast(config.select(n.group, share)), n.group)
    a, b = (F.col(f"{c}_score") for c in components)
    blend = F.col(share) * a + (1 - F.col(share)) * b
    return rows.withColumns({f"{c}_score": stable(f"{c}_score") for c in components} | {"composite_score": stable(F.coalesce(blend, a, b))})


def rankings(scores: DataFrame, n: Names = Names(), points: str = "points", finished: DataFrame | None = None, opening: DataFrame | None = None) -> DataFrame:
    """Two views of a period, each within season, period and group: rank, of qualified rows by composite, points, games, id;
    and fantasy_rank, of all rows by points, games, id. For either, the rank of exactly the period before in the same group
    (a change of group is no movement), the movement, and whether it is new, which nothing is in a season's first period.
    week_complete: every game of the period is final (`finished`: season, week, is_final); false where nothing is known.
    opening: season and its first week, if known; else from the scores.
    """
    order = [F.col(points).desc_nulls_last(), F.col("games").desc(), F.col(n.entity)]
    pool = [n.season, n.week, n.group]
    ranked = windows.rank_rows(scores, pool, [F.col("composite_score").desc_nulls_last(), *order], "is_qualified")
    ranked = windows.rank_rows(ranked, pool, order, None, "fantasy_rank")
    first = (scores if opening is None else opening).groupBy(n.season).agg(F.min(n.week).alias("__first"))  # a row a season
    moved = joins.prev_period(ranked, [n.entity, n.season, n.group], n.week, ["rank", "fantasy_rank"]).join(F.broadcast(first), n.season)
    fresh = lambda now, was: F.col(now).isNotNull() & F.col(was).isNull() & (F.col(n.week) > F.col("__first"))
    out = moved.withColumns({
        "movement": F.col("prev_rank") - F.col("rank"), "is_new": fresh("rank", "prev_rank"),
        "fantasy_movement": F.col("prev_fantasy_rank") - F.col("fantasy_rank"), "fantasy_is_new": fresh("fantasy_rank", "prev_fantasy_rank"),
    }).drop("__first")
    if finished is not None:
        complete = aggs.all_true(finished, [n.season, n.week], "is_final", "week_complete")  # a row a period
        out = out.join(F.broadcast(complete), [n.season, n.week], "left").withColumn("week_complete", F.coalesce("week_complete", F.lit(False)))
    return out


def breakdown(told: DataFrame, config: DataFrame, names: Sequence[str], n: Names = Names(), share: str = "efficiency_share", efficiency: str = "efficiency") -> DataFrame:
    """Points that each metric of `with_percentiles` adds to the composite, a row a metric. A sole component has the full share.
    They add up to the score."""
    rows = told if share in told.columns else told.join(F.broadcast(config.select(n.group, share)), n.group)
    kinds = F.array_size(F.array_compact(F.array_distinct(F.array(*(F.col(f"__{m}.component") for m in names)))))
    rows = rows.withColumn("__kinds", kinds)

    def points(m: str) -> Column:
        v = F.col(f"__{m}")
        part = F.when(F.col("__kinds") == 1, 1.0).when(v["component"] == efficiency, F.col(share)).otherwise(1 - F.col(share))
        value = 100 * v["percentile"] * v["weight"] / _weight(names, v["component"]) * part
        return F.when(v.isNotNull(), F.struct(F.lit(m).alias("metric"), v["component"].alias("component"), v["weight"].alias("weight"), v["percentile"].alias("percentile"), value.alias("contribution")))

    each = F.explode(F.filter(F.array(*map(points, names)), lambda x: x.isNotNull()))
    return rows.select(*n.keys, n.group, each.alias("__v")).select(*n.keys, n.group, "__v.*")


def player_dim(players: DataFrame, facts: DataFrame, n: Names = Names(), cols: Sequence[str] = ("name", "team", "position")) -> DataFrame:
    """Known players, and those whom only the facts have, with the details of their most recent row."""
    recent = aggs.latest_by(facts, [n.entity], [n.season, n.week], cols)
    return shape.union_dims(players.withColumn("is_fallback", F.lit(False)), joins.anti(recent, players, [n.entity]).withColumn("is_fallback", F.lit(True)))


def feature_store(fact: DataFrame, upcoming: DataFrame, x: str, n: Names = Names(), windows_back: Sequence[int] = (3, 5, 8, 10), extra: Sequence[str] = (), opponent: str | None = None) -> DataFrame:
    """What is known before each period, for past rows and for upcoming ones (whose outcome is null).

    mean<k>, season mean, deviation over 8, prior games; means over 5 of the extra columns; with `opponent`, what that
    opponent has allowed to the group over the 8 periods before. All frames end one row before the row itself.
    """
    rows = shape.union_dims(fact.withColumn("is_upcoming", F.lit(False)), upcoming.withColumn("is_upcoming", F.lit(True)))
    order, every = [n.season, n.week], windows.past([n.entity], [n.season, n.week])
    back = lambda k: windows.past([n.entity], order, k)
    out = rows.select(
        "*", *(F.avg(x).over(back(k)).alias(f"{x}_mean{k}") for k in windows_back), F.stddev_samp(x).over(back(8)).alias(f"{x}_sd8"),
        F.count("*").over(every).alias("prior_games"), F.avg(x).over(windows.past([n.entity, n.season], [n.week])).alias(f"{x}_season"),
        *(F.avg(c).over(back(5)).alias(f"{c}_mean5") for c in extra),
    )
    if opponent:
        allowed = windows.trailing_of_agg(rows, [opponent, n.group], order, x, 8, f"{opponent}_allowed8")
        out = joins.opponent_history(out, allowed, [opponent, n.group], f"{opponent}_allowed8", order)
    return out


def stage_games(raw: DataFrame, codes: DataFrame) -> DataFrame:
    """Schedule: codes, local start, flags that stay null where unknown, is_final."""
    df = joins.std_code(joins.std_code(raw, "home_team", codes), "away_team", codes)
    final = F.col("home_score").isNotNull() & F.col("away_score").isNotNull()
    return shape.require(df, "game_id").select(
        "game_id", "season", "week", to_date_or_null("gameday").alias("game_date"), parse_local_ts("gameday", "gametime").alias("starts_at"),
        F.col("home_team").alias("home"), F.col("away_team").alias("away"), "home_score", "away_score", shape.flag("overtime", "=", 1).alias("overtime"),
        shape.flag("div_game", "=", 1).alias("division_game"), final.alias("is_final"),
    )


def stage_players(raw: DataFrame, codes: DataFrame, groups: DataFrame) -> DataFrame:
    df = joins.map_category(joins.std_code(raw, "latest_team", codes), "position", groups, "position", "position_group", "position_group")
    return shape.require(df, "gsis_id").select(F.col("gsis_id").alias("player_id"), F.col("display_name").alias("name"), to_date_or_null("birth_date").alias("birth_date"), "position", "position_group", F.col("latest_team").alias("team"), F.col("pfr_id").alias("other_id"))


def stage_stats(raw: DataFrame, codes: DataFrame, groups: DataFrame, dropped: Sequence[str] = ()) -> DataFrame:
    """All columns but those named, with standard codes and the group of the position."""
    df = shape.drop_cols(shape.require(raw, "player_id"), [*dropped, "position_group"])
    df = joins.std_code(joins.std_code(df, "team", codes), "opponent_team", codes)
    return joins.map_category(df, "position", groups, "position", "position_group", "position_group")


def stage_rosters(raw: DataFrame, codes: DataFrame) -> DataFrame:
    df = joins.std_code(shape.require(raw, "gsis_id"), "team", codes)
    return df.select(F.col("gsis_id").alias("player_id"), "season", "week", "team", "position", "status", F.coalesce(F.col("status") == "ACT", F.lit(False)).alias("is_active"))


def stage_snaps(raw: DataFrame, codes: DataFrame) -> DataFrame:
    df = joins.std_code(shape.require(raw, "pfr_player_id"), "team", codes)
    return df.select(F.col("pfr_player_id").alias("other_id"), "game_id", "season", "week", "team", F.col("offense_snaps").alias("snaps"), F.col("offense_pct").alias("snap_pct"))


def stage_participation(raw: DataFrame, plays: DataFrame, game: str = "game_id", carry: Sequence[str] = ()) -> DataFrame:
    """A row per play and listed player, with the play's dropback flag (null counts as no) and further columns of the play.
    Plays meet their lists before these are taken apart."""
    marked = plays.select("game_id", "play_id", F.coalesce(F.col("dropback").cast("boolean"), F.lit(False)).alias("dropback"), *carry)
    listed = shape.non_blank(raw, "offense_players").withColumnRenamed(game, "game_id")
    return explode_list(joins.attach(listed, joins.large(marked), ["game_id", "play_id"]), "offense_players", ";", "player_id")


def stage_advstats(rush: DataFrame, rec: DataFrame, passing: DataFrame, regular: str = "REG", kind: str = "game_type", keys: Sequence[str] = ("season", "week", "pfr_player_id"), team: str = "team") -> DataFrame:
    """Three files in one row per player and week; the team is the first file's alone, null where that has no row."""
    parts = [shape.isin(df, kind, [regular]).drop(kind) for df in (rush, rec, passing)]
    return joins.full_merge_first(parts, list(keys), [team])


def stage_tracking(rec: DataFrame, rush: DataFrame, passing: DataFrame, regular: str = "REG") -> DataFrame:
    """Three files in one row per player and week; week 0 holds season totals and goes."""
    parts = [shape.isin(df, "season_type", [regular]).where("week > 0").drop("season_type") for df in (rec, rush, passing)]
    return joins.full_merge(parts, ["season", "week", "player_gsis_id"])


def stage_charting(raw: DataFrame, game: str = "game_id", play: str = "play_id") -> DataFrame:
    """Renamed keys, and the counts, flags and quarterback columns."""
    return shape.curate(raw, {"game_id": game, "play_id": play, "season": "season", "week": "week"} | {c: c for c in raw.columns if c.startswith(("is_", "n_", "qb_"))})


def stage_plays(raw: DataFrame, cols: Sequence[str], regular: str = "REG") -> DataFrame:
    """A narrow regular-season play table: the filter and the columns reach the scan."""
    return shape.isin(raw, "season_type", [regular]).select(*cols)


def stage_injuries(raw: DataFrame, ladder: Sequence[str] = ("Out", "Doubtful", "Questionable")) -> DataFrame:
    """One row per player and week, the most severe status first, then by team."""
    known = shape.require(raw, "gsis_id")
    first = windows.dedupe(known, ["gsis_id", "season", "week"], [windows.ladder("report_status", ladder), F.col("team").asc_nulls_last()])
    return first.select(F.col("gsis_id").alias("player_id"), "season", "week", F.col("report_status").alias("injury_status"), "practice_status")
