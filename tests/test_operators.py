"""Operators on hand-made frames."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.functions import scalar
from panelkit.operators import aggs, checks, joins, shape, windows
from panelkit.plans import forecast, ranking


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def panel(spark):
    data = [("a", 1, 1, 10.0), ("a", 1, 2, 20.0), ("a", 1, 4, 40.0), ("b", 1, 2, 5.0), ("b", 1, 3, 7.0), ("a", 2, 1, 1.0)]
    return spark.createDataFrame(data, "e string, season int, week int, x double")


def test_spine_is_dense_from_the_first_period(spark):
    assert rows(joins.spine(panel(spark), "e", "season", "week"), "e", "season", "week") == [("a", 1, 1), ("a", 1, 2), ("a", 1, 3), ("a", 1, 4), ("a", 2, 1), ("b", 1, 2), ("b", 1, 3), ("b", 1, 4)]


def test_prev_period_is_null_across_a_gap(spark):
    got = {r[:3]: r[3] for r in rows(joins.prev_period(panel(spark), ["e", "season"], "week", ["x"]), "e", "season", "week", "prev_x")}
    assert got[("a", 1, 2)] == 10.0 and got[("a", 1, 4)] is None and got[("a", 2, 1)] is None


def test_trailing_never_sees_its_own_row_or_the_future(spark):
    specs = {"m": ("avg", "x", 3), "n": ("count", "x", None)}
    before = windows.trailing(panel(spark), ["e"], ["season", "week"], specs)
    changed = panel(spark).withColumn("x", F.when(F.col("season") == 2, 999.0).when((F.col("week") == 4), -1.0).otherwise(F.col("x")))
    after = windows.trailing(changed, ["e"], ["season", "week"], specs)
    early = "season = 1 and week <= 4"
    assert rows(before.where(early), "e", "season", "week", "m", "n") == rows(after.where(early), "e", "season", "week", "m", "n")
    assert rows(before.where("season = 2"), "m") != rows(after.where("season = 2"), "m")
    first = before.where("e = 'b' and week = 2").first()
    assert first["m"] is None and first["n"] == 0


def test_percentile_of_one_row_is_half(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 3.0), ("h", 9.0)], "k string, x double")
    assert rows(windows.percentile_score(df, ["k"], "x", F.lit(True)), "k", "percentile") == [("g", 0.0), ("g", 0.5), ("g", 1.0), ("h", 0.5)]


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 1.0), (1, 9.0)], "k int, x double")
    assert rows(windows.avg_rank(df, ["k"], "x", "r"), "r") == [(1.0,), (2.5,), (2.5,), (4.0,)]


def test_correlations_are_null_where_undefined(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 4.0), (1, 3.0, 6.0), (2, 1.0, 1.0), (2, 1.0, 2.0), (2, 1.0, 3.0), (3, 1.0, 1.0)], "k int, x double, y double")
    got = dict(rows(aggs.pearson_by(df, ["k"], "x", "y"), "k", "r"))
    assert got[1] == pytest.approx(1.0) and got[2] is None and got[3] is None
    assert dict(rows(aggs.spearman_by(df.withColumn("y", -F.col("y")), ["k"], "x", "y"), "k", "rho"))[1] == pytest.approx(-1.0)


def test_lift_needs_more_rows_than_k(spark):
    df = spark.createDataFrame([(1, s, float(s), str(s)) for s in range(5)], "k int, s int, y double, id string")
    assert aggs.lift_by(df, ["k"], "s", "y", "id", 2).first()["lift"] == pytest.approx(1.5)
    assert aggs.lift_by(df, ["k"], "s", "y", "id", 5).first()["lift"] is None


def test_worst_share_with_ties(spark):
    df = spark.createDataFrame([(float(x),) for x in (10, 10, 10, 1, 1, 1, 1, 1, 1, 1)], "x double")
    assert aggs.worst_share(df, "x", 20, "x").first()["share"] == pytest.approx(20 / 37)


def test_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(0.0,), (4.0,), (4.1,), (None,), (200.0,)], "x double")
    assert [r[0] for r in df.select(scalar.bin_right("x", (-0.01, 4, 8, 13, 100))).collect()] == ["(-0.01, 4]", "(-0.01, 4]", "(4, 8]", None, None]


def test_times_and_bad_text(spark):
    df = spark.createDataFrame([("2024-09-08", "13:00"), ("2024-09-08", "late"), (None, "13:00")], "d string, t string")
    got = [r[0] for r in df.select(scalar.parse_local_ts("d", "t").cast("string")).collect()]
    assert got == ["2024-09-08 13:00:00", None, None]


def test_opponent_history_reaches_upcoming_periods(spark):
    history = spark.createDataFrame([("o", 1, 1, None), ("o", 1, 2, 3.0)], "opp string, season int, week int, h double")
    asked = spark.createDataFrame([("o", 1, 2), ("o", 1, 3)], "opp string, season int, week int")
    assert rows(joins.opponent_history(asked, history, ["opp"], "h", ["season", "week"]), "week", "h") == [(2, 3.0), (3, 3.0)]
    assert sorted(joins.opponent_history(asked, history, ["opp"], "h", ["season", "week"], asof=False).select("week", "h").collect())[1]["h"] is None


@pytest.mark.parametrize("name,build", [
    ("unique", lambda s: checks.unique(s.createDataFrame([(1,), (1,)], "k int"), "k")),
    ("not_null", lambda s: checks.not_null(s.createDataFrame([(None,)], "k int"), "k")),
    ("accepted", lambda s: checks.accepted(s.createDataFrame([("z",)], "k string"), "k", ["a"])),
    ("orphans", lambda s: checks.orphans(s.createDataFrame([(1,)], "k int"), "k", s.createDataFrame([(2,)], "p int"), "p")),
    ("combination", lambda s: checks.unique_combination(s.createDataFrame([(1, 2), (1, 2)], "a int, b int"), ["a", "b"])),
    ("expression", lambda s: checks.expression(s.createDataFrame([(5, 3)], "done int, tried int"), "done <= tried")),
    ("not_empty", lambda s: checks.not_empty(s.createDataFrame([], "k int"))),
    ("contiguous", lambda s: checks.contiguous(s.createDataFrame([(1, 1), (1, 3)], "g int, r int"), ["g"], "r")),
    ("min_rows", lambda s: checks.min_rows(s.createDataFrame([("a",)], "g string"), "g", {"a": 2})),
    ("flag", lambda s: checks.flag_agrees(s.createDataFrame([(False, 1, 2.0)], "q boolean, r int, s double"), "q", "r", "s")),
    ("outcome", lambda s: checks.outcome_iff_final(s.createDataFrame([(1.0, False)], "y double, f boolean"), "y", "f")),
    ("no_future", lambda s: checks.no_future(s.createDataFrame([("a", 1, 0, 5.0)], "e string, w int, n int, h double"), ["e"], ["w"], "n", ["h"])),
    ("conforms", lambda s: checks.conforms(s.createDataFrame([(101.0,)], "score double"), s.createDataFrame([], "score double").schema, {"score": (0, 100)})),
])
def test_checks_find_what_is_wrong(spark, name, build):
    assert not build(spark).isEmpty()
    with pytest.raises(checks.GateError):
        checks.gate([checks.Check(name, build(spark))])
    assert checks.gate([checks.Check(name, build(spark), "warn")]) == [(name, 1)]


def test_staging_keeps_the_most_severe_injury(spark):
    raw = spark.createDataFrame([("p", 1, 1, "T", "Questionable", "x"), ("p", 1, 1, "T", "Out", "y"), (None, 1, 1, "T", "Out", "z")], "gsis_id string, season int, week int, team string, report_status string, practice_status string")
    assert rows(ranking.stage_injuries(raw), "player_id", "injury_status") == [("p", "Out")]


def test_advanced_files_merge_into_one_row(spark):
    part = lambda who, team, col: spark.createDataFrame([(1, 1, who, team, "REG", 5)], f"season int, week int, pfr_player_id string, team string, game_type string, {col} int")
    got = ranking.stage_advstats(part("a", "X", "rush"), part("a", "X", "rec"), part("b", "Y", "pass"))
    assert rows(got, "pfr_player_id", "team", "rush", "rec", "pass") == [("a", "X", 5, 5, None), ("b", None, None, None, 5)]


def test_participation_has_a_row_per_listed_player(spark):
    raw = spark.createDataFrame([("g", 1, "a;b;"), ("g", 2, "")], "game_id string, play_id int, offense_players string")
    plays = spark.createDataFrame([("g", 1, None)], "game_id string, play_id int, dropback int")
    assert rows(ranking.stage_participation(raw, plays), "player_id", "dropback") == [("a", False), ("b", False)]


def test_charting_keeps_counts_and_flags(spark):
    raw = spark.createDataFrame([("g", 7, 2024, 1, True, 3, "S", "no")], "gid string, pid int, season int, week int, is_motion boolean, n_rushers int, qb_location string, note string")
    got = ranking.stage_charting(raw, "gid", "pid")
    assert got.columns == ["game_id", "play_id", "season", "week", "is_motion", "n_rushers", "qb_location"]


def test_games_are_staged_with_codes_and_tolerant_times(spark):
    raw = spark.createDataFrame([("g1", 1, 1, "2024-09-08", "13:00", "OAK", "KC", 3, 7, 1, 0), ("g2", 1, 2, "soon", None, "LV", "KC", None, None, None, 1)], "game_id string, season int, week int, gameday string, gametime string, home_team string, away_team string, home_score int, away_score int, overtime int, div_game int")
    codes = spark.createDataFrame([("OAK", "LV")], "raw string, standard string")
    got = {r["game_id"]: r for r in ranking.stage_games(raw, codes).collect()}
    assert got["g1"]["home"] == "LV" and got["g1"]["is_final"] and got["g1"]["overtime"]
    assert got["g2"]["starts_at"] is None and got["g2"]["game_date"] is None and got["g2"]["overtime"] is None and not got["g2"]["is_final"]


def test_promotion_gate(spark):
    df = spark.createDataFrame([(0.1, 0.8, 3.0), (0.01, 0.8, 3.0), (0.1, 0.9, 3.0), (0.1, 0.8, 1.0)], "improvement double, coverage double, z double")
    assert [r["reason"] for r in forecast.promote(df).collect()] == ["promoted", "improvement too small", "coverage out of bounds", "not significant"]


def test_candidates_are_held_to_their_contract(spark):
    df = spark.createDataFrame([("a", 1, 1, 2.0, 4.0), ("a", 1, 2, 3.0, 1.0)], "e string, season int, week int, y double, m double")
    keys = ["e", "season", "week"]
    assert "r" in forecast.Candidate("ok", "", ("r",), lambda d: d.withColumn("r", F.col("m") * 2)).apply(df, keys).columns
    for bad in (lambda d: d.withColumn("m", F.lit(0.0)).withColumn("r", F.lit(1)), lambda d: d.limit(1).withColumn("r", F.lit(1)), lambda d: d):
        with pytest.raises(ValueError):
            forecast.Candidate("bad", "", ("r",), bad).apply(df, keys)
    leaky = forecast.Candidate("leaky", "", ("r",), lambda d: d.withColumn("r", F.col("y")))
    assert leaky.leaks(df, keys, "y", F.col("week") == 2).count() == 1


def test_lock_windows(spark):
    starts = spark.createDataFrame([(1, "2024-01-02 00:00:00"), (2, "2024-01-01 00:20:00"), (3, "2024-01-05 00:00:00"), (4, None)], "week int, s string").withColumn("first_start", F.col("s").cast("timestamp"))
    got = forecast.lock_state(starts, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert [r["state"] for r in got.orderBy("week").collect()] == ["lock", "missed", "wait", "unknown"]


def test_model_beats_guessing_and_ranges_are_honest(spark):
    import random

    rng = random.Random(5)
    data = []
    for season in (1, 2, 3):
        for week in range(1, 13):
            for p in range(50):
                form = 4 + p / 5
                data.append((f"p{p}", season, week, 9, form + rng.gauss(0, 1), form + rng.gauss(0, 2), max(0.0, form + rng.gauss(0, 3))))
    df = spark.createDataFrame(data, "player_id string, season int, week int, prior_games int, mean5 double, mean10 double, actual double").repartition(2).cache()
    spec = forecast.Spec(["mean5", "mean10"], options={"rounds": 5, "rate": 0.3, "trees": 5, "leaf": 30})
    got = forecast.walk_forward(df, [(3, 6)], spec, least_history=1000)
    row = forecast.summarize_replay(got.withColumn("flat", F.lit(9.0)), "actual", ["flat"]).first()
    assert row["margin"] > 0 and 0.6 <= row["coverage"] <= 0.95
    with pytest.raises(ValueError):
        forecast.reject_overlap(df, df, ["player_id", "season", "week"])


def test_replay_covers_every_period_with_history_and_ridge_chooses_its_penalty(spark, monkeypatch):
    data = [(f"p{p}", 1, week, 9, float(p % 7), float(p % 7 + (p * week) % 3)) for week in range(1, 7) for p in range(400)]
    df = spark.createDataFrame(data, "player_id string, season int, week int, prior_games int, mean5 double, actual double").cache()
    tried = []
    monkeypatch.setattr(forecast, "choose_alpha", lambda train, held, features, outcome, alphas: tried.append(len(alphas)) or alphas[0])
    spec = forecast.Spec(["mean5"], options={"rounds": 1, "rate": 0.3, "trees": 1, "leaf": 30})
    got = forecast.walk_forward(df, None, spec, least_history=1600)
    assert sorted(tuple(r) for r in got.select("season", "week").distinct().collect()) == [(1, 5), (1, 6)]
    assert tried == [20, 20]


def test_choose_alpha_is_the_best_on_held_rows(spark):
    from pyspark.ml.feature import VectorAssembler

    rows = spark.createDataFrame([(float(k % 11), 3.0 * (k % 11) + (k * 7 % 5), k) for k in range(200)], "x double, y double, k int")
    ready = VectorAssembler(inputCols=["x"], outputCol="f").transform(rows)
    train, held = ready.where("k < 150"), ready.where("k >= 150")
    error = lambda a: forecast.fit_ridge(train, "f", "y", a).transform(held).agg(F.avg((F.col("ridge") - F.col("y")) ** 2)).first()[0]
    assert forecast.choose_alpha(train, held, "f", "y", [0.1, 100.0, 1000.0]) == min([0.1, 100.0, 1000.0], key=error)


def test_ablation_against_least_squares(spark):
    """Almost no penalty: the errors are those of least squares on the same columns."""
    rng = random.Random(5)
    rows = [(rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(400)]
    data = [(a, b, c, 3 * a - b + rng.gauss(0, 0.1)) for a, b, c in rows]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(data)], "a double, b double, c double, y double, k int")
    train, test = df.where("k < 300"), df.where("k >= 300")
    got = {(r["kind"], r["group"]): (r["features"], r["mae"]) for r in forecast.ablation(train, test, {"one": ["a"], "two": ["b"], "three": ["c"]}, "y", alpha=1e-6).collect()}

    def mae(cols):
        x = np.array([[1.0, *(r[c] for c in cols)] for r in data])
        y = np.array([r[3] for r in data])
        w = np.linalg.lstsq(x[:300], y[:300], rcond=None)[0]
        return np.abs(x[300:] @ w - y[300:]).mean()

    want = {("add", "one"): [0], ("add", "two"): [0, 1], ("add", "three"): [0, 1, 2], ("drop", "one"): [1, 2], ("drop", "two"): [0, 2], ("drop", "three"): [0, 1]}
    assert set(got) == set(want)
    assert all(got[k] == (len(cols), pytest.approx(mae(cols), rel=1e-3)) for k, cols in want.items())


def test_failure_report_and_evaluation(spark):
    rows = [(k, 2001, w, "P" if k % 2 else "Q", float(k % 7), 3.0, 2.0 + k % 3, 5.0) for k in range(40) for w in (1, 2)] + [(99, 2001, 3, "P", None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "player_id int, season int, week int, position string, y double, points double, a double, b double").withColumns({"low": F.col("points") - 2, "high": F.col("points") + 2})
    got = forecast.failure_report(df, "y", ["a", "b"], "points", worst=3).collect()
    week = [r for r in rows if r[2] == 2]
    one = next(r for r in got if r["section"] == "summary")
    assert (one["n"], one["model_mae"]) == (40, pytest.approx(sum(abs(r[4] - 3) for r in week) / 40)) and one["baseline_mae"] == pytest.approx(sum(abs(r[4] - r[6]) for r in week) / 40)
    assert sum(r["n"] for r in got if r["section"] == "position") == sum(r["n"] for r in got if r["section"] == "tier") == 40
    assert [(r["label"], r["error"]) for r in sorted((r for r in got if r["section"] == "worst"), key=lambda r: int(r["label"]))] == [("0", -3.0), ("6", 3.0), ("7", -3.0)]
    with pytest.raises(ValueError):
        forecast.failure_report(df.where("y is null"), "y", ["a"], "points")
    c = forecast.Candidate("x", "h", ("z",), lambda d: d.withColumn("z", F.lit(1)))
    keys = ["player_id", "season", "week"]
    entry = forecast.evaluate(c, df.withColumn("points", F.col("b")), df, keys, "y").first()
    assert entry["n"] == 80 and entry["candidate"] == "x" and entry["coverage"] == pytest.approx(sum(1 <= r[4] <= 5 for r in rows[:-1]) / 80)
    with pytest.raises(ValueError):
        forecast.evaluate(c, df.limit(0), df, keys, "y")


def test_ewm_over_many_values_and_gaps(spark):
    """More values than a block holds, with nulls between them, against the sum itself."""
    rng = random.Random(2)
    rows = [(e, k, None if rng.random() < 0.2 else rng.uniform(0, 9)) for e in (1, 2) for k in range(30 if e == 2 else 210)]
    got = {(r["e"], r["k"]): r["m"] for r in windows.ewm(spark.createDataFrame(rows, "e int, k int, x double"), ["e"], ["k"], "x", 0.3, 2, "m", block=16).collect()}
    for e, k, _ in rows:
        before = [x for f, j, x in rows if f == e and j < k and x is not None]
        weights = [0.7 ** (len(before) - 1 - i) for i in range(len(before))]
        want = sum(w * x for w, x in zip(weights, before)) / sum(weights) if len(before) >= 2 else None
        assert got[e, k] == (None if want is None else pytest.approx(want, rel=1e-9))
