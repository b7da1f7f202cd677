"""Order statistics, tail probabilities, claims, boosting and replay against brute force."""

import os
import re
import threading
from dataclasses import replace as changed

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.functions import distributions
from panelkit.operators import aggs, order_stats, windows
from panelkit.operators.checks import Check
from panelkit.plans import boosting, forecast, ranking, registry, replay, studies
from panelkit.plans.slice import Slice
from panelkit.sources import claims, sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def skewed(spark, n=3000):
    pick = np.random.default_rng(4)
    rows = [("big" if k % 100 else f"g{k % 7}", k, float(pick.integers(0, 400)), None if k % 11 == 0 else float(pick.normal())) for k in range(n)]
    return rows, spark.createDataFrame(rows, "g string, k long, x double, y double").repartition(5)


def test_quantiles_equal_numpy(spark, many_parts):
    rows, df = skewed(spark)
    levels = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {(r["g"], r["column"]): (r["n"], r["values"]) for r in order_stats.quantiles(df, ["g"], ["x", "y"], levels).collect()}
    for g in {r[0] for r in rows}:
        for place, c in ((2, "x"), (3, "y")):
            values = [r[place] for r in rows if r[0] == g and r[place] is not None]
            n, found = got[g, c]
            assert n == len(values) and np.allclose(found, np.quantile(values, levels), rtol=1e-12)
    assert aggs.medians(df, ["x", "y"]).first()["x"] == np.median([r[2] for r in rows])
    empty = order_stats.quantiles(df.where("k < 0"), [], ["x"], [0.5])
    assert empty.collect() == [] and aggs.medians(df.where("k < 0"), ["x"]).first()["x"] is None


def test_ranks_of_one_giant_group_equal_windows_and_are_spread(spark, many_parts):
    _, df = skewed(spark)
    for large, plain in (
        (windows.avg_rank(df, ["g"], "x", "r", large=True), windows.avg_rank(df, ["g"], "x", "r")),
        (windows.percentile_score(df, ["g"], "x", F.lit(True), "r", large=True), windows.percentile_score(df, ["g"], "x", F.lit(True), "r")),
        (windows.rank_rows(df, ["g"], [F.col("x").desc(), F.col("k")], name="r", large=True), windows.rank_rows(df, ["g"], [F.col("x").desc(), F.col("k")], name="r")),
    ):
        key = lambda d: sorted((r["k"], round(float(r["r"]), 12)) for r in d.collect())
        assert key(large) == key(plain)
    parts = order_stats.in_parts(df, ["g", F.col("x").desc(), "k"], "spread").where("g = 'big'").groupBy("__part").count().collect()
    assert len(parts) >= 3 and max(r["count"] for r in parts) < 2000  # 99 % of the rows are one group


def test_tail_probabilities_of_known_values(spark):
    c = lambda x: F.lit(float(x))
    row = spark.range(1).select(
        distributions.p_of_t(c(2.0), c(10)), distributions.p_of_t(c(-1.959963984540054), c(1e6)), distributions.p_of_f(c(3.0), c(2), c(20)), distributions.p_of_chi_square(c(3.841458820694124), c(1)),
        distributions.p_of_chi_square(c(30.0), c(24)), distributions.p_of_r(c(0.5), c(12)), distributions.incomplete_beta(c(0.3), c(2.0), c(3.0)), distributions.p_of_r(c(1.0), c(9)), distributions.p_of_t(F.lit(None).cast("double"), c(3)),
    ).first()
    t = 0.5 * np.sqrt(10 / 0.75)
    s = np.linspace(0, t, 200_001)
    density = (1 + s * s / 10) ** -5.5
    half = np.trapezoid(density, s) / (np.sqrt(10) * 0.8126984126984127)  # B(1/2, 5)
    # closed forms: chi-square with 24 degrees is a Poisson sum; F with 2 and 20 is (1 + x/10)^-10; the beta function of whole numbers a sum
    poisson = sum(np.exp(-15 + k * np.log(15) - sum(np.log(range(1, k + 1)))) for k in range(12))
    want = [0.07338803477074055, 0.05, 1.3**-10, 0.05, poisson, 1 - 2 * half, 0.3483, 0.0]
    assert np.allclose(list(row)[:8], want, atol=1e-6) and row[8] is None, (list(row), want)
    assert abs(row[2] - 1.3**-10) < 1e-12 and abs(row[4] - poisson) < 1e-12 and abs(row[6] - 0.3483) < 1e-12


# ---- records -------------------------------------------------------------------------------------------------------


def test_two_writers_at_one_moment_lock_one_record(spark, tmp_path):
    path, out = f"file://{tmp_path}/lock", []
    frames = [spark.createDataFrame([(k,)], "x int") for k in range(3)]

    def write(df):
        try:
            out.append(("held", sinks.lock_once(df, path, ["x"]).first()["x"]))
        except sinks.Conflict:
            out.append(("conflict", None))

    threads = [threading.Thread(target=write, args=(df,)) for df in frames]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(o for o, _ in out) == ["conflict", "conflict", "held"]
    assert sinks.load_locked(spark, path).first()["x"] == next(x for o, x in out if o == "held")


def test_two_writers_of_one_entry(spark, tmp_path):
    path, out = f"file://{tmp_path}/ledger", []

    def write(k):
        try:
            sinks.ledger_append(spark.createDataFrame([("same", k)], "entry_id string, x int"), path)
            out.append("written")
        except sinks.Conflict:
            out.append("conflict")

    threads = [threading.Thread(target=write, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(out) == ["conflict", "written"] and spark.read.parquet(f"{path}/rows").count() == 1


def test_claims_exclude_expire_and_go(spark, tmp_path):
    path = f"file://{tmp_path}/claim"
    with claims.claimed(spark, path):
        with pytest.raises(claims.Busy), claims.claimed(spark, path, wait=0.1):
            pass
    assert not claims.exists(spark, path)
    assert claims.create_new(spark, path, "dead") and not claims.create_new(spark, path, "late")
    os.utime(tmp_path / "claim", (0, 0))
    with claims.claimed(spark, path, wait=5, expires=60) as mine:
        assert claims.read_text(spark, path) == mine


def test_published_version_is_never_absent(spark, tmp_path, monkeypatch):
    root, one = f"file://{tmp_path}/site", lambda x: {"t": spark.createDataFrame([(x,)], "x int")}
    fine = [Check("fine", spark.range(0))]
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, root, "t")
    sinks.publish(one(1), root, fine)
    monkeypatch.setattr(sinks.claims, "point_to", lambda *a: (_ for _ in ()).throw(OSError("the writer died")))
    with pytest.raises(OSError):
        sinks.publish(one(2), root, fine)
    assert sinks.published(spark, root, "t").first()["x"] == 1
    monkeypatch.undo()
    (tmp_path / "site" / "latest" / "0000000002").touch()  # a pointer whose writer died half-way
    assert sinks.published(spark, root, "t").first()["x"] == 1
    sinks.publish(one(3), root, fine)
    assert sinks.published(spark, root, "t").first()["x"] == 3


def test_lock_only_in_its_window(spark, tmp_path):
    rows, path = spark.createDataFrame([("a", 2.0)], "k string, x double"), f"file://{tmp_path}/locks"
    starts = spark.createDataFrame([(1, 1, "2024-01-10 12:00:00"), (1, 2, None)], "season int, week int, s string").select("season", "week", F.to_timestamp("s").alias("first_start"))
    at = lambda t: F.lit(t).cast("timestamp")
    go = lambda week, t, df=rows: forecast.lock_in_window(df, starts, 1, week, at(t), path, ["k", "x"])
    assert go(1, "2024-01-08 12:00:00")[0] == "preview"
    for week, t in ((2, "2024-01-10 00:00:00"), (1, "2024-01-10 11:45:00"), (3, "2024-01-10 00:00:00")):
        with pytest.raises(forecast.Refused):
            go(week, t)
    assert not (tmp_path / "locks").exists()
    assert go(1, "2024-01-10 00:00:00")[0] == "write"
    later = go(1, "2024-02-01 00:00:00", rows.withColumn("x", F.lit(9.0)))
    assert later[0] == "keep" and later[1].first()["x"] == 2.0


# ---- models --------------------------------------------------------------------------------------------------------


def planted(spark, n=600, seasons=3, seed=1):
    pick = np.random.default_rng(seed)
    rows = []
    for k in range(n * seasons):
        form, other = float(pick.gamma(4, 2.5)), float(pick.normal())
        step = 6.0 if other > 0.5 else 0.0
        rows.append((f"p{k % n}", k // n + 1, k % 12 + 1, 5, max(form + step + float(pick.normal(0, 3)), 0.0), form, None if k % 9 == 0 else other, float(pick.normal()), form))
    return rows, spark.createDataFrame(rows, "player_id string, season int, week int, prior_games int, actual double, a double, b double, c double, mean5 double")


def test_a_tree_is_that_of_an_exhaustive_search(spark):
    pick = np.random.default_rng(8)
    bins, g = pick.integers(0, 5, (80, 3)), pick.normal(0, 1, 80) + 0.0
    g = np.round(g + (bins[:, 1] > 2) * 2 - (bins[:, 0] > 1) * (bins[:, 1] > 2), 3)
    growth = boosting.Growth(leaves=6, least=5)
    df = spark.createDataFrame([(0, [int(x) for x in b], float(v)) for b, v in zip(bins, g)], "__m int, __bins array<int>, __g double")
    tree = boosting.grow(df, 3, {0: growth})[0]

    def split(rows):
        best = None
        for c in range(3):
            for b in range(5):
                low, high = [i for i in rows if bins[i, c] <= b], [i for i in rows if bins[i, c] > b]
                if min(len(low), len(high)) >= 5:
                    gain = sum(g[low]) ** 2 / len(low) + sum(g[high]) ** 2 / len(high) - sum(g[rows]) ** 2 / len(rows)
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, low, high)
        return best

    leaves = [list(range(80))]
    while len(leaves) < 6:
        choice = max(((s[0], k, s) for k, rows in enumerate(leaves) if (s := split(rows))), key=lambda x: x[0])
        leaves[choice[1] : choice[1] + 1] = choice[2][1:]
    want = {i: round(float(np.mean(g[rows])), 9) for rows in leaves for i in rows}
    depth = tree.depth()
    said = df.withColumn("v", F.expr(f"transform(array({tree.sql()}), t -> t.value[{boosting.leaf_of('t', depth)}])[0]")).collect()
    assert [round(r["v"], 9) for r in said] == [want[i] for i in range(80)]


def test_boosting_beats_the_mean_and_quantiles_cover(spark):
    rows, df = planted(spark, 500, 2)
    train, held = df.where("season = 1"), df.where("season = 2")
    growth = boosting.Growth(rounds=15, rate=0.2, leaves=6, least=20, bins=31)
    learn = F.lit(True)
    mean, low, high = boosting.fit_many(train, ["a", "b", "c"], "actual", [(growth, learn), (changed(growth, quantile=0.1), learn), (changed(growth, quantile=0.9), learn)], ["player_id"])
    told = high.score(low.score(mean.score(held, "p"), "lo"), "hi")
    miss, plain, inside, order = told.agg(F.avg(F.abs(F.col("actual") - F.col("p"))), F.avg(F.abs(F.col("actual") - F.lit(np.mean([r[4] for r in rows[:500]])))), F.avg((F.col("actual").between(F.col("lo"), F.col("hi"))).cast("int")), F.avg((F.col("lo") <= F.col("hi")).cast("int"))).first()
    assert miss < 0.7 * plain and 0.68 < inside < 0.9 and order > 0.99
    again = boosting.Boosted.from_rows(mean.as_rows(), mean.features, mean.rate)
    assert sorted(r["p"] for r in again.score(held, "p").collect()) == sorted(r["p"] for r in told.collect())


def test_ridge_of_all_periods_equals_a_fit_of_each(spark):
    rows, df = planted(spark)
    spec = forecast.Spec(["a", "b", "c"])
    got = {(r["season"], r["week"], r["player_id"]): r["points"] for r in replay.ridge_replay(df, spec, least_history=600, least_players=10).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    periods = sorted({r[1:3] for r in rows})
    first_head, checked = None, 0
    for period in periods:
        past = [r for r in order if r[1:3] < period]
        if len(past) < 600:
            continue
        first_head = first_head or period
        head = period if period[0] == first_head[0] else min(p for p in periods if p[0] == period[0])
        of = lambda n: n - (int(n * 0.2) if n >= 1000 and int(n * 0.2) >= 100 else 0)
        cut = of(len(past))
        inner = of(cut)
        early_past = [r for r in order if r[1:3] < head]
        medians = [np.median([r[k] for r in early_past[: of(len(early_past))] if r[k] is not None]) for k in (5, 6, 7)]
        matrix = lambda part: np.array([[r[k] if r[k] is not None else m for k, m in zip((5, 6, 7), medians)] for r in part])
        y = lambda part: np.array([r[4] for r in part])

        def fit(part, alpha):
            x = matrix(part)
            z = (x - x.mean(0)) / x.std(0)
            w = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y(part) - y(part).mean()))
            return lambda rows: (matrix(rows) - x.mean(0)) / x.std(0) @ w + y(part).mean()

        alpha = 10.0 if inner == cut else min((float(np.sum((fit(past[:inner], a)(past[inner:cut]) - y(past[inner:cut])) ** 2)), a) for a in forecast.ALPHAS)[1]
        now = [r for r in order if r[1:3] == period]
        for r, p in zip(now, fit(past[:cut], alpha)(now)):
            assert abs(got[r[1], r[2], r[0]] - max(p, 0.0)) < 1e-6
            checked += 1
    assert checked == len(got) > 500


def test_replay_sees_no_later_row_and_its_ranges_hold(spark):
    rows, df = planted(spark)
    spec = forecast.Spec(["a", "b", "c"], options={"rounds": 4, "rate": 0.3, "leaf": 20, "leaves": 5, "bins": 15})
    keys = ["player_id", "season", "week"]
    of = lambda d: {tuple(r[c] for c in keys): tuple(round(r[c], 6) for c in ("points", "low", "high")) for r in replay.walk_forward(d, spec, least_history=600, least_players=10).collect()}
    plain = of(df)
    moved = of(df.withColumn("actual", F.when((F.col("season") == 2) & (F.col("week") > 6), F.col("actual") + 50).otherwise(F.col("actual"))))
    assert {k: v for k, v in plain.items() if k[1:] <= (2, 7)} == {k: v for k, v in moved.items() if k[1:] <= (2, 7)}
    assert plain != moved
    told = {(r[0], r[1], r[2]): r[4] for r in rows}
    third = [k for k in plain if k[1] == 3]
    assert 0.7 < np.mean([plain[k][1] <= told[k] <= plain[k][2] for k in third]) < 0.92
    assert all(v[1] <= v[2] for v in plain.values())


def test_frozen_control_is_stored_once_and_what_comes_later_does_not_move_it(spark, tmp_path):
    _, df = planted(spark)
    spec, path = forecast.Spec(["a", "b", "c"], options={"rounds": 2, "rate": 0.3, "leaf": 20, "leaves": 4, "bins": 15}), f"file://{tmp_path}/frozen"
    of = lambda m: sorted(r["boost"] for r in m.predict(df.where("season = 3")).collect())
    first = of(replay.frozen_trees(df, 3, path, spec))
    again = of(replay.frozen_trees(df.withColumn("actual", F.col("actual") * 2), 3, path, spec))
    assert first == again
    live = df.where("season = 3").withColumns({"points": F.col("a"), "low": F.col("a") - 9, "high": F.col("a") + 9})
    some = live.where("not (week = 2 and player_id = 'p1')").select("player_id", "season", "week", F.lit(1.0).alias("points"))
    weeks = {r["week"]: r["frozen_mae"] for r in replay.graded_with_control(live, some, ["player_id", "season", "week"], "actual", ["mean5"]).collect()}
    assert weeks[2] is None and all(v is not None for w, v in weeks.items() if w != 2)
    assert replay.control_to_date(replay.graded_with_control(live, some, ["player_id", "season", "week"], "actual", ["mean5"])).first()["learning"] == "no control"


# ---- queries -------------------------------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_every_check_sql_binds():
    con = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    for name, sql in registry.oracle_sql().items():
        try:
            con.execute(f"EXPLAIN {sql}")
        except duckdb.Error as e:
            raise AssertionError(f"{name}: {e}") from e


def test_errors_that_cancel_out_are_no_learned_bias(spark):
    rows = [("a", w, y, 0.0, 1.0, 1.0) for w, y in enumerate((0.1, 0.2, -0.3, 1.0, 0.0))]  # 0.1 + 0.2 - 0.3 is not 0 in doubles
    df = spark.createDataFrame(rows, "e string, w int, y double, p double, short double, long double")
    got = studies.player_learning(df, ["e"], ["w"], "y", "p", ("short", "p", "long")).first()
    assert (got["n"], got["with_bias"], got["with_role_change"]) == (5, 1, 0)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_plays_and_players_are_not_broadcast_however_small_their_files(spark):
    plan = registry.queries()["r02_panel_advanced"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 3 and plan.count("BroadcastExchange") == 2  # the teams' plays and style


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_the_ranking_deals_out_its_rows_twice_and_joins_only_small_sides(spark):
    plan = Slice(spark, SF).ranks._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan  # positions, teams and periods are broadcast
    assert len(re.findall(r"Exchange hashpartitioning\(player_id", plan)) == 1 and len(re.findall(r"Exchange hashpartitioning\(season#\d+, week#\d+, position", plan)) == 1
    assert plan.count(" Sort [season") == 6  # four metrics and two ranks, one sort each


def test_movers_are_found_in_one_pass(spark):
    rows = [(1, p, m, r) for p, (m, r) in enumerate([(3, 4), (3, 2), (1, 9), (0, 1), (-2, 7), (-5, 3), (-2, 5), (None, 6)])]
    df = spark.createDataFrame(rows, "g int, p int, movement int, rank int")
    out = windows.movers(df, ["g"], "movement", "rank", 2)
    assert sorted((r["kind"], r["place"], r["p"]) for r in out.collect()) == [("faller", 1, 5), ("faller", 2, 6), ("riser", 1, 1), ("riser", 2, 0)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_marks_stand_until_the_next_one(spark):
    rows = [("a", 1, 2, "x", 5), ("a", 1, 4, "x", 1), ("b", 1, 1, "y", 2), ("b", 1, 2, "y", 3), ("b", 1, 3, "y", 4), ("b", 2, 7, "y", 9)]
    fact = spark.createDataFrame(rows, "player_id string, season int, week int, team string, v int")
    marks = ranking.cumulative_marks(fact, ["v"], carry=["team"])
    got = sorted(tuple(r) for r in ranking.spread_marks(marks, ["team"], ahead="ahead").select("player_id", "season", "week", "games", "active", "cum_v", "ahead").collect())
    want = [("a", 1, 2, 1, True, 5, False), ("a", 1, 3, 1, False, 5, True), ("a", 1, 4, 2, True, 6, False), ("b", 1, 1, 1, True, 2, True), ("b", 1, 2, 2, True, 5, True), ("b", 1, 3, 3, True, 9, False), ("b", 1, 4, 3, False, 9, False), ("b", 2, 7, 1, True, 9, False)]
    assert got == want


def test_rows_are_not_written_again_for_every_few_trees_and_writing_changes_nothing(spark, monkeypatch):
    _, df = planted(spark, 200, 1)
    growth, learn = boosting.Growth(rounds=6, rate=0.3, leaves=4, least=15, bins=15), F.lit(True)
    models, made = [(growth, learn), (changed(growth, quantile=0.9), F.col("week") < 9)], []
    plain = boosting.stored
    monkeypatch.setattr(boosting, "stored", lambda d, name: made.append(name) or plain(d, name))
    fit = lambda **more: [m.as_rows() for m in boosting.fit_many(df.coalesce(1).repartition(4), ["a", "b", "c"], "actual", models, ["player_id"], **more)]
    once = fit()
    assert len(made) == 2  # what is learned from, and its bins
    for one, other in zip(once, fit(every=2)):
        assert len(one) == len(other) and all(x[:6] == y[:6] and abs(x[6] - y[6]) < 1e-9 for x, y in zip(one, other))
