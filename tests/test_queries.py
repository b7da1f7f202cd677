"""Registered queries against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from panelkit.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
QUICK = ["ranking_slice", "r10_feature_store", "b03_score_groups", "j04_membership_join", "j06_j07_full_merge", "a14_lift", "a22_worst_share", "w12_w15_trailing", "w19_ewm", "o06_chrono_split", "q01_q07_checks", "f03_f04_f14_times", "m20_m22_grading", "x03_heterogeneity"]


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)
    return f"{float(value) + 0.0:.5f}"


STAGING = ["r12_stage_games", "r13_stage_players", "r13_stage_stats", "r14_stage_rosters", "r14_stage_snaps", "r15_stage_participation", "r16_stage_advstats", "r17_stage_tracking", "r18_stage_charting", "r18_stage_plays", "r18_stage_injuries", "r02_panel_advanced", "p04_j08_j18_inner"]
STORES = ["s04_read_seed", "s07_manifest_counts", "s09_materialize", "s14_publish_entity", "s16_methodology", "q16_gate"]


@pytest.mark.parametrize("name", QUICK + STAGING + STORES)
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = registry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({registry.oracle_sql()[name]})").fetchall()
    rows = sorted(tuple(map(plain, r)) for r in got.select(*cols).collect())
    assert rows == sorted(tuple(map(plain, r)) for r in want)


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.queries()) > 110


def test_trailing_windows_share_one_exchange(spark):
    from panelkit.operators import windows

    df = spark.range(100).selectExpr("id % 5 AS e", "id div 10 AS season", "id AS week", "id AS x")
    out = windows.trailing(df, ["e"], ["season", "week"], {f"m{n}": ("avg", "x", n) for n in (3, 5, 8, 10)} | {"all": ("avg", "x", None)})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "NestedLoop" not in plan and "Python" not in plan
