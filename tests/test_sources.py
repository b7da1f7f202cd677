"""Snapshots, landing, locks and publishing on small files."""

import pytest
from pyspark.sql import functions as F

from panelkit.operators.checks import Check, GateError
from panelkit.sources import landing, sinks, snapshots


def test_newest_snapshot_of_each_season_wins(spark, tmp_path):
    root = f"file://{tmp_path}"
    write = lambda season, day, rows, ddl: spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{root}/stats/season={season}/ingest_date={day}")
    write(1, "2024-01-01", [(1, 5)], "k int, x int")
    write(1, "2024-02-01", [(1, 7.5), (1, 8.5)], "k int, x double")
    write(2, "2024-01-15", [(2, 1)], "k int, x int")
    wanted = spark.createDataFrame([], "k int, x double, extra string").schema
    got = snapshots.latest_snapshot(spark, root, snapshots.Dataset("stats", wanted, True))
    assert sorted((r["season"], r["x"], str(r["_ingest_date"]), r["extra"]) for r in got.collect()) == [(1, 7.5, "2024-02-01", None), (1, 8.5, "2024-02-01", None), (2, 1.0, "2024-01-15", None)]
    with pytest.raises(FileNotFoundError):
        snapshots.latest_snapshot(spark, root, snapshots.Dataset("none"))


def test_registry_refuses_unknown_names():
    r = snapshots.Registry([snapshots.Dataset("a", seasonal=True), snapshots.Dataset("b")])
    assert [(d.name, s) for d, s in r.resolve(None, [1, 2])] == [("a", 1), ("a", 2), ("b", None)]
    with pytest.raises(KeyError):
        r.resolve(["c"], [1])


def test_landing_skips_rejects_and_records(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"x": [1, 2]}), tmp_path / "good.parquet")
    pq.write_table(pa.table({"x": pa.array([], pa.int64())}), tmp_path / "empty.parquet")
    (tmp_path / "bad.parquet").write_bytes(b"no parquet at all")
    files = spark.createDataFrame([(n, f"{tmp_path}/{n}.parquet") for n in ("good", "empty", "bad")] + [("gone", None)], "file_id string, path string")
    none = spark.createDataFrame([], "file_id string, digest string")
    manifest, state = landing.land(files, none)
    assert {r["file_id"]: r["status"] for r in manifest.collect()} == {"good": "ingested", "empty": "failed", "bad": "failed", "gone": "not_available"}
    assert [r["file_id"] for r in state.collect()] == ["good"]
    again, _ = landing.land(files, state)
    assert {r["status"]: r["n"] for r in landing.manifest_counts(again).collect()} == {"ingested": 0, "skipped_unchanged": 1, "not_available": 1, "failed": 2}
    forced, _ = landing.land(files, state, force=True)
    assert forced.where("file_id = 'good'").first()["status"] == "ingested"


def test_landing_copies_a_folder_in_a_fixed_number_of_jobs(spark, tmp_path):
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    for k in range(60):
        pq.write_table(pa.table({"x": list(range(k % 7))}), tmp_path / f"f{k}.parquet")  # every seventh is empty
    (tmp_path / "f60.parquet").write_bytes(b"PAR1 not really PAR1")
    rows = [(f"f{k}", f"{tmp_path}/f{k}.parquet", "stats", k % 3 or None) for k in range(62)]  # f61 does not exist
    files = spark.createDataFrame(rows, "file_id string, path string, dataset string, season int")
    none, lake = spark.createDataFrame([], "file_id string, digest string"), f"{tmp_path}/lake"
    tracker = spark.sparkContext.statusTracker()

    def jobs(some):
        group = f"landing-{some.count()}"
        spark.sparkContext.setJobGroup(group, group)
        out = landing.land(some, none, lake=f"{lake}-{some.count()}", ingest_date="2024-05-01")
        out[0].count()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return out, len(tracker.getJobIdsForGroup(group))

    (_, _), few = jobs(files.limit(3))
    (manifest, state), many = jobs(files)
    assert abs(many - few) <= 3
    status = {r["file_id"]: r["status"] for r in manifest.collect()}
    assert all(status[f"f{k}"] == ("failed" if k % 7 == 0 else "ingested") for k in range(60)) and status["f60"] == "failed" and status["f61"] == "not_available"
    kept = {r["file_id"]: r["landed"] for r in manifest.where("status = 'ingested'").collect()}
    assert kept["f1"].endswith("/stats/season=1/ingest_date=2024-05-01/f1.parquet") and kept["f3"].endswith("/stats/ingest_date=2024-05-01/f3.parquet")
    assert all(pq.ParquetFile(p).metadata.num_rows == int(f[1:]) % 7 for f, p in kept.items())
    left = [f for _, _, names in os.walk(f"{lake}-62") for f in names]
    assert sorted(left) == sorted(os.path.basename(p) for p in kept.values())  # nothing half-way, no failed file
    pq.write_table(pa.table({"x": [9, 9]}), tmp_path / "f1.parquet")
    again, _ = landing.land(files, state, lake=f"{lake}-62", ingest_date="2024-05-02")
    assert {r["status"]: r["n"] for r in landing.manifest_counts(again).collect()} == {"ingested": 1, "skipped_unchanged": 50, "not_available": 1, "failed": 10}


def test_lock_is_written_once(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, x double")
    path = f"file://{tmp_path}/lock"
    assert sinks.load_locked(spark, path) is None
    sinks.lock_once(df, path, ["k", "x"])
    sinks.lock_once(df.orderBy(F.desc("k")).withColumn("x", F.col("x") + 1e-9), path, ["k", "x"])
    with pytest.raises(sinks.Conflict):
        sinks.lock_once(df.withColumn("x", F.col("x") + 1), path, ["k", "x"])


def test_ledger_refuses_a_repeated_entry(spark, tmp_path):
    path, one = f"file://{tmp_path}/ledger", spark.createDataFrame([("e1", 0.1)], "entry_id string, score double")
    sinks.ledger_append(one, path)
    with pytest.raises(sinks.Conflict):
        sinks.ledger_append(one, path)
    assert sinks.ledger_append(one.withColumn("entry_id", F.lit("e2")), path).count() == 2


def test_failed_gate_leaves_what_was_published(spark, tmp_path):
    root, df = f"file://{tmp_path}/site", spark.createDataFrame([(1,)], "x int")
    sinks.publish({"ranks": df}, root, [Check("fine", df.where("x > 5"))])
    with pytest.raises(GateError):
        sinks.publish({"ranks": df.withColumn("x", F.lit(9))}, root, [Check("broken", df)])
    assert sinks.published(spark, root, "ranks").first()["x"] == 1


def test_documents_nest_in_order(spark):
    df = spark.createDataFrame([("p", 1, 2.0), ("p", 2, 3.0), ("q", 1, 5.0)], "e string, week int, s double")
    parts = spark.createDataFrame([("p", 2, "m", 1.0)], "e string, week int, metric string, points double")
    docs = {r["e"]: r["document"] for r in sinks.publish_entity(df, parts, "e", ["week"], ["s"], ["metric", "points"], ["metric"]).collect()}
    assert docs["p"] == '{"e":"p","history":[{"week":1,"s":2.0},{"week":2,"s":3.0}],"breakdown":[{"metric":"m","points":1.0}]}'
    assert docs["q"].endswith('"breakdown":[]}')
    config = spark.createDataFrame([("g", 0.2)], "g string, share double")
    weights = spark.createDataFrame([("g", "b", 1.0), ("g", "a", 2.0)], "g string, metric string, weight double")
    assert sinks.methodology(config, weights, "g", ["metric"], ["metric", "weight"]).first()["document"] == '{"g":"g","share":0.2,"weights":[{"metric":"a","weight":2.0},{"metric":"b","weight":1.0}]}'
