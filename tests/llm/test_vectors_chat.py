"""Embeddings, components and conversations: brute force on small frames, and odd rows."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.llm import chat, embedding_dedup
from panelkit.llm.components import connected_components


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(170)] + [(900, 900)]
    root = {k: k for pair in links for k in pair}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: find(k) for k in root if any(k in p and p[0] != p[1] for p in links)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(150, 24))
    rows = [v for v in base] + [base[k % 40] + rng.normal(size=24) * 0.05 for k in range(120)] + [base[0]] * 30
    data = [(k, [float(x) for x in v], 1) for k, v in enumerate(rows)]
    odd = [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] + [1.0] * 23, 1), (903, [None] + [1.0] * 23, 1), (904, [], 1), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1), (None, [1.0] * 24, 1)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit("clash")).withColumn("copies", F.lit("clash")).repartition(3)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    assert [got[k]["n_links"] for k in range(len(rows))] == near.sum(1).tolist()
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[k], *(label[j] for j in np.flatnonzero(near[k]))]) for k in range(len(rows))]
    assert [got[k]["component_id"] for k in range(len(rows))] == label
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in (900, 901, 902, 903, 904))
    assert got[905]["n_links"] == 1 and got[906]["component_id"] == 905 and not got[906]["kept"]
    assert got[None]["component_id"] is None
    assert len(got) == len(data) + len(odd)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    """vec_id 1 has two vectors; only one of them has a link, to 2."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.0, -1.0]), (0, [-1.0, 0.0]), (4, [-1.0, 0.0]), (4, [-1.0, 0.0])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 2, 0, True), (1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 2, 0, False), (4, 2, 0, False)]


def test_sketches_bound_the_cosine():
    rng = np.random.default_rng(8)
    unit = rng.normal(size=(300, 48))
    unit[:20, 1:] *= 1e-3
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    coarse, scale, rest = embedding_dedup._sketches(unit)
    about = (coarse.astype(float) * scale[:, None]) @ (coarse.astype(float) * scale[:, None]).T
    assert (np.abs(about - unit @ unit.T) <= rest[:, None] + rest + rest[:, None] * rest + 1e-9).all() and rest.max() < 0.02


def crowded_topic(rows, dims=64, planted=300, within=0.88, pair=0.955):
    """A third of the rows in one topic of mutual cosine 0.88; in it, row k and row planted + k are a pair of 0.955."""
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    topic = unit(rng.normal(size=dims))

    def beside(v):
        v = v - np.outer(v @ topic, topic)
        return unit(v)

    rest = beside(rng.normal(size=(rows // 3, dims)))
    share = 1 - (1 - pair) / (1 - within)
    for k in range(planted):
        side = beside(rng.normal(size=(1, dims)))[0]
        rest[planted + k] = share * rest[k] + np.sqrt(1 - share**2) * unit(side - (side @ rest[k]) * rest[k])
    return np.vstack([np.sqrt(within) * topic + np.sqrt(1 - within) * rest, unit(rng.normal(size=(rows - rows // 3, dims)))])


def test_near_duplicates_in_a_crowded_topic(spark):
    x = crowded_topic(20_000)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(df).collect()}
    want = np.concatenate([(x[at : at + 2000] @ x.T >= 0.95).sum(1) for at in range(0, len(x), 2000)]) - 1
    assert sum(want[:600] > 0) == 600
    assert sum(got.values()) >= 0.99 * want.sum()


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "long answer"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "less"), (2, 3, "assistant", "short"),
    (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (4, 0, "user", "hi"), (4, 1, "assistant", "hello"),
    (5, 0, None, None), (6, None, "user", "alone"), (6, 1, "assistant", ""), (7, 0, "user", "x"), (7, 0, "user", "x"),
]


def test_preferences(spark):
    turns = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash")).withColumn("opening", F.lit("clash"))
    got = {r["pair_id"]: r for r in chat.preference_rows(turns).collect()}
    one = got[1]
    assert (one["chosen_id"], one["rejected_id"], one["n_common"]) == (1, 2, 2)
    assert one["prompt"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n"
    assert one["chosen"] == "<|im_start|>user\nmore<|im_end|>\n<|im_start|>assistant\nlong answer<|im_end|>\n"
    low, high = map(int, one["chosen_mask"].split(":"))
    assert one["chosen"][low:high] == "long answer<|im_end|>\n"
    assert (got[3]["n_common"], got[3]["chosen"], got[3]["rejected"]) == (2, "", "")
    assert got[5]["rejected"] is None and got[5]["chosen"] == "<|im_start|>unknown\n<|im_end|>\n"
    assert got[6]["rejected_id"] is None and got[6]["rejected"] is None and got[6]["chosen_mask"] == "22:33" and got[7]["n_common"] == 1
    assert chat.preference_rows(turns.limit(0)).count() == 0


def test_borrowed_answers(spark):
    rows = [(k, t, r, x) for k in (10, 11, 12) for t, r, x in ((0, "user", f"q{k}"), (1, "assistant", "a" * k), (2, "user", "bye"))]
    got = {r["pair_id"]: r for r in chat.preference_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: r["rejected_id"] for k, r in got.items()} == {10: 11, 11: 10, 12: 11}
    for k, r in got.items():
        assert r["n_common"] == 1 and r["prompt"] == f"<|im_start|>user\nq{k}<|im_end|>\n"
        for side, n in (("chosen", k), ("rejected", r["rejected_id"])):
            assert r[side] == f"<|im_start|>assistant\n{'a' * n}<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n"
            low, high = map(int, r[f"{side}_mask"].split(":"))
            assert r[side][low:high] == "a" * n + "<|im_end|>\n"


MORE = [(k, t, r, f"{r} {k * 7 % 5} {k if t else k % 9}" * (1 + k * t % 4)) for k in range(20, 60) for t, r in enumerate(["user", "assistant", "user", "assistant"][: 1 + k % 4])]


@pytest.mark.parametrize("rows", [ROWS, [*ROWS, *MORE, (None, 0, "user", "stray"), (None, None, None, None), (None, 1, "assistant", "é")]])
def test_preferences_like_sql(spark, rows):
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = chat.preference_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    cols = got.columns
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({chat.PREFERENCE_SQL})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_siblings_pair_up_wherever_their_ids_lie(spark):
    ids = sorted({*range(-3, 4), 4095, 4096, 10**6, 10**12, *range(5000, 5000 + 7 * 4096, 4096)})
    rows = [(k, 0, "user", "hi") for k in ids] + [(k, 1, "assistant", str(k)) for k in ids] + [(8191, 0, "user", "other"), (8192, 0, "user", "other")]
    got = chat.preference_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()
    want = {tuple(ids[k : k + 2]) for k in range(0, len(ids), 2)} | {(8191, 8192)}
    assert {tuple(sorted(x for x in (r["chosen_id"], r["rejected_id"]) if x is not None)) for r in got} == want
    assert {r["pair_id"] for r in got} == {min(p) for p in want} and len(got) == len(want)
    assert all(r["n_common"] == 1 for r in got if r["pair_id"] != r["rejected_id"])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_given_conversations_form_pairs(spark):
    got = chat.preference_rows(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")).collect()
    real = [r for r in got if r["rejected"] is not None and r["n_common"] > 0 and r["chosen_mask"] and r["rejected_mask"]]
    answered = [r for r in got if "assistant\n" in r["prompt"] + r["chosen"]]
    assert len(real) >= 0.95 * len(answered) > 0.7 * len(got) and any(r["chosen"] != r["rejected"] for r in real)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_native_operators_have_no_python_in_their_plans(spark):
    from panelkit.llm.queries import QUERIES

    for name in ("op2_mixing_sources", "op5_chat_formatting", "op9_sharding"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
