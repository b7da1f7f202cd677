"""Conversation repair, hard negatives and personal data against brute force and on odd rows."""

import hashlib
import itertools
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelkit.llm import hard_negatives, private_spans, repair

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def same_as_sql(df, table, sql, path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    cols = ", ".join(df.columns)
    want = con.execute(f"SELECT {cols} FROM ({sql})").fetchall()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)


# ---- conversation repair -------------------------------------------------------------------------------------------

LEGAL = re.compile(r"(s?(ua)+)?")
TO = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """All edit strings with at most two new turns between rows, tried one by one."""
    best = None

    def go(k, roles, cost, audit, news):
        nonlocal best
        if best and (cost, audit) >= best and cost > best[0]:
            return
        if k == len(rows) and LEGAL.fullmatch(roles):
            best = min(best, (cost, audit)) if best else (cost, audit)
        if news < 2:
            go(k, roles + TO[roles[-1:]], cost + 2, audit + "I", news + 1)
        if k < len(rows):
            initial, fault = rows[k]
            go(k + 1, roles, cost + 3, audit + "D", 0)
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                if LEGAL.fullmatch(roles + initial) or LEGAL.fullmatch(roles + initial + "a") or roles + initial == "s":
                    go(k + 1, roles + initial, cost + late, audit + "K", 0)
                go(k + 1, roles + TO[roles[-1:]], cost + 2 + late, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from(["", "blank", "duplicate", "truncated"])), max_size=5))
def test_walk_gives_the_least_cheapest_edits(rows):
    state, audit = 0, ""
    for edits, state in repair.walk([(i, f, 1) for i, f in rows], repair.AT_END, 0):
        audit += edits
    audit += repair.tail(state)
    cost = 3 * audit.count("D") + 2 * (audit.count("R") + audit.count("I"))
    at = [e for e in audit if e != "I"]
    cost += sum(f == "truncated" and e != "D" for (_, f), e in zip(rows, at))
    assert (cost, audit) == cheapest(rows)


def told(rows):
    """A conversation's row by the rules, in Python, with the edits of one walk over all rows."""
    out = []
    for turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        h = zlib.crc32(f"{rows.name}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [] if h == 0 else [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in out:
        bare = text.strip(repair.WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    plain = [(role[:1], f, 1) for (_, role, _), f in zip(out, faults)]
    state, before, audit, said = 0, 0, "", []
    for (edits, state), (_, role, text) in zip(repair.walk(plain, repair.AT_END, 0), out):
        for e in edits:
            if e != "D":
                to = repair.KEEP_TO[role[:1]][before] if e == "K" else repair.TURN_TO[before]
                said.append(f"{role if e == 'K' else repair.TURN_ROLE[before]}:{'' if e == 'I' else text}")
                before = to
        audit += edits
    for e in repair.tail(state):
        said.append(f"{repair.TURN_ROLE[before]}:")
        before = repair.TURN_TO[before]
        audit += e
    turns = {t for t, _, _ in out if t is not None}
    kept = sum(f == "truncated" and e != "D" for f, e in zip(faults, [e for e in audit if e != "I"]))
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(out))
    cost = 3 * audit.count("D") + 2 * (audit.count("R") + audit.count("I")) + kept
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


class Rows(list):
    name = ""


def conversation_rows(seed, n):
    pick = random.Random(seed)
    out = Rows()
    for k in range(n):
        turn = None if pick.random() < 0.03 else k + pick.randrange(3) * 5
        out.append((turn, pick.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]), pick.choice(["Yes.", "Yes.", "And so", "", " \t", None, "What?\n", f"{k}!", f"half {k}"])))
    return out


@pytest.mark.parametrize("split", [False, True])
def test_repair_against_brute_force_also_when_conversations_lie_in_several_parts(spark, split):
    whole, rows = {}, []
    for conv, n in {1: 900, 2: 3, 3: 1, 4: 700, None: 40, 6: 12, 7: 5, 8: 0}.items():
        whole[conv] = conversation_rows(n, n)
        whole[conv].name = " " if conv is None else str(conv)
        rows += [(conv, *r, "x") for r in whole[conv]]
    rows += rows[:5]  # repeated rows
    whole[1] += whole[1][:5]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(not split).lower())
    try:
        got = {r["conv_id"]: tuple(r)[1:] for r in repair.repaired_conversations(df).collect()}
        if split:
            ordered = repair.in_order(repair.damaged(df))
            assert ordered.where("conv_id = 1").select("part").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {conv: told(r) for conv, r in whole.items() if r}


def test_repair_of_nothing_of_dropped_and_of_very_long_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert repair.repaired_conversations(spark.createDataFrame([], schema)).collect() == []
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    fine = next(k for k in range(1000) if all(zlib.crc32(f"{k}:{t}".encode()) % 20 > 4 for t in (0, 1)))
    long = "word " * 400_000 + "end."
    got = {r["conv_id"]: r for r in repair.repaired_conversations(spark.createDataFrame([(gone, 0, "user", "Hi."), (fine, 0, "user", long), (fine, 1, "assistant", "Yes.")], schema)).collect()}
    assert tuple(got[gone])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[fine]["audit"] == "KK" and got[fine]["repaired_sha256"] == hashlib.sha256(f"user:{long}\nassistant:Yes.".encode()).hexdigest()


def test_repair_holds_a_square_root_of_vectors(monkeypatch):
    calls = []
    plain = repair._before
    monkeypatch.setattr(repair, "_before", lambda *a: calls.append(1) or plain(*a))
    rows = [("u" if k % 3 else "a", "", 1) for k in range(10_000)]
    assert len(list(repair.walk(rows, repair.AT_END, 0))) == 10_000
    assert len(calls) == 20_000  # each vector twice: once backward, once in its block


@tables
def test_repair_same_as_sql(spark):
    path = f"{SF}/conversations.parquet"
    same_as_sql(repair.repaired_conversations(spark.read.parquet(path)), "conversations", repair.REPAIRED_SQL, path)


# ---- hard negatives ------------------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(1, 6), st.sampled_from([1, 200, 10**5, 10**7, 2.0**60, 2.0**100]), st.integers(0, 10**6))
def test_packed_products_are_exact(a, n, dims, size, seed):
    pick = np.random.default_rng(seed)
    x, y = (np.floor(pick.uniform(-size, size, (k, dims))) for k in (a, n))
    want = [[min(max(sum(int(p) * int(q) for p, q in zip(u, v)), hard_negatives.ENDS[0]), hard_negatives.ENDS[1]) for v in y] for u in x]
    assert hard_negatives.inner_products(x, y).tolist() == want


def test_two_or_more_candidates_share_a_word_of_the_given_vectors():
    x = np.floor(np.random.default_rng(1).normal(0, 32, (50, 64)))
    width = (int(np.abs(x).sum(1).max()) * int(x.max() - x.min())).bit_length() + 2
    assert 52 // width >= 2


def mined(rows, k=5):
    """anchor, positive, rank, negative, scores by plain loops. rows: (id, vec, label), ids distinct."""
    fine = [(i, [int(np.floor(np.float64(x) * 256)) for x in v], ((g + 1) % 10 if i % 7 == 0 else g)) for i, v, g in rows if i is not None and g is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, v, g in (r for r in fine if r[0] % 100 == 0):
        scored = [(-sum(a * b for a, b in zip(v, w)), j, h == g) for j, w, h in fine if j != i and len(w) == len(v)]
        for p, j, _ in sorted(s for s in scored if s[2])[:k]:
            near = sorted(s for s in scored if not s[2] and -80 * p <= -100 * s[0] <= -100 * p)[:k]
            out |= {(i, j, r + 1, m, -p, -q) for r, (q, m, _) in enumerate(near)}
    return out


def test_hard_negatives_against_loops(spark):
    pick = np.random.default_rng(5)
    centre = pick.normal(0, 1, 6)
    rows = []
    for k in range(420):
        v = [float(np.float32(x)) for x in centre + pick.normal(0, 0.6, 6)]
        rows.append([k, v, int(pick.integers(0, 3)) if k % 3 else 1])
    for k in (3, 9, 12):
        rows[k][1] = rows[201][1]  # ties
    rows[40][1], rows[41][1], rows[42][1], rows[43][2], rows[44][1] = None, [1.0, None] + [0.0] * 4, [float("nan")] + [0.0] * 5, None, [float("inf")] * 6
    rows[45][1], rows[300][1], rows[46][1], rows[47][1] = [1.0, 2.0], [2.0, 1.0], [], [1e30] * 6
    rows += [[None, rows[0][1], 1], [-100, rows[7][1], 2]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, score string")
    got = [tuple(r) for r in hard_negatives.mined(df).collect()]
    assert len(got) == len(set(got)) and set(got) == {tuple(map(int, r)) for r in mined([(i, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None, g) for i, v, g in rows])}
    assert hard_negatives.mined(df.limit(0)).collect() == []
    tiles = hard_negatives.TILE_ROWS
    try:
        hard_negatives.TILE_ROWS = 3  # many tiles on either side give the same
        assert {tuple(r) for r in hard_negatives.mined(df).collect()} == set(got)
    finally:
        hard_negatives.TILE_ROWS = tiles


def test_hard_negatives_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (1, [1.0, 0.1], 1), (2, [0.9, 0.0], 2), (2, [0.9, 0.0], 2)]
    got = sorted(tuple(r)[:4] for r in hard_negatives.hard_negatives(hard_negatives.mining_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), hard_negatives.F.col("id") == 0).collect())
    assert got == [(0, 1, 1, 2), (0, 1, 1, 2), (0, 1, 2, 2), (0, 1, 2, 2)]


@tables
def test_hard_negatives_same_as_sql(spark):
    path = f"{SF}/embeddings.parquet"
    same_as_sql(hard_negatives.mined(spark.read.parquet(path)), "embeddings", hard_negatives.MINED_SQL, path)


# ---- personal data -------------------------------------------------------------------------------------------------

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def passes(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in hit.split(".")), "phone": 9 <= len(digits) <= 15}[kind]


def base_spans(text):
    found = sorted((m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PLAIN.items()) for m in p.finditer(text or "") if passes(kind, m[0]))
    return [sum(kind == x[2] for x in found) for kind in PLAIN], [f"{kind}:{a}:{b}" for a, _, kind, b in found]


def agree(spark, texts):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in private_spans.private_spans(df).collect()}
    for k, t in enumerate(texts):
        n, spans = base_spans(t)
        r = got[k]
        assert [r[f"n_{kind}"] for kind in PLAIN] == n, t and t[:200]
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), t and t[:200]
        assert set(spans) <= set(r["spans"].split(",")) | {""}
        starts = [int(s.split(":")[1]) for s in r["spans"].split(",") if s]
        assert starts == sorted(starts)
    return got


def test_base_spans_against_plain_patterns(spark):
    pick = random.Random(3)
    bits = ["a@b.c", "_d@e.f", "x.y+z%@m-1.co.uk", "@", ".", "..", "1.2.3.4", "256.1.1.1", "001.02.3.0255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "0" * 14, "+1 (988) 555-2485", "+12", "+1-", "++49 30 1234567", " ", "  ", "-", "é", "😀", "\n", "7", "12", "(at)", "@x", "a_b", "+", "٣"]
    texts = ["".join(pick.choice(bits) for _ in range(pick.randrange(1, 12))) for _ in range(300)] + [None, "", " "]
    got = agree(spark, texts + texts[:3])
    assert got[300]["spans"] == got[301]["spans"] == "" and got[300]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_base_spans_of_very_long_texts(spark):
    """The plain patterns would take the square of these lengths, so what is expected is stated."""
    n = 100_000
    texts = {"a" * 3 * n: "", "a@b." + "a." * n + " ": f"email:0:{2 * n + 3}", "1" * 2 * n: "", "1 " * n + "x": "", "+1" + " " * n: "", "4111111111111111 " + "b" * n: "card:0:16"}
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, "a@b.co " * 5000])], "doc_id int, text string")
    got = {r["doc_id"]: r for r in private_spans.private_spans(df).collect()}
    assert [got[k]["spans"] for k in range(len(texts))] == list(texts.values())
    assert got[len(texts)]["n_email"] == 5000 and got[len(texts)]["spans"].endswith("email:34993:34999")


def test_labelers_are_weighed_and_spans_are_added(spark):
    pick = random.Random(1)

    def card():
        body = [4] + [pick.randrange(10) for _ in range(14)]
        last = next(d for d in range(10) if passes("card", "".join(map(str, [*body, d]))))
        return "".join(map(str, [*body, last]))

    two = f"{card()} {card()}"  # 32 digits in a row: no base span
    wrong = card()
    wrong = wrong[:-1] + str((int(wrong[-1]) + 1) % 10)
    texts = [f"some words {card()} and more" for _ in range(200)] + [f'token = "a{wrong}f"' for _ in range(60)] + [f"pay with {two} now", f"plain {wrong} number", "write to joe (at) mail.example (dot) com today"] + [f"mail ann.{k}@mail{k}.example.com for it" for k in range(60)]
    got = agree(spark, texts)
    assert got[260]["spans"] == "card:9:25,card:26:42" and got[260]["n_card"] == 0
    assert got[261]["spans"] == ""
    assert all(got[k]["spans"] == "" for k in range(200, 260))
    assert got[0]["spans"] == "card:11:27"


def test_reliabilities_find_the_bad_labeler(spark):
    pick = random.Random(2)
    rows = []
    for _ in range(4000):
        truth = pick.random() < 0.4
        say = lambda right: int(truth) if pick.random() < right else 1 - int(truth)
        rows.append((2, say(0.95), say(0.9), say(0.9), -1 if pick.random() < 0.5 else say(0.9), say(0.55)))
    patterns = spark.createDataFrame(rows, "kind int, v0 int, v1 int, v2 int, v3 int, v4 int").groupBy("kind", *(f"v{k}" for k in range(5))).count().withColumnRenamed("count", "n")
    prior, hit, false = private_spans.reliabilities(patterns)
    assert abs(prior[2] - 0.4) < 0.05 and prior[0] == 0.5
    assert hit[2][0] > 0.9 and false[2][0] < 0.1 and hit[2][4] < 0.65 and false[2][4] > 0.35


def test_no_python_workers_in_private_spans(spark):
    df = spark.createDataFrame([(1, "a@b.com")], "doc_id long, text string")
    plan = private_spans.candidates(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert private_spans.private_spans(df.limit(0)).collect() == []
