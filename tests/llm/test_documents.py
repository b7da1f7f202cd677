"""Operators on documents: brute force on small frames, and odd rows - nulls, empty and long texts, repeats, no rows,
columns whose names clash."""

import hashlib
import random
import tarfile
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelkit.llm import lm, media, mixing, ngram_join, packing, quality, sharding, toxicity
from panelkit.llm.labelled import labelled_sample
from panelkit.llm.queries import WORD_BPE

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(3)
SYLLABLES = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
WORDS = ["".join(RNG.choices(SYLLABLES, k=RNG.randint(1, 3))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choices(WORDS, k=n))


def odd_rows():
    base = prose(60)
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, base, "en", "a", 1), (4, base, "en", "b", 1), (5, base + " zusatz", "de", "\U0001f600", 1), (6, prose(6000), "en", "a", 1), (7, " \t\n ", "en", "b", 3), (None, prose(20), "fr", "a", 1), (9, "Ünï <|endoftext|> don't \x1c x y É́!", "fr", "b", 1), (10, "one two", "en", "c", 1)]
    return rows + [rows[3]]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    # names that operators use inside, and names of their results
    for name in ("score", "set", "row", "size", "digest", "payload", "block", "label", "shard", "rank"):
        df = df.withColumn(name, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(9)
    rows = []
    for k in range(300):
        words = rng.choices(WORDS, k=rng.choice([3, 12, 40, 150, 400]))
        rows.append((k, " ".join(words), "en", rng.choice(["s0"] * 6 + ["s1", "s2", "s3", None]), 1))
        if k % 6 == 0 and len(words) > 20:
            for j in range(rng.choice([1, 2, 8])):
                near = list(words)
                for _ in range(rng.choice([0, 1, 2, 6])):
                    near[rng.randrange(len(near))] = "neu" + str(rng.random())
                rows.append((1000 + 20 * k + j, " ".join(near).upper() if j % 2 else " ".join(near), "en", "s0", 1))
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def packed(df):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    rows = packing.pack_documents(df, WORD_BPE, capacity=64).collect()
    want = Counter()
    for name, text in texts(df):
        ids = np.array(tok.encode(text, add_special_tokens=False).ids + [0], "<u4")
        for p, at in enumerate(range(0, len(ids), 64)):
            want[(name, p, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    return len(bins), sum(r["length"] for r in rows)


def test_packing(odd, none, many):
    packed(odd)
    n, total = packed(many)
    assert n <= 1.02 * total / 64 + 2
    assert packing.pack_documents(none, WORD_BPE).count() == 0


def test_packing_of_texts_that_hold_special_strings(spark):
    texts = ["hello <|endoftext|> x", "a<|endoftext|>b's <|startoftext|>", "<|ENDOFTEXT|> <|endoftext", "<|endoftext|><|endoftext|>!", "it's 12 don't. x\u00a0y \u0301e ＡＢ", "<|endoftext|>" * 40]
    packed(spark.createDataFrame([(k, t, "en", "a", 1) for k, t in enumerate(texts)], SCHEMA))


def test_packing_with_another_tokenizer_file(spark, tmp_path):
    import json

    from tokenizers import Tokenizer

    shape = json.load(open(WORD_BPE, encoding="utf-8"))
    shape["pre_tokenizer"]["pretokenizers"][0] = {"type": "Split", "pattern": {"Regex": ".+"}, "behavior": "Removed", "invert": True}
    path = f"{tmp_path}/other.json"
    json.dump(shape, open(path, "w", encoding="utf-8"))
    texts = ["Hello world, it's", "", None, "a b  c"]
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, with_ids=True).collect()
    tok = Tokenizer.from_file(path)
    assert {r["doc_id"]: r["ids"] for r in rows} == {k: tok.encode(t or "", add_special_tokens=False).ids + [0] for k, t in enumerate(texts)}


def test_runs_of_letters_go_to_the_tokenizers_model_alone():
    """With normalizer and pre-tokenizer, each rare word cost four times as much."""
    held = packing.WordIds(WORD_BPE)
    whole, given = held.tokenizer, []

    class Noted:
        model = whole.model

        def encode(self, words, **how):
            given.extend(words)
            return whole.encode(words, **how)

    held.tokenizer = Noted()
    letters = [c for c in map(chr, range(0xC0, 0x100)) if c.isalpha()]
    rng = random.Random(5)
    rare = ["".join(rng.choices(letters + list("abcdefghijKLMNOP"), k=rng.randint(1, 9))) + rng.choice(["", ",", ".)", "!?", "'s", "-x", "\u0301"]) for _ in range(3000)]
    texts = [" ".join(rare[k : k + 7]) for k in range(0, 3000, 7)] + ["", "  ", "\u00ff\u00df \u01c5 \u0130 \ufb01 \u00aa a\u00d7b", "\x1c a\x1fb\n"]
    got = [ids.tolist() for ids in packing.token_rows(pa.array([*texts, None]), held)]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in [*texts, ""]]
    assert given and not any(set(w.lower()) <= {*letters, *"abcdefghijklmnop"} for w in given)


@pytest.mark.parametrize("added", ["hello", "hello!", "a b"])
def test_packing_with_an_added_token_that_words_would_hide(tmp_path, added):
    """Of letters, or across a cut: these are looked for before letters are lower-cased and words are split."""
    import json

    from tokenizers import Tokenizer

    shape = json.load(open(WORD_BPE, encoding="utf-8"))
    shape["added_tokens"].append(shape["added_tokens"][-1] | {"id": 49408, "content": added})
    path = f"{tmp_path}/added.json"
    json.dump(shape, open(path, "w", encoding="utf-8"))
    texts = ["Hello hello! xhello, HELLO!! a b", "oh hello!? a  b"]
    tok = Tokenizer.from_file(path)
    assert [ids.tolist() for ids in packing.token_rows(pa.array(texts), packing.WordIds(path))] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("top", [100, 60, 30])
def test_best_fit_takes_the_tightest_sequence(top):
    rng = random.Random(top)
    sizes = [rng.randint(1, top) for _ in range(700)] + [10] * 300 + [100]
    rooms, want = [], Counter()
    for size in sorted(sizes, reverse=True):
        fits = [(room, b) for b, room in enumerate(rooms) if room >= size]
        if not fits:
            rooms.append(100)
            fits = [(100, len(rooms) - 1)]
        room, at = min(fits)
        want[size, 100 - room] += 1
        rooms[at] -= size
    held, got = defaultdict(list), Counter()
    ranks = defaultdict(list)
    for length, rank, many, sequence, each, offset in packing.best_fit_decreasing(Counter(sizes), 100):
        for i in range(many):
            at = offset + i % each * length
            got[length, at] += 1
            held[sequence + i // each].append((at, length))
            ranks[length].append(rank + i)
    assert got == want and len(held) == len(rooms)
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values())
    for pieces in held.values():
        assert [at for at, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:k]) for k in range(len(pieces))]


def test_sharding(odd, none, many):
    for df in (odd, many):
        rows = sharding.shuffle_to_shards(df, shards=7, rows_per_task=40).collect()
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((k, len(t.encode()) + 1, zlib.crc32(t.encode())) for k, t in texts(df))
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        sizes = [len(slots[s]) for s in range(7)]
        assert max(sizes) - min(sizes) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = sharding.shuffle_to_shards(many, shards=7, rows_per_task=40).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}
    assert sharding.shuffle_to_shards(none).count() == 0


def test_hypergeometric_law(spark):
    """Quantiles of the draw against the law summed in Python."""
    from math import comb

    good, bad, draws = 7, 13, 6
    law = [comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws) for k in range(7)]
    us = [0.001, 0.1, 0.35, 0.5, 0.77, 0.93, 0.9999]
    df = spark.createDataFrame([(u,) for u in us], "u double")
    lit = lambda n: F.lit(n).cast("bigint")
    got = [r[0] for r in df.select(sharding.hypergeometric(F.col("u"), lit(good), lit(bad), lit(draws))).collect()]
    assert got == [int(np.searchsorted(np.cumsum(law), u)) for u in us]


def test_mixing(odd, none, many):
    for df in (odd, many):
        mix = mixing.mix_sources(df, block=16, rows_per_task=50)
        rows = mixing.mixed_documents(mix).collect()
        assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((k, len(t.encode().split())) for k, t in texts(df))
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
        taken, target, size = Counter(), {}, Counter()
        for r in rows:
            taken[r["source"]] += r["taken"]
            size[r["source"]] += r["size"]
            target[r["source"]] = r["target"]
        assert all(abs(taken[s] - target[s]) <= 4 * 16 and target[s] <= 2 * size[s] + 1e-6 for s in target)
        assert abs(sum(taken.values()) - sum(target.values())) <= 4 * 16
        assert all((r["first_slot"] is None) == (r["taken"] == 0) for r in rows)
        assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
        free = {s: target[s] / w for s, w in zip(sorted((s for s in target), key=lambda s: (s is None, s or "")), [3, 1, 2] * 9) if target[s] < 2 * size[s] - 1e-6}
        assert not free or max(free.values()) - min(free.values()) < 1e-6 * max(free.values())
    again = mixing.mixed_documents(mixing.mix_sources(many, block=16, rows_per_task=50)).collect()
    assert {(r["doc_id"], r["taken"]) for r in again} == {(r["doc_id"], r["taken"]) for r in rows}
    assert mixing.mixed_documents(mixing.mix_sources(none)).count() == 0
    assert mixing.take_whole(odd).columns == odd.columns
    whole = Counter(r["doc_id"] for r in mixing.take_whole(many, block=16).collect())
    assert all(whole[r["doc_id"]] == 0 for r in mixing.mixed_documents(mixing.mix_sources(many, block=16)).where("taken = 0").collect())


def test_the_schedule_decides_what_is_taken(many, monkeypatch):
    full = mixing.mixed_documents(mixing.mix_sources(many, block=16)).agg(F.sum("taken")).first()[0]
    slots = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda *a: slots(*a).where("slot % 2 = 0"))
    half = mixing.mixed_documents(mixing.mix_sources(many, block=16)).agg(F.sum("taken")).first()[0]
    monkeypatch.setattr(mixing, "schedule", lambda *a: slots(*a).where("false"))
    assert mixing.mixed_documents(mixing.mix_sources(many, block=16)).agg(F.sum("taken")).first()[0] == 0 and mixing.take_whole(many, block=16).count() == 0
    assert abs(half - full / 2) < 0.02 * full


def test_slots_are_golden_ratio_points(many):
    mix = mixing.mix_sources(many, block=16)
    targets = {r["number"]: r["target"] for r in mix.sources.collect()}
    total, upto, spans = sum(targets.values()), 0.0, {}
    for k in sorted(targets):
        spans[k], upto = (upto / total, (upto + targets[k]) / total), upto + targets[k]
    n = -(-int(total) // 16)
    want, seen = set(), Counter()
    for i in range(n):
        point = (i + 1) * mixing.GOLDEN % 1.0
        k = next(k for k, (low, high) in spans.items() if low <= point < high)
        want.add((k, seen[k], i))
        seen[k] += 1
    assert {(r["number"], r["rank"], r["slot"]) for r in mixing.schedule(mix.sources, 16, n).collect()} == want
    assert all(abs(seen[k] - n * targets[k] / total) <= 3 for k in targets)


def test_golden_points_are_even_at_any_slot(spark):
    step, modulus = mixing.FIBONACCI
    for first in (0, 10**12, modulus - 10**5):
        rows = spark.range(first, first + 50_000).select("id", mixing.golden_point(F.col("id")).alias("point")).collect()
        assert all(r["point"] == (r["id"] + 1) * step % modulus / modulus for r in rows) and len({r["point"] for r in rows}) == 50_000
        assert abs(sum(r["point"] < 1e-3 for r in rows) - 50) <= 3


def test_labelled_rows_are_bounded_by_rows(spark):
    docs = spark.range(500).select(F.when(F.col("id") < 400, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality")).distinct()
    got = labelled_sample(docs, labels, "quality", rows=60).collect()
    assert len(got) == 60 and len({r["text"] for r in got}) == 60
    assert sorted(got) == sorted(labelled_sample(docs, labels, "quality", rows=60).collect())
    assert labelled_sample(docs, labels, "quality", rows=1000).count() == 500


def test_media(odd, none, spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "shard-000000-0000-999.tar").write_bytes(b"of an attempt that failed")
    root = f"file://{tmp_path}/m"
    rows = media.media_columns(odd, root).collect()
    assert {r["root"] for r in rows} == {root} and {p.name for p in (tmp_path / "m").glob("shard*")} == {r["shard"] for r in rows}
    for r in rows:  # the shards are there, and are tar files whose members have the digests as names
        with open(f"{tmp_path}/m/{r['shard']}", "rb") as f:
            f.seek(r["offset"])
            assert hashlib.sha256(f.read(r["length"])).hexdigest() == r["media_sha256"]
    for shard in {r["shard"] for r in rows}:
        with tarfile.open(f"{tmp_path}/m/{shard}") as f:
            assert {m.name for m in f} >= {f"{r['digest']}.png" for r in rows if r["shard"] == shard}
    want = Counter()
    for name, text in texts(odd):
        raw = text.encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        want[(name, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
    assert all(r["width"] * r["height"] == r["payload_bytes"] and r["digest"] == r["payload_sha256"] for r in rows)
    assert len({(r["digest"], r["shard"], r["offset"], r["media_sha256"], r["feature"]) for r in rows}) == len({r["digest"] for r in rows})
    assert media.media_columns(none, f"file://{tmp_path}/n").count() == 0


def components(df, n, percent):
    sets = defaultdict(set)
    for name, text in texts(df):
        words = text.encode().lower().split()
        sets[name] |= {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_ngram_join_against_brute_force(odd, many, n, percent):
    for df in (odd.where("doc_id is not null"), many):
        got = ngram_join.jaccard_join(df, n, percent, block_sets=5).collect()
        want = components(df, n, percent)
        assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(k, *v) for k, v in want.items()}
    assert len({v[1] for v in want.values()}) < len(want)


def test_ngram_join_odd_rows(odd, none):
    got = ngram_join.jaccard_join(odd).collect()
    assert len(got) == odd.count()
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 7)} == {1, 2, 7}
    assert ngram_join.one_of_each(odd).columns == odd.columns
    assert ngram_join.jaccard_join(none).count() == 0


def test_signatures_are_shared_by_every_linked_pair():
    rng = np.random.default_rng(4)
    for sketch in (np.zeros(64, np.uint32), rng.integers(0, 9, 64).astype(np.uint32)):
        for size in (1, 2, 5, 7, 12, 30, 77, 200, 900):
            for _ in range(30):
                a = np.unique(rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2) + np.uint64(1))
                k = ngram_join._differ(len(a), 80)
                drop = int(rng.integers(0, k // 2 + 1))
                b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, k // 2 - drop if k // 2 > drop else 0, np.uint64) * np.uint64(2)]))
                both = len(np.intersect1d(a, b))
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    sent = [{x for found, keep in ngram_join.signatures(s, 80) for x in ngram_join.rarest(found, keep, sketch).tolist()} for s in (a, b)]
                    assert sent[0] & sent[1]


def test_counting_sketch(many):
    first = ngram_join.shingled(many, "doc_id", "text", 4, 85).cache()
    want = np.zeros(ngram_join.SKETCH, np.int64)
    for r in first.where("signatures is not null").collect():
        np.add.at(want, np.array(r["signatures"], np.int64).view(np.uint64) % ngram_join.SKETCH, 1)
    assert (ngram_join.counting_sketch(first) == want).all() and want.sum() > 0


@pytest.mark.parametrize("most", [1, 7, 40, 700, 2_500, 10_000])
def test_lm_head_is_exact_and_full(spark, most):
    """Also where the commonest count, or one count of thousands of words, has more words than the head may hold."""
    n = {f"w{i}": 1 if i >= 400 else 5 if i >= 200 else 100 + i for i in range(3000)}
    counts = spark.createDataFrame(list(n.items()), "word string, n long")
    got = [r["word"] for r in lm.head_counts(counts, most).collect()]
    assert len(got) == len(set(got)) == min(most, 3000)
    assert sorted((n[w] for w in got), reverse=True) == sorted(n.values(), reverse=True)[:most]
    assert set(got) == {r["word"] for r in lm.head_counts(counts.repartition(5), most).collect()}


def test_lm_start_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "word " * (1 + i % 50)) for i in range(2000)] + [(9999, "x" * 100_000)], "doc_id long, text string")
    sample = lambda *a: [t for b in lm.start_sample(docs, 2001, *a) for t in b.column(0).to_pylist()]
    some = sample(500, 20_000)
    assert 10_000 < sum(map(len, some)) <= 20_000 and max(map(len, some)) <= 2_500
    assert len(sample(5000, 100 << 20)) == 2001
    assert len(sample(100, 100 << 20)) <= 200
    assert some == sample(500, 20_000)


def test_lm_learns_beyond_the_base(spark):
    """Held out, words that follow from the one before are far likelier than by their counts."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(1200):
        w = [int(rng.integers(0, 60))]
        while len(w) < 120:
            w.append((w[-1] * 7 + 3 + int(rng.integers(0, 2))) % 60)
        rows.append((i, " ".join(f"t{x}" for x in w)))
    got = lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).where("held_out").agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score")).first()
    assert got[2] / got[0] > got[1] / got[0] + 0.5


def test_lm(odd, none, many):
    got = {r["doc_id"]: r for r in lm.lm_scores(many, vocabulary_words=50, head_words=100).collect()}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in got}
    counts = Counter()
    for k, t in texts(many):
        if not held[k]:
            counts.update([*t.encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    for k, t in texts(many):
        tokens = [*t.encode().lower().split(), None]
        assert (got[k]["n_tokens"], got[k]["n_known"], got[k]["train_tokens"], got[k]["held_out"]) == (len(tokens), sum(counts[x] > 0 for x in tokens), n, held[k])
        assert got[k]["base_score"] == pytest.approx(sum(np.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens))
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got.values())
    assert len(lm.lm_scores(odd).collect()) == odd.count()
    assert lm.lm_scores(none).count() == 0


def bilinear(size=23, seed=1):
    rng = np.random.default_rng(seed)
    model = lm.LogBilinear(rng.integers(0, 50, size).astype(float), dimensions=6)
    for name in ("context", "word", "klass", "word_bias", "klass_bias", "position"):
        value = getattr(model, name)
        value += rng.normal(0, 0.7, value.shape).astype(np.float32)
    return model, rng


@pytest.mark.parametrize("size", [2, 5, 23, 26])
def test_log_bilinear_probabilities_add_up_to_one(size):
    model, rng = bilinear(size)
    for _ in range(20):
        before = np.repeat(rng.integers(0, size + 1, (1, lm.CONTEXT)), size, 0)
        logs = model.log10(before, np.arange(size), batch=7)
        assert (10**logs).sum() == pytest.approx(1, abs=1e-5)
        q = sum(model.context[before[0, k]].astype(float) @ model.position[k] for k in range(lm.CONTEXT))
        for i in range(size):
            c = i // model.width
            classes = np.exp(model.klass.astype(float) @ q + model.klass_bias)
            mates = np.arange(c * model.width, min(size, (c + 1) * model.width))
            inside = np.exp(model.word[mates].astype(float) @ q + model.word_bias[mates])
            assert 10 ** logs[i] == pytest.approx(classes[c] / classes.sum() * inside[i - mates[0]] / inside.sum(), rel=1e-3)


def test_noise_contrastive_training_learns_what_follows():
    """Outcome 5 follows 3 wherever it is in the context; otherwise outcomes are drawn from one law."""
    rng = np.random.default_rng(4)
    before = rng.integers(0, 12, (40_000, lm.CONTEXT)).astype(np.int32)
    ids = np.where((before == 3).any(1), 5, rng.integers(0, 12, len(before))).astype(np.int32)
    trainer = lm.Trainer(lm.LogBilinear(np.bincount(ids, minlength=12).astype(float), dimensions=8), seed=2, batch=512)
    for _ in range(6):
        trainer.learn(before, ids)
    plain = np.log10(np.bincount(ids) / len(ids))[ids].mean()
    assert trainer.model.log10(before, ids).mean() > plain + 0.1
    with_3, without = np.full((1, lm.CONTEXT), 3), np.full((1, lm.CONTEXT), 7)
    assert 10 ** trainer.model.log10(with_3, np.array([5]))[0] > 0.8 > 0.2 > 10 ** trainer.model.log10(without, np.array([5]))[0]


@pytest.mark.parametrize("rows", [4, 1024])
def test_a_training_step_is_that_of_its_tokens_one_by_one(monkeypatch, rows):
    """Also where a batch takes several parts; a word drawn several times for a class meets its tokens once."""
    monkeypatch.setattr(lm, "ROWS", rows)
    taken, falling = [], lm._falling
    monkeypatch.setattr(lm, "_falling", lambda x, *top: taken.append(x.size) or falling(x, *top))
    model, rng = bilinear(23)
    ids = np.sort(rng.choice([0, 1, 2, 7, 11, 22, 22, 22], 60))
    before = rng.integers(0, 24, (60, lm.CONTEXT)).astype(np.int32)
    trainer = lm.Trainer(model, seed=5, class_noise=16, word_noise=12)
    trainer._step(before, ids)

    draw, classes = np.random.default_rng(5), np.unique(ids // model.width)
    noise = draw.choice(len(model.klass), 16, p=model.class_law)
    low, high = model.upto[classes * model.width], model.upto[np.minimum((classes + 1) * model.width, 23)]
    words = np.searchsorted(model.upto, low[:, None] + draw.random((len(classes), 12)) * (high - low)[:, None], "right") - 1
    names = ("context", "word", "klass", "position", "word_bias", "klass_bias")
    g = {name: np.zeros(getattr(model, name).shape) for name in names}
    for row, w in zip(before, ids):
        q = sum(model.context[row[k]].astype(float) @ model.position[k] for k in range(lm.CONTEXT))
        dq, c = np.zeros(6), w // model.width
        for name, own, others, law in (("klass", c, noise, model.class_law), ("word", w, words[list(classes).index(c)], model.word_law)):
            for i, real in [(own, 1), *((i, 0) for i in others)]:
                vector, bias = getattr(model, name)[i], getattr(model, name + "_bias")[i]
                by = real - 1 / (1 + np.exp(-(q @ vector + bias - np.log(len(others) * law[i]))))
                g[name][i] += by * q
                g[name + "_bias"][i] += by
                dq += by * vector
        for k in range(lm.CONTEXT):
            g["context"][row[k]] += model.position[k].astype(float) @ dq
            g["position"][k] += np.outer(model.context[row[k]], dq)
    for name in names:
        flat = g[name].reshape(len(g[name]), -1)
        by = 0.3 / np.sqrt(1 + (flat**2).sum(1))
        assert getattr(trainer.model, name) == pytest.approx(getattr(model, name) + (flat * by[:, None]).reshape(g[name].shape), abs=2e-5), name
    distinct = [len(set(x)) for x in words]
    assert sum(taken) == 60 * (len(set(noise)) + 2) + sum(n * (ids // model.width == c).sum() for n, c in zip(distinct, classes)) and min(distinct) < 12


def test_examples_are_tokens_with_those_before_them():
    vocabulary = lm.Vocabulary(["a", "b", "c"], np.array([9, 5, 3]), 2)
    of, before, ids = lm.model_ids(vocabulary, 3, np.array([0, 0, 0, 2]), np.array([0, 1, 2, 0]))
    assert of.tolist() == [0, 0, 0, 0, 1, 2, 2] and ids.tolist() == [0, 1, 2, 3, 3, 0, 3]
    assert before.tolist() == [[4, 4, 4, 4], [0, 4, 4, 4], [1, 0, 4, 4], [2, 1, 0, 4], [4, 4, 4, 4], [4, 4, 4, 4], [0, 4, 4, 4]]


@pytest.mark.parametrize("text", ["", " a  B\t", "\n\v", "a\u00a0b \u00c4 \u00e4 A"])
def test_words_stay_in_arrow(text):
    """Rare words abound in a batch, so none of them becomes a Python string."""
    given = pa.array([text, None, "x y", text], pa.string())
    doc, found = lm.words_of(given)
    assert isinstance(found, pa.Array)
    want = [(i, w.decode()) for i, t in enumerate(given.to_pylist()) for w in (t or "").encode().lower().split()]
    assert list(zip(doc.tolist(), found.to_pylist())) == want
    vocabulary = lm.Vocabulary(["a", "x", "y"], np.array([9, 5, 3]), 2)
    assert vocabulary.find(found).tolist() == [{"a": 0, "x": 1, "y": 2}.get(w, -1) for _, w in want]
    assert vocabulary.find(found, 2).tolist() == [{"a": 0, "x": 1}.get(w, -1) for _, w in want]
    batch = pa.RecordBatch.from_arrays([given], names=["text"])
    assert dict(zip(*(c.to_pylist() for c in next(lm._word_counts(iter([batch]))).columns))) == Counter(w for _, w in want)


def test_scoring_holds_few_logits_at_a_time():
    """Those of 30,000 tokens against 400 classes would be 48 MB, which leave a core's cache again and again."""
    rng = np.random.default_rng(5)
    model = lm.LogBilinear(np.ones(160_000), dimensions=4)
    before, ids = rng.integers(0, 160_000, (30_000, lm.CONTEXT)).astype(np.int32), rng.integers(0, 160_000, 30_000).astype(np.int32)
    tracemalloc.start()
    logs = model.log10(before, ids)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.klass) > 390 and most < 16e6
    assert logs == pytest.approx(np.full(len(ids), -np.log10(160_000)), abs=0.5)


@pytest.mark.parametrize("size", [5, 23])
def test_large_logits_are_shifted(size):
    """Vectors so long that exponentials would leave the range of a float; the sum over outcomes stays one."""
    model, rng = bilinear(size)
    model.word *= 300
    model.klass *= 300
    before = np.repeat(rng.integers(0, size + 1, (1, lm.CONTEXT)), size, 0)
    assert (10 ** model.log10(before, np.arange(size))).sum() == pytest.approx(1, abs=1e-5)


@pytest.mark.parametrize("width", [3, 6])
def test_sums_of_runs(width):
    rows = np.random.default_rng(6).normal(size=(50, width)).astype(np.float32)
    first = np.array([0, 1, 2, 30, 49])
    want = [rows[a:b].sum(0) for a, b in zip(first, [*first[1:], 50])]
    for some in (rows, np.asfortranarray(rows)):
        assert lm._sums(some, first) == pytest.approx(np.array(want), abs=1e-5)


def test_scores_are_sums_over_tokens(many, odd, monkeypatch):
    """All of score, by the model that was fitted, for one text after another."""
    fitted = []
    fit = lm.fit
    monkeypatch.setattr(lm, "fit", lambda *a, **k: fitted.append((a[1], fit(*a, **k))) or fitted[-1][1])
    for df in (many, odd):
        rows = lm.lm_scores(df, vocabulary_words=50, head_words=100).collect()
        vocabulary, model = fitted[-1]
        train = [(k, t) for k, t in texts(df) if k is None or zlib.crc32(str(k).encode()) % 10]
        counts = Counter(w for _, t in train for w in t.encode().lower().split())
        inside = [w.encode() for w in vocabulary.words[: vocabulary.size]]
        mass = sum(n for w, n in counts.items() if w not in set(inside)) + 0.1 * (len(counts) - len(inside) + 1)
        want = Counter()
        for k, t in texts(df):
            words, total, before = t.encode().lower().split(), 0.0, [vocabulary.begin] * lm.CONTEXT
            for w in [*words, None]:
                i = vocabulary.end if w is None else inside.index(w) if w in inside else vocabulary.other
                total += model.log10(np.array([before]), np.array([i]))[0]
                if i == vocabulary.other:
                    total += np.log10((counts[w] + 0.1) / mass)
                before = [i, *before[:-1]]
            want[k, round(total, 2)] += 1
        got = Counter((r["doc_id"], round(r["score"], 2)) for r in rows)
        assert sum((got & want).values()) >= 0.97 * len(rows)  # the rest lies at a border of rounding
        assert {k for k, _ in got} == {k for k, _ in want}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for k in range(600):
        good = rng.random() < 0.7
        toxic = good and rng.random() < 0.3
        words = rng.choices(WORDS, k=rng.randint(20, 120))
        if toxic:
            for _ in range(rng.randint(1, 6)):
                words[rng.randrange(len(words))] = rng.choice(["schuft", "scheusal", "lump"]) + rng.choice(["", "e", "es"])
        docs.append((k, " ".join(words if good else [w.upper() + "!!#" for w in words[:10]] * 5), "en", "a", 1))
        labels.append((k, int(good), int(toxic)))
    return spark.createDataFrame(docs, SCHEMA).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def test_quality_on_held_out_rows(labelled, odd, none):
    docs, labels = labelled
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 100 and sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.97
    held = quality.quality_scores(odd, labels).collect()
    assert len(held) == odd.count() and all(0 <= r["score"] <= 1 for r in held)
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(none, labels).count() == 0
    model = quality.fit_quality(docs, labels)
    for name in ("__q", "score", "Score"):
        named = odd.withColumn("text_to_score", F.lit("clash")).withColumn("a.b", F.lit(1))
        got = quality.score_quality(named, model, score_col=name)
        assert got.columns == [*(c for c in named.columns if c.lower() != name.lower()), name]
        again = [r[name] for r in got.orderBy("doc_id", name).collect()]
        assert again == sorted_scores(odd, model) and all(0 <= p <= 1 for p in again)


def sorted_scores(df, model):
    found = [(k is not None, k, p) for (k, t), p in zip(texts(df), model.probability(quality.statistics_rows(pa.array([t for _, t in texts(df)]))).tolist())]
    return [p for _, _, p in sorted(found, key=lambda x: (x[0], x[1] or 0, x[2]))]


def test_statistics_by_hand():
    got = quality.statistics(b"Ab ab\nab. 7!")
    assert got[:13] == pytest.approx([n / 12 for n in (1, 5, 1, 2, 1, 1, 0, 0, 1, 0, 0, 0, 0)])  # one figure a byte class
    assert got[13:] == pytest.approx([np.log1p(4), 9 / 4, 3 / 4, 1, 0, 2, 1, 0, 1 / 4])


def test_flat_trees_walk_like_nested_ones():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    model = quality.fit_boosted(x, (x[:, 0] * x[:, 1] > 0).astype(float), rounds=60)

    def one(row, t):
        node = 0
        while node < model.feature.shape[1]:
            node = 2 * node + 1 + (row[model.feature[t, node]] > model.cut[t, node])
        return model.leaf[t, node - model.feature.shape[1]]

    want = [model.base + sum(one(row, t) for t in range(len(model.feature))) for row in x]
    assert np.allclose(model.raw(x), want)
    assert ((model.probability(x) > 0.5) == (x[:, 0] * x[:, 1] > 0)).mean() > 0.9


def test_toxicity_on_rows_it_has_not_seen(labelled, odd, none):
    docs, labels = labelled
    rows = toxicity.toxicity_scores(docs, labels.where("doc_id % 2 = 0")).join(labels, "doc_id").where("doc_id % 2 = 1").collect()
    assert sum(r["toxic"] for r in rows if r[4] == 1) and all(0 <= r["expected_severity"] <= 3 for r in rows)
    right = [r[2] == r[4] for r in rows]
    assert sum(right) / len(right) > 0.95
    assert len(toxicity.toxicity_scores(odd, labels).collect()) == odd.count()
    assert {r["toxic"] for r in toxicity.toxicity_scores(docs, labels.withColumn("toxic", F.lit(0))).collect()} == {0}
    assert toxicity.toxicity_scores(none, labels).count() == 0


def test_toxicity_scores_against_the_formula(labelled, odd):
    docs, labels = labelled
    model = toxicity.fit_toxicity(docs, labels)
    assert (model.weight > 0).any() and (np.diff(model.theta) > 0).all()
    for df in (docs, odd.withColumn("expected_severity", F.lit("clash"))):
        got = toxicity.score_toxicity(df, model)
        assert got.columns == [*(c for c in df.columns if c != "expected_severity"), "expected_severity"]
        for r in got.collect():
            counts = Counter(f for w in (r["text"] or "").encode().split() for f in toxicity.word_features(w.decode()))
            z = sum(model.weight[model.number[f]] * np.log1p(n) for f, n in counts.items() if f in model.number)
            assert r["expected_severity"] == pytest.approx(sum(1 / (1 + np.exp(-np.clip(z - t, -35, 35))) for t in model.theta))


def test_grades_come_from_scores_of_the_other_fold():
    rng = np.random.default_rng(5)
    toxic = np.arange(400) % 4 == 0
    strength = np.where(toxic, rng.integers(1, 9, 400), 0)
    grade = toxicity.severity_grades(np.flatnonzero(toxic), np.zeros(100, int), np.log1p(strength[toxic]), toxic, np.arange(400) // 4 % 2, 1)
    assert (grade[~toxic] == 0).all() and set(grade[toxic]) == {1, 2, 3}
    assert np.corrcoef(grade[toxic], strength[toxic])[0, 1] > 0.8


def test_cumulative_link_orders_grades():
    rng = np.random.default_rng(6)
    value = rng.normal(size=900)
    grade = np.digitize(value, [-0.5, 0.5, 1.5])
    w, theta = toxicity.fit_cumulative_link(np.arange(900), np.zeros(900, int), value, grade, 1)
    assert w[0] > 2 and (np.diff(theta) > 0).all()
    assert np.abs(theta / w[0] - [-0.5, 0.5, 1.5]).max() < 0.3


def test_pipeline_stages(labelled, spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.union(docs.where("doc_id < 30").withColumn("doc_id", F.col("doc_id") + 5000)).write.parquet(f"{tmp_path}/documents.parquet")
    truth = {r["doc_id"]: r for r in labels.collect()}
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append([r["doc_id"] for r in now.collect()])
    good = lambda k: truth[k % 5000]["quality"] == 1
    assert sum(not good(k) for k in kept[0]) <= 3 and len(kept[0]) > 400
    assert sum(truth[k % 5000]["toxic"] for k in kept[1]) <= 0.1 * sum(truth[k % 5000]["toxic"] for k in kept[0])
    assert not [k for k in kept[2] if k >= 5000 and k - 5000 in kept[2]]
    assert set(kept[3]) <= set(kept[2]) and max(Counter(kept[3]).values()) <= 2
    assert set(kept[4]) == set(kept[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept[4])


def test_pipeline_stages_on_odd_rows(labelled, odd, none, spark, tmp_path):
    """Nulls, empty and very long texts, repeats, an empty table and columns with the names that stages use."""
    import corpus_pipeline as pipeline

    labelled[1].write.parquet(f"{tmp_path}/labels.parquet")
    long = " ".join(RNG.choices(WORDS, k=400_000))  # about 2 MB
    rows = [*odd_rows(), (20, long, "en", "a", 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("quality_score", "severity", "taken_id", "taken_times", "taken_pass", "gone", "score", "length", "part", "rank"):
        frame = frame.withColumn(name, F.lit("clash"))
    run = lambda stage, df: stage(spark, df, str(tmp_path))
    ids = lambda df: Counter(r["doc_id"] for r in df.collect())
    for stage in (pipeline.keep_quality, pipeline.drop_toxic, pipeline.drop_near_duplicates, pipeline.mix_by_source):
        out = run(stage, frame)
        assert out.columns == frame.columns and set(ids(out)) <= set(ids(frame))
        assert run(stage, none).columns == none.columns and run(stage, none).count() == 0
    quality_model = quality.fit_quality(frame, labelled[1])
    kept = {k for k, t in texts(frame) if quality_model.probability(quality.statistics_rows(pa.array([t])))[0] >= 0.5}
    assert set(ids(run(pipeline.keep_quality, frame))) == kept
    assert ids(run(pipeline.drop_near_duplicates, frame)) == Counter({1: 1, 2: 1, 3: 1, 6: 1, 7: 1, None: 1, 9: 1, 10: 1, 20: 1})
    mixed = ids(run(pipeline.mix_by_source, frame))
    assert not {1, 2, 7} & set(mixed) and all(n <= 2 * m for (k, n) in mixed.items() for m in [ids(frame)[k]])
    packed_rows = run(pipeline.pack, frame).collect()
    assert set(r["doc_id"] for r in packed_rows) == set(ids(frame)) and sum(r["start"] == 0 for r in packed_rows) == len(rows)
    assert sum(r["length"] for r in packed_rows if r["doc_id"] == 20) > 400_000 and run(pipeline.pack, none).count() == 0


def test_rows_without_ids_are_rows_of_their_own(spark):
    """Null and repeated ids: the mix keeps to its targets, and one row of each text is left."""
    pick = random.Random(9)
    rows = [(None if k % 2 else 5, " ".join(pick.choices(WORDS, k=40 + k % 30)), "en", "ab"[k % 3 == 0], 1) for k in range(400)]
    frame = spark.createDataFrame(rows, SCHEMA)
    mix = mixing.mix_sources(frame, block=16)
    target = {r["source"]: r["target"] for r in mix.sources.collect()}
    words = Counter()
    for r in mixing.take_whole(frame, block=16).collect():
        words[r["source"]] += len(r["text"].split())
    assert all(abs(words[s] - target[s]) <= 4 * 16 + 2 * 70 for s in target)
    text, other = (" ".join(pick.choices(WORDS, k=60)) for _ in range(2))
    again = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in [(4, text), (1, text), (1, text), (None, text), (None, text), (None, other), (None, other), (7, None), (7, None), (8, "")]], SCHEMA)
    kept = Counter((r["doc_id"], r["text"]) for r in ngram_join.one_of_each(again).collect())
    assert kept == Counter({(1, text): 1, (None, other): 1, (7, None): 2, (8, ""): 1})


def test_packing_looks_at_a_bounded_slice_of_texts(monkeypatch):
    """Tokenising 16 MB at a time took the pipeline's executor over its memory."""
    seen, taken = [], packing.token_rows

    def noted(texts, held):
        seen.append((len(texts), sum(len(x.as_py() or "") for x in texts)))
        return taken(texts, held)

    class Kind:
        def simpleString(self):
            return "bigint"

    class Docs:
        """Keeps what a task is given to run."""

        schema = {"doc_id": type("Field", (), {"dataType": Kind()})}

        def select(self, *columns):
            return self

        def mapInArrow(self, rows, schema):
            return rows

    monkeypatch.setattr(packing, "token_rows", noted)
    monkeypatch.setattr(packing, "TaskContext", type("Context", (), {"get": staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})())}))
    monkeypatch.setattr(packing.F, "col", lambda name: type("Column", (), {"cast": lambda self, kind: self, "alias": lambda self, kind: self})())
    texts = ["word " * 200_000] * 8 + [None, "", "x " * 3_000_000]  # 1 MB each; the last has 6 MB alone
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    out = pa.Table.from_batches(list(packing.cut_pieces(Docs(), "doc_id", "text", 2048, WORD_BPE, 0, False)(iter([batch]))))
    assert all(size <= 4 << 20 or rows == 1 for rows, size in seen)
    lengths = out.group_by("doc_id").aggregate([("length", "sum")]).sort_by("doc_id")["length_sum"].to_pylist()
    assert lengths[:8] == [lengths[0]] * 8 and lengths[0] >= 200_000 and lengths[8:10] == [1, 1]
    assert out.group_by("doc_id").aggregate([("row", "min")]).sort_by("doc_id")["row_min"].to_pylist() == list(range(len(texts)))
