"""Toxicity by cumulative-link ordinal regression over sparse text features.

A document's severity is a grade 0..3. One weight vector is shared by all thresholds:
P(grade >= k) = sigmoid(w . x - theta_k), theta_1 < theta_2 < theta_3, and the result is the expected grade.
Labels say only whether a document is toxic. How severe a toxic one is comes from models that have not seen it: the sample
is cut into folds, a model with one threshold is fitted without the fold, and its score of the toxic documents of the fold
is cut into thirds. Features are lower-cased letter runs and their first 4, 5 and 6 letters, so that inflected forms share
what they have in common; they may speak for either side, and a ridge decides how much.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, settled, slices
from .labelled import crc_of, labelled_sample, with_score

GRADES = 3
VOCABULARY = 4096
THRESHOLD = 0.4
#: Standard errors by which a feature's log odds have to differ from none, to either side.
SIGNIFICANT = 2.8
FOLDS = 2
#: The most labelled rows to learn from: inflected forms are rare, so more than for document statistics.
TOXIC_SAMPLE_ROWS = 40_000
#: Features that a task counts before it sends the counts on.
HELD_FEATURES = 150_000
_LETTERS = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    found = []
    for run in _LETTERS.findall(word.lower()):
        found.append(run)
        found += [f"{run[:n]}~" for n in (4, 5, 6) if len(run) >= n]
    return found


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Bounds of each text in the codes, the code of each word, the distinct words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    return lists.offsets.to_numpy() - lists.offsets[0].as_py(), coded.indices.to_numpy(), coded.dictionary.to_pylist()


def sparse_rows(texts: pa.Array, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) of the known features, sorted by row, and the number of words of each text."""
    bounds, codes, words = _coded(texts)
    known = [[number[f] for f in word_features(w) if f in number] for w in words]
    sizes = np.array(list(map(len, known)), np.int64)
    flat, first = np.array([f for k in known for f in k], np.int64), np.cumsum(sizes) - sizes
    hit = np.flatnonzero(sizes[codes]) if len(codes) else np.zeros(0, np.int64)
    n = sizes[codes[hit]]
    at = np.repeat(first[codes[hit]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    rows = np.repeat(np.searchsorted(bounds, hit, "right") - 1, n)
    key, count = np.unique(rows * (len(number) + 1) + flat[at], return_counts=True)
    return key // (len(number) + 1), key % (len(number) + 1), count, np.diff(bounds)


@dataclass
class Ordinal:
    number: dict[str, int]
    weight: np.ndarray
    theta: np.ndarray

    def expected(self, texts: pa.Array) -> np.ndarray:
        row, feature, count, words = sparse_rows(texts, self.number)
        z = np.bincount(row, self.weight[feature] * np.log1p(count), len(words)) if len(row) else np.zeros(len(words))
        return _sigmoid(z[:, None] - self.theta).sum(1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_cumulative_link(row: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, size: int, steps: int = 300, rate: float = 0.05, ridge: float = 2e-5, grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the proportional-odds model of grades 0..`grades` by Adam; gaps between thresholds stay positive."""
    n, k = len(grade), grades
    share = np.array([(grade >= j).mean() if n else 0.0 for j in range(1, k + 1)]).clip(1e-4, 1 - 1e-4)
    start = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(k))
    w, t = np.zeros(size), np.concatenate([start[:1], np.log(np.diff(start).clip(1e-3))])
    moments = [np.zeros(size + k), np.zeros(size + k)]
    for step in range(1, steps + 1 if n else 1):
        theta = np.concatenate([t[:1], t[0] + np.cumsum(np.exp(t[1:]))])
        z = np.bincount(row, w[feature] * value, n)
        above = np.concatenate([np.ones((n, 1)), _sigmoid(z[:, None] - theta), np.zeros((n, 1))], 1)
        p = (above[np.arange(n), grade] - above[np.arange(n), grade + 1]).clip(1e-12)
        slope = above * (1 - above)
        up, down = slope[np.arange(n), grade], slope[np.arange(n), grade + 1]
        dz = (up - down) / p
        dtheta = np.array([(down / p)[grade == j - 1].sum() - (up / p)[grade == j].sum() for j in range(1, k + 1)])
        tail = np.cumsum(dtheta[::-1])[::-1]
        gradient = -np.concatenate([np.bincount(feature, dz[row] * value, size) / n - 2 * ridge * w, tail[:1] / n, tail[1:] * np.exp(t[1:]) / n])
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.99 * moments[1] + 0.01 * gradient**2
        move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-9)
        w, t = w - move[:size], t - move[size:]
    return w, np.concatenate([t[:1], t[0] + np.cumsum(np.exp(t[1:]))])


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of each label a feature is, summed over what a task sees before it holds too many features."""
    found = (Counter(), Counter())

    def counted() -> pa.RecordBatch:
        names = list(found[0].keys() | found[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in found)], names=["feature", "clean", "toxic"])
        for c in found:
            c.clear()
        return out

    for batch in slices(batches, 0, 2 << 20):
        bounds, codes, words = _coded(batch.column(0))
        features = [word_features(w) for w in words]
        for k, label in enumerate(batch.column(1).to_pylist()):
            found[label].update({f for c in np.unique(codes[bounds[k] : bounds[k + 1]]).tolist() for f in features[c]})
        if len(found[0]) + len(found[1]) > HELD_FEATURES:
            yield counted()
    yield counted()


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TOXIC_SAMPLE_ROWS, vocabulary: int = VOCABULARY, allowed=None) -> Ordinal:
    """Fit on at most `rows` labelled documents. The driver gets at most `vocabulary` features, then the sample's sparse rows.

    Without toxic or without clean labels, no document is toxic.
    """
    sample = labelled_sample(docs, labels, label, allowed, rows)
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    if not clean or not toxic:
        return Ordinal({}, np.zeros(0), np.full(GRADES, 30.0))
    counts = sample.select("text", "label").mapInArrow(lambda batches: settled(_feature_counts(batches)), "feature string, clean bigint, toxic bigint")
    counts = counts.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    rated = counts.withColumn("errors", F.abs(odds) / error).where(F.col("errors") >= SIGNIFICANT)
    chosen = [r["feature"] for r in rated.orderBy(F.desc("errors"), "feature").limit(vocabulary).select("feature").collect()]
    number = {f: k for k, f in enumerate(chosen)}

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            row, feature, count, words = sparse_rows(batch.column(0), number)
            cut = np.searchsorted(row, np.arange(len(words) + 1))
            lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, pa.int32())) for x in (feature, count)]
            yield pa.RecordBatch.from_arrays([*lists, batch.column(1), batch.column(2)], names=["feature", "count", "label", "place"])

    placed = sample.select("text", "label", crc_of("doc_id").alias("place"))
    got = placed.mapInArrow(lambda batches: settled(rows_of(batches)), "feature array<int>, count array<int>, label int, place bigint").toPandas()
    order = np.lexsort((got["label"], got["feature"].map(len), got["place"]))  # the same model whatever order rows arrive in
    got = got.iloc[order].reset_index(drop=True)
    row = np.repeat(np.arange(len(got), dtype=np.int32), got["feature"].map(len).to_numpy(np.int64))
    feature, count = (np.concatenate([np.zeros(0), *got[c]]).astype(np.int32) for c in ("feature", "count"))
    value, is_toxic = np.log1p(count), got["label"].to_numpy() == 1
    grade = severity_grades(row, feature, value, is_toxic, np.arange(len(got)) % FOLDS, len(number))
    weight, theta = fit_cumulative_link(row, feature, value, grade, len(number))
    del got, row, feature, count, value, grade
    give_back()
    return Ordinal(number, weight, theta)


def severity_grades(row: np.ndarray, feature: np.ndarray, value: np.ndarray, is_toxic: np.ndarray, fold: np.ndarray, size: int) -> np.ndarray:
    """0 for clean rows, else 1 to GRADES: the part in which the score lies that a model fitted without the row's fold gives it."""
    score = np.zeros(len(is_toxic))
    for k in range(FOLDS):
        seen = fold != k
        place, of = np.cumsum(seen) - 1, seen[row]
        weight, theta = fit_cumulative_link(place[row[of]], feature[of], value[of], is_toxic[seen].astype(np.int64), size, grades=1)
        score[~seen] = (np.bincount(row, weight[feature] * value, len(is_toxic)) - theta[0])[~seen]
    cuts = np.quantile(score[is_toxic], np.arange(1, GRADES) / GRADES)
    return np.where(is_toxic, 1 + np.searchsorted(cuts, score, "left"), 0)


def score_toxicity(docs: DataFrame, model: Ordinal, text_col: str = "text", score_col: str = "expected_severity") -> DataFrame:
    """`docs` with the expected severity, 0 to 3. A null text scores as an empty one; every row is scored once; a column
    that is named `score_col` is replaced."""
    return with_score(docs, text_col, score_col, model.expected)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TOXIC_SAMPLE_ROWS) -> DataFrame:
    """doc_id, expected_severity (0 to 3), toxic (1 from the threshold on), a row for every row of `docs`.

    A null text is an empty one; null and repeated ids are scored like others. Without toxic or clean labels nothing is
    toxic. An empty table gives no rows. Columns other than doc_id and text are not looked at.
    """
    out = score_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, labels, rows=rows))
    return out.select("doc_id", "expected_severity", F.when(F.col("expected_severity") >= threshold, 1).otherwise(0).alias("toxic"))
