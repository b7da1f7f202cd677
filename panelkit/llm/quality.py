"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown level by level from histograms of binned statistics and kept as complete binary trees in flat
arrays, so a batch of documents walks all of them with numpy indexing only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, slices
from .labelled import SAMPLE_ROWS, crc_of, labelled_sample, with_score

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",", b"|", b"!", b"#$%&*@^~", b"<>[]{}()\\/=_+", b"\"'`-:;?", bytes(range(128, 256))]
_BYTE_CLASS = np.zeros((256, len(_CLASSES)))
for _k, _bytes in enumerate(_CLASSES):
    _BYTE_CLASS[list(_bytes), _k] = 1
N_STATISTICS = len(_CLASSES) + 9


def statistics(text: bytes) -> list[float]:
    """Shares of byte classes, then figures of words, repeats and lines. An empty text gives zeros."""
    size = len(text)
    if not size:
        return [0.0] * N_STATISTICS
    shares = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _BYTE_CLASS / size).tolist()
    words, lines = text.split(), text.split(b"\n")
    n = max(1, len(words))
    lengths = list(map(len, words))
    repeats = sum(map(eq, words, words[1:]))
    return shares + [
        float(np.log1p(len(words))), sum(lengths) / n, max(lengths, default=0) / n, len(set(words)) / n, repeats / n,
        len(words) / len(lines), len(set(lines)) / len(lines), sum(x == 1 for x in lengths) / n, len(set(words[: 1 + len(words) // 2]) & set(words[len(words) // 2 :])) / n,
    ]


def statistics_rows(texts: pa.Array) -> np.ndarray:
    found = [statistics(memoryview(x.as_buffer()).tobytes()) for x in pc.fill_null(texts, "").cast(pa.large_string())]
    return np.array(found, np.float64).reshape(-1, N_STATISTICS)


@dataclass
class Boosted:
    """Node k of a tree has the children 2k+1 and 2k+2; a leaf row holds what the tree adds."""

    base: float
    feature: np.ndarray  # tree, inner node
    cut: np.ndarray
    leaf: np.ndarray  # tree, leaf

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_boosted(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Boosted:
    """Logistic loss, second-order gains. Without rows, or with one class only, the prior alone is the model."""
    prior = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    base = float(np.log(prior / (1 - prior)))
    inner = 2**depth - 1
    if len(np.unique(y)) < 2:
        return Boosted(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
    trees, raw, rows = [], np.full(len(y), base), np.arange(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best, chosen = np.zeros(width), np.full(width, -1)
            place = np.zeros(width, np.int64)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                key = (at - first) * (len(e) + 1) + binned[:, f]
                gs, hs = (np.bincount(key, v, width * (len(e) + 1)).reshape(width, -1) for v in (g, h))
                gl, hl = gs.cumsum(1), hs.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain = np.where((hl >= least) & (ht - hl >= least), gain, 0)[:, :-1]
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best + 1e-9
                best[better], chosen[better], place[better] = gain[np.arange(width), top][better], f, top[better]
            for k in np.flatnonzero(chosen >= 0):
                feature[first + k], cut[first + k] = chosen[k], edges[chosen[k]][place[k]]
            at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
        gs, hs = (np.bincount(at - inner, v, inner + 1) for v in (g, h))
        leaf = -rate * gs / (hs + ridge)
        trees.append((feature, cut, leaf))
        raw = raw + leaf[at - inner]
    return Boosted(base, *(np.array(part) for part in zip(*trees)))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 0):
        x = statistics_rows(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])


def fit_quality(docs: DataFrame, labels: DataFrame, allowed=None, label: str = "quality", rows: int = SAMPLE_ROWS) -> Boosted:
    """Fit on at most `rows` labelled documents, of which only the statistics and the label reach the driver."""
    got = labelled_sample(docs, labels, label, allowed, rows).select("text", "label").mapInArrow(lambda batches: settled(_measured(batches)), "x array<double>, label int").toPandas()
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, N_STATISTICS)
    order = np.lexsort((*x.T, got["label"].to_numpy()))  # the same model whatever order rows arrive in
    return fit_boosted(x[order], got["label"].to_numpy(np.float64)[order])


def score_quality(docs: DataFrame, model: Boosted, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with the probability of label 1. A null text scores as an empty one; every row is scored once; a column that
    is named `score_col` is replaced."""
    return with_score(docs, text_col, score_col, lambda texts: model.probability(statistics_rows(texts)))


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: learned only from rows that are not held out (crc32 of the id mod 3 is not 1).

    A null id is not held out. A null text scores as an empty one. Repeated rows are scored each. Without usable labels
    every score is 0.5 and predicted 1. An empty table gives no rows. Columns other than doc_id and text are not looked at.
    """
    model = fit_quality(docs, labels, crc_of("doc_id") % 3 != 1, rows=rows)
    out = score_quality(docs.select("doc_id", "text"), model)
    held = F.coalesce(crc_of("doc_id") % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
