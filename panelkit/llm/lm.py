"""Language-model scoring: a log-bilinear model over the commonest words, words beyond them by their own counts.

Counts of words come from every training document. The model predicts a vector from the CONTEXT tokens before a token, the
sum over positions of a position's matrix times the vector of the token there; an outcome's score is the product with its own
vector plus a bias. Outcomes lie in about as many classes as a class has members, commonest words first, and the
probability is that of the class times that within the class, each normalised over all its alternatives, so a token costs two
narrow matrix products. The model's vocabulary grows with the root of the training tokens.

Training is by noise-contrastive estimation with sampled noise: classes from the law of their counts, words from that within
the class, drawn once a batch for all tokens of a class. The driver starts on a sample bounded in documents and bytes; then
every task passes over all tokens of its training documents, and what tasks have learned is averaged in Spark, each vector by
how often it was seen. Scores therefore move a little with how the table is split.

A word outside of the model's vocabulary is predicted as <other> and then by its smoothed count among all such words.
Only the commonest `head` words travel to the tasks; counts of rarer ones are joined by word.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, settled, slices, small_batches
from .labelled import crc_of

SMOOTH = 0.1
CONTEXT = 4
DIMENSIONS = 32
#: Rows of a training batch that are worked on at a time.
ROWS = 1024
#: What the driver starts from: about so many training documents, twice as many at most, of so many bytes together at most.
START_DOCUMENTS = 1500
START_BYTES = 8 << 20


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words of each text with A-Z lower-cased: document of each word, words. They stay in Arrow: a Python string for each
    distinct word of a batch, where rare words abound, takes longer than all else that is done to the text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    real = pc.not_equal(flat, "")
    if pc.all(real).as_py():  # also where there are none
        return doc, flat
    return doc[real.to_numpy(zero_copy_only=False)], flat.filter(real)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 0, 16 << 20, 5000):
        counted = pc.value_counts(words_of(batch.column(0))[1])
        yield pa.RecordBatch.from_arrays(counted.flatten(), names=["word", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts, summed within tasks before the shuffle."""
    return texts.mapInArrow(lambda batches: settled(_word_counts(batches)), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def head_counts(counts: DataFrame, most: int) -> DataFrame:
    """The first `most` words by count, those of one count by a hash. Eighths of a power of two in count, then counts, then
    parts of the hash are taken whole while they fit; only the last part of the hash that does not fit is sorted."""
    mixed, taken, rest, left = F.xxhash64("word"), [], counts, most
    for key in (-F.floor(F.log2("n") * 8).cast("int"), -F.col("n"), F.shiftrightunsigned(mixed, 50)):
        sizes = sorted((r["key"], r["words"]) for r in rest.groupBy(key.alias("key")).agg(F.count("*").alias("words")).collect())
        for at, words in sizes:
            if words > left:
                taken.append(rest.where(key < at))
                rest = rest.where(key == at)
                break
            left -= words
        else:
            taken.append(rest)
            break
    else:
        taken.append(rest.orderBy(mixed, "word").limit(left))
    return reduce(DataFrame.unionAll, taken)


@dataclass
class Vocabulary:
    """The head words with their counts, commonest first; the first `size` of them are the model's."""

    words: list[str]
    counts: np.ndarray
    size: int

    def __post_init__(self):
        self.first = {}

    def __getstate__(self):
        return self.__dict__ | {"first": {}}

    def find(self, words: pa.Array, most: int | None = None) -> np.ndarray:
        """Places among the first `most` words of the head, or -1."""
        most = len(self.words) if most is None else most
        if most not in self.first:
            self.first[most] = pa.array(self.words[:most], pa.string())
        return pc.fill_null(pc.index_in(words, value_set=self.first[most]), -1).to_numpy()

    @property
    def other(self) -> int:
        return self.size

    @property
    def end(self) -> int:
        return self.size + 1

    @property
    def begin(self) -> int:
        return self.size + 2


def model_ids(vocabulary: Vocabulary, n_docs: int, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, CONTEXT ids before, nearest first, predicted id) of every token, the end of each document included."""
    ids = np.full(len(doc) + n_docs, vocabulary.end, np.int32)
    of = np.empty(len(ids), np.int64)
    at = np.arange(len(doc)) + doc
    ids[at], of[at] = np.where((place >= 0) & (place < vocabulary.size), place, vocabulary.other), doc
    ends = np.bincount(doc, minlength=n_docs).cumsum() + np.arange(n_docs)
    of[ends] = np.arange(n_docs)
    within = np.arange(len(ids)) - np.concatenate([[0], ends[:-1] + 1])[:n_docs][of]
    before = np.full((len(ids), CONTEXT), vocabulary.begin, np.int32)
    for k in range(min(CONTEXT, len(ids) - 1)):
        real = within[k + 1 :] > k
        before[k + 1 :, k][real] = ids[: len(ids) - k - 1][real]
    return of, before, ids


class LogBilinear:
    """Parameters, with `width` outcomes in a class; outcome i is in class i // width. n: count of each outcome in training."""

    def __init__(self, n: np.ndarray, seed: int = 3, dimensions: int = DIMENSIONS):
        rng, size = np.random.default_rng(seed), len(n)
        self.width = max(1, math.isqrt(max(1, size - 1)) + 1)
        classes, share = -(-size // self.width), n + SMOOTH
        pad = np.zeros(classes * self.width - size)
        of_class = np.concatenate([share, pad]).reshape(classes, -1).sum(1)
        self.class_law = of_class / of_class.sum()
        self.word_law = share / of_class[np.arange(size) // self.width]
        self.upto = np.concatenate([[0.0], np.cumsum(share)])
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.context, self.word, self.klass = draw(size + 1, dimensions), draw(size, dimensions), draw(classes, dimensions)
        self.position = np.stack([np.eye(dimensions, dtype=np.float32) / (k + 1) for k in range(CONTEXT)])
        self.word_bias, self.klass_bias = np.log(self.word_law).astype(np.float32), np.log(self.class_law).astype(np.float32)

    def predicted(self, before: np.ndarray) -> np.ndarray:
        """Of many tokens, each context vector meets the matrices once."""
        if len(before) > len(self.context):
            return sum((self.context @ self.position[k]).take(before[:, k], 0) for k in range(CONTEXT))
        return sum(self.context[before[:, k]] @ self.position[k] for k in range(CONTEXT))

    def log10(self, before: np.ndarray, ids: np.ndarray, batch: int = 32_768) -> np.ndarray:
        """Normalised log10 P(id | tokens before), in batches of matrix products."""
        out, klass, word = np.empty(len(ids)), _beside(self.klass, self.klass_bias), _beside(self.word, self.word_bias)
        for at in range(0, len(ids), batch):
            q, w = self.predicted(before[at : at + batch]), ids[at : at + batch]
            longest = math.sqrt(np.einsum("ij,ij->i", q, q).max())
            order = _order(w, len(self.word))  # by word, so by class
            q, w = _beside(q.take(order, 0), np.ones(len(w), q.dtype)), w[order]
            of = w // self.width
            found = _log_softmax(q, klass, of, longest)
            cuts = np.searchsorted(of, np.arange(len(self.klass) + 1))
            for c in np.flatnonzero(np.diff(cuts)).tolist():
                own, low = slice(cuts[c], cuts[c + 1]), c * self.width
                high = low + self.width
                found[own] += _log_softmax(q[own], word[low:high], w[own] - low, longest)
            out[at + order] = found
        return out / np.log(10)


def _log_softmax(q: np.ndarray, vectors: np.ndarray, chosen: np.ndarray, longest: float, most: int = 1 << 16) -> np.ndarray:
    """Log of the share of the chosen vector of each row of q, both with the bias in their last component; no row is longer than
    `longest` without it. `most` logits at a time, which a core's cache holds. Rows are shifted by their greatest value only
    where the lengths leave it open whether some exponential would leave the range of a float."""
    out, step, bias, plain = np.empty(len(q)), max(1, most // len(vectors)), vectors[:, -1], vectors[:, :-1]
    wide = not longest * math.sqrt(np.einsum("ij,ij->i", plain, plain).max()) + np.abs(bias).max() < 80
    ones, turned, room = np.ones(len(vectors), q.dtype), vectors.T, np.empty((min(step, len(q)), len(vectors)), q.dtype)
    for at in range(0, len(q), step):
        some = chosen[at : at + step]
        logits = np.matmul(q[at : at + step], turned, out=room[: len(some)])
        if wide:
            logits -= logits.max(1, keepdims=True)
        picked = logits[np.arange(len(some)), some].astype(np.float64)
        out[at : at + step] = picked - np.log(np.exp(logits, out=logits) @ ones)
    return out


def _falling(x: np.ndarray, top=np.float32(1)) -> np.ndarray:
    """top / (1 + exp(x)), in place; 0 where the exponential leaves the range."""
    np.exp(x, out=x)
    x += 1
    return np.divide(top, x, out=x)


def _beside(vectors: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Each vector with its bias as one more component, so that the product with a vector that ends in 1 has the bias in it."""
    return np.concatenate([vectors, bias[..., None]], -1)


def _runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of sorted ids and where each begins."""
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    return ids[first], first


def _sums(rows: np.ndarray, first: np.ndarray, long: int = 16) -> np.ndarray:
    """Sums of runs of rows. Long runs are matrix products; of the others, longest first, all second rows are added to the
    first ones at once, then all third rows, and so on."""
    size = np.diff(first, append=len(rows))
    by = _order(len(rows) - size, len(rows) + 1)
    start, size = first[by], size[by]
    sums, ones = rows.take(start, 0), np.ones(size.max(initial=0), rows.dtype)
    longer = np.searchsorted(-size, -np.arange(long))  # how many runs have more than 0, 1, ... rows
    many = int(longer[-1])
    for i, (a, n) in enumerate(zip(start[:many].tolist(), size[:many].tolist())):
        np.matmul(ones[:n], rows[a : a + n], out=sums[i])
    for k in range(1, long - 1):
        if many < longer[k]:
            sums[many : longer[k]] += rows.take(start[many : longer[k]] + k, 0)
    out = np.empty_like(sums)
    out[by] = sums
    return out


def _present(size: int, *ids: np.ndarray) -> np.ndarray:
    """The distinct values, each below size, in order."""
    found = np.zeros(size, bool)
    for some in ids:
        found[some] = True
    return np.flatnonzero(found)


def _order(ids: np.ndarray, size: int) -> np.ndarray:
    """A stable order; ids of two bytes are sorted by counting."""
    return np.argsort(ids.astype(np.uint16) if size <= 1 << 16 else ids, kind="stable")


class Trainer:
    """Noise-contrastive steps on a copy of a model. Each row of a parameter has a step size of its own, which shrinks with
    the squares of its gradients; `seen` counts how often a context's or outcome's vector has been in a batch."""

    def __init__(self, model: LogBilinear, seed: int, rate: float = 0.3, batch: int = 16_384, class_noise: int = 64, word_noise: int = 32):
        self.model, self.rng, self.rate, self.batch = copy.deepcopy(model), np.random.default_rng(seed), rate, batch
        self.class_noise, self.word_noise = class_noise, word_noise
        self.squares = {k: np.full(len(getattr(model, k)), 1.0, np.float32) for k in ("context", "word", "klass", "position", "word_bias", "klass_bias")}
        self.seen = {k: np.zeros(len(getattr(model, k)), np.int64) for k in ("context", "word")}

    def learn(self, before: np.ndarray, ids: np.ndarray) -> None:
        for at in range(0, len(ids), self.batch):
            some = ids[at : at + self.batch]
            order = _order(some, len(self.model.word))  # by word, so by class
            with np.errstate(over="ignore"):
                self._step(before[at : at + self.batch].take(order, 0), some[order])

    def _move(self, name: str, rows: np.ndarray, gradient: np.ndarray) -> None:
        """Upwards, since gradients are those of the likelihood."""
        flat = gradient.reshape(len(rows), -1)
        self.squares[name][rows] += np.einsum("ij,ij->i", flat, flat)
        by = self.rate / np.sqrt(self.squares[name][rows])
        getattr(self.model, name)[rows] += gradient * by.reshape(-1, *[1] * (gradient.ndim - 1))
        if name in self.seen:
            self.seen[name][rows] += 1

    def _step(self, before: np.ndarray, w: np.ndarray) -> None:
        m = self.model
        sides, place, q = [], np.empty(len(m.context), np.int32), np.zeros((len(w), m.word.shape[1]), np.float32)
        for k in range(CONTEXT):  # each word that the batch has at k meets the matrix once
            order = _order(before[:, k], len(m.context))
            here, first = _runs(before[order, k])
            vectors = m.context.take(here, 0)
            place[here] = np.arange(len(here))
            q += (vectors @ m.position[k]).take(place.take(before[:, k]), 0)
            sides.append((order, here, first, vectors))
        of, q1 = w // m.width, _beside(q, np.ones(len(w), np.float32))
        words, at_word = _runs(w)
        classes, at_class = _runs(of)
        spans = list(zip(at_class.tolist(), [*at_class[1:].tolist(), len(w)]))

        noise, times = np.unique(self.rng.choice(len(m.klass), self.class_noise, p=m.class_law), return_counts=True)
        bias = m.klass_bias - np.log(self.class_noise * m.class_law).astype(np.float32)
        word_bias = m.word_bias - np.log(self.word_noise * m.word_law).astype(np.float32)
        others, times = m.klass[noise], -times.astype(np.float32)
        turned, push = -_beside(others, bias[noise]).T, np.zeros((len(noise), q1.shape[1]), np.float32)
        real, real_word, dq, drawn_to = np.empty(len(w), np.float32), np.empty(len(w), np.float32), np.empty_like(q), np.empty_like(q)
        for at in range(0, len(w), ROWS):  # so many rows stay in a core's cache
            part = slice(at, at + ROWS)
            false = _falling(q1[part] @ turned, times)
            push += false.T @ q1[part]
            np.matmul(false, others, out=dq[part])
            for vectors, ids, biases, share in ((m.klass, of[part], bias, real[part]), (m.word, w[part], word_bias, real_word[part])):
                own = vectors.take(ids, 0)
                np.add(np.einsum("ij,ij->i", q[part], own), biases.take(ids), out=share)
                dq[part] += np.multiply(own, _falling(share)[:, None], out=own)
            np.multiply(q[part], real_word[part, None], out=drawn_to[part])
        klass, klass_bias = np.zeros_like(m.klass), np.zeros_like(m.klass_bias)
        for c, (a, b) in zip(classes.tolist(), spans):
            np.matmul(real[a:b], q[a:b], out=klass[c])
        klass_bias[classes] = np.add.reduceat(real, at_class)
        klass[noise] += push[:, :-1]
        klass_bias[noise] += push[:, -1]

        low, high = m.upto[classes * m.width], m.upto[np.minimum((classes + 1) * m.width, len(m.word))]
        drawn = np.searchsorted(m.upto, low[:, None] + self.rng.random((len(classes), self.word_noise)) * (high - low)[:, None], "right") - 1
        drawn, at_drawn = _runs(np.sort(drawn.clip(0, len(m.word) - 1), None))  # classes follow each other, so those of a class lie together
        weights = -np.diff(at_drawn, append=len(classes) * self.word_noise).astype(np.float32)
        cuts = np.searchsorted(at_drawn, np.arange(len(classes) + 1) * self.word_noise).tolist()
        others = m.word[drawn]
        turned, push = -_beside(others, word_bias[drawn]), np.zeros((len(drawn), q1.shape[1]), np.float32)
        for low, high, (first, last) in zip(cuts, cuts[1:], spans):
            for a in range(first, last, ROWS):
                part = slice(a, min(a + ROWS, last))
                false = _falling(q1[part] @ turned[low:high].T, weights[low:high])
                push[low:high] += false.T @ q1[part]
                dq[part] += false @ others[low:high]
        word, word_bias = np.zeros_like(m.word), np.zeros_like(m.word_bias)
        word[words] = _sums(drawn_to, at_word)
        word_bias[words] = np.add.reduceat(real_word, at_word)
        word[drawn] += push[:, :-1]
        word_bias[drawn] += push[:, -1]
        touched = _present(len(m.word), words, drawn)

        context, position = np.zeros_like(m.context), np.empty_like(m.position)
        for k, (order, here, first, vectors) in enumerate(sides):  # dq summed over the tokens that have a context word at k
            sums = _sums(dq.take(order, 0), first)
            position[k] = vectors.T @ sums
            context[here] += sums @ m.position[k].T
        seen = _present(len(m.context), before)

        self._move("klass", np.arange(len(m.klass)), klass)
        self._move("klass_bias", np.arange(len(m.klass)), klass_bias)
        self._move("word", touched, word[touched])
        self._move("word_bias", touched, word_bias[touched])
        self._move("position", np.arange(CONTEXT), position)
        self._move("context", seen, context[seen])


def _examples(vocabulary: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    doc, words = words_of(texts)
    return model_ids(vocabulary, len(texts), doc, vocabulary.find(words, vocabulary.size))[1:]


def train_everywhere(texts: DataFrame, vocabulary: Vocabulary, start: LogBilinear) -> LogBilinear:
    """Each task learns from all its texts, beginning at `start`; the average of what tasks have, vector by vector."""
    shared = texts.sparkSession.sparkContext.broadcast((vocabulary, start))
    dimensions = start.context.shape[1]
    columns = [f"d{k}" for k in range(dimensions + 1)]
    dense = [("position", CONTEXT * dimensions), ("klass", len(start.klass))]  # with as many rows of `dimensions` numbers
    firsts = np.cumsum([0, len(start.context), len(start.word), *(n for _, n in dense)])

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model = shared.value
        trainer, tokens = Trainer(model, seed=TaskContext.get().partitionId()), 0
        for batch in slices(batches, 0, 4 << 20):
            before, ids = _examples(vocabulary, batch.column(0))
            order = trainer.rng.permutation(len(ids))
            trainer.learn(before.take(order, 0), ids.take(order))
            tokens += len(ids)
        if not tokens:
            return
        m, none = trainer.model, lambda n: np.zeros(n, np.float32)
        parts = [(m.context, none(len(m.context)), trainer.seen["context"]), (m.word, m.word_bias, trainer.seen["word"])]
        parts += [(m.position.reshape(-1, dimensions), none(CONTEXT * dimensions), np.full(CONTEXT * dimensions, tokens)), (m.klass, m.klass_bias, np.full(len(m.klass), tokens))]
        for at, (vectors, bias, seen) in zip(firsts.tolist(), parts):
            rows = np.flatnonzero(seen)
            for low in range(0, len(rows), 20_000):
                some = rows[low : low + 20_000]
                values = np.column_stack([vectors[some], bias[some]]).astype(np.float64) * seen[some][:, None]
                yield pa.RecordBatch.from_arrays([pa.array(some + at), pa.array(seen[some].astype(np.float64)), *map(pa.array, values.T)], names=["row", "seen", *columns])

    schema = "row bigint, seen double, " + ", ".join(f"{c} double" for c in columns)
    sums = texts.mapInArrow(lambda batches: settled(learned(batches)), schema).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("seen", *columns)))
    got = sums.toPandas()  # a row a vector of the model
    rows, values = got["row"].to_numpy(np.int64), (got[columns].to_numpy(np.float64) / got[["seen"]].to_numpy(np.float64)).astype(np.float32)
    model = copy.deepcopy(start)
    for k, (vectors, bias) in enumerate(((model.context, None), (model.word, model.word_bias), (model.position.reshape(-1, dimensions), None), (model.klass, model.klass_bias))):
        own = (rows >= firsts[k]) & (rows < firsts[k + 1])
        vectors[rows[own] - firsts[k]] = values[own, :-1]
        if bias is not None:
            bias[rows[own] - firsts[k]] = values[own, -1]
    return model


def start_sample(texts: DataFrame, documents: float, start_documents: int, start_bytes: int) -> list[pa.RecordBatch]:
    """About `start_documents` of so many documents, the first by a hash, that have `start_bytes` bytes together at most; of
    documents longer than an eighth of that none. The driver sees hashes and lengths before texts. Documents of one hash
    are taken together or not at all."""
    mixed, size = F.xxhash64("doc_id", "text"), F.octet_length("text")
    below = F.pmod(mixed, F.lit(1 << 32)) < F.lit(int(min(1.0, start_documents / max(1.0, documents)) * (1 << 32)))
    short = texts.where(below & (size <= start_bytes // 8)).select(mixed.alias("mixed"), size.alias("size"), "text")
    most = 2 * start_documents
    held = short.select("mixed", "size").orderBy("mixed", "size").limit(most + 1).toPandas()
    ends = held.groupby("mixed", sort=True)["size"].agg(["sum", "count"]).cumsum()
    fit = ends[(ends["sum"] <= start_bytes) & (ends["count"] <= most)]
    if not len(fit):
        return []
    some = short.where(F.col("mixed") <= int(fit.index[-1])).select("text").toArrow().sort_by("text")
    return [b for b in some.to_batches() if b.num_rows]


def fit(texts: DataFrame, vocabulary: Vocabulary, n: np.ndarray, start_documents: int = START_DOCUMENTS, start_bytes: int = START_BYTES, passes: int = 3) -> LogBilinear:
    """texts: doc_id, text. n: training count of each outcome, the last one that of ends, so of documents. The driver passes
    a few times over the start sample; then all documents are learned from where they are."""
    model = LogBilinear(n)
    if not n[-1]:
        return model
    trainer, held = Trainer(model, seed=1, batch=2048), start_sample(texts, n[-1], start_documents, start_bytes)
    for _ in range(passes):
        for batch in slices(iter(held), 0):
            before, ids = _examples(vocabulary, batch.column(0))
            order = trainer.rng.permutation(len(ids))
            trainer.learn(before.take(order, 0), ids.take(order))
    return train_everywhere(texts.select("text"), vocabulary, trainer.model)


def lm_scores(docs: DataFrame, vocabulary_words: int | None = None, head_words: int = 200_000) -> DataFrame:
    """Scores of all documents by a model that learns from those not held out (crc32 of the id mod 10 is not 0).

    Returns doc_id, held_out, n_tokens (words and one end), n_known, train_tokens, base_score and score (log10 of the
    whole text's probability under smoothed word counts and under the model). A null text is an empty one: its end
    alone is scored. A null id is not held out. Repeated rows count, and are scored, each. If nothing is held in,
    all words are unseen. An empty table gives no rows. The model's vocabulary is the `vocabulary_words` commonest words,
    by default the root of the training tokens and 1,022 at least, within `head_words`, which bounds what tasks hold.
    """
    held = F.coalesce(crc_of("doc_id") % 10 == 0, F.lit(False))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    small_batches(docs.sparkSession)
    spark, training = docs.sparkSession, docs.where(~held).select("doc_id", text)
    counts = materialize(word_counts(training.select("text")), "word-counts")
    ends = training.count()
    known = counts.agg(F.count("*").alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    train_tokens, distinct = known["n"] + ends, known["words"] + (ends > 0)
    head = head_counts(counts, head_words).toPandas().sort_values(["n", "word"], ascending=[False, True], ignore_index=True)
    vocabulary = Vocabulary(head["word"].tolist(), head["n"].to_numpy(np.int64), min(vocabulary_words or max(1022, math.isqrt(train_tokens)), len(head)))
    in_model = int(vocabulary.counts[: vocabulary.size].sum())
    model = fit(training, vocabulary, np.concatenate([vocabulary.counts[: vocabulary.size], [known["n"] - in_model, ends]]).astype(np.float64))

    below = np.log10(train_tokens + SMOOTH * (distinct + 1))
    others = np.log10((known["n"] - in_model) + SMOOTH * (known["words"] - vocabulary.size + 1))
    shared = spark.sparkContext.broadcast((vocabulary, np.log10(vocabulary.counts + SMOOTH), model))
    end_log, end_known = float(np.log10(ends + SMOOTH) - below), int(ends > 0)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "model", "rare", "rare_n"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, logs, log_bilinear = shared.value
        for batch in slices(batches, 3, 4 << 20, 20_000):
            n = batch.num_rows
            doc, words = words_of(batch.column(3))
            place = vocabulary.find(words)
            of, before, ids = model_ids(vocabulary, n, doc, place)
            model = np.bincount(of, log_bilinear.log10(before, ids), n)
            common = place >= 0
            log = logs[place[common]] if len(logs) else np.zeros(0)
            base = np.bincount(doc[common], log - below, n) + end_log
            outside = place[common] >= vocabulary.size
            model += np.bincount(doc[common][outside], log[outside] - others, n)
            coded = words.filter(pa.array(~common)).dictionary_encode()
            codes = max(1, len(coded.dictionary))
            key, times = np.unique(doc[~common] * codes + coded.indices.to_numpy(), return_counts=True)
            cut = np.searchsorted(key, np.arange(n + 1) * codes)
            rare = coded.dictionary.take(pa.array(key % codes))
            size = np.bincount(doc, minlength=n)
            arrays = [*batch.columns[:3], pa.array(size + 1), pa.array(np.bincount(doc[common], minlength=n) + end_known), pa.array(base), pa.array(model)]
            arrays += [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), x) for x in (rare, pa.array(times, pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held.alias("held_out"), text)
    first = materialize(rows.mapInArrow(lambda batches: settled(scored(batches)), f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, model double, rare array<string>, rare_n array<bigint>"), "scored")
    rare = first.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("times"))
    matched = rare.join(counts.hint("shuffle_hash"), "word", "left")  # a word has one row in counts, so no key is large there; nothing is sorted
    log = F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)
    sums = matched.groupBy("row").agg(F.sum(F.col("times") * log).alias("log"), F.sum("times").alias("times"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("seen"))
    none = F.lit(0.0)
    return first.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("log") - F.col("times") * float(below), none)).alias("base_score"),
        (F.col("model") + F.coalesce(F.col("log") - F.col("times") * float(others), none)).alias("score"),
    )
