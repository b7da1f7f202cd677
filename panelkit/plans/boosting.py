"""Gradient boosting over binned columns: trees that grow at their best leaf, for squared error or for a quantile.

Columns are cut once into at most 255 bins and held as a small integer each. Growing a tree is a series of aggregates: one
gives, for the newest leaves, the sums of gradients and rows in every bin of every column; splits are chosen from these sums,
which have leaves x columns x bins numbers whatever the rows are. Of two new leaves only the smaller is counted, the other is
the difference. Tasks count their rows as Arrow batches; where rows stand, and what earlier trees say of them, follows from the
trees alone, so nothing is joined or collected and rows are written once, not again for every few trees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import stored


#: Leaves' quantiles are exact in rank up to one part in so many.
QUANTILE_ACCURACY = 10_000


@dataclass(frozen=True)
class Growth:
    """How trees grow. quantile: None for squared error, otherwise the level of the pinball loss."""

    rounds: int = 400
    rate: float = 0.03
    leaves: int = 15
    least: int = 60
    share: float = 0.8
    bins: int = 63
    quantile: float | None = None
    seed: int = 7


@dataclass
class Tree:
    """Nodes by number: a split (column, bin, left, right) sends rows whose bin is at most `bin` left; a leaf has a value."""

    splits: dict[int, tuple[int, int, int, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def depth(self, node: int = 0) -> int:
        return 1 + max(map(self.depth, self.splits[node][2:])) if node in self.splits else 0

    def sql(self) -> str:
        """The tree as a constant: arrays by node of column (-1 for a leaf), bin, left, right and value."""
        nodes = range(1 + max([0, *self.values, *(n for s in self.splits.values() for n in s[2:])]))
        splits = [self.splits.get(n, (-1, 0, 0, 0)) for n in nodes]
        told = [f"'{name}', array({', '.join(str(s[k]) for s in splits)})" for k, name in enumerate(("column", "bin", "left", "right"))]
        return f"named_struct({', '.join(told)}, 'value', array({', '.join(f'{self.values.get(n, 0.0)!r}D' for n in nodes)}))"


def leaf_of(tree: str, depth: int) -> str:
    """SQL over `__bins`: the number of the leaf in which a row ends, for a tree as a constant."""
    return f"aggregate(sequence(1, {max(1, depth)}), 0, (n, k) -> IF({tree}.column[n] < 0, n, IF(__bins[{tree}.column[n]] <= {tree}.bin[n], {tree}.left[n], {tree}.right[n])))"


@dataclass
class Boosted:
    features: tuple[str, ...]
    cuts: list[list[float]]
    base: float
    rate: float
    trees: list[Tree]

    def score(self, df: DataFrame, name: str) -> DataFrame:
        """`df` with the prediction."""
        return score_many(df, {name: self})

    def as_rows(self) -> list[tuple]:
        """What `from_rows` reads: (tree, node, column, bin, left, right, value), plus a row with the base and the cuts."""
        rows: list[tuple] = [(-1, k, -1, -1, -1, -1, self.base, list(map(float, c))) for k, c in enumerate(self.cuts)]
        for k, t in enumerate(self.trees):
            rows += [(k, node, *split, 0.0, []) for node, split in t.splits.items()] + [(k, node, -1, -1, -1, -1, v, []) for node, v in t.values.items()]
        return rows

    SCHEMA = "tree int, node int, column int, bin int, left int, right int, value double, cuts array<double>"

    @staticmethod
    def from_rows(rows: Sequence[tuple], features: Sequence[str], rate: float) -> Boosted:
        heads = sorted((r for r in rows if r[0] < 0), key=lambda r: r[1])
        trees = [Tree() for _ in range(1 + max((r[0] for r in rows), default=-1))]
        for tree, node, column, at, left, right, value, _ in (r for r in rows if r[0] >= 0):
            if column >= 0:
                trees[tree].splits[node] = (column, at, left, right)
            else:
                trees[tree].values[node] = value
        return Boosted(tuple(features), [list(r[7]) for r in heads], heads[0][6] if heads else 0.0, rate, trees)


def score_many(df: DataFrame, models: Mapping[str, Boosted]) -> DataFrame:
    """`df` with the predictions of several models on the same columns and cuts, in one pass."""
    first = next(iter(models.values()))
    if any((m.features, m.cuts) != (first.features, first.cuts) for m in models.values()):
        raise ValueError("the models have different columns or cuts")
    told, given = [(name, m.base, m.rate, m.trees) for name, m in models.items()], df.columns
    width, schema = len(first.features), df.select(*given).schema
    for name in models:
        schema = schema.add(name, "double")

    def scored(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _batches(parts):
            bins, out = [table[f"__b{k}"].to_numpy() for k in range(width)], table.select(given)
            for name, base, rate, trees in told:
                p = np.full(table.num_rows, base)
                for tree in trees:
                    p = p + rate * _at(tree, bins, tree.values)
                out = out.append_column(name, pa.array(p))
            yield from out.combine_chunks().to_batches()

    binned = with_bins(df, first.features, first.cuts)
    return binned.select(*given, *(F.col("__bins")[k].cast("smallint").alias(f"__b{k}") for k in range(width))).mapInArrow(scored, schema)


def cut_points(df: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Cuts of each column into bins of about as many rows, from a sketch of bounded size; fewer for a column with few values.
    Cuts only say where splits may be, so they need not be exact order statistics."""
    levels = [k / bins for k in range(1, bins)]
    known = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features]
    row = df.agg(*(F.percentile_approx(x, levels, 2000).alias(f"c{k}") for k, x in enumerate(known))).first()
    return [sorted(set(row[f"c{k}"] or [])) for k in range(len(features))]


def with_bins(df: DataFrame, features: Sequence[str], cuts: Sequence[Sequence[float]]) -> DataFrame:
    """`df` with `__bins`: the number of cuts below each column's value; a null or NaN is in the first bin."""
    one = []
    for c, at in zip(features, cuts, strict=True):
        x = F.col(c).cast("double")
        known = F.when(x.isNull() | F.isnan(x), F.lit(float("-inf"))).otherwise(x)
        one.append(cuts_below(known, list(at)))
    return df.withColumn("__bins", F.array(*one) if one else F.array().cast("array<int>"))


def cuts_below(x: Column, at: Sequence[float]) -> Column:
    """How many of the sorted cuts are below x, by halving: eight comparisons for 255 cuts."""

    def halve(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x <= at[mid], halve(lo, mid)).otherwise(halve(mid + 1, hi))

    return halve(0, len(at))


#: Nodes of one model have numbers below this; beyond it begin those of the next.
SPAN = 1_000_000

#: Sums of gradients and rows of one node, by column and bin.
Cells = tuple[np.ndarray, np.ndarray]


#: Tasks look at so many rows at a time.
AT_ONCE = 65_536


def _at(tree: Tree, bins: Sequence[np.ndarray], of: Mapping[int, float] | None = None, node: int = 0) -> np.ndarray | float:
    """The number of the node in which each row ends, or what `of` has for it. bins: an array a column."""
    if node not in tree.splits:
        return np.int32(node) if of is None else np.float64(of.get(node, 0.0))
    column, at, left, right = tree.splits[node]
    return np.where(bins[column] <= at, _at(tree, bins, of, left), _at(tree, bins, of, right))


def _batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += part.num_rows
        if n >= AT_ONCE:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


@dataclass
class Residuals:
    """What is known of each model while it grows: the base, rate and level of its loss, its trees since predictions were last
    written, and whether they ever were. A row has __y, __use<k> (a bit for each of 62 models: who learns from it), the columns
    __b<k>, and __p, an array of predictions, if they were written."""

    width: int
    base: list[float]
    rate: list[float]
    level: list[float | None]
    trees: list[list[Tree]]
    written: bool = False

    def bins(self, table: pa.Table) -> list[np.ndarray]:
        return [table[f"__b{k}"].to_numpy() for k in range(self.width)]

    def said(self, table: pa.Table, m: int, own: np.ndarray, bins: Sequence[np.ndarray]) -> np.ndarray:
        """The prediction of model m for the rows `own`, whose bins these are."""
        p = table["__p"].combine_chunks().values.to_numpy().reshape(-1, len(self.base))[own, m] if self.written else np.full(len(own), self.base[m])
        for tree in self.trees[m]:
            p = p + self.rate[m] * _at(tree, bins, tree.values)
        return p

    def each(self, table: pa.Table, models: Sequence[int]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
        """(model, bins, residuals) of the rows that each of these models learns from."""
        every, y = self.bins(table), table["__y"].to_numpy()
        for m in models:
            own = np.flatnonzero((table[f"__use{m // 62}"].to_numpy() >> (m % 62)) & 1)
            if len(own):
                bins = [b[own] for b in every]
                yield m, bins, y[own] - self.said(table, m, own, bins)

    def pulls(self, table: pa.Table, models: Sequence[int]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
        """As `each`, with gradients."""
        for m, bins, miss in self.each(table, models):
            q = self.level[m]
            yield m, bins, miss if q is None else np.where(miss > 0, q, q - 1)


def _counting(pulls: Callable, ahead: Mapping[int, Tree], asked: Mapping[int, Sequence[int]], shape: tuple[int, int]) -> Callable:
    """A task's sums of gradients and rows for each node that is asked for, by column and bin, in one row."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, nodes = {}, 0
        for m, wanted in asked.items():
            place[m], nodes = {n: nodes + k for k, n in enumerate(wanted)}, nodes + len(wanted)
        g, rows = np.zeros((nodes, *shape)), np.zeros((nodes, *shape), np.int64)
        for table in _batches(parts):
            for m, bins, pull in pulls(table, list(asked)):
                node = np.broadcast_to(_at(ahead[m], bins), len(pull))
                for n, k in place[m].items():
                    own = np.flatnonzero(node == n)
                    told = pull[own]
                    for c in range(shape[0]):
                        b = bins[c][own]
                        g[k, c] += np.bincount(b, told, shape[1])
                        rows[k, c] += np.bincount(b, minlength=shape[1])
        yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()]), pa.array([rows.tobytes()])], ["g", "n"])

    return count


def _histograms(rows: DataFrame, counting: Callable, asked: Mapping[int, Sequence[int]], shape: tuple[int, int]) -> dict[int, dict[int, Cells]]:
    """{model: {node: cells}}. The driver adds up a row a task; tasks are as many as `fit_many` allows, whatever the rows are."""
    every, g, n = [(m, node) for m, nodes in asked.items() for node in nodes], 0.0, 0
    for r in rows.mapInArrow(counting, "g binary, n binary").collect():
        g, n = g + np.frombuffer(r["g"]), n + np.frombuffer(r["n"], np.int64)
    g, n = (np.broadcast_to(x, len(every) * shape[0] * shape[1]).reshape(-1, *shape) for x in (g, n))
    out: dict[int, dict[int, Cells]] = {m: {} for m in asked}
    for k, (m, node) in enumerate(every):
        out[m][node] = (g[k], n[k])
    return out


def best_split(held: Cells, least: int) -> tuple[float, int, int] | None:
    """(gain, column, bin) with the largest fall in squared error; the smaller column, then bin, on a tie."""
    g, k = (x.cumsum(1) for x in held)
    total, n = g[:, -1:], k[:, -1:]
    fits = (k >= least) & (n - k >= least)
    gain = g * g / np.maximum(k, 1) + (total - g) ** 2 / np.maximum(n - k, 1) - total * total / np.maximum(n, 1)
    gain = np.where(fits & (gain > 1e-12), gain, 0.0)
    top = gain.max()
    if top <= 0:
        return None
    column, at = divmod(int(np.argmax(gain.ravel() * (1 + 1e-12) >= top)), gain.shape[1])
    return float(gain[column, at]), column, at


class Growing:
    """One tree that grows best leaf first. `wanted` goes on as far as what is known allows and says which nodes it has to
    have counted next; children of all leaves that may still be split are asked for at once, so a tree takes about as many
    rounds of counting as it is deep. What is not taken in the end is forgotten: the tree is the one that single steps give."""

    def __init__(self, growth: Growth):
        self.growth, self.count = growth, 1
        self.tree, self.ahead, self.open = Tree(), Tree(), {0}
        self.held: dict[int, Cells] = {}
        self.choice: dict[int, tuple[float, int, int] | None] = {}
        self.pairs: list[tuple[int, int, int]] = []

    def wanted(self) -> list[int]:
        if not self.held:
            return [0]
        while len(self.open) < self.growth.leaves and any(self.choice[n] for n in self.open):
            waiting = sorted((n for n in self.open if self.choice[n]), key=lambda n: (-self.choice[n][0], n))
            node = waiting[0]
            if node not in self.ahead.splits:
                return self._ask([n for n in waiting if n not in self.ahead.splits][: self.growth.leaves - len(self.open)])
            self.tree.splits[node] = self.ahead.splits[node]
            self.open = (self.open - {node}) | {*self.ahead.splits[node][2:]}
        return []

    def _ask(self, nodes: list[int]) -> list[int]:
        self.pairs = []
        for n in nodes:
            _, column, at = self.choice[n]
            left, right, self.count = self.count, self.count + 1, self.count + 2
            self.ahead.splits[n] = (column, at, left, right)
            rows = self.held[n][1][column]
            low, every = rows[: at + 1].sum(), rows.sum()
            self.pairs.append((n, left, right) if 2 * low <= every else (n, right, left))
        return [small for _, small, _ in self.pairs]

    def counted(self, found: dict[int, Cells]) -> None:
        self.held |= found
        for n, small, large in self.pairs:
            rest = self.held[n][1] - found[small][1]
            self.held[large] = (np.where(rest > 0, self.held[n][0] - found[small][0], 0.0), rest)
        for n in [0] if not self.pairs else [x for p in self.pairs for x in p[1:]]:
            self.choice[n] = best_split(self.held[n], self.growth.least)

    def ended(self) -> Tree:
        for n in self.open:
            g, rows = self.held[n]
            self.tree.values[n] = float(g[0].sum()) / max(1, int(rows[0].sum()))
        return self.tree


def _grown(rows: DataFrame, pulls: Callable, shape: tuple[int, int], growths: Mapping[int, Growth]) -> dict[int, Tree]:
    """A tree for each model, all in the same aggregates. pulls: (model, bins, gradients) of a batch, for some models; shape:
    columns and bins."""
    growing = {m: Growing(g) for m, g in growths.items()}
    while asked := {m: w for m, g in growing.items() if (w := g.wanted())}:
        found = _histograms(rows, _counting(pulls, {m: growing[m].ahead for m in asked}, asked, shape), asked, shape)
        for m in asked:
            growing[m].counted(found[m])
    return {m: g.ended() for m, g in growing.items()}


def grow(rows: DataFrame, width: int, growths: Mapping[int, Growth]) -> dict[int, Tree]:
    """A tree for each model, all in the same aggregates. rows: __m (the model), __bins, __g (the gradient)."""

    def pulls(table: pa.Table, models: Sequence[int]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
        model, g = table["__m"].to_numpy(), table["__g"].to_numpy()
        for m in models:
            own = np.flatnonzero(model == m)
            yield m, [table[f"__b{k}"].to_numpy()[own] for k in range(width)], g[own]

    return _grown(rows.select("__m", "__g", *(F.col("__bins")[k].alias(f"__b{k}") for k in range(width))), pulls, (width, 256), growths)


def fit_many(df: DataFrame, features: Sequence[str], y: str, models: Sequence[tuple[Growth, Column]], keys: Sequence[str] = (), every: int = 25) -> list[Boosted]:
    """Boosted trees of several models on one binned frame, a model for each (growth, rows that it learns from).

    Models grow in step: round after round, one aggregate counts for all of them, so ten models take about the jobs of one.
    They are for squared error or for the quantile of their growth, whose leaves are quantiles of residuals: a value of the
    leaf whose rank is off by a ten-thousandth of the leaf's rows at most, since a leaf may hold most of a table.

    Each tree sees the rows whose hash of keys and round is below `share`. What earlier trees say is computed from them, and
    written every `every` rounds only, so that many rounds do not walk all trees again. Rows without an outcome are left out. Bins are cut by the rows that all models learn from, so
    none sees what lies after its own rows in time; without such rows by all.
    """
    name = "boosted"
    use = F.filter(F.array(*(F.when(c, m) for m, (_, c) in enumerate(models))), lambda m: m.isNotNull())
    known = df.where(F.col(y).isNotNull()).select(*keys, *(c for c in features if c not in keys), F.col(y).cast("double").alias("__y"), use.alias("__use")).where(F.size("__use") > 0)
    known, cores = stored(known, name), df.sparkSession.sparkContext.defaultParallelism
    if known.rdd.getNumPartitions() < cores:  # many rounds read a small frame: every core gets a part of it
        known = stored(known.repartition(cores), name)
    shared = known.where(F.size("__use") == len(models))
    cuts = cut_points(shared if not shared.isEmpty() else known, features, max(g.bins for g, _ in models))
    start = known.select(F.explode("__use").alias("m"), "__y").groupBy("m")
    levels = sorted({g.quantile for g, _ in models if g.quantile is not None})
    bases = {r["m"]: r for r in start.agg(F.avg("__y").alias("mean"), *(F.percentile_approx("__y", q, QUANTILE_ACCURACY).alias(f"q{k}") for k, q in enumerate(levels))).collect()}  # a row a model
    out = []
    for m, (g, _) in enumerate(models):
        base = 0.0 if m not in bases else bases[m]["mean"] if g.quantile is None else bases[m][f"q{levels.index(g.quantile)}"]
        out.append(Boosted(tuple(features), cuts, float(base), g.rate, []))
    width, binned = len(features), with_bins(known, features, cuts)
    by = [F.col(c) for c in keys] or [F.col("__bins"), F.col("__y")]
    bit = lambda k: F.aggregate("__use", F.lit(0).cast("bigint"), lambda s, m: s + F.when(m.between(62 * k, 62 * k + 61), F.pow(F.lit(2.0), m - 62 * k).cast("bigint")).otherwise(0))
    told = [F.col("__bins")[k].cast("smallint").alias(f"__b{k}") for k in range(width)] + [bit(k).alias(f"__use{k}") for k in range((len(models) + 61) // 62)]
    rows = stored(binned.select(*keys, *(["__bins"] if not keys else []), "__y", *told), name)
    state = Residuals(width, [b.base for b in out], [b.rate for b in out], [g.quantile for g, _ in models], [[] for _ in models])
    going = {m: g for m, (g, _) in enumerate(models) if m in bases}
    for k in range(max(g.rounds for g, _ in models)):
        going = {m: g for m, g in going.items() if k < g.rounds}
        if not going:
            break
        some = next(iter(going.values()))
        seen = rows
        if some.share < 1:
            seen = rows.where(F.pmod(F.xxhash64(*by, F.lit(some.seed * 1_000_003 + k)), F.lit(1_000_000)) < int(some.share * 1_000_000))
        seen = seen.drop(*keys, "__bins")
        grown = _grown(seen.coalesce(max(48, cores)), state.pulls, (width, 1 + max(map(len, cuts), default=0)), going)
        going = {m: g for m, g in going.items() if grown[m].splits}
        tails = {m: grown[m] for m, g in going.items() if g.quantile is not None}
        if tails:
            at = [F.percentile_approx("miss", q, QUANTILE_ACCURACY).alias(f"q{i}") for i, q in enumerate(levels)]
            for r in seen.mapInArrow(_leaves(state, tails), "node bigint, miss double").groupBy("node").agg(*at).collect():  # a row a leaf
                m, n = divmod(r["node"], SPAN)
                grown[m].values[n] = r[f"q{levels.index(going[m].quantile)}"]
        for m in going:
            out[m].trees.append(grown[m])
            state.trees[m].append(grown[m])
        if (k + 1) % every == 0:
            kept = [c for c in rows.columns if c != "__p"]
            rows = stored(rows.mapInArrow(_written(state, kept), rows.select(*kept).schema.add("__p", T.ArrayType(T.DoubleType()))), name)
            state.trees, state.written = [[] for _ in models], True
    return out


def _leaves(state: Residuals, trees: Mapping[int, Tree]) -> Callable:
    """Rows of (leaf, residual) of each of these models."""

    def told(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _batches(parts):
            for m, bins, miss in state.each(table, list(trees)):
                node = np.broadcast_to(_at(trees[m], bins), len(miss)).astype(np.int64) + m * SPAN
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(miss)], ["node", "miss"])

    return told


def _written(state: Residuals, kept: Sequence[str]) -> Callable:
    """Rows with __p: what all models say so far."""

    def told(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _batches(parts):
            bins, own = state.bins(table), np.arange(table.num_rows)
            said = np.stack([state.said(table, m, own, bins) for m in range(len(state.base))], 1)
            ends = pa.array(np.arange(table.num_rows + 1, dtype=np.int32) * len(state.base))
            yield from table.select(kept).append_column("__p", pa.ListArray.from_arrays(ends, pa.array(said.ravel()))).combine_chunks().to_batches()

    return told


def fit_boosted(df: DataFrame, features: Sequence[str], y: str, growth: Growth, keys: Sequence[str] = ()) -> Boosted:
    """One model on all rows; see `fit_many`."""
    return fit_many(df, features, y, [(growth, F.lit(True))], keys)[0]
