"""Hard negatives by exact integer inner products, several candidates to a multiplication.

Components become integers. Candidates' components, made non-negative by a bias, lie side by side in fields of one wide
integer, as wide as the largest sum needs; an anchor's component multiplies that integer once, products add up field by
field without touching each other, and unpacking gives the exact score of every candidate. While two fields or more fit 52
bits, words are whole numbers in doubles and products are matrix products; beyond that they are Python's integers, as wide
as needed.

The anchors are a stated query set: blocks of anchors meet blocks of rows, so a tile of bounded size is all that a task
holds, whatever the labels are. Tiles give the best few of each anchor, which meet per anchor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, quoted

SCALE = 256
#: Most rows, and most components, of either side of a tile.
TILE_ROWS, TILE_ELEMENTS = 32_768, 8 << 20
#: Most scores that a task holds at a time.
SCORES = 4 << 20
ENDS = (-(2**63) + 1, 2**63 - 1)


def inner_products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products (anchors by rows, int64) of whole numbers in doubles; those beyond a long are cut to its ends."""
    n, dims = rows.shape
    if not n or not len(anchors) or not dims:
        return np.zeros((len(anchors), n), np.int64)
    low = min(0.0, float(rows.min()))
    most = max(sum(map(abs, map(int, a))) for a in anchors[np.argsort(np.abs(anchors).sum(1))[-2:]])
    most = (most + most // 1000 + 1) * max(1, int(float(rows.max())) - int(low))
    width = most.bit_length() + 1
    if 52 // width >= 1:
        return _in_doubles(anchors, rows, low, width)
    return _in_wide_integers(anchors, rows, int(low), width)


def _in_doubles(anchors: np.ndarray, rows: np.ndarray, low: float, width: int) -> np.ndarray:
    fields, n = 52 // width, len(rows)
    biased = np.zeros((-(-n // fields) * fields, rows.shape[1]))
    biased[:n] = rows - low
    shifts = 2.0 ** (width * np.arange(fields))
    words = np.einsum("wfd,f->wd", biased.reshape(-1, fields, rows.shape[1]), shifts)
    middle = 1 << (width - 1)
    packed = (anchors @ words.T).astype(np.int64) + sum(middle << (width * k) for k in range(fields))
    apart = (packed[:, :, None] >> (width * np.arange(fields))) & ((1 << width) - 1)
    back = (anchors.sum(1) * low).astype(np.int64)
    return apart.reshape(len(anchors), -1)[:, :n] - middle + back[:, None]


def _in_wide_integers(anchors: np.ndarray, rows: np.ndarray, low: int, width: int) -> np.ndarray:
    size, n, dims = -(-width // 8), len(rows), rows.shape[1]
    whole = [[int(x) for x in row] for row in rows]
    words = [int.from_bytes(b"".join((row[j] - low).to_bytes(size, "little") for row in whole), "little") for j in range(dims)]
    middle = 1 << (8 * size - 1)
    offset = int.from_bytes(middle.to_bytes(size, "little") * n, "little")
    out = np.zeros((len(anchors), n), np.int64)
    for k, a in enumerate([[int(x) for x in a] for a in anchors]):
        packed = (sum(x * w for x, w in zip(a, words)) + offset).to_bytes(size * n + 1, "little")
        back = low * sum(a) - middle
        out[k] = [min(max(int.from_bytes(packed[i * size : (i + 1) * size], "little") + back, ENDS[0]), ENDS[1]) for i in range(n)]
    return out


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest allowed scores of each row, the lower column first on ties; fewer if there are fewer."""
    rows, n = scores.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if max(abs(int(scores.max())), abs(int(scores.min()))) < 2**62 // n:
        order = np.where(allowed, scores * n + np.arange(n - 1, -1, -1), ENDS[0])
        top = np.argpartition(order, n - min(k, n), 1)[:, n - min(k, n) :]
    else:
        top = np.array([[*np.flatnonzero(a)[np.argsort(-s[a], kind="stable")][:k], *np.flatnonzero(~a), *range(n)][: min(k, n)] for s, a in zip(scores, allowed)])
    row = np.repeat(np.arange(rows), top.shape[1])
    kept = allowed[row, top.ravel()]
    return row[kept], top.ravel()[kept]


def _by_length(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, whole numbers) of the vectors of each length."""
    vec = table.column("vec").combine_chunks()
    vec = vec if isinstance(vec, pa.ListArray | pa.LargeListArray) else pa.concat_arrays(vec.chunks)
    lengths = pc.list_value_length(vec).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        flat = vec.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield int(d), at, np.floor(flat * SCALE).reshape(len(at), int(d))


def _tile(positives: bool, k: int):
    """Of a tile, the k best rows for each anchor: of its label, or, for each of its positives, of other labels in range."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = []
        if anchors.num_rows and rows.num_rows:
            rows = rows.sort_by("id")
            mine, theirs = ([t.column(c).to_numpy() for c in ("id", "group")] for t in (anchors, rows))
            held = {d: (at, x) for d, at, x in _by_length(rows)}
            for d, at, x in _by_length(anchors):
                if d in held:
                    there, y = held[d]
                    step = max(1, SCORES // len(there))
                    for b in range(0, len(at), step):
                        found += _scored(at[b : b + step], x[b : b + step], there, y, mine, theirs, anchors, positives, k)
        whole = [np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found) if found else range(5))]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("anchor_id", "place", "positive_score", "other_id", "score"), whole)})

    return run


def _scored(at, x, there, y, mine, theirs, anchors: pa.Table, positives: bool, k: int) -> list[tuple[np.ndarray, ...]]:
    ids, same = theirs[0][there], mine[1][at][:, None] == theirs[1][there][None, :]
    if positives:
        out = []
        for group in np.unique(mine[1][at]):
            a, c = np.flatnonzero(mine[1][at] == group), np.flatnonzero(theirs[1][there] == group)
            scores = inner_products(x[a], y[c])
            row, col = best(scores, mine[0][at][a][:, None] != ids[c][None, :], k)
            out.append((mine[0][at][a][row], np.zeros(len(row), np.int64), scores[row, col], ids[c][col], scores[row, col]))
        return out
    scores, out = inner_products(x, y), []
    ranges = [anchors.column("positive_scores")[int(i)].as_py() for i in at]
    for place in range(max(map(len, ranges))):
        a = np.array([i for i, p in enumerate(ranges) if place < len(p)], np.int64)
        upper = np.array([ranges[i][place] for i in a], np.int64)
        lower = np.array([-(-4 * ranges[i][place] // 5) for i in a], np.int64)
        row, col = best(scores[a], ~same[a] & (scores[a] >= lower[:, None]) & (scores[a] <= upper[:, None]), k)
        out.append((mine[0][at][a][row], np.full(len(row), place), upper[row], ids[col], scores[a][row, col]))
    return out


def _met(anchors: DataFrame, rows: DataFrame, sizes: tuple[int, int, int], positives: bool, k: int) -> DataFrame:
    """The k best of all tiles: (anchor_id, place, positive_score, other_id, score, rank)."""
    n_anchors, n_rows, dims = sizes
    per = max(1, min(TILE_ROWS, TILE_ELEMENTS // max(1, dims)))
    down, across = max(1, math.ceil(n_anchors / per)), max(math.ceil(n_rows / per), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    number = F.monotonically_increasing_id()
    left = anchors.withColumn("down", F.pmod(number, F.lit(down))).withColumn("across", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(across - 1).cast("bigint"))))
    right = rows.withColumn("across", F.pmod(number, F.lit(across))).withColumn("down", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(down - 1).cast("bigint"))))
    schema = "anchor_id bigint, place bigint, positive_score bigint, other_id bigint, score bigint"
    tiles = left.groupBy("down", "across").cogroup(right.groupBy("down", "across")).applyInArrow(_tile(positives, k), schema)
    order = Window.partitionBy("anchor_id", "place").orderBy(F.col("score").desc(), "other_id")
    return tiles.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mining_rows(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", group: Column | None = None, label_col: str = "label") -> DataFrame:
    """(id, vec, group) of the rows that take part: no null id, label, vector or component, and no component that is not
    finite, be it only after scaling."""
    whole = quoted(vec_col)
    finite = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) * SCALE < float("inf")))
    told = vectors.where(quoted(id_col).isNotNull() & quoted(label_col).isNotNull() & whole.isNotNull() & finite)
    return told.select(quoted(id_col).cast("bigint").alias("id"), whole.alias("vec"), (quoted(label_col) if group is None else group).cast("bigint").alias("group"))


def hard_negatives(rows: DataFrame, anchor: Column, k: int = 5) -> DataFrame:
    """For the rows (id, vec, group) that `anchor` chooses, and each of their positives, the k hardest negatives.

    A score is the inner product of the whole numbers floor(256 * x). An anchor's positives are its k best other rows of the
    same group; a positive's negatives are the k best rows of other groups whose score is at least four fifths of the
    positive's and at most as high. Ties go to the smaller id. Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    Vectors of other lengths are not compared. Rows that share an id are rows of their own, but never positives of that
    id; as anchors they are one, the least by group, then vector. Scores beyond a long count as its end. Empty vectors
    have a score of 0. An empty table, or one without anchors, gives no rows; further columns are not looked at.
    """
    rows = materialize(rows.select("id", "vec", "group"), "mining")
    anchors = rows.where(anchor).groupBy("id").agg(F.min(F.struct("group", "vec")).alias("x"))
    anchors = materialize(anchors.select("id", F.col("x.vec").alias("vec"), F.col("x.group").alias("group")), "anchors")
    n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    sizes = (anchors.count(), n, dims)
    near = materialize(_met(anchors, rows, sizes, True, k), "positives")
    each = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("x"))
    asked = anchors.join(each.select(F.col("anchor_id").alias("id"), F.transform("x", lambda p: p["score"]).alias("positive_scores")), "id")
    far = _met(asked, rows, sizes, False, k)
    named = near.select("anchor_id", (F.col("rank") - 1).cast("bigint").alias("place"), F.col("other_id").alias("positive_id"))
    out = far.join(named, ["anchor_id", "place"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mined(vectors: DataFrame) -> DataFrame:
    """Rows whose id is divisible by 7 have the next label of ten; those whose id is divisible by 100 are the anchors."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(mining_rows(vectors, group=moved), F.col("id") % 100 == 0)


#: The same in DuckDB's SQL, for tables whose vectors have one length and whose ids do not repeat.
MINED_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) QUALIFY row_number() OVER w <= 5
"""
