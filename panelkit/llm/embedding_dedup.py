"""Embedding near-duplicates by sorted projection passes.

In each pass a vector's key is a row of random hyperplane signs, and rows are sorted by that key. Rows with the same
leading bits are a bucket, and all rows of a bucket are compared: a bucket of at most `window` + 1 rows within a sliding
window over the sorted rows, larger ones (counted first) in bounded tiles, however large they are. Passes carry a sketch
of each vector, its components as 8-bit numbers, with a bound of its error: it settles all pairs but those near the
threshold, and only for these are the vectors fetched. Verified pairs of all passes are united. Afterwards links are
counted exactly: all members of a component are compared with each other, in blocks.

A pass is needed for every chance to be in one bucket: passes_for gives 17 of them at 1e4 rows, 35 at 1e6, 107 at 1e9, so
what is shuffled grows a little faster than the rows (as a power of about 1.2).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, running, small_or_plain
from .components import connected_components

BITS = 62
WINDOW = 32
BLOCK = 1024
TILE = 4096
#: What starting a tile costs, in comparisons.
TILE_START = 200_000


def bits_for(rows: int, window: int = WINDOW) -> int:
    """Leading bits of a bucket: keys that spread evenly put half a window at most of `rows` into one."""
    return min(BITS, max(1, math.ceil(math.log2(max(2.0, rows / window)))) + 1)


def passes_for(rows: int, threshold: float, window: int = WINDOW, miss: float = 1e-3) -> int:
    """Passes after which a pair at the threshold has been in different buckets in all of them with probability `miss`
    at most. That holds for every pair, however other rows lie, since buckets are compared whole."""
    met = (1 - math.acos(threshold) / math.pi) ** bits_for(rows, window)
    return max(4, math.ceil(math.log(miss) / math.log(1 - met)))


def _matrix(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(v, np.float64) for v in column.to_numpy(zero_copy_only=False)]


def _unit(v: np.ndarray) -> np.ndarray:
    big = np.abs(v).max()
    v = v / big
    return v / np.sqrt(v @ v)


def _spanning(left: np.ndarray, right: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Enough of these pairs of places to connect what they connect."""
    root = list(range(n))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out = []
    for a, b in zip(left.tolist(), right.tolist()):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _sketches(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as 8-bit numbers, the scale of each, and the length of what rounding leaves out of each."""
    scale = np.abs(unit).max(1) / 127
    coarse = np.rint(unit / scale[:, None])
    return coarse.astype(np.int8), scale, np.linalg.norm(unit - coarse * scale[:, None], axis=1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(turn, cls, coarse, scale, rest) of each run of rows whose vectors have one length."""
    for batch in batches:
        turn, cls, dims, scale, rest = (batch.column(c).to_numpy() for c in ("turn", "cls", "dims", "scale", "rest"))
        cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)] if len(dims) else []
        for a, b in zip(cuts, cuts[1:]):
            coarse = np.frombuffer(b"".join(batch.column("sketch").slice(a, b - a).to_pylist()), np.int8).reshape(b - a, -1)
            yield turn[a:b], cls[a:b], coarse.astype(np.float64), scale[a:b], rest[a:b]


def _window_links(threshold: float, window: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive in the order of (pass, key, cls); each is compared with the `window` before it in its pass.

        The cosine lies within `slack` of what the sketches give. Of pairs that are linked for certain, enough are sent on to
        connect what they connect; pairs near the threshold are all sent on, to be verified."""
        held: tuple = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), np.zeros(0))
        for now in _runs(batches):
            known = len(held[0]) if held[2].shape[1] == now[2].shape[1] else 0
            turn, cls, coarse, scale, rest = (np.concatenate(x) for x in zip(held, now)) if known else now
            sure, open_ = [], []
            for gap in range(1, min(window, len(cls) - 1) + 1):
                late = np.arange(max(gap, known), len(cls))
                early = late - gap
                about = np.einsum("ij,ij->i", coarse[late], coarse[early]) * scale[late] * scale[early]
                slack = rest[late] + rest[early] + rest[late] * rest[early] + 1e-9
                same = turn[late] == turn[early]
                for found, near in ((sure, about - slack >= threshold), (open_, np.abs(about - threshold) < slack)):
                    found.append(np.stack([early, late])[:, same & near])
            if sure:
                a, b = np.array(_spanning(*np.concatenate(sure, 1), len(cls)), np.int64).reshape(-1, 2).T
                c, d = np.concatenate(open_, 1)
                ends = [pa.array(cls[np.concatenate(x)]) for x in ((a, c), (b, d))]
                yield pa.RecordBatch.from_arrays([*ends, pa.array(np.arange(len(a) + len(c)) < len(a))], names=["a", "b", "sure"])
            held = tuple(x[-window:] for x in (turn, cls, coarse, scale, rest))

    return links


def _verified(threshold: float):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows (a, b, left vector, right vector), the pairs that are linked."""
        for batch in batches:
            near = [_unit(x) @ _unit(y) >= threshold for x, y in zip(_matrix(batch.column(2)), _matrix(batch.column(3)))]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return links


def _units(rows: pd.Series) -> np.ndarray:
    return np.vstack([_unit(np.asarray(v, np.float64)) for v in rows])


def _bucket_links(threshold: float):
    def links(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """One tile: block i of a bucket against block j. Enough of its pairs to connect what all of them connect."""
        i, j = key[-2], key[-1]
        x, y = rows[rows["block"] == i], rows[rows["block"] == j]
        ids = (x if i == j else pd.concat([x, y]))["cls"].to_numpy()
        right = _units(y["embedding"]) if len(y) else np.zeros((0, 0))
        shift, label, out = len(ids) - len(y), np.arange(len(ids)), []
        for at in range(0, len(x) if len(y) else 0, 512):
            near = _units(x["embedding"].iloc[at : at + 512]) @ right.T >= threshold
            for k in np.flatnonzero(near.any(axis=1)).tolist():
                others = np.flatnonzero(near[k]) + shift
                found, first = np.unique(label[others], return_index=True)
                fresh = found != label[at + k]
                if fresh.any():
                    out += [(ids[at + k], ids[o]) for o in others[first[fresh]]]
                    label[np.isin(label, found[fresh])] = label[at + k]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return links


def _crowded_links(places: DataFrame, crowded: DataFrame, reps: DataFrame, threshold: float) -> DataFrame | None:
    """Links of all pairs that share a crowded bucket: bucket by bucket or, where that is less work, by comparing all
    rows that are in any of them once. Blocks are dealt by hash, so no bucket is one task."""
    known = crowded.agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("size") / 2).alias("pairs")).first()
    if not known["n"]:
        return None
    cell = ["dims", "turn", "prefix"]
    inside = materialize(places.join(small_or_plain(crowded.select(*cell), known["n"]), cell), "crowd")
    once = inside.select("dims", F.lit(0).alias("turn"), F.lit(0).cast("bigint").alias("prefix"), "cls").distinct()
    if once.count() ** 2 / 2 <= known["pairs"] + TILE_START * known["n"]:
        inside, crowded = once, once.groupBy(*cell).agg(F.count("*").alias("size"))
    cells = crowded.select(*cell, F.ceil(F.col("size") / TILE).cast("int").alias("of"))
    dealt = inside.join(small_or_plain(cells, known["n"]), cell).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("of")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    dealt = dealt.select(*cell, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls")
    tiles = dealt.join(reps.select("cls", "embedding"), "cls").groupBy(*cell, "i", "j")
    return tiles.applyInPandas(_bucket_links(threshold), "a bigint, b bigint")


def _tile_links(threshold: float):
    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """One tile: block i of a component against block j. Each side's vectors meet once; copies count by weight."""
        i, j = key[1], key[2]
        x, y = rows[rows["block"] == i], rows[rows["block"] == j]
        near = _units(x["embedding"]) @ _units(y["embedding"]).T >= threshold
        if i == j:
            np.fill_diagonal(near, False)
            return pd.DataFrame({"cls": x["cls"].to_numpy(), "links": near @ y["copies"].to_numpy()})
        return pd.DataFrame({"cls": np.concatenate([x["cls"], y["cls"]]), "links": np.concatenate([near @ y["copies"].to_numpy(), near.T @ x["copies"].to_numpy()])})

    return count


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, passes: int | None = None, window: int = WINDOW, seed: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept. Pairs with cosine >= threshold in double precision are linked.

    Null and zero vectors, and those with null or non-finite components, link with nothing; nor do vectors of
    different lengths. Equal vectors are compared once and counted by their number, whatever their ids. Rows that share an
    id are vectors of their own: each has its own links, and the component id is the smallest id that links reach. Null ids
    link with nothing, have a null component and are kept. An empty table gives no rows. More passes are made for more rows,
    so that the chance to miss a pair stays the same wherever rows crowd; links inside a component are then exact.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    good = F.col("vec_id").isNotNull() & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    usable = rows.where(good).where(F.exists("embedding", lambda x: x != 0))
    classes = usable.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    reps = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "vectors")  # written, so cls stays
    total = reps.count()
    turns, bits = passes or passes_for(total, threshold, window), bits_for(total, window)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                found = _matrix(batch.column(1))
                keys, sizes = np.zeros((len(found), turns), np.int64), np.array(list(map(len, found)))
                sketch, scale, rest = [b""] * len(found), np.zeros(len(found)), np.zeros(len(found))
                for size in np.unique(sizes).tolist():
                    if size not in planes:
                        planes[size] = np.random.default_rng([seed, size]).normal(size=(size, turns * BITS)).astype(np.float32)
                    of = np.flatnonzero(sizes == size)
                    unit = np.vstack([_unit(found[k]) for k in of])
                    signs = unit.astype(np.float32) @ planes[size] > 0
                    keys[of] = signs.reshape(len(of), turns, BITS) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    coarse, scale[of], rest[of] = _sketches(unit)
                    for k, row in zip(of.tolist(), coarse):
                        sketch[k] = row.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(sketch, pa.binary()), pa.array(scale), pa.array(rest), pa.array(list(keys), pa.list_(pa.int64()))], names=["cls", "dims", "sketch", "scale", "rest", "keys"])

    hashed = materialize(reps.select("cls", "embedding").mapInArrow(keyed, "cls bigint, dims int, sketch binary, scale double, rest double, keys array<bigint>"), "keys")
    spread = hashed.select(F.posexplode("keys").alias("turn", "key"), "cls", "dims", "sketch", "scale", "rest")
    spread = spread.withColumn("prefix", F.shiftright("key", BITS - bits))
    places, bucket = spread.select("dims", "turn", "prefix", "cls"), ["dims", "turn", "prefix"]
    crowded = materialize(places.groupBy(*bucket).agg(F.count("*").alias("size")).where(F.col("size") > window + 1), "crowded")
    sparse = spread.join(small_or_plain(crowded.select(*bucket), crowded.count()), bucket, "left_anti")
    parts = max(1, math.ceil(total * turns / 20_000))
    sorted_rows = sparse.repartitionByRange(parts, *bucket).sortWithinPartitions("dims", "turn", "key", "cls").drop("key", "prefix")  # a bucket is in one partition
    found = materialize(sorted_rows.mapInArrow(_window_links(threshold, window), "a bigint, b bigint, sure boolean"), "pairs")
    vector = lambda side: reps.select(F.col("cls").alias(side), F.col("embedding").alias(f"of_{side}"))
    open_ = found.where("not sure").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(vector("a"), "a").join(vector("b"), "b")
    links = found.where("sure").select("a", "b").union(open_.select("a", "b", "of_a", "of_b").mapInArrow(_verified(threshold), "a bigint, b bigint"))
    more = _crowded_links(places, crowded, reps, threshold)
    components = materialize(connected_components(links if more is None else links.union(more)), "components")

    members = running(components, "component", ["node"]).select("component", "node", F.floor(F.col("place") / BLOCK).cast("int").alias("block"))
    blocks = members.groupBy("component").agg(F.max("block").alias("last"))
    tiles = members.join(blocks, "component").select("component", "node", "block", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
    tiles = tiles.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", F.col("node").alias("cls"))
    dealt = tiles.join(reps.select("cls", "embedding", "copies"), "cls")
    counted = dealt.groupBy("component", "i", "j").applyInPandas(_tile_links(threshold), "cls bigint, links bigint")
    near = counted.groupBy("cls").agg(F.sum("links").alias("links"))

    linked = reps.select("cls", "rep").join(components.withColumnRenamed("node", "cls"), "cls")
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = linked.join(least, "component").join(near, "cls").select("cls", "component_id", "links")
    known = reps.join(known, "cls", "left").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    joined = usable.join(known, "embedding").select("vec_id", "n_links", "component_id")
    single = rows.where(~good | ~F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(single).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
