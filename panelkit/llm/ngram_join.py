"""N-gram Jaccard join: size-banded tiles, hashed bitmaps, then exact intersection of sorted arrays.

Two sets with similarity t differ in few elements, at most k = (1-t)/(1+t) * (sizes). Sets lie in bands by size; for a
band, hash space is cut into half as many ranges again as k. A signature is the hash of what a set holds in one range, so two linked sets
differ in k signatures at most. If all signatures are put in one order, two linked sets have one in common among the first
k + 1 of each: only these are sent. The order puts ranges with several elements first, since one element is easily shared
by chance, then by how often a signature's cell of a counting sketch occurs, rare ones first, so a passage that many
documents share does not bring them together while they have something rarer. The sketch is counted over all sets; it
decides about work, never about links.

Sets that meet, directly or through others, form a cluster. A cluster is ordered by size and cut into blocks of bounded
weight; two blocks make a tile if their sizes allow a link. A first pass over tiles carries hashed bitmaps only: bit
counts bound every overlap from above, and what the bound leaves connected forms smaller clusters. A second pass over
their tiles carries sorted arrays: pairs that pass the bound and are not connected yet are intersected exactly. Equal
sets are one class and need no comparison.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, materialize, quoted, running, settled, slices, small_batches
from .components import connected_components

BAND = 0.75
CACHED_WORDS = 200_000
#: Cells of the sketch that counts signatures, a power of two, and the parts in which it is summed.
SKETCH = 1 << 20
SKETCH_PARTS = 64
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S31, _S29 = np.uint64(31), np.uint64(29)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S31)) * _M1
    x = (x ^ (x >> _S29)) * _M2
    return x ^ (x >> _S31)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_hashed = _WordHash()


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-word shingles; of the whole sequence if it has fewer words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashed.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mix(out + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def set_key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _differ(high: int, percent: int) -> int:
    """The most elements in which two linked sets of at most `high` elements each differ."""
    return (100 - percent) * 2 * high // (100 + percent)


def _starts() -> list[int]:
    out = [1]
    while out[-1] < 1 << 50:
        out.append(max(out[-1] + 1, math.ceil(BAND ** -len(out))))
    return out


#: Smallest size in each band; bands 0, 1, 2, ... cover all sizes from 1.
BAND_STARTS = _starts()


def bands_of(size: int, percent: int) -> list[int]:
    """The band of a set's own size, and those after it in which a linked set can lie."""
    out = [bisect.bisect_right(BAND_STARTS, size) - 1]
    while size * 100 >= percent * BAND_STARTS[out[-1] + 1]:
        out.append(out[-1] + 1)
    return out


def signatures(s: np.ndarray, percent: int) -> list[tuple[np.ndarray, int]]:
    """For each band of a set: its signatures, and how many of them it has to send, k + 1. If fewer ranges than that have
    elements, signatures of ranges without any make up the number, in an order of their own, which is the same for all.
    The two highest bits of a signature say whether its range has no element, one, or several."""
    out = []
    for band in bands_of(len(s), percent):
        keep = _differ(BAND_STARTS[band + 1] - 1, percent) + 1
        ranges = keep + keep // 2 + 1
        where = ((s >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        content, held = np.add.reduceat(_mix(s), first), where[first]
        many = np.minimum(np.diff(np.r_[first, len(s)]), 2).astype(np.uint64)
        found = (_mix(content + _mix(held * _M1 + np.uint64(band + 1))) >> np.uint64(2)) | (many << np.uint64(62))
        if len(found) < keep:
            empty = np.sort(_mix(_mix(np.setdiff1d(np.arange(ranges, dtype=np.uint64), held) * _M1 + np.uint64(band + 1))) >> np.uint64(2))
            found = np.r_[found, empty[: keep - len(found)]]
        out.append((found, keep))
    return out


def rarest(found: np.ndarray, keep: int, sketch: np.ndarray) -> np.ndarray:
    """The first `keep` signatures in the order of (elements of the range: several, one, none; count of the sketch's cell;
    signature)."""
    if len(found) <= keep:
        return found
    order = np.lexsort((found, sketch[found & np.uint64(len(sketch) - 1)], np.uint64(3) - (found >> np.uint64(62))))
    return found[order[:keep]]


def bitmap(s: np.ndarray) -> np.ndarray:
    """Packed bits by the elements' hashes, twice as many bits as elements or more (512 to 65,536)."""
    width = 1 << min(16, max(9, (2 * len(s)).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits)


def _bit_rows(packed: list[np.ndarray]) -> np.ndarray:
    """Bits of all as rows of one width, wider ones folded: a bit's place is its number modulo the width."""
    width = 8 * min(map(len, packed))
    return np.array([np.unpackbits(p).reshape(-1, width).max(0) for p in packed], np.float32)


def open_pairs(size: np.ndarray, packed: list[np.ndarray], left: int, percent: int, inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, need) of the pairs that may be linked: among all (inside), or of the first `left` with the others.

    A bit that only one of two sets has is an element less to share, so bit counts, all from one matrix product, bound
    the overlap from above. need is the overlap that a link takes.
    """
    bits = _bit_rows(packed)
    held = bits.sum(1)
    first, second = (slice(None), slice(None)) if inside else (slice(0, left), slice(left, None))
    need = -(-percent * (size[first, None] + size[None, second]) // (100 + percent))
    most = np.minimum(size[first, None] - held[first, None], size[None, second] - held[None, second]) + bits[first] @ bits[second].T
    open_ = np.minimum(np.minimum(most, size[first, None]), size[None, second]) >= need - 0.5
    a, b = np.nonzero(np.triu(open_, 1) if inside else open_)
    return a, b + (0 if inside else left), need[a, b]


def tile_links(size: np.ndarray, packed: list[np.ndarray], sets: list[np.ndarray] | None, left: int, percent: int, inside: bool) -> list[tuple[int, int]]:
    """Pairs that connect what this tile connects. With sets, overlaps are exact; without, the bound alone decides."""
    root, out = list(range(len(size))), []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b, need in zip(*(x.tolist() for x in open_pairs(size, packed, left, percent, inside))):
        x, y = find(a), find(b)
        if x == y:
            continue
        if sets is not None:
            u, v = sets[a], sets[b]
            at = np.searchsorted(u, v)
            if np.count_nonzero(u[np.minimum(at, len(u) - 1)] == v) < need:
                continue
        root[max(x, y)] = min(x, y)
        out.append((a, b))
    return out


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in pc.fill_null(column, ""):
        yield memoryview(x.as_buffer()).tobytes() if x.as_buffer() is not None else b""


def shingled(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, set (a hash of the whole set; null without words), signatures of all bands and bands (for each
    how many signatures, and how many of them are to be sent); null where the task has sent them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches, 1, rows=1000):
            sizes, names, found, bands = [], [], [], []
            for text in _texts(part.column(1)):
                s = shingle_set(text, n)
                key = set_key(s)
                sizes.append(len(s))
                names.append(key if len(s) else None)
                fresh = signatures(s, percent) if len(s) and key not in seen else None
                found.append(np.concatenate([x for x, _ in fresh]).view(np.int64) if fresh else None)
                bands.append([y for x, keep in fresh for y in (len(x), keep)] if fresh else None)
                seen.add(key)
            arrays = [part.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "set", "signatures", "bands"])

    kept = docs.select(quoted(id_col).cast("bigint").alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    return kept.mapInArrow(lambda batches: settled(rows(batches), _hashed), "doc_id bigint, n_shingles bigint, set bigint, signatures array<bigint>, bands array<int>")


def counting_sketch(first: DataFrame) -> np.ndarray:
    """How often signatures fall in each of SKETCH cells, over all sets. Tasks count, cells are summed in Spark in parts, so
    the driver gets SKETCH numbers whatever the input."""
    part = SKETCH // SKETCH_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(SKETCH, np.int64)
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            cells += np.bincount((values & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        if cells.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([cells[k * part : (k + 1) * part].astype("<u4").tobytes() for k in range(SKETCH_PARTS)], pa.binary())], names=["k", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of k."""
        now, total = None, np.zeros(part, np.int64)
        for batch in batches:
            for k, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != now and now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["k", "cells"])
                    total = np.zeros(part, np.int64)
                now, total = k, total + np.frombuffer(cells, "<u4")
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["k", "cells"])

    counted = first.where("signatures is not null").select("signatures").mapInArrow(lambda b: settled(count(b)), "k int, cells binary")
    summed = counted.repartition("k").sortWithinPartitions("k").mapInArrow(lambda b: settled(add(b)), "k int, cells binary")
    out = np.zeros(SKETCH, np.int64)
    for row in summed.collect():
        out[row["k"] * part : (row["k"] + 1) * part] = np.frombuffer(row["cells"], np.int64)
    return np.minimum(out, np.iinfo(np.uint32).max).astype(np.uint32)


def sent_signatures(first: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(set, signature): of each set and band, those that have to be sent."""
    shared = first.sparkSession.sparkContext.broadcast(sketch)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                values, starts = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1).offsets.to_numpy()
                out = []
                for k, bands in enumerate(batch.column(2).to_pylist()):
                    low, kept = starts[k] - starts[0], []
                    for size, keep in zip(bands[0::2], bands[1::2]):
                        kept.append(rarest(values[low : low + size], keep, shared.value))
                        low += size
                    out.append(np.concatenate(kept).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["set", "signatures"])

    given = first.where("signatures is not null").select("set", "signatures", "bands")
    return given.mapInArrow(lambda b: settled(rows(b)), "set bigint, signatures array<bigint>").select("set", F.explode("signatures").alias("signature"))


#: Bytes of sets or bitmaps that a task sends on at a time, at most (or one row's).
TILE_BYTES = 16 << 20
_TILE = "cluster bigint, i int, j int, block int, set bigint, size int, held binary"


def _tile_rows(n: int, exact: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From (text, set, block, cluster, first, last): what a tile has to know of the set, once for each of its tiles,
        which are those of its block with the blocks from first to last."""
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        names = ["cluster", "i", "j", "block", "set", "size", "held"]
        for part in slices(batches, 0, rows=500):
            out: list[tuple] = []
            for text, name, block, cluster, first, last in zip(_texts(part.column(0)), *(part.column(c).to_pylist() for c in range(1, 6))):
                s = shingle_set(text, n)
                if set_key(s) != name:  # another row with this id
                    continue
                held = (s if exact else bitmap(s)).tobytes()
                for other in range(first, last + 1):
                    out.append((cluster, min(block, other), max(block, other), block, name, len(s), held))
                    if len(out) * len(held) > TILE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                        out = []
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names=names)

    return lambda batches: settled(rows(batches), _hashed)


def _settle(percent: int, exact: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of their tile; a tile's weight is bounded, so it is held whole."""

        def settle(tile: tuple, held: dict[int, tuple]) -> pa.RecordBatch:
            """held: by set, so that a set that two rows carry is there once."""
            ordered = sorted(held.items(), key=lambda x: (x[1][0] != tile[1], x[0]))
            left, inside = sum(x[0] == tile[1] for x in held.values()), tile[1] == tile[2]
            found = []
            if len(ordered) > 1 and (inside or 0 < left < len(ordered)):
                sets = [np.frombuffer(x[2], np.uint64) for _, x in ordered] if exact else None
                packed = list(map(bitmap, sets)) if exact else [np.frombuffer(x[2], np.uint8) for _, x in ordered]
                found = tile_links(np.array([x[1] for _, x in ordered]), packed, sets, left, percent, inside)
            return pa.RecordBatch.from_arrays([pa.array([ordered[p[side]][0] for p in found], pa.int64()) for side in (0, 1)], names=["a", "b"])

        now, held = None, {}
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(7))):
                if row[:3] != now:
                    if now is not None:
                        yield settle(now, held)
                    now, held = row[:3], {}
                held[row[4]] = (row[3], row[5], row[6])
        if now is not None:
            yield settle(now, held)

    return lambda batches: settled(rows(batches))


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block_sets: int = 512, block_elements: int = 400_000, broadcast_rows: int = 300_000) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Linked: 100 * |intersection| >= percent * |union| of the sets of distinct n-word shingles; words are runs of
    characters other than ASCII white space, A-Z lower-cased. Fewer than n words are one shingle. Null and empty texts
    have an empty set and link with nothing. Rows with one text are linked. A null id has a null component_id. An empty
    table gives no rows. Links are found in full, except that different sets with one 64-bit hash count as equal. At most
    `broadcast_rows` rows of six numbers are broadcast; beyond that, texts of the rows that meet others are shuffled.
    """
    small_batches(docs.sparkSession)
    first = materialize(shingled(docs, id_col, text_col, n, percent), "shingled")
    classes = materialize(first.where("set is not null and doc_id is not null").groupBy("set").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")), "classes")
    same = Window.partitionBy("signature")
    sent = sent_signatures(first, counting_sketch(first))
    meetings = sent.withColumn("low", F.min("set").over(same)).where("low < set").select(F.col("low").alias("a"), F.col("set").alias("b")).distinct()
    bounded = materialize(connected_components(meetings), "clusters")
    for exact in (False, True):
        members = running(bounded.join(classes.withColumnRenamed("set", "node"), "node"), "component", ["n", "node"], "n")
        block = F.floor(F.col("place") / block_sets) + F.floor(F.col("before") / block_elements)
        members = materialize(members.select("component", "node", "rep", "n", block.cast("int").alias("block")), "members")
        blocks = members.groupBy("component", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
        other = blocks.select("component", F.col("block").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        # blocks are in the order of size, so those whose sizes allow a link lie side by side
        near = blocks.join(other, "component").where(100 * F.least("high", "high2") >= percent * F.greatest("low", "low2"))
        near = near.groupBy("component", "block").agg(F.min("other").alias("first"), F.max("other").alias("last"))
        wanted = members.join(near, ["component", "block"]).select(F.col("rep").alias("doc_id"), F.col("node").alias("set"), "block", F.col("component").alias("cluster"), "first", "last")
        few = F.broadcast(wanted) if members.count() <= broadcast_rows else wanted
        texts = docs.select(quoted(id_col).cast("bigint").alias("doc_id"), quoted(text_col).cast("string").alias("text")).join(few, "doc_id")
        held = texts.select("text", "set", "block", "cluster", "first", "last").mapInArrow(_tile_rows(n, exact), _TILE)
        ordered = held.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
        bounded = connected_components(ordered.mapInArrow(_settle(percent, exact), "a bigint, b bigint"))
        bounded = materialize(bounded, "components")
    components = bounded

    named = classes.withColumnRenamed("set", "node")
    joined = named.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    smallest = joined.join(least, "component").select(F.col("node").alias("set"), "component_id")
    out = first.select("doc_id", "n_shingles", "set").join(smallest, "set", "left")
    alone = F.col("set").isNull() | F.col("doc_id").isNull()
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row of `docs` for each component of linked texts, columns as they were: that with the smallest id, of such with one
    id the first that is read; a row with a null id stays only where all are null.

    Every row is a document of its own, so rows that repeat in id and text leave one, and so do null ids. Rows are told apart by
    their number in the order of reading: `docs` has to be a table that is read, as every stage's is, so that it has the same
    numbers whenever it is read again. Null and empty texts link with nothing and stay.
    """
    row, was = free_name(docs, "row_number"), free_name(docs, "was_id")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    found = jaccard_join(numbered, n, percent, row, text_col).where("n_shingles > 0")
    named = materialize(found.join(numbered.select(F.col(row).alias("doc_id"), quoted(id_col).alias(was)), "doc_id"), "named")
    order = F.struct(F.col(was).isNull(), F.col(was), F.col("doc_id"))
    kept = named.groupBy("component_id").agg(F.min(order).alias("x"), F.count("*").alias("n")).where("n > 1")
    kept = materialize(kept.select("component_id", F.col("x.doc_id").alias("kept")), "kept")
    gone = materialize(named.join(kept, "component_id").where("doc_id <> kept").select(F.col("doc_id").alias(was)), "gone")
    few = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    return numbered.join(few, numbered[row] == gone[was], "left_anti").drop(row)
