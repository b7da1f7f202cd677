"""Best-fit packing of tokenised documents into fixed-capacity sequences.

Each document becomes its token ids followed by one end id. Only documents longer than the capacity are cut. All pieces of
the corpus are packed together by best-fit decreasing: longest piece first, each into the open sequence that it leaves
fullest, which a segment tree over remaining capacities finds. Pieces of one length are alike, so the tree packs lengths
with their multiplicities (a histogram of at most `capacity` rows, counted in Spark); the outcome is a plan of runs, in
which the pieces of a length whose ranks lie in a run have consecutive sequences. Tasks then place each piece by its rank.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, materialize, settled, slices, small_batches

#: Latin letters, then ASCII marks that are neither an apostrophe nor part of a special token. Both runs are
#: separate pre-tokens for a tokenizer that splits letters from marks, so they can be looked up separately.
_LETTERS, _MARKS = r"A-Za-zÀ-ÖØ-öø-ÿ", r"!\"#$%&()*+,\-./:;=?@\[\]\\^_`{}~"
_SPLIT = rf"^(?P<letters>[{_LETTERS}]+)(?P<marks>[{_MARKS}]*)$"
#: An added token with such a character and without spaces is never in a word that is split.
_APART = re.compile(rf"\S*[^{_LETTERS}{_MARKS}\s]\S*")
#: The normalizer and pre-tokenizer under which words can be tokenised one by one, and split as above.
_BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "truncation": None,
    "padding": None,
}
_CACHED_WORDS = 200_000
_CHUNK_WORDS = 100_000
#: Bytes of text that a task tokenises at a time, at most (or one row's); what they took goes back to the system before the next.
_SLICE_BYTES = 4 << 20


class CapacityTree:
    """Open sequences by remaining capacity 0..capacity, in a segment tree that counts them below each node. Those of one
    remaining capacity are kept as runs (first, how many)."""

    def __init__(self, capacity: int):
        self.leaves = 1 << max(1, capacity).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, room: int, first: int, many: int) -> None:
        self.runs.setdefault(room, []).append((first, many))
        self._changed(room, many)

    def _changed(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int, int] | None:
        """Remove and return (room, first, how many) of a run of the tightest sequences with room for `need`."""
        count, node = self.count, need + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not count[node]:
                    node += 1
        room = node - self.leaves
        first, many = self.runs[room].pop()
        self._changed(room, -many)
        return room, first, many


def best_fit_decreasing(lengths: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Pack `lengths` (how many pieces of each length) as if one by one, longest first.

    Returns runs (length, rank, many, sequence, each, offset): the pieces of `length` whose rank is rank + i, for i from
    0 to many - 1, go to sequence + i // each, at offset + (i % each) * length. A piece's tightest sequence is again the
    tightest for the next piece of its length while it has room, so a sequence takes `each` of them in a row.
    """
    tree, plan, opened = CapacityTree(capacity), [], 0
    for length in sorted(lengths, reverse=True):
        rank, left = 0, lengths[length]
        while left:
            found = tree.take(length)
            if found is None:
                each = capacity // length
                found = (capacity, opened, -(-left // each))
                opened += found[2]
            room, first, many = found
            each = room // length
            full = min(many, left // each)
            put = min(left, many * each)
            plan.append((length, rank, put, first, each, capacity - room))
            if full and room > each * length:
                tree.add(room - each * length, first, full)
            used = full
            if put > full * each:  # the last one that this run uses takes fewer
                tree.add(room - (put - full * each) * length, first + full, 1)
                used += 1
            if used < many:
                tree.add(room, first + used, many - used)
            rank, left = rank + put, left - put
    return plan


class WordIds:
    """Token ids of whole words. A task keeps one, so that a word is tokenised once, not once a use.

    `by_word` is false if the file's normalizer or pre-tokenizer is another than the one for which texts can be tokenised
    word by word; texts then are tokenised whole. Runs of letters are lower-cased here and go to the file's model itself, in
    the letters that its pre-tokenizer has for their bytes, as its normalizer has nothing left to do to them: that takes a
    quarter of the time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            shape = json.load(file)
        self.by_word = all(shape[k] == v for k, v in _BY_WORD.items()) and not any(
            x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] or not _APART.fullmatch(x["content"]) for x in shape["added_tokens"]
        )
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {k: level.pre_tokenize_str(chr(k))[0][0] for k in range(0xC0, 0x100)}
        self.clear()

    def clear(self) -> None:
        self.number, self.flat = {"": 0}, np.zeros(1 << 16, np.uint32)
        self.start, self.length, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def _of_letters(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Ids of all words in a row, and how many each word has; here of lower-case letters alone."""
        of = self.tokenizer.model.tokenize
        rows = [[t.id for t in of(w if w.isascii() else w.translate(self.bytes))] for w in words]
        return list(chain.from_iterable(rows)), list(map(len, rows))

    def _of_others(self, words: list[str]) -> tuple[list[int], np.ndarray]:
        coded = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        return coded.ids, np.bincount(np.array(coded.word_ids, np.int64), minlength=len(words))

    def _numbers(self, words: pa.Array, ids_of: Callable) -> np.ndarray:
        """The number of each of some distinct words."""
        held = words.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in held if w not in self.number]
        for at in range(0, len(new), 5000):
            part = new[at : at + 5000]
            ids, sizes = ids_of(part)
            first = len(self.number)
            self.flat = _grown(self.flat, self.used + len(ids))
            self.start, self.length = _grown(self.start, first + len(part)), _grown(self.length, first + len(part))
            self.flat[self.used : self.used + len(ids)] = ids
            self.length[first : first + len(part)] = sizes
            self.start[first : first + len(part)] = self.used + np.cumsum(sizes) - sizes
            self.used += len(ids)
            self.number.update(zip(part, range(first, first + len(part))))
        return np.fromiter(map(self.number.__getitem__, held), np.int64, len(held))

    def table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each word has."""
        if len(self.number) > _CACHED_WORDS:
            self.clear()
        letters, marks = pc.extract_regex(words, _SPLIT).flatten()  # null for words that are not split
        letters, rest = pc.utf8_lower(letters).dictionary_encode(), pc.coalesce(marks, words).dictionary_encode()
        both = np.empty(2 * len(words), np.int64)
        both[0::2] = np.append(self._numbers(letters.dictionary, self._of_letters), 0)[pc.fill_null(letters.indices, -1).to_numpy()]
        both[1::2] = self._numbers(rest.dictionary, self._of_others)[rest.indices.to_numpy()]
        sizes = self.length[both]
        return self.flat[_ranges(self.start[both], sizes)], sizes[0::2] + sizes[1::2]


def _grown(a: np.ndarray, least: int) -> np.ndarray:
    return a if least <= len(a) else np.concatenate([a, np.zeros(max(least - len(a), len(a)), a.dtype)])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0]..start[0]+size[0]-1, then the same of the next, and so on."""
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    kind = np.int32 if max(total, int(start.max(initial=0))) < 1 << 30 else np.int64
    return np.repeat((start - (end - size)).astype(kind), size) + np.arange(total, dtype=kind)


def token_rows(texts: pa.Array, held: WordIds) -> Iterator[np.ndarray]:
    """Token ids of each text (null: none), in order."""
    if not held.by_word:
        for text in texts.to_pylist():
            yield np.array(held.tokenizer.encode(text or "", add_special_tokens=False).ids, np.uint32)
        return
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    flat, per_word = held.table(coded.dictionary)
    first, codes = np.cumsum(per_word) - per_word, coded.indices.to_numpy()
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + _CHUNK_WORDS, "right")) - 1)
        part = codes[bounds[row] : bounds[last]]
        sizes = per_word[part]
        ids, ends = flat[_ranges(first[part], sizes)], np.concatenate([[0], np.cumsum(sizes)])
        cuts = ends[bounds[row : last + 1] - bounds[row]]
        for k in range(last - row):
            yield ids[cuts[k] : cuts[k + 1]]
        row = last


def cut_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, tokenizer_path: str, end_id: int, with_ids: bool) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, row (a number of the input row), ids if asked for."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = WordIds(tokenizer_path), TaskContext.get().partitionId() << 33
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids

        def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            names = batch.column(0).to_pylist()
            for k, ids in enumerate(token_rows(batch.column(1), held)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for p, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    out.append((names[k], p, at, len(part), zlib.crc32(part), seen + k) + ((part.astype(np.int32),) if with_ids else ()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [batch.schema.field(0).type, *kinds])], names=heads)

        def found() -> Iterator[pa.RecordBatch]:
            nonlocal seen
            for batch in slices(batches, 1, _SLICE_BYTES, 5000):
                yield cut(batch)
                seen += batch.num_rows
                give_back()

        yield from settled(found(), held)

    kind = docs.schema[id_col].dataType.simpleString()
    heads = ["doc_id", "piece", "start", "length", "ids_crc32", "row"] + ["ids"] * with_ids
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, row bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(pieces, schema)


def _places(plan: list[tuple[int, int, int, int, int, int]], columns: list[str]):
    """Looks up (sequence_id, offset) of pieces from length and rank."""
    length, rank, _, sequence, each, offset = np.array(plan, np.int64).reshape(-1, 6).T
    of_length = np.searchsorted(length, np.arange(length.max(initial=0) + 2))  # the runs of a length lie together

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, r = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = np.empty(len(n), np.int64)
            for size in np.unique(n).tolist():
                at = np.flatnonzero(n == size)
                low, high = of_length[size], of_length[size + 1]
                run[at] = low + np.searchsorted(rank[low:high], r[at], "right") - 1
            i = r - rank[run]
            found = [pa.array(sequence[run] + i // each[run]), pa.array(offset[run] + i % each[run] * n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *found], names=[*columns, "sequence_id", "offset"])

    return rows


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, rows_per_task: int = 2_000, with_ids: bool = False) -> DataFrame:
    """Pack whole documents into as few sequences of at most `capacity` tokens as best-fit decreasing finds.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for). Ids are
    those of `Tokenizer.from_file(tokenizer_path).encode(text, add_special_tokens=False)`. A null or empty text is one
    piece that holds only the end id. Null and repeated ids are kept: every input row is packed once. Pieces of one length
    are interchangeable; which of them goes where depends on a hash. An empty table gives no rows. Other columns of `docs`
    are not looked at. Ranks are counted in parts of a length of about `rows_per_task` rows, so no length is one task.
    """
    small_batches(docs.sparkSession, _SLICE_BYTES)
    pieces = materialize(cut_pieces(docs, id_col, text_col, capacity, tokenizer_path, end_id, with_ids), "pieces")
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity`
    plan = sorted(best_fit_decreasing(lengths, capacity))
    parts = docs.sparkSession.createDataFrame([(k, math.ceil(n / rows_per_task)) for k, n in lengths.items()], "length bigint, parts bigint")

    dealt = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("row", "piece"), "parts").cast("int"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("length", "part").orderBy(F.xxhash64("row", "piece"), "row", "piece")) - 1
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    ranked = dealt.withColumn("place", place).join(first, ["length", "part"]).select(*names, (F.col("first") + F.col("place")).cast("bigint").alias("rank"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(names).schema) + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(_places(plan, names), schema)
