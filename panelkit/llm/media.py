"""Media columns: content-addressed payloads in tar shards, with metadata filled by reading headers only.

A payload is stored once under its digest, as a grey 8-bit PNG that is 64 samples wide, so storing is lossless and
shards stay ordinary tar files. A row carries digest, shard, offset and length. `with_headers` fetches just the first
bytes of each member by a range read; `with_features` reads whole members back.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, settled, slices, small_batches

#: Fixed values of the PNG format: signature, and the length of signature plus header chunk.
PNG_START = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
WIDTH = 64
SHARD_BYTES = 256 << 20


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """A payload whose length is a positive multiple of 64, as PNG: each line has filter type 0."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(lines), WIDTH + 1), np.uint8)
    raw[:, 1:] = lines
    head = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)
    return PNG_START + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, 6)) + _chunk(b"IEND", b"")


def read_header(start: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first 33 bytes."""
    if start[:8] != PNG_START or start[12:16] != b"IHDR":
        raise ValueError("not a stored payload")
    return struct.unpack(">IIB", start[16:25])


def decode_png(stored: bytes) -> bytes:
    width, height, _ = read_header(stored)
    at, data = 8, b""
    while at < len(stored):
        size, kind = struct.unpack(">I4s", stored[at : at + 8])
        if kind == b"IDAT":
            data += stored[at + 8 : at + 8 + size]
        at += size + 12
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def payload_column(text: Column) -> Column:
    """UTF-8 bytes, then bytes 0 up to a positive multiple of 64; null as empty."""
    raw = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    size = F.octet_length(raw)
    short = F.when(size == 0, WIDTH).otherwise(F.pmod(-size, F.lit(WIDTH))).cast("int")
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), short)))


def _shard_writer(root: str, suffix: str) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are (digest, payload). What a task remembers is a digest for each of its rows at most. A shard's name has
        the attempt in it, so attempts of one task never write the same file; only a committed one is in the index."""
        task = TaskContext.get()
        files, base = fs.FileSystem.from_uri(root)
        part, out, at, seen, rows = 0, None, 0, set(), []

        def close() -> pa.RecordBatch:
            out.write(b"\0" * 1024)
            out.close()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["digest", "shard", "offset", "length"])

        for batch in slices(batches, 1):
            for digest, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if digest in seen:
                    continue
                seen.add(digest)
                stored = encode_png(value.as_buffer())
                if out is not None and at > SHARD_BYTES:
                    yield close()
                    part, out, rows = part + 1, None, []
                if out is None:
                    files.create_dir(base, recursive=True)
                    name, at = f"shard-{task.partitionId():06d}-{part:04d}-{task.taskAttemptId()}.tar", 0
                    out = files.open_output_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20)
                member = tarfile.TarInfo(f"{digest}.{suffix}")
                member.size = len(stored)
                head = member.tobuf(tarfile.GNU_FORMAT)
                out.write(head)
                out.write(stored)
                out.write(b"\0" * (-len(stored) % 512))
                rows.append((digest, name, at + len(head), len(stored)))
                at += len(head) + len(stored) + -len(stored) % 512
        if out is not None:
            yield close()

    return lambda batches: settled(write(batches))


def store_payloads(payloads: DataFrame, root: str, suffix: str = "png") -> DataFrame:
    """Write payloads (columns digest, payload) into tar shards under `root`, a shared folder, where they are.

    Returns the index: digest, shard, offset, length; a digest that several tasks were given has the place that comes
    first. Payloads do not travel; leave out those that another row stands for. An empty table writes nothing.
    """
    written = materialize(payloads.select("digest", "payload").mapInArrow(_shard_writer(root, suffix), "digest string, shard string, offset bigint, length bigint"), "media-written")
    remove_orphans(written, root)
    place = F.struct("shard", "offset", "length")
    return written.groupBy("digest").agg(F.min(place).alias("at")).select("digest", "at.*")


def remove_orphans(written: DataFrame, root: str) -> None:
    """Remove the shards under `root` that attempts have left which did not commit. Names come one for each shard."""
    spark, kept = written.sparkSession, {r["shard"] for r in written.select("shard").distinct().collect()}
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(where) if files.exists(where) else []:
        if status.getPath().getName() not in kept:
            files.delete(status.getPath(), False)


def copies_of_others(rows: DataFrame) -> DataFrame:
    """(doc_id, digest) of the rows whose payload a row with a smaller id has, too."""
    least = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    least = materialize(least.select("digest", "least"), "media-copied")  # so that the join can split a digest that many rows have
    return rows.join(least, "digest").where("doc_id <> least").select("doc_id", "digest")


def _reader(root: str, read: Callable, names: list[str]) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        opened, held = None, None
        for batch in batches:
            out = []
            for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length"))):
                if shard != opened:
                    opened, held = shard, files.open_input_file(f"{base}/{shard}")
                out.append(read(held, offset, length))
            if out:
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in zip(*out))], names=[*batch.schema.names, *names])

    return lambda batches: settled(rows(batches))


def with_headers(index: DataFrame, root: str) -> DataFrame:
    """Adds width, height and bits, for which only each member's first 33 bytes are read."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema)
    return index.mapInArrow(_reader(root, lambda f, at, _: read_header(f.read_at(HEADER_BYTES, at)), ["width", "height", "bits"]), f"{kinds}, width bigint, height bigint, bits bigint")


def _features(file, at: int, length: int) -> tuple:
    stored = file.read_at(length, at)
    payload = decode_png(stored)
    samples = np.frombuffer(payload, np.uint8)
    bins = np.bincount(samples >> 5, minlength=8)
    text = f"{WIDTH}x{len(samples) // WIDTH};sum={int(samples.sum(dtype=np.int64))};hist={','.join(map(str, bins.tolist()))}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), text


def with_features(index: DataFrame, root: str) -> DataFrame:
    """Adds payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature, from the stored bytes."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema)
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return index.mapInArrow(_reader(root, _features, names), f"{kinds}, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def media_columns(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """Store every whole text as a payload under `root`, a new folder that all executors reach, and describe it from what
    has been stored there. The shards are the product: they stay.

    Returns doc_id, n_bytes (of the text, without padding), what `with_features` reads back, width and height from
    the header, and digest, root, shard, offset, length. A null text is an empty one: 64 bytes 0. Repeated rows and null
    ids stay; equal texts get equal values and one stored copy. An empty table gives no rows and no shard. Other columns are
    not looked at.
    """
    small_batches(docs.sparkSession)
    payload = payload_column(F.col(text_col))
    whole = docs.select(F.col(id_col).alias("doc_id"), F.sha2(payload, 256).alias("digest"), payload.alias("payload"))
    n_bytes = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("bigint").alias("n_bytes")
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), n_bytes, F.sha2(payload, 256).alias("digest")), "media-rows")
    copies = copies_of_others(rows)
    if copies.count() <= broadcast_rows:
        copies = F.broadcast(copies)
    index = materialize(store_payloads(whole.join(copies, ["doc_id", "digest"], "left_anti"), root).repartition("shard").sortWithinPartitions("shard", "offset"), "media-index")
    described = with_features(with_headers(index, root), root)
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return rows.join(described, "digest").select("doc_id", "n_bytes", *names, "width", "height", "digest", F.lit(root).alias("root"), "shard", "offset", "length")
