"""Landing files into the lake: unchanged ones are skipped, bad ones are reported, one failure stops no other.

A landing is a fixed number of Spark jobs, however many files there are. Tasks stream the files that fall to them: a first pass
takes digests; a second copies what has changed to a temporary name beside its place in the lake, checks the footer of the
copy, and renames it last, so a reader sees a whole file or none. Files are read in pieces, so their size is no matter.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("ingested", "skipped_unchanged", "not_available", "failed")
PIECE = 8 << 20
MANIFEST = "file_id string, path string, digest string, rows bigint, status string, landed string"


def _store(path: str):
    """(filesystem, path in it) of a local path or a URI, in any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _stream(path: str) -> Iterator[bytes]:
    store, at = _store(path)
    with store.open_input_stream(at) as source:
        while piece := source.read(PIECE):
            yield piece


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The SHA-256 of each file; null for one that cannot be read."""
    for batch in batches:
        found = []
        for path in batch["path"]:
            try:
                whole = hashlib.sha256()
                for piece in _stream(path):
                    whole.update(piece)
                found.append(whole.hexdigest())
            except Exception:  # a file that cannot be read is a result here, not an error of the run
                found.append(None)
        yield pd.DataFrame({"file_id": batch["file_id"], "path": batch["path"], "digest": found})


def digests(candidates: DataFrame) -> DataFrame:
    """(file_id, path, digest) of the candidates that have a path."""
    some = candidates.where(F.col("path").isNotNull()).select("file_id", "path")
    return _spread(some).mapInPandas(_digests, "file_id string, path string, digest string")


def _spread(files: DataFrame) -> DataFrame:
    """A listing is small and a file is not: every task gets a few files."""
    return files.repartition(files.sparkSession.sparkContext.defaultParallelism * 4, "file_id")


def _land_one(path: str, place: str | None, digest: str) -> tuple[int | None, str, str | None]:
    """(rows, status, where it lies). The copy is checked by its own bytes and its own footer before it gets its name."""
    import pyarrow.parquet as pq

    temporary = None
    try:
        if place is None:
            store, at = _store(path)
        else:
            store, final = _store(place)
            temporary = at = f"{final}.{uuid.uuid4().hex}.landing"
            store.create_dir(final.rpartition("/")[0], recursive=True)
            whole = hashlib.sha256()
            with store.open_output_stream(at) as out:
                for piece in _stream(path):
                    whole.update(piece)
                    out.write(piece)
            if whole.hexdigest() != digest:
                raise OSError("the file changed while it was read")
        with store.open_input_file(at) as held:
            rows = pq.ParquetFile(held).metadata.num_rows
        if rows and temporary:
            store.move(temporary, final)
            temporary = None
        return rows, "ingested" if rows else "failed", place if rows else None
    except Exception:  # no Parquet, unreadable or changed: this file has failed, the others go on
        return None, "failed", None
    finally:
        if temporary is not None:
            try:
                store.delete_file(temporary)
            except Exception:  # it was never written
                pass


def _copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        done = [_land_one(*x) for x in zip(batch["path"], [p or None for p in batch["place"]], batch["digest"])]
        yield pd.DataFrame({"file_id": batch["file_id"], "path": batch["path"], "digest": batch["digest"], "rows": pd.array([d[0] for d in done], "Int64"), "status": [d[1] for d in done], "landed": [d[2] for d in done]})


def land(candidates: DataFrame, state: DataFrame, force: bool = False, lake: str | None = None, ingest_date: str | None = None) -> tuple[DataFrame, DataFrame]:
    """candidates: (file_id, path) and, with a lake, dataset and perhaps season; state: (file_id, digest). Returns the manifest
    (file_id, path, digest, rows, status, landed) and the new state, which has only what was read in full.

    What has changed is copied to `lake`/dataset/[season=S/]ingest_date=D/file_id.parquet; without a lake it is only checked.
    Files that cannot be read, are no Parquet or hold no row have failed and leave nothing behind. The manifest is written
    once, so reading it again lands nothing again.
    """
    from .scratch import stored

    missing = F.col("path").isNull()
    told = stored(digests(candidates), "digests")
    known = state.select("file_id", F.col("digest").alias("__old"))
    same = F.coalesce(F.col("digest") == F.col("__old"), F.lit(False)) & F.lit(not force)
    seen = told.join(known, "file_id", "left").withColumn("same", same).drop("__old")
    fresh = seen.where("digest is not null and not same").select("file_id", "path", "digest")
    place = F.lit(None).cast("string")
    if lake is not None:
        season = F.when(F.col("season").isNotNull(), F.concat(F.lit("season="), F.col("season").cast("string"), F.lit("/"))).otherwise("") if "season" in candidates.columns else F.lit("")
        place = F.concat(F.lit(f"{lake.rstrip('/')}/"), "dataset", F.lit("/"), season, F.lit(f"ingest_date={ingest_date}/"), "file_id", F.lit(".parquet"))
    where = candidates.where(~missing).select("file_id", place.alias("place"))
    landed = _spread(fresh.join(where, "file_id")).mapInPandas(_copies, MANIFEST)
    nothing = [F.lit(None).cast("bigint").alias("rows")]
    skipped = seen.where("same").select("file_id", "path", "digest", *nothing, F.lit("skipped_unchanged").alias("status"), F.lit(None).cast("string").alias("landed"))
    unread = seen.where("digest is null").select("file_id", "path", "digest", *nothing, F.lit("not_available").alias("status"), F.lit(None).cast("string").alias("landed"))
    absent = candidates.where(missing).select("file_id", "path", F.lit(None).cast("string").alias("digest"), *nothing, F.lit("not_available").alias("status"), F.lit(None).cast("string").alias("landed"))
    manifest = stored(landed.unionByName(skipped).unionByName(unread).unionByName(absent), "manifest")
    done = manifest.where("status = 'ingested'").select("file_id", "digest")
    return manifest, state.join(done, "file_id", "left_anti").unionByName(done)


def manifest_counts(manifest: DataFrame) -> DataFrame:
    """A count for every status, those without a file included."""
    counts = manifest.groupBy("status").agg(F.count("*").alias("n"))
    every = manifest.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return every.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def data_as_of(state: DataFrame, dataset: str = "dataset", updated: str = "source_last_updated", ingested: str = "ingested_at") -> DataFrame:
    """The source time of what was ingested last, per dataset."""
    return state.groupBy(dataset).agg(F.max_by(updated, ingested).alias("as_of"))
