"""What classifiers share: a bounded, repeatable sample of labelled rows with their texts, and the scoring of all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, settled, slices, small_batches

#: The most labelled rows that a classifier is fitted on.
SAMPLE_ROWS = 12_000


def crc_of(id_col: str | Column) -> Column:
    return F.crc32((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string").cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column | None = None, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label): the first `rows` labelled rows of `docs` by a hash of their id, labels 0 and 1 only.

    An id labelled twice counts twice, and so does each row of an id that repeats; of those that do not fit, the last in the
    order of reading go. Which rows are meant is settled on ids and row numbers, before any text is looked at.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
    if allowed is not None:
        known = known.where(allowed)
    order = [F.xxhash64("doc_id"), "doc_id", "label"]
    chosen = known.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label")).orderBy(*order).limit(rows)
    row = F.monotonically_increasing_id().alias("row")
    meant = docs.select(F.col(id_col).alias("doc_id"), row).join(F.broadcast(chosen), "doc_id").orderBy(*order, "row").limit(rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), row)
    return texts.join(F.broadcast(meant), ["doc_id", "row"]).select("doc_id", "text", "label")


def with_score(docs: DataFrame, text_col: str, score_col: str, score: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """`docs` with a last column `score_col` (double) that `score` makes of the texts; a column of that name is replaced.

    A null text is an empty one. Tasks look at a bounded number of bytes of text at a time.
    """
    names = [c for c in docs.columns if c.lower() != score_col.lower()]
    given = docs.select(*map(quoted, names), F.coalesce(quoted(text_col).cast("string"), F.lit(""))).toDF(*map(str, range(len(names) + 1)))
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(score_col, T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(names)):
            found = score(batch.column(len(names)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found, pa.float64())], names=[*names, score_col])

    small_batches(docs.sparkSession)
    return given.mapInArrow(lambda batches: settled(scored(batches)), schema)
