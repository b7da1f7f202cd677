"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

Rows lie in blocks. How many rows of each block go to each shard is drawn first, from the multivariate
hypergeometric law that a uniform shuffle obeys, so shard sizes are exact. Then every block permutes its own rows
and cuts the permutation at those counts, and every shard permutes what has arrived. Only ids, sizes and checksums travel:
once to their block, once to their shard.
The matrix is drawn by halving the list of blocks again and again: at each node one conditional draw a shard
decides what goes to the left half.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialize


def uniform(*parts) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def hypergeometric(u: Column, good: Column, bad: Column, draws: Column) -> Column:
    """The u-quantile of the number of good ones among `draws` of good + bad, by summing its law from the left.

    The sum runs over mean +- (9 deviations + 20), outside of which less than a double's resolution remains;
    weights are relative to the first term, each from the one before it.
    """
    total = good + bad
    mean = draws * good / F.greatest(total, F.lit(1))
    spread = F.sqrt(mean * (bad / F.greatest(total, F.lit(1))) * ((total - draws) / F.greatest(total - 1, F.lit(1))))
    low = F.greatest(F.lit(0).cast("bigint"), draws - bad, F.floor(mean - 9 * spread - 20))
    high = F.least(good, draws, F.ceil(mean + 9 * spread + 20))

    def after(w: Column, k: Column) -> Column:
        return w * ((good - k).cast("double") * (draws - k)) / ((k + 1).cast("double") * (bad - draws + k + 1))

    span = F.sequence(low, F.greatest(low, high))
    one, none = F.lit(1.0).cast("double"), F.lit(0.0).cast("double")
    mass = F.aggregate(span, F.struct(one.alias("w"), none.alias("sum")), lambda s, k: F.struct(after(s["w"], k).alias("w"), (s["sum"] + s["w"]).alias("sum")), lambda s: s["sum"])
    start = F.struct(one.alias("w"), (u * mass).alias("left"), low.alias("k"))
    step = lambda s, k: F.when(s["left"] < 0, s).otherwise(F.struct(after(s["w"], k).alias("w"), (s["left"] - s["w"]).alias("left"), k.alias("k")))
    return F.aggregate(span, start, step, lambda s: s["k"])


def split_counts(sizes: Column, draws: Column, seed: Column) -> Column:
    """How many of `draws` rows, taken without replacement, belong to each of the groups of these sizes."""
    first = F.struct(F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("rest"), draws.alias("need"), F.array().cast("array<bigint>").alias("out"))

    def one(s: Column, m: Column) -> Column:
        drawn = F.array(hypergeometric(uniform(seed, F.size(s["out"])), m, s["rest"] - m, s["need"]))
        return F.element_at(F.transform(drawn, lambda x: F.struct((s["rest"] - m).alias("rest"), (s["need"] - x).alias("need"), F.concat(s["out"], F.array(x)).alias("out"))), 1)

    return F.aggregate(sizes, first, one, lambda s: s["out"])


def communication_matrix(counts: DataFrame, shards: int, blocks: int, seed: int) -> DataFrame:
    """(block, upto): for each row of `counts` (block, rows), how many of its rows go to shards 0..k, k = 0, 1, ..."""
    ordered = counts.agg(F.array_sort(F.collect_list(F.struct("block", "rows"))).alias("part"))
    total = F.aggregate("part", F.lit(0).cast("bigint"), lambda a, x: a + x["rows"])
    even = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.floor(F.col("total") / shards) + F.when(s < F.col("total") % shards, 1).otherwise(0))
    nodes = ordered.withColumn("total", total).select("part", even.alias("sizes"), F.lit(1).cast("bigint").alias("node"))
    half = F.floor(F.size("part") / 2).cast("int")
    for level in range(math.ceil(math.log2(max(2, blocks)))):
        left = F.aggregate(F.slice("part", 1, half), F.lit(0).cast("bigint"), lambda a, x: a + x["rows"])
        nodes = nodes.withColumn("drawn", F.when(F.size("part") > 1, split_counts(F.col("sizes"), left, F.concat_ws(":", F.lit(seed), "node"))).otherwise(F.col("sizes")))
        pair = F.array(
            F.struct(F.slice("part", 1, F.greatest(half, F.lit(1))).alias("part"), F.col("drawn").alias("sizes"), (F.col("node") * 2).alias("node")),
            F.struct(F.slice("part", half + 1, F.size("part")).alias("part"), F.zip_with("sizes", "drawn", lambda a, b: a - b).alias("sizes"), (F.col("node") * 2 + 1).alias("node")),
        )
        nodes = nodes.select(F.explode(F.when(F.size("part") > 1, pair).otherwise(F.slice(pair, 1, 1))).alias("x")).select("x.*")
        if level == 7:
            nodes = nodes.repartition("node")
    sums = F.aggregate("sizes", F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(x + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)))))
    return nodes.where(F.size("part") > 0).select(F.col("part")[0]["block"].alias("block"), sums.alias("upto"))


def shuffle_to_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, seed: int = 7, rows_per_task: int = 20_000) -> DataFrame:
    """Give every row a shard and a slot: a uniform shuffle with row counts that differ by one at most.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law ("rows"), shard, slot (gapless from 0 in
    each shard) and grown_shard (null: under this law an added shard moves rows everywhere). A null text has size 1
    and the checksum of no bytes. Null and repeated ids keep their rows; other columns are not looked at. An empty
    table gives no rows. The same rows get the same places in every run; rows equal in id and text are interchangeable, and
    in one block.
    """
    total = docs.count()
    blocks = max(16, math.ceil(total / rows_per_task))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    block = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_crc32"), F.lit(blocks)).cast("int").alias("block")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = materialize(rows.select("*", block), "sizes")
    matrix = communication_matrix(rows.groupBy("block").agg(F.count("*").alias("rows")), shards, blocks, seed)

    local = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "text_crc32"), "doc_id", "text_crc32")
    ranked = rows.withColumn("place", F.row_number().over(local))
    sent = ranked.join(matrix, "block").withColumn("shard", F.size(F.filter("upto", lambda c: c < F.col("place"))))
    buckets = max(1, math.ceil(total / shards / rows_per_task))
    bucket = F.pmod(F.xxhash64(F.lit(seed + 2), "doc_id", "text_crc32"), F.lit(buckets)).cast("int")
    arrived = materialize(sent.select("doc_id", "size", "text_crc32", "shard", bucket.alias("bucket")), "shards")

    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = arrived.groupBy("shard", "bucket").agg(F.count("*").alias("rows")).select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    again = Window.partitionBy("shard", "bucket").orderBy(F.xxhash64(F.lit(seed + 3), "doc_id", "text_crc32"), "doc_id", "text_crc32")
    return (
        arrived.withColumn("place", F.row_number().over(again))
        .join(starts, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("first") + F.col("place") - 1).cast("bigint").alias("slot"), F.lit(None).cast(T.IntegerType()).alias("grown_shard"))
    )
