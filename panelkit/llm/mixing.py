"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slot i of the schedule is the point frac((i + 1) / golden ratio), mapped through the cumulative targets to a
source; slots are ranked within their source. Each source's documents are shuffled into a stream (again for the
second pass), the stream is cut into blocks of equally many words, and the slot of rank k takes block k. What no slot
takes is not in the mix: there are as many slots as blocks in all targets together, so a source's words depart from its
target by the schedule's discrepancy, d slots with |d| <= 2 * (3 + ln(slots) / ln(golden ratio)) for every share (3 or fewer
as measured), and by the rounding to a block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, free_name, materialize, quoted, small_or_plain

GOLDEN = 0.6180339887498949
CELLS = 4096
#: Consecutive Fibonacci numbers: their ratio is the golden ratio for as many slots as the greater one says.
FIBONACCI = (498_454_011_879_264, 806_515_533_049_393)


def golden_point(slot: Column) -> Column:
    """frac((slot + 1) / golden ratio) of any slot below FIBONACCI[1], evenly fine everywhere: whole numbers are multiplied,
    13 bits at a time, so that no product overflows; a double's digits would run out at 1e9 slots."""
    step, modulus = FIBONACCI
    parts = [F.shiftright(slot + 1, 13 * k).bitwiseAND(F.lit(0x1FFF)) * F.lit((step << 13 * k) % modulus) % F.lit(modulus) for k in range(4)]
    return (parts[0] + parts[1] + parts[2] + parts[3]) % F.lit(modulus) / F.lit(float(modulus))


@dataclass
class Mix:
    """sized: row, doc_id, source, size. sources: source, number, source_size, target, need. segments: what the slots take."""

    sized: DataFrame
    sources: DataFrame
    segments: DataFrame


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """sizes: (source, source_size). Weighted targets that add up to `share` of all sizes, none above `most` times its
    source; what a full source cannot take is shared again by weight. One row a source; the windows see only those rows,
    all in one task: that is for up to some millions of sources."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.withColumn("number", F.row_number().over(by_name) - 1)
    weighted = weighted.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("number", F.lit(len(weights))) + 1))
    full = weighted.withColumn("limit", most * F.col("source_size")).withColumn("total", share * F.sum("source_size").over(everything))
    full = full.withColumn("fills_at", F.col("limit") / F.col("weight"))
    order = Window.orderBy("fills_at", "number")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levelled = full.withColumn("level", level)
    chosen = F.min_by(F.when(F.col("level") <= F.col("fills_at"), F.col("level")), F.when(F.col("level") <= F.col("fills_at"), F.col("fills_at"))).over(everything)
    target = F.least(F.col("limit"), F.coalesce(chosen, F.col("fills_at")) * F.col("weight"))
    return levelled.withColumn("target", target.cast("double")).select("source", "number", "source_size", "target", F.round("target").cast("bigint").alias("need"))


def schedule(sources: DataFrame, block: int, slots: int) -> DataFrame:
    """(number, rank, slot) of the low-discrepancy schedule; ranks are counted in runs of slots, so no source is one task."""
    upto = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    shares = sources.withColumn("high", F.sum("target").over(upto) / F.greatest(F.sum("target").over(Window.partitionBy()), F.lit(1e-300)))
    shares = shares.select("number", (F.coalesce(F.lag("high").over(Window.orderBy("number")), F.lit(0.0))).alias("low"), "high").where("low < high")
    spans = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.lit(CELLS - 1), F.floor(F.col("high") * CELLS)))))
    points = sources.sparkSession.range(slots).withColumn("point", golden_point(F.col("id")))
    points = points.withColumn("cell", F.floor(F.col("point") * CELLS))
    hits = points.join(spans, "cell").where("low <= point and point < high").select("number", F.col("id").alias("slot"), F.floor(F.col("id") / 8192).alias("run"))
    prior = Window.partitionBy("number").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = hits.groupBy("number", "run").agg(F.count("*").alias("n")).select("number", "run", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("first"))
    placed = hits.withColumn("place", F.row_number().over(Window.partitionBy("number", "run").orderBy("slot")))
    return placed.join(runs, ["number", "run"]).select("number", (F.col("first") + F.col("place") - 1).alias("rank"), "slot")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 64, seed: int = 11, rows_per_task: int = 20_000) -> Mix:
    """Mix documents so that each source's words come near its target, to a few blocks.

    Sources are ordered by code point, null last, and weigh `weights` in turn. `segments` has slot, number, rank, row,
    doc_id, pass, offset and length, in words of the document. A null or empty text has no words and is never taken. No
    document is taken more than `most` (2 at most) times. Rows that repeat are separate documents; null ids are kept.
    The same table gives the same mix in every run (rows with a null id: if it is read in the same splits). Empty tables
    give empty frames.
    """
    if most > 2:
        raise ValueError("a source is passed over twice at most")
    text = F.col(text_col).cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.crc32(text.cast("binary")).alias("sum"))
    sized = materialize(rows, "sized")
    sources = materialize(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    known = sources.agg(F.count("*").alias("n"), F.coalesce(F.sum("target"), F.lit(0.0)).alias("target")).first()
    tasks, slots = max(1, math.ceil(sized.count() / rows_per_task)), math.ceil(known["target"] / block)
    spare = block * math.ceil(2 * (3 + math.log(max(1, slots)) / -math.log(GOLDEN)))

    upto = F.least(F.floor(most * F.col("source_size")), F.col("need") + spare)
    few = small_or_plain(sources.select(F.col("source").alias("name"), "number", "source_size", upto.alias("upto")), known["n"])
    passes = sized.where("size > 0").join(few, F.col("source").eqNullSafe(F.col("name"))).withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1))))
    key = F.xxhash64(F.lit(seed), "pass", "doc_id", "size", "sum", F.when(F.col("doc_id").isNull(), F.col("row")))
    passes = passes.where("pass * source_size < upto").withColumn("key", key).withColumn("part", F.pmod("key", F.lit(tasks)))
    keys = ["number", "pass", "part"]
    prior = Window.partitionBy("number", "pass").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = passes.groupBy(*keys).agg(F.sum("size").alias("words")).select(*keys, F.coalesce(F.sum("words").over(prior), F.lit(0)).alias("first"))
    inner = Window.partitionBy(*keys).orderBy("key", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = passes.withColumn("words", F.sum("size").over(inner)).join(parts, keys)
    start = F.col("pass") * F.col("source_size") + F.col("first") + F.col("words") - F.col("size")
    placed = placed.withColumn("start", start).withColumn("end", F.least(F.col("start") + F.col("size"), F.col("upto"))).where("start < end")
    cut = placed.withColumn("rank", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    begin, close = F.greatest("start", F.col("rank") * block), F.least("end", (F.col("rank") + 1) * block)
    pieces = cut.select("number", "rank", "row", "doc_id", "pass", (begin - F.col("start")).alias("offset"), (close - begin).alias("length"))
    return Mix(sized.drop("sum"), sources, pieces.join(schedule(sources, block, slots), ["number", "rank"]))


def mixed_documents(mix: Mix) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words that slots take of it, repeats counted), source, and
    first_slot, the place in the mix at which it first appears (null if it does not)."""
    taken = mix.segments.groupBy("row").agg(F.sum("length").alias("taken"), F.min("slot").alias("first_slot"))
    few = small_or_plain(mix.sources.withColumnRenamed("source", "name"), mix.sources.count())
    joined = mix.sized.join(taken, "row", "left").join(few, F.col("source").eqNullSafe(F.col("name")))
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "source", "first_slot")


def take_whole(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` once for each pass in which a slot takes words of them, columns as they were.

    A document at the end of its source's share is taken whole, so a source can exceed its share by one document a pass.
    Every row is a document of its own, also where ids repeat or are null. Rows are told apart by their number in the order of
    reading: `docs` has to be a table that is read, as every stage's is, so that it has the same numbers when it is read again.
    """
    mix = mix_sources(docs, **options)
    of, times, one = (free_name(docs, name) for name in ("taken_row", "taken_times", "taken_pass"))
    passes = mix.segments.groupBy("row").agg(F.count_distinct("pass").cast("int").alias(times)).withColumnRenamed("row", of)
    repeated = docs.withColumn(of, F.monotonically_increasing_id()).join(passes, of)
    return repeated.withColumn(one, F.explode(F.array_repeat(F.lit(1), F.col(times)))).select(*map(quoted, docs.columns))
