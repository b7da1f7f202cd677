"""Cheapest repair of the turns of conversations, by a dynamic program with square-root checkpoints.

A repaired conversation's role initials are `(s?(ua)+)?`. Turns are kept, given another role, deleted, or new empty ones are
put in. Costs to the end, one for each of four states, are computed backward and kept at checkpoints only, a square root of
the turns apart; walking forward, the vectors of one block at a time are computed again, and among the edits that are tight
the least in ASCII is taken.

Turns lie in range partitions by (conversation, turn, role, text), so a conversation of any length is spread over tasks. A
partition's first and last conversation may go on in others: for these, a matrix of costs from state to state stands for the
part, parts of one conversation (at most one a partition) are joined backward to the cost vector at the end of each, then
forward to the state in which each begins. Hashing the repaired text is sequential by nature: it streams in order,
without being held.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_batches

#: States after nothing, s, u and a; where each goes by a turn of the user or the assistant, the one of both that fits.
TURN_TO, TURN_ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
KEEP_TO = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: Costs from each state when no turn is left: nothing, or the turns that are missing.
AT_END = (0, 4, 2, 0)
NEVER = 1 << 60
BLANK, DUPLICATE, TRUNCATED, FINE, GONE = "blank", "duplicate", "truncated", "", "gone"
WHITE = " \t\n\x0b\x0c\r"

Row = tuple[str, str, int]  # initial of the role, fault, copies


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n) by each turn's checksum modulo 20; n is 0 for a turn that is dropped and
    2 for one that is repeated, otherwise 1. A null is one space, but for ids and turns it is so in the checksum alone."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(hit.isin(0, 1), "").when(hit == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    n = F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1)
    return turns.select("conv_id", "turn", F.when(hit == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), n.cast("bigint").alias("n"))


def in_order(told: DataFrame) -> DataFrame:
    """(key, conv_id, turn, role, text, n, place, part), written in order; equal rows are one with their number. Places
    rise with (key, turn with nulls first, role, text); key names the conversation, also without an id."""
    key = F.concat(F.when(F.col("conv_id").isNull(), "-").otherwise("="), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    once = told.withColumn("key", key).groupBy("key", "conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    starts = [F.substring(c, 1, 64) for c in ("role", "text")]  # the whole order, but for texts that begin alike
    spread = once.repartitionByRange("key", "turn", *starts).sortWithinPartitions("key", "turn", "role", "text")
    placed = spread.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33))
    return materialize(placed, "turns")


def faults(turns: DataFrame) -> DataFrame:
    """(key, part, place, n, initial, fault) of each row, without texts. Of equal rows only the first is no duplicate."""
    bare = F.rtrim("text", F.lit(WHITE))
    said = turns.select("key", "part", "place", "n", F.substring("role", 1, 1).alias("initial"), F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"), (bare == "").alias("blank"), F.right(bare, F.lit(1)).alias("last"))
    first = said.where("n > 0").groupBy("key", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    fault = F.when(F.col("n") == 0, GONE).when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(~F.col("last").isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    return materialize(said.join(first, "place", "left").select("key", "part", "place", "n", "initial", fault.alias("fault")), "faults")


def _before(row: Row, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end before a row, given those after it. A row's copies are duplicates and go."""
    initial, fault, n = row
    if fault == GONE:
        return after
    copies = 3 * (n - 1)
    cost = [3 + copies + x for x in after]
    if fault not in (BLANK, DUPLICATE):
        late = copies + (fault == TRUNCATED)
        keep = KEEP_TO.get(initial, (None,) * 4)
        for s in range(4):
            cost[s] = min(cost[s], late + 2 + after[TURN_TO[s]], NEVER if keep[s] is None else late + after[keep[s]])
    u, a = min(cost[2], 2 + cost[3]), min(cost[3], 2 + cost[2])
    return min(cost[0], 2 + u), min(cost[1], 2 + u), u, a


def _edits(row: Row, state: int, own: tuple[int, ...], after: tuple[int, ...]) -> tuple[str, int]:
    """The least tight edits up to and with this row, and the state after it."""
    initial, fault, n = row
    if fault == GONE:
        return "", state
    out, copies = "", 3 * (n - 1)
    late, keep = copies + (fault == TRUNCATED), KEEP_TO.get(initial, (None,) * 4)
    while True:
        if own[state] == 3 + copies + after[state]:
            return out + "D" * n, state
        if own[state] == 2 + own[TURN_TO[state]]:
            out, state = out + "I", TURN_TO[state]
        elif fault not in (BLANK, DUPLICATE) and keep[state] is not None and own[state] == late + after[keep[state]]:
            return out + "K" + "D" * (n - 1), keep[state]
        else:
            return out + "R" + "D" * (n - 1), TURN_TO[state]


def walk(rows: list[Row], end: tuple[int, ...], state: int) -> Iterator[tuple[str, int]]:
    """(edits, state after) for each row. Vectors are held at checkpoints and for one block between two of them."""
    n = len(rows)
    step = math.isqrt(n) + 1
    marks, now = {n: end}, end
    for i in range(n - 1, -1, -1):
        now = _before(rows[i], now)
        if i % step == 0:
            marks[i] = now
    for at in range(0, n, step):
        upto = min(at + step, n)
        block = [marks[upto]]
        for i in range(upto - 1, at - 1, -1):
            block.append(_before(rows[i], block[-1]))
        block.reverse()
        for i in range(at, upto):
            edits, state = _edits(rows[i], state, block[i - at], block[i - at + 1])
            yield edits, state


def tail(state: int) -> str:
    """The turns put in after the last row."""
    return "I" * (AT_END[state] // 2)


def _parts(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[tuple[int, str], list[tuple]]]:
    """((part, key), rows) of each conversation's rows in each partition, which arrive in order."""
    name, held = None, []
    for batch in batches:
        for part, key, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "key", *columns))):
            if (part, key) != name:
                if held:
                    yield name, held
                name, held = (part, key), []
            held.append(tuple(row))
    if held:
        yield name, held


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs from state to state over the first and the last conversation of each partition, which may go on in others."""

    def told(found: list) -> Iterator[pa.RecordBatch]:
        for (part, key), rows in found:
            ways = []
            for to in range(4):
                now = tuple(0 if s == to else NEVER for s in range(4))
                for row in reversed(rows):
                    now = tuple(min(x, NEVER) for x in _before(row, now))
                ways.append(list(now))
            yield pa.RecordBatch.from_pydict({"part": [part], "key": [key], "ways": [ways]}, schema=pa.schema([("part", pa.int64()), ("key", pa.string()), ("ways", pa.list_(pa.list_(pa.int64())))]))

    first = last = None
    for name, rows in _parts(batches, ("initial", "fault", "n")):
        if last is not None and last[0][0] != name[0]:
            yield from told([first, last] if first is not last else [first])
            first = None
        last = (name, rows)
        first = first or last
    if last is not None:
        yield from told([first, last] if first is not last else [first])


def _end_vectors(parts: pd.DataFrame) -> pd.DataFrame:
    """Costs at the end of each part of one conversation, from the last part backward."""
    parts, now, out = parts.sort_values("part"), AT_END, []
    for part, key, ways in reversed(list(zip(parts["part"], parts["key"], parts["ways"]))):
        out.append((part, key, list(now)))
        now = tuple(min(min(int(ways[to][s]) + now[to] for to in range(4)), NEVER) for s in range(4))
    return pd.DataFrame(out, columns=["part", "key", "ends"])


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the edits up to and with it: from the beginning, or from every state for a part of a longer conversation."""
    out: list[tuple] = []
    schema = pa.schema([("part", pa.int64()), ("key", pa.string()), ("place", pa.int64()), ("n", pa.int64()), ("initial", pa.string()), ("fault", pa.string()), ("start", pa.int32()), ("edits", pa.string()), ("state", pa.int32()), ("last", pa.bool_())])
    for (part, key), rows in _parts(batches, ("place", "initial", "fault", "n", "ends")):
        end, plain = rows[0][4], [row[1:4] for row in rows]
        for start in range(4) if end is not None else (0,):
            walked = walk(plain, tuple(end) if end is not None else AT_END, start)
            for k, (row, (edits, state)) in enumerate(zip(rows, walked)):
                out.append((part, key, row[0], row[3], row[1], row[2], start, edits, state, k + 1 == len(rows)))
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _chained(parts: pd.DataFrame) -> pd.DataFrame:
    """The state in which each part of one conversation begins."""
    to = {(p, s): e for p, s, e in zip(parts["part"], parts["start"], parts["state"])}
    state, out = 0, []
    for part in sorted(set(parts["part"])):
        out.append((part, parts["key"].iloc[0], state))
        state = to[part, state]
    return pd.DataFrame(out, columns=["part", "key", "start"])


def edits_of(marked: DataFrame) -> DataFrame:
    """(key, place, n, initial, fault, edits) of every row of `faults`: the edits up to and with it, in the cheapest repair."""
    apart = marked.repartition("part").sortWithinPartitions("part", "place")
    edges = materialize(apart.select("part", "key", "initial", "fault", "n").mapInArrow(_matrices, "part bigint, key string, ways array<array<bigint>>"), "edges")
    longer = edges.groupBy("key").agg(F.count("*").alias("parts")).where("parts > 1").select("key")
    ends = edges.join(longer, "key").groupBy("key").applyInPandas(_end_vectors, "part bigint, key string, ends array<bigint>")
    ends = materialize(ends, "ends")
    met = marked.join(ends, ["part", "key"], "left").repartition("part").sortWithinPartitions("part", "place")
    walked = met.select("part", "key", "place", "initial", "fault", "n", "ends").mapInArrow(_walks, "part bigint, key string, place bigint, n bigint, initial string, fault string, start int, edits string, state int, last boolean")
    walked = materialize(walked, "walks")
    hops = walked.where("last").join(longer, "key", "left_semi").groupBy("key").applyInPandas(_chained, "part bigint, key string, start int")
    chosen = materialize(hops.where("start > 0"), "starts")  # a part that begins in another state than 0 has its rows of state 0 replaced
    moved = walked.join(chosen.withColumnRenamed("start", "begins"), ["part", "key"], "left")
    return moved.where(F.col("start") == F.coalesce("begins", F.lit(0))).select("key", "place", "n", "initial", "fault", "edits")


REPAIRED = "conv_id {id}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


class _Conversation:
    """What is told of one conversation while its rows pass by."""

    def __init__(self, conv_id):
        self.conv_id, self.state, self.audit, self.hash, self.any = conv_id, 0, [], hashlib.sha256(), False
        self.turns, self.least, self.most, self.turn, self.before, self.illegal = 0, None, None, None, None, 0
        self.counts, self.kept_truncated = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0, FINE: 0}, 0

    def say(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def take(self, turn, role: str, text: str, n: int, initial: str, fault: str, edits: str) -> None:
        if fault == GONE:
            return
        self.counts[fault] += n if fault in (BLANK, DUPLICATE) else 1
        self.counts[DUPLICATE] += 0 if fault in (BLANK, DUPLICATE) else n - 1
        self.illegal += (self.before is not None and (self.before, initial) not in {("s", "u"), ("u", "a"), ("a", "u")}) + n - 1
        self.before = initial
        if turn is not None and turn != self.turn:
            self.turns, self.turn, self.most = self.turns + 1, turn, turn
            self.least = turn if self.least is None else self.least
        self.kept_truncated += fault == TRUNCATED and ("K" in edits or "R" in edits)
        self.edit(edits, role, text, initial)

    def edit(self, edits: str, role: str = "", text: str = "", initial: str = "") -> None:
        self.audit.append(edits)
        for e in edits.rstrip("D"):
            if e == "I":
                self.say(TURN_ROLE[self.state], "")
            elif e in "KR":
                self.say(role if e == "K" else TURN_ROLE[self.state], text)
            if e != "D":
                self.state = KEEP_TO[initial][self.state] if e == "K" else TURN_TO[self.state]

    def row(self) -> tuple:
        self.edit(tail(self.state))
        audit = "".join(self.audit)
        cost = 3 * audit.count("D") + 2 * (audit.count("R") + audit.count("I")) + self.kept_truncated
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *(self.counts[c] for c in (BLANK, DUPLICATE, TRUNCATED)), self.illegal, cost, audit, self.hash.hexdigest())


def _told(id_type: pa.DataType):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive in the order of (key, place), a turn after its edits; texts are hashed as they pass."""
        key, now, out, edited = None, None, [], ()
        for batch in batches:
            for k, edits, n, initial, fault, conv_id, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "edits", "n", "initial", "fault", "conv_id", "turn", "role", "text"))):
                if edits is not None:
                    edited = (n, initial, fault, edits)
                    continue
                if k != key:
                    out += [now.row()] if now else []
                    key, now = k, _Conversation(conv_id)
                now.take(turn, role, text, *edited)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []
        out += [now.row()] if now else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return run


def repair(told: DataFrame) -> DataFrame:
    """One row for each conversation of `told` (conv_id, turn, role, text, n): faults, cheapest repair, and its hash.

    Rows with one turn are taken in the order of role, then text, by code points; a null turn comes first. Rows that repeat,
    and n above 1, are turns that repeat; a row with n = 0 is no turn, but its conversation has a row. Roles count by their
    first character as it is: what is not s, u or a has to be given another role or go. Rows with a null id are one
    conversation, whose id is null. An empty table gives no rows; further columns are not looked at. turn is a whole number.
    """
    small_batches(told.sparkSession)
    turns = in_order(told)
    marked = faults(turns)
    none = [F.lit(None).cast(turns.schema[c].dataType).alias(c) for c in ("conv_id", "turn", "role", "text")]
    found = edits_of(marked).select("key", "place", "edits", "n", "initial", "fault", *none)
    texts = turns.select("key", "place", F.lit(None).cast("string").alias("edits"), "n", *(F.lit(None).cast("string").alias(c) for c in ("initial", "fault")), "conv_id", "turn", "role", "text")
    ordered = found.union(texts).repartition("key").sortWithinPartitions("key", "place", F.col("edits").asc_nulls_last()).drop("place")
    kind = told.schema["conv_id"].dataType
    types = {T.StringType: pa.string(), T.IntegerType: pa.int32(), T.ShortType: pa.int16(), T.ByteType: pa.int8()}
    return ordered.mapInArrow(_told(types.get(type(kind), pa.int64())), REPAIRED.format(id=kind.simpleString()))


def repaired_conversations(turns: DataFrame) -> DataFrame:
    """`repair` of the damaged rows of `turns` (conv_id, turn, role, text)."""
    return repair(damaged(turns))


#: The same in DuckDB's SQL: the checksum bit by bit, and a forward program that keeps the least (cost, edits) of each state.
REPAIRED_SQL = """
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
bits AS (SELECT *, list_prepend(4294967295, flatten(list_transform(string_split(name, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))) AS steps FROM src),
hit AS (SELECT *, xor(list_reduce(steps, lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END), 4294967295) % 20 AS h FROM bits),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hit WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS r, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
f AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM o),
c AS (SELECT conv_id, count(*) AS n, CASE WHEN max(turn) IS NULL THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (p IS NOT NULL AND p || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
w AS (SELECT conv_id, 0 AS i, unnest([{'s': 0, 'e': {'cost': 0, 'audit': '', 'said': []::VARCHAR[]}}, {'s': 2, 'e': {'cost': 2, 'audit': 'I', 'said': ['user:']}}, {'s': 3, 'e': {'cost': 4, 'audit': 'II', 'said': ['user:', 'assistant:']}}], recursive := true) FROM c
 UNION ALL
 SELECT conv_id, i, s, (best).cost, (best).audit, (best).said FROM (
  SELECT conv_id, i, s, min({'cost': cost, 'audit': audit, 'said': said}) AS best FROM (
   SELECT conv_id, i, s2 AS s, c2 AS cost, a2 AS audit, said2 AS said FROM (
    SELECT conv_id, i, unnest([{'s2': t, 'c2': x, 'a2': y, 'said2': z}, {'s2': CASE WHEN t = 2 THEN 3 ELSE 2 END, 'c2': x + 2, 'a2': y || 'I', 'said2': list_append(z, CASE WHEN t = 2 THEN 'assistant:' ELSE 'user:' END)},
      {'s2': CASE WHEN t = 2 THEN 2 ELSE 3 END, 'c2': x + 4, 'a2': y || 'II', 'said2': list_concat(z, CASE WHEN t = 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END)}], recursive := true) FROM (
     SELECT w.conv_id, f.i, unnest([{'t': w.s, 'x': w.cost + 3, 'y': w.audit || 'D', 'z': w.said},
       {'t': CASE WHEN fault IN ('blank', 'duplicate') THEN NULL WHEN r = 's' AND w.s = 0 THEN 1 WHEN r = 'u' AND w.s <> 2 THEN 2 WHEN r = 'a' AND w.s = 2 THEN 3 END, 'x': w.cost + (fault = 'truncated')::INTEGER, 'y': w.audit || 'K', 'z': list_append(w.said, role || ':' || text)},
       {'t': CASE WHEN fault IN ('blank', 'duplicate') THEN NULL WHEN w.s = 2 THEN 3 ELSE 2 END, 'x': w.cost + 2 + (fault = 'truncated')::INTEGER, 'y': w.audit || 'R', 'z': list_append(w.said, CASE WHEN w.s = 2 THEN 'assistant:' ELSE 'user:' END || text)}], recursive := true)
     FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1) WHERE t IS NOT NULL)) GROUP BY conv_id, i, s)),
e AS (SELECT w.conv_id, min({'cost': w.cost, 'audit': w.audit, 'said': w.said}) AS best FROM w JOIN c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i WHERE w.s IN (0, 3) GROUP BY w.conv_id)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce((best).cost, 0) AS cost, coalesce((best).audit, '') AS audit,
 sha256(coalesce(array_to_string((best).said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM k.conv_id
"""
