"""Preference formatting: the common turns of two conversations once as prompt, then both masked completions.

Pairs come either from the caller or from `preference_pairs`: conversations that open with the same turn are each other's
alternatives; a conversation without such a sibling is set against itself with the last answer borrowed from a conversation
of about as many turns and the nearest length of answer. Either way the longest common prefix of turns is found by comparing
them. Everything is built from array functions, one row a conversation; a conversation is one training example, so its
text fits a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, quoted, running

TURN_START, TURN_END = "<|im_start|>", "<|im_end|>\n"


def _turn(turns: DataFrame) -> Column:
    return F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def conversations(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turns array<struct<role, text>>): turns in the order of turn (null first), role, text.

    A null role is "unknown" and a null text is empty. Rows that repeat are turns that repeat. Turns whose id is null
    belong to no conversation and are left out; see `stray_turns`.
    """
    whole = turns.select(quoted(id_col).cast("bigint").alias("conv_id"), _turn(turns).alias("x")).where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return whole.select("conv_id", F.transform("x", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def stray_turns(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Turns whose id is null, each as a conversation of one turn whose id is null."""
    x = _turn(turns)
    one = F.array(F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return turns.where(quoted(id_col).isNull()).select(F.lit(None).cast("bigint").alias("conv_id"), one.alias("turns"))


def answers(turns: Column) -> Column:
    return F.filter(turns, lambda t: t["role"] == "assistant")


def preference_pairs(told: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, rejected_id, borrowed) for all of `told` (conv_id, turns); ids only, no texts.

    Conversations with one opening turn pair up in the order of their ids, wherever these lie; of two, the one in which
    assistants say more is chosen, then the smaller id, and pair_id is the smaller id. One that is left over is chosen by
    itself. If it has an answer, `rejected_id` is the conversation to borrow one from: of those left over, in the order of
    the number of turns, the answer's length and the id, places 0 and 1, 2 and 3, ... borrow from each other, and a last
    odd one from the place before. If there is none, rejected_id is null.
    """
    first, last = F.col("turns")[0], F.try_element_at(answers(F.col("turns")), F.lit(-1))["text"]
    opening = F.md5(F.concat(first["role"], F.lit("\x1f"), first["text"]).cast("binary"))
    keys = materialize(told.select("conv_id", opening.alias("opening"), F.size("turns").alias("n"), said(F.col("turns")).alias("said"), F.length(last).alias("answer")), "openings")
    placed = running(keys, "opening", ["conv_id"]).withColumn("pair", F.floor(F.col("place") / 2))
    one = F.struct(F.negative(F.col("said")).alias("order"), "conv_id", "n", "answer")
    pairs = placed.groupBy("opening", "pair").agg(F.min("conv_id").alias("pair_id"), F.array_sort(F.collect_list(one)).alias("x"))
    pairs = materialize(pairs.select("pair_id", F.col("x")[0].alias("chosen"), F.try_element_at("x", F.lit(2))["conv_id"].alias("rejected_id")), "siblings")

    alone = pairs.where("rejected_id is null").select("chosen.*")
    one_order = alone.where("answer is not null").withColumn("all", F.lit(0))
    lenders = materialize(running(one_order, "all", ["n", "answer", "conv_id"]).select("place", "conv_id"), "lenders")
    after = lenders.select((F.col("place") - 1).alias("place"), F.col("conv_id").alias("after_id"))
    before = lenders.select((F.col("place") + 1).alias("place"), F.col("conv_id").alias("before_id"))
    lent = lenders.join(after, "place", "left").join(before, "place", "left")
    lent = lent.select("conv_id", F.when(F.col("place") % 2 == 0, F.coalesce("after_id", "before_id")).otherwise(F.col("before_id")).alias("lender"))

    siblings = pairs.where("rejected_id is not null").select("pair_id", F.col("chosen.conv_id").alias("chosen_id"), "rejected_id", F.lit(False).alias("borrowed"))
    single = alone.join(lent, "conv_id", "left").select(F.col("conv_id").alias("pair_id"), F.col("conv_id").alias("chosen_id"), F.col("lender").alias("rejected_id"), F.lit(True).alias("borrowed"))
    return siblings.union(single)


def with_answer(turns: Column, text: Column) -> Column:
    """`turns` with another text in the last turn of an assistant."""
    place = F.size(turns) - F.array_position(F.transform(F.reverse(turns), lambda t: t["role"] == "assistant"), True)
    return F.transform(turns, lambda t, i: F.struct(t["role"].alias("role"), F.when(i == place, text).otherwise(t["text"]).alias("text")))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two arrays of turns have in common from the start."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(a).cast("bigint"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(TURN_START), turn["role"], F.lit("\n"), turn["text"], F.lit(TURN_END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def completion_mask(turns: Column) -> Column:
    """Character spans "start:end" that are trained on, in the rendered completion: what assistants say, with its end mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def one(s: Column, t: Column) -> Column:
        head = s["at"] + F.lit(len(TURN_START) + 1) + F.length(t["role"])
        end = s["at"] + F.length(rendered(t))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(s["spans"], F.array(F.concat_ws(":", head, end)))).otherwise(s["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, one, lambda s: s["spans"]), ",")


def said(turns: Column) -> Column:
    """Characters that assistants say."""
    return F.aggregate(turns, F.lit(0), lambda n, t: n + F.when(t["role"] == "assistant", F.length(t["text"])).otherwise(0))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """pairs: pair_id, chosen_id, chosen, rejected_id, rejected (arrays of turns; rejected may be null).

    Returns pair_id, chosen_id, rejected_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask. Equal
    conversations have all turns in the prompt and empty completions. Without a rejected side, the prompt is what
    comes before the last turn of the chosen one.
    """
    alone = F.col("rejected").isNull()
    n = F.when(alone, F.greatest(F.size("chosen") - 1, F.lit(0)).cast("bigint")).otherwise(common_turns(F.col("chosen"), F.col("rejected"))).cast("int")
    cut = pairs.withColumn("n_common", n)
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    cut = cut.select("pair_id", "chosen_id", "rejected_id", "n_common", F.slice("chosen", 1, F.col("n_common")).alias("prompt"), rest("chosen").alias("a"), rest("rejected").alias("b"))
    return cut.select(
        "pair_id", "chosen_id", "rejected_id", "n_common", render(F.col("prompt")).alias("prompt"),
        render(F.col("a")).alias("chosen"), F.when(F.col("b").isNotNull(), render(F.col("b"))).alias("rejected"),
        completion_mask(F.col("a")).alias("chosen_mask"), F.when(F.col("b").isNotNull(), completion_mask(F.col("b"))).alias("rejected_mask"),
    )


def preference_rows(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Preference rows of all conversations, paired by `preference_pairs`: every conversation is in one pair of siblings,
    or is the chosen side of a row of its own.

    The rejected side is null only for a conversation without an answer or without another to borrow from, and for turns
    whose id is null, each of which is a row of its own. Columns other than turn, role and text are not looked at. An
    empty table gives no rows.
    """
    told = materialize(conversations(turns, id_col), "told")
    pairs = preference_pairs(told)
    chosen = pairs.join(told.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen")), "chosen_id")
    other = told.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("other"))
    answer = F.try_element_at(answers(F.col("other")), F.lit(-1))["text"]
    rejected = F.when(F.col("other").isNull(), None).when(F.col("borrowed"), with_answer(F.col("chosen"), answer)).otherwise(F.col("other"))
    both = chosen.join(other, "rejected_id", "left").select("pair_id", "chosen_id", "chosen", "rejected_id", rejected.alias("rejected"))
    strays = stray_turns(turns, id_col).select(F.col("conv_id").alias("pair_id"), F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen"), F.col("conv_id").alias("rejected_id"), F.lit(None).cast(told.schema["turns"].dataType).alias("rejected"))
    return format_preferences(both.union(strays))


#: The same in DuckDB's SQL.
PREFERENCE_SQL = """
WITH named AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, role, text FROM named WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS said,
        max(i) FILTER (WHERE role = 'assistant') AS last, md5(arg_min(role || chr(31) || text, i)) AS opening FROM t GROUP BY conv_id),
a AS (SELECT c.conv_id, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i = c.last),
p AS (SELECT conv_id, opening, said, n, (row_number() OVER (PARTITION BY opening ORDER BY conv_id) - 1) // 2 AS pair FROM c),
s AS (SELECT min(conv_id) AS pair_id, arg_min(conv_id, (-said, conv_id)) AS chosen_id, CASE WHEN count(*) > 1 THEN arg_max(conv_id, (-said, conv_id)) END AS rejected_id
      FROM p GROUP BY opening, pair),
l AS (SELECT chosen_id AS conv_id, row_number() OVER (ORDER BY c.n, length(a.text), chosen_id) - 1 AS place
      FROM s JOIN c ON c.conv_id = chosen_id JOIN a ON a.conv_id = chosen_id WHERE rejected_id IS NULL),
b AS (SELECT x.conv_id, coalesce(near.conv_id, back.conv_id) AS lender FROM l x
      LEFT JOIN l near ON near.place = x.place + CASE WHEN x.place % 2 = 0 THEN 1 ELSE -1 END
      LEFT JOIN l back ON back.place = x.place - 1),
q AS (SELECT pair_id, chosen_id, rejected_id, false AS borrowed FROM s WHERE rejected_id IS NOT NULL
      UNION ALL SELECT pair_id, chosen_id, lender, true FROM s LEFT JOIN b ON b.conv_id = s.chosen_id WHERE rejected_id IS NULL),
v AS (SELECT pair_id, 1 AS side, i, role, text FROM q JOIN t ON t.conv_id = q.chosen_id
      UNION ALL SELECT pair_id, 2, i, role, text FROM q JOIN t ON t.conv_id = q.rejected_id WHERE NOT borrowed
      UNION ALL SELECT pair_id, 2, i, role, CASE WHEN i = c.last THEN a.text ELSE t.text END
        FROM q JOIN t ON t.conv_id = q.chosen_id JOIN c ON c.conv_id = q.chosen_id JOIN a ON a.conv_id = q.rejected_id WHERE borrowed),
w AS (SELECT pair_id, i, count(DISTINCT (role, text)) = 1 AND count(*) = 2 AS same FROM v GROUP BY pair_id, i),
k AS (SELECT q.*, CASE WHEN rejected_id IS NULL THEN (SELECT n - 1 FROM c WHERE c.conv_id = chosen_id)
        ELSE coalesce((SELECT min(i) - 1 FROM w WHERE w.pair_id = q.pair_id AND NOT same), (SELECT n FROM c WHERE c.conv_id = chosen_id)) END AS n_common FROM q),
z AS (SELECT pair_id, side, i, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown, n_common FROM v JOIN k USING (pair_id)),
y AS (SELECT *, sum(CASE WHEN i > n_common THEN length(shown) ELSE 0 END) OVER (PARTITION BY pair_id, side ORDER BY i) AS upto FROM z),
g AS (SELECT pair_id, side,
        coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE i <= n_common), '') AS prompt,
        coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE i > n_common), '') AS told,
        coalesce(string_agg((upto - length(shown) + 13 + length(role)) || ':' || upto, ',' ORDER BY i) FILTER (WHERE i > n_common AND role = 'assistant'), '') AS mask
      FROM y GROUP BY pair_id, side)
SELECT k.pair_id, k.chosen_id, k.rejected_id, CAST(k.n_common AS INTEGER) AS n_common, x.prompt, x.told AS chosen, y.told AS rejected,
       x.mask AS chosen_mask, y.mask AS rejected_mask
FROM k JOIN g x ON x.pair_id = k.pair_id AND x.side = 1 LEFT JOIN g y ON y.pair_id = k.pair_id AND y.side = 2
UNION ALL
SELECT NULL, NULL, NULL, 0, '', '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), NULL,
       CASE WHEN role = 'assistant' THEN (length(role) + 13) || ':' || (length(role) + length(text) + 24) ELSE '' END, NULL
FROM named WHERE conv_id IS NULL
"""
