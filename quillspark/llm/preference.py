"""Preference formatting of chosen and rejected conversations, in DataFrame operations only.

The longest common turn prefix of the two conversations of a pair is rendered once, as the prompt; what follows in each is its
completion. A completion is paired with a mask: the places (code points of the completion, end exclusive) of the assistant's words and their end
mark, on which a loss is to be taken; headers and other roles are masked out.

Turns are compared one by one, so a pair's conversations never have to sit in memory side by side: the first turn that differs is a
minimum over pairs of equal turn numbers, combined before it is shuffled. Only the rendering gathers a conversation, as its
result is one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm._order import Blocks, next_blocks


def _turns(conversations: DataFrame) -> DataFrame:
    """One row per (conv_id, turn), renumbered from 0 without gaps; of repeated turns the least (role, text) stays."""
    known = conversations.where("conv_id is not null and turn is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    least = known.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("t"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return least.select("conv_id", at.cast("long").alias("turn"), F.col("t.role").alias("role"), F.col("t.text").alias("text"))


def preference_pairs(conversations: DataFrame) -> DataFrame:
    """(pair_id, side, turn, role, text) from plain conversations (conv_id, turn, role, text).

    Each conversation with a reply by the assistant gives a pair: chosen is the conversation up to its last such reply, rejected is the same
    with that reply taken from the next conversation (ascending conv_id among those with a reply; after the last, the first).
    """
    turns = _turns(conversations)
    last = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("r")).select("conv_id", F.col("r.turn").alias("last"), F.col("r.text").alias("reply"))
    placed = last.withColumn("block", Blocks(last.select("conv_id"), "conv_id").of(F.lit(0)))
    order = Window.partitionBy("block").orderBy("conv_id")
    firsts = placed.withColumn("rn", F.row_number().over(order)).where("rn = 1").select(F.col("block").alias("next_block"), F.col("reply").alias("first_reply"))
    rim = next_blocks(placed).join(firsts, "next_block").select("block", "first_reply")
    led = placed.withColumn("n", F.lead("reply").over(order)).join(rim, "block").select("conv_id", "last", F.coalesce("n", "first_reply").alias("other"))
    both = turns.join(led, "conv_id").where("turn <= last")
    sides = both.withColumn("side", F.explode(F.array(F.lit("chosen"), F.lit("rejected"))))
    return sides.select(F.col("conv_id").alias("pair_id"), "side", "turn", "role", F.when((F.col("side") == "rejected") & (F.col("turn") == F.col("last")), F.col("other")).otherwise(F.col("text")).alias("text"))


def render(role: Column, text: Column, start: str = "<|im_start|>", end: str = "<|im_end|>") -> Column:
    """One turn as text: a header line with the role, the words, and an end mark."""
    return F.concat(F.lit(start), role, F.lit("\n"), text, F.lit(end), F.lit("\n"))


def format_preferences(pairs: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """One row per pair_id of ``pairs`` (pair_id, side 'chosen' or 'rejected', turn, role, text).

    pair_id, n_common (turns), prompt, chosen, chosen_mask, rejected, rejected_mask. Masks list start:end, comma-joined. A turn is
    common if role and text are equal in both sides. Null roles count as 'user' and null texts as empty; rows without
    pair_id, turn or a known side are ignored; of repeated turns the least (role, text) counts. A side without turns has an empty completion, and
    equal sides have two. Other columns are not looked at; an empty table gives an empty result. Marks in the texts
    are not escaped: choose ones that can't occur.
    """
    known = pairs.where("pair_id is not null and turn is not null and side in ('chosen', 'rejected')").select(F.col("pair_id").cast("long").alias("pair_id"), "side", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    of = lambda side: F.min(F.when(F.col("side") == side, F.struct("role", "text")))
    turns = known.groupBy("pair_id", "turn").agg(of("chosen").alias("c"), of("rejected").alias("r"))
    # Turns stand side by side; the first that differs is known before anything is gathered.
    differs = ~F.col("c").eqNullSafe(F.col("r"))
    first = turns.where(differs).groupBy("pair_id").agg(F.min("turn").alias("first"))
    marked = turns.join(first, "pair_id", "left").withColumn("common", F.col("first").isNull() | (F.col("turn") < F.col("first")))
    gather = lambda cond, turn: F.array_sort(F.collect_list(F.when(cond, F.struct("turn", F.col(turn + ".role").alias("role"), F.col(turn + ".text").alias("text")))))
    rows = marked.groupBy("pair_id").agg(gather(F.col("common") & F.col("c").isNotNull(), "c").alias("p"), gather(~F.col("common") & F.col("c").isNotNull(), "c").alias("c"), gather(~F.col("common") & F.col("r").isNotNull(), "r").alias("r"))
    text = lambda c: F.array_join(F.transform(c, lambda t: render(t["role"], t["text"], start, end)), "")

    def mask(c: str) -> Column:
        def step(acc: Column, t: Column) -> Column:
            a = acc["at"] + F.char_length(F.concat(F.lit(start), t["role"], F.lit("\n")))
            b = a + F.char_length(t["text"]) + len(end)
            own = F.concat_ws(":", a.cast("string"), b.cast("string"))
            return F.struct((b + 1).alias("at"), F.when(t["role"] == "assistant", F.concat(acc["out"], F.array(own))).otherwise(acc["out"]).alias("out"))

        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(c, begin, step, lambda a: F.array_join(a["out"], ","))

    return rows.select("pair_id", F.size("p").cast("long").alias("n_common"), text("p").alias("prompt"), text("c").alias("chosen"), mask("c").alias("chosen_mask"), text("r").alias("rejected"), mask("r").alias("rejected_mask"))


PREFERENCE_SQL = """
WITH t0 AS (
  SELECT conv_id, turn, min(struct_pack(role := coalesce(role, 'user'), text := coalesce(text, ''))) AS t FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, t.role AS role, t.text AS text FROM t0),
l AS (SELECT conv_id, max(turn) AS last FROM t WHERE role = 'assistant' GROUP BY conv_id),
r AS (SELECT l.conv_id, l.last, t.text AS reply FROM l JOIN t ON t.conv_id = l.conv_id AND t.turn = l.last),
o AS (SELECT conv_id, last, reply, coalesce(lead(reply) OVER (ORDER BY conv_id), first_value(reply) OVER (ORDER BY conv_id)) AS other FROM r),
s AS (
  SELECT t.conv_id, t.turn, t.role, t.text AS c, CASE WHEN t.turn = o.last THEN o.other ELSE t.text END AS r, o.last, (o.reply = o.other) AS same
  FROM t JOIN o ON t.conv_id = o.conv_id AND t.turn <= o.last),
m AS (
  SELECT conv_id, turn, same OR turn < last AS common,
    '<|im_start|>' || role || chr(10) || c || '<|im_end|>' || chr(10) AS c, '<|im_start|>' || role || chr(10) || r || '<|im_end|>' || chr(10) AS r FROM s)
SELECT conv_id AS pair_id, count(*) FILTER (common) AS n_common,
  coalesce(string_agg(c, '' ORDER BY turn) FILTER (common), '') AS prompt,
  coalesce(string_agg(c, '' ORDER BY turn) FILTER (NOT common), '') AS chosen,
  coalesce(max('22:' || (length(c) - 1)::VARCHAR) FILTER (NOT common), '') AS chosen_mask,
  coalesce(string_agg(r, '' ORDER BY turn) FILTER (NOT common), '') AS rejected,
  coalesce(max('22:' || (length(r) - 1)::VARCHAR) FILTER (NOT common), '') AS rejected_mask
FROM m GROUP BY conv_id
"""
