"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as the
assistant and all others as named users; the mask names the spans to train on, which are that
speaker's words and the end marks after them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Turns of a rendered part: turn numbers 0-127, 128-255, ... A dialogue up to that is one row.
PART_TURNS = 128


def _role(t: Column, me: Column, system: tuple[str, ...]) -> Column:
    return (
        F.when(t["who"] == me, F.lit("assistant"))
        .when(t["who"].isin(*system), F.lit("system"))
        .otherwise(F.concat(F.lit("user name="), F.translate(F.replace(t["who"], F.lit("<|"), F.lit("< |")), "\r\n", "  ")))
    )


def render_perspectives(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role",
    text: str = "text", system: tuple[str, ...] = ("system",), part_turns: int = PART_TURNS,
) -> DataFrame:
    """(conversation, perspective, part, cut, n_turns, n_rows, n_trained, text, mask).

    ``mask``: character spans ``start:end`` (end exclusive, 0-based, into ``text``) joined by ','.
    Turns stand in order of turn, then speaker, then text; null turns come last, in a part of their
    own (null). Identical rows are one turn sent again: rendered once, counted in ``n_rows``. A null
    speaker is named 'unknown', a null text is empty. Speakers in ``system`` are rendered as system
    and have no perspective; a conversation of only those gives no row. Control marks inside a text
    are broken by a space, in a speaker's name too, and a name's line ends become spaces, so neither can
    forge a turn. An empty table gives an empty result. A null conversation id is a conversation.
    ``cut`` is always 0: a part is rendered whole, however many of its rows tie in turn, so a part's
    distinct rows must fit a task.
    """
    said = turns.select(
        F.col(conversation).alias("conv"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(speaker).cast("string"), F.lit("unknown")).alias("who"),
        F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|"), F.lit("< |")).alias("what"),
    ).withColumn("part", F.expr(f"turn div {part_turns}"))
    # copies of a row are merged before the shuffle already, so a conversation sent very often is small here
    parts = said.groupBy("conv", "part").agg(
        F.sort_array(F.collect_set(F.struct(F.col("turn").isNull().alias("last"), "turn", "who", "what"))).alias("said"),
        F.count("*").alias("n_rows"),
    ).withColumn("cut", F.lit(0))
    # a row for each speaker, so that no conversation's speakers are gathered in one
    people = said.where(~F.col("who").isin(*system)).select(F.col("conv").alias("_conv"), F.col("who").alias("me")).distinct()
    each = parts.join(people, F.col("conv").eqNullSafe(F.col("_conv"))).select("conv", "part", "cut", "n_rows", "said", "me")
    me = F.col("me")
    heads = F.transform("said", lambda t: F.concat(F.lit(START), _role(t, me, system), F.lit("\n")))
    bodies = F.transform("said", lambda t: F.concat(t["what"], F.lit(END)))
    walk = F.aggregate(
        F.arrays_zip("said", heads.alias("head"), bodies.alias("body")),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<string>)").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t["head"]) + F.length(t["body"]) + 1).alias("at"),
            F.when(
                t["said"]["who"] == me,
                F.array_append(a["spans"], F.concat_ws(":", a["at"] + F.length(t["head"]), a["at"] + F.length(t["head"]) + F.length(t["body"]))),
            ).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    lines = F.transform(F.arrays_zip(heads.alias("head"), bodies.alias("body")), lambda t: F.concat(t["head"], t["body"], F.lit("\n")))
    return each.withColumn("_spans", walk).select(
        F.col("conv").alias(conversation), me.alias("perspective"), "part", "cut",
        F.size("said").cast("bigint").alias("n_turns"), "n_rows", F.size("_spans").cast("bigint").alias("n_trained"),
        F.array_join(lines, "").alias("text"), F.array_join("_spans", ",").alias("mask"),
    )


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from each participant's side. Nulls, ties, repeated rows and an empty table are treated as ``render_perspectives`` says."""
    return render_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP5_SQL = """
WITH said AS (
  SELECT conv_id, turn::BIGINT AS turn, coalesce(role, 'unknown') AS who, replace(coalesce(text, ''), '<|', '< |') AS what, count(*) AS n
  FROM conversations GROUP BY ALL),
people AS (SELECT DISTINCT conv_id, who AS me FROM said WHERE who <> 'system'),
lines AS (
  SELECT s.conv_id, me, turn // 128 AS part, turn, who, what, n,
         '<|im_start|>' || CASE WHEN who = me THEN 'assistant' WHEN who = 'system' THEN 'system' ELSE 'user name=' || translate(replace(who, '<|', '< |'), chr(13) || chr(10), '  ') END || chr(10) AS head,
         what || '<|im_end|>' AS body
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, me, part ORDER BY turn, who, what) - length(body) - 1 AS pos FROM lines)
SELECT conv_id, me AS perspective, part, 0 AS cut, count(*)::BIGINT AS n_turns, sum(n)::BIGINT AS n_rows,
       (count(*) FILTER (who = me))::BIGINT AS n_trained,
       string_agg(head || body || chr(10), '' ORDER BY turn, who, what) AS text,
       coalesce(string_agg(pos::BIGINT || ':' || (pos + length(body))::BIGINT, ',' ORDER BY turn, who, what) FILTER (who = me), '') AS mask
FROM placed GROUP BY conv_id, me, part
"""
