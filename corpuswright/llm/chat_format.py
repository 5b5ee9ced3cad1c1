"""Preference formatting of chosen and rejected conversations, with DataFrame functions only.

The longest common prefix of turns is rendered once, as the prompt; what follows it in either conversation is a completion.
A completion's mask lists the character spans to train on: the text and end mark of each assistant turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (role, text) in order of turn, then role, then text.

    Null texts are empty, null roles are `user`, null turns come first; rows without conv_id belong to no conversation and are
    left out. A conversation is the unit that is rendered, so it is held whole.
    """
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"), turn["text"], F.lit(CLOSE + "\n"))


def _join(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _mask(turns: Column) -> Column:
    """start:end of each assistant turn's text and end mark in the joined turns, comma-joined; code points, end exclusive."""

    def add(acc: Column, turn: Column) -> Column:
        begin = acc["at"] + F.length(turn["role"]) + F.lit(len(OPEN) + 1)
        end = begin + F.length(turn["text"]) + F.lit(len(CLOSE))
        span = F.concat(F.when(acc["spans"] == "", "").otherwise(","), begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct(
            (end + F.lit(1)).alias("at"),
            F.when(turn["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.lit("").alias("spans")), add)["spans"]


def common_turns(a: Column, b: Column) -> Column:
    """The number of turns in the longest common prefix of two arrays of turns."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs == 0, F.least(F.size(a), F.size(b))).otherwise(differs - 1).cast("int")


def format_pairs(pairs: DataFrame, *keep: str) -> DataFrame:
    """n_prefix, prompt, chosen, rejected, chosen_mask, rejected_mask for rows with arrays of turns `chosen` and `rejected`.

    Equal conversations give empty completions with empty masks; a null or empty array counts as no turns. Rows never meet.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    a, b = F.coalesce("chosen", empty), F.coalesce("rejected", empty)
    cut = pairs.select(*keep, a.alias("a"), b.alias("b"), common_turns(a, b).alias("n_prefix"))
    rest = lambda c: F.slice(c, F.col("n_prefix") + 1, F.greatest(F.size(c) - F.col("n_prefix"), F.lit(0)))
    split = cut.select(*keep, "n_prefix", F.slice("a", F.lit(1), F.col("n_prefix")).alias("p"), rest(F.col("a")).alias("a"), rest(F.col("b")).alias("b"))
    return split.select(
        *keep, F.col("n_prefix").cast("long").alias("n_prefix"), _join(F.col("p")).alias("prompt"),
        _join(F.col("a")).alias("chosen"), _join(F.col("b")).alias("rejected"),
        _mask(F.col("a")).alias("chosen_mask"), _mask(F.col("b")).alias("rejected_mask"),
    )


def pair_conversations(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """format_pairs over two tables of turns with the same conv_id for the two sides of a pair; one-sided ones are left out."""
    a = conversations(chosen).withColumnRenamed("turns", "chosen")
    b = conversations(rejected).withColumnRenamed("turns", "rejected")
    return format_pairs(a.join(b, "conv_id"), "conv_id")


def parroting_pairs(turns: DataFrame) -> DataFrame:
    """A pair from every conversation with an assistant turn, for training on last answers only: chosen ends with the last one; rejected has there the text of
    the conversation's first turn instead (an answer that parrots), or nothing if the answer is the first turn."""
    last = F.aggregate(
        F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1).otherwise(0)), F.lit(0), lambda acc, i: F.greatest(acc, i)
    )
    told = conversations(turns).withColumn("last", last).where("last > 0")
    answer = F.when(F.col("last") > 1, F.element_at("turns", 1)["text"]).otherwise("")
    chosen = F.slice("turns", F.lit(1), F.col("last"))
    parrot = F.struct(F.lit("assistant").alias("role"), answer.alias("text"))
    return told.select("conv_id", chosen.alias("chosen"), F.concat(F.slice("turns", F.lit(1), F.col("last") - 1), F.array(parrot)).alias("rejected"))


def whole_pairs(turns: DataFrame) -> DataFrame:
    """A pair from every conversation, with all its turns on both sides: in rejected one answer has the text of the
    conversation's first turn instead, or nothing if it is the first turn. The answer is drawn by conv_id, so pairs part
    anywhere; a conversation without an answer is on both sides as it is.
    """
    is_answer = F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1))
    told = conversations(turns).withColumn("answers", F.filter(is_answer, lambda i: i.isNotNull()))
    draw = F.conv(F.left(F.md5(F.col("conv_id").cast("string")), F.lit(8)), 16, 10).cast("long")
    drawn = F.pmod(draw, F.greatest(F.size("answers"), F.lit(1))).cast("int") + 1
    told = told.withColumn("at", F.when(F.size("answers") > 0, F.element_at("answers", drawn)))
    text = F.when(F.col("at") > 1, F.element_at("turns", 1)["text"]).otherwise("")
    parrot = F.struct(F.lit("assistant").alias("role"), text.alias("text"))
    swapped = F.transform("turns", lambda t, i: F.when(F.col("at") == i + 1, parrot).otherwise(t))
    return told.select("conv_id", F.col("turns").alias("chosen"), swapped.alias("rejected"))


ORACLE_LAST = r"""
    WITH t AS (
      SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS i
      FROM conversations WHERE conv_id IS NOT NULL
    ), l AS (
      SELECT conv_id, max(i) FILTER (WHERE role = 'assistant') AS last, max(text) FILTER (WHERE i = 1) AS first_text FROM t GROUP BY 1
    ), r AS (
      SELECT conv_id, i, text, last, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown,
             CASE WHEN last > 1 THEN first_text ELSE '' END AS parrot
      FROM t JOIN l USING (conv_id) WHERE i <= last
    ), e AS (
      SELECT conv_id, last, max(text) FILTER (WHERE i = last) AS answer, max(parrot) AS parrot FROM r GROUP BY 1, 2
    ), n AS (
      SELECT *, CASE WHEN answer = parrot THEN last ELSE last - 1 END AS n_prefix FROM e
    ), p AS (
      SELECT r.conv_id, string_agg(shown, '' ORDER BY i) FILTER (WHERE i <= n_prefix) AS prompt FROM r JOIN n USING (conv_id) GROUP BY 1
    )
    SELECT conv_id, CAST(n_prefix AS BIGINT) AS n_prefix, coalesce(prompt, '') AS prompt,
           CASE WHEN n_prefix = last THEN '' ELSE '<|im_start|>assistant' || chr(10) || answer || '<|im_end|>' || chr(10) END AS chosen,
           CASE WHEN n_prefix = last THEN '' ELSE '<|im_start|>assistant' || chr(10) || parrot || '<|im_end|>' || chr(10) END AS rejected,
           CASE WHEN n_prefix = last THEN '' ELSE '22:' || (32 + length(answer)) END AS chosen_mask,
           CASE WHEN n_prefix = last THEN '' ELSE '22:' || (32 + length(parrot)) END AS rejected_mask
    FROM n JOIN p USING (conv_id)
"""

ORACLE = r"""
    WITH t AS (
      SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS i
      FROM conversations WHERE conv_id IS NOT NULL
    ), a AS (
      SELECT conv_id, count(*) AS n, coalesce(list(i ORDER BY i) FILTER (WHERE role = 'assistant'), []) AS answers, max(text) FILTER (WHERE i = 1) AS first_text FROM t GROUP BY 1
    ), d AS (
      SELECT *, answers[1 + CAST('0x' || left(md5(CAST(conv_id AS VARCHAR)), 8) AS BIGINT) % greatest(len(answers), 1)] AS place FROM a
    ), s AS (
      SELECT t.*, n, place, CASE WHEN i = place THEN CASE WHEN place > 1 THEN first_text ELSE '' END ELSE text END AS other FROM t JOIN d USING (conv_id)
    ), p AS (
      SELECT conv_id, CASE WHEN max(CASE WHEN text <> other THEN 1 ELSE 0 END) = 1 THEN max(place) - 1 ELSE max(n) END AS n_prefix FROM s GROUP BY 1
    ), r AS (
      SELECT s.*, n_prefix, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown, '<|im_start|>' || role || chr(10) || other || '<|im_end|>' || chr(10) AS shown_other
      FROM s JOIN p USING (conv_id)
    ), o AS (
      SELECT *, sum(CASE WHEN i > n_prefix THEN length(shown) ELSE 0 END) OVER w - length(shown) AS own_off, sum(CASE WHEN i > n_prefix THEN length(shown_other) ELSE 0 END) OVER w - length(shown_other) AS other_off
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY i)
    )
    SELECT conv_id, CAST(n_prefix AS BIGINT) AS n_prefix, coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE i <= n_prefix), '') AS prompt,
           coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE i > n_prefix), '') AS chosen, coalesce(string_agg(shown_other, '' ORDER BY i) FILTER (WHERE i > n_prefix), '') AS rejected,
           coalesce(string_agg((own_off + length(role) + 13) || ':' || (own_off + length(role) + 23 + length(text)), ',' ORDER BY i) FILTER (WHERE i > n_prefix AND role = 'assistant'), '') AS chosen_mask,
           coalesce(string_agg((other_off + length(role) + 13) || ':' || (other_off + length(role) + 23 + length(other)), ',' ORDER BY i) FILTER (WHERE i > n_prefix AND role = 'assistant'), '') AS rejected_mask
    FROM o GROUP BY conv_id, n_prefix
"""
