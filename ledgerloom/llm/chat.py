"""Chat formatting by perspective rotation, in DataFrame functions only.

For every participant (a role other than ``system``) the dialogue is rendered
with that speaker as the assistant and the others as named users. The loss mask
covers what the assistant says, as character spans of the whole rendering.

No conversation meets in one row or task, however long it is: it is cut every
``turns_a_part`` turn numbers, and where more turns than that share a number (or
have none), by their rank among these. The parts in order, joined, are the
rendering, and all offsets count from its start: the lengths of the parts before
are summed from one light row a part.

Defined results: a null text is empty; a null role speaks as ``unknown``; turns
with equal numbers follow in order of role, then text; repeated rows are
rendered as often as they occur; a null turn counts as 0; a conversation with
none but system turns has no participant and no row; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSISTANT, SYSTEM, END = "<|assistant|>\n", "<|system|>\n", "\n<|end|>\n"


def head(role: Column, mine: Column) -> Column:
    return F.when(mine, F.lit(ASSISTANT)).when(role == "system", F.lit(SYSTEM)).otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))


def perspectives(conversations: DataFrame, turns_a_part: int = 256) -> DataFrame:
    """conv_id, perspective, part (from 0), n_turns, part_start, rendered, mask_spans ("start-end,..." in code points of the whole rendering, end excluded), n_masked."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    stretch = F.floor(F.col("turn") / turns_a_part).alias("stretch")
    rank = F.row_number().over(Window.partitionBy("conv_id", "stretch").orderBy("turn", "role", "text")) - 1
    placed = turns.select("*", stretch).withColumn("slice", F.floor(rank / turns_a_part))
    key = ["conv_id", "stretch", "slice"]
    parts = placed.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))

    # One row a part and participant: how long the parts before it are, if all but the participant speak as users.
    as_user = F.char_length(head(F.col("role"), F.lit(False)))
    by_role = placed.groupBy(*key, "role").agg(F.sum(as_user + F.char_length("text") + len(END)).alias("length"), F.count(F.lit(1)).alias("own"))
    lengths = by_role.groupBy(*key).agg(F.sum("length").alias("length"), F.collect_list(F.struct("role", "own")).alias("by"))  # at most turns_a_part roles
    speakers = turns.filter("role <> 'system'").select(F.col("conv_id").alias("_c"), F.col("role").alias("perspective")).distinct()
    grid = lengths.join(speakers, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    said = F.aggregate(F.filter("by", lambda x: x["role"] == F.col("perspective")), F.lit(0).cast("long"), lambda n, x: n + x["own"])
    here = F.col("length") - said * (F.char_length(head(F.col("perspective"), F.lit(False))) - len(ASSISTANT))
    order = Window.partitionBy("conv_id", "perspective").orderBy("stretch", "slice")
    grid = grid.select(
        F.col("conv_id").alias("_c"), F.col("stretch").alias("_s"), F.col("slice").alias("_k"), "perspective",
        (F.row_number().over(order) - 1).cast("long").alias("part"), (F.sum(here).over(order) - here).alias("part_start"),
    )
    own = parts.join(grid, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("stretch") == F.col("_s")) & (F.col("slice") == F.col("_k")))

    def piece(x: Column) -> Column:
        mine = x["role"] == F.col("perspective")
        return F.struct(head(x["role"], mine).alias("head"), x["text"].alias("text"), mine.alias("mine"))

    pieces = own.withColumn("pieces", F.transform("said", piece))
    start = F.struct(F.col("part_start").alias("at"), F.lit(0).cast("long").alias("masked"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.char_length(x["head"])
        b = a + F.char_length(x["text"])
        return F.struct(
            (b + len(END)).alias("at"), (acc["masked"] + F.when(x["mine"], b - a).otherwise(F.lit(0))).alias("masked"),
            F.when(x["mine"], F.concat(acc["spans"], F.array(F.concat_ws("-", a.cast("string"), b.cast("string"))))).otherwise(acc["spans"]).alias("spans"),
        )

    end = pieces.withColumn("mask", F.aggregate("pieces", start, step))
    return end.select(
        "conv_id", "perspective", "part", F.size("pieces").cast("long").alias("n_turns"), "part_start",
        F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["text"], F.lit(END))), "").alias("rendered"),
        F.array_join("mask.spans", ",").alias("mask_spans"), F.col("mask.masked").alias("n_masked"),
    )


ORACLE_SQL = """
WITH t AS (SELECT conv_id, coalesce(turn, 0) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
                  CAST(floor(coalesce(turn, 0) / 256) AS BIGINT) AS stretch FROM conversations),
p AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, stretch ORDER BY turn, role, text) - 1) // 256 AS slice FROM t),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
m AS (SELECT p.*, s.perspective, p.role = s.perspective AS mine, dense_rank() OVER (PARTITION BY p.conv_id, s.perspective ORDER BY stretch, slice) - 1 AS part,
             CASE WHEN p.role = s.perspective THEN '<|assistant|>' || chr(10) WHEN p.role = 'system' THEN '<|system|>' || chr(10)
                  ELSE '<|user name=' || p.role || '|>' || chr(10) END AS head
      FROM p JOIN s ON p.conv_id IS NOT DISTINCT FROM s.conv_id),
n AS (SELECT *, row_number() OVER w AS k,
             CAST(coalesce(sum(length(head) + length(text) + 9) OVER (PARTITION BY conv_id, perspective ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
      FROM m WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn, role, text))
SELECT conv_id, perspective, part, count(*) AS n_turns, min(pos) AS part_start,
       string_agg(head || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY k) AS rendered,
       coalesce(string_agg(CASE WHEN mine THEN CAST(pos + length(head) AS BIGINT) || '-' || CAST(pos + length(head) + length(text) AS BIGINT) END, ',' ORDER BY k), '') AS mask_spans,
       CAST(sum(CASE WHEN mine THEN length(text) ELSE 0 END) AS BIGINT) AS n_masked
FROM n GROUP BY conv_id, perspective, part
"""
