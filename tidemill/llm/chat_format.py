"""Multi-party perspective rotation of dialogues, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Turns are summed in blocks of this many places before the blocks are summed, so no long dialogue is one window.
BLOCK = 256


def rotate_perspectives(turns: DataFrame) -> DataFrame:
    """For every participant of a dialogue, render all of its turns with that speaker as the assistant.

    Input: conv_id, turn, role (the speaker), text; other columns are ignored. Output: one row for each dialogue,
    perspective and turn: ``role`` is ``assistant`` for the perspective's own turns and ``user`` for all others,
    ``name`` is the other speaker's name (null on own turns), ``segment`` the rendered turn, ``train`` the loss
    mask, ``char_start``/``char_end`` the segment's place in the dialogue rendered from this perspective, in turn order.

    Null speakers are the participant ``unknown``; null texts are empty; a null conv_id is a dialogue of its own.
    Turns with equal numbers, repeated rows included, follow in the order of speaker and text; a null number comes
    first. A dialogue with one participant has one perspective. Empty tables give empty results. Texts are rendered as
    they are: role and mask come from the row, so a marker inside a text changes no mask.

    A turn is longer by a constant of its speaker as ``user`` than as ``assistant``. So its place from a perspective is the
    sum of all turns before it as ``user``, less that constant for each earlier turn of the perspective. Sums and counts of
    blocks of turns are made from lengths alone, and the text is shuffled once, by dialogue and block.
    """
    body, speaker = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit("unknown"))
    user, own_head = F.concat(F.lit("<|user name="), F.col("speaker"), F.lit("|>\n")), F.lit("<|assistant|>\n")
    base = turns.select(
        F.when(F.col("conv_id").isNull(), F.lit("n")).otherwise(F.concat(F.lit("c"), F.col("conv_id").cast("string"))).alias("ck"),
        F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(-(1 << 62))).alias("bk"),
        "conv_id", "turn", speaker.alias("speaker"), body.alias("body"),
    ).withColumn("size", (F.length(user) + F.length("body") + 1).cast("long"))
    # Of each block and speaker: turns, and their length as users.
    spoken = base.groupBy("ck", "bk", "speaker").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("s"))
    blocks = spoken.groupBy("ck", "bk").agg(F.sum("s").alias("s"))
    speakers = spoken.select(F.col("ck").alias("pk"), F.col("speaker").alias("perspective")).distinct()
    mine = spoken.select(F.col("ck").alias("mk"), F.col("bk").alias("mb"), F.col("speaker").alias("m"), F.col("c").alias("mc"))
    offsets = blocks.join(speakers, F.col("ck") == F.col("pk")).join(mine, (F.col("ck") == F.col("mk")) & (F.col("bk") == F.col("mb")) & (F.col("perspective") == F.col("m")), "left")
    before = Window.partitionBy("ck", "perspective").orderBy("bk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(
        F.col("ck").alias("ok"), F.col("bk").alias("ob"), "perspective",
        F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"), F.coalesce(F.sum(F.coalesce("mc", F.lit(0))).over(before), F.lit(0)).alias("c0"),
    )
    order = Window.partitionBy("ck", "bk").orderBy(F.col("turn").asc_nulls_first(), "speaker", "body").rowsBetween(Window.unboundedPreceding, 0)
    rows = base.withColumns({"upto": F.sum("size").over(order), "seq": F.row_number().over(order)})
    rows = rows.join(offsets, (F.col("ck") == F.col("ok")) & (F.col("bk") == F.col("ob")))
    own = F.col("speaker") == F.col("perspective")
    turns_so_far = F.count_if(own).over(Window.partitionBy("ck", "bk", "perspective").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    saved = (F.length(F.lit("user name=")) - F.length(F.lit("assistant")) + F.length("perspective")).cast("long")
    end = F.col("s0") + F.col("upto") - saved * (F.col("c0") + turns_so_far)
    segment = F.concat(F.when(own, own_head).otherwise(user), F.col("body"), F.lit("\n"))
    out = rows.select("conv_id", "perspective", "turn", F.when(own, F.lit("assistant")).otherwise(F.lit("user")).alias("role"), F.when(~own, F.col("speaker")).alias("name"), segment.alias("segment"), own.alias("train"), end.alias("char_end"))
    return out.select("conv_id", "perspective", "turn", "role", "name", "segment", "train", (F.col("char_end") - F.length("segment")).alias("char_start"), "char_end")


ORACLE_SQL = f"""
WITH base AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS body FROM conversations),
speakers AS (SELECT DISTINCT conv_id, speaker AS perspective FROM base),
r AS (
  SELECT b.conv_id, s.perspective, b.turn, b.speaker, b.speaker = s.perspective AS train,
    '<|' || CASE WHEN b.speaker = s.perspective THEN 'assistant' ELSE 'user name=' || b.speaker END || '|>' || chr(10) || b.body || chr(10) AS segment
  FROM base b JOIN speakers s ON b.conv_id IS NOT DISTINCT FROM s.conv_id),
c AS (
  SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, segment ROWS UNBOUNDED PRECEDING) AS char_end FROM r)
SELECT conv_id, perspective, turn, CASE WHEN train THEN 'assistant' ELSE 'user' END AS role,
  CASE WHEN train THEN NULL ELSE speaker END AS name, segment, train,
  CAST(char_end - length(segment) AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end
FROM c
"""
