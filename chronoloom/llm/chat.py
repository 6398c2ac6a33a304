"""Multi-party perspective rotation: each conversation is rendered once for every participant, who becomes the assistant.

A rendering is a run of segments, one row per turn, with character offsets into the whole rendering. Keeping segments as rows
lets a conversation be as long as it likes: offsets are summed within blocks of turns and over blocks, so no task needs a whole
conversation. Only DataFrame functions are used.

Defined cases: a null role speaks as ``unknown``; a null text is empty; turns that share a number follow role, then text; a
null turn comes first; repeated rows are repeated turns; a conversation with nobody but the system has no perspective and no
rows; an empty table gives an empty result; a null conversation is one of its own; marks inside a text or a role's name are broken
up, so that neither can open or close a turn (``speaker`` and ``perspective`` give the role as it is).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Turn numbers of one block.
BLOCK = 1024
SYSTEM = "system"


def unmarked(c: Column) -> Column:
    """Without marks that open or close."""
    return F.replace(F.replace(c, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def rotate(turns: DataFrame, *, block: int = BLOCK, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key, perspective, seq (from 0), turn, speaker, rendered, char_start, char_end, masked, loss_start, loss_end.

    masked is true where no loss is taken; loss_start and loss_end span the assistant's words and its end mark, else null.
    """
    said = turns.select(
        F.col(key).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("speaker"),
        unmarked(F.coalesce(F.col(text), F.lit(""))).alias("body"),
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / F.lit(block)), F.lit(-1 << 62)))
    mine, system = F.col("speaker") == F.col("perspective"), F.col("speaker") == F.lit(SYSTEM)
    head = F.when(system, F.lit("<|system|>\n")).when(mine, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), unmarked(F.col("speaker")), F.lit("|>\n")))
    tail = F.lit("<|end|>\n")
    parts = said.groupBy("conv", "block", "speaker").agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("chars"))
    people = parts.where(~system).select(F.col("conv").alias("p_conv"), F.col("speaker").alias("perspective")).distinct()
    sums = (
        parts.join(people, F.col("conv").eqNullSafe(F.col("p_conv")))
        .groupBy("conv", "block", "perspective")
        .agg(F.sum("n").alias("n"), F.sum(F.col("chars") + F.col("n") * (F.length(head) + F.length(tail))).alias("chars"))
    )
    before = Window.partitionBy("conv", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.select(
        F.col("conv").alias("b_conv"),
        F.col("block").alias("b_block"),
        "perspective",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("seq_base"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("char_base"),
    )
    rows = said.join(blocks, F.col("conv").eqNullSafe(F.col("b_conv")) & (F.col("block") == F.col("b_block")))
    rows = rows.withColumn("rendered", F.concat(head, "body", tail)).withColumn("size", F.length("rendered"))
    inside = Window.partitionBy("conv", "block", "perspective").orderBy("turn", "speaker", "body")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = (F.col("char_base") + F.sum("size").over(upto)).alias("char_end")
    rows = rows.select("*", (F.col("seq_base") + F.row_number().over(inside) - 1).alias("seq"), end)
    loss = mine & ~system
    return rows.select(
        F.col("conv").alias(key),
        "perspective",
        "seq",
        F.col("turn").alias("turn"),
        "speaker",
        "rendered",
        (F.col("char_end") - F.col("size")).alias("char_start"),
        "char_end",
        (~loss).alias("masked"),
        F.when(loss, F.col("char_end") - F.col("size") + F.length(head)).alias("loss_start"),
        F.when(loss, F.col("char_end") - F.lit(1)).alias("loss_end"),
    )


def op10_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


SQL_OP10 = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(replace(coalesce(text, ''), '<|', '< |'), '|>', '| >') AS body FROM conversations
), people AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'
), lines AS (
  SELECT s.*, p.perspective, s.speaker = p.perspective AS mine,
    CASE WHEN s.speaker = 'system' THEN '<|system|>' || chr(10) WHEN s.speaker = p.perspective THEN '<|assistant|>' || chr(10)
         ELSE '<|user name=' || replace(replace(s.speaker, '<|', '< |'), '|>', '| >') || '|>' || chr(10) END AS head
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), sized AS (
  SELECT *, head || body || '<|end|>' || chr(10) AS rendered FROM lines
), placed AS (
  SELECT *, row_number() OVER w - 1 AS seq,
    sum(length(rendered)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS char_end
  FROM sized WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body)
)
SELECT conv_id, perspective, CAST(seq AS BIGINT) AS seq, turn, speaker, rendered,
  CAST(char_end - length(rendered) AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end, NOT mine AS masked,
  CAST(CASE WHEN mine THEN char_end - length(rendered) + length(head) END AS BIGINT) AS loss_start,
  CAST(CASE WHEN mine THEN char_end - 1 END AS BIGINT) AS loss_end
FROM placed
"""
