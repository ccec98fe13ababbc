"""Multi-party perspective rotation of dialogues, with DataFrame functions only.

For every participant of a conversation the dialogue is rendered once with that speaker as the
assistant and all others as named users; the speaker's own messages are the ones to learn from.
The result has one row per perspective and turn: a dialogue of any length is never gathered.
Places in the rendered dialogue come from two prefix sums, over blocks of turns and within one.

Defined cases: a null or empty role is the participant ``unknown``; a system turn keeps its role
in every perspective and is no participant, so a conversation of system turns only has no
perspective; a null text is empty; turns are ordered by turn (null first), role and text, so equal
rows follow each other; rows with a null conv_id form one conversation; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns whose numbers share this quotient form a block of the prefix sums.
BLOCK_TURNS = 256
CONTEXT_ROLE = "system"


def rendered(role: Column, name: Column, text: Column) -> Column:
    head = F.when(name.isNull(), F.concat(F.lit("<|"), role, F.lit("|>\n"))).otherwise(F.concat(F.lit("<|"), role, F.lit(" name="), name, F.lit("|>\n")))
    return F.concat(head, text, F.lit("<|end|>\n"))


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, speaker, position, turn, role, name, segment, start, stop, mask_start, mask_stop, learn.

    ``segment`` is the rendered turn, at characters start..stop of that perspective's dialogue;
    mask_start..mask_stop is the text with its end mark, ``learn`` 1 for the speaker's own turns.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit("unknown")).alias("author"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("_block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-1)))
    speakers = turns.where(F.col("author") != CONTEXT_ROLE).select(F.col("conv_id").alias("_conv"), F.col("author").alias("speaker")).distinct()
    seen = turns.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    role = F.when(F.col("author") == CONTEXT_ROLE, CONTEXT_ROLE).when(F.col("author") == F.col("speaker"), "assistant").otherwise("user")
    seen = seen.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("author")))
    seen = seen.withColumn("segment", rendered(F.col("role"), F.col("name"), F.col("text"))).withColumn("_len", F.length("segment").cast("long"))
    keys = ["conv_id", "speaker"]
    blocks = seen.groupBy(*keys, "_block").agg(F.sum("_len").alias("_chars"), F.count("*").alias("_turns"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("_speaker"), F.col("_block").alias("_b"), F.coalesce(F.sum("_chars").over(earlier), F.lit(0)).alias("_chars0"), F.coalesce(F.sum("_turns").over(earlier), F.lit(0)).alias("_turns0"))
    here = Window.partitionBy(*keys, "_block").orderBy("turn", "author", "text")
    placed = seen.join(blocks, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("speaker") == F.col("_speaker")) & (F.col("_block") == F.col("_b")))
    placed = placed.withColumn("position", (F.col("_turns0") + F.row_number().over(here) - 1).cast("long")).withColumn("stop", F.col("_chars0") + F.sum("_len").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    tail = F.length("text") + F.length(F.lit("<|end|>\n"))
    return placed.select(
        "conv_id", "speaker", "position", "turn", "role", "name", "segment",
        (F.col("stop") - F.col("_len")).alias("start"), "stop",
        (F.col("stop") - tail).alias("mask_start"), F.col("stop").alias("mask_stop"),
        F.when(F.col("role") == "assistant", 1).otherwise(0).alias("learn"),
    )


#: The same in SQL, for DuckDB.
ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS author, coalesce(text, '') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id AS c, author AS speaker FROM t WHERE author <> '{CONTEXT_ROLE}'),
r AS (SELECT conv_id, speaker, turn, author, text,
  CASE WHEN author = '{CONTEXT_ROLE}' THEN '{CONTEXT_ROLE}' WHEN author = speaker THEN 'assistant' ELSE 'user' END AS role
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.c),
n AS (SELECT *, CASE WHEN role = 'user' THEN author END AS name FROM r),
g AS (SELECT *, CASE WHEN name IS NULL THEN '<|' || role || '|>' || chr(10) ELSE '<|' || role || ' name=' || name || '|>' || chr(10) END || text || '<|end|>' || chr(10) AS segment FROM n),
p AS (SELECT *, CAST(row_number() OVER w - 1 AS BIGINT) AS position,
  CAST(sum(length(segment)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, author, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
  FROM g WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, author, text))
SELECT conv_id, speaker, position, turn, role, name, segment, stop - length(segment) AS start, stop,
  stop - length(text) - 8 AS mask_start, stop AS mask_stop, CAST(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS INTEGER) AS learn
FROM p
"""
