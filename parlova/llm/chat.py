"""Dialogues rendered from every participant's point of view. Spark SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlova.operators.ranking import global_rank
from parlova.runtime import materialize

PART_TURNS = 1024
SYSTEM = "system"
UNKNOWN = "unknown"


def _clean(text: Column) -> Column:
    """Markers inside a text can't be mistaken for the template's."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", part_turns: int = PART_TURNS
) -> DataFrame:
    """One row per conversation, participant and part: the dialogue with that speaker as assistant.

    Columns: ``conv_id, perspective, part, n_turns, rendered, masks, n_trained``. A turn is rendered
    as ``<|start|>head\\ntext<|end|>\\n``; the head is ``assistant`` for the speaker,
    ``user name=…`` for others and ``system`` for instructions, which are no participant.
    ``masks`` lists ``start:end`` in characters of what the speaker says with its end marker, comma
    joined; ``n_trained`` counts these characters. Conversations of more than ``part_turns``
    turns continue in parts, so that no task and no row holds an unbounded one.

    Turns sort by number (null first), speaker and text; repeated rows are separate turns. A null
    or empty speaker is ``unknown``, a null text is empty. Rows with a null conversation
    form one conversation. A conversation with instructions only has no participant and no row.
    """
    rows = turns.select(
        F.col(f"`{conv_col}`").cast("bigint").alias("conv_id"),
        F.col(f"`{turn_col}`").cast("bigint").alias("turn"),
        F.coalesce(F.nullif(F.col(f"`{speaker_col}`").cast("string"), F.lit("")), F.lit(UNKNOWN)).alias("speaker"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )
    ranked = materialize(global_rank(rows, ["conv_id", "turn", "speaker", "text"]).rows)
    first = ranked.groupBy("conv_id").agg(F.min("rank").alias("_first")).withColumnRenamed("conv_id", "_conv")
    placed = (
        ranked.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")))
        .withColumn("index", F.col("rank") - F.col("_first"))
        .withColumn("part", F.floor(F.col("index") / part_turns).cast("bigint"))
    )
    people = (
        ranked.where(F.col("speaker") != SYSTEM)
        .select(F.col("conv_id").alias("_who_conv"), F.col("speaker").alias("perspective"))
        .distinct()
    )
    mine = F.col("speaker") == F.col("perspective")
    head = (
        F.when(mine, F.lit("assistant"))
        .when(F.col("speaker") == SYSTEM, F.lit(SYSTEM))
        .otherwise(F.concat(F.lit("user name="), F.translate(_clean(F.col("speaker")), "\n", " ")))
    )
    opening = F.concat(F.lit("<|start|>"), head, F.lit("\n"))
    said = F.concat(_clean(F.col("text")), F.lit("<|end|>"))
    views = placed.drop("_conv").join(people, F.col("conv_id").eqNullSafe(F.col("_who_conv"))).select(
        "conv_id", "perspective", "part", "index", mine.alias("mine"), opening.alias("opening"), said.alias("said")
    )
    key = ["conv_id", "perspective", "part"]
    length = F.length("opening") + F.length("said") + 1
    before = F.coalesce(
        F.sum(length).over(Window.partitionBy(*key).orderBy("index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    start = before + F.length("opening")
    spans = F.when(F.col("mine"), F.concat_ws(":", start.cast("string"), (start + F.length("said")).cast("string")))
    pieces = views.withColumn("span", spans).withColumn("piece", F.concat("opening", "said", F.lit("\n")))
    packed = pieces.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("index", "piece", "span"))).alias("turns"),
        F.count(F.lit(1)).alias("n_turns"),
        F.sum(F.when(F.col("mine"), F.length("said")).otherwise(0)).cast("bigint").alias("n_trained"),
    )
    return packed.select(
        *key,
        "n_turns",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("rendered"),
        F.array_join(F.transform("turns", lambda t: t["span"]), ",").alias("masks"),
        "n_trained",
    )


def op7_chat(spark, sf_dir: str) -> DataFrame:
    """Every perspective of all ``conversations``."""
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(nullif(role, ''), '{UNKNOWN}') AS speaker, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(nullif(role, ''), '{UNKNOWN}'), text NULLS FIRST) - 1 AS index
  FROM conversations
), p AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> '{SYSTEM}'
), v AS (
  SELECT t.conv_id, perspective, index // {PART_TURNS} AS part, index, speaker = perspective AS mine,
    '<|start|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}'
      ELSE 'user name=' || replace(replace(speaker, '<|', '< |'), chr(10), ' ') END || chr(10) AS opening,
    replace(coalesce(text, ''), '<|', '< |') || '<|end|>' AS said
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, coalesce(sum(length(opening) + length(said) + 1)
    OVER (PARTITION BY conv_id, perspective, part ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(opening) AS start
  FROM v
)
SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, count(*) AS n_turns, string_agg(opening || said || chr(10), '' ORDER BY index) AS rendered,
  coalesce(string_agg(CASE WHEN mine THEN CAST(start AS BIGINT) || ':' || CAST(start + length(said) AS BIGINT) END, ',' ORDER BY index), '') AS masks,
  CAST(sum(CASE WHEN mine THEN length(said) ELSE 0 END) AS BIGINT) AS n_trained
FROM o GROUP BY conv_id, perspective, part"""
