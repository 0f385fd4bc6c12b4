"""Chat formatting: multi-party perspective rotation.

For every participant of a dialogue the dialogue is rendered once with that
participant as the assistant and all others as named users; system messages
stay system messages.  A run-length mask says which characters are trained on.
Built-in expressions only: one shuffle on ``conv_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _plain(c: Column) -> Column:
    """Keep message text from forging control tokens."""
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def rotate_perspectives(turns: DataFrame) -> DataFrame:
    """One row per (conversation, participant): ``conv_id, speaker, n_turns, n_trained, text, mask_runs``.

    ``mask_runs`` alternates over the rendered text: -n for n masked
    characters, +n for n trained ones (the assistant's message and its end
    mark), 0 runs included only for messages of no length.

    Rows without a conv_id belong to no dialogue and are left out.  A null or
    blank role is the participant ``unknown``; a null text is empty; a null
    turn comes first; ties in turn go by role, then text; a repeated row is a
    repeated message.  A dialogue with system messages only has no
    perspective.  Other columns of ``turns`` are not read.  An empty table
    gives an empty table.
    """
    role = F.coalesce(F.nullif(F.trim(F.regexp_replace("role", r"[\r\n\t]+", " ")), F.lit("")), F.lit("unknown"))
    told = (
        turns.where(F.col("conv_id").isNotNull())
        .select("conv_id", "turn", _plain(role).alias("role"), _plain(F.coalesce("text", F.lit(""))).alias("text"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    )
    people = F.array_distinct(F.filter(F.col("said.role"), lambda r: r != "system"))
    each = told.select("conv_id", "said", F.explode(people).alias("speaker"))

    def head(m: Column) -> Column:
        return F.concat(
            F.lit(OPEN),
            F.when(m["role"] == F.col("speaker"), "assistant").when(m["role"] == "system", "system").otherwise(F.concat(F.lit("user name="), m["role"])),
            F.lit("\n"),
        )

    body = lambda m: F.concat(m["text"], F.lit(CLOSE))
    own = lambda m: m["role"] == F.col("speaker")
    return each.select(
        "conv_id",
        "speaker",
        F.size("said").alias("n_turns"),
        F.size(F.filter("said", own)).alias("n_trained"),
        F.array_join(F.transform("said", lambda m: F.concat(head(m), body(m))), "").alias("text"),
        F.flatten(F.transform("said", lambda m: F.array(-F.length(head(m)), F.when(own(m), 1).otherwise(-1) * F.length(body(m))))).alias("mask_runs"),
    )


def op9_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rotate_perspectives(turns).withColumn("mask_runs", F.array_join(F.col("mask_runs").cast("array<string>"), ","))


OP9_SQL = r"""
WITH m AS (
  SELECT conv_id, turn,
         replace(coalesce(nullif(trim(regexp_replace(role, '[\r\n\t]+', ' ', 'g')), ''), 'unknown'), '<|', '< |') AS role,
         replace(coalesce(text, ''), '<|', '< |') AS body
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM m WHERE role <> 'system'),
r AS (
  SELECT m.conv_id, speaker, turn, role, body, (role = speaker) AS own,
         '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system'
                                ELSE 'user name=' || role END || chr(10) AS head,
         body || '<|im_end|>' || chr(10) AS tail
  FROM m JOIN p ON m.conv_id = p.conv_id)
SELECT conv_id, speaker, CAST(count(*) AS INT) AS n_turns, CAST(count(*) FILTER (own) AS INT) AS n_trained,
       string_agg(head || tail, '' ORDER BY turn NULLS FIRST, role, body) AS text,
       string_agg('-' || length(head) || ',' || CASE WHEN own THEN '' ELSE '-' END || length(tail), ','
                  ORDER BY turn NULLS FIRST, role, body) AS mask_runs
FROM r GROUP BY conv_id, speaker
"""
