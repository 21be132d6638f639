"""Chat formatting by rotating the perspective over the participants of a dialogue.

Every participant of a conversation is the assistant once: their turns become
those of the assistant, all others' those of named users, and system turns stay.
A turn is rendered as

    <|im_start|>assistant\\nTEXT<|im_end|>\\n   or   <|im_start|>user name=NAME\\nTEXT<|im_end|>\\n

and the mask covers TEXT<|im_end|> of the assistant's turns, the characters that a
loss is taken over. Markup inside a text or a name is escaped by a backslash after
its "<", so that no turn can end itself or begin another one.

The plan is declarative and has one shuffle, by conversation: the turns of a
conversation lie in one partition for the participants, the running lengths and
the rendering alike, and windows may spill where a conversation is long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"


def _escaped(text: Column) -> Column:
    for mark in (START, END):
        text = F.replace(text, F.lit(mark), F.lit("<\\" + mark[1:]))
    return text


def rotate(turns: DataFrame, system: str = SYSTEM) -> DataFrame:
    """(conv_id, perspective, n_turns, n_trained, text, mask) of every conversation and participant.

    mask is an ascending array of (start, end) in characters of text. A speaker is
    what `role` holds, without the white space around it; white space inside a
    name becomes "_". Turns without conv_id or with a null or blank role are left
    out; a null text is an empty one; turns are in order of `turn` (null first),
    ties by role and text. Rows that agree in conv_id, turn, role and text are one
    turn. A conversation with none but system turns gives no row, an empty table
    neither. A very long text is rendered once for every participant; a
    conversation lies in one task, which may spill. Columns other than conv_id,
    turn, role and text are not read.
    """
    role = F.regexp_replace(F.regexp_replace("role", "^[ \\t\\n\\r]+|[ \\t\\n\\r]+$", ""), "[ \\t\\n\\r]+", "_")
    own = turns.select("conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null and role is not null and role != ''")
    talk = Window.partitionBy("conv_id")
    same = Window.partitionBy("conv_id", "turn", "role", "text").orderBy(F.lit(0))
    placed = own.repartition(F.col("conv_id")).withColumn("copy", F.row_number().over(same)).where("copy = 1")
    speakers = F.array_sort(F.collect_set(F.when(F.col("role") != system, F.col("role"))).over(talk))
    each = placed.withColumn("speakers", speakers).withColumn("perspective", F.explode("speakers")).drop("copy", "speakers")
    trained = F.col("role") == F.col("perspective")
    head = F.when(trained, F.lit(f"{START}assistant\n")).when(F.col("role") == system, F.lit(f"{START}system\n")).otherwise(F.concat(F.lit(f"{START}user name="), _escaped(F.col("role")), F.lit("\n")))
    shown = each.select("conv_id", "perspective", "turn", "role", "text", trained.alias("trained"), F.length(head).alias("h"), F.concat(head, _escaped(F.col("text")), F.lit(f"{END}\n")).alias("shown"))
    line = Window.partitionBy("conv_id", "perspective").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    until = F.sum(F.length("shown").cast("long")).over(line.rowsBetween(Window.unboundedPreceding, 0))
    spans = shown.withColumns({"at": F.row_number().over(line), "until": until}).withColumn("mask", F.when(F.col("trained"), F.struct((F.col("until") - F.length("shown") + F.col("h")).alias("start"), (F.col("until") - 1).alias("end"))))
    parts = F.array_sort(F.collect_list(F.struct("at", "shown")))
    return spans.groupBy("conv_id", "perspective").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.count("mask").alias("n_trained"),
        F.array_join(F.transform(parts, lambda x: x["shown"]), "").alias("text"),
        F.array_sort(F.collect_list("mask")).alias("mask"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masks are given as text, start:end with commas between them, which every engine can compare."""
    found = rotate(table(spark, sf_dir, "conversations"))
    return found.withColumn("mask", F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"], m["end"])), ","))


def sql(source: str = "conversations", system: str = SYSTEM) -> str:
    escaped = lambda c: f"replace(replace({c}, '{START}', '<\\{START[1:]}'), '{END}', '<\\{END[1:]}')"
    return f"""
WITH named AS (
  SELECT DISTINCT conv_id, turn, coalesce(text, '') AS text,
    regexp_replace(regexp_replace(role, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g'), '[ \\t\\n\\r]+', '_', 'g') AS role
  FROM {source} WHERE conv_id IS NOT NULL AND role IS NOT NULL
), own AS (SELECT * FROM named WHERE role <> ''
), speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM own WHERE role <> '{system}'
), headed AS (
  SELECT o.conv_id, s.perspective, o.turn, o.role, o.text, o.role = s.perspective AS trained,
    CASE WHEN o.role = s.perspective THEN '{START}assistant' WHEN o.role = '{system}' THEN '{START}system' ELSE '{START}user name=' || {escaped("o.role")} END || chr(10) AS head
  FROM own o JOIN speakers s ON o.conv_id = s.conv_id
), shown AS (SELECT *, head || {escaped("text")} || '{END}' || chr(10) AS shown FROM headed
), placed AS (
  SELECT *, row_number() OVER w AS place, (sum(length(shown)) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS until FROM shown
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, perspective, count(*) AS n_turns, count(*) FILTER (WHERE trained) AS n_trained, string_agg(shown, '' ORDER BY place) AS text,
  coalesce(string_agg((until - length(shown) + length(head))::VARCHAR || ':' || (until - 1)::VARCHAR, ',' ORDER BY place) FILTER (WHERE trained), '') AS mask
FROM placed GROUP BY conv_id, perspective
"""
