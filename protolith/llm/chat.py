"""Multi-party chat formatting by perspective rotation. DataFrame functions only.

Each participant of a dialogue takes the assistant's place once: the turns of that
speaker are rendered as the assistant's and carry the loss mask, all others as named
users. A dialogue is laid out in parts of at most ``TURNS`` turns, whose
places in the whole rendering are prefix sums, so a dialogue with any number of
turns never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

TURNS = 256
#: Code points of a text by which turns with equal dialogue, number and role are dealt to blocks.
TIES = 128
# The markers of the layout.
START, END = "<|im_start|>", "<|im_end|>"


def _header(role: Column, assistant: Column) -> Column:
    return F.when(assistant, F.lit(f"{START}assistant\n")).otherwise(F.concat(F.lit(f"{START}user name="), role, F.lit("\n")))


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", size: int = TURNS) -> DataFrame:
    """Every dialogue from every participant's perspective.

    Returns a row per ``conv_id``, ``speaker`` and ``part`` (0, 1, ... of ``size`` turns each):
    ``text``; ``n_turns``; ``char_start``, the code points of the parts before it; and ``mask``, the
    spans ``start:end`` of this part's text that the speaker wrote, end marker included,
    comma-joined, in code points, end exclusive.

    Turns run by ``turn`` (null first), ties by role and text. Rows that agree in all
    four columns are one turn. A null role is the participant ``unknown``, a null text is empty;
    null dialogue ids are one dialogue. Markers inside a text lose their bars. Other
    columns are not read; an empty table gives an empty result.
    """
    clean = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"<\|(im_start|im_end)\|>", "<$1>")
    name = F.regexp_replace(F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")), r"[\n\r<>|]", " ")
    order = ["turn", "role", "text"]
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), name.alias("role"), clean.alias("text")).distinct()
    # Equal range keys share a block, so the start of a text splits ties as the whole text orders them.
    dealt = written(rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, TIES)).withColumn("block", F.spark_partition_id()), "turns")
    inside = Window.partitionBy("conv", "block").orderBy(*order)
    sums = dealt.groupBy("conv", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.select(F.col("conv").alias("c"), F.col("block").alias("b"), before.alias("base"))
    ranked = dealt.withColumn("k", F.row_number().over(inside)).join(base, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    turn = F.struct((F.col("base") + F.col("k") - 1).alias("at"), "role", "text")
    parts = ranked.groupBy("conv", F.floor((F.col("base") + F.col("k") - 1) / size).cast("int").alias("part")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    who = dealt.select(F.col("conv").alias("c"), F.col("role").alias("speaker")).distinct()
    seen = parts.join(who, F.col("conv").eqNullSafe(F.col("c")))

    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            F.length(_header(t["role"], t["role"] == F.col("speaker"))).alias("head"),
            F.concat(_header(t["role"], t["role"] == F.col("speaker")), t["text"], F.lit(f"{END}\n")).alias("shown"),
            (t["role"] == F.col("speaker")).alias("own"),
        ),
    )
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p["shown"])
        span = F.concat_ws(":", acc["at"] + p["head"], end - 1)
        return F.struct(end.alias("at"), F.when(p["own"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    laid = seen.withColumn("pieces", pieces).select(
        F.col("conv").alias("conv_id"),
        "speaker",
        "part",
        F.array_join(F.transform("pieces", lambda p: p["shown"]), "").alias("text"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.aggregate("pieces", state, step, lambda acc: acc["spans"]), ",").alias("mask"),
    )
    ahead = Window.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return laid.withColumn("char_start", F.coalesce(F.sum(F.length("text").cast("bigint")).over(ahead), F.lit(0)))


#: The same for DuckDB.
ORACLE = r"""
WITH rows_ AS (
  SELECT DISTINCT conv_id, turn,
         regexp_replace(coalesce(role, 'unknown'), '[\n\r<>|]', ' ', 'g') AS role,
         regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '<\1>', 'g') AS text
  FROM conversations),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM rows_),
who AS (SELECT DISTINCT conv_id, role AS speaker FROM rows_),
pieces AS (
  SELECT r.conv_id, w.speaker, CAST(floor(pos / 256.0) AS INTEGER) AS part, pos, r.role = w.speaker AS own,
         CASE WHEN r.role = w.speaker THEN '<|im_start|>assistant' || chr(10)
              ELSE '<|im_start|>user name=' || r.role || chr(10) END AS head, r.text
  FROM ranked r JOIN who w ON r.conv_id IS NOT DISTINCT FROM w.conv_id),
laid AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS shown FROM pieces),
placed AS (
  SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY conv_id, speaker, part ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM laid),
parts AS (
  SELECT conv_id, speaker, part, string_agg(shown, '' ORDER BY pos) AS text, count(*) AS n_turns,
         coalesce(string_agg(CAST(CAST(a + length(head) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(a + length(shown) - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE own), '') AS mask
  FROM placed GROUP BY conv_id, speaker, part)
SELECT conv_id, speaker, part, text, n_turns, mask,
       CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id, speaker ORDER BY part
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start
FROM parts
"""
