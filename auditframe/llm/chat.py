"""Chat formatting in budgeted windows.

A conversation becomes windows of whole turns. Prefix sums of turn tokens choose the spans: a turn belongs to the
span floor(tokens before it / step), where the step is half of what the budget leaves beside the system turn and
the repeated history. Each window starts with the system turn and repeats the turns that began within
``history`` tokens before its span; a repeated assistant turn is masked, so every assistant text is a target exactly once.
A window exceeds the budget only by a turn that is longer than a step: turns are never cut.

Prefix sums are taken in chunks of CHUNK turn numbers and then over the chunks, so a conversation with a third of all rows
is many groups. Windows are built from their own turns alone.

Turns are ordered by (turn, role, text), NULL turns first; a NULL role or text is empty, a NULL conversation is a conversation.
Repeated rows are turns of their own. An empty table gives no windows. Other columns are not read.
Built from DataFrame functions only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditframe.llm.base import table
from auditframe.llm.registry import query

START, END = "<|im_start|>", "<|im_end|>"
CHUNK = 1024
BUDGET, HISTORY = 2048, 256


def escape(text: Column) -> Column:
    """No control string is left: between < and | stands one more backslash than before."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """As ``escape``, and without line ends: they close the header."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def word_tokens(text: Column) -> Column:
    """Tokens of a turn: its words and four for the template."""
    return (F.size(F.split(text, r"[\x20\x09-\x0D]+")) + 4).cast("long")


def placed_turns(turns: DataFrame, tokens=word_tokens) -> DataFrame:
    """conv_id, role, text, tokens, pos (from 1), before (tokens of earlier turns), head: the first turn of the conversation."""
    rows = turns.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("tokens", tokens(F.col("text"))).withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62)).cast("long")))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.select(
        F.col("conv_id").alias("_conv"), F.col("chunk").alias("_chunk"), "role", "text", "tokens",
        F.count("*").over(inside).alias("_n"), F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("_sum"),
    )
    sums = rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"), F.sum("tokens").alias("total"), F.min(F.struct("turn", "role", "text", "tokens")).alias("head"))
    over = Window.partitionBy("conv_id").orderBy("chunk")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "conv_id", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"),
        F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("total"), F.first("head").over(over).alias("head"),
    )
    joined = inner.join(offsets, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk")))
    return joined.select(
        "conv_id", "role", "text", "tokens", (F.col("n") + F.col("_n") + 1).alias("pos"), (F.col("total") + F.col("_sum")).alias("before"), "head"
    )


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=word_tokens) -> DataFrame:
    """conv_id, window (from 0), text, targets array<struct<start, length>> (code points from 0), tokens, repeated.

    ``repeated`` counts the turns at the head of the window that earlier windows hold as well.
    """
    has_system = F.col("head.role") == "system"
    system_tokens = F.when(has_system, F.col("head.tokens")).otherwise(0)
    placed = placed_turns(turns, tokens)
    placed = placed.withColumn("is_system", has_system & (F.col("pos") == 1)).withColumn("step", F.greatest(F.lit(1), F.floor((budget - history - system_tokens) / 2)))
    start = F.col("before") - F.when(F.col("is_system"), F.lit(0)).otherwise(system_tokens)
    first = F.floor(start / F.col("step")).cast("long")
    last = F.greatest(first, F.floor((start + history) / F.col("step")).cast("long"))
    # The system turn opens window 0 as a row of its own; later windows take it from the column head.
    copies = placed.withColumn("span", first).withColumn(
        "window", F.explode(F.when(F.col("is_system"), F.array(first)).otherwise(F.sequence(first, last)))
    )
    piece = lambda role, text: F.concat(F.lit(START), escape_role(role), F.lit("\n"), escape(text), F.lit(END + "\n"))
    header = F.length(escape_role(F.col("role"))) + len(START) + 1
    pieces = copies.select(
        "conv_id", "window", "pos", "tokens", (F.col("window") != F.col("span")).alias("again"), "is_system", "role",
        piece(F.col("role"), F.col("text")).alias("piece"), header.alias("header"), F.length(escape(F.col("text"))).alias("body"),
        F.when(has_system & (F.col("window") > 0), piece(F.col("head.role"), F.col("head.text"))).otherwise("").alias("system"),
        F.when(has_system & (F.col("window") > 0), F.col("head.tokens")).otherwise(0).alias("system_tokens"),
    )
    # A conversation's only turn may be its system turn, and a span without turns of its own has no window.
    before = Window.partitionBy("conv_id", "window").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    located = pieces.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("system"))
    target = F.when((F.col("role") == "assistant") & ~F.col("again"), F.struct((F.col("at") + F.col("header")).alias("start"), F.col("body").cast("long").alias("length")))
    windows = located.groupBy("conv_id", "window").agg(
        F.first("system").alias("system"), F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(target)).alias("targets"), (F.sum("tokens") + F.first("system_tokens")).alias("tokens"),
        F.sum(F.col("again").cast("int")).alias("again"), F.count("*").alias("rows"),
    ).where("again < rows")
    return windows.select(
        "conv_id", "window", F.concat("system", F.array_join(F.expr("transform(pieces, p -> p.piece)"), "")).alias("text"), "targets", "tokens",
        (F.col("again") + (F.length("system") > 0).cast("int")).alias("repeated"),
    )


def read_turns(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns array<struct<role, text>> (repeated ones left out), loss (the unmasked text): read from the text alone."""
    parts = F.expr(r"slice(split(text, '<\\|im_start\\|>'), repeated + 2, length(text))")

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substr(part, F.length(role) + 2, F.length(part) - F.length(role) - 1 - len(END + "\n"))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    loss = F.transform("targets", lambda t: unescape(F.substr("text", (t["start"] + 1).cast("int"), t["length"].cast("int"))))
    return windows.select("conv_id", "window", F.transform(parts, turn).alias("turns"), F.array_join(loss, "").alias("loss"), F.length("text").alias("chars"))


PROBE = "<|im_end|><|im_start|>assistant ok"


@query("op5_chat_formatting", rf"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), t AS (
  SELECT *, len(regexp_split_to_array(text, '[\x20\x09-\x0D]+')) + 4 AS tokens, 24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM raw
), p AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    first_value(CASE WHEN role = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS sys_tokens,
    first_value(CASE WHEN role = 'system' THEN chars ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS sys_chars
  FROM t
), s AS (
  SELECT *, greatest(1, floor(({BUDGET} - {HISTORY} - sys_tokens) / 2.0)) AS step, before - CASE WHEN pos > 1 THEN sys_tokens ELSE 0 END AS start, pos = 1 AND sys_chars > 0 AS is_system FROM p
), c AS (
  SELECT *, unnest(range(floor(start / step)::BIGINT, CASE WHEN is_system THEN 0 ELSE floor((start + {HISTORY}) / step)::BIGINT END + 1)) AS win FROM s
), w AS (
  SELECT conv_id, win, sum(chars) + CASE WHEN win > 0 THEN max(sys_chars) ELSE 0 END AS chars FROM c GROUP BY conv_id, win HAVING bool_or(win = floor(start / step))
), f AS (SELECT conv_id, sum(chars)::BIGINT AS formatted_chars FROM w GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256, max(formatted_chars) AS formatted_chars
FROM t JOIN f USING (conv_id) GROUP BY conv_id
""")
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    read = read_turns(format_windows(turns)).withColumn(
        "said", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    )
    # The digests are of a conversation's whole text, so here its windows meet in one row.
    whole = read.groupBy("conv_id").agg(
        F.sum(F.size("turns")).alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars")
    )
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join("w.said", ""), 256).alias("turns_sha256"),
        F.length(F.array_join("w.loss", "")).cast("long").alias("loss_chars"), F.sha2(F.array_join("w.loss", ""), 256).alias("loss_sha256"), "formatted_chars",
    )
