"""Preference formatting: a chosen and a rejected conversation share one rendered prompt.

A conversation is its turns in order (ties by role, then text; repeated rows are repeated turns). The longest common
prefix of turns is rendered once as the prompt; what follows is rendered as two completions, with the character spans
that a loss should see: the text and end mark of each assistant turn. Null role renders as `unknown`, null text as
empty; rows without a conversation are left out. Equal conversations have empty completions. Very long turns are
rendered whole; a conversation is one row, so its turns must fit into one. An empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"


def head(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<turn, role, text>>)"""
    clean = turns.where(F.col("conv_id").isNotNull()).select("conv_id", F.struct(F.coalesce("turn", F.lit(-1)).alias("turn"), F.coalesce(F.col("role"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("t"))
    return clean.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), t["text"], F.lit(END))), "")


def spans(turns: Column) -> Column:
    """`start-stop` pairs, joined by commas."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        begin = a["at"] + F.length(head(t))
        stop = begin + F.length(t["text"]) + len(END)
        mark = F.concat(begin.cast("string"), F.lit("-"), stop.cast("string"))
        return F.struct(stop.cast("bigint").alias("at"), F.when(t["role"] == "assistant", F.concat(a["out"], F.array(mark))).otherwise(a["out"]).alias("out"))

    return F.array_join(F.aggregate(turns, start, step, lambda a: a["out"]), ",")


def format_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (pair_id, chosen, rejected: conversation ids) -> one row for each pair whose conversations exist."""
    c = conversations(turns)
    both = pairs.join(c.toDF("chosen", "a"), "chosen").join(c.toDF("rejected", "b"), "rejected")
    key = lambda x: F.struct(x["role"], x["text"])
    differ = F.array_position(F.zip_with("a", "b", lambda x, y: x.isNotNull() & y.isNotNull() & key(x).eqNullSafe(key(y))), False)
    both = both.withColumn("n", F.when(differ == 0, F.size("a")).otherwise(differ - 1).cast("int"))
    rest = [F.slice(x, F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0))) for x in ("a", "b")]
    both = both.withColumns({"p": F.slice("a", 1, "n"), "ca": rest[0], "cb": rest[1]})
    return both.select(
        "pair_id", "chosen", "rejected", F.col("n").cast("bigint").alias("n_prompt_turns"), rendered(F.col("p")).alias("prompt"),
        rendered(F.col("ca")).alias("chosen_text"), spans(F.col("ca")).alias("chosen_spans"), rendered(F.col("cb")).alias("rejected_text"), spans(F.col("cb")).alias("rejected_spans"),
    )


def op4(turns: DataFrame) -> DataFrame:
    """Conversations 2n (chosen) and 2n + 1 (rejected) are pair n."""
    ids = turns.where(F.col("conv_id").isNotNull()).select("conv_id").distinct()
    pairs = ids.where(F.pmod("conv_id", F.lit(2)) == 0).select(F.expr("conv_id div 2").cast("bigint").alias("pair_id"), F.col("conv_id").alias("chosen"), (F.col("conv_id") + 1).alias("rejected"))
    return format_pairs(turns, pairs)


ORACLE = """
WITH turns AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), nth AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, role, text,
         '<|' || role || '|>' || chr(10) AS head FROM turns
), pairs AS (
  SELECT DISTINCT a.conv_id // 2 AS pair_id, a.conv_id AS chosen, b.conv_id AS rejected
  FROM turns a JOIN turns b ON a.conv_id % 2 = 0 AND b.conv_id = a.conv_id + 1
), sizes AS (SELECT conv_id, max(n) AS n FROM nth GROUP BY conv_id
), differ AS (
  SELECT p.pair_id, min(x.n) AS n FROM pairs p JOIN nth x ON x.conv_id = p.chosen
  LEFT JOIN nth y ON y.conv_id = p.rejected AND y.n = x.n
  WHERE y.n IS NULL OR x.role <> y.role OR x.text <> y.text GROUP BY p.pair_id
), cut AS (
  SELECT p.*, coalesce(d.n - 1, s.n) AS n FROM pairs p LEFT JOIN differ d USING (pair_id) JOIN sizes s ON s.conv_id = p.chosen
), parts AS (
  SELECT c.pair_id, c.chosen, c.rejected, c.n AS n_prompt, t.conv_id = c.rejected AS other, t.n > c.n AS after, t.n, t.role,
         t.head || t.text || '<|end|>' || chr(10) AS body,
         coalesce(sum(length(t.head) + length(t.text) + 8) OVER (PARTITION BY c.pair_id, t.conv_id, t.n > c.n ORDER BY t.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base,
         length(t.head) AS h, length(t.text) AS l
  FROM cut c JOIN nth t ON t.conv_id IN (c.chosen, c.rejected)
)
SELECT pair_id, chosen, rejected, n_prompt AS n_prompt_turns,
  coalesce(string_agg(body, '' ORDER BY n) FILTER (NOT other AND NOT after), '') AS prompt,
  coalesce(string_agg(body, '' ORDER BY n) FILTER (NOT other AND after), '') AS chosen_text,
  coalesce(string_agg(CAST(base + h AS BIGINT) || '-' || CAST(base + h + l + 8 AS BIGINT), ',' ORDER BY n) FILTER (NOT other AND after AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(body, '' ORDER BY n) FILTER (other AND after), '') AS rejected_text,
  coalesce(string_agg(CAST(base + h AS BIGINT) || '-' || CAST(base + h + l + 8 AS BIGINT), ',' ORDER BY n) FILTER (other AND after AND role = 'assistant'), '') AS rejected_spans
FROM parts GROUP BY pair_id, chosen, rejected, n_prompt
"""
