"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets: sources in code point order (null last) weigh 1, 2, 3, repeating, and share the total size; a target stops
at `most` times its source's size and the excess is shared again by weight (the level of that filling comes from one
pass over the sources sorted by cap per weight).

Drawing: each source is cut into blocks of about BLOCK_WORDS words by a hash of its documents, and its blocks are
permuted. A target of f whole passes and a rest asks for every block f times and then for blocks in permuted order up
to the rest: so many draws are the source's exact quota. A binary tree over the output shards splits the quotas of
all sources at each node by a multivariate hypergeometric draw. A leaf's quota says how many blocks its shard takes
next from the source's permuted sequence, so shards draw disjoint stretches of it; each shard is shuffled locally.
The last block of a sequence is drawn in part, document by document. The number of shards follows the words drawn.

Sizes are word counts, of whole texts; null and blank texts have size 0 and are never drawn. Repeated rows are
documents of their own; of equal rows each is drawn as often as any. An empty table gives no rows. Other columns pass
through, whatever their names. Every choice is a hash of the rows and `seed`, so reruns agree.

One task sees one row for each source (the targets, and the tree's root), never one for each document or block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, by_key, whole_rows
from .quality import BLANKS

BLOCK_WORDS = 20_000
#: Words of a shard, about: some 12 MB of text.
SHARD_WORDS = 2_000_000
WEIGHTS = 3


def word_count(text: str) -> Column:
    trimmed = F.btrim(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, "[ \\t-\\r]+"))).cast("bigint")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, s, size, d, t, rank): s is the source as a key, (d, t) tells the text, rank is a hash of it."""
    source = F.col("row.source").cast("string")
    key = F.coalesce(F.concat(F.lit("="), source), F.lit(""))
    return whole_rows(docs).select(F.col("row.doc_id").alias("doc_id"), source.alias("source"), key.alias("s"), word_count("text").alias("size"), "d", "t", F.xxhash64("d", "t").alias("rank"))


def targets(rows: DataFrame, most: int = 3) -> DataFrame:
    """(s, source_size, target) of each source; one row a source in every window."""
    total = rows.groupBy("s").agg(F.sum("size").alias("source_size"), F.min("source").alias("source"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = total.withColumn("w", ((F.row_number().over(by_name) - 1) % WEIGHTS + 1).cast("double")).withColumn("cap", (most * F.col("source_size")).cast("double"))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), "s").rowsBetween(Window.unboundedPreceding, -1)
    level = weighed.withColumns({"all_size": F.sum("source_size").over(every).cast("double"), "all_w": F.sum("w").over(every)})
    level = level.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "w_before": F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    full = F.col("cap") / F.col("w") < (F.col("all_size") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before"))
    level = level.withColumn("full", full)
    level = level.withColumns({"full_cap": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every), "full_w": F.sum(F.when(F.col("full"), F.col("w")).otherwise(0.0)).over(every)})
    share = F.when(F.col("full"), F.col("cap")).otherwise((F.col("all_size") - F.col("full_cap")) * F.col("w") / (F.col("all_w") - F.col("full_w")))
    return level.select("s", "source_size", F.least("cap", share).alias("target"))


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(s, quota) -> (s, shard, quota) where the quota is not 0, after one split of every node per level."""
    schema = "s string, lo int, hi int, quota bigint"
    level = quotas.select("s", F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.col("quota").cast("bigint").alias("quota"))

    def split(node: pd.DataFrame) -> pd.DataFrame:
        node = node.sort_values("s", ignore_index=True)
        lo, hi = int(node.lo[0]), int(node.hi[0])
        if hi - lo == 1:
            return node
        mid, counts = (lo + hi) // 2, node.quota.to_numpy(np.int64)
        rng = np.random.default_rng([seed, lo, hi])
        left, wanted, rest = np.zeros(len(counts), np.int64), int(round(counts.sum() * (mid - lo) / (hi - lo))), int(counts.sum())
        for i, n in enumerate(counts.tolist()):  # the marginals of a multivariate hypergeometric draw, one by one
            left[i] = rng.hypergeometric(n, rest - n, wanted) if wanted else 0
            wanted, rest = wanted - int(left[i]), rest - n
        both = pd.concat([node.assign(hi=mid, quota=left), node.assign(lo=mid, quota=counts - left)])
        return both[both.quota > 0]

    for _ in range(max(0, (shards - 1).bit_length())):
        level = level.groupBy("lo", "hi").applyInPandas(split, schema)
    return level.where("quota > 0").select("s", F.col("lo").alias("shard"), "quota")


def permuted(blocks: DataFrame, seed: int) -> DataFrame:
    """(s, block, words) -> with nth (from 1), the block's place in its source's permuted order, and the words before.

    Ranks and sums are added up over 4096 stretches of the order first, so that no task orders all blocks of a source.
    """
    placed = blocks.withColumn("order", F.xxhash64("s", "block", F.lit(seed))).withColumn("part", F.shiftrightunsigned("order", 52).cast("int"))
    earlier = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("s", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("w"))
    parts = parts.select("s", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"), F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w_before"))
    within = Window.partitionBy("s", "part").orderBy("order", "block")
    nth, before = F.row_number().over(within), F.coalesce(F.sum("words").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(parts, ["s", "part"]).select("s", "block", "words", (F.col("n_before") + nth).alias("nth"), (F.col("w_before") + before).alias("before"))


def draws(blocks: DataFrame, goal: DataFrame, scratch: Scratch, shard_words: int, seed: int) -> tuple[DataFrame, int]:
    """(s, block, draws array<struct<pass, shard, room>>) of each block drawn, and the number of shards; room is null
    for a whole block, else the words that a part of it may fill."""
    rest = goal.select("s", "target", F.floor(F.col("target") / F.col("source_size")).cast("bigint").alias("passes"), (F.col("target") % F.col("source_size")).alias("rest"))
    order = scratch.write("mix-order", permuted(blocks, seed).join(rest, "s").withColumn("room", F.col("rest") - F.col("before")))
    quotas = scratch.write("mix-quotas", order.groupBy("s").agg(F.count(F.lit(1)).alias("n_blocks"), F.min("passes").alias("passes"), F.count_if(F.col("room") > 0).alias("last")).withColumn("quota", F.col("passes") * F.col("n_blocks") + F.col("last")))
    shards = max(1, -(-int(goal.agg(F.sum("target")).first()[0] or 0) // shard_words))
    leaves = split_tree(quotas.select("s", "quota"), shards, seed)
    until = Window.partitionBy("s").orderBy("shard")
    stop = F.sum("quota").over(until)
    taken = leaves.withColumn("stop", stop).select("s", "shard", F.explode(F.sequence(F.col("stop") - F.col("quota"), F.col("stop") - 1)).alias("p"))
    sequence = taken.join(quotas.select("s", "n_blocks", F.col("passes").alias("whole")), "s")
    sequence = sequence.select("s", "shard", "whole", (F.floor(F.col("p") / F.col("n_blocks")) + 1).cast("int").alias("pass"), (F.col("p") % F.col("n_blocks") + 1).alias("nth"))
    part = F.when((F.col("pass") > F.col("whole")) & (F.col("room") < F.col("words")), F.col("room"))
    units = sequence.join(order.select("s", "nth", "block", "words", "room"), ["s", "nth"]).select("s", "block", F.struct("pass", "shard", part.alias("room")).alias("draw"))
    return units.groupBy("s", "block").agg(F.array_sort(F.collect_list("draw")).alias("draws")), shards


def taken(rows: DataFrame, scratch: Scratch, shard_words: int = SHARD_WORDS, seed: int = 7, most: int = 3) -> tuple[DataFrame, int]:
    """rows of sized(), written -> with source_size, target, draws array<struct<pass, shard, room>>; and the shards.

    The table of sources is written before it is joined: Spark sends it to every task where it is small enough, and
    else can split the rows of a source that holds most.
    """
    goal = scratch.write("mix-goal", targets(rows, most))
    n = F.greatest(F.ceil(F.col("source_size") / BLOCK_WORDS), F.lit(1))
    dealt = rows.join(goal, "s").withColumn("block", F.pmod("rank", n))
    blocks = scratch.write("mix-blocks", dealt.where("size > 0").groupBy("s", "block").agg(F.sum("size").alias("words")))
    found, shards = draws(blocks, goal, scratch, shard_words, seed)
    drawn = dealt.join(scratch.write("mix-drawn", found), ["s", "block"], "left")
    # only blocks at the end of a sequence are drawn in part; there documents fill the room in the order of their hash
    edge = F.col("size") > 0
    part = F.exists("draws", lambda d: d["room"].isNotNull())
    inside = drawn.where(edge & part)
    order = Window.partitionBy("s", "block").orderBy(F.xxhash64("rank", F.lit(seed + 2)), "rank").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    fits = F.expr("filter(draws, d -> d.room IS NULL OR before + size / 2 <= d.room)")
    rest = drawn.where(~(edge & F.coalesce(part, F.lit(False)))).withColumn("draws", F.when(edge, F.col("draws")))
    return rest.unionByName(inside.withColumn("draws", fits).drop("before")), shards


def mixed(docs: DataFrame, shard_words: int = SHARD_WORDS, seed: int = 7) -> DataFrame:
    """The mix itself: `docs` once per draw, one partition a shard, shuffled within each."""
    scratch = Scratch(docs.sparkSession)
    chosen, shards = taken(scratch.write("mix-sizes", sized(docs)), scratch, shard_words, seed)
    per_row = chosen.where(F.size("draws") > 0).select("d", "t", F.explode("draws").alias("x")).select("d", "t", "x.pass", "x.shard").distinct()
    per_row = scratch.write("mix-draws", per_row.groupBy("d", "t").agg(F.collect_list(F.struct("pass", "shard")).alias("draws")))
    scratch.keep("mix-draws")
    rows = whole_rows(docs).select("row", "d", "t").join(by_key(per_row), ["d", "t"]).select("row", "d", "t", F.explode("draws").alias("x"))
    return rows.repartitionById(shards, F.col("x.shard")).sortWithinPartitions(F.xxhash64("d", "t", "x.pass", F.lit(seed + 3)), "d").select("row.*")


def op10(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards: the shard of each draw, in order."""
    scratch = Scratch(docs.sparkSession)
    out, _ = taken(scratch.write("mix-sizes", sized(docs.select("doc_id", "text", "source"))), scratch)
    scratch.drop("mix-order", "mix-quotas", "mix-blocks")
    n = F.coalesce(F.greatest(F.size("draws"), F.lit(0)), F.lit(0))
    shards = F.array_sort(F.transform(F.coalesce("draws", F.array()), lambda x: x["shard"]))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * n).cast("bigint").alias("taken"), shards.alias("shards"))
