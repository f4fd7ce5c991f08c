"""Incremental ingest with an outcome for each item, and its roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["source", "content_hash"]


def outcomes(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """batch (item_id, source, external_id, content_hash, empty) -> with `outcome`; items in order of item_id.

    Known: same source, hash and external id, or, without an external id, same source and hash. Later items of a
    batch see earlier ones. Without an external id, several stored rows are ambiguous and the item fails.

    No row waits for the rows before it: a key's rows are summed up first (rows stored, the first item of each external
    id, the first two ids created, the first item without an id), which a hash that many rows hold combines on every
    task; then each item is compared with its key's sums.
    """
    exact = existing.where("external_id IS NOT NULL").select(*KEYS, "external_id").distinct()
    stored = existing.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("stored"))
    fine = batch.where("NOT empty")
    created = fine.where("external_id IS NOT NULL").groupBy(*KEYS, "external_id").agg(F.min("item_id").alias("first_item")).join(exact, [*KEYS, "external_id"], "left_anti")
    one = created.groupBy(*KEYS).agg(F.min("first_item").alias("one"))
    two = created.join(one, KEYS).where("first_item > one").groupBy(*KEYS).agg(F.min("first_item").alias("two"))
    bare = fine.where("external_id IS NULL").groupBy(*KEYS).agg(F.min("item_id").alias("bare"))
    sums = bare.join(stored, KEYS, "left").join(one, KEYS, "left").join(two, KEYS, "left")  # read by items without an id only
    later = lambda c: F.coalesce((F.col("item_id") > F.col(c)).cast("int"), F.lit(0))
    # the first item without an id is stored only where nothing of its hash is yet
    own = F.when(F.col("stored").isNull() & F.coalesce(F.col("bare") < F.col("one"), F.lit(True)), later("bare")).otherwise(0)
    held = F.coalesce("stored", F.lit(0)) + later("one") + later("two") + own
    unnamed = F.when(F.col("empty"), "failed").when(held > 1, "failed").when(held == 1, "skipped_duplicate").otherwise("created")
    named = F.when(F.col("empty"), "failed").when(F.col("item_id") == F.col("first_item"), "created").otherwise("skipped_duplicate")
    columns = ["item_id", "source", "external_id", "content_hash"]
    with_id = batch.where("external_id IS NOT NULL").join(created, [*KEYS, "external_id"], "left").select(*columns, named.alias("outcome"))
    return with_id.union(batch.where("external_id IS NULL").join(sums, KEYS, "left").select(*columns, unnamed.alias("outcome")))


def job_rollup(events: DataFrame, by: str) -> DataFrame:
    counts = events.groupBy(by).agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in ("created", "skipped_duplicate", "failed")])
    bad = (F.col("created") == 0) & (F.col("skipped_duplicate") == 0) & (F.col("failed") > 0)
    return counts.withColumn("status", F.when(bad, "failed").otherwise("succeeded"))
