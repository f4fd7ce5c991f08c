"""Provenance: current values, conflicts, quality, the review queue and replay of review logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.evidence import freshness, risk

# Fields that a quality score looks at; statuses of evidence nobody has confirmed.
RELEVANT = ["name", "industry", "country", "state", "city", "cin"]
UNVERIFIED = ["observed", "extracted", "claimed"]


def conflicts(records: DataFrame) -> DataFrame:
    """(company_id, field_name, records): groups with more than one value, all of whose records are tagged."""
    per = records.groupBy("company_id", "field_name").agg(F.min("value_observed").alias("lo"), F.max("value_observed").alias("hi"), F.count(F.lit(1)).alias("records"), F.min("record_id").alias("first_record"))
    return per.where("lo <> hi").drop("lo", "hi")


def tag_conflicts(records: DataFrame, open_conflicts: DataFrame) -> DataFrame:
    """(record_id, conflict_id): every record of a group with more than one value, under the group's open conflict
    (company_id, field_name, conflict_id; the smallest) where there is one, else under its first record."""
    keys = ["company_id", "field_name"]
    earlier = open_conflicts.groupBy(*keys).agg(F.min("conflict_id").alias("earlier"))
    tags = conflicts(records).join(earlier, keys, "left").select(*keys, F.coalesce("earlier", "first_record").alias("conflict_id"))
    return records.select("record_id", *keys).join(tags, keys).select("record_id", "conflict_id")


def current(records: DataFrame) -> DataFrame:
    latest = Window.partitionBy("company_id", "field_name").orderBy(F.desc("last_observed_at"), F.desc("record_id"))
    return records.withColumn("nth", F.row_number().over(latest)).where("nth = 1").drop("nth")


def field_quality(records: DataFrame, as_of: datetime) -> DataFrame:
    f = F.col("field_name")
    tagged = conflicts(records).select("company_id", "field_name", F.lit(True).alias("in_conflict"))
    out = current(records).join(tagged, ["company_id", "field_name"], "left")
    return out.select("company_id", "field_name", "record_id", "value_observed", "status", F.col("confidence").cast("double").alias("confidence"), risk(f).alias("risk"), freshness(f, F.col("last_observed_at"), F.lit(as_of)).alias("freshness"), F.coalesce("in_conflict", F.lit(False)).alias("has_open_conflict"))


def quality_score(quality: DataFrame) -> DataFrame:
    weights = {f: 2.0 if f == "cin" else 1.0 for f in RELEVANT}
    w = F.lit(0.0)
    for f, v in weights.items():
        w = F.when(F.col("field_name") == f, v).otherwise(w)
    part = F.when(F.col("status") == "verified", 1.0).when(F.col("status").isin(UNVERIFIED), 0.5).otherwise(0.0)
    return quality.groupBy("company_id").agg(F.bround(F.sum(w * part) / sum(weights.values()) * 100, 1).alias("score"))


def review_queue(records: DataFrame) -> DataFrame:
    """Each record once with all its reasons, in order: those under review or in conflict first (level 1), then claims of
    high risk that nobody has verified (level 2), each the oldest first."""
    tagged = conflicts(records).select("company_id", "field_name", F.lit(True).alias("c"))
    high = F.col("status").isin(UNVERIFIED) & (risk(F.col("field_name")) == "high")
    reasons = F.array_compact(F.array(F.when(F.col("status") == "under_review", "under_review"), F.when(F.col("c"), "open_conflict"), F.when(high, "unverified_high_risk")))
    out = records.join(tagged, ["company_id", "field_name"], "left").withColumn("reasons", F.array_join(reasons, ","))
    level = F.when(F.col("reasons") == "unverified_high_risk", 2).otherwise(1).alias("level")
    queue = out.where("reasons <> ''").select("record_id", "company_id", "field_name", "status", "reasons", "last_observed_at", level)
    return queue.orderBy("level", "last_observed_at", "record_id")


def unpivot(observations: DataFrame, direct: list[str], extra: list[str]) -> DataFrame:
    """One provenance row for each non-empty field: direct ones by rule, others by hand; none is verified."""
    rows = observations.unpivot("observation_id", [*direct, *extra], "field_name", "value_observed").where("value_observed IS NOT NULL AND value_observed <> ''")
    by_rule = F.col("field_name").isin(direct)
    return rows.withColumns({"extraction_method": F.when(by_rule, "rule_based").otherwise("manual"), "confidence": F.when(by_rule, 0.8).otherwise(0.5), "status": F.when(by_rule, "extracted").otherwise("observed")})
