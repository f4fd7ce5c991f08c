"""What a search found, kept as it was: an event for each search and a row for each candidate returned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matching import TRUST, ranked

WHOLE = {"ignoreNullFields": "false"}


def events(requirements: DataFrame, criteria: DataFrame, summary: DataFrame) -> DataFrame:
    """One event a search, its id that of the requirement, with the requirement as it was then."""
    one = F.struct("specification", "operator", "low", "high", "text_value")
    asked = requirements.join(criteria, "requirement_id", "left").groupBy("requirement_id", "category_id", "country", "state", "city").agg(F.array_sort(F.collect_list(F.when(F.col("specification").isNotNull(), one))).alias("criteria"))
    snapshot = F.to_json(F.struct("category_id", "country", "state", "city", "criteria"), WHOLE)
    return asked.select("requirement_id", snapshot.alias("snapshot")).join(summary, "requirement_id").withColumnRenamed("requirement_id", "search_id")


def results(pairs: DataFrame) -> DataFrame:
    """One row for each candidate that a search returned, with its parts of the score."""
    out = ranked(pairs, "location_possible", "certificate_possible")
    snapshot = F.struct(
        F.struct((F.col("certificate_possible") > 0).alias("requested"), F.col("certificate_points").alias("points")).alias("certification"),
        F.struct((F.col("location_possible") > 0).alias("requested"), F.col("location_points").alias("points")).alias("location"),
        F.struct(F.col("trust_points").alias("earned"), F.lit(TRUST).alias("possible")).alias("trust"),
    )
    return out.select(F.col("requirement_id").alias("search_id"), "offering_id", "rank", "score", F.to_json(snapshot, WHOLE).alias("snapshot"))


def as_searches(events: DataFrame) -> DataFrame:
    """Events as gaps.category_gaps reads them."""
    return events.select("search_id", F.col("search_id").alias("requirement_id"), "considered", "excluded", F.col("more_may_exist").alias("ceiling_hit"), F.get_json_object("snapshot", "$.category_id").alias("snapshot_category"))
