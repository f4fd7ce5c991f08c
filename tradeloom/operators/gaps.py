"""What buyers asked for that the data could not answer, by category and by specification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNALS = "certification STRUCT<requested: BOOLEAN, points: DOUBLE>, location STRUCT<requested: BOOLEAN>, trust STRUCT<earned: DOUBLE, possible: DOUBLE>"


def category_gaps(events: DataFrame, requirements: DataFrame, candidates: DataFrame) -> DataFrame:
    """Two small aggregates joined by category, so that a search's candidates do not multiply its counts."""
    known = requirements.select("requirement_id", "category_id")
    category = F.when(F.col("requirement_id").isNull(), F.col("snapshot_category")).otherwise(F.col("category_id"))
    searches = events.join(known, "requirement_id", "left").withColumn("category", category).where("category IS NOT NULL")
    returned = F.col("considered") - F.col("excluded")
    per = searches.groupBy("category").agg(
        F.count(F.lit(1)).alias("search_count"), F.count_if(F.col("considered") == 0).alias("zero_offering_count"), F.count_if((F.col("considered") > 0) & (returned == 0)).alias("fully_excluded_count"),
        F.avg("considered").alias("avg_considered"), F.avg("excluded").alias("avg_excluded"), F.avg(returned).alias("avg_returned"), F.avg(F.col("ceiling_hit").cast("double")).alias("ceiling_hit_rate"),
    )
    s = candidates.join(searches.select("search_id", "category"), "search_id").withColumn("s", F.from_json("snapshot", SIGNALS))
    wanted = F.col("s.certification.requested")
    signals = s.groupBy("category").agg(
        F.count_if(wanted).alias("certification_requested"), F.count_if(wanted & (F.col("s.certification.points") == 0)).alias("certification_gap"),
        F.count_if("s.location.requested").alias("location_requested"), F.avg("s.trust.earned").alias("avg_trust_earned"), F.avg("s.trust.possible").alias("avg_trust_possible"),
    )
    out = per.join(signals, "category", "left")
    zero = ("certification_requested", "certification_gap", "location_requested")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero}).withColumn("certification_gap_rate", F.try_divide(F.col("certification_gap").cast("double"), F.col("certification_requested")))


def specification_gaps(criteria: DataFrame, requirements: DataFrame, offerings: DataFrame, products: DataFrame, attributes: DataFrame) -> DataFrame:
    """For each (category, specification) asked for: uses, live offerings, and those whose product has the value."""
    used = criteria.join(requirements.where("category_id IS NOT NULL").select("requirement_id", "category_id"), "requirement_id").groupBy("category_id", "specification").agg(F.count(F.lit(1)).alias("times_used"))
    live = offerings.where("status = 'active'").select("product_id").join(products.where("status = 'published'").select("product_id", "category_id"), "product_id")
    per_product = live.groupBy("category_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
    total = per_product.groupBy("category_id").agg(F.sum("n").alias("live_offerings"))
    having = per_product.join(attributes.select("product_id", "specification").distinct(), "product_id").groupBy("category_id", "specification").agg(F.sum("n").alias("with_value"))
    out = used.join(total, "category_id", "left").join(having, ["category_id", "specification"], "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("live_offerings", "with_value")})
    return out.withColumn("coverage_rate", F.try_divide(F.col("with_value").cast("double"), F.col("live_offerings")))


def search_gaps(profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """profiles (requirement_id, category_id, searches) and their pairs -> (category, search_count, unmet,
    certification_gap): searches without an offering left, and offerings returned that prove no requested certificate."""
    unproven = F.col("passes") & (F.col("certificate_possible") > 0) & (F.col("certificate_points") == 0)
    per = pairs.groupBy("requirement_id").agg(F.count_if("passes").alias("returned"), F.count_if(unproven).alias("unproven"))
    found = profiles.join(per, "requirement_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("returned", "unproven")})
    return found.groupBy(F.col("category_id").alias("category")).agg(
        F.sum("searches").alias("search_count"), F.sum(F.when(F.col("returned") == 0, F.col("searches")).otherwise(0)).alias("unmet"), F.sum(F.col("searches") * F.col("unproven")).alias("certification_gap"),
    )


def report(categories: DataFrame, specifications: DataFrame) -> DataFrame:
    """Both kinds of gaps as one table: what was asked for, how often, and how often the data had no answer."""
    by_category = categories.select(F.lit("category").alias("kind"), F.col("category").alias("category_id"), F.lit(None).cast("string").alias("specification"), F.col("search_count").alias("asked"), "unmet", "certification_gap")
    by_value = specifications.select(F.lit("specification").alias("kind"), "category_id", "specification", F.col("times_used").alias("asked"), (F.col("live_offerings") - F.col("with_value")).alias("unmet"), F.lit(None).cast("bigint").alias("certification_gap"))
    return by_category.unionByName(by_value)
