"""Requirements matched to offerings: capped candidates, hard criteria, scores, ranks and a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import number, phrase_in
from .trust import TRUST_POINTS

# Candidates per category; points of a place; weights; document types and the phrases that name them.
CEILING = 500
COUNTRY, STATE, CITY, PLACE, CERTIFICATES, TRUST = 15.0, 10.0, 5.0, 30.0, 20.0, 50.0
LABELS = [("iso", "iso"), ("ce", "ce"), ("bis", "bis"), ("gst_certificate", "gst"), ("msme", "msme"), ("factory_license", "factory license"), ("import_export_code", "iec"), ("import_export_code", "import export code"), ("business_registration", "business registration")]


def candidates(offerings: DataFrame, products: DataFrame, ceiling: int = CEILING) -> DataFrame:
    """Live offerings, the oldest `ceiling` of each category and a flag whether there are more. Once per category."""
    live = offerings.where("status = 'active'").drop("status").join(products.where("status = 'published'").select("product_id", "category_id"), "product_id")
    oldest = Window.partitionBy("category_id").orderBy("created_at", "offering_id")
    first = live.withColumn("nth", F.row_number().over(oldest)).where(F.col("nth") <= ceiling + 1)
    more = F.max("nth").over(Window.partitionBy("category_id")) > ceiling
    return first.withColumn("more_exist", more).where(F.col("nth") <= ceiling).drop("nth")


def attribute_maps(attributes: DataFrame) -> DataFrame:
    return attributes.groupBy("product_id").agg(F.map_from_entries(F.collect_list(F.struct("specification", "value"))).alias("attributes"))


def holds(c: Column, attributes: Column) -> Column:
    """One criterion against a product's attributes; a missing one fails. Options of `in` are joined by bars."""
    raw = F.try_element_at(attributes, c["specification"])
    value = number(raw)
    options = F.transform(F.split(c["text_value"], r"\|"), lambda x: F.lower(F.trim(x)))
    text_eq, is_text = F.lower(F.trim(raw)) == F.lower(F.trim(c["text_value"])), c["text_value"].isNotNull()
    by = F.when(c["operator"] == "eq", F.when(is_text, text_eq).otherwise(value == c["low"])).when(c["operator"] == "in", F.array_contains(options, F.lower(F.trim(raw)))).when(c["operator"] == "gte", value >= c["low"]).when(c["operator"] == "lte", value <= c["low"]).when(c["operator"] == "range", value.between(c["low"], c["high"]))
    return F.coalesce(by, F.lit(False))


def same(a: Column, b: Column) -> Column:
    return F.coalesce(F.lower(F.trim(a)) == F.lower(F.trim(b)), F.lit(False))


def evidence(certificates: DataFrame) -> DataFrame:
    """requirement_id -> array of arrays: document types that each requested certificate may name."""
    types = F.array_compact(F.array(*[F.when(phrase_in(F.col("certificate"), label), t) for t, label in LABELS]))
    return certificates.groupBy("requirement_id").agg(F.collect_list(types).alias("requested"))


def profiles(requirements: DataFrame, criteria: DataFrame, certificates: DataFrame) -> DataFrame:
    """(requirement_id, category_id, searches): of the requirements with a category that are alike in it, in hard
    criteria and in requested certificates, the least id and how many there are. They pass and prove the same offerings."""
    hard = criteria.groupBy("requirement_id").agg(F.array_sort(F.collect_list(F.struct("specification", "operator", "low", "high", "text_value"))).alias("criteria"))
    wanted = evidence(certificates).select("requirement_id", F.array_sort("requested").alias("requested"))
    asked = requirements.where("category_id IS NOT NULL").select("requirement_id", "category_id").join(hard, "requirement_id", "left").join(wanted, "requirement_id", "left")
    return asked.groupBy("category_id", "criteria", "requested").agg(F.min("requirement_id").alias("requirement_id"), F.count(F.lit(1)).alias("searches")).select("requirement_id", "category_id", "searches")


def pairs(requirements: DataFrame, criteria: DataFrame, certificates: DataFrame, offerings: DataFrame, products: DataFrame, attributes: DataFrame, companies: DataFrame, documents: DataFrame, scores: DataFrame) -> DataFrame:
    """Every requirement with its candidates: `passes` by the hard criteria, and the score parts."""
    proof = documents.where("status = 'verified'").groupBy("company_id").agg(F.collect_set("document_type").alias("proof"))
    place = companies.select("company_id", F.col("country").alias("own_country"), F.col("state").alias("own_state"), F.col("city").alias("own_city"))
    found = candidates(offerings, products)
    wanted = attributes.join(criteria.select("specification").distinct(), "specification", "left_semi").join(found.select("product_id").distinct(), "product_id", "left_semi")
    offered = found.join(attribute_maps(wanted), "product_id", "left").join(place, "company_id").join(proof, "company_id", "left").join(scores.select("company_id", "level"), "company_id")
    offered = offered.withColumnRenamed("country", "offer_country")
    hard = criteria.groupBy("requirement_id").agg(F.collect_list(F.struct("specification", "operator", "low", "high", "text_value")).alias("criteria"))
    asked = requirements.where("category_id IS NOT NULL").join(hard, "requirement_id", "left").join(evidence(certificates), "requirement_id", "left")
    both = asked.join(offered, "category_id")
    passes = F.coalesce(F.forall("criteria", lambda c: holds(c, F.col("attributes"))), F.lit(True))
    country = same(F.col("country"), F.coalesce(F.nullif("offer_country", F.lit("")), "own_country"))
    state = country & same(F.col("state"), F.col("own_state"))
    city = state & same(F.col("city"), F.col("own_city"))
    wants = F.coalesce("country", "state", "city").isNotNull()
    found = F.size(F.filter("requested", lambda t: F.arrays_overlap(t, F.coalesce("proof", F.array().cast("array<string>")))))
    points = F.lit(0.0)
    for k, v in TRUST_POINTS.items():
        points = F.when(F.col("level") == k, v).otherwise(points)
    return both.withColumns({
        "passes": passes,
        "location_points": F.when(wants, F.when(country, COUNTRY).otherwise(0.0) + F.when(state, STATE).otherwise(0.0) + F.when(city, CITY).otherwise(0.0)).otherwise(0.0),
        "location_possible": F.when(wants, PLACE).otherwise(0.0),
        "certificate_points": F.when(F.size("requested") > 0, CERTIFICATES * (found / F.size("requested"))).otherwise(0.0),
        "certificate_possible": F.when(F.size("requested") > 0, CERTIFICATES).otherwise(0.0),
        "trust_points": points,
    })


def ranked(pairs: DataFrame, *more: str) -> DataFrame:
    """Candidates that pass, by score; further columns of `pairs` on demand."""
    earned = F.col("location_points") + F.col("certificate_points") + F.col("trust_points")
    possible = F.col("location_possible") + F.col("certificate_possible") + TRUST
    out = pairs.where("passes").withColumn("score", F.bround(earned / possible * 100, 2))
    order = Window.partitionBy("requirement_id").orderBy(F.desc("score"), F.desc("trust_points"), "created_at", "offering_id")
    return out.select("requirement_id", F.row_number().over(order).alias("rank"), "offering_id", "company_id", "score", "location_points", "certificate_points", "trust_points", *more)


def summary(requirements: DataFrame, pairs: DataFrame) -> DataFrame:
    per = pairs.groupBy("requirement_id").agg(F.count(F.lit(1)).alias("considered"), F.count_if(~F.col("passes")).alias("excluded"), F.count_if("passes").alias("returned"), F.bool_or("more_exist").alias("more_may_exist"))
    out = requirements.select("requirement_id", F.when(F.col("category_id").isNull(), "category_required").otherwise("ok").alias("status")).join(per, "requirement_id", "left")
    return out.select("requirement_id", "status", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("considered", "excluded", "returned")], F.coalesce("more_may_exist", F.lit(False)).alias("more_may_exist"))
