"""Company trust: a weighted checklist, its level, and the verified flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the checks (sum 100), and the least score of each level.
WEIGHTS = {"owner_email_verified": 20, "legal_entity_type_set": 6, "government_id_set": 7, "business_registration_date_set": 4, "business_registration_document_uploaded": 8, "business_type_set": 5, "factory_license_document_uploaded": 12, "manufacturing_categories_set": 8, "logo_uploaded": 5, "cover_image_uploaded": 4, "descriptions_complete": 6, "social_link_added": 4, "quality_certificate_uploaded": 8, "export_categories_set": 3}
LEVELS = [("unverified", 0), ("email_verified", 20), ("business_verified", 45), ("factory_verified", 70), ("premium_verified", 90)]
TRUST_POINTS = {"unverified": 0.0, "email_verified": 12.5, "business_verified": 25.0, "factory_verified": 37.5, "premium_verified": 50.0}


def level(score: Column) -> Column:
    out = F.lit(LEVELS[0][0])
    for name, least in LEVELS[1:]:
        out = F.when(score >= least, name).otherwise(out)
    return out


def next_level(score: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, least in reversed(LEVELS[1:]):
        out = F.when(score < least, name).otherwise(out)
    return out


def trust_scores(companies: DataFrame, documents: DataFrame) -> DataFrame:
    """(company_id, score, level, next_level, missing): one aggregate of documents, then a left join."""
    counts = ~F.col("is_deleted") & ~F.col("status").isin("rejected", "expired")
    has = {"reg": ["business_registration"], "lic": ["factory_license"], "cert": ["iso", "ce", "bis"]}
    docs = documents.where(counts).groupBy("company_id").agg(*[F.bool_or(F.col("document_type").isin(t)).alias(k) for k, t in has.items()])
    c = F.col
    checks = {
        "owner_email_verified": c("owner_email_verified"), "legal_entity_type_set": c("legal_entity_type").isNotNull(),
        "government_id_set": (F.coalesce(c("gst_number"), F.lit("")) != "") | (F.coalesce(c("cin"), F.lit("")) != ""),
        "business_registration_date_set": c("has_registration_date"), "business_registration_document_uploaded": c("reg"),
        "business_type_set": c("business_type").isNotNull(), "factory_license_document_uploaded": c("lic"), "manufacturing_categories_set": c("has_categories"),
        "logo_uploaded": c("has_logo"), "cover_image_uploaded": c("has_cover"), "descriptions_complete": c("has_descriptions"), "social_link_added": c("has_social_link"),
        "quality_certificate_uploaded": c("cert"), "export_categories_set": c("export_ready"),
    }
    met = {k: F.coalesce(v, F.lit(False)) for k, v in checks.items()}
    out = companies.join(docs, "company_id", "left").withColumn("score", sum(F.when(met[k], w).otherwise(0) for k, w in WEIGHTS.items()))
    missing = F.array_join(F.array_compact(F.array(*[F.when(~met[k], k) for k in WEIGHTS])), ",")
    return out.select("company_id", "score", level(c("score")).alias("level"), next_level(c("score")).alias("next_level"), missing.alias("missing"), "verification_status")


def verified_sync(scores: DataFrame) -> DataFrame:
    """Companies whose verified flag must change."""
    wanted = F.when(F.col("score") >= dict(LEVELS)["business_verified"], "verified").otherwise("unverified")
    return scores.select("company_id", wanted.alias("verification_status"), F.col("verification_status").alias("previous")).where("verification_status <> previous")
