"""Which collector an observation came from, and what its content says a company is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import city_from_address, squeezed

# Fields of each profile, read by rule and as they are; keys that mark a registry record without lineage.
PROFILES = {
    "registry": (["cin", "company_name", "registered_state", "principal_business_activity"], ["company_status", "company_class", "company_category", "sub_category", "authorized_capital", "paid_up_capital", "date_of_registration", "registrar_of_companies", "registered_office_address", "indian_foreign_classification", "nic_code", "industrial_classification"]),
    "filer": (["name", "sic_description", "business_address_state"], ["cik", "sic", "entity_type", "ein", "category", "fiscal_year_end", "state_of_incorporation", "tickers", "exchanges", "phone", "business_address_city", "business_address_street1", "business_address_zip", "former_names"]),
    "manual": (["company_name", "industry", "state"], ["city", "website", "description"]),
    "mock": ([], []),
}
MARKERS = ["cin", "company_name", "registered_state"]


def profiles(observations: DataFrame, events: DataFrame, jobs: DataFrame) -> DataFrame:
    """observations (observation_id, content map) with `profile`, or with the reason why there is none.

    The collector of the observation's job (of several, the smallest) decides; without a job, only content with a mark
    of the registry has a profile.
    """
    lineage = events.groupBy("observation_id").agg(F.min("job_id").alias("job_id")).join(jobs.select("job_id", "collector"), "job_id").select("observation_id", "collector")
    out = observations.join(lineage, "observation_id", "left")
    marked = F.exists(F.array(*[F.coalesce(F.map_contains_key("content", k), F.lit(False)) for k in MARKERS]), lambda x: x)
    profile = F.when(F.col("collector").isin(*PROFILES), F.col("collector")).when(F.col("collector").isNull() & marked, "registry")
    reason = F.when(profile.isNotNull(), None).when(F.col("collector").isNotNull(), "collector_without_profile").otherwise("no_lineage")
    return out.select("observation_id", "content", profile.alias("profile"), reason.alias("reason"))


def identities(profiled: DataFrame) -> DataFrame:
    """What each profile reads as identity; a filer's id is never a strong id, and mock content says nothing."""
    m = lambda k: F.try_element_at("content", F.lit(k))

    def by(**of: Column) -> Column:
        out = F.lit(None).cast("string")
        for profile, c in of.items():
            out = F.when(F.col("profile") == profile, c).otherwise(out)
        return out

    named = lambda k: squeezed(F.nullif(m(k), F.lit("")))
    return profiled.where("profile IS NOT NULL").select(
        "observation_id", "profile", by(registry=m("cin")).alias("strong_id"),
        by(registry=named("company_name"), filer=named("name"), manual=named("company_name")).alias("name"),
        by(registry=m("principal_business_activity"), filer=m("sic_description"), manual=m("industry")).alias("industry"),
        by(registry=F.lit("India"), filer=F.lit("United States"), manual=m("country")).alias("country"),
        by(registry=m("registered_state"), filer=m("business_address_state"), manual=m("state")).alias("state"),
        by(registry=city_from_address(m("registered_office_address"), m("registered_state")), filer=m("business_address_city"), manual=m("city")).alias("city"),
        by(registry=m("website"), filer=m("website"), manual=m("website")).alias("website"),
    )


def fields(profiled: DataFrame) -> DataFrame:
    """One row for each field of an observation that its profile knows and that is not empty."""
    known = F.map_from_entries(F.array(*[F.struct(F.lit(f"{p}/{f}"), F.lit(kind)) for p, kinds in PROFILES.items() for kind, names in zip(("direct", "extra"), kinds) for f in names]))
    rows = profiled.where("profile IS NOT NULL").select("observation_id", "profile", F.explode("content").alias("field_name", "value_observed"))
    kind = F.try_element_at(known, F.concat_ws("/", "profile", "field_name"))
    return rows.select("observation_id", "field_name", "value_observed", kind.alias("kind")).where("kind IS NOT NULL AND value_observed <> ''")
