"""Observations resolved to known companies by ordered, explainable rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exact
from ..functions.text import match_domain, match_name, match_place
from .similar import similar_names

# Fixed value: least ratio of a similar name.
SIMILAR = 0.72


def keyed(df: DataFrame) -> DataFrame:
    """Names and places as they are compared: in Unicode form NFKC, upper case."""
    df = exact.with_normalized(df, {"n_name": "name", "n_state": "state", "n_city": "city"}, "NFKC")
    keys = {"k_name": F.nullif(match_name(F.col("n_name")), F.lit("")), "k_domain": match_domain(F.col("website")), "k_state": match_place(F.col("n_state")), "k_city": match_place(F.col("n_city"))}
    return df.withColumns(keys).drop("n_name", "n_state", "n_city")


def hits(observations: DataFrame, companies: DataFrame, signal: str, on: dict[str, str]) -> DataFrame:
    """Companies are reduced to one row a key before the join, so a common key multiplies nothing."""
    c = companies.where(" AND ".join(f"{b} IS NOT NULL" for b in on.values()))
    c = c.groupBy(*on.values()).agg(F.min("company_id").alias("company_id"), F.min(F.when(F.col("cin").isNotNull(), F.col("company_id"))).alias("with_cin"))
    c = c.toDF(*[f"r_{b}" for b in on.values()], "company_id", "with_cin")
    match = [F.col(a) == F.col(f"r_{b}") for a, b in on.items()]
    return observations.join(c, match).select("observation_id", F.lit(signal).alias("signal"), "company_id", "with_cin")


def exact_signals(observations: DataFrame, companies: DataFrame) -> DataFrame:
    o, c = keyed(observations.where("name IS NOT NULL")), keyed(companies)
    found = hits(o, c, "strong_id", {"strong_id": "cin"})
    found = found.union(hits(o, c, "domain", {"k_domain": "k_domain"}))
    found = found.union(hits(o, c, "name_address", {"k_name": "k_name", "k_state": "k_state", "k_city": "k_city"}))
    return found.union(hits(o, c, "name", {"k_name": "k_name"}))


def source_signals(observations: DataFrame, listed: DataFrame) -> DataFrame:
    """listed (external_id, company_id): companies that a source's identifier is linked to already; any one counts."""
    one = listed.groupBy("external_id").agg(F.min("company_id").alias("company_id"))
    return observations.where("name IS NOT NULL").join(one, "external_id").select("observation_id", F.lit("source_id").alias("signal"), "company_id", F.lit(None).cast("bigint").alias("with_cin"))


def decide(observations: DataFrame, signals: DataFrame) -> DataFrame:
    """One aggregate by observation, then the ordered rules."""
    names = ("strong_id", "source_id", "domain", "name_address", "name", "fuzzy")
    conflict = F.coalesce(*[F.min(F.when(F.col("signal") == s, F.col("with_cin"))) for s in ("name_address", "name", "fuzzy")])
    per = signals.groupBy("observation_id").agg(
        *[F.min(F.when(F.col("signal") == s, F.col("company_id"))).alias(s) for s in names], conflict.alias("conflict"), F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("signals")
    )
    out = observations.select("observation_id", F.col("name").alias("given")).join(per, "observation_id", "left")
    weak = F.coalesce("source_id", "domain", "name_address", "name", "fuzzy")
    state = F.when(F.col("given").isNull(), "NO_MATCH").when(F.col("strong_id").isNotNull(), "AUTO_MATCH").when(F.col("conflict").isNotNull() | weak.isNotNull(), "REVIEW_REQUIRED").otherwise("NEW")
    rule = F.when(F.col("strong_id").isNotNull(), F.col("strong_id")).when(F.col("conflict").isNotNull(), F.col("conflict")).otherwise(weak)
    return out.select("observation_id", state.alias("state"), rule.alias("company_id"), F.coalesce("signals", F.lit("")).alias("signals"))


def fuzzy_signals(observations: DataFrame, companies: DataFrame, exact: DataFrame) -> DataFrame:
    """Best similar name of each observation that no name equals; with_cin is the first of all similar ones that has a CIN."""
    unnamed = keyed(observations.where("name IS NOT NULL")).join(exact.where("signal = 'name'"), "observation_id", "left_anti").where("k_name IS NOT NULL")
    known = keyed(companies).where("k_name IS NOT NULL").groupBy("k_name").agg(F.min("company_id").alias("company_id"), F.min(F.when(F.col("cin").isNotNull(), F.col("company_id"))).alias("with_cin"))
    pairs = similar_names(unnamed.select(F.col("k_name").alias("a")).distinct(), known.select(F.col("k_name").alias("b")), SIMILAR)
    best = pairs.join(known, F.col("b") == F.col("k_name")).groupBy("a").agg(F.max_by("company_id", F.struct("ratio", -F.col("company_id"))).alias("company_id"), F.min("with_cin").alias("with_cin"), F.max("ratio").alias("ratio"))
    return unnamed.join(best, F.col("k_name") == F.col("a")).select("observation_id", F.lit("fuzzy").alias("signal"), "company_id", "with_cin", "ratio")


def all_decisions(observations: DataFrame, companies: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """decide over exact signals, similar names and, where given, identifiers of sources."""
    exact = exact_signals(observations, companies)
    found = exact.unionByName(fuzzy_signals(observations, companies, exact).drop("ratio"))
    return decide(observations, found.unionByName(source_signals(observations, listed)) if listed is not None else found)
