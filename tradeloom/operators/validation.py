"""Checks of what is handed in: each row with the reason why it is refused, or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Longest texts of a requirement's fields.
LONGEST = {"raw_query": 5000, "industry": 120, "country": 120, "state": 120, "city": 120, "quantity": 120, "budget": 120, "timeline": 120}
NUMERIC_OPERATORS, NUMERIC_TYPES = ["gte", "lte", "range"], ["number", "range"]


def well_formed(operator: Column, value: Column) -> Column:
    """Whether a criterion's JSON value has the shape that its operator needs."""
    size, is_list, texts = F.json_array_length(value), value.startswith("["), value.contains('"')
    ends = [F.get_json_object(value, f"$[{i}]").try_cast("double") for i in (0, 1)]
    ranged = is_list & (size == 2) & ~texts & (ends[0] <= ends[1])
    by = F.when(operator == "range", ranged).when(operator == "in", is_list & (size >= 1)).when(operator.isin("gte", "lte"), ~is_list & ~texts).otherwise(~is_list)
    return F.coalesce(by, F.lit(False))


def criteria(asked: DataFrame, requirements: DataFrame, specifications: DataFrame) -> DataFrame:
    """asked (requirement_id, n, specification, operator, value) -> with `reason`, the first that holds, or null."""
    earlier = Window.partitionBy("requirement_id", "specification").orderBy("n")
    known = specifications.select(F.col("category_id").alias("own"), F.col("specification").alias("s"), "datatype")
    out = asked.join(requirements.select("requirement_id", "category_id"), "requirement_id", "left").withColumn("nth", F.row_number().over(earlier))
    out = out.join(known, (F.col("category_id") == F.col("own")) & (F.col("specification") == F.col("s")), "left")
    wrong = F.col("operator").isin(NUMERIC_OPERATORS) & ~F.col("datatype").isin(NUMERIC_TYPES)
    reason = F.when(~well_formed(F.col("operator"), F.col("value")), "value_shape").when(F.col("category_id").isNull(), "category_required").when(F.col("nth") > 1, "duplicate_specification").when(F.col("datatype").isNull(), "unknown_specification").when(wrong, "operator_of_other_type")
    return out.select("requirement_id", "n", "specification", "operator", reason.alias("reason"))


def attributes(given: DataFrame, products: DataFrame, specifications: DataFrame) -> DataFrame:
    """given (product_id, specification, value): a specification must belong to its product's category."""
    own = specifications.select("category_id", "specification", F.lit(True).alias("known"))
    out = given.join(products.select("product_id", "category_id"), "product_id", "left").join(own, ["category_id", "specification"], "left")
    return out.select("product_id", "specification", F.when(F.col("category_id").isNull(), "unknown_product").when(F.col("known").isNull(), "not_in_category").alias("reason"))


def requirement_fields(rows: DataFrame) -> DataFrame:
    """requirement_id and the fields out of their bounds, in order, joined by commas."""
    bad = {c: F.coalesce(F.length(c) > n, F.lit(False)) for c, n in LONGEST.items()}
    bad["raw_query"] = F.coalesce(~F.length("raw_query").between(1, LONGEST["raw_query"]), F.lit(True))
    bad["extraction_confidence"] = F.coalesce(~F.col("extraction_confidence").between(0, 1), F.lit(False))
    return rows.select("requirement_id", F.concat_ws(",", *[F.when(b, F.lit(c)) for c, b in bad.items()]).alias("out_of_bounds"))


def promotions(companies: DataFrame, records: DataFrame) -> DataFrame:
    """companies (company_id, observation_id) as promoted: records exist, none verified, all of that observation, and
    no other company of it."""
    per = records.groupBy("company_id").agg(F.count(F.lit(1)).alias("n_records"), F.bool_or(F.col("status") == "verified").alias("any_verified"), F.min("observation_id").alias("lo"), F.max("observation_id").alias("hi"))
    same = companies.groupBy("observation_id").agg(F.count_distinct("company_id").alias("n_companies"))
    out = companies.join(per, "company_id", "left").join(same, "observation_id", "left")
    n = F.coalesce("n_records", F.lit(0))
    tied = (n > 0) & (F.col("lo") == F.col("observation_id")) & (F.col("hi") == F.col("observation_id"))
    checks = {"one_company": F.col("n_companies") == 1, "none_verified": ~F.coalesce("any_verified", F.lit(False)), "tied": F.coalesce(tied, F.lit(False)), "has_records": n > 0}
    passed = checks["one_company"] & checks["none_verified"] & checks["tied"] & checks["has_records"]
    return out.select("company_id", *[c.alias(k) for k, c in checks.items()], passed.alias("passed"))
