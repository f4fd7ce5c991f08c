"""Graph questions over offerings and relationships, and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The relationship that each offering role stands for.
ROLES = {"manufacturer": "manufactures", "distributor": "distributes", "supplier": "supplies", "exporter": "exports", "service_provider": "services"}


def offering_edges(offerings: DataFrame) -> DataFrame:
    kind = F.col("role")
    for role, relation in ROLES.items():
        kind = F.when(F.col("role") == role, relation).otherwise(kind)
    return offerings.where("status = 'active'").select("company_id", kind.alias("relationship"), F.lit("product").alias("object_type"), F.col("product_id").alias("object_id"))


def company_graph(offerings: DataFrame, relationships: DataFrame) -> DataFrame:
    return offering_edges(offerings).unionByName(relationships.select("company_id", "relationship", "object_type", "object_id"))


def in_role(offerings: DataFrame, role: str, country: str | None = None) -> DataFrame:
    out = offerings.where((F.col("role") == role) & (F.col("status") == "active"))
    return (out.where(F.col("country") == country) if country else out).select("product_id", "company_id", "offering_id", "country")


def traversal(companies: DataFrame, offerings: DataFrame, products: DataFrame) -> DataFrame:
    """company -> offering -> product -> category"""
    return companies.select("company_id", "name").join(offerings.select("company_id", "product_id", "role"), "company_id").join(products.select("product_id", "category_id"), "product_id")


def like_any(columns: list[str], text: str) -> Column:
    return F.exists(F.array(*[F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False)) for c in columns]), lambda x: x)


def paged(found: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """A page of what was found, with the total and number of pages on each row."""
    total = found.agg(F.count(F.lit(1)).alias("total"))
    rows = found.orderBy(*order).offset((page - 1) * size).limit(size)
    return rows.join(F.broadcast(total)).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("bigint"))  # one row


def company_search(companies: DataFrame, name: str | None = None, industry: str | None = None, country: str | None = None, page: int = 1, size: int = 20, city: str | None = None, sort: str = "name", descending: bool = False) -> DataFrame:
    """A page of active companies; `name` is looked for in the slug too where companies have one."""
    out = companies.where("status = 'active'")
    fields = {"name": [c for c in ("name", "slug") if c in companies.columns], "industry": ["industry"], "country": ["country"], "city": ["city"]}
    for field, value in (("name", name), ("industry", industry), ("country", country), ("city", city)):
        if value:
            out = out.where(like_any(fields[field], value))
    order = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return paged(out, [order, F.col("company_id")], page, size).select("company_id", "name", "industry", "country", "total", "pages")


def with_trust(results: DataFrame, scores: DataFrame) -> DataFrame:
    return results.select("company_id", "name").join(scores.select("company_id", "score", "level"), "company_id")


def product_search(products: DataFrame, offerings: DataFrame, name: str) -> DataFrame:
    counts = offerings.groupBy("product_id").agg(F.count(F.lit(1)).alias("offering_count"))
    out = products.where((F.col("status") == "published") & F.col("name").ilike(f"%{name}%")).join(counts, "product_id", "left")
    return out.select("product_id", "name", "category_id", F.coalesce("offering_count", F.lit(0)).alias("offering_count"))


def product_page(products: DataFrame, offerings: DataFrame, name: str | None = None, category: str | None = None, industry: str | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """A page of published products, newest (largest id) first, each with its number of offerings."""
    out = products.where("status = 'published'")
    out = out.where(like_any(["name"], name)) if name else out
    out = out.where(F.col("category_id") == category) if category else out
    out = out.where(like_any(["industry"], industry)) if industry else out
    shown = paged(out, [F.desc("product_id")], page, size)
    counts = offerings.join(F.broadcast(shown.select("product_id")), "product_id").groupBy("product_id").agg(F.count(F.lit(1)).alias("offering_count"))  # a page of ids
    return shown.join(counts, "product_id", "left").select("product_id", "name", "category_id", F.coalesce("offering_count", F.lit(0)).alias("offering_count"), "total", "pages")


def discover(companies: DataFrame, text: str, per_field: int = 50) -> DataFrame:
    """Hits per field (first `per_field`, newest first: a top-k for each), merged and ranked by fields hit."""
    if len(text.strip()) < 2:
        return companies.limit(0).select("company_id", F.lit("").alias("matched_fields"), F.lit(0).alias("n_fields"), F.lit(0).alias("rank"))
    fields = ["name", "industry", "city", "country"]
    text = text.strip()
    hit = {f: like_any([f, "slug"] if f == "name" and "slug" in companies.columns else [f], text) for f in fields}
    live = companies.where("status = 'active'").select("company_id", *[hit[f].alias(f) for f in fields])
    lists = [live.where(f).orderBy(F.desc("company_id")).limit(per_field).select("company_id", F.lit(i).alias("i")) for i, f in enumerate(fields)]
    first = lists[0].union(lists[1]).union(lists[2]).union(lists[3]).groupBy("company_id").agg(F.array_sort(F.collect_list("i")).alias("lists"))
    out = live.join(F.broadcast(first), "company_id").withColumn("n_fields", sum(F.col(f).cast("int") for f in fields))  # at most four lists of per_field
    order = Window.orderBy(F.desc("n_fields"), F.element_at("lists", 1), F.desc("company_id"))
    return out.select("company_id", F.array_join(F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in fields])), ",").alias("matched_fields"), "n_fields", F.row_number().over(order).alias("rank"))


def integrity(offerings: DataFrame, companies: DataFrame, provenance: DataFrame) -> DataFrame:
    """Violations: repeated (company, product, role), offerings of unknown companies, records without an entity."""
    twice = offerings.groupBy("company_id", "product_id", "role").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_offering").alias("rule"), F.col("company_id").alias("entity_id"))
    orphan = offerings.join(companies, "company_id", "left_anti").select(F.lit("unknown_company").alias("rule"), F.col("company_id").alias("entity_id"))
    loose = provenance.join(companies, "company_id", "left_anti").select(F.lit("unknown_entity").alias("rule"), F.col("record_id").alias("entity_id"))
    return twice.unionByName(orphan).unionByName(loose)
