"""Landed payloads to observations."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.exact import content_hash

# Key variants of the registry's fields, the first that is not empty counts; tables read of a trade report.
REGISTRY_FIELDS = {
    "cin": ["CIN", "cin", "Corporate_identification_number", "corporate_identification_number"],
    "company_name": ["Company Name", "company_name", "CompanyName", "COMPANY_NAME"],
    "company_status": ["Company Status", "company_status", "CompanyStatus"],
    "company_class": ["Company Class", "company_class", "CompanyClass"],
    "company_category": ["Company Category", "company_category", "CompanyCategory"],
    "sub_category": ["Company SubCategory", "sub_category", "Sub Category", "CompanySubCategory"],
    "authorized_capital": ["Authorized Capital", "authorized_capital", "AuthorizedCapital"],
    "paid_up_capital": ["Paid up Capital", "paid_up_capital", "PaidUpCapital", "PaidupCapital"],
    "date_of_registration": ["Date of Registration", "date_of_registration", "DateOfRegistration", "CompanyRegistrationdate_date"],
    "registered_state": ["Registered State", "registered_state", "RegisteredState", "CompanyStateCode"],
    "registrar_of_companies": ["Registrar of Companies", "registrar_of_companies", "ROC", "CompanyROCcode"],
    "principal_business_activity": ["Principal Business Activity", "principal_business_activity", "PrincipalBusinessActivity"],
    "registered_office_address": ["Registered Office Address", "registered_office_address", "RegisteredOfficeAddress", "Registered_Office_Address"],
    "indian_foreign_classification": ["Company Indian/Foreign Company", "CompanyIndianForeignCompany", "Indian/Foreign Company", "indian_foreign_company", "CompanyIndian/Foreign Company"],
    "nic_code": ["NIC Code", "nic_code", "NICCode", "Nic Code"],
    "industrial_classification": ["Company Industrial Classification", "CompanyIndustrialClassification", "Industrial Classification", "industrial_classification"],
}
MOST_TABLES = 5


def registry(pages: DataFrame) -> DataFrame:
    """pages (page_id, body: JSON with records[]) -> one observation a record; its id is the CIN."""
    records = F.from_json("body", "STRUCT<records: ARRAY<MAP<STRING, STRING>>>")["records"]
    rows = pages.select("page_id", F.posexplode(records).alias("pos", "m"))
    field = {f: F.trim(F.coalesce(*[F.nullif(F.col("m")[k], F.lit("")) for k in keys])) for f, keys in REGISTRY_FIELDS.items()}
    return rows.select("page_id", F.col("pos").cast("bigint").alias("pos"), *[c.alias(f) for f, c in field.items()]).where("cin IS NOT NULL")


def registry_hashes(observations: DataFrame) -> DataFrame:
    """Registry observations with the hash of their sixteen fields, absent ones as nulls."""
    body = F.to_json(F.struct(*REGISTRY_FIELDS), {"ignoreNullFields": "false"})
    return observations.select("page_id", "pos", F.col("cin").alias("external_id"), content_hash(body).alias("content_hash"))


def as_registry_pages(companies: DataFrame, per_page: int = 10) -> DataFrame:
    """Companies as the registry would send them, alternating between its two spellings of keys."""
    text = lambda c: F.col(c).cast("string")
    old = F.struct(F.col("cin").alias("CIN"), F.concat(F.lit(" "), "name").alias("Company Name"), F.col("state").alias("Registered State"), F.col("status").alias("Company Status"), text("company_id").alias("Authorized Capital"), F.concat(F.lit("7 Lake Lane, "), "city", F.lit(" ")).alias("Registered Office Address"))
    new = F.struct(F.col("cin").alias("cin"), F.lit("").alias("Company Name"), F.col("name").alias("CompanyName"), F.col("state").alias("CompanyStateCode"), F.col("status").alias("CompanyStatus"), text("company_id").alias("PaidupCapital"), F.col("industry").alias("Industrial Classification"))
    rows = companies.select(F.floor(F.col("company_id") / per_page).alias("page_id"), "company_id", F.when(F.col("company_id") % 2 == 0, F.to_json(old)).otherwise(F.to_json(new)).alias("r"))
    bodies = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("company_id", "r"))).alias("rs"))
    return bodies.select("page_id", F.concat(F.lit('{"records":['), F.array_join(F.col("rs.r"), ","), F.lit("]}")).alias("body"))


#: A filer's fields by the places that a submission has them at.
FILER_FIELDS = {
    "name": "name", "entity_type": "entityType", "sic": "sic", "sic_description": "sicDescription", "ein": "ein", "category": "category", "fiscal_year_end": "fiscalYearEnd", "state_of_incorporation": "stateOfIncorporation",
    "tickers": "tickers", "exchanges": "exchanges", "phone": "phone", "website": "website", "business_address_street1": "addresses.business.street1", "business_address_city": "addresses.business.city",
    "business_address_state": "addresses.business.stateOrCountry", "business_address_zip": "addresses.business.zipCode", "former_names": "formerNames",
}
_FILER_LISTS = ("tickers", "exchanges")


def submissions(rows: DataFrame) -> DataFrame:
    """Filer submissions (body JSON) -> external_id (zero-padded to ten digits at least, never cut), cik, all fields, and
    the hash of them all. Lists are joined by commas; absent and empty values are null."""
    plain = [f"{path}: STRING" for name, path in FILER_FIELDS.items() if "." not in path and name not in (*_FILER_LISTS, "former_names")]
    address = "STRUCT<street1: STRING, city: STRING, stateOrCountry: STRING, zipCode: STRING>"
    lists = [f"{name}: ARRAY<STRING>" for name in _FILER_LISTS]
    schema = f"STRUCT<cik: STRING, {', '.join(plain + lists)}, addresses: STRUCT<business: {address}>, formerNames: ARRAY<STRUCT<name: STRING>>>"
    out = rows.select(F.from_json("body", schema).alias("s"))
    cik = F.col("s.cik")
    padded = F.when(F.length(cik) >= 10, cik).otherwise(F.lpad(cik, 10, "0"))
    joined = lambda items: F.when(F.size(items) > 0, F.array_join(F.filter(items, lambda t: t.isNotNull() & (t != "")), ", "))

    def field(name: str, path: str) -> Column:
        if name == "former_names":
            return joined(F.filter(F.transform("s.formerNames", lambda x: x["name"]), lambda t: t.isNotNull() & (t != "")))
        c = F.col(f"s.{path}")
        return joined(c) if name in _FILER_LISTS else F.nullif(c, F.lit(""))

    out = out.select(padded.alias("external_id"), padded.alias("cik"), *[field(n, p).alias(n) for n, p in FILER_FIELDS.items()])
    body = F.to_json(F.struct("cik", *FILER_FIELDS), {"ignoreNullFields": "false"})
    return out.withColumn("content_hash", content_hash(body))


def pattern_rows(rows: DataFrame, year: int) -> DataFrame:
    """Census rows: the header row names the cells of the first data row; a header alone is a suppressed cell."""
    cells = F.from_json("body", "ARRAY<ARRAY<STRING>>")
    out = rows.select(cells.alias("c")).where(F.size("c") > 1).select(F.map_from_arrays(F.col("c")[0], F.col("c")[1]).alias("m"))
    key = F.concat(F.lit(f"cbp:{year}:state:"), F.col("m")["state"], F.lit(":naics:"), F.col("m")["NAICS2017"])
    return out.select(key.alias("external_id"), "m")


def manual(rows: DataFrame) -> DataFrame:
    needed = (F.coalesce("company_name", F.lit("")) != "") & (F.coalesce("entered_by", F.lit("")) != "")
    return rows.where(needed).withColumn("external_id", F.nullif("evidence_url", F.lit("")))


def first_seen(ids: DataFrame, id_column: str, place: str, limit: int) -> DataFrame:
    """The first `limit` distinct ids in order of their first place."""
    return ids.groupBy(id_column).agg(F.min(place).alias(place)).orderBy(place, id_column).limit(limit)


@F.pandas_udf(ArrayType(StringType()))
def leaf_labels(groups: pd.Series) -> pd.Series:
    """Labels of the columns of nested column groups (JSON), left to right; a group with columns has no label of its own."""

    def walk(text: str | None) -> list[str]:
        found, todo = [], [json.loads(text) if text else []]
        while todo:
            g = todo.pop()
            if isinstance(g, list):
                todo += reversed(g)
            elif isinstance(g, dict) and "columns" in g:
                todo.append(g["columns"])
            elif isinstance(g, dict) and "label" in g:
                found.append(str(g["label"]))
        return found

    return groups.map(walk)


def trade_tables(reports: DataFrame) -> DataFrame:
    """reports (query, body) -> a row for each row of the first tables; cells are named `col:` and the column's label.

    Of equal labels the last counts; cells beyond the labels and labels beyond the cells are left out.
    """
    rows = "ARRAY<STRUCT<rowsNew: ARRAY<STRUCT<rowEntries: ARRAY<STRUCT<value: STRING>>>>>>"
    tables = F.from_json("body", f"STRUCT<dto: STRUCT<tables: ARRAY<STRUCT<column_groups: STRING, row_groups: {rows}>>>>")["dto"]["tables"]
    table = reports.select("query", F.posexplode(F.slice(tables, 1, MOST_TABLES)).alias("measure", "t"))
    table = table.select("query", "measure", leaf_labels("t.column_groups").alias("labels"), F.try_element_at("t.row_groups", F.lit(1))["rowsNew"].alias("rows"))
    row = table.select("query", "measure", "labels", F.posexplode("rows").alias("row", "r")).withColumn("values", F.col("r.rowEntries.value"))
    wide = F.least(F.size("labels"), F.size("values"))
    used = row.withColumns({"labels": F.slice("labels", F.lit(1), wide), "values": F.slice("values", F.lit(1), wide)})
    last = lambda p, i: ~F.array_contains(F.slice("labels", i + 2, F.size("labels")), p["labels"])
    cells = F.filter(F.arrays_zip("labels", "values"), last)
    named = F.map_from_entries(F.transform(cells, lambda p: F.struct(F.concat(F.lit("col:"), p["labels"]), p["values"])))
    key = F.concat_ws(":", F.lit("usitc"), "query", F.lit("measure"), "measure", F.lit("row"), "row")
    return used.select(key.alias("external_id"), "query", "measure", "row", named.alias("cells"))


def as_trade_reports(companies: DataFrame) -> DataFrame:
    """A report for up to a hundred companies of a country: six tables of them, with nested column groups."""
    entry = lambda c: F.struct(c.cast("string").alias("value"))
    line = F.struct(F.array(entry(F.col("company_id")), entry(F.col("name")), entry(F.col("city"))).alias("rowEntries"))
    query = F.concat_ws("-", "country", F.floor(F.col("company_id") / 100))
    per = companies.groupBy(query.alias("query")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("company_id", line.alias("line")))), lambda x: x["line"])).alias("lines"))
    table = F.concat(F.lit('{"column_groups":[{"label":"id"},{"label":"group","columns":[{"label":"name"},[{"label":"city"}]]}],"row_groups":[{"rowsNew":'), "lines", F.lit("}]}"))
    return per.select("query", F.concat(F.lit('{"dto":{"tables":['), F.array_join(F.array_repeat(table, MOST_TABLES + 1), ","), F.lit("]}}")).alias("body"))


def redacted(config: Column, secret: tuple[str, ...] = ("password", "api_key")) -> Column:
    """A map of settings with the values of secret keys hidden."""
    return F.transform_values(config, lambda k, v: F.when(F.lower(k).isin(*secret), "***REDACTED***").otherwise(v))


def error_text(message: Column, config: Column) -> Column:
    """An error with the settings it came from, secrets hidden; without settings the bare message."""
    pairs = F.transform(F.map_entries(redacted(config)), lambda e: F.concat(F.lit("'"), e["key"], F.lit("': '"), e["value"], F.lit("'")))
    base = F.coalesce(message, F.lit("Unknown error"))
    return F.when(F.size(config) > 0, F.concat(base, F.lit(" (config: {"), F.array_join(pairs, ", "), F.lit("})"))).otherwise(base)
