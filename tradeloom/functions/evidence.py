"""Risk and freshness of a field's evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days until a field is stale by its kind, and fields of low and high risk (others: medium).
LEGAL_IDENTITY = ["name", "company_name", "legal_name", "cin", "business_registration_date", "date_of_registration", "registrar_of_companies", "company_class", "company_category"]
ADDRESS = ["country", "state", "city", "registered_state", "registered_office_address"]
STALE_DAYS = {"legal_identity": 180, "address": 90, "other": 30}
HIGH_RISK = ["cin", "gst_number", "pan", "msme_number", "iec_number", "export_capable"]
LOW_RISK = ["name", "company_name", "legal_name", "industry", "principal_business_activity", "registered_office_address", "registered_state", "city", "state", "country", "sub_category", "registrar_of_companies", "date_of_registration", "company_class", "company_category"]


def risk(field: Column) -> Column:
    return F.when(field.isin(HIGH_RISK), "high").when(field.isin(LOW_RISK), "low").otherwise("medium")


def stale_days(field: Column) -> Column:
    return F.when(field.isin(LEGAL_IDENTITY), STALE_DAYS["legal_identity"]).when(field.isin(ADDRESS), STALE_DAYS["address"]).otherwise(STALE_DAYS["other"])


def freshness(field: Column, seen: Column, as_of: Column) -> Column:
    age, limit = F.unix_timestamp(as_of) - F.unix_timestamp(seen), stale_days(field) * 86400
    return F.when(age >= limit, "stale").when(age * 5 >= limit * 4, "approaching_stale").otherwise("fresh")
