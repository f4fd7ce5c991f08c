"""A buyer's free text to a requirement by keywords and patterns, and how complete it is. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Role words in order of test, countries, certificates, opening words, and weights of confidence.
ROLES = {
    "find_manufacturer": ["manufacturer", "manufacture", "produce", "producer", "factory"],
    "find_supplier": ["supplier", "supply"],
    "find_distributor": ["distributor", "distribute", "distribution"],
    "find_exporter": ["exporter", "export"],
}
COUNTRIES = ["india", "china", "germany", "usa", "united states", "japan", "italy", "france", "uk", "united kingdom", "south korea", "vietnam", "taiwan", "mexico", "brazil", "turkey", "spain", "poland", "thailand", "indonesia"]
CERTIFICATES = {"iso": "ISO", "ce": "CE", "bis": "BIS", "gst": "GST Certificate", "msme": "MSME"}
OPENINGS = ["i need", "i want", "need", "looking for", "i'm looking for", "im looking for", "find", "find me", "source", "sourcing"]
CONFIDENCE = {"intent": 25, "product": 30, "country": 15, "certificates": 10, "quantity": 7, "budget": 7, "timeline": 6}


def first_in(text: Column, options: list[tuple[str, list[str]]]) -> Column:
    out = F.lit(None).cast("string")
    for name, words in reversed(options):
        held = F.lit(False)
        for w in words:
            held = held | text.contains(w)
        out = F.when(held, name).otherwise(out)
    return out


def extracted(rows: DataFrame) -> DataFrame:
    """rows (id, text) -> intent, country, quantity, certificates, product, each null where the text lacks it."""
    low = F.lower("text")
    number = F.nullif(F.regexp_extract("text", r"\b\d{1,3}(?:,\d{3})*\b", 0), F.lit(""))
    found = F.array_compact(F.array(*[F.when(F.col("text").rlike(rf"(?i)\b{k}\b"), F.lit(v)) for k, v in CERTIFICATES.items()]))
    out = rows.withColumns({
        "intent": first_in(low, list(ROLES.items())),
        "place": first_in(low, [(c, [c]) for c in COUNTRIES]),
        "quantity": F.when(F.length(F.regexp_replace(number, ",", "")) >= 2, number),
        "certificates": F.when(F.size(found) > 0, F.array_join(found, ",")),
    })
    # step by step: each column is read more than once by the next
    out = out.withColumn("said", F.trim("text"))
    opening = first_in_front(F.lower("said"))
    out = out.withColumn("opening", opening)
    rest = F.trim(F.when(F.col("opening").isNull(), F.col("said")).otherwise(F.expr("substring(said, length(opening) + 1)")))
    for words in ROLES.values():
        for w in words:
            rest = F.trim(F.regexp_replace(rest, rf"(?i)\b{w}s?\b", ""))
    out = out.withColumn("without_roles", rest)
    named = F.trim(F.regexp_replace("without_roles", F.concat(F.lit(r"(?i)\b"), "place", F.lit(r"\b")), F.lit("")))
    out = out.withColumn("without_place", F.when(F.col("place").isNull(), F.col("without_roles")).otherwise(named))
    rest = F.trim(F.regexp_replace("without_place", r"(?i)\s+(in|for|from|at|near)\s*$", ""))
    out = out.withColumn("left", F.trim(F.regexp_replace(rest, r"[.,!?]+$", "")))
    return out.select("id", "intent", F.initcap("place").alias("country"), "quantity", "certificates", F.when(F.length("left") >= 2, F.col("left")).alias("product"))


def first_in_front(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for p in reversed(OPENINGS):
        out = F.when(text.startswith(p), p).otherwise(out)
    return out


def completeness(rows: DataFrame) -> DataFrame:
    """Confidence of 0 to 100 from the fields that are known, and the field to ask for next."""
    known = ["intent", "product", "country", "certificates", "quantity"]
    score = sum(F.when(F.col(c).isNotNull(), CONFIDENCE[c]).otherwise(0) for c in known)
    ask = F.lit(None).cast("string")
    for c in reversed(known[:4]):
        ask = F.when(F.col(c).isNull(), c).otherwise(ask)
    return rows.select("id", score.cast("int").alias("confidence"), ask.alias("ask_next"))


#: The part of its weight that an inferred value earns, the order of asking.
INFERRED = 0.6
ASKED = ["intent", "product", "country", "certificates"]


def state_confidence(states: DataFrame) -> DataFrame:
    """states (id, and for each field `explicit`, `inferred` or `missing`; null is missing) -> confidence of 0 to 100,
    halves rounded up, and the first field to ask for."""
    part = lambda c: F.when(F.col(c) == "explicit", 1.0).when(F.col(c) == "inferred", INFERRED).otherwise(0.0)
    score = sum(part(c) * w for c, w in CONFIDENCE.items())
    missing = F.coalesce(*[F.when(F.coalesce(F.col(c), F.lit("missing")) == "missing", c) for c in ASKED])
    return states.select("id", F.floor(F.round(score, 6) + 0.5).cast("int").alias("confidence"), missing.alias("ask_next"))
