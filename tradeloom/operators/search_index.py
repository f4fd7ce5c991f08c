"""Substring search for whole tables of questions: an inverted index of short pieces, then exact verification.

A text that contains a term contains each piece of it, so a term needs the texts of its rarest piece only. Pieces have
three letters; terms of one or two letters are pieces themselves. Terms and texts meet by equal pieces, never all with
all; empty terms are no terms and find nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = 3
#: Places of a filter's hits that one task joins with the requirements that ask for it.
PART = 256


def pieces(c: Column, size: int) -> Column:
    """Distinct stretches of `size` letters; none of a shorter text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(c) - (size - 1), F.lit(1)))
    return F.when(F.length(c) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def containing(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """asked (asked), texts (text) -> (asked, text): each distinct term with the distinct texts that contain it."""
    asked = asked.where("asked <> ''").select("asked").distinct()
    every = F.flatten(F.array(*[pieces(F.col("text"), n) for n in range(1, PIECE + 1)]))
    postings = texts.where("text <> ''").select("text").distinct().select("text", F.explode(every).alias("piece"))
    own = F.when(F.length("asked") >= PIECE, pieces(F.col("asked"), PIECE)).otherwise(F.array("asked"))
    rows = asked.select("asked", F.explode(own).alias("piece")).join(postings.groupBy("piece").agg(F.count(F.lit(1)).alias("n")), "piece", "left")
    rarest = rows.groupBy("asked").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece"))  # a piece that no text has ends the search
    return rarest.join(postings, "piece").where(F.col("text").contains(F.col("asked"))).select("asked", "text")


def held(c: str, sign: str = "=") -> Column:
    """A filter as a key: a sign and the value, or nothing where any value will do."""
    return F.coalesce(F.concat(F.lit(sign), F.col(c)), F.lit(""))


def keyed_pairs(asked: DataFrame, name: str, texts: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """(ask, own): keys of one filter, with the keys of the values that satisfy it; no filter is satisfied by any.
    fields: sign of a field -> its columns; a hit in any of them counts for the first, whose value is the key."""
    out = asked.where(F.col(name).isNull()).select(F.lit("").alias("ask"), F.lit("").alias("own")).limit(1)
    for sign, columns in fields.items():
        some = texts.select(F.col(columns[0]).alias("own"), F.explode(F.array(*columns)).alias("text")).distinct()
        found = containing(asked.select(F.col(name).alias("asked")), some.select("text"))
        if len(columns) > 1:
            found = found.join(some, "text").select("asked", F.col("own").alias("text")).distinct()
        out = out.union(found.select(F.concat(F.lit(sign), "asked"), F.concat(F.lit(sign), "text")))
    return out


def first_of(rows: DataFrame, by: list[str], order: list[Column], most: int | None) -> DataFrame:
    """At most `most` rows of each group (None: all); what cannot be among them is dropped before the shuffle."""
    out = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if most is None else out.where(F.col("nth") <= most)


def pages(asked: DataFrame, live: DataFrame, also: list[str], page: int | None, size: int) -> tuple[DataFrame, DataFrame]:
    """asked (term, country, city: distinct filters, null where any will do) -> the total of each filter that finds any,
    and a page (None: every page) of its companies by name; by industry where that finds any, else by name.

    Companies are first brought together under the values that filters can name (or any value): a count and the first
    page * size names (all, where every page is asked for) of each combination. A filter then adds up combinations, never companies, so that a filter that
    nearly all companies satisfy costs no more than another. A company is in twelve combinations.
    """
    terms = F.array(held("own_industry", "i"), held("own_name", "n"), F.lit(""))
    spread = live.select("company_id", "shown", F.explode(terms).alias("g_term"), "own_country", "own_city")
    for c in ("country", "city"):
        spread = spread.withColumn(f"g_{c}", F.explode(F.array(held(f"own_{c}"), F.lit(""))))
    keys = ["g_term", "g_country", "g_city"]
    spread = spread.select("company_id", "shown", *keys).distinct()  # a null value is held as any value already
    counts = spread.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    order, most = [F.col("shown"), F.col("company_id")], page and page * size
    firsts = spread if most is None else first_of(spread, keys, order, most).drop("nth")
    wanted = asked.select(F.explode(F.array(held("term", "i"), held("term", "n"))).alias("a_term"), held("country").alias("a_country"), held("city").alias("a_city")).distinct()
    for c, fields in (("term", {"i": ["own_industry"], "n": ["own_name", *also]}), ("country", {"=": ["own_country"]}), ("city", {"=": ["own_city"]})):
        wanted = wanted.join(keyed_pairs(asked, c, live, fields).toDF(f"a_{c}", f"g_{c}"), f"a_{c}")
    wanted = wanted.withColumns({"term": F.expr("if(a_term = '', '', substring(a_term, 2))"), "by_name": F.col("a_term").startswith("n")})
    asks = ["term", "a_country", "a_city"]
    totals = wanted.join(counts, keys).groupBy(*asks).pivot("by_name", [False, True]).agg(F.sum("n")).toDF(*asks, "by_industry", "named")
    totals = totals.select(*asks, F.coalesce("by_industry", "named").alias("total"), F.col("by_industry").isNull().alias("by_name"))
    chosen = wanted.join(totals.select(*asks, "by_name"), [*asks, "by_name"])
    shown = first_of(chosen.join(firsts, keys).select(*asks, "shown", "company_id"), asks, order, most)
    shown = shown if page is None else shown.where(F.col("nth") > (page - 1) * size)
    value = lambda c: F.when(F.col(c) != "", F.expr(f"substring({c}, 2)")).alias(c[2:])
    named = [F.nullif("term", F.lit("")).alias("term"), value("a_country"), value("a_city")]
    return totals.select(*named, "total"), shown.select(*named, F.col("nth").alias("place"), "company_id")


def term_search(requirements: DataFrame, companies: DataFrame, page: int | None = 1, size: int = 20) -> DataFrame:
    """(requirement_id, place, company_id, matched_on, total, pages): one page of active companies (page None: all of
    them) for each requirement (requirement_id, term, country, city) that finds any, by name.

    Industry, country and city contain what is asked for; a requirement with a term and no hit is searched again with
    the name (or the slug, where companies have one) instead of the industry. Blank and null filters are left out.
    matched_on has the term where industry or name contains it, and country and city where they are equal. A page
    beyond the last has the total and no company. Equal filters are searched once.
    """
    clean = lambda c: F.lower(F.trim(c))
    asked = requirements.select("requirement_id", *[F.nullif(clean(F.col(c)), F.lit("")).alias(c) for c in ("term", "country", "city")])
    also = ["slug"] if "slug" in companies.columns else []
    live = companies.where("status = 'active'").select("company_id", F.col("name").alias("shown"), *[F.lower(c).alias(f"own_{c}") for c in ("name", "industry", "country", "city", *also)])
    filters = asked.select("term", "country", "city").distinct()
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"x.{c}")) for c in ("term", "country", "city")]
    totals, found = pages(filters, live, [f"own_{c}" for c in also], page, size)
    found = found.join(live.drop("shown"), "company_id", "left")
    kinds = {
        "term": F.col("own_industry").contains(F.col("term")) | F.col("own_name").contains(F.col("term")),
        "country": F.col("own_country") == F.col("country"),
        "city": F.col("own_city") == F.col("city"),
    }
    part = F.floor((F.col("place") - 1) / PART) if page is None else F.lit(0).cast("bigint")
    found = found.select("term", "country", "city", part.alias("part"), "place", "company_id", F.concat_ws(",", *[F.when(c, F.lit(k)) for k, c in kinds.items()]).alias("matched_on"))
    last = F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("bigint").alias("pages")
    # a filter that many ask for has its hits dealt to tasks by place, else one task would give all their rows
    parts = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("total") - 1) / PART)) if page is None else F.array(F.lit(0).cast("bigint"))
    each = asked.alias("f").join(totals.alias("x"), same).select("requirement_id", *[f"f.{c}" for c in ("term", "country", "city")], "total", F.explode(parts).alias("part"))
    out = each.alias("f").join(found.alias("x"), [*same, F.col("f.part") == F.col("x.part")], "left")
    return out.select("requirement_id", "place", "company_id", F.coalesce("matched_on", F.lit("")).alias("matched_on"), "total", last)


def discover_terms(terms: DataFrame, companies: DataFrame, per_field: int = 50) -> DataFrame:
    """terms (term) -> (term, company_id, matched_fields, n_fields, rank): for each distinct trimmed term of two letters
    or more, the newest `per_field` hits of each field, merged by company and ranked by the fields hit."""
    fields = {"name": ["name", "slug"] if "slug" in companies.columns else ["name"], "industry": ["industry"], "city": ["city"], "country": ["country"]}
    asked = terms.select(F.trim("term").alias("shown"), F.lower(F.trim("term")).alias("asked")).where(F.length("asked") >= 2).distinct()
    live = companies.where("status = 'active'").select("company_id", *[F.lower(c).alias(c) for cs in fields.values() for c in cs])
    lists = None
    for i, columns in enumerate(fields.values()):
        values = live.select("company_id", F.explode(F.array(*columns)).alias("text")).distinct()
        hits = containing(asked, values.select("text")).join(values, "text").select("asked", "company_id").distinct()
        part = first_of(hits, ["asked"], [F.desc("company_id")], per_field).select("asked", "company_id", F.lit(i).alias("i"))
        lists = part if lists is None else lists.union(part)
    merged = lists.groupBy("asked", "company_id").agg(F.min("i").alias("first")).join(live, "company_id")
    hit = {f: F.coalesce(F.greatest(*[F.coalesce(F.col(c).contains(F.col("asked")), F.lit(False)) for c in columns]) if len(columns) > 1 else F.col(columns[0]).contains(F.col("asked")), F.lit(False)) for f, columns in fields.items()}
    merged = merged.withColumns({f"hit_{f}": c for f, c in hit.items()}).withColumn("n_fields", sum(F.col(f"hit_{f}").cast("int") for f in fields))
    order = Window.partitionBy("asked").orderBy(F.desc("n_fields"), "first", F.desc("company_id"))
    ranked = merged.withColumn("rank", F.row_number().over(order))  # at most four lists of per_field in a group
    names = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"hit_{f}"), F.lit(f)) for f in fields])), ",")
    return asked.join(ranked, "asked").select(F.col("shown").alias("term"), "company_id", names.alias("matched_fields"), "n_fields", "rank")
