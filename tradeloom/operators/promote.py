"""New companies from resolved observations, with unique slugs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exact
from ..functions.text import slug
from .ranks import HEAVY, PARTS, heaviest, running_count


def promote(observations: DataFrame, companies: DataFrame) -> DataFrame:
    """outcome: created, duplicate_strong_id (known, or earlier in the batch) or missing_name."""
    taken = companies.where("cin IS NOT NULL").select(F.col("cin").alias("strong_id")).distinct().withColumn("known", F.lit(True))
    named = observations.withColumn("usable", F.coalesce(F.col("name"), F.lit("")) != "")
    first = named.where("usable").groupBy("strong_id").agg(F.min("observation_id").alias("first"))
    out = named.join(taken, "strong_id", "left").join(first, "strong_id", "left")
    again = F.col("strong_id").isNotNull() & (F.col("known").isNotNull() | F.coalesce(F.col("first") < F.col("observation_id"), F.lit(False)))
    return out.select("observation_id", "name", F.col("name").alias("legal_name"), F.col("strong_id").alias("cin"), F.when(~F.col("usable"), "missing_name").when(again, "duplicate_strong_id").otherwise("created").alias("outcome"))


def allocate_slugs(new: DataFrame, existing: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """new (id, name), existing (slug) -> (id, slug): base, base-2, ... in order of id, what is used left out.

    Names are read in Unicode form NFKD. A stem is a slug without its trailing numbers. Where no new base has such
    numbers, the k-th new row of a stem gets its k-th free number: k plus the used numbers t_i with t_i - i < k. All
    three counts are running counts, for stems of over `heavy` names in parts, so that none is a task of its own. Only stems with
    numbered bases, whose allocations meet each other, are walked row by row.
    """
    stem = F.regexp_replace("slug", "(-\\d+)+$", "")
    plain_text = exact.with_normalized(new.select("id", "name"), {"form": "name"}, "NFKD")
    rows = plain_text.select("id", slug(F.col("form")).alias("slug")).withColumn("stem", stem)
    held = existing.select("slug").distinct().withColumn("stem", stem)
    numbered = rows.where("slug <> stem").select("stem").distinct()
    plain, walked = rows.join(numbered, "stem", "left_anti"), rows.join(numbered, "stem", "left_semi")

    parts = PARTS if heaviest(rows.select("stem").union(held.select("stem")), ["stem"], heavy) else 1

    rest = F.expr("substring(slug, length(stem) + 2)")
    number = F.when(F.col("slug") == F.col("stem"), 1).when((F.length("slug") > F.length("stem")) & rest.rlike("^[1-9]\\d{0,8}$") & (rest != "1"), rest.try_cast("int"))
    used = running_count(held.withColumn("number", number).where("number IS NOT NULL").select("stem", "number"), ["stem"], "number", F.lit(True), "nth", parts)
    used = used.select("stem", F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("k"), (F.col("number") - F.col("nth") + 0.5).cast("double").alias("at"))
    asked = running_count(plain.select("stem", "id"), ["stem"], "id", F.lit(True), "k", parts).select("stem", "id", "k", F.col("k").cast("double").alias("at"))
    both = running_count(used.unionByName(asked), ["stem"], "at", F.col("k").isNull(), "before", parts).where("k IS NOT NULL")
    n = F.col("k") + F.col("before")
    done = both.select("id", F.when(n == 1, F.col("stem")).otherwise(F.concat("stem", F.lit("-"), n.cast("string"))).alias("slug"))

    def allocate(group: pd.DataFrame) -> pd.DataFrame:
        used = set(group.slug[group.id.isna()])
        out = []
        for i, base in group[group.id.notna()].sort_values("id")[["id", "slug"]].itertuples(index=False):
            name, n = base, 2
            while name in used:
                name, n = f"{base}-{n}", n + 1
            used.add(name)
            out.append((int(i), name))
        return pd.DataFrame(out, columns=["id", "slug"]).astype({"id": "int64", "slug": "object"})

    near = held.join(numbered, "stem", "left_semi").select(F.lit(None).cast("bigint").alias("id"), "slug", "stem")
    return done.union(walked.select("id", "slug", "stem").unionByName(near).groupBy("stem").applyInPandas(allocate, "id bigint, slug string"))
