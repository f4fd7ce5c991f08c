"""Decisions and reviews carried out: provenance and companies that follow from decisions, review logs action by action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import registration_date
from .identity import fields
from .provenance import UNVERIFIED
from .records import apply_decisions


def refusal(status: Column, action: Column, note: Column) -> Column:
    """Why an action on a record of that status is refused; null where it is not."""
    return (
        F.when((action == "verify") & (status == "verified"), "already_verified")
        .when((action == "review") & ~status.isin(UNVERIFIED), "not_reviewable")
        .when((action == "reject") & (status == "verified"), "verified_is_not_rejected")
        .when((action == "reject") & status.isin("rejected", "expired"), F.concat(F.lit("already_"), status))
        .when((action == "reject") & (F.coalesce(note, F.lit("")) == ""), "note_needed")
        .when((action == "expire") & (status != "verified"), "not_verified")
        .when(~F.coalesce(action.isin("verify", "review", "reject", "expire"), F.lit(False)), "unknown_action")
    )


def outcome(action: Column) -> Column:
    return F.when(action == "verify", "verified").when(action == "review", "under_review").when(action == "reject", "rejected").otherwise("expired")


def review_log(records: DataFrame, actions: DataFrame) -> DataFrame:
    """actions (record_id, seq, action, note) in order of seq -> each with the status before and after it, and the reason
    where it is refused; actions on unknown records are refused too."""
    log = actions.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("seq", "action", "note"))).alias("log"))

    def step(state: Column, a: Column) -> Column:
        why = F.when(state["s"].isNull(), "unknown_record").otherwise(refusal(state["s"], a["action"], a["note"]))
        new = F.when(why.isNull(), outcome(a["action"])).otherwise(state["s"])
        entry = F.struct(a["seq"].alias("seq"), a["action"].alias("action"), a["note"].alias("note"), state["s"].alias("previous_status"), new.alias("status"), why.alias("reason"))
        return F.struct(new.alias("s"), F.concat(state["out"], F.array(entry)).alias("out"))

    empty = F.array().cast("array<struct<seq:bigint,action:string,note:string,previous_status:string,status:string,reason:string>>")
    walked = F.aggregate("log", F.struct(F.col("status").alias("s"), empty.alias("out")), step, lambda x: x["out"])
    known = log.join(records.select("record_id", "status"), "record_id", "left")
    return known.select("record_id", F.explode(walked).alias("x")).select("record_id", "x.*")


def replay(records: DataFrame, actions: DataFrame) -> DataFrame:
    """Final status of every record, with the number of its actions and of those refused; none for most."""
    per = review_log(records, actions).groupBy("record_id").agg(F.max_by("status", "seq").alias("last"), F.count(F.lit(1)).alias("actions"), F.count("reason").alias("refused"))
    out = records.select("record_id", F.col("status").alias("previous_status")).join(per, "record_id", "left")
    return out.select("record_id", "previous_status", F.coalesce("last", "previous_status").alias("status"), F.coalesce("actions", F.lit(0)).alias("actions"), F.coalesce("refused", F.lit(0)).alias("refused"))


def audit(log: DataFrame) -> DataFrame:
    """An event for each accepted action; a verification is attributed on its record and has none."""
    event = F.when(F.col("action") == "review", "provenance_marked_under_review").when(F.col("action") == "reject", "provenance_rejected").when(F.col("action") == "expire", "provenance_marked_expired")
    return log.where("reason IS NULL AND action <> 'verify'").select("record_id", "seq", event.alias("event"), "previous_status", "status", F.when(F.col("action") != "review", F.col("note")).alias("reason"))


def promoted(identities: DataFrame, content: DataFrame, companies: DataFrame) -> DataFrame:
    """What becomes of each identity (observation_id, strong_id, name, ...): created, duplicate_strong_id (held by a
    company, or by a usable observation before it) or missing_name; created ones as a company's fields.

    The strong id is checked before the name. Of a strong id the first usable observation is found by one aggregate.
    """
    taken = companies.where("cin IS NOT NULL").select(F.col("cin").alias("strong_id"), F.lit(True).alias("known")).distinct()
    usable = F.coalesce(F.col("name"), F.lit("")) != ""
    first = identities.where(usable & F.coalesce(F.col("strong_id"), F.lit("")).__ne__("")).groupBy("strong_id").agg(F.min("observation_id").alias("first"))
    out = identities.join(taken, "strong_id", "left").join(first, "strong_id", "left").join(content.select("observation_id", "content"), "observation_id", "left")
    again = F.coalesce(F.col("strong_id"), F.lit("")).__ne__("") & (F.col("known").isNotNull() | F.coalesce(F.col("first") < F.col("observation_id"), F.lit(False)))
    state = F.when(again, "duplicate_strong_id").when(~usable, "missing_name").otherwise("created")
    made = lambda c: F.when(state == "created", c)
    date = registration_date(F.try_element_at("content", F.lit("date_of_registration")))
    kept = [made(F.col(c)).alias(c) for c in ("name", "industry", "country", "state", "city", "website")]
    return out.select("observation_id", state.alias("outcome"), made(F.col("name")).alias("legal_name"), made(F.nullif("strong_id", F.lit(""))).alias("cin"), *kept, made(date).alias("registered_on"))


def evidence(rows: DataFrame) -> DataFrame:
    """Provenance of fields (field_name, value_observed, kind): those read by rule are extracted, others observed."""
    direct = F.col("kind") == "direct"
    return rows.withColumns({"extraction_method": F.when(direct, "rule_based").otherwise("manual"), "confidence": F.when(direct, 0.8).otherwise(0.5), "status": F.when(direct, "extracted").otherwise("observed")}).drop("kind")


def carried_out(candidates: DataFrame, decisions: DataFrame, profiled: DataFrame, identities: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(companies, provenance) that follow from the accepted decisions.

    create_new promotes the observation; confirm_match adds the observation's fields to the candidate's company, never a
    company; what is promoted gets its fields too, under the observation's id as long as the company has none.
    """
    accepted = apply_decisions(candidates, decisions).where("reason IS NULL").select("observation_id", "effect")
    new = promoted(identities.join(accepted.where("effect = 'promotion'"), "observation_id", "left_semi"), profiled, companies)
    confirmed = accepted.where("effect = 'provenance'").join(candidates.select("observation_id", "company_id"), "observation_id").select("observation_id", "company_id")
    created = new.where("outcome = 'created'").select("observation_id", F.lit(None).cast("bigint").alias("company_id"))
    rows = evidence(fields(profiled).join(confirmed.union(created), "observation_id"))
    return new, rows.select("observation_id", "company_id", "field_name", "value_observed", "extraction_method", "confidence", "status")


def loose_links(links: DataFrame) -> DataFrame:
    """links (link_id, object_type, <type>_object_id ...): those that do not hold exactly the one object of their type."""
    objects = [c for c in links.columns if c.endswith("_object_id")]
    held = sum(F.col(c).isNotNull().cast("int") for c in objects)
    own = F.coalesce(*[F.when(F.col("object_type") == c.removesuffix("_object_id"), F.col(c).isNotNull()) for c in objects], F.lit(False))
    return links.where((held != 1) | ~own).select(F.lit("not_exactly_one_object").alias("rule"), F.col("link_id").alias("entity_id"))


def owners(members: DataFrame) -> DataFrame:
    """Companies with several owners, and memberships held twice."""
    several = members.where("role = 'owner'").groupBy("company_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("several_owners").alias("rule"), F.col("company_id").alias("entity_id"))
    twice = members.groupBy("company_id", "user_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated_member").alias("rule"), F.col("company_id").alias("entity_id"))
    return several.union(twice)
