"""Life of candidates, relationships, documents and sessions: keyed joins, first or last of a key, and short logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .provenance import UNVERIFIED


def new_candidates(decided: DataFrame, existing: DataFrame) -> DataFrame:
    """One candidate an observation; one that exists stays as it is."""
    return decided.join(existing.select("observation_id"), "observation_id", "left_anti")


def candidate_list(candidates: DataFrame, state: str, page: int = 1, size: int = 50) -> DataFrame:
    return candidates.where(F.col("state") == state).orderBy(F.desc("created_at"), F.desc("observation_id")).offset((page - 1) * size).limit(size)


def apply_decisions(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each decision (observation_id, seq, decision) with what it does: the first legal one of an undecided candidate
    counts, all others are refused with a reason."""
    out = decisions.join(candidates.select("observation_id", "company_id", F.col("decision").alias("earlier"), F.lit(True).alias("known")), "observation_id", "left")
    lacking = (F.col("decision") == "confirm_match") & F.col("company_id").isNull()
    legal = F.col("known") & F.col("earlier").isNull() & ~lacking
    before = Window.partitionBy("observation_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("decided", F.coalesce(F.max(F.coalesce(legal, F.lit(False))).over(before), F.lit(False)))
    effect = F.when(F.col("decision") == "confirm_match", "provenance").when(F.col("decision") == "create_new", "promotion").otherwise("recorded")
    reason = F.when(F.col("known").isNull(), "unknown_candidate").when(F.col("earlier").isNotNull() | F.col("decided"), "already_decided").when(lacking, "no_company")
    return out.select("observation_id", "seq", "decision", F.when(reason.isNull(), effect).alias("effect"), reason.alias("reason"))


def run_report(jobs: DataFrame, events: DataFrame, candidates: DataFrame) -> DataFrame:
    """A row for each job: outcomes of its items and states of their candidates."""
    outcome = {k: F.count_if(F.col("outcome") == k).alias(k) for k in ("created", "skipped_duplicate", "failed")}
    states = {s: F.count_if(F.col("state") == s).alias(s.lower()) for s in ("AUTO_MATCH", "REVIEW_REQUIRED", "NEW", "NO_MATCH")}
    per = events.join(candidates.select("observation_id", "state"), "observation_id", "left").groupBy("job_id").agg(*outcome.values(), *states.values())
    names = [*outcome, *[s.lower() for s in states]]
    return jobs.select("job_id", "collector").join(per, "job_id", "left").select("job_id", "collector", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def allowed_jobs(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Production data only from sources whose policy allows it; of sources of one name the first counts."""
    first = sources.groupBy("name").agg(F.min_by("policy", "source_id").alias("policy"))
    out = jobs.join(first, F.col("source_name") == F.col("name"), "left")
    return out.select("job_id", (~F.col("production") | F.coalesce(F.col("policy") == "allowed", F.lit(False))).alias("admitted"))


def by_capability(relationships: DataFrame, companies: DataFrame, capability: int, city: str | None = None, verified_only: bool = False) -> DataFrame:
    out = relationships.where((F.col("relationship") == "has_capability") & (F.col("object_id") == capability))
    out = out.where("status = 'verified'") if verified_only else out
    place = companies.where(F.col("city") == city) if city else companies
    return out.join(place.select("company_id"), "company_id").select("company_id", "relationship_id")


def memberships(companies: DataFrame, members: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, company_id, place, member_count, owner_email_verified): a user's live companies, newest first."""
    per = members.groupBy("company_id").agg(F.count(F.lit(1)).alias("member_count"), F.min(F.when(F.col("role") == "owner", F.col("user_id"))).alias("owner"))
    live = companies.where("status <> 'archived'").select("company_id").join(per, "company_id").join(users.select(F.col("user_id").alias("owner"), F.col("email_verified").alias("owner_email_verified")), "owner", "left")
    newest = Window.partitionBy("user_id").orderBy(F.desc("company_id"))
    out = members.select("user_id", "company_id").join(live, "company_id").withColumn("place", F.row_number().over(newest))
    return out.select("user_id", "company_id", "place", "member_count", F.coalesce("owner_email_verified", F.lit(False)).alias("owner_email_verified"))


def lineage(records: DataFrame) -> DataFrame:
    """Every company's records, newest first."""
    newest = Window.partitionBy("company_id").orderBy(F.desc("last_observed_at"), F.desc("record_id"))
    return records.select("company_id", "record_id", "field_name", "status", F.row_number().over(newest).alias("place"))


def versions(documents: DataFrame) -> DataFrame:
    """documents (document_id, chain, uploaded_at) -> version, the document that replaced it, and whether it is current."""
    chain = Window.partitionBy("chain").orderBy("uploaded_at", "document_id")
    out = documents.withColumns({"version": F.row_number().over(chain), "replaced_by": F.lead("document_id").over(chain)})
    return out.select("document_id", "chain", "version", "replaced_by", F.col("replaced_by").isNull().alias("is_current"))


def last_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; one aggregate, so a hot key is combined before it is sent."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def first_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each row, and whether it is the first of its key (later ones are refused)."""
    first = rows.groupBy(*keys).agg(F.min(order).alias("first_of_key"))
    return rows.join(first, keys).withColumn("accepted", F.col(order) == F.col("first_of_key")).drop("first_of_key")


def evidence_links(records: DataFrame, links: DataFrame, documents: DataFrame) -> DataFrame:
    """links (record_id, document_id): the record's expiry follows its document's, its status does not change."""
    out = links.join(records.select("record_id", "status"), "record_id").join(documents.select("document_id", "expiry_date", F.lit(True).alias("known")), "document_id", "left")
    found = F.col("known").isNotNull()
    return out.select("record_id", "document_id", "status", F.when(found, F.col("expiry_date").cast("timestamp_ntz")).alias("expires_at"), F.when(~found, "unknown_document").alias("reason"))


def resolve_conflicts(conflicts: DataFrame, notes: DataFrame) -> DataFrame:
    """Open conflicts with a note are resolved; values stay as they are."""
    first = notes.where("note <> ''").groupBy("conflict_id").agg(F.min("note").alias("note"))
    return conflicts.join(first, "conflict_id", "left").select("conflict_id", F.when(F.col("note").isNotNull(), "resolved").otherwise("open").alias("status"), "note")


def review_relationships(relationships: DataFrame, actions: DataFrame) -> DataFrame:
    """Each action (relationship_id, seq, action, note) with the status before and after, and whether it was accepted.

    verify: not twice; reject: with a note, not once verified or rejected. Created rows of another status are refused.
    """
    log = actions.groupBy("relationship_id").agg(F.array_sort(F.collect_list(F.struct("seq", "action", "note"))).alias("log"))

    def step(state: Column, a: Column) -> Column:
        s = state["s"]
        ok = ((a["action"] == "verify") & (s != "verified")) | ((a["action"] == "reject") & ~s.isin("verified", "rejected") & (F.coalesce(a["note"], F.lit("")) != ""))
        new = F.when(ok, F.when(a["action"] == "verify", "verified").otherwise("rejected")).otherwise(s)
        entry = F.struct(a["seq"].alias("seq"), a["action"].alias("action"), s.alias("previous_status"), new.alias("status"), ok.alias("accepted"))
        return F.struct(new.alias("s"), F.concat(state["out"], F.array(entry)).alias("out"))

    empty = F.array().cast("array<struct<seq:bigint,action:string,previous_status:string,status:string,accepted:boolean>>")
    walked = F.aggregate("log", F.struct(F.col("status").alias("s"), empty.alias("out")), step, lambda x: x["out"])
    usable = relationships.where(F.col("status").isin(UNVERIFIED))
    return usable.join(log, "relationship_id").select("relationship_id", F.explode(walked).alias("x")).select("relationship_id", "x.*")


def audit(review: DataFrame) -> DataFrame:
    """An event for each accepted action of a review."""
    name = F.concat(F.lit("relationship_"), F.when(F.col("action") == "verify", "verified").otherwise("rejected"))
    return review.where("accepted").select("relationship_id", "seq", name.alias("event"), "previous_status", "status")


def flag_pairs(relationships: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) of relationships -> both rows tagged with one conflict, named after the first's kind."""
    kind = relationships.select(F.col("relationship_id").alias("a"), "company_id", F.concat(F.lit("relationship:"), "relationship").alias("field_name"))
    both = pairs.join(kind, "a").join(relationships.select(F.col("relationship_id").alias("b")), "b")
    return both.select(F.explode(F.array("a", "b")).alias("relationship_id"), F.col("a").alias("conflict_id"), "company_id", "field_name")


def active_sessions(sessions: DataFrame, as_of, keep: DataFrame | None = None) -> DataFrame:
    """Live sessions of each user, newest activity first; with `keep` (user_id, session_id), those that a sign-out of
    all others revokes."""
    live = sessions.where(~F.col("revoked") & (F.col("expires_at") > F.lit(as_of)))
    if keep is not None:
        return live.join(keep, ["user_id", "session_id"], "left_anti").select("user_id", "session_id")
    newest = Window.partitionBy("user_id").orderBy(F.desc("last_used_at"), F.desc("session_id"))
    return live.select("user_id", "session_id", F.row_number().over(newest).alias("place"))


def sweep(sessions: DataFrame, tokens: DataFrame, as_of) -> DataFrame:
    """Sessions expired for more than a day, and how many tokens go with each."""
    gone = sessions.where(F.col("expires_at") < F.lit(as_of) - F.expr("INTERVAL 1 DAY")).select("session_id")
    per = tokens.join(gone, "session_id", "left_semi").groupBy("session_id").agg(F.count(F.lit(1)).alias("tokens"))
    return gone.join(per, "session_id", "left").select("session_id", F.coalesce("tokens", F.lit(0)).alias("tokens"))
