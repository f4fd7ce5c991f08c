"""Queries over decisions and reviews that are carried out, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import decisions, identity, resolve
from ..sources.fixtures import FIXTURES, ctes
from . import collected, records
from .over import over
from .twins import SIGNALS

QUERIES, ORACLES = {}, {}


def query(name: str, tables: list[str], f, twin: str, recursive: bool = False) -> None:
    QUERIES[name] = over(*tables)(f)
    ORACLES[name] = (ctes(*tables) if twin.startswith((",", " SELECT")) else "") + twin
    if recursive:
        ORACLES[name] = ORACLES[name].replace("WITH ", "WITH RECURSIVE ", 1)


_WHY = """CASE WHEN {a} = 'verify' AND {s} = 'verified' THEN 'already_verified' WHEN {a} = 'review' AND {s} NOT IN ('observed', 'extracted', 'claimed') THEN 'not_reviewable' WHEN {a} = 'reject' AND {s} = 'verified' THEN 'verified_is_not_rejected'
  WHEN {a} = 'reject' AND {s} IN ('rejected', 'expired') THEN 'already_' || {s} WHEN {a} = 'reject' AND coalesce({n}, '') = '' THEN 'note_needed' WHEN {a} = 'expire' AND {s} <> 'verified' THEN 'not_verified' END"""
_NOW = "CASE WHEN w.reason IS NULL THEN CASE w.action WHEN 'verify' THEN 'verified' WHEN 'review' THEN 'under_review' WHEN 'reject' THEN 'rejected' ELSE 'expired' END ELSE w.previous_status END"
LOG = f""", w AS (
  SELECT record_id, seq, action, note, status AS previous_status, {_WHY.format(a='action', s='status', n='note')} AS reason FROM provenance JOIN provenance_actions USING (record_id) WHERE seq = 0
  UNION ALL SELECT a.record_id, a.seq, a.action, a.note, {_NOW}, {_WHY.format(a='a.action', s='(' + _NOW + ')', n='a.note')} FROM w JOIN provenance_actions a ON a.record_id = w.record_id AND a.seq = w.seq + 1
), log AS (SELECT record_id, seq, action, note, previous_status, {_NOW} AS status, reason FROM w)"""
REVIEWED = ["provenance", "provenance_actions"]
query("provenance_review", REVIEWED, decisions.review_log, LOG + " SELECT * FROM log", True)
query("review_replay", REVIEWED, decisions.replay, LOG + " SELECT p.record_id, p.status AS previous_status, coalesce(arg_max(l.status, l.seq), p.status) AS status, count(l.seq) AS actions, count(l.reason) AS refused FROM provenance p LEFT JOIN log l USING (record_id) GROUP BY p.record_id, p.status", True)
query("provenance_audit", REVIEWED, lambda p, a: decisions.audit(decisions.review_log(p, a)), LOG + " SELECT record_id, seq, CASE action WHEN 'review' THEN 'provenance_marked_under_review' WHEN 'reject' THEN 'provenance_rejected' ELSE 'provenance_marked_expired' END AS event, previous_status, status, CASE WHEN action <> 'review' THEN note END AS reason FROM log WHERE reason IS NULL AND action <> 'verify'", True)

DECIDED = ["resolution_candidates", "decisions", *collected.LANDED, "companies"]
_TAKEN = f"""WITH ident AS ({collected.ORACLES['source_identities']}), known_fields AS ({collected.ORACLES['source_fields']}), dec AS ({records.ORACLES['decisions_applied']}), cand AS ({FIXTURES['resolution_candidates']}), bodies AS ({FIXTURES['collected']}), own AS ({FIXTURES['companies']}
), asked AS (SELECT i.*, json_extract_string(body, '$.date_of_registration') AS d FROM ident i JOIN dec USING (observation_id) JOIN bodies USING (observation_id) WHERE effect = 'promotion'
), new AS (SELECT *, coalesce(strong_id, '') <> '' AND (strong_id IN (SELECT cin FROM own WHERE cin IS NOT NULL) OR EXISTS (SELECT 1 FROM asked b WHERE b.strong_id = a.strong_id AND b.observation_id < a.observation_id AND coalesce(b.name, '') <> '')) AS again, coalesce(name, '') <> '' AS usable FROM asked a)"""


def outcome_of(which: int):
    def run(candidates: DataFrame, taken: DataFrame, landed: DataFrame, events: DataFrame, jobs: DataFrame, companies: DataFrame) -> DataFrame:
        profiled = collected.profiled(landed, events, jobs)
        return decisions.carried_out(candidates, taken, profiled, identity.identities(profiled), companies)[which]

    return run


query("decision_companies", DECIDED, outcome_of(0), _TAKEN + """ SELECT observation_id, CASE WHEN again THEN 'duplicate_strong_id' WHEN NOT usable THEN 'missing_name' ELSE 'created' END AS outcome,
""" + ", ".join(f"CASE WHEN usable AND NOT again THEN {e} END AS {c}" for c, e in {"legal_name": "name", "cin": "nullif(strong_id, '')", **{c: c for c in ("name", "industry", "country", "state", "city", "website")}, "registered_on": "CAST(coalesce(try_strptime(d, '%d/%m/%Y'), try_strptime(d, '%Y-%m-%d'), try_strptime(d, '%d-%m-%Y')) AS DATE)"}.items()) + " FROM new")
query("decision_provenance", DECIDED, outcome_of(1), _TAKEN + """, got AS (SELECT observation_id, company_id FROM dec JOIN cand USING (observation_id) WHERE effect = 'provenance' UNION ALL SELECT observation_id, NULL FROM new WHERE usable AND NOT again)
SELECT observation_id, company_id, field_name, value_observed, CASE kind WHEN 'direct' THEN 'rule_based' ELSE 'manual' END AS extraction_method, CASE kind WHEN 'direct' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS confidence, CASE kind WHEN 'direct' THEN 'extracted' ELSE 'observed' END AS status FROM known_fields JOIN got USING (observation_id)""")
query("integrity_links", ["relationship_links", "entered_members"], lambda r, m: decisions.loose_links(r).union(decisions.owners(m)), """ SELECT 'not_exactly_one_object' AS rule, link_id AS entity_id FROM relationship_links WHERE NOT ((object_type = 'factory' AND factory_object_id IS NOT NULL AND capability_object_id IS NULL) OR (object_type = 'capability' AND capability_object_id IS NOT NULL AND factory_object_id IS NULL))
UNION ALL SELECT 'several_owners', company_id FROM entered_members WHERE role = 'owner' GROUP BY company_id HAVING count(*) > 1 UNION ALL SELECT 'repeated_member', company_id FROM entered_members GROUP BY company_id, user_id HAVING count(*) > 1""")


def other_form(observations: DataFrame, companies: DataFrame, foreign: DataFrame) -> DataFrame:
    """Names in two Unicode forms on the two sides."""
    name = F.replace(F.col("name"), F.lit("e"), F.when(F.col("observation_id") % 2 == 0, "\u00e9").otherwise("e\u0301"))
    theirs = companies.drop("name").join(foreign, "company_id")
    return resolve.exact_signals(observations.withColumn("name", name), theirs).select("observation_id", "signal", "company_id")


_FORMS = """, observations_ AS (SELECT * REPLACE (nfc_normalize(replace(name, 'e', CASE WHEN observation_id % 2 = 0 THEN '\u00e9' ELSE 'e\u0301' END)) AS name) FROM observations), companies_ AS (SELECT c.* REPLACE (nfc_normalize(f.name) AS name) FROM companies c JOIN foreign_names f USING (company_id))"""
query("resolve_foreign", ["observations", "companies", "foreign_names"], other_form, _FORMS + SIGNALS.replace("FROM observations", "FROM observations_").replace("FROM companies", "FROM companies_") + " SELECT observation_id, signal, company_id FROM signals")
