"""Queries over the records around companies, each with its SQL twin."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import extract, graph, records, trust, validation
from ..sources.fixtures import ctes
from .over import over
from .twins import SCORES

AS_OF = datetime(2024, 1, 20)
AT = "TIMESTAMP '2024-01-20 00:00:00'"
COMPLETE = """, e AS (SELECT id, text, lower(text) AS low, nullif(regexp_extract(text, '\\b\\d{1,3}(?:,\\d{3})*\\b'), '') AS num FROM buyer_texts), f AS (
  SELECT id, text, CASE """ + " ".join(f"WHEN {' OR '.join(f'contains(low, {w!r})' for w in ws)} THEN '{k}'" for k, ws in extract.ROLES.items()) + """ END AS intent,
  CASE """ + " ".join(f"WHEN contains(low, '{c}') THEN '{c}'" for c in extract.COUNTRIES) + """ END AS place, CASE WHEN length(replace(num, ',', '')) >= 2 THEN num END AS quantity,
  nullif(concat_ws(',', """ + ", ".join(f"CASE WHEN regexp_matches(text, '(?i)\\b{k}\\b') THEN '{v}' END" for k, v in extract.CERTIFICATES.items()) + """), '') AS certificates,
  trim(text) AS r0 FROM e), g AS (SELECT *, trim(CASE """ + " ".join("WHEN starts_with(lower(r0), '{0}') THEN substr(r0, {1})".format(p.replace("'", "''"), len(p) + 1) for p in extract.OPENINGS) + " ELSE r0 END) AS r1 FROM f), "
_r = "r1"
for _w in [w for ws in extract.ROLES.values() for w in ws]:
    _r = f"trim(regexp_replace({_r}, '\\b{_w}s?\\b', '', 'gi'))"
COMPLETE += f"h AS (SELECT *, {_r} AS r2 FROM g), k AS (SELECT *, CASE " + " ".join(f"WHEN place = '{c}' THEN trim(regexp_replace(r2, '\\b{c}\\b', '', 'gi'))" for c in extract.COUNTRIES) + " ELSE r2 END AS r3 FROM h), "
COMPLETE += """l AS (SELECT *, trim(regexp_replace(trim(regexp_replace(r3, '\\s+(in|for|from|at|near)\\s*$', '', 'i')), '[.,!?]+$', '')) AS r4 FROM k), x AS (
  SELECT id, intent, array_to_string(list_transform(string_split(place, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS country, quantity, certificates, CASE WHEN length(r4) >= 2 THEN r4 END AS product FROM l)"""

QUERIES, ORACLES = {}, {}


def query(name: str, tables: list[str], f, twin: str) -> None:
    QUERIES[name] = over(*tables)(f)
    ORACLES[name] = ctes(*tables) + " " + twin


query("candidates_new", ["job_events", "resolution_candidates"], lambda e, c: records.new_candidates(e.select("observation_id", "outcome"), c), "SELECT observation_id, outcome FROM job_events WHERE observation_id NOT IN (SELECT observation_id FROM resolution_candidates)")
query("candidate_list", ["resolution_candidates"], lambda c: records.candidate_list(c, "REVIEW_REQUIRED", 2, 20), "SELECT * FROM resolution_candidates WHERE state = 'REVIEW_REQUIRED' ORDER BY created_at DESC, observation_id DESC LIMIT 20 OFFSET 20")
query("decisions_applied", ["resolution_candidates", "decisions"], records.apply_decisions, """, j AS (SELECT d.*, c.company_id, c.decision AS earlier, c.observation_id IS NOT NULL AS known FROM decisions d LEFT JOIN resolution_candidates c USING (observation_id)
), w AS (SELECT *, known AND earlier IS NULL AND NOT (decision = 'confirm_match' AND company_id IS NULL) AS legal FROM j), f AS (SELECT observation_id, min(seq) AS first FROM w WHERE legal GROUP BY 1
), r AS (SELECT w.*, CASE WHEN NOT known THEN 'unknown_candidate' WHEN earlier IS NOT NULL OR seq > first THEN 'already_decided' WHEN decision = 'confirm_match' AND company_id IS NULL THEN 'no_company' END AS reason FROM w LEFT JOIN f USING (observation_id))
SELECT observation_id, seq, decision, CASE WHEN reason IS NULL THEN CASE decision WHEN 'confirm_match' THEN 'provenance' WHEN 'create_new' THEN 'promotion' ELSE 'recorded' END END AS effect, reason FROM r""")
query("run_report", ["jobs", "job_events", "resolution_candidates"], records.run_report, "SELECT j.job_id, collector, " + ", ".join(f"count(*) FILTER (outcome = '{k}') AS {k}" for k in ("created", "skipped_duplicate", "failed")) + ", " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s.lower()}" for s in ("AUTO_MATCH", "REVIEW_REQUIRED", "NEW", "NO_MATCH")) + " FROM jobs j LEFT JOIN job_events e ON e.job_id = j.job_id LEFT JOIN resolution_candidates c USING (observation_id) GROUP BY 1, 2")
query("source_policy", ["jobs", "sources"], records.allowed_jobs, "SELECT job_id, NOT production OR coalesce((SELECT policy FROM sources WHERE name = source_name ORDER BY source_id LIMIT 1) = 'allowed', false) AS admitted FROM jobs")
query("capability_companies", ["relationships", "companies"], lambda r, c: records.by_capability(r, c, 2, "Lyon", True), "SELECT company_id, relationship_id FROM relationships JOIN companies USING (company_id) WHERE relationship = 'has_capability' AND object_id = 2 AND city = 'Lyon' AND relationships.status = 'verified'")
query("capability_everywhere", ["relationships", "companies"], lambda r, c: records.by_capability(r, c, 2), "SELECT company_id, relationship_id FROM relationships JOIN companies USING (company_id) WHERE relationship = 'has_capability' AND object_id = 2")
query("company_graph", ["offerings", "relationships"], graph.company_graph, "SELECT company_id, CASE role WHEN 'manufacturer' THEN 'manufactures' WHEN 'distributor' THEN 'distributes' WHEN 'supplier' THEN 'supplies' WHEN 'exporter' THEN 'exports' ELSE 'services' END AS relationship, 'product' AS object_type, product_id AS object_id FROM offerings WHERE status = 'active' UNION ALL SELECT company_id, relationship, object_type, object_id FROM relationships")
query("memberships", ["companies", "company_members", "users"], records.memberships, """, live AS (SELECT company_id FROM companies WHERE status <> 'archived'), n AS (SELECT company_id, count(*) AS member_count FROM company_members GROUP BY 1), o AS (SELECT company_id, bool_or(email_verified) AS ok FROM company_members JOIN users USING (user_id) WHERE role = 'owner' GROUP BY 1)
SELECT user_id, company_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY company_id DESC) AS INTEGER) AS place, member_count, coalesce(ok, false) AS owner_email_verified FROM company_members JOIN live USING (company_id) JOIN n USING (company_id) LEFT JOIN o USING (company_id)""")
query("provenance_lineage", ["provenance"], records.lineage, "SELECT company_id, record_id, field_name, status, CAST(row_number() OVER (PARTITION BY company_id ORDER BY last_observed_at DESC, record_id DESC) AS INTEGER) AS place FROM provenance")
query("document_versions", ["document_uploads"], records.versions, "SELECT document_id, chain, CAST(row_number() OVER w AS INTEGER) AS version, lead(document_id) OVER w AS replaced_by, lead(document_id) OVER w IS NULL AS is_current FROM document_uploads WINDOW w AS (PARTITION BY chain ORDER BY uploaded_at, document_id)")
query("social_links_last", ["social_links"], lambda s: records.last_by(s.groupBy("company_id", "platform", "written").agg(F.max("url").alias("url")), ["company_id", "platform"], "written"), "SELECT company_id, platform, written, url FROM (SELECT company_id, platform, written, max(url) AS url FROM social_links GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY company_id, platform ORDER BY written DESC) = 1")
query("offerings_first", ["offering_requests"], lambda o: records.first_by(o, ["company_id", "product_id"], "asked"), "SELECT company_id, product_id, asked, asked = min(asked) OVER (PARTITION BY company_id, product_id) AS accepted FROM offering_requests")
query("evidence_links", ["provenance", "evidence", "document_uploads"], records.evidence_links, "SELECT record_id, e.document_id, p.status, CASE WHEN d.document_id IS NOT NULL THEN CAST(expiry_date AS TIMESTAMP) END AS expires_at, CASE WHEN d.document_id IS NULL THEN 'unknown_document' END AS reason FROM evidence e JOIN provenance p USING (record_id) LEFT JOIN document_uploads d ON d.document_id = e.document_id")
query("conflicts_resolved", ["conflict_rows", "conflict_notes"], records.resolve_conflicts, ", n AS (SELECT conflict_id, min(note) AS note FROM conflict_notes WHERE note <> '' GROUP BY 1) SELECT conflict_id, CASE WHEN note IS NULL THEN 'open' ELSE 'resolved' END AS status, note FROM conflict_rows LEFT JOIN n USING (conflict_id)")
REVIEW = """, RECURSIVE_LOG AS (
  SELECT r.relationship_id, a.seq, a.action, r.status AS previous_status, a.action = 'verify' OR coalesce(a.note, '') <> '' AS accepted FROM relationships r JOIN relationship_actions a USING (relationship_id) WHERE a.seq = 0 AND r.status IN ('observed', 'extracted', 'claimed')
  UNION ALL SELECT w.relationship_id, a.seq, a.action, CASE WHEN w.accepted THEN CASE w.action WHEN 'verify' THEN 'verified' ELSE 'rejected' END ELSE w.previous_status END,
    CASE a.action WHEN 'verify' THEN CASE WHEN w.accepted THEN w.action <> 'verify' ELSE w.previous_status <> 'verified' END ELSE NOT w.accepted AND w.previous_status NOT IN ('verified', 'rejected') AND coalesce(a.note, '') <> '' END
  FROM RECURSIVE_LOG w JOIN relationship_actions a ON a.relationship_id = w.relationship_id AND a.seq = w.seq + 1
), reviewed AS (SELECT relationship_id, seq, action, previous_status, CASE WHEN accepted THEN CASE action WHEN 'verify' THEN 'verified' ELSE 'rejected' END ELSE previous_status END AS status, accepted FROM RECURSIVE_LOG)"""
query("relationship_review", ["relationships", "relationship_actions"], records.review_relationships, REVIEW + " SELECT * FROM reviewed")
query("relationship_audit", ["relationships", "relationship_actions"], lambda r, a: records.audit(records.review_relationships(r, a)), REVIEW + " SELECT relationship_id, seq, 'relationship_' || CASE action WHEN 'verify' THEN 'verified' ELSE 'rejected' END AS event, previous_status, status FROM reviewed WHERE accepted")
for _n in ("relationship_review", "relationship_audit"):
    ORACLES[_n] = ORACLES[_n].replace("WITH ", "WITH RECURSIVE ", 1)
query("relationship_conflicts", ["relationships", "relationship_pairs"], records.flag_pairs, ", p AS (SELECT a, b, company_id, 'relationship:' || relationship AS field_name FROM relationship_pairs JOIN relationships r ON r.relationship_id = a WHERE b IN (SELECT relationship_id FROM relationships)) SELECT a AS relationship_id, a AS conflict_id, company_id, field_name FROM p UNION ALL SELECT b, a, company_id, field_name FROM p")
query("active_sessions", ["auth_sessions"], lambda s: records.active_sessions(s, AS_OF), f"SELECT user_id, session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY last_used_at DESC, session_id DESC) AS INTEGER) AS place FROM auth_sessions WHERE NOT revoked AND expires_at > {AT}")
query("sessions_revoked", ["auth_sessions"], lambda s: records.active_sessions(s, AS_OF, s.groupBy("user_id").agg(F.max("session_id").alias("session_id"))), f"SELECT user_id, session_id FROM auth_sessions s WHERE NOT revoked AND expires_at > {AT} AND session_id <> (SELECT max(session_id) FROM auth_sessions x WHERE x.user_id = s.user_id)")
query("session_sweep", ["auth_sessions", "session_tokens"], lambda s, t: records.sweep(s, t, AS_OF), f"SELECT s.session_id, count(token_id) AS tokens FROM auth_sessions s LEFT JOIN session_tokens t USING (session_id) WHERE expires_at < {AT} - INTERVAL 1 DAY GROUP BY 1")
query("criteria_checked", ["criteria_requests", "requirements", "specifications"], validation.criteria, """, c AS (SELECT q.*, r.category_id, row_number() OVER (PARTITION BY requirement_id, q.specification ORDER BY n) AS nth FROM criteria_requests q LEFT JOIN requirements r USING (requirement_id)
), d AS (SELECT c.*, s.datatype, CASE operator WHEN 'range' THEN value IN ('[10,40]') WHEN 'in' THEN value IN ('[10,40]', '[40,10]', '["red","blue"]', '[1,"x"]') WHEN 'eq' THEN value IN ('5', '"red"') ELSE value = '5' END AS ok FROM c LEFT JOIN specifications s ON s.category_id = c.category_id AND s.specification = c.specification)
SELECT requirement_id, n, specification, operator, CASE WHEN NOT ok THEN 'value_shape' WHEN category_id IS NULL THEN 'category_required' WHEN nth > 1 THEN 'duplicate_specification' WHEN datatype IS NULL THEN 'unknown_specification' WHEN operator IN ('gte', 'lte', 'range') AND datatype <> 'number' THEN 'operator_of_other_type' END AS reason FROM d""")
query("attributes_checked", ["product_attributes", "products", "specifications"], validation.attributes, "SELECT product_id, a.specification, CASE WHEN p.category_id IS NULL THEN 'unknown_product' WHEN s.category_id IS NULL THEN 'not_in_category' END AS reason FROM product_attributes a LEFT JOIN products p USING (product_id) LEFT JOIN specifications s ON s.category_id = p.category_id AND s.specification = a.specification")
query("requirement_bounds", ["requirement_forms"], validation.requirement_fields, "SELECT requirement_id, concat_ws(',', CASE WHEN coalesce(length(raw_query) NOT BETWEEN 1 AND 5000, true) THEN 'raw_query' END, CASE WHEN length(industry) > 120 THEN 'industry' END, CASE WHEN length(country) > 120 THEN 'country' END, CASE WHEN length(state) > 120 THEN 'state' END, CASE WHEN length(city) > 120 THEN 'city' END, CASE WHEN length(quantity) > 120 THEN 'quantity' END, CASE WHEN length(budget) > 120 THEN 'budget' END, CASE WHEN length(timeline) > 120 THEN 'timeline' END, CASE WHEN extraction_confidence NOT BETWEEN 0 AND 1 THEN 'extraction_confidence' END) AS out_of_bounds FROM requirement_forms")
query("promotion_audit", ["promoted", "promoted_records"], validation.promotions, """, r AS (SELECT company_id, count(*) AS n, bool_or(status = 'verified') AS v, count(DISTINCT observation_id) AS k, min(observation_id) AS o FROM promoted_records GROUP BY 1), c AS (SELECT observation_id, count(DISTINCT company_id) AS n FROM promoted GROUP BY 1
), x AS (SELECT p.company_id, c.n = 1 AS one_company, NOT coalesce(v, false) AS none_verified, coalesce(k = 1 AND o = p.observation_id, false) AS tied, coalesce(r.n, 0) > 0 AS has_records FROM promoted p LEFT JOIN r USING (company_id) LEFT JOIN c USING (observation_id)) SELECT *, one_company AND none_verified AND tied AND has_records AS passed FROM x""")
query("buyer_requirements", ["buyer_texts"], extract.extracted, COMPLETE + " SELECT * FROM x")
query("buyer_completeness", ["buyer_texts"], lambda t: extract.completeness(extract.extracted(t)), COMPLETE + " SELECT id, CASE WHEN intent IS NULL THEN 0 ELSE 25 END + CASE WHEN product IS NULL THEN 0 ELSE 30 END + CASE WHEN country IS NULL THEN 0 ELSE 15 END + CASE WHEN certificates IS NULL THEN 0 ELSE 10 END + CASE WHEN quantity IS NULL THEN 0 ELSE 7 END AS confidence, CASE WHEN intent IS NULL THEN 'intent' WHEN product IS NULL THEN 'product' WHEN country IS NULL THEN 'country' WHEN certificates IS NULL THEN 'certificates' END AS ask_next FROM x")
query("search_trust", ["companies", "company_documents"], lambda c, d: graph.with_trust(graph.company_search(c, name="zone 1", size=50), trust.trust_scores(c, d)), SCORES + ", f AS (SELECT company_id, name, industry, country, count(*) OVER () AS total FROM companies WHERE status = 'active' AND name ILIKE '%zone 1%') SELECT company_id, name, score, level FROM (SELECT * FROM f ORDER BY name, company_id LIMIT 50) JOIN scores USING (company_id)")
