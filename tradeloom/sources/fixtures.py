"""Domain tables derived from the star schema, as SQL that Spark and DuckDB read alike.

Each text is used twice: run by Spark to give an operator its rows, and as a CTE of the operator's SQL twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
CITY = "CASE CAST({0} % 5 AS INT) WHEN 0 THEN 'Pune' WHEN 1 THEN 'Surat' WHEN 2 THEN 'Oslo' WHEN 3 THEN 'Lyon' ELSE 'Graz' END"

FIXTURES: dict[str, str] = {
    "companies": f"""
SELECT s_suppkey AS company_id,
  p_name || ' ' || replace(lower(n_name), 'nation_', 'zone ') || CASE CAST(s_suppkey % 5 AS INT) WHEN 0 THEN ' Pvt. Ltd.' WHEN 1 THEN ' Private Limited' WHEN 2 THEN ' LLP' WHEN 3 THEN ' Inc.' ELSE '' END AS name,
  n_name AS country, r_name AS state, {CITY.format('s_suppkey')} AS city,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE p_type END AS industry,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'U' || CAST(s_suppkey AS STRING) END AS cin,
  CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'GST' || CAST(s_suppkey AS STRING) END AS gst_number,
  CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE 'https://www.s' || CAST(s_suppkey AS STRING) || '.example.com/' END AS website,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'private' END AS legal_entity_type,
  CASE WHEN s_suppkey % 4 = 1 THEN NULL ELSE 'manufacturer' END AS business_type,
  s_suppkey % 3 <> 1 AS has_registration_date, s_suppkey % 4 <> 2 AS has_categories, s_suppkey % 2 = 0 AS has_logo,
  s_suppkey % 3 = 0 AS has_cover, s_suppkey % 5 <> 1 AS has_descriptions, s_suppkey % 7 < 3 AS export_ready,
  CASE WHEN s_suppkey % 9 = 8 THEN 'archived' ELSE 'active' END AS status,
  CASE WHEN s_suppkey % 2 = 0 THEN 'verified' ELSE 'unverified' END AS verification_status,
  s_suppkey % 6 <> 5 AS owner_email_verified, s_suppkey % 3 = 2 AS has_social_link
FROM supplier JOIN part ON p_partkey = s_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "company_documents": """
SELECT s_suppkey AS company_id, k AS document_no,
  CASE k WHEN 0 THEN 'business_registration' WHEN 1 THEN 'factory_license' WHEN 2 THEN 'iso' ELSE 'ce' END AS document_type,
  CASE CAST((s_suppkey + k) % 4 AS INT) WHEN 0 THEN 'pending' WHEN 1 THEN 'verified' WHEN 2 THEN 'rejected' ELSE 'expired' END AS status,
  (s_suppkey + k) % 6 = 0 AS is_deleted
FROM supplier CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) kinds""",
    "products": """
SELECT p_partkey AS product_id, p_name AS name, p_type || '/' || p_brand AS category_id, p_type AS industry,
  CASE WHEN p_partkey % 10 = 0 THEN 'draft' ELSE 'published' END AS status FROM part""",
    "product_attributes": """
SELECT p_partkey AS product_id, 'size' AS specification, CASE WHEN p_partkey % 11 = 0 THEN CAST(p_size AS STRING) || ' mm' ELSE CAST(p_size AS STRING) END AS value FROM part WHERE p_partkey % 7 <> 0
UNION ALL SELECT p_partkey, 'price', CAST(CAST(p_retailprice AS BIGINT) AS STRING) FROM part WHERE p_partkey % 7 <> 0
UNION ALL SELECT p_partkey, 'color', split_part(p_name, ' ', 1) FROM part WHERE p_partkey % 7 <> 0""",
    "offerings": """
SELECT l_partkey * 100000 + l_suppkey AS offering_id, l_suppkey AS company_id, l_partkey AS product_id, min(l_shipdate) AS created_at,
  CASE CAST((l_partkey + l_suppkey) % 5 AS INT) WHEN 0 THEN 'manufacturer' WHEN 1 THEN 'distributor' WHEN 2 THEN 'supplier' WHEN 3 THEN 'exporter' ELSE 'service_provider' END AS role,
  CASE WHEN (l_partkey + l_suppkey) % 10 = 9 THEN 'inactive' ELSE 'active' END AS status,
  CASE WHEN l_suppkey % 4 = 0 THEN NULL WHEN l_suppkey % 8 = 1 THEN '' ELSE 'NATION_' || CAST(l_suppkey % 25 AS STRING) END AS country
FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "requirements": f"""
SELECT c_custkey AS requirement_id, CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE p_type || '/' || p_brand END AS category_id,
  CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE ' ' || lower(n_name) END AS country, CASE WHEN c_custkey % 4 < 2 THEN NULL ELSE r_name END AS state,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE {CITY.format('c_custkey')} END AS city, CAST(c_custkey % 4 AS INT) AS certificate_set,
  c_mktsegment || ' ' || c_name AS name
FROM customer JOIN part ON p_partkey = c_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "requirement_certificates": """
SELECT requirement_id, n, certificate FROM requirements JOIN (
  SELECT 1 AS cs, 0 AS n, 'ISO 9001' AS certificate UNION ALL SELECT 2, 0, 'CE mark' UNION ALL SELECT 2, 1, 'BIS'
  UNION ALL SELECT 3, 0, 'ISO' UNION ALL SELECT 3, 1, 'Factory license' UNION ALL SELECT 3, 2, 'certificate of nothing') c ON cs = certificate_set""",
    "criteria": """
SELECT c_custkey AS requirement_id, specification, operator, low, high, text_value FROM customer JOIN (
  SELECT 0 AS k, 'color' AS specification, 'eq' AS operator, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high, ' RED ' AS text_value
  UNION ALL SELECT 1, 'size', 'gte', 20.0, NULL, NULL UNION ALL SELECT 2, 'price', 'lte', 1500.0, NULL, NULL UNION ALL SELECT 4, 'color', 'in', NULL, NULL, 'Red|blue ' UNION ALL SELECT 1, 'size', 'eq', 25.0, NULL, NULL
  UNION ALL SELECT 3, 'size', 'range', 10.0, 40.0, NULL UNION ALL SELECT 3, 'price', 'lte', 1900.0, NULL, NULL) c ON c_custkey % 5 = k""",
    "provenance": """
SELECT o_orderkey AS record_id, CAST(floor(o_custkey / 15.0) AS BIGINT) AS company_id,
  CASE CAST(o_orderkey % 8 AS INT) WHEN 0 THEN 'name' WHEN 1 THEN 'cin' WHEN 2 THEN 'website' WHEN 3 THEN 'industry' WHEN 4 THEN 'country' WHEN 5 THEN 'gst_number' WHEN 6 THEN 'city' ELSE 'authorized_capital' END AS field_name,
  CASE WHEN o_orderkey % 8 < 4 THEN o_orderpriority ELSE 'same' END AS value_observed, o_orderdate AS last_observed_at,
  CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN 'verified' WHEN 1 THEN 'observed' WHEN 2 THEN 'extracted' WHEN 3 THEN 'claimed' WHEN 4 THEN 'under_review' WHEN 5 THEN 'rejected' ELSE 'expired' END AS status, (o_orderkey % 11) / 10.0 AS confidence
FROM orders""",
    "observations": f"""
SELECT c_custkey AS observation_id, base, v,
  CASE WHEN v = 7 THEN NULL WHEN v >= 8 THEN c_mktsegment || ' works ' || CAST(c_custkey AS STRING) WHEN v = 5 THEN 'other ' || c_mktsegment WHEN v = 6 THEN 'listed ' || CAST(c_custkey AS STRING)
       WHEN v = 4 THEN replace(c.name, 'e', '') WHEN v = 0 THEN c.name || ' Ltd' ELSE c.name END AS name,
  CASE WHEN v = 0 THEN c.cin WHEN v = 1 THEN 'X' || CAST(c_custkey AS STRING) END AS strong_id,
  CASE WHEN v = 5 THEN lower(c.website) END AS website, CASE WHEN v = 3 THEN c.state END AS state, CASE WHEN v = 3 THEN c.city END AS city, CASE WHEN v = 6 THEN 'R' || CAST(base AS STRING) END AS external_id
FROM (SELECT *, CAST(floor(c_custkey / 15.0) AS BIGINT) AS base, CAST(c_custkey % 15 AS INT) AS v FROM customer) o JOIN companies c ON c.company_id = o.base""",
    "auth_events": """
SELECT event_id, ts, user_id, event_type = 'error' AS failed, event_type = 'signup' AS succeeded, CAST(floor(event_id / 2.0) AS BIGINT) AS token_id FROM events""",
    "search_events": """
SELECT event_id AS search_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE user_id END AS requirement_id, CAST(event_id % 6 AS INT) AS considered,
  CAST(CASE WHEN event_id % 6 = 0 THEN 0 WHEN event_id % 4 = 0 THEN event_id % 6 ELSE event_id % 2 END AS INT) AS excluded, event_id % 9 = 0 AS ceiling_hit,
  'snap/' || CAST(event_id % 3 AS STRING) AS snapshot_category
FROM events WHERE event_type = 'view'""",
    "search_candidates": """
SELECT event_id AS search_id, k AS rank_no,
  '{"certification":{"requested":' || CASE WHEN (event_id + k) % 3 = 0 THEN 'true' ELSE 'false' END || ',"points":' || CAST((event_id + k) % 5 AS STRING) || '},"location":{"requested":' || CASE WHEN (event_id + k) % 2 = 0 THEN 'true' ELSE 'false' END || '},"trust":{"earned":' || CAST((event_id * k) % 50 AS STRING) || ',"possible":50}}' AS snapshot
FROM events CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) ks WHERE event_type = 'view' AND event_id % 6 > 0 AND k <= event_id % 3 + 1""",
}
#: Tables of the records around companies: jobs, candidates, decisions, relationships, members, documents, sessions.
FIXTURES |= {
    "sources": """
SELECT n_nationkey AS source_id, 'src' || CAST(n_nationkey % 8 AS STRING) AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'forbidden' ELSE 'allowed' END AS policy FROM nation""",
    "jobs": """
SELECT s_suppkey AS job_id, 'src' || CAST(s_suppkey % 9 AS STRING) AS source_name, s_suppkey % 4 <> 0 AS production,
  CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN 'registry' WHEN 1 THEN 'filer' WHEN 2 THEN 'census' ELSE 'trade' END AS collector FROM supplier""",
    "job_events": """
SELECT c_custkey AS observation_id, CAST(floor(c_custkey / 16.0) AS BIGINT) AS job_id, CASE CAST(c_custkey % 7 AS INT) WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped_duplicate' ELSE 'created' END AS outcome FROM customer""",
    "resolution_candidates": """
SELECT c_custkey AS observation_id, CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'AUTO_MATCH' WHEN 1 THEN 'NEW' WHEN 2 THEN 'NO_MATCH' ELSE 'REVIEW_REQUIRED' END AS state,
  CASE WHEN c_custkey % 5 IN (1, 2) THEN NULL ELSE CAST(floor(c_custkey / 15.0) AS BIGINT) END AS company_id, CASE WHEN c_custkey % 11 = 0 THEN 'reject_match' END AS decision, (c_custkey * 37) % 1000 AS created_at
FROM customer WHERE c_custkey % 6 <> 5""",
    "decisions": """
SELECT c_custkey AS observation_id, k AS seq, CASE CAST((c_custkey + k) % 3 AS INT) WHEN 0 THEN 'confirm_match' WHEN 1 THEN 'create_new' ELSE 'reject_match' END AS decision
FROM customer CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) ks WHERE k <= c_custkey % 4""",
    "relationships": """
SELECT s_suppkey * 4 + k AS relationship_id, s_suppkey AS company_id, CASE CAST((s_suppkey + k) % 3 AS INT) WHEN 0 THEN 'has_capability' WHEN 1 THEN 'member_of' ELSE 'partner_of' END AS relationship,
  CASE CAST((s_suppkey + k) % 3 AS INT) WHEN 0 THEN 'capability' WHEN 1 THEN 'association' ELSE 'company' END AS object_type, (s_suppkey * 7 + k) % 5 AS object_id,
  CASE CAST((s_suppkey + 2 * k) % 5 AS INT) WHEN 0 THEN 'verified' WHEN 1 THEN 'observed' WHEN 2 THEN 'extracted' WHEN 3 THEN 'claimed' ELSE 'rejected' END AS status
FROM supplier CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) ks""",
    "relationship_actions": """
SELECT relationship_id, CAST(k AS BIGINT) AS seq, CASE WHEN (relationship_id + k) % 2 = 0 THEN 'verify' ELSE 'reject' END AS action, CASE WHEN relationship_id % 3 <> 0 THEN 'seen' END AS note
FROM relationships CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) ks WHERE k <= relationship_id % 3""",
    "relationship_pairs": """
SELECT relationship_id AS a, relationship_id + 1 AS b FROM relationships WHERE relationship_id % 4 = 1 AND company_id % 3 = 0""",
    "members": """
SELECT s_suppkey AS company_id, s_suppkey * 15 + k * 2 AS user_id, CASE WHEN k = 0 THEN 'owner' ELSE 'member' END AS role
FROM supplier CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) ks WHERE k <= s_suppkey % 3""",
    "company_members": """
SELECT s_suppkey AS company_id, (s_suppkey * 3 + k) % 40 + 1 AS user_id, CASE WHEN k = 0 THEN 'owner' ELSE 'member' END AS role
FROM supplier CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) ks WHERE k <= s_suppkey % 3
UNION ALL SELECT CAST(floor(c_custkey / 15.0) AS BIGINT) - k, c_custkey, 'member'
FROM customer CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) ks WHERE c_custkey NOT BETWEEN 1 AND 40 AND k <= c_custkey % 3""",
    "users": """
SELECT c_custkey AS user_id, c_custkey % 3 <> 0 AS email_verified FROM customer""",
    "document_uploads": """
SELECT o_orderkey AS document_id, o_custkey % 97 * 10 + o_orderkey % 4 AS chain, o_orderdate AS uploaded_at,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS expiry_date FROM orders""",
    "evidence": """
SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 9 = 0 THEN -1 ELSE (o_orderkey * 3) % 5000 + 1 END AS document_id FROM orders WHERE o_orderkey % 2 = 0""",
    "conflict_rows": """
SELECT o_custkey AS conflict_id, count(*) AS records FROM orders GROUP BY o_custkey""",
    "conflict_notes": """
SELECT o_custkey AS conflict_id, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'note ' || CAST(o_orderkey AS STRING) END AS note FROM orders WHERE o_orderkey % 5 = 0""",
    "social_links": """
SELECT l_suppkey AS company_id, CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN 'linkedin' WHEN 1 THEN 'facebook' ELSE 'youtube' END AS platform,
  CAST(l_orderkey AS BIGINT) * 100000 + l_partkey AS written, 'https://p' || CAST(l_partkey AS STRING) AS url FROM lineitem""",
    "offering_requests": """
SELECT l_suppkey AS company_id, l_partkey % 50 AS product_id, min(CAST(l_orderkey AS BIGINT) * 100000 + l_partkey) AS asked FROM lineitem GROUP BY l_suppkey, l_partkey % 50, l_orderkey""",
    "auth_sessions": """
SELECT event_id AS session_id, user_id, ts AS last_used_at, ts + INTERVAL '7' DAY AS expires_at, event_type = 'error' AS revoked FROM events WHERE event_id % 3 = 0""",
    "session_tokens": """
SELECT event_id AS token_id, event_id - event_id % 3 AS session_id FROM events""",
    "specifications": """
SELECT DISTINCT p_type || '/' || p_brand AS category_id, specification, datatype FROM part JOIN (
  SELECT 0 AS k, 'size' AS specification, 'number' AS datatype UNION ALL SELECT 1, 'price', 'number' UNION ALL SELECT 2, 'color', 'text') s ON (p_size + k) % 5 <> 0""",
    "criteria_requests": """
SELECT c_custkey AS requirement_id, k AS n, CASE CAST((c_custkey + k) % 4 AS INT) WHEN 0 THEN 'size' WHEN 1 THEN 'color' WHEN 2 THEN 'price' ELSE 'weight' END AS specification,
  CASE CAST((c_custkey + k * 3) % 5 AS INT) WHEN 0 THEN 'eq' WHEN 1 THEN 'gte' WHEN 2 THEN 'lte' WHEN 3 THEN 'range' ELSE 'in' END AS operator,
  CASE CAST((c_custkey * 3 + k) % 7 AS INT) WHEN 0 THEN '5' WHEN 1 THEN '"red"' WHEN 2 THEN '[10,40]' WHEN 3 THEN '[40,10]' WHEN 4 THEN '[]' WHEN 5 THEN '["red","blue"]' ELSE '[1,"x"]' END AS value
FROM customer CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 4) ks""",
    "requirement_forms": """
SELECT doc_id AS requirement_id, text AS raw_query, lang AS industry, source AS country, substr(text, 1, 130) AS state, CAST(NULL AS STRING) AS city, substr(text, 1, 120) AS quantity, '' AS budget, lang AS timeline,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE (doc_id % 13) / 10.0 END AS extraction_confidence FROM documents""",
    "promoted": """
SELECT s_suppkey AS company_id, s_suppkey - s_suppkey % 7 % 2 AS observation_id FROM supplier""",
    "promoted_records": """
SELECT o_orderkey AS record_id, o_custkey AS company_id, CASE WHEN o_orderkey % 41 = 0 THEN o_custkey + 1 ELSE o_custkey - o_custkey % 7 % 2 END AS observation_id, CASE WHEN o_orderkey % 53 = 0 THEN 'verified' ELSE 'extracted' END AS status FROM orders""",
    "buyer_texts": """
SELECT c_custkey AS id, CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN 'I need ' WHEN 1 THEN 'Looking for ' WHEN 2 THEN 'find ' WHEN 3 THEN '' WHEN 4 THEN '  Sourcing ' ELSE 'Hello, ' END
  || p_name || CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN ' manufacturers' WHEN 1 THEN ' Exporter' WHEN 2 THEN '' ELSE ' supply' END
  || CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN ' in India' WHEN 1 THEN ' from south korea' WHEN 2 THEN ', 1,200 pieces' WHEN 3 THEN ' ISO and CE.' ELSE ' near ' END AS text
FROM customer JOIN part ON p_partkey = c_custkey""",
    "entered_offerings": """
SELECT company_id, product_id, role FROM offerings UNION ALL SELECT company_id, product_id, role FROM offerings WHERE offering_id % 97 = 0
UNION ALL SELECT company_id + 1000000, product_id, role FROM offerings WHERE offering_id % 89 = 0""",
    "filings": """
SELECT c_custkey AS filing_id, '{"cik":' || CAST(c_custkey AS STRING) || ',"name":"' || c_name || '","entityType":"operating","sic":"' || CAST(c_custkey % 90 AS STRING) || '","ein":"","tickers":[' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '"T' || CAST(c_custkey AS STRING) || '","","U"' END
  || '],"addresses":{"business":{"city":"Fresno","stateOrCountry":' || CASE WHEN c_custkey % 5 = 0 THEN 'null' ELSE '"CA"' END || '}},"formerNames":[' || CASE WHEN c_custkey % 4 = 0 THEN '{"name":"Old ' || c_name || '"},{"name":""}' ELSE '' END || ']}' AS body FROM customer""",
    "census_bodies": """
SELECT c_custkey AS row_id, '[["ESTAB","NAICS2017","state"]' || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE ',["' || CAST(c_custkey % 100 AS STRING) || '","' || CAST(c_custkey AS STRING) || '","06"]' END || ']' AS body FROM customer""",
    "manual_forms": """
SELECT c_custkey AS form_id, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS company_name, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS entered_by,
  CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'https://e' || CAST(c_custkey AS STRING) WHEN 1 THEN '' END AS evidence_url FROM customer""",
    "agents": """
SELECT event_id, CASE CAST(event_id % 8 AS INT) WHEN 0 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) Version/17.0 Mobile Safari/604.1' WHEN 1 THEN 'Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36 Edg/120.0'
  WHEN 2 THEN 'Mozilla/5.0 (Linux; Android 14) Chrome/120.0 Mobile Safari/537.36' WHEN 3 THEN 'Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Firefox/121.0' WHEN 4 THEN 'Mozilla/5.0 (Macintosh; Intel Mac OS X 14_0) OPR/105.0' WHEN 5 THEN 'curl/' || CAST(user_id AS STRING) WHEN 6 THEN '' END AS agent FROM events""",
    "requirement_states": """
SELECT c_custkey AS id, CASE CAST((c_custkey + 0) * 1 % 3 AS INT) WHEN 0 THEN 'explicit' WHEN 1 THEN 'inferred' WHEN 2 THEN 'missing' END AS intent, CASE CAST((c_custkey + 1) * 2 % 4 AS INT) WHEN 0 THEN 'explicit' WHEN 1 THEN 'inferred' WHEN 2 THEN 'missing' END AS product, CASE CAST((c_custkey + 2) * 3 % 3 AS INT) WHEN 0 THEN 'explicit' WHEN 1 THEN 'inferred' WHEN 2 THEN 'missing' END AS country, CASE CAST((c_custkey + 3) * 4 % 4 AS INT) WHEN 0 THEN 'explicit' WHEN 1 THEN 'inferred' WHEN 2 THEN 'missing' END AS certificates, CASE CAST((c_custkey + 4) * 5 % 3 AS INT) WHEN 0 THEN 'explicit' WHEN 1 THEN 'inferred' WHEN 2 THEN 'missing' END AS quantity, CASE CAST((c_custkey + 5) * 6 % 4 AS INT) WHEN 0 THEN 'explicit' WHEN 1 THEN 'inferred' WHEN 2 THEN 'missing' END AS budget, CASE CAST((c_custkey + 6) * 7 % 3 AS INT) WHEN 0 THEN 'explicit' WHEN 1 THEN 'inferred' WHEN 2 THEN 'missing' END AS timeline FROM customer""",
    "provenance_actions": """
SELECT record_id, CAST(k AS BIGINT) AS seq, CASE CAST((record_id + k) % 4 AS INT) WHEN 0 THEN 'verify' WHEN 1 THEN 'review' WHEN 2 THEN 'reject' ELSE 'expire' END AS action, CASE WHEN record_id % 2 = 0 THEN 'because' END AS note
FROM provenance CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) ks WHERE k < record_id % 4""",
    "relationship_links": """
SELECT relationship_id AS link_id, CASE WHEN relationship_id % 2 = 0 THEN 'factory' ELSE 'capability' END AS object_type,
  CASE WHEN relationship_id % 2 = 0 AND relationship_id % 13 <> 0 OR relationship_id % 17 = 0 THEN object_id END AS factory_object_id, CASE WHEN relationship_id % 2 = 1 THEN object_id END AS capability_object_id FROM relationships""",
    "entered_members": """
SELECT company_id, user_id, role FROM members UNION ALL SELECT company_id, user_id + 1, 'owner' FROM members WHERE company_id % 11 = 0 AND role = 'owner' UNION ALL SELECT company_id, user_id, 'member' FROM members WHERE company_id % 13 = 0""",
    "listed_ids": """
SELECT 'R' || CAST(company_id AS STRING) AS external_id, company_id FROM companies WHERE company_id % 4 <> 3""",
}
#: Tables of what collectors landed: names in two Unicode forms, contents of five kinds, jobs and their settings.
FIXTURES |= {
    "foreign_names": """
SELECT company_id, replace(name, 'e', CASE WHEN company_id % 2 = 0 THEN '\u00e9' ELSE 'e\u0301' END) AS name FROM companies""",
    "collector_jobs": """
SELECT s_suppkey AS job_id, CASE CAST(s_suppkey % 6 AS INT) WHEN 0 THEN 'registry' WHEN 1 THEN 'filer' WHEN 2 THEN 'manual' WHEN 3 THEN 'mock' WHEN 4 THEN 'census' ELSE 'trade' END AS collector,
  CASE WHEN s_suppkey % 3 <> 0 THEN 'key ' || s_name END AS api_key, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'no answer from ' || s_name END AS message FROM supplier""",
    "collected_events": """
SELECT c_custkey AS observation_id, 1 + CAST(floor(c_custkey / 16.0) AS BIGINT) AS job_id FROM customer WHERE c_custkey % 5 <> 0""",
    "collected": f"""
SELECT c_custkey AS observation_id, CASE WHEN c_custkey % 15 = 2 OR c_custkey % 25 = 5 THEN '{{"other":"' || c_name || '"}}'
  WHEN c_custkey % 3 = 0 THEN '{{"cin":"U' || CAST(c_custkey AS STRING) || '","company_name":"  ' || c_name || '  Ltd","registered_state":"Maharashtra","registered_office_address":"7 Lake Lane, ' || {CITY.format('c_custkey')} || CASE WHEN c_custkey % 2 = 0 THEN ', maharashtra' ELSE '' END || ' 422001","principal_business_activity":"' || c_mktsegment || '","nic_code":"28","date_of_registration":"' || CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN '15/09/2015' WHEN 1 THEN '2016-03-01' WHEN 2 THEN '1-2-2017' ELSE '31/02/2015' END || '"}}'
  WHEN c_custkey % 3 = 1 THEN '{{"name":"' || c_name || '","company_name":"","sic_description":"' || c_mktsegment || '","business_address_state":"CA","business_address_city":"Fresno","cik":"' || CAST(c_custkey AS STRING) || '","website":"https://c.example"}}'
  ELSE '{{"company_name":"' || c_name || '","industry":"' || c_mktsegment || '","country":"India","state":"","city":"Pune","notes":"seen"}}' END AS body FROM customer""",
}
#: Which fixtures a fixture reads.
NEEDS = {"provenance_actions": ["provenance"], "relationship_links": ["relationships"], "entered_members": ["members"], "foreign_names": ["companies"], "requirement_certificates": ["requirements"], "observations": ["companies"], "relationship_actions": ["relationships"], "relationship_pairs": ["relationships"], "listed_ids": ["companies"], "entered_offerings": ["offerings"]}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a fixture, without leaving views behind."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = FIXTURES[name]
    used = {t: frame(spark, sf_dir, t) for t in (*BASE, *NEEDS.get(name, [])) if f" {t}" in text.replace("\n", " ")}
    sql = text.replace("{", "{{").replace("}", "}}")
    for t in used:
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {t} ", f"{word} {{{t}}} ").replace(f"{word} {t}\n", f"{word} {{{t}}}\n").replace(f"{word} {t})", f"{word} {{{t}}})")
        for word in ("FROM", "JOIN"):
            if sql.endswith(f"{word} {t}"):
                sql = sql.removesuffix(t) + f"{{{t}}}"
    return spark.sql(sql, **{t: df for t, df in used.items() if f"{{{t}}}" in sql})


def ctes(*names: str) -> str:
    """`WITH name AS (...), ...` for a SQL twin, dependencies first."""
    order: list[str] = []
    for n in names:
        for x in (*NEEDS.get(n, []), n):
            if x not in order:
                order.append(x)
    return "WITH " + ", ".join(f"{n} AS ({FIXTURES[n]})" for n in order)
