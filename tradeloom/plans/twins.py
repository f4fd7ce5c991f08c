"""SQL twins of the queries: fixtures that each reads, and the rest of its text."""

from __future__ import annotations

from ..operators.trust import LEVELS, WEIGHTS

NAME = "CASE WHEN {0} IN ('PRIVATE LIMITED', 'LLP', 'INC', 'LTD', 'LIMITED') THEN {0} ELSE regexp_replace({0}, '^(.+?) (?:PRIVATE LIMITED|PVT LIMITED|PVT LTD|PUBLIC LIMITED|LIMITED LIABILITY PARTNERSHIP|LIMITED|INCORPORATED|CORPORATION|COMPANY|LLP|LTD|INC|CORP|CO)$', '\\1') END"
PLAIN = "trim(regexp_replace(regexp_replace(upper({0}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"
DOMAIN = "nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(website)), '^https?://', ''), '^www\\.', ''), '/+$', ''), '')"
MATCH_NAME = "nullif(" + NAME.format(PLAIN.format("name")) + ", '')"
PLACE = "nullif(" + PLAIN + ", '')"
SLUG = "regexp_replace(regexp_replace(lower(regexp_replace(name, '[^\\x00-\\x7f]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"

_MET = {
    "owner_email_verified": "owner_email_verified", "legal_entity_type_set": "legal_entity_type IS NOT NULL", "government_id_set": "coalesce(gst_number, '') <> '' OR coalesce(cin, '') <> ''",
    "business_registration_date_set": "has_registration_date", "business_registration_document_uploaded": "reg", "business_type_set": "business_type IS NOT NULL", "factory_license_document_uploaded": "lic",
    "manufacturing_categories_set": "has_categories", "logo_uploaded": "has_logo", "cover_image_uploaded": "has_cover", "descriptions_complete": "has_descriptions", "social_link_added": "has_social_link",
    "quality_certificate_uploaded": "cert", "export_categories_set": "export_ready",
}
SCORES = f""", docs AS (
  SELECT company_id, bool_or(document_type = 'business_registration') AS reg, bool_or(document_type = 'factory_license') AS lic, bool_or(document_type IN ('iso', 'ce', 'bis')) AS cert
  FROM company_documents WHERE NOT is_deleted AND status NOT IN ('rejected', 'expired') GROUP BY 1
), checked AS (
  SELECT company_id, verification_status, {' + '.join(f'CASE WHEN coalesce({m}, false) THEN {WEIGHTS[k]} ELSE 0 END' for k, m in _MET.items())} AS score,
    array_to_string(list_filter([{', '.join(f"CASE WHEN coalesce({m}, false) THEN NULL ELSE '{k}' END" for k, m in _MET.items())}], lambda x: x IS NOT NULL), ',') AS missing
  FROM companies LEFT JOIN docs USING (company_id)
), scores AS (
  SELECT company_id, score, CASE {' '.join(f"WHEN score >= {n} THEN '{k}'" for k, n in reversed(LEVELS))} END AS level,
    CASE {' '.join(f"WHEN score < {n} THEN '{k}'" for k, n in LEVELS[1:])} END AS next_level, missing, verification_status FROM checked
)"""
CANDIDATES = """, live AS (
  SELECT o.offering_id, o.company_id, o.product_id, o.created_at, o.country, p.category_id, row_number() OVER (PARTITION BY p.category_id ORDER BY o.created_at, o.offering_id) AS nth, count(*) OVER (PARTITION BY p.category_id) AS n
  FROM offerings o JOIN products p USING (product_id) WHERE o.status = 'active' AND p.status = 'published'
), candidates AS (SELECT *, n > 500 AS more_exist FROM live WHERE nth <= 500)"""
MATCH = SCORES + CANDIDATES + """, checked_criteria AS (
  SELECT r.requirement_id, c.offering_id, bool_and(coalesce(CASE k.operator WHEN 'eq' THEN CASE WHEN k.text_value IS NULL THEN try_cast(a.value AS DOUBLE) = k.low ELSE lower(trim(a.value)) = lower(trim(k.text_value)) END WHEN 'in' THEN lower(trim(a.value)) IN (SELECT lower(trim(x)) FROM unnest(string_split(k.text_value, '|')) t(x)) WHEN 'gte' THEN try_cast(a.value AS DOUBLE) >= k.low
    WHEN 'lte' THEN try_cast(a.value AS DOUBLE) <= k.low WHEN 'range' THEN try_cast(a.value AS DOUBLE) BETWEEN k.low AND k.high END, false)) AS ok
  FROM requirements r JOIN candidates c USING (category_id) JOIN criteria k USING (requirement_id) LEFT JOIN product_attributes a ON a.product_id = c.product_id AND a.specification = k.specification GROUP BY 1, 2
), wanted AS (
  SELECT requirement_id, n, CASE WHEN certificate LIKE 'ISO%' THEN 'iso' WHEN certificate LIKE 'CE %' THEN 'ce' WHEN certificate = 'BIS' THEN 'bis' WHEN certificate = 'Factory license' THEN 'factory_license' END AS type FROM requirement_certificates
), asked AS (SELECT requirement_id, count(*) AS n FROM wanted GROUP BY 1
), found AS (
  SELECT w.requirement_id, d.company_id, count(DISTINCT w.n) AS n FROM wanted w JOIN company_documents d ON d.document_type = w.type AND d.status = 'verified' GROUP BY 1, 2
), parts AS (
  SELECT r.requirement_id, c.offering_id, c.company_id, c.created_at, c.more_exist, coalesce(k.ok, true) AS passes,
    lower(trim(r.country)) = lower(trim(coalesce(nullif(c.country, ''), m.country))) AS same_country, lower(trim(r.state)) = lower(trim(m.state)) AS same_state, lower(trim(r.city)) = lower(trim(m.city)) AS same_city,
    coalesce(r.country, r.state, r.city) IS NOT NULL AS wants, coalesce(a.n, 0) AS asked, coalesce(f.n, 0) AS found,
    CASE s.level WHEN 'email_verified' THEN 12.5 WHEN 'business_verified' THEN 25.0 WHEN 'factory_verified' THEN 37.5 WHEN 'premium_verified' THEN 50.0 ELSE 0.0 END::DOUBLE AS trust_points
  FROM requirements r JOIN candidates c USING (category_id) JOIN companies m ON m.company_id = c.company_id JOIN scores s ON s.company_id = c.company_id
  LEFT JOIN checked_criteria k ON k.requirement_id = r.requirement_id AND k.offering_id = c.offering_id LEFT JOIN asked a ON a.requirement_id = r.requirement_id
  LEFT JOIN found f ON f.requirement_id = r.requirement_id AND f.company_id = c.company_id
), points AS (
  SELECT *, (CASE WHEN same_country THEN 15 + CASE WHEN same_state THEN 10 + CASE WHEN same_city THEN 5 ELSE 0 END ELSE 0 END ELSE 0 END)::DOUBLE AS location_points,
    CASE WHEN asked > 0 THEN 20.0::DOUBLE * (found::DOUBLE / asked) ELSE 0.0 END AS certificate_points,
    50.0::DOUBLE + CASE WHEN wants THEN 30 ELSE 0 END + CASE WHEN asked > 0 THEN 20 ELSE 0 END AS possible FROM parts
)"""
RANKED = """, scored AS (SELECT *, round_even((location_points + certificate_points + trust_points) / possible * 100, 2)::DOUBLE AS score FROM points WHERE passes)
SELECT requirement_id, CAST(row_number() OVER (PARTITION BY requirement_id ORDER BY score DESC, trust_points DESC, created_at, offering_id) AS INTEGER) AS rank, offering_id, company_id, score, location_points, certificate_points, trust_points FROM scored"""
SUMMARY = """, per AS (SELECT requirement_id, count(*) AS considered, count(*) FILTER (NOT passes) AS excluded, count(*) FILTER (passes) AS returned, bool_or(more_exist) AS more FROM points GROUP BY 1)
SELECT r.requirement_id, CASE WHEN r.category_id IS NULL THEN 'category_required' ELSE 'ok' END AS status, coalesce(considered, 0) AS considered, coalesce(excluded, 0) AS excluded, coalesce(returned, 0) AS returned, coalesce(more, false) AS more_may_exist FROM requirements r LEFT JOIN per USING (requirement_id)"""
PAIRS = ["requirements", "criteria", "requirement_certificates", "offerings", "products", "product_attributes", "companies", "company_documents"]

BATCH = """WITH batch AS (SELECT doc_id AS item_id, source, CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id // 2 AS STRING) END AS external_id, sha256(text) AS content_hash, doc_id % 50 = 7 AS empty FROM documents
), existing AS (SELECT source, external_id, content_hash FROM batch WHERE item_id % 4 = 0
), loose AS (SELECT source, content_hash, count(*) AS stored FROM existing GROUP BY 1, 2
), exact AS (SELECT DISTINCT source, content_hash, external_id FROM existing WHERE external_id IS NOT NULL
), named AS (
  SELECT b.*, coalesce(l.stored, 0) AS stored, NOT b.empty AND b.external_id IS NOT NULL AND e.external_id IS NULL
    AND count(*) FILTER (NOT b.empty) OVER (PARTITION BY b.source, b.content_hash, b.external_id ORDER BY b.item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0 AS first_named
  FROM batch b LEFT JOIN loose l USING (source, content_hash) LEFT JOIN exact e ON e.source = b.source AND e.content_hash = b.content_hash AND e.external_id = b.external_id
), seen AS (
  SELECT *, count(*) FILTER (first_named) OVER w AS names, count(*) FILTER (NOT empty AND external_id IS NULL) OVER w AS bare,
    CASE WHEN stored = 0 AND min(item_id) FILTER (NOT empty AND external_id IS NULL) OVER k < coalesce(min(item_id) FILTER (first_named) OVER k, 9000000000000000000) THEN 1 ELSE 0 END AS own FROM named
  WINDOW k AS (PARTITION BY source, content_hash), w AS (PARTITION BY source, content_hash ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), outcomes AS (
  SELECT item_id, source, external_id, content_hash, CASE WHEN empty THEN 'failed' WHEN external_id IS NOT NULL THEN CASE WHEN first_named THEN 'created' ELSE 'skipped_duplicate' END
    WHEN stored + names + CASE WHEN bare > 0 THEN own ELSE 0 END > 1 THEN 'failed' WHEN stored + names = 1 OR bare > 0 THEN 'skipped_duplicate' ELSE 'created' END AS outcome FROM seen
)
"""
SIGNALS = f""", o AS (SELECT observation_id, strong_id, {MATCH_NAME} AS k_name, {DOMAIN} AS k_domain, {PLACE.format('state')} AS k_state, {PLACE.format('city')} AS k_city FROM observations WHERE name IS NOT NULL
), c AS (SELECT company_id, cin, {MATCH_NAME} AS k_name, {DOMAIN} AS k_domain, {PLACE.format('state')} AS k_state, {PLACE.format('city')} AS k_city FROM companies
), signals AS (
  SELECT observation_id, 'strong_id' AS signal, min(company_id) AS company_id, min(company_id) FILTER (c.cin IS NOT NULL) AS with_cin FROM o JOIN c ON o.strong_id = c.cin GROUP BY 1
  UNION ALL SELECT observation_id, 'domain', min(company_id), min(company_id) FILTER (cin IS NOT NULL) FROM o JOIN c USING (k_domain) GROUP BY 1
  UNION ALL SELECT observation_id, 'name_address', min(company_id), min(company_id) FILTER (cin IS NOT NULL) FROM o JOIN c USING (k_name, k_state, k_city) GROUP BY 1
  UNION ALL SELECT observation_id, 'name', min(company_id), min(company_id) FILTER (cin IS NOT NULL) FROM o JOIN c USING (k_name) GROUP BY 1
)"""
CONFLICTS = ", tagged AS (SELECT company_id, field_name, count(*) AS records, min(record_id) AS first_record FROM provenance GROUP BY 1, 2 HAVING count(DISTINCT value_observed) > 1)"
RISK = "CASE WHEN field_name IN ('cin', 'gst_number') THEN 'high' WHEN field_name IN ('name', 'industry', 'country', 'city') THEN 'low' ELSE 'medium' END"
DAYS = "CASE WHEN field_name IN ('name', 'cin') THEN 180 WHEN field_name IN ('country', 'city') THEN 90 ELSE 30 END * 86400"
QUALITY = CONFLICTS + f""", latest AS (SELECT *, row_number() OVER (PARTITION BY company_id, field_name ORDER BY last_observed_at DESC, record_id DESC) AS nth, epoch(TIMESTAMP '1999-06-01 00:00:00') - epoch(last_observed_at) AS age FROM provenance
), quality AS (SELECT l.company_id, l.field_name, l.record_id, l.value_observed, l.status, CAST(l.confidence AS DOUBLE) AS confidence, {RISK.replace('field_name', 'l.field_name')} AS risk, CASE WHEN age >= {DAYS.replace('field_name', 'l.field_name')} THEN 'stale' WHEN age * 5 >= 4 * {DAYS.replace('field_name', 'l.field_name')} THEN 'approaching_stale' ELSE 'fresh' END AS freshness, t.company_id IS NOT NULL AS has_open_conflict
  FROM latest l LEFT JOIN tagged t USING (company_id, field_name) WHERE nth = 1)"""

TERM_SEARCH = """, q AS (SELECT requirement_id, nullif(lower(trim(CASE WHEN requirement_id % 3 = 0 THEN ['red', 'blue', 'ring', 'bolt'][CAST(requirement_id % 4 AS INTEGER) + 1] ELSE split_part(category_id, '/', 1) END)), '') AS term, nullif(lower(trim(country)), '') AS qc, nullif(lower(trim(city)), '') AS qt FROM requirements
), l AS (SELECT company_id, lower(name) AS nm, lower(industry) AS ind, lower(country) AS c, lower(city) AS t, name AS shown FROM companies WHERE status = 'active'
), here AS (SELECT * FROM q JOIN l ON (qc IS NULL OR contains(c, qc)) AND (qt IS NULL OR contains(t, qt))
), one AS (SELECT * FROM here WHERE term IS NULL OR contains(ind, term)
), two AS (SELECT * FROM one UNION ALL SELECT * FROM here WHERE contains(nm, term) AND requirement_id NOT IN (SELECT requirement_id FROM one))
, n AS (SELECT requirement_id, company_id, shown, concat_ws(',', CASE WHEN contains(ind, term) OR contains(nm, term) THEN 'term' END, CASE WHEN c = qc THEN 'country' END, CASE WHEN t = qt THEN 'city' END) AS matched_on,
  row_number() OVER (PARTITION BY requirement_id ORDER BY shown, company_id) AS place, count(*) OVER (PARTITION BY requirement_id) AS total FROM two)
SELECT requirement_id, CAST(place AS INTEGER) AS place, company_id, matched_on, total, greatest(1, CAST(ceil(total / {0}.0) AS BIGINT)) AS pages FROM n WHERE place BETWEEN {1} AND {2}"""
DISCOVER = """, q AS (SELECT DISTINCT trim(term) AS shown, lower(trim(term)) AS x FROM (SELECT CASE WHEN requirement_id % 3 = 0 THEN ['red', 'blue', 'ring', 'bolt'][CAST(requirement_id % 4 AS INTEGER) + 1] ELSE split_part(category_id, '/', 1) END AS term FROM requirements) WHERE length(trim(term)) >= 2
), f AS (SELECT shown, company_id, contains(lower(name), x) AS h0, coalesce(contains(lower(industry), x), false) AS h1, contains(lower(city), x) AS h2, contains(lower(country), x) AS h3 FROM q JOIN companies ON status = 'active' AND (contains(lower(name), x) OR contains(lower(industry), x) OR contains(lower(city), x) OR contains(lower(country), x))
), l AS (SELECT shown, company_id, i FROM f JOIN (VALUES (0), (1), (2), (3)) v(i) ON CASE i WHEN 0 THEN h0 WHEN 1 THEN h1 WHEN 2 THEN h2 ELSE h3 END QUALIFY row_number() OVER (PARTITION BY shown, i ORDER BY company_id DESC) <= 50
), m AS (SELECT shown, company_id, min(i) AS first FROM l GROUP BY 1, 2), r AS (SELECT f.*, m.first, CAST(h0 AS INTEGER) + CAST(h1 AS INTEGER) + CAST(h2 AS INTEGER) + CAST(h3 AS INTEGER) AS n_fields FROM f JOIN m USING (shown, company_id))
SELECT shown AS term, company_id, concat_ws(',', CASE WHEN h0 THEN 'name' END, CASE WHEN h1 THEN 'industry' END, CASE WHEN h2 THEN 'city' END, CASE WHEN h3 THEN 'country' END) AS matched_fields, n_fields, CAST(row_number() OVER (PARTITION BY shown ORDER BY n_fields DESC, first, company_id DESC) AS INTEGER) AS rank FROM r"""
# Rules that depend on order are walked one row at a time: step n of every user or stem at once.
LOG = """, log AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, coalesce(failed, false) AS failed, coalesce(succeeded, false) AS succeeded, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM auth_events{})"""
RATE_LIMIT = LOG.format("") + """ SELECT user_id, event_id, CAST(hit AS INTEGER) AS hit, start + 3600 - t AS retry_after FROM (WITH RECURSIVE walk AS (SELECT user_id, event_id, n, t, t AS start, 1 AS hit FROM log WHERE n = 1
UNION ALL SELECT l.user_id, l.event_id, l.n, l.t, CASE WHEN l.t >= w.start + 3600 THEN l.t ELSE w.start END, CASE WHEN l.t >= w.start + 3600 THEN 1 ELSE w.hit + 1 END FROM walk w JOIN log l ON l.user_id IS NOT DISTINCT FROM w.user_id AND l.n = w.n + 1
) FROM walk) WHERE hit > 2"""
# strikes, first, until: the state after a row; live: strikes that still count when it comes
LOCKOUTS = LOG.format(" WHERE failed OR succeeded") + """ SELECT user_id, event_id, outcome, CAST(strikes AS INTEGER) AS strikes, lock_seconds FROM (WITH RECURSIVE walk AS (SELECT user_id, NULL::BIGINT AS event_id, 0::BIGINT AS n, 0 AS strikes, 0.0::DOUBLE AS first, 0.0::DOUBLE AS until, '' AS outcome, 0.0::DOUBLE AS lock_seconds FROM log WHERE n = 1
UNION ALL SELECT user_id, event_id, n, strikes, first, CASE WHEN outcome = 'failed' AND strikes >= 5 THEN t + lock ELSE until END, outcome, CASE WHEN outcome = 'blocked' THEN until - t WHEN outcome = 'failed' THEN lock ELSE 0.0 END
  FROM (SELECT *, CASE WHEN strikes >= 5 THEN least(30.0 * 2 ** least(strikes - 5, 30), 900.0) ELSE 0.0 END::DOUBLE AS lock
    FROM (SELECT user_id, event_id, n, t, until, CASE WHEN t < until THEN 'blocked' WHEN failed THEN 'failed' ELSE 'passed' END AS outcome, CASE WHEN t < until THEN held WHEN failed THEN live + 1 ELSE 0 END AS strikes, CASE WHEN t >= until AND failed AND live = 0 THEN t ELSE first END AS first
      FROM (SELECT l.*, w.strikes AS held, w.first, w.until, CASE WHEN l.t >= w.first + 86400 THEN 0 ELSE w.strikes END AS live FROM walk w JOIN log l ON l.user_id IS NOT DISTINCT FROM w.user_id AND l.n = w.n + 1)))
) FROM walk) WHERE n > 0"""
# the names of the fixture are ASCII, so their Unicode form is as it is
SLUGS = f""", base AS (SELECT observation_id AS id, CASE WHEN s = '' THEN 'company' ELSE s END AS slug FROM (SELECT observation_id, {SLUG} AS s FROM observations WHERE name IS NOT NULL)
), stems AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY id) AS n FROM (SELECT *, regexp_replace(slug, '(-\\d+)+$', '') AS stem FROM base)
), held AS (SELECT regexp_replace(slug, '(-\\d+)+$', '') AS stem, list(DISTINCT slug) AS used FROM (SELECT CASE WHEN {SLUG} = '' THEN 'company' ELSE {SLUG} END AS slug FROM companies) GROUP BY 1
) SELECT id, slug FROM (WITH RECURSIVE walk AS (SELECT s.stem, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::VARCHAR AS slug, coalesce(any_value(h.used), []) AS used FROM stems s LEFT JOIN held h USING (stem) GROUP BY 1
UNION ALL SELECT stem, n, id, free, list_append(used, free)
  FROM (SELECT s.stem, s.n, s.id, w.used, list_filter(list_prepend(s.slug, list_transform(range(2, len(w.used) + 3), lambda k: s.slug || '-' || k)), lambda x: NOT list_contains(w.used, x))[1] AS free FROM walk w JOIN stems s ON s.stem = w.stem AND s.n = w.n + 1)
) FROM walk) WHERE n > 0"""
TWINS: dict[str, tuple[list[str], str]] = {
    "names": (["companies"], f" SELECT company_id, {NAME.format(PLAIN.format('name'))} AS match_name, {DOMAIN} AS domain, {PLACE.format('city')} AS place, CASE WHEN {SLUG} = '' THEN 'company' ELSE {SLUG} END AS slug, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS display FROM companies"),
    "certificate_words": (["requirement_certificates"], ", w AS (SELECT requirement_id, n, ' ' || array_to_string(regexp_extract_all(lower(certificate), '[a-z0-9]+'), ' ') || ' ' AS p FROM requirement_certificates) SELECT requirement_id, n, contains(p, ' iso ') AS is_iso, contains(p, ' ce ') AS is_ce, contains(p, ' bis ') AS is_bis, contains(p, ' factory license ') AS is_licence FROM w"),
    "trust_scores": (["companies", "company_documents"], SCORES + " SELECT company_id, score, level, next_level, missing, verification_status FROM scores"),
    "verified_sync": (["companies", "company_documents"], SCORES + ", w AS (SELECT company_id, CASE WHEN score >= 45 THEN 'verified' ELSE 'unverified' END AS verification_status, verification_status AS previous FROM scores) SELECT * FROM w WHERE verification_status <> previous"),
    "match_candidates": (["offerings", "products"], CANDIDATES + " SELECT category_id, offering_id, more_exist FROM candidates"),
    "match_ranked": (PAIRS, MATCH + RANKED),
    "match_summary": (PAIRS, MATCH + SUMMARY),
    "gap_categories": (["search_events", "requirements", "search_candidates"], """, s AS (SELECT e.*, considered - excluded AS returned, CASE WHEN e.requirement_id IS NULL THEN snapshot_category ELSE r.category_id END AS category FROM search_events e LEFT JOIN requirements r ON r.requirement_id = e.requirement_id
), a AS (SELECT category, count(*) AS search_count, count(*) FILTER (considered = 0) AS zero_offering_count, count(*) FILTER (considered > 0 AND returned = 0) AS fully_excluded_count, avg(considered) AS avg_considered, avg(excluded) AS avg_excluded, avg(returned) AS avg_returned, avg(ceiling_hit::INT) AS ceiling_hit_rate FROM s WHERE category IS NOT NULL GROUP BY 1
), b AS (SELECT category, count(*) FILTER ((snapshot->'$.certification.requested')::BOOLEAN) AS q, count(*) FILTER ((snapshot->'$.certification.requested')::BOOLEAN AND (snapshot->'$.certification.points')::DOUBLE = 0) AS g, count(*) FILTER ((snapshot->'$.location.requested')::BOOLEAN) AS l, avg((snapshot->'$.trust.earned')::DOUBLE) AS avg_trust_earned, avg((snapshot->'$.trust.possible')::DOUBLE) AS avg_trust_possible
  FROM search_candidates JOIN s USING (search_id) WHERE category IS NOT NULL GROUP BY 1)
SELECT category, search_count, zero_offering_count, fully_excluded_count, avg_considered, avg_excluded, avg_returned, ceiling_hit_rate, coalesce(q, 0) AS certification_requested, coalesce(g, 0) AS certification_gap, coalesce(l, 0) AS location_requested, avg_trust_earned, avg_trust_possible, CASE WHEN q > 0 THEN g::DOUBLE / q END AS certification_gap_rate FROM a LEFT JOIN b USING (category)"""),
    "gap_specifications": (["criteria", "requirements", "offerings", "products", "product_attributes"], """, used AS (SELECT category_id, specification, count(*) AS times_used FROM criteria JOIN requirements USING (requirement_id) WHERE category_id IS NOT NULL GROUP BY 1, 2
), live AS (SELECT category_id, o.product_id FROM offerings o JOIN products p USING (product_id) WHERE o.status = 'active' AND p.status = 'published'
), total AS (SELECT category_id, count(*) AS n FROM live GROUP BY 1
), having_ AS (SELECT category_id, specification, count(*) AS n FROM live JOIN product_attributes USING (product_id) GROUP BY 1, 2)
SELECT category_id, specification, times_used, coalesce(t.n, 0) AS live_offerings, coalesce(h.n, 0) AS with_value, CASE WHEN t.n > 0 THEN coalesce(h.n, 0)::DOUBLE / t.n END AS coverage_rate FROM used LEFT JOIN total t USING (category_id) LEFT JOIN having_ h USING (category_id, specification)"""),
    "ingest_outcomes": ([], BATCH + "SELECT * FROM outcomes"),
    "ingest_rollup": ([], BATCH + ", r AS (SELECT source, count(*) FILTER (outcome = 'created') AS created, count(*) FILTER (outcome = 'skipped_duplicate') AS skipped_duplicate, count(*) FILTER (outcome = 'failed') AS failed FROM outcomes GROUP BY 1) SELECT *, CASE WHEN created = 0 AND skipped_duplicate = 0 AND failed > 0 THEN 'failed' ELSE 'succeeded' END AS status FROM r"),
    "resolve_signals": (["observations", "companies"], SIGNALS + " SELECT observation_id, signal, company_id FROM signals"),
    "resolve_exact_decisions": (["observations", "companies", "listed_ids"], SIGNALS + """, l AS (SELECT external_id, min(company_id) AS company_id FROM listed_ids GROUP BY 1), every AS (SELECT observation_id, signal, company_id, with_cin FROM signals UNION ALL SELECT observation_id, 'source_id', l.company_id, NULL FROM observations JOIN l USING (external_id) WHERE name IS NOT NULL
), p AS (SELECT observation_id, min(company_id) FILTER (signal = 'strong_id') AS a, min(company_id) FILTER (signal = 'source_id') AS s, min(company_id) FILTER (signal = 'domain') AS d, min(company_id) FILTER (signal = 'name_address') AS na, min(company_id) FILTER (signal = 'name') AS n, coalesce(min(with_cin) FILTER (signal = 'name_address'), min(with_cin) FILTER (signal = 'name')) AS k, string_agg(DISTINCT signal, ',' ORDER BY signal) AS signals FROM every GROUP BY 1)
SELECT o.observation_id, CASE WHEN o.name IS NULL THEN 'NO_MATCH' WHEN a IS NOT NULL THEN 'AUTO_MATCH' WHEN coalesce(k, s, d, na, n) IS NOT NULL THEN 'REVIEW_REQUIRED' ELSE 'NEW' END AS state, coalesce(a, k, s, d, na, n) AS company_id, coalesce(signals, '') AS signals FROM observations o LEFT JOIN p USING (observation_id)"""),
    "resolve_sources": (["observations", "listed_ids"], " SELECT observation_id, min(l.company_id) AS company_id FROM observations JOIN listed_ids l USING (external_id) WHERE name IS NOT NULL GROUP BY 1"),
    "promote": (["observations", "companies"], """, x AS (SELECT *, coalesce(name, '') <> '' AS usable, count(*) FILTER (coalesce(name, '') <> '') OVER (PARTITION BY strong_id ORDER BY observation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM observations)
SELECT observation_id, name, name AS legal_name, strong_id AS cin, CASE WHEN NOT usable THEN 'missing_name' WHEN strong_id IS NOT NULL AND (earlier > 0 OR strong_id IN (SELECT cin FROM companies WHERE cin IS NOT NULL)) THEN 'duplicate_strong_id' ELSE 'created' END AS outcome FROM x"""),
    "provenance_unpivot": (["observations"], "".join(f" {'UNION ALL' if i else ''} SELECT observation_id, '{f}' AS field_name, {f} AS value_observed, '{'rule_based' if i < 3 else 'manual'}' AS extraction_method, {0.8 if i < 3 else 0.5}::DOUBLE AS confidence, '{'extracted' if i < 3 else 'observed'}' AS status FROM observations WHERE coalesce({f}, '') <> ''" for i, f in enumerate(["name", "strong_id", "state", "city", "website"]))),
    "conflicts": (["provenance"], CONFLICTS + " SELECT * FROM tagged"),
    "field_quality": (["provenance"], QUALITY + " SELECT * FROM quality"),
    "quality_scores": (["provenance"], QUALITY + " SELECT company_id, round_even(sum(CASE WHEN field_name = 'cin' THEN 2.0 WHEN field_name IN ('name', 'industry', 'country', 'state', 'city') THEN 1.0 ELSE 0.0 END * CASE WHEN status = 'verified' THEN 1.0 WHEN status IN ('observed', 'extracted', 'claimed') THEN 0.5 ELSE 0.0 END)::DOUBLE / 7 * 100, 1)::DOUBLE AS score FROM quality GROUP BY 1"),
    "review_queue": (["provenance"], CONFLICTS + f""", q AS (SELECT p.record_id, p.company_id, p.field_name, p.status, array_to_string(list_filter([CASE WHEN p.status = 'under_review' THEN 'under_review' END, CASE WHEN t.company_id IS NOT NULL THEN 'open_conflict' END, CASE WHEN p.status IN ('observed', 'extracted', 'claimed') AND {RISK.replace('field_name', 'p.field_name')} = 'high' THEN 'unverified_high_risk' END], lambda x: x IS NOT NULL), ',') AS reasons, p.last_observed_at FROM provenance p LEFT JOIN tagged t USING (company_id, field_name)) SELECT *, CASE WHEN reasons = 'unverified_high_risk' THEN 2 ELSE 1 END AS level FROM q WHERE reasons <> ''"""),
    "graph_edges": (["offerings"], " SELECT company_id, CASE role WHEN 'manufacturer' THEN 'manufactures' WHEN 'distributor' THEN 'distributes' WHEN 'supplier' THEN 'supplies' WHEN 'exporter' THEN 'exports' ELSE 'services' END AS relationship, 'product' AS object_type, product_id AS object_id FROM offerings WHERE status = 'active'"),
    "graph_distributors": (["offerings"], " SELECT product_id, company_id, offering_id, country FROM offerings WHERE role = 'distributor' AND status = 'active' AND country = 'NATION_2'"),
    "graph_manufacturers": (["offerings"], " SELECT product_id, company_id, offering_id, country FROM offerings WHERE role = 'manufacturer' AND status = 'active'"),
    "graph_traversal": (["companies", "offerings", "products"], " SELECT product_id, company_id, c.name, role, category_id FROM companies c JOIN offerings o USING (company_id) JOIN products p USING (product_id)"),
    "company_search": (["companies"], ", f AS (SELECT company_id, name, industry, country, count(*) OVER () AS total FROM companies WHERE status = 'active' AND name ILIKE '%zone 1%') SELECT *, greatest(1, CAST(ceil(total / 10.0) AS BIGINT)) AS pages FROM f ORDER BY name, company_id LIMIT 10"),
    "product_search": (["products", "offerings"], ", n AS (SELECT product_id, count(*) AS k FROM offerings GROUP BY 1) SELECT product_id, name, category_id, coalesce(k, 0) AS offering_count FROM products LEFT JOIN n USING (product_id) WHERE status = 'published' AND name ILIKE '%ring%'"),
    "discover": (["companies"], """, h AS (SELECT company_id, coalesce(name ILIKE '%on%', false) AS a, coalesce(industry ILIKE '%on%', false) AS b, coalesce(city ILIKE '%on%', false) AS c, coalesce(country ILIKE '%on%', false) AS d FROM companies WHERE status = 'active'
), n AS (SELECT *, a AND row_number() OVER (PARTITION BY a ORDER BY company_id DESC) <= 50 AS la, b AND row_number() OVER (PARTITION BY b ORDER BY company_id DESC) <= 50 AS lb, c AND row_number() OVER (PARTITION BY c ORDER BY company_id DESC) <= 50 AS lc, d AND row_number() OVER (PARTITION BY d ORDER BY company_id DESC) <= 50 AS ld FROM h WHERE a OR b OR c OR d
), m AS (SELECT *, a::INT + b::INT + c::INT + d::INT AS n_fields, CASE WHEN la THEN 0 WHEN lb THEN 1 WHEN lc THEN 2 ELSE 3 END AS first FROM n WHERE la OR lb OR lc OR ld)
SELECT company_id, array_to_string(list_filter([CASE WHEN a THEN 'name' END, CASE WHEN b THEN 'industry' END, CASE WHEN c THEN 'city' END, CASE WHEN d THEN 'country' END], lambda x: x IS NOT NULL), ',') AS matched_fields, n_fields, CAST(row_number() OVER (ORDER BY n_fields DESC, first, company_id DESC) AS INTEGER) AS rank FROM m"""),
    "requirement_search": (["requirements", "companies"], TERM_SEARCH.format(20, 1, 20)),
    "requirement_term_search": (["requirements", "companies"], TERM_SEARCH.format(20, 1, "total")),
    "discover_terms": (["requirements", "companies"], DISCOVER),
    "integrity": (["entered_offerings", "companies", "promoted_records"], " SELECT 'duplicate_offering' AS rule, company_id AS entity_id FROM entered_offerings GROUP BY company_id, product_id, role HAVING count(*) > 1 UNION ALL SELECT 'unknown_company', company_id FROM entered_offerings WHERE company_id NOT IN (SELECT company_id FROM companies) UNION ALL SELECT 'unknown_entity', record_id FROM promoted_records WHERE company_id NOT IN (SELECT company_id FROM companies)"),
    "token_reuse": (["auth_events"], ", n AS (SELECT *, row_number() OVER (PARTITION BY token_id ORDER BY ts, event_id) AS nth FROM auth_events) SELECT token_id, user_id, ts AS revoked_at FROM n WHERE nth = 2"),
    "session_expiry": (["auth_events"], ", g AS (SELECT *, ts - lag(ts) OVER w > INTERVAL 3600 SECOND AS gap FROM auth_events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), d AS (SELECT *, coalesce(bool_or(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS dead FROM g) SELECT user_id, max(ts) FILTER (NOT dead) AS last_valid, count(*) FILTER (NOT dead) AS rotations, count(*) FILTER (dead) AS failed FROM d GROUP BY 1"),
    "keep_last": (["auth_events"], ", n AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS nth FROM auth_events) SELECT user_id, nth, event_id FROM n WHERE nth <= 5"),
    "rate_limit": (["auth_events"], RATE_LIMIT),
    "lockouts": (["auth_events"], LOCKOUTS),
    "slugs": (["observations", "companies"], SLUGS),
}
