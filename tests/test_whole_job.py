"""Queries do their whole job, not a part of it."""

import difflib

import pytest

from tradeloom.operators import graph, resolve, search_index
from tradeloom.plans import registry
from tradeloom.sources.fixtures import frame

SF = "/root/testdata/sf0.001"


def test_every_customer_with_a_part_is_a_requirement(spark):
    customers, parts = frame(spark, SF, "customer"), frame(spark, SF, "part")
    want = {r[0] for r in customers.join(parts, customers.c_custkey == parts.p_partkey).select("c_custkey").collect()}
    for name in ("requirements", "match_summary"):
        rows = registry.QUERIES[name](spark, SF) if name in registry.QUERIES else frame(spark, SF, name)
        assert {r.requirement_id for r in rows.collect()} == want
    kinds = {(r.specification, r.operator) for r in frame(spark, SF, "criteria").collect()}
    assert kinds == {("color", "eq"), ("size", "gte"), ("price", "lte"), ("size", "range"), ("color", "in"), ("size", "eq")}
    assert {r.requirement_id % 5 for r in frame(spark, SF, "criteria").collect()} == {0, 1, 2, 3, 4}


def test_similar_names_decide(spark):
    o = spark.createDataFrame([(1, "Alpha Bearings Works", None), (2, "Zeta Quartz", None), (3, "Omega Pipe Mill", None), (4, None, None), (5, "Alpha Bearing Work", "U3"), (6, "Gamma Tool", None)], "observation_id bigint, name string, strong_id string").selectExpr("*", "string(null) AS website", "string(null) AS state", "string(null) AS city")
    c = spark.createDataFrame([(1, "Alpha Bearing Works", None), (2, "Alpha Bearings Worx", "U2"), (3, "Omega Pipes Mill", "U3"), (4, "Gamma Tools", None)], "company_id bigint, name string, cin string").selectExpr("*", "string(null) AS website", "string(null) AS state", "string(null) AS city")
    out = {r.observation_id: (r.state, r.company_id, r.signals) for r in resolve.all_decisions(o, c).collect()}
    # observation 1: company 1 is more similar or as similar, but company 2 has a CIN
    assert out == {1: ("REVIEW_REQUIRED", 2, "fuzzy"), 2: ("NEW", None, ""), 3: ("REVIEW_REQUIRED", 3, "fuzzy"), 4: ("NO_MATCH", None, ""), 5: ("AUTO_MATCH", 3, "fuzzy,strong_id"), 6: ("REVIEW_REQUIRED", 4, "fuzzy")}


def test_all_decisions_equal_brute_force(spark):
    o, c = frame(spark, SF, "observations"), frame(spark, SF, "companies")
    known = [r for r in resolve.keyed(c).collect() if r.k_name]
    want, fuzzy = {}, 0
    for r in resolve.keyed(o).collect():
        if r.name is None:
            want[r.observation_id] = ("NO_MATCH", None)
            continue
        strong = [k.company_id for k in known if r.strong_id and k.cin == r.strong_id]
        domain = [k.company_id for k in known if r.k_domain and k.k_domain == r.k_domain]
        name = [k for k in known if k.k_name == r.k_name]
        there = [k for k in name if r.k_state and r.k_city and (k.k_state, k.k_city) == (r.k_state, r.k_city)]
        near = sorted([(-ratio, k.company_id, k) for k in known if not name and (ratio := difflib.SequenceMatcher(None, r.k_name, k.k_name).ratio()) >= 0.72], key=lambda x: x[:2])
        conflict = [k.company_id for k in name + [x[2] for x in near] if k.cin]
        weak = [min(ids) for ids in (domain, [k.company_id for k in there], [k.company_id for k in name], [x[1] for x in near[:1]]) if ids]
        fuzzy += bool(near) and not strong and not domain
        want[r.observation_id] = ("AUTO_MATCH", min(strong)) if strong else ("REVIEW_REQUIRED", min(conflict) if conflict else weak[0]) if conflict or weak else ("NEW", None)
    got = {r.observation_id: (r.state, r.company_id) for r in registry.QUERIES["resolve_all_decisions"](spark, SF).collect()}
    assert fuzzy and got == want


def searched(requirements, companies):
    """(requirement, company, matched_on), one requirement at a time."""
    low = lambda x: None if x is None else x.lower()
    out = set()
    for r in requirements:
        term, country, city = [(low(x) or "").strip() for x in (r.term, r.country, r.city)]
        held = lambda x, y: not x or (y is not None and x in low(y))
        here = [c for c in companies if c.status == "active" and held(country, c.country) and held(city, c.city)]
        hits = [c for c in here if held(term, c.industry)] or [c for c in here if term and held(term, c.name)]
        for c in hits:
            on = {"term": term and (term in (low(c.industry) or "") or term in low(c.name)), "country": country and low(c.country) == country, "city": city and low(c.city) == city}
            out.add((r.requirement_id, c.company_id, ",".join(k for k, v in on.items() if v)))
    return out


def paged(requirements, companies, page, size):
    """A page by name for each requirement that finds any: (requirement, place, company, matched_on, total, pages)."""
    names, hits, out = {c.company_id: c.name for c in companies}, {}, set()
    for r, c, on in searched(requirements, companies):
        hits.setdefault(r, []).append((names[c], c, on))
    for r, found in hits.items():
        shown = list(enumerate(sorted(found), 1))[(page - 1) * size : page * size]
        out |= {(r, i, c, on, len(found), max(1, -(-len(found) // size))) for i, (_, c, on) in shown} or {(r, None, None, "", len(found), max(1, -(-len(found) // size)))}
    return out


COMPANIES = [
    (1, "Bolt House", "Steel", "India", "Pune", "active"), (2, "Old Bolts", "steel", "India", "Pune", "archived"), (3, "Ring Works", "Steel pipes", "INDIA", "Surat", "active"), (4, "Bolt Shop", None, "Norway", None, "active"),
    (5, "X", "Wood", None, "Oslo", "active"), (6, "Ring Works", "Steel pipes", "India", "Surat", "active"), (7, "\u00c5s", "\u00e9t", "", "", "active"),
]
ASKED = [
    (1, "steel", " india", None), (2, "Steel", None, "Pune"), (3, "bolt", None, None), (4, "bolt", "norway", "Oslo"), (5, None, None, "oslo"), (6, "glass", "India", "Pune"), (7, None, None, None), (8, " ", "India", ""),
    (9, "e", None, None), (10, "x", None, None), (11, "\u00e9", None, None), (12, "ee", "di", "u"), (13, "bolt", None, None), (13, "bolt", None, None), (None, "wood", None, None),
]


@pytest.mark.parametrize(("page", "size"), [(1, 20), (1, 2), (2, 2), (9, 3)])
def test_requirements_are_searched_by_term(spark, page, size):
    c = spark.createDataFrame(COMPANIES, "company_id bigint, name string, industry string, country string, city string, status string")
    r = spark.createDataFrame(ASKED, "requirement_id bigint, term string, country string, city string")
    got = [tuple(x) for x in search_index.term_search(r, c, page, size).collect()]
    assert set(got) == paged(r.collect(), c.collect(), page, size) and len(got) == len(set(got)) + sum(x[0] == 13 for x in got) // 2
    assert {x[0] for x in got} == {1, 2, 3, 5, 7, 8, 9, 10, 11, 12, 13, None}


def test_term_search_equals_brute_force(spark):
    r, c = frame(spark, SF, "requirements"), frame(spark, SF, "companies")
    found = registry.QUERIES["requirement_search"](spark, SF)
    assert not any(x in found._jdf.queryExecution().executedPlan().toString() for x in ("CartesianProduct", "NestedLoop"))
    got = [tuple(x) for x in found.collect()]
    want = paged(registry.with_term(r).select("requirement_id", "term", "country", "city").collect(), c.collect(), 1, 20)
    assert len(got) == len(set(got)) and set(got) == want and want


def test_terms_are_discovered(spark):
    c = spark.createDataFrame(COMPANIES, "company_id bigint, name string, industry string, country string, city string, status string")
    terms = ["bolt", " Ring ", "steel", "in", "o", "", None, "pun", "steel", "\u00c5s"]
    got = search_index.discover_terms(spark.createDataFrame([(t,) for t in terms], "term string"), c, per_field=1)
    one = {t: [tuple(x)[:3] + (x.rank,) for x in graph.discover(c, t, per_field=1).select("company_id", "matched_fields", "n_fields", "rank").collect()] for t in {t.strip() for t in terms if t}}
    assert {(t, *x) for t, xs in one.items() for x in xs} == {tuple(x) for x in got.collect()}
    assert search_index.containing(spark.createDataFrame([("",)], "asked string"), spark.createDataFrame([("a",)], "text string")).collect() == []
