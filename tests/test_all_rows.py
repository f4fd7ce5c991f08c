"""Searches and memberships give every row, not a page or a corner of the tables."""

import pytest

from tests.test_whole_job import SF, searched
from tradeloom.plans import registry
from tradeloom.sources.fixtures import frame


def test_requirement_term_search_gives_every_hit(spark):
    asked, companies = registry.with_term(frame(spark, SF, "requirements")), frame(spark, SF, "companies")
    want = searched(asked.collect(), companies.where("status = 'active'").collect())
    rows = registry.QUERIES["requirement_term_search"](spark, SF).collect()
    assert {(r.requirement_id, r.company_id, r.matched_on) for r in rows} == want and len(rows) == len(want)
    places = {}
    for r in rows:
        places.setdefault((r.requirement_id, r.total), []).append(r.place)
    assert all(sorted(p) == list(range(1, total + 1)) for (_, total), p in places.items())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_memberships_of_all_users(spark, sf):
    sf = f"/root/testdata/{sf}"
    customers = {r[0] for r in frame(spark, sf, "customer").select("c_custkey").collect()}
    companies = {r[0] for r in frame(spark, sf, "companies").where("status <> 'archived'").select("company_id").collect()}
    rows = registry.QUERIES["memberships"](spark, sf).collect()
    held = frame(spark, sf, "company_members").collect()
    assert len(held) == len({(r.company_id, r.user_id) for r in held})  # nobody is in one company twice
    assert {(r.company_id, r.user_id) for r in rows} == {(r.company_id, r.user_id) for r in held if r.company_id in companies}
    of = {}
    for r in rows:
        of.setdefault(r.user_id, {})[r.place] = r.company_id
    assert all([of[u][k] for k in sorted(of[u])] == sorted(of[u].values(), reverse=True) and sorted(of[u]) == list(range(1, len(of[u]) + 1)) for u in of)
    if sf.endswith("0.1"):
        # as many companies a user as when 40 users held them all, and now users among all customers too
        assert max(map(len, of.values())) >= 5 and len(of) > 0.9 * len(customers)
