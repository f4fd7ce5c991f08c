"""The gap report matches requirements that are alike once, and says what the telemetry of every search would."""

from pyspark.sql import functions as F

from tradeloom.operators import gaps, telemetry
from tradeloom.plans import collected
from tradeloom.plans.twins import PAIRS
from tradeloom.sources.fixtures import frame

SF = "/root/testdata/sf0.001"


def test_alike_requirements_are_matched_once(spark, monkeypatch):
    tables = [frame(spark, SF, n) for n in PAIRS]
    for i in (0, 1, 2):  # requirements, criteria, certificates: each twice more, under other ids and from other places
        more = [tables[i].withColumn("requirement_id", F.col("requirement_id") + 1000 * k) for k in (1, 2)]
        tables[i] = tables[i].union(more[0]).union(more[1] if i else more[1].withColumn("country", F.lit("nowhere")))
    tables[1] = tables[1].union(tables[1].where("requirement_id = 2001"))  # a criterion twice
    every, matched = collected.all_pairs, []

    def counted(requirements, *others):
        matched.append(requirements.count())
        return every(requirements, *others)

    monkeypatch.setattr(collected, "all_pairs", counted)
    got = {tuple(r) for r in collected.gap_report(*tables).where("kind = 'category'").select("category_id", "asked", "unmet", "certification_gap").collect()}
    assert sum(matched) <= tables[0].count() // 3 + 1, matched
    monkeypatch.setattr(collected, "all_pairs", every)
    one_by_one = gaps.category_gaps(telemetry.as_searches(collected.searches(*tables)), tables[0], telemetry.results(every(*tables)))
    unmet = F.col("zero_offering_count") + F.col("fully_excluded_count")
    want = {tuple(r) for r in one_by_one.select("category", "search_count", unmet, "certification_gap").collect()}
    assert got == want and any(x[2] for x in want) and any(x[3] for x in want)
