"""Collectors over landed files, and the sink of runs."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tradeloom.operators import identity
from tradeloom.sources import collectors, sinks

FILER = {
    "cik": 320193, "name": "A Inc", "entityType": "operating", "sic": "3571", "sicDescription": "Computers", "ein": "", "tickers": ["X", "", "Y"], "exchanges": [], "phone": None,
    "addresses": {"business": {"street1": "1 Way", "city": "C", "stateOrCountry": "CA", "zipCode": "1"}}, "formerNames": [{"name": "Old"}, {"name": ""}, {"name": "Older"}],
}
LANDED = {
    "registry": [{"records": [{"CIN": "U1", "Company Name": " One "}, {"Company Name": "no id"}]}, {"records": [{"cin": "U2", "CompanyName": "Two"}]}],
    "filer": [FILER, {"cik": "12345678901", "name": "B"}],
    "census": [[["ESTAB", "NAICS2017", "state"], ["12", "31", "06"]], [["ESTAB"]]],
    "trade": [{"query": "q", "report": {"dto": {"tables": [{"column_groups": [{"label": "id"}], "row_groups": [{"rowsNew": [{"rowEntries": [{"value": "7"}]}]}]}]}}}],
    "manual": [{"company_name": "M", "entered_by": "p", "evidence_url": "u"}, {"company_name": "M"}],
    "mock": [{"id": "1", "name": "mock"}],
}


def digest(content):
    return hashlib.sha256(json.dumps(content, sort_keys=True).encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(LANDED))
def test_collectors_read_landed_files(spark, tmp_path, name):
    for i, body in enumerate(LANDED[name]):
        (tmp_path / f"part-{i}.json").write_text(json.dumps(body) + "\n\n")
    (tmp_path / "_SUCCESS").write_text("")
    out = collectors.read_landed(spark, name, str(tmp_path))
    rows = {r.external_id: r for r in out.collect()}
    want = {"registry": {"U1", "U2"}, "filer": {"0000320193", "12345678901"}, "census": {"cbp:2021:state:06:naics:31"}, "trade": {"usitc:q:measure:0:row:0"}, "manual": {"u"}, "mock": {"1"}}
    assert set(rows) == want[name]
    assert all(r.content_hash == digest(r.content) and r.collector == name for r in rows.values())
    assert out.rdd.getNumPartitions() == len(LANDED[name])
    if name == "filer":
        a = rows["0000320193"].content
        assert (a["cik"], a["tickers"], a["exchanges"], a["ein"], a["former_names"], a["business_address_zip"]) == ("0000320193", "X, Y", None, None, "Old, Older", "1") and len(a) == 18
    if name in ("registry", "filer", "manual"):
        known = out.select(F.monotonically_increasing_id().alias("observation_id"), "content", "profile")
        assert {r.name for r in identity.identities(known).collect()} <= {"One", "Two", "A Inc", "B", "M"}


def test_an_unknown_collector_is_refused(spark, tmp_path):
    with pytest.raises(collectors.UnknownCollector, match="registry"):
        collectors.read_landed(spark, "nobody", str(tmp_path))
    with pytest.raises(Exception, match="no collector is named"):
        spark.read.format("landed").option("collector", "nobody").option("path", str(tmp_path)).load().collect()


def test_a_repeated_run_leaves_the_same_rows(spark, tmp_path):
    path = str(tmp_path / "telemetry")
    rows = lambda *ids: spark.createDataFrame([(i, f"s{i}") for i in ids], "search_id bigint, snapshot string")
    held = lambda: sorted((r.run_id, r.search_id) for r in sinks.runs(spark, path).collect())
    sinks.append_run(rows(1, 2), path, "a")
    sinks.append_run(rows(3), path, "b")
    sinks.append_run(rows(1, 2), path, "a")
    assert held() == [("a", 1), ("a", 2), ("b", 3)]
    sinks.append_run(rows(5), path, "b")
    assert held() == [("a", 1), ("a", 2), ("b", 5)]
    with pytest.raises(sinks.SchemaChanged):
        sinks.append_run(rows(1).withColumn("more", F.lit(1)), path, "c")
    with pytest.raises(ValueError, match="run_id"):
        sinks.append_run(rows(1).withColumn("run_id", F.lit("x")), path, "c")
    assert held() == [("a", 1), ("a", 2), ("b", 5)]
