"""Streams give what the batch forms give; ingest equals the rule applied item by item."""

import random
from datetime import datetime, timedelta

import pytest

from tradeloom.operators import ingest, provenance, sessions
from tradeloom.streaming import stateful

ITEMS = "item_id bigint, source string, external_id string, content_hash string, empty boolean"


def one_by_one(items, existing):
    stored, out = [tuple(e) for e in existing], {}
    for i, source, external, content, empty in sorted(items, key=lambda r: r[0]):
        same = [e for e in stored if e[0] == source and e[2] == content and (external is None or e[1] == external)]
        out[i] = "failed" if empty or len(same) > 1 else "skipped_duplicate" if same else "created"
        if out[i] == "created":
            stored.append((source, external, content))
    return out


def items_and_store(seed, n=200):
    rng = random.Random(seed)
    named = lambda: str(rng.randint(0, 9)) if rng.random() < 0.6 else None
    content = lambda: "hot" if rng.random() < 0.35 else f"h{rng.randint(0, 25)}"
    rows = [(i, f"s{rng.randint(0, 1)}", named(), content(), rng.random() < 0.1) for i in range(n)]
    return rows, list({("s0", str(i), f"h{i}") for i in range(6)} | {("s1", None, "h3"), ("s0", "7", "h1"), ("s1", "1", "hot")})


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ingest_equals_one_by_one(spark, seed):
    rows, store = items_and_store(seed)
    got = ingest.outcomes(spark.createDataFrame(rows, ITEMS).repartition(3), spark.createDataFrame(store, "source string, external_id string, content_hash string"))
    assert {r.item_id: r.outcome for r in got.collect()} == one_by_one(rows, store)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    nothing = spark.createDataFrame([], ITEMS)
    assert ingest.outcomes(nothing, nothing).collect() == []


def files(spark, rows, schema, path, parts):
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[size * i : size * (i + 1)], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_ingest_stream(spark, tmp_path):
    rows, store = items_and_store(4, 90)
    stream = files(spark, rows, ITEMS, str(tmp_path / "in"), 3)
    known = spark.createDataFrame(store, "source string, external_id string, content_hash string")
    run = lambda: stateful.ingest_stream(stream, known, str(tmp_path / "store"), str(tmp_path / "c")).awaitTermination()
    run()
    run()  # nothing new: nothing counts twice
    got = spark.read.parquet(str(tmp_path / "store")).collect()
    assert {r.item_id: r.outcome for r in got} == one_by_one(rows, store) and len(got) == 90
    more = [(100, "s0", "new", "h0", False), (101, "s0", "new", "h0", False), (102, "s1", None, "h3", False)]
    spark.createDataFrame(more, ITEMS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = {r.item_id: r.outcome for r in spark.read.parquet(str(tmp_path / "store")).collect()}
    assert got == one_by_one(rows + more, store)


def memory(stream, name, path):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_lockouts_on_a_stream(spark, tmp_path):
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    schema = "user_id bigint, event_id bigint, ts timestamp, failed boolean, succeeded boolean"
    log, at = [], start
    for i in range(160):
        at += timedelta(seconds=rng.choice([1, 5, 20, 40, 300]))
        if i == 120:
            at += timedelta(days=2)  # strikes are forgotten
        kind = rng.random()
        log.append((rng.randint(1, 2), i, at, kind < 0.8, kind > 0.93))
    want = {tuple(r) for r in sessions.lockouts(spark.createDataFrame(log, schema)).collect()}
    late = [log[i] for i in sorted(range(160), key=lambda i: i + rng.randint(0, 3))]  # out of order by some rows
    late.append((9, 999, at + timedelta(days=30), True, False))  # moves the watermark past all others
    late.append((9, 1000, at + timedelta(days=60), True, False))
    stream = files(spark, late, schema, str(tmp_path / "in"), 6)
    got = {tuple(r) for r in memory(stateful.lockouts_stream(stream, "1 hour"), "locked", tmp_path / "c").where("user_id < 9").collect()}
    assert got == want and {"blocked", "failed", "passed"} == {r[2] for r in want}


@pytest.mark.parametrize("days", [None, 30])
def test_conflicts_on_a_stream(spark, tmp_path, days):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(days is None).lower())
    rng = random.Random(6)
    schema = "record_id bigint, company_id bigint, field_name string, value_observed string"
    rows = [(i, rng.randint(1, 6), rng.choice(["name", "city"]), rng.choice(["x"] * 9 + ["y", None])) for i in range(80)]
    stream = files(spark, rows, schema, str(tmp_path / "in"), 5)
    got = [(r.record_id, r.conflict_id) for r in memory(stateful.conflict_stream(stream, days), f"disputes_{days}", tmp_path / "c").collect()]
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    none = spark.createDataFrame([], "company_id bigint, field_name string, conflict_id bigint")
    want = {(r.record_id, r.conflict_id) for r in provenance.tag_conflicts(spark.createDataFrame(rows, schema), none).collect()}
    assert set(got) == want and len(got) == len(want) and want and len(want) < 80
