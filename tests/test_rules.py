"""Rules on tiny frames, and helpers against brute force."""

import difflib
import hashlib
import json
import random
import unicodedata
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tradeloom.functions import exact, text
from tradeloom.operators import decisions, promote, provenance, ranks, resolve, sessions, similar
from tradeloom.sources import payloads
from tradeloom.streaming import jobs


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_names(spark):
    for raw in ("Quill Castings Pvt. Ltd.", "Quill Castings", "Quill  Castings Private Limited"):
        assert one(spark, raw, text.match_name) == "QUILL CASTINGS"
    assert one(spark, "Limited", text.match_name) == "LIMITED"
    assert one(spark, "https://www.Quill.example//", text.match_domain) == "quill.example"


def test_dates_numbers_places(spark):
    assert str(one(spark, "1/9/2015", text.registration_date)) == "2015-09-01"
    assert one(spark, "31/02/2015", text.registration_date) is None
    assert [one(spark, x, text.number) for x in ("5d", "0x1p3", "1_000", " 2.5 ", "")] == [None, None, 1000.0, 2.5, None]
    f = lambda c: text.city_from_address(c, F.lit("Maharashtra"))
    assert one(spark, "7 Lake Lane, Nashik, Maharashtra 422001", f) == "Nashik"
    assert one(spark, "Mozilla/5.0 (iPhone) Version/16 Safari/1", text.platform) == "iOS"


def test_fuzzy_join_loses_no_pair(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 9)))
    left = sorted({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(60)})
    right = sorted({(x[:-1] + rng.choice("xyz")) if rng.random() < 0.5 else word() + " " + word() for x in left for _ in range(2)})
    want = {(a, b) for a in left for b in right if difflib.SequenceMatcher(None, a, b).ratio() >= 0.72}
    got = similar.similar_names(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string"), 0.72)
    assert {(r.a, r.b) for r in got.collect()} == want


def test_slugs(spark):
    new = spark.createDataFrame([(1, "Acme"), (2, "ACME!"), (3, "Acme 2"), (4, "!!")], "id bigint, name string")
    out = promote.allocate_slugs(new, spark.createDataFrame([("acme",)], "slug string"))
    assert {r.id: r.slug for r in out.collect()} == {1: "acme-2", 2: "acme-3", 3: "acme-2-2", 4: "company"}


def test_slugs_equal_one_by_one(spark):
    rng = random.Random(9)
    names = ["Zed", "Zed", "Zed 2", "Yak", "Yak", "Wolf 3", "Ox", "漢字", "Ox-1", "Ox-02"]
    new = [(i, rng.choice(names[:5] if i % 2 else names)) for i in range(120)]
    existing = ["yak", "yak-2", "yak-4", "yak-5", "yak-1", "yak-03", "yak-4-2", "company-2", "ox-7", "zed-3"]
    used, want = set(existing), {}
    base = {r.id: r.s for r in spark.createDataFrame(new, "id bigint, name string").select("id", text.slug(F.col("name")).alias("s")).collect()}
    for i, _ in new:
        slug, n = base[i], 2
        while slug in used:
            slug, n = f"{base[i]}-{n}", n + 1
        used.add(slug)
        want[i] = slug
    got = promote.allocate_slugs(spark.createDataFrame(new, "id bigint, name string"), spark.createDataFrame([(s,) for s in existing], "slug string"))
    assert {r.id: r.slug for r in got.collect()} == want


def test_a_stem_of_half_the_names(spark):
    """Half of 4,000 names and of 600 used slugs share a stem; no part of it is large, and the result is the same."""
    rng = random.Random(3)
    new = [(i * 3, "Acme Works" if i % 2 else "Firm" + "abcdefgh"[i % 8] + "q" * (i % 5)) for i in range(4000)]
    rng.shuffle(new)
    existing = sorted({"acme-works" if rng.random() < 0.01 else f"acme-works-{rng.randint(2, 900)}" for _ in range(600)} | {"firma-2", "firmbq"})
    used, want = set(existing), {}
    for i, name in sorted(new):
        base, n = name.lower().replace(" ", "-"), 2
        slug = base
        while slug in used:
            slug, n = f"{base}-{n}", n + 1
        used.add(slug)
        want[i] = slug
    frame = spark.createDataFrame(new, "id bigint, name string")
    for heavy in (300, 10**6):
        got = promote.allocate_slugs(frame, spark.createDataFrame([(s,) for s in existing], "slug string"), heavy)
        assert {r.id: r.slug for r in got.collect()} == want
    parts = frame.where("name = 'Acme Works'").withColumn("part", ranks.parts_of(frame, "id", 8)).groupBy("part").count().collect()
    assert len(parts) == 8 and max(p["count"] for p in parts) < 300


def test_slugs_of_two_unicode_forms(spark):
    new = spark.createDataFrame([(1, "Caf\u00e9"), (2, "Cafe\u0301"), (3, "\uff21\uff22")], "id bigint, name string")
    assert {r.id: r.slug for r in promote.allocate_slugs(new, spark.createDataFrame([("cafe-2",)], "slug string")).collect()} == {1: "cafe", 2: "cafe-3", 3: "ab"}


def test_replay(spark):
    records = spark.createDataFrame([(1, "observed"), (2, "verified")], "record_id bigint, status string")
    log = spark.createDataFrame([(1, 0, "review", None), (1, 1, "verify", None), (1, 2, "verify", None), (2, 0, "reject", "no"), (2, 1, "expire", None)], "record_id bigint, seq int, action string, note string")
    out = {r.record_id: (r.status, r.refused) for r in decisions.replay(records, log).collect()}
    assert out == {1: ("verified", 1), 2: ("expired", 1)}


def test_first_hit_window_and_lockout():
    assert [(i, h) for i, h, _ in sessions.first_hit_window([0, 1, 2, 3, 11, 12], 10, 2)[0]] == [(2, 3), (3, 4)]
    state, out = None, []
    for t in [0.0, 1.0, 2.0, 3.0, 4.0, 10.0, 40.0]:
        state, row = sessions.lockout_step(state, t, True, False)
        out.append(row)
    assert [x[0] for x in out] == ["failed"] * 5 + ["blocked", "failed"] and out[-1][2] == 60


def test_logs_are_walked_whole(spark):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, start + timedelta(seconds=rng.randint(0, 4000)), rng.random() < 0.8) for i in range(300)]
    log = spark.createDataFrame(rows, "user_id bigint, event_id bigint, ts timestamp, failed boolean").withColumn("succeeded", ~F.col("failed")).repartition(3)
    got = {(r.user_id, r.event_id, r.outcome, r.strikes, r.lock_seconds) for r in sessions.lockouts(log).collect()}
    breaches = {(r.user_id, r.event_id, r.hit) for r in sessions.rate_limit(log, 60, 2).collect()}
    want, seen = set(), set()
    for user in (1, 2, 3):
        strikes = first = until = 0
        window, hits = None, 0
        for _, i, at, failed in sorted((r for r in rows if r[0] == user), key=lambda r: (r[2], r[1])):
            t = at.timestamp()
            if window is None or t >= window + 60:
                window, hits = t, 0
            hits += 1
            if hits > 2:
                seen.add((user, i, hits))
            if t < until:
                want.add((user, i, "blocked", strikes, until - t))
                continue
            strikes = 0 if strikes and t >= first + 86400 else strikes
            lock = 0.0
            if failed:
                first, strikes = (first if strikes else t), strikes + 1
                if strikes >= 5:
                    lock = float(min(30 * 2 ** (strikes - 5), 900))
                    until = t + lock
            else:
                strikes = 0
            want.add((user, i, "failed" if failed else "passed", strikes, lock))
    assert got == want and breaches == seen and seen and any(x[2] == "blocked" for x in want)


def test_payloads(spark):
    body = '{"cik": "41077", "name": "A", "tickers": ["X", "", "Y"], "addresses": {"business": {"city": "C", "stateOrCountry": "S"}}}'
    r = payloads.submissions(spark.createDataFrame([(body,)], "body string")).first()
    assert (r.external_id, r.tickers, r.business_address_city) == ("0000041077", "X, Y", "C")
    rows = spark.createDataFrame([('[["ESTAB", "NAICS2017", "state"], ["12", "31", "06"]]',), ('[["ESTAB"]]',)], "body string")
    assert [r.external_id for r in payloads.pattern_rows(rows, 2021).collect()] == ["cbp:2021:state:06:naics:31"]


def test_rate_limits_on_a_stream(spark, tmp_path):
    rng = random.Random(2)
    start = datetime(2024, 1, 1)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, start + timedelta(seconds=rng.randint(0, 4000)), rng.random() < 0.8) for i in range(300)]
    log = spark.createDataFrame(rows, "user_id bigint, event_id bigint, ts timestamp, failed boolean").withColumn("succeeded", ~F.col("failed")).repartition(3)
    got = {(r.user_id, r.event_id, r.outcome, r.strikes, r.lock_seconds) for r in sessions.lockouts(log).collect()}
    breaches = {(r.user_id, r.event_id, r.hit) for r in sessions.rate_limit(log, 60, 2).collect()}
    want, seen = set(), set()
    for user in (1, 2, 3):
        strikes = first = until = 0
        window, hits = None, 0
        for _, i, at, failed in sorted((r for r in rows if r[0] == user), key=lambda r: (r[2], r[1])):
            t = at.timestamp()
            if window is None or t >= window + 60:
                window, hits = t, 0
            hits += 1
            if hits > 2:
                seen.add((user, i, hits))
            if t < until:
                want.add((user, i, "blocked", strikes, until - t))
                continue
            strikes = 0 if strikes and t >= first + 86400 else strikes
            lock = 0.0
            if failed:
                first, strikes = (first if strikes else t), strikes + 1
                if strikes >= 5:
                    lock = float(min(30 * 2 ** (strikes - 5), 900))
                    until = t + lock
            else:
                strikes = 0
            want.add((user, i, "failed" if failed else "passed", strikes, lock))
    assert got == want and breaches == seen and seen and any(x[2] == "blocked" for x in want)


def test_payloads(spark):
    body = '{"cik": "41077", "name": "A", "tickers": ["X", "", "Y"], "addresses": {"business": {"city": "C", "stateOrCountry": "S"}}}'
    r = payloads.submissions(spark.createDataFrame([(body,)], "body string")).first()
    assert (r.external_id, r.tickers, r.business_address_city) == ("0000041077", "X, Y", "C")
    rows = spark.createDataFrame([('[["ESTAB", "NAICS2017", "state"], ["12", "31", "06"]]',), ('[["ESTAB"]]',)], "body string")
    assert [r.external_id for r in payloads.pattern_rows(rows, 2021).collect()] == ["cbp:2021:state:06:naics:31"]


def test_streams_equal_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "s", str(rng.randint(0, 9)) if rng.random() < 0.8 else None, f"h{rng.randint(0, 5)}", rng.random() < 0.1) for i in range(60)]
    schema = "item_id bigint, source string, external_id string, content_hash string, empty boolean"
    for i in range(3):
        spark.createDataFrame(rows[20 * i : 20 * i + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.ingest_stream(stream, str(tmp_path / "store"), str(tmp_path / "c1")).awaitTermination()
    got = {r.item_id: r.outcome for r in spark.read.parquet(str(tmp_path / "store")).collect()}
    assert len(got) == 60
    named = {r.item_id: r.outcome for r in ingest.outcomes(spark.createDataFrame([r for r in rows if r[2]], schema), spark.createDataFrame([], schema)).collect()}
    assert {k: v for k, v in got.items() if k in named} == named

    start = datetime(2024, 1, 1)
    hits = [(rng.randint(1, 3), i, start + timedelta(seconds=7 * i)) for i in range(90)]
    frame = "user_id bigint, event_id bigint, ts timestamp"
    for i in range(3):
        spark.createDataFrame(hits[30 * i : 30 * i + 30], frame).coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
    q = jobs.rate_limit_stream(spark.readStream.schema(frame).parquet(str(tmp_path / "ev")), 60, 2).writeStream.format("memory").queryName("breaches").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.user_id, r.event_id, r.hit) for r in sessions.rate_limit(spark.createDataFrame(hits, frame), 60, 2).collect()}
    assert {(r.user_id, r.event_id, r.hit) for r in spark.table("breaches").collect()} == want


def test_unicode_forms_and_hashes(spark):
    for raw in ("Ｑｕｉｌｌ ﬁne", "Cafe\u0301", "Ångström 漢字", "plain", "", None):
        for form in ("NFKC", "NFKD"):
            assert one(spark, raw, lambda c: exact.normalized(c, form)) == (None if raw is None else unicodedata.normalize(form, raw))
    assert one(spark, "Ｑｕｉｌｌ Ｐｖｔ. Ｌｔｄ.", lambda c: text.match_name(exact.normalized(c, "NFKC"))) == "QUILL"
    assert one(spark, "Ångström Mühle", lambda c: text.slug(exact.normalized(c, "NFKD"))) == "angstrom-muhle"
    body = {"z": "Mühle 漢字 😀", "a": None, "m": {"y": 1.50, "x": [True, 10**20]}}
    want = hashlib.sha256(json.dumps(body, sort_keys=True).encode("utf-8")).hexdigest()
    assert one(spark, json.dumps(body, ensure_ascii=False, indent=1), exact.content_hash) == want and one(spark, None, exact.content_hash) is None


def test_trade_tables(spark):
    groups = [{"label": "year"}, [{"columns": [{"label": "value"}, {"label": "deep", "columns": [{"label": "value"}]}]}], {"other": 1}]
    lines = [{"rowEntries": [{"value": "2020"}, {"value": "1"}, {"value": "2"}, {"value": "beyond"}]}, {"rowEntries": [{"value": "2021"}, {"value": None}]}, {}]
    tables = [{"column_groups": groups, "row_groups": [{"rowsNew": lines}, {"rowsNew": lines}]}, {"column_groups": [], "row_groups": []}, {"column_groups": groups}]
    rows = spark.createDataFrame([("q", json.dumps({"dto": {"tables": tables}})), ("none", json.dumps({"dto": {}}))], "query string, body string")
    got = {r.external_id: r.cells for r in payloads.trade_tables(rows).collect()}
    assert got["usitc:q:measure:0:row:0"] == {"col:year": "2020", "col:value": "2"}
    assert got["usitc:q:measure:0:row:1"] == {"col:year": "2021", "col:value": None}
    assert all(x.startswith("usitc:q:measure:0:") for x in got)


def test_secrets_are_hidden(spark):
    rows = spark.sql("SELECT 'refused' AS m, map('Password', 'p', 'api_key', 'k', 'kind', 'x') AS c UNION ALL SELECT NULL, map_filter(map('a', 'b'), (k, v) -> false)")
    row = rows.select(payloads.error_text(F.col("m"), F.col("c"))).collect()
    assert [r[0] for r in row] == ["refused (config: {'Password': '***REDACTED***', 'api_key': '***REDACTED***', 'kind': 'x'})", "Unknown error"]


def test_submitted_by_hand(spark):
    rows = spark.createDataFrame([("A", "me", ""), ("", "me", "u"), ("B", None, "u"), ("C", "me", "u")], "company_name string, entered_by string, evidence_url string")
    assert [(r.company_name, r.external_id) for r in payloads.manual(rows).collect()] == [("A", None), ("C", "u")]


def test_a_user_with_a_third_of_all_events(spark):
    """Chunks of a hot log, summed up and composed, give the walk's breaches; so do gaps, ties and rows without a user."""
    rng = random.Random(13)
    start, rows = datetime(2024, 1, 1), []
    for user, n in ((1, 700), (None, 300), (2, 250), (3, 5)):
        at = start
        for _ in range(n):
            at += timedelta(seconds=rng.choice([0, 0, 1, 3, 10, 30, 61, 400]) * rng.random())
            rows.append((user, len(rows), at))
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "user_id bigint, event_id bigint, ts timestamp").repartition(5)
    for seconds, most in ((60, 3), (600, 20), (100_000, 2), (1, 1)):
        want = set()
        for user in (1, None, 2, 3):
            log = sorted((at.timestamp(), e) for u, e, at in rows if u == user)
            found, _, _ = sessions.first_hit_window([t for t, _ in log], seconds, most)
            want |= {(user, log[i][1], hit, round(wait, 3)) for i, hit, wait in found}
        for heavy in (200, 10**6):
            got = sessions.rate_limit(events, seconds, most, heavy=heavy, parts=16)
            assert {(r.user_id, r.event_id, r.hit, round(r.retry_after, 3)) for r in got.collect()} == want
