"""Turn repair, fill-in-the-middle and token counts against brute force, SQL and the library."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tradeloom.llm import fill_middle, token_counts, turn_repair

MODEL = P.path("piece_bpe_32k.model")
TURNS = "conv_id bigint, turn bigint, role string, text string"
VISIBLE = re.compile("[^\x20\x09-\x0d]")


# ------------------------------------------------------------------ turn repair


def cheapest(rows):
    """All edits in order of cost and letters: (cost, letters, roles)."""
    heap = [(0, "", 0, "")]
    while True:
        cost, letters, i, roles = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, letters, roles
        if not re.fullmatch("s?(ua)*u?", roles):
            continue
        for r in "ua":
            heapq.heappush(heap, (cost + 3, letters + "I", i, roles + r))
        if i < len(rows):
            role, fault = rows[i]
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, roles))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                heapq.heappush(heap, (cost + more, letters + "K", i + 1, roles + (role[:1] or "?")))
                for r in "ua":
                    heapq.heappush(heap, (cost + 3 + more, letters + "R", i + 1, roles + r))


def expected(rows):
    """op11 of (turn, role, text) rows of one conversation id, one row at a time."""
    conv, rows = rows
    damaged = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm:
            text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
            damaged += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in damaged:
        marks = VISIBLE.findall(text)
        faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    cost, letters, _ = cheapest([(r[1], f) for r, f in zip(damaged, faults)])
    out, left, roles = [], list(damaged), "?"
    for letter in letters:
        row = left.pop(0) if letter != "I" else (None, "", "")
        if letter != "D":
            role = row[1] if letter == "K" else "assistant" if roles[-1] == "u" else "user"
            out.append(f"{role}:{row[2]}")
            roles += role[0]
    turns = [r[0] for r in damaged if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[1][:1] for r in damaged]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    n = Counter(faults)
    return (conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest())


def conversations(seed=5, n=120):
    rng = random.Random(seed)
    texts = ["Hello there.", "Yes!", "What is it?", "cut off here", "", " \t", None, "Hello there.", "no end", "Fine.\n", "one. two", "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 6)):
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            rows.append((c if c else None, rng.choice([t, t, t, t + 5, None]), role, rng.choice(texts)))
    return rows + [rows[0], rows[0], (n, -7, "user", "Hi."), (n, 2**40, "assistant", "Ok.")]


def save(df):
    return df.persist()


def test_turn_repair_equals_brute_force(spark):
    rows = conversations()
    groups = {}
    for c, *rest in rows:
        groups.setdefault(c, []).append(tuple(rest))
    want = Counter(map(expected, groups.items()))
    df = spark.createDataFrame(rows, TURNS).repartition(3).withColumns({c: F.lit(7) for c in ("digest", "kind", "fault", "audit", "nth", "harm", "every_id")})
    got = turn_repair.op11(df, save)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert Counter(map(tuple, got.collect())) == want
    assert len({w[7] for w in want}) > 40


def test_blocks_decide_as_the_whole():
    rng = random.Random(9)
    for _ in range(1500):
        rows = [(rng.choice("suau-"), rng.choice(["", "", "truncated", "blank"])) for _ in range(rng.randint(0, 6))]
        codes = [r + {"": "-", "truncated": "t", "blank": "x"}[f] for r, f in rows]
        want = cheapest(rows)[:2]
        for size in (1, 2, 100):
            ways = turn_repair.Ways()
            for i in range(0, len(codes), size):
                ways.block("".join(codes[i : i + size]))
            ways.block("", True)
            cost, letters = ways.result()
            assert (cost, letters.decode()) == want


def test_repaired_turns_and_a_long_conversation(spark):
    long = [(1, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(3000) if t != 1000]
    turns = spark.createDataFrame([*long, (2, 0, "assistant", "Hi."), (2, 1, "user", "x" * 5_000_000 + ".")], TURNS)
    decided = save(turn_repair.decisions(turns))
    fixed = turn_repair.repaired(turns, decided).orderBy("conv_id", "nth").collect()
    audits = {r.conv_id: (r.cost, r.audit) for r in decided.collect()}
    assert audits[1] == (3, "K" * 1000 + "I" + "K" * 1999) and audits[2] == (6, "IKKI")
    one = [r for r in fixed if r.conv_id == 1]
    assert [r.nth for r in one] == list(range(1, 3001)) and (one[1000].role, one[1000].text, one[1000].edit) == ("user", "", "I")
    assert [(r.role, len(r.text)) for r in fixed if r.conv_id == 2] == [("user", 0), ("assistant", 3), ("user", 5_000_001), ("assistant", 0)]


def test_turn_repair_of_nothing(spark):
    assert turn_repair.op11(spark.createDataFrame([], TURNS), save).collect() == []
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = turn_repair.op11(spark.createDataFrame([(dropped, 0, "user", "Hi.")], TURNS), save).collect()
    assert [tuple(r) for r in row] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# ------------------------------------------------------------------ fill in the middle


def filled(doc_id, text):
    text = text or ""
    n = len(text)
    digits = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h = [int(digits[i * 8 : i * 8 + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    p, m, s = text[:a], text[a:b], text[b:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (doc_id, n, form, a, b - a, sha(out), sha(text))


def odd_texts():
    rng = random.Random(4)
    mixed = "".join(rng.choice("aé漢\U0001f600") for _ in range(30_000))
    steep = "a" * 5000 + "漢" * 5000 + "é" * 3000 + "\U0001f600" * 2000
    return [mixed, steep, "<P", "P><S", "a<M>b", "<", "é" * 777, "x" * 5_000_000, "\x00\x01", "\U0001f600"] + [mixed[i : i + 40] for i in range(0, 4000, 40)]


def test_fill_in_middle_equals_brute_force(spark, docs):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(r.doc_id, r.text) for r in docs.collect()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("n", "form", "output")})
    got = fill_middle.op12(df.repartition(3))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(filled(*r) for r in rows)
    assert {r.form for r in got.collect()} == {"plain", "psm", "spm"}
    assert fill_middle.op12(df.limit(0)).collect() == []


def test_outputs_and_other_units(spark):
    texts = odd_texts()[:6] + ["one two  three four ", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in fill_middle.fill_in_middle(df, unit=r"\s*\S+").collect():
        assert fill_middle.restored(r.output.encode(), r.form).decode() == texts[r.doc_id]
        if r.form != "plain":
            at = len(r.output) - len(texts[r.doc_id])
            assert at == 9 and r.prefix_units + r.middle_units <= r.n
    words = fill_middle.matches(np.frombuffer(b"one two  three", np.uint8), __import__("regex").compile(rb"\s*\S+"))
    assert [words.offset(k) for k in range(words.n + 1)] == [0, 3, 7, 14]


def test_rank_index_is_exact_and_bounded():
    for text in odd_texts():
        raw = np.frombuffer(text.encode(), np.uint8)
        index = fill_middle.code_points(raw)
        want = np.cumsum([0] + [len(c.encode()) for c in text[:20_000]])
        assert [index.offset(k) for k in range(len(want))] == want.tolist()
        assert all(abs(index.predicted(k) - w) <= fill_middle.BOUND for k, w in enumerate(want.tolist()))
    assert len(fill_middle.code_points(np.frombuffer(odd_texts()[1].encode(), np.uint8)).starts) > 3


def test_fill_in_middle_twin(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    got = fill_middle.op12(spark.read.parquet(f"{sf}/documents.parquet"))
    columns = sorted(got.columns)
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(c.sql(fill_middle.ORACLE).select(*columns).fetchall())


# ------------------------------------------------------------------ token counts


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def counted_texts(docs):
    rng = random.Random(6)
    parts = ["a", "b", "t", "the", " ", "  ", "\n", "\t", "é", "中", "\U0001f600", "<s>", "</s>", "<unk>", "<0x0A>", "ing", " the", "10", "▁", "==", "////", "\x00", "ß", "́", " " * 17, "A" * 9, "ａ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    return texts + [r.text for r in docs.collect()] + ["aaaa" * 100, "word" * 300, " " * 300, "=" * 200 + "\n", "", None]


def test_counts_of_all_prefixes(spark, docs, library):
    texts = counted_texts(docs)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for r in token_counts.prefix_counts(df, MODEL, keep=("doc_id",)).collect():
        text = texts[r.doc_id] or ""
        assert r.n_bytes == len(text.encode()) and len(r.prefix_tokens) == len(text)
        places = range(1, len(text) + 1) if len(text) < 80 else random.Random(1).sample(range(1, len(text) + 1), 25) + [len(text)]
        assert [r.prefix_tokens[i - 1] for i in places] == [len(library.encode(text[:i])) for i in places]


def test_budgets_without_encoding(spark, docs, library):
    texts = counted_texts(docs)[:80] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = token_counts.prefix_counts(df, MODEL, keep=("doc_id",)).select("doc_id", token_counts.tokens_of("prefix_tokens", 5).alias("five"), token_counts.chars_within("prefix_tokens", 7).alias("seven"), token_counts.chars_within("prefix_tokens", 0).alias("none"))
    for r in out.collect():
        text = texts[r.doc_id] or ""
        assert r.five == len(library.encode(text[:5])) and r.none == 0
        assert r.seven == max(i for i in range(len(text) + 1) if len(library.encode(text[:i])) <= 7)


def test_op13_on_given_texts(spark, docs, nothing, library):
    odd = spark.createDataFrame([(1, "word " * 5000, 0), (2, "ab" * 600_000, 0), (2, "ab" * 600_000, 0), (None, None, 0)], "doc_id bigint, text string, prefix_tokens int")
    got = token_counts.op13(odd, MODEL)
    rows = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect())
    long = len(library.encode("ab" * 600_000))
    assert rows == Counter({(1, 25_000, len(library.encode("word " * 5000)), True): 1, (2, 1_200_000, long, True): 2, (None, 0, 0, False): 1})
    assert token_counts.op13(nothing, MODEL).collect() == []
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in given.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.op13(given, MODEL).collect()} == {d: len(library.encode(t)) for d, t in texts.items()}


def test_small_tables_of_words_change_nothing(library, monkeypatch):
    monkeypatch.setattr(token_counts, "TABLE_WORDS", 50)
    counter = token_counts.PrefixCounter(MODEL)
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(60)) for _ in range(40)]
    assert [int(counter.counts([t])[0][-1]) for t in texts] == [len(library.encode(t)) for t in texts]
