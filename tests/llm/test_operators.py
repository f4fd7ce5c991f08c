"""Each operator against brute force or a library, on small frames that hold the odd cases; and on empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from tokenizers import Tokenizer

from tradeloom.llm import bpe, mixing, ngram_lm, preference, quality, simhash, suffix_dedup, token_store, toxicity, vp_search
from tradeloom.llm.common import fold, written

SPACE = rb"[^\x20\x09-\x0D]+"
save = lambda df: written(df, "test")


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def bag(rows):
    return Counter(map(tuple, rows))


def test_bpe_equals_library(docs, nothing):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter()
    for k, text in rows_of(docs):
        ids = t.encode(text, add_special_tokens=False).ids
        want[k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert bag(bpe.op2(docs, P.path("word_bpe_49k.json")).collect()) == want
    assert bpe.op2(nothing, P.path("word_bpe_49k.json")).count() == 0


def test_long_words_merge_alike():
    b = bpe.load(P.path("word_bpe_49k.json"))
    for text in ("ab" * 300, "the" * 200, "z" * 999):
        parts = [b.first[x] for x in text.encode()]
        short, bpe.SHORT = bpe.SHORT, 1 << 30
        try:
            assert b.merge(list(parts)) == b.merge_long(list(parts))
        finally:
            bpe.SHORT = short


STORE = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN, "<|endoftext|>", 50256)


def test_token_store_round_trip(spark, docs, nothing, tmp_path):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = sorted(token_store.op5(docs, *STORE).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: (x is not None, x))
    want = Counter((k, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())) for k, text in rows_of(docs) for ids in [t.encode(text, add_special_tokens=False).ids])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    assert token_store.op5(nothing, *STORE).count() == 0
    token_store.write_store(docs, str(tmp_path / "s"), *STORE, 2, shard_ids=200)
    found = token_store.lookup(spark, str(tmp_path / "s"), spark.createDataFrame([(1,), (2,), (10**9,)], "doc_id bigint"))
    text = dict(rows_of(docs))
    assert {r.doc_id: list(r.ids) for r in found.collect()} == {k: [*t.encode(text[k], add_special_tokens=False).ids, 2] for k in (1, 2)}


def test_perfect_hash_refutes_strangers():
    keys = [(i * 7, 0) for i in range(500)] + [(None, 0), (7, 1)]
    index = token_store.Index(token_store.build_index(keys, list(range(502)), [1] * 502))
    assert [index.find(*k)[0] for k in keys] == list(range(502))
    assert not any(index.find(i * 7 + 1) for i in range(500))


def print_of(text, width):
    w = [x for x in re.findall(SPACE, text.encode().lower())]
    shingles = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    count = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum((2 * c > len(shingles)) << b for b, c in enumerate(count))


def linked(prints, threshold):
    group = {p: p for p in prints}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= threshold:
                group[top(a)] = top(b)
    return {p: top(p) for p in prints}


def test_simhash_equals_brute_force(docs, nothing):
    prints = [(k, print_of(t, 3)) for k, t in rows_of(docs)]
    group = linked({p for _, p in prints}, 2)
    least = {}
    for k, p in prints:
        if k is not None:
            least[group[p]] = min(least.get(group[p], k), k)
    assert bag(simhash.op7(docs).collect()) == Counter((k, f"{p:016x}", least.get(group[p])) for k, p in prints)
    assert simhash.op7(nothing).count() == 0


@pytest.mark.parametrize("threshold", [1, 2, 3, 4])
def test_covering_loses_no_link(spark, threshold):
    rng = np.random.default_rng(threshold)
    centre = rng.integers(0, 1 << 63, 3)
    fps = set()
    for c in centre.tolist():
        for _ in range(150):  # large groups of near fingerprints around each
            x = c
            for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << b
            fps.add(x)
    fps |= set(rng.integers(0, 1 << 63, 200).tolist())
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = [(r.u, r.v) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), threshold).collect()]
    group = {p: p for p in signed}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for u, v in edges:
        group[top(u)] = top(v)
    want = linked(fps, threshold)
    un = lambda x: x & (1 << 64) - 1
    assert len({top(p) for p in signed}) == len(set(want.values()))
    assert len({(top(p), want[un(p)]) for p in signed}) == len(set(want.values()))


def removal(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, x in zip(t, gone) if not x)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_dedup_equals_brute_force(docs, nothing, hot):
    rows = rows_of(docs)
    want = Counter((k, *r) for (k, _), r in zip(rows, removal([t.encode() for _, t in rows], 200)))
    assert bag(suffix_dedup.digest(suffix_dedup.removed(docs, 200, hot)).collect()) == want
    assert suffix_dedup.op8(nothing).count() == 0


def test_quality_counts_and_verdict(docs, nothing):
    got = quality.op9(docs).collect()
    want = Counter()
    for k, text in rows_of(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[k, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)] += 1
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.op9(nothing).count() == 0


def test_quality_posterior_equals_python(spark):
    votes = [(-1, 0), (0, 1), (0, 0)]
    k = len(quality.rules())
    patterns = [tuple(v[i % 2] if i in (j, 7) else 0 for i in range(k)) for j, v in enumerate(votes * 2)]
    code = lambda p: sum((v + 1) * 3**i for i, v in enumerate(p))
    counts = {p: 3 + 2 * i for i, p in enumerate(dict.fromkeys(patterns))}
    got = {r.pattern: r.quality for r in quality.posteriors(spark.createDataFrame([(code(p),) for p, n in counts.items() for _ in range(n)], "pattern int")).collect()}
    share, *rest = quality.START
    a, b, c, d = ([x] * k for x in rest)

    def belief(p):
        o = math.log(share / (1 - share))
        for j, v in enumerate(p):
            o += max(0, math.log(a[j] / c[j])) if v == 1 else min(0, math.log(b[j] / d[j])) if v == -1 else 0
        return 1 / (1 + math.exp(-o))

    for _ in range(quality.ROUNDS):
        g = {p: belief(p) for p in counts}
        good, bad = sum(n * g[p] for p, n in counts.items()), sum(n * (1 - g[p]) for p, n in counts.items())
        rate = lambda v, j, side: (1 + sum(n * (g[p] if side else 1 - g[p]) for p, n in counts.items() if p[j] == v)) / (2 + (good if side else bad))
        a, b, c, d = ([rate(v, j, side) for j in range(k)] for v, side in ((1, 1), (-1, 1), (1, 0), (-1, 0)))
        share = (1 + good) / (2 + good + bad)
    assert all(abs(got[code(p)] - belief(p)) < 1e-9 for p in counts)


def test_mixing_targets_and_limits(docs, nothing):
    got = mixing.op10(docs).collect()
    assert all(r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0) for r in got)
    assert len(got) == docs.count() and sorted(map(str, got)) == sorted(map(str, mixing.op10(docs).collect()))
    source = {}
    for r in docs.select("source", "text").collect():
        source[r.source] = source.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    names = sorted((s for s in source if s is not None)) + [None] * (None in source)
    weight, capped, total = {s: i % 3 + 1 for i, s in enumerate(names)}, set(), sum(source.values())
    while True:
        left = total - sum(3 * source[s] for s in capped)
        goal = {s: 3 * source[s] if s in capped else left * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names}
        more = {s for s in names if s not in capped and goal[s] > 3 * source[s]}
        if not more:
            break
        capped |= more
    assert {round(r.target, 6) for r in got} == {round(g, 6) for g in goal.values()}
    assert mixing.op10(nothing).count() == 0
    assert mixing.mixed(docs).columns == docs.columns


def test_split_tree_is_exact(spark):
    quotas = {"a": 1000, "b": 37, "c": 0}
    got = mixing.split_tree(spark.createDataFrame(list(quotas.items()), "s string, quota bigint"), 6, 1).collect()
    for s, n in quotas.items():
        assert sum(r.quota for r in got if r.s == s) == n
    per = [sum(r.quota for r in got if r.shard == i) for i in range(6)]
    assert max(per) - min(per) <= 3


def test_toxicity_learns_words(spark, nothing):
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeilnorst") for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(500):
        w = [word() for _ in range(120)]
        if i % 4 == 0:
            for j in range(5):
                w[j * 20] = rng.choice(["scoundrel", "blockhead", "dimwitted"])
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    rows += [(900, None, None), (901, "", None), (902, "x" * 5000, None)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if y is not None] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.op1(d, labels).collect()}
    tested = [(y, got[i].predicted) for i, _, y in rows if y is not None and got[i].held_out]
    assert sum(a == b for a, b in tested) >= 0.9 * len(tested) and len(got) == 503
    assert toxicity.op1(d, labels.limit(0)).where("score <> 0").count() == 0
    assert toxicity.op1(nothing, labels).count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney_equals_brute_force(docs, nothing, order):
    got = Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in ngram_lm.op6(docs, fold("doc_id"), order).collect())
    every = [(k, [*re.findall(SPACE, t.encode().lower()), "end"]) for k, t in rows_of(docs)]
    learned = [t for k, t in every if k is None or zlib.crc32(str(k).encode()) % 5 != 1]
    c = Counter(w for t in learned for w in t)
    total, kinds = sum(c.values()), len(c)
    grams = {order: Counter(tuple((["start"] * (order - 1) + t)[i : i + order]) for t in learned for i in range(len(t)))}
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    cut = {k: ngram_lm.discounts(*[sum(n == i for n in g.values()) for i in (1, 2, 3, 4)]) for k, g in grams.items()}
    sums = {}
    for k, g in grams.items():
        for gram, n in g.items():
            s = sums.setdefault(gram[:-1] if k > 1 else (), [0, 0.0]) if k > 1 else sums.setdefault((), [0, 0.0])
            s[0] += n
            s[1] += cut[k][min(n, 3) - 1]
    want = Counter()
    for k, t in every:
        score, history = 0.0, ["start"] * (order - 1) + t
        for i, w in enumerate(t):
            n = grams[1][(w,)]
            p = (n - (cut[1][min(n, 3) - 1] if n else 0) + sums[()][1] / (kinds + 1)) / sums[()][0]
            for m in range(2, order + 1):
                context = tuple(history[i + order - m : i + order - 1])
                if i + 1 >= m - 1 and context in sums:
                    n = grams[m][(*context, w)]
                    p = ((n - cut[m][min(n, 3) - 1] if n else 0) + sums[context][1] * p) / sums[context][0]
            score += math.log10(p)
        base = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in t)
        want[k, len(t), sum(c[w] > 0 for w in t), total, round(base, 5), round(score, 5)] += 1
    assert got == want
    assert ngram_lm.op6(nothing, fold("doc_id"), order).count() == 0


def test_nearest_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 1500)] + 0.3 * rng.normal(size=(1500, 16))
    x[100:160] = x[100]  # many equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] + [1.0] * 15), (2060, [1.0]), (2080, [None] + [1.0] * 15), (None, [1.0] * 16)]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = {(q, r + 1): int(i) for q in range(0, 1500, 20) for s in [(x * x[q]).sum(1)] for r, i in enumerate([i for i in np.lexsort((np.arange(1500), -s)) if i != q][:20])}
    exact = {(r.query_id, r["rank"]): r.vec_id for r in vp_search.op3(d, factor=1.0, shard_rows=300).collect()}
    assert exact == want
    near = {(r.query_id, r["rank"]): r.vec_id for r in vp_search.op3(d, save=save, shard_rows=300).collect()}
    assert sum(want[k] == v for k, v in near.items()) >= 0.9 * len(want)
    assert vp_search.op3(d.limit(0)).count() == 0
    assert vp_search.op3(d.where("vec_id < 3"), save=save).count() == 2


def test_preference_pairs(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", "x"), (2, 0, "user", "a"), (3, 0, "user", "a"), (4, 0, None, None), (4, 0, None, None), (5, 1, "user", ""), (None, 0, "user", "z"), (8, 0, "user", "alone")]
    d = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    got = {r.pair_id: r for r in preference.op4(d).collect()}
    assert got[0].prompt == "<|user|>\nhi<|end|>\n" and got[0].n_prompt_turns == 1
    assert got[0].chosen_text == "<|assistant|>\nyes<|end|>\n" and got[0].chosen_spans == "14-25"
    assert got[0].rejected_spans == "14-24" and (got[1].chosen_text, got[1].rejected_text) == ("", "")
    assert set(got) == {0, 1, 2} and preference.op4(d.limit(0)).count() == 0
    c = duckdb.connect()
    c.register("conversations", d.toPandas())
    want = c.sql(preference.ORACLE)
    assert sorted(map(tuple, preference.op4(d).select(*want.columns).collect())) == sorted(want.fetchall())
