"""Odd inputs of operators and stages: clashing names, very long texts, ties, repeated rows."""

import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tradeloom.llm import bpe, mixing, near_copies, ngram_lm, preference, quality, simhash, suffix_dedup, token_store, toxicity, vp_search
from tradeloom.llm.common import fold

STORE = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN, "<|endoftext|>", 50256)
#: Names that operators use for columns of their own.
OURS = "row d t text_ key fps subs pattern quality kept n_words base_failed w w_text w_n has less spans hits place digest copies s size rank source_size target block draws draw room pass shard x nth before order u v fp anchor root node held_out score n_tokens ids start k_0".split()


@pytest.fixture(scope="module")
def plain(docs):
    return docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id < 40 OR doc_id IS NULL").cache()


@pytest.fixture(scope="module")
def clashing(plain):
    return plain.withColumns({n: F.lit(777).cast("bigint") for n in OURS}).cache()


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_of_any_name(spark, plain, clashing, stage):
    got, want = stage(spark, clashing, ""), stage(spark, plain, "")
    assert got.columns == clashing.columns
    rows = got.collect()
    assert rows and all(r[n] == 777 for r in rows for n in OURS)
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in want.collect())


def test_operators_do_not_read_other_columns(spark, plain, clashing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    for run in (
        lambda d: toxicity.op1(d, labels), lambda d: bpe.op2(d, P.path("word_bpe_49k.json")), lambda d: token_store.op5(d, *STORE).drop("start"), lambda d: ngram_lm.op6(d, fold("doc_id")),
        simhash.op7, suffix_dedup.op8, quality.op9, mixing.op10,
    ):
        assert Counter(map(str, run(clashing).collect())) == Counter(map(str, run(plain).collect()))
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "vec_id bigint, embedding array<double>")
    more = vectors.withColumns({n: F.lit(777) for n in ("shard", "home", "vector", "v", "sub", "rank", "query_id", "bound", "score")})
    assert Counter(map(str, vp_search.op3(more).collect())) == Counter(map(str, vp_search.op3(vectors).collect()))
    turns = spark.createDataFrame([(0, 0, "user", "hi"), (1, 0, "user", "hi")], "conv_id bigint, turn bigint, role string, text string")
    assert preference.op4(turns.withColumns({n: F.lit(777) for n in ("t", "turns", "n", "p", "a", "b", "pair_id", "chosen")})).collect() == preference.op4(turns).collect()


def test_very_long_texts(spark):
    """Texts of over 4 MB: repeated windows told by words, whole fingerprints, tokens and repeats."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(5, 9))) for _ in range(60_000)]
    long = [rng.choice(words) for _ in range(600_000)]
    long[-3:] = long[:3]
    text = " ".join(long)
    assert len(text) > 4_000_000
    d = spark.createDataFrame([(1, text), (2, "a short one"), (3, text + " more")], "doc_id bigint, text string")
    counts = {r.doc_id: r for r in quality.op9(d).collect()}
    windows = Counter(zip(long, long[1:], long[2:]))
    again = {i + j for i, w in enumerate(zip(long, long[1:], long[2:])) if windows[w] > 1 for j in range(3)}
    assert counts[1].n_words == 600_000 and counts[1].n_repeat_words == len(again) >= 6
    tokens = {r.doc_id: r.n_tokens for r in bpe.op2(d, P.path("word_bpe_49k.json")).collect()}
    assert tokens[1] == len(Tokenizer.from_file(P.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids)
    assert {r.doc_id: r.n_tokens for r in token_store.op5(d, *STORE).collect()}[2] == 4
    n = np.zeros(64, np.int64)
    for x in zip(long, long[1:], long[2:]):
        n += np.unpackbits(np.array([xxhash.xxh64_intdigest(" ".join(x).encode(), 42)], ">u8").view(np.uint8))
    want = sum(1 << (63 - i) for i, c in enumerate(n.tolist()) if 2 * c > 599_998)
    prints = {r.doc_id: r for r in simhash.op7(d).collect()}
    assert prints[1].fingerprint == f"{want:016x}" and prints[3].component_id == 1
    removed = {r.doc_id: r for r in suffix_dedup.op8(d).collect()}
    assert removed[1].n_removed == removed[1].n_bytes == len(text) and removed[3].n_removed == len(text) and removed[2].n_removed == 0
    assert {r.doc_id for r in near_copies.deduplicated(d).collect()} == {1, 2}
    assert {r.doc_id: r.size for r in mixing.op10(d.withColumn("source", F.lit("s"))).collect()}[1] == 600_000
    scored = {r.doc_id: r for r in ngram_lm.op6(d, fold("doc_id")).collect()}
    assert scored[1].n_tokens == 600_001 and scored[1].score < 0
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id bigint, toxic int")
    assert toxicity.op1(d, labels).count() == 3


def test_windows_of_equal_hash_prefix_differ(spark):
    """400,000 words without a repeated window but six: truncated hashes alone would find more."""
    text = " ".join(f"w{i}" for i in range(400_000)) + " w0 w1 w2"
    r = quality.op9(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert (r.n_words, r.n_repeat_words) == (400_003, 6)


@pytest.mark.parametrize("kind", ["one-hot", "small integers"])
def test_ties_go_to_smaller_ids(spark, kind):
    rng = np.random.default_rng(2)
    x = np.eye(128) if kind == "one-hot" else rng.integers(-1, 2, (500, 5)).astype(float)
    ids = np.arange(len(x)) * 5
    d = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id bigint, embedding array<double>")
    there = np.abs(x).sum(1) > 0
    want = {}
    for i, q in zip(ids[there], x[there]):
        if i % 20 == 0:
            near = [j for j in np.lexsort((ids[there], -(x[there] * q).sum(1))) if ids[there][j] != i][:20]
            want |= {(int(i), r + 1): int(ids[there][j]) for r, j in enumerate(near)}
    assert {(r.query_id, r["rank"]): r.vec_id for r in vp_search.op3(d, factor=1.0, shard_rows=100).collect()} == want


def test_mix_is_near_targets_and_disjoint(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(rng.randint(1, 300))), f"s{min(3, int(rng.expovariate(0.7)))}") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    got = mixing.op10(d).collect()
    source = {i: s for i, _, s in rows}
    taken, target = Counter(), {}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert len(r.shards) <= 3 and r.taken == len(r.shards) * r.size
    assert all(abs(taken[s] - t) <= 0.03 * t + 300 for s, t in target.items())
    mix = mixing.mixed(d, shard_words=40_000)
    parts = [r[0] for r in mix.select(F.spark_partition_id()).collect()]
    assert len(set(parts)) == mix.rdd.getNumPartitions() > 4  # one partition a shard, none empty
    again = Counter((r.doc_id) for r in mixing.mixed(d, shard_words=40_000).collect())
    assert Counter(r.doc_id for r in mix.collect()) == again
    assert sum(len(re.findall("w", rows[i][1])) * n for i, n in again.items()) == pytest.approx(sum(target.values()), rel=0.03)


def test_template_texts_are_not_copies_but_their_copies_are(spark):
    """Many texts that share most of a template, too little to be copies, and a true copy of each tenth."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abdeilnorst") for _ in range(6))
    template = [word() for _ in range(200)]
    rows = []
    for i in range(300):
        own = template[:170] + [word() for _ in range(70)]
        rows.append((2 * i, " ".join(own)))
        if i % 10 == 0:
            rows.append((2 * i + 1, " ".join(own[:-4] + [word() for _ in range(4)])))
    rng.shuffle(rows)
    kept = {r.doc_id for r in near_copies.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {2 * i for i in range(300)} <= kept
    assert sum(i % 2 for i in kept) <= 3  # of 30 copies
