import random
from itertools import combinations

import corpus_pipeline
from tradeloom.llm import near_copies
from tradeloom.llm.common import written


def test_stages_take_effect(spark, docs, nothing):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near copies", "repeated strings", "mixing", "tokens"]
    for start in (docs, nothing):
        d, counts = start, []
        for name, stage in corpus_pipeline.STAGES:
            before = d.columns
            d = written(stage(spark, d, ""), "stage")
            counts.append(d.count())
            assert name == "tokens" or d.columns == before
        assert "ids" in d.columns
        if start is docs:
            assert counts[0] < docs.count() and 0 < counts[1] <= counts[0] and counts[2] == counts[1] and counts[4] == counts[3]


def test_near_copies_keep_one_of_each(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(1, base), (2, base), (3, base + " end"), (4, " ".join(f"other{i}" for i in range(300))), (5, None), (6, "")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_copies_stage(spark, d, "").collect()}
    assert {1, 4} <= kept and not {2, 3} & kept


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    texts = []
    for i in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 400))]
        texts.append(base)
        for _ in range(rng.choice((0, 0, 1, 2, 30 if i == 7 else 1))):  # scattered edits, some too many to count as a copy
            rate = rng.choice((0.01, 0.015, 0.05))
            texts.append([w if rng.random() > rate else rng.choice(vocabulary) for w in base])
        if i % 6 == 0:
            texts.append(base + [rng.choice(vocabulary) for _ in range(len(base) // 8)])
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, " ".join(texts[k])) for i, k in enumerate(order)]
    kept = {r.doc_id for r in corpus_pipeline.near_copies_stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    top = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            x, y = top[a], top[b]
            top = [min(x, y) if t in (x, y) else t for t in top]
    want = {i for i in range(len(rows)) if top[i] == i}
    gone, found = len(rows) - len(want), len(rows) - len(kept)
    assert want <= kept and gone > 30 and found >= 0.9 * gone


def test_odd_rows_of_near_copies(spark, docs, nothing):
    again = docs.union(docs.limit(5))
    kept = near_copies.deduplicated(again)
    assert kept.columns == docs.columns and kept.count() == near_copies.deduplicated(docs).count()
    assert sum(not (r.text or "").strip() for r in kept.collect()) == 1
    assert near_copies.deduplicated(nothing).count() == 0
