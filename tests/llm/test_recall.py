import random

from tradeloom.llm import near_copies


def test_near_copies_by_contiguous_edits_are_found(spark):
    """Appended and replaced blocks at a similarity of 0.8 or more: one fingerprint finds about 0.7 of such pairs."""
    rng = random.Random(11)
    words = lambda n: ["w" + str(int(20_000 ** rng.random())) + rng.choice("abcdefgh") for _ in range(n)]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, pairs = [], 0
    while pairs < 150:
        a = words(rng.randint(100, 900))
        if pairs % 2:
            b = a + words(len(a) * 23 // 100)
        else:
            m = len(a) // 10
            i = rng.randint(0, len(a) - m)
            b = a[:i] + words(m) + a[i + m :]
        x, y = shingles(a), shingles(b)
        if len(x & y) >= 0.8 * len(x | y):
            rows += [(2 * pairs, " ".join(a)), (2 * pairs + 1, " ".join(b))]
            pairs += 1
    kept = {r.doc_id for r in near_copies.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {2 * i for i in range(pairs)} <= kept
    assert len(kept) - pairs <= 0.06 * pairs


def test_copies_in_a_large_family_are_found(spark):
    """9,000 texts share a template of 170 words of 240; 300 copies with 18 of their own words changed are all found."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    template, shingles = [word() for _ in range(170)], lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    texts = [template[:85] + [word() for _ in range(70)] + template[85:] for _ in range(9000)]
    pairs = []
    for i in rng.sample(range(9000), 300):
        copy = list(texts[i])
        at = 85 + rng.randint(0, 52)
        copy[at : at + 18] = [word() for _ in range(18)]
        x, y = shingles(texts[i]), shingles(copy)
        assert len(x & y) >= 0.8 * len(x | y)
        pairs.append((i, 9000 + len(pairs)))
        texts.append(copy)
    kept = {r.doc_id for r in near_copies.deduplicated(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(8)).collect()}
    assert set(range(9000)) <= kept
    assert sum(copy in kept for _, copy in pairs) <= 0.02 * len(pairs)
