"""No near copy is lost: groups equal brute force, also where candidates by chance fail."""

import random
from collections import Counter

import pytest

from tradeloom.llm import near_copies, near_exact


def sets_of(texts):
    return [near_copies.shingle_set(t, 5) for t in texts]


def brute_force(texts):
    """Ids that stay: the least of each component of exact links."""
    sets, top = sets_of(texts), list(range(len(texts)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for b in range(len(texts)):
        shared = Counter(a for x in sets[b] for a in holders[x] if a < b) if sets[b] else {a: 0 for a in range(b) if not sets[a]}
        for a in shared:
            if near_copies.similarity(sets[a], sets[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {i for i in range(len(texts)) if top[i] == i}


def family(rng):
    """Texts of templates, with chains of copies around a similarity of 0.8, short and long texts and odd ones."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = ["", " ", "One", "one ", "a b", "A  b", "a b c d e", "a b c d e f", "x " * 40, "x " * 60]
    for n in (12, 60, 240, 900):
        template = [word() for _ in range(n * 2 // 3)]
        for _ in range(12):
            base = template[: n // 3] + [word() for _ in range(n - 2 * (n // 3))] + template[n // 3 :]
            texts.append(" ".join(base))
            for _ in range(rng.randint(1, 3)):  # one block replaced: from few to too many words
                m = max(1, int(n * rng.choice((0.03, 0.07, 0.085, 0.1, 0.12))))
                at = rng.randint(0, n - m)
                base = base[:at] + [word() for _ in range(m)] + base[at + m :]
                texts.append(" ".join(base))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("often", [3, 10**9])
@pytest.mark.parametrize("chance", [True, False])
def test_groups_equal_brute_force(spark, monkeypatch, chance, often):
    texts = family(random.Random(3))
    want = brute_force(texts)
    assert len(want) < len(texts) - 30
    monkeypatch.setattr(near_exact, "OFTEN", often)
    if not chance:  # candidates by chance find nothing at all
        monkeypatch.setattr(near_copies, "neighbours", lambda met: met.selectExpr("meet AS u", "turn AS v", "1L AS n").where("false"))
        monkeypatch.setattr(near_copies, "rare_neighbours", lambda keys: keys.selectExpr("key AS u", "key AS v", "1L AS n").where("false"))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert {r.doc_id for r in near_copies.deduplicated(rows).collect()} == want


def test_copies_in_a_family_are_all_found(spark):
    """All 500 copies of texts that share a template of 170 words of 240 are linked, and no stranger is."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    template, texts, pairs = [word() for _ in range(170)], [], []
    for _ in range(2500):
        texts.append(template[:85] + [word() for _ in range(70)] + template[85:])
    for i in range(0, 2500, 5):
        at = 85 + rng.randint(0, 52)
        copy = texts[i][:at] + [word() for _ in range(18)] + texts[i][at + 18 :]
        pairs.append((i, len(texts)))
        texts.append(copy)
    texts = [" ".join(t) for t in texts]
    sets = sets_of(texts)
    assert all(near_copies.similarity(sets[a], sets[b]) >= 0.8 for a, b in pairs)
    kept = {r.doc_id for r in near_copies.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)).collect()}
    assert kept == set(range(2500))


def test_checks_grow_with_texts(spark, monkeypatch):
    """Texts of one template, few of them links, meet in very many pairs: a bounded number a text is checked, no link is lost."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, texts = [word() for _ in range(100)], []
    for _ in range(500):
        m = rng.choice((3, 8, 9, 10))
        at = rng.randint(0, 100 - m)
        texts.append(" ".join(base[:at] + [word() for _ in range(m)] + base[at + m :]))
    checked, similar = [], near_copies.similar

    def counted(pairs, *args):
        checked.append(pairs.count())
        return similar(pairs, *args)

    monkeypatch.setattr(near_copies, "similar", counted)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert {r.doc_id for r in near_copies.deduplicated(rows).collect()} == brute_force(texts)
    assert sum(checked[:-1]) <= sum(near_copies.ROUNDS) * len(texts) and checked[-1] <= 2 * len(texts)


def test_parities_never_rule_a_link_out():
    rng = random.Random(5)
    for _ in range(300):
        small, large = 64 << rng.randint(0, 2), 64 << rng.randint(0, 2)
        a, b = ({rng.getrandbits(40) for _ in range(rng.randint(0, 300))} for _ in range(2))
        b |= set(list(a)[: rng.randint(0, len(a))])
        pack = lambda s, size: sum(1 << i for i, n in Counter(x % (8 * size) for x in s).items() if n % 2).to_bytes(size, "little")
        assert near_exact.differ(pack(a, small), pack(b, large)) <= len(a ^ b)


def test_candidates_go_on_by_texts_not_by_pairs(spark, monkeypatch):
    """Of the pairs that texts of one template meet in, a bounded number a text is written for the rounds, once; none is lost."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, texts = [word() for _ in range(100)], []
    for _ in range(300):
        m = rng.choice((2, 3, 9))
        at = rng.randint(0, 100 - m)
        texts.append(" ".join(base[:at] + [word() for _ in range(m)] + base[at + m :]))
    rows, write = [], near_copies.Scratch.write

    def counted(self, name, df):
        out = write(self, name, df)
        rows.extend([out.count()] if name == "near-pairs" else [])
        return out

    monkeypatch.setattr(near_copies.Scratch, "write", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert {r.doc_id for r in near_copies.deduplicated(docs).collect()} == brute_force(texts)
    assert len(rows) == 1 and 0 < rows[0] <= sum(near_copies.ROUNDS) * len(texts), rows
