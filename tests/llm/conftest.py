import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key bigint, fp bigint, size bigint"


def documents(seed=3, n=60):
    """Small texts with copies, near copies, shared passages, nulls, blanks, repeated rows and odd characters.

    The last three columns are extra ones with names that operators use themselves."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abdeilnorst") for _ in range(rng.randint(1, 8)))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for i in range(n):
        t = " ".join(word() for _ in range(rng.randint(1, 160)))
        if i % 7 == 0:
            t = t[:80] + " " + passage + " " + t[80:]
        if i % 9 == 0 and texts:
            t = rng.choice(texts) or t
        if i % 10 == 0 and texts and texts[-1]:
            t = texts[-1].replace(" a", " the", 1)
        texts.append(t)
    texts += [None, "", " \t\n ", "one", "ONE", "é ß 漢字 \U0001f600 \x1c x\x85y", "la la la la la la " * 60, "trash idiot " * 30, "x" * 700, passage * 3, "a  b\n\nc   ", "<|endoftext|> a <|startoftext|>", "5% off! $$ ### " * 20]
    rows = [(i, t, "en", [None, "", "s1", "s2", "s1"][i % 5], len(t or ""), 1, 2, 3) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id here", None, None, None, None, None, None), (5, "same id, other text", "en", "s2", 1, 1, 1, 1)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
