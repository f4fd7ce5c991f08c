from pyspark.sql import functions as F

from tradeloom.llm import toxicity
from tradeloom.llm.common import table

SF = "/root/testdata/sf0.1"


def test_heads_of_words_are_marked():
    """Byte by byte: letters and bytes beyond ASCII among the first HEAD bytes after a blank or the start."""
    for text in ("", " ", "a", "Ab cdefgh\nijklmnop  q 12abc", "réeux überäöü x", "!" * 9, None):
        raw, want, since = (text or "").lower().encode().replace(b"\n", b" "), bytearray(), 0
        for b in raw:
            since = 0 if b == 32 else since + 1
            want.append(b ^ 0x20 if 1 <= since <= toxicity.HEAD and (97 <= b < 123 or b >= 128) else b)
        assert toxicity.prepared(text) == bytes(want)


def test_score_of_a_small_model_by_hand():
    """The saved bytes of each window and the curve over them, with compressors made anew."""
    text = "some idle words " * 20 + "you blockhead and scoundrel " + "more idle words " * 20
    model = toxicity.Model(b" SCOUndrel BLOCkhead", b" SOME IDLE WORDs", 2.0, (-3.0, 0.5, 0.2, 0.1, -0.2, 1.0))
    plain, both = model.compressors()
    saved = [len(plain(w)) - len(both(w)) for w in toxicity.windows(toxicity.prepared(text))]
    assert b"".join(toxicity.windows(toxicity.prepared(text))) == toxicity.prepared(text) and max(saved) >= 2
    over = [s for s in saved if s >= 2]
    import math

    z = -3 + 0.5 * min(sum(over), toxicity.MOST_SUM) + 0.2 * min(max(saved), toxicity.MOST_ONE) + 0.1 * math.log1p(len(over)) - 0.2 * math.log1p(len(saved)) + sum(saved) / (len(saved) + 4)
    assert abs(toxicity.score(toxicity.distances(text, model), model) - 1 / (1 + math.exp(-z))) < 1e-12


def test_held_out_labels(spark):
    """Precision and recall on labelled rows that nothing was learned from, and the area under the curve."""
    labels = table(spark, SF, "labels")
    known = labels.where("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = toxicity.op1(table(spark, SF, "documents"), labels).where("held_out").join(known, "doc_id").select("score", "predicted", "toxic").collect()
    bad, good = ([r for r in rows if r.toxic == k] for k in (1, 0))
    hit, wrong = sum(r.predicted for r in bad), sum(r.predicted for r in good)
    area = sum((x.score > y.score) + 0.5 * (x.score == y.score) for x in bad for y in good) / (len(bad) * len(good))
    print(len(bad), hit, wrong, area)
    assert hit >= 0.6 * len(bad) and hit >= 0.9 * (hit + wrong) and area >= 0.9
