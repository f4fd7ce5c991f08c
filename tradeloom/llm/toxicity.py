"""Toxicity by compression distance between two zstandard dictionaries.

Both are trained on a bounded sample of labelled texts: one on ordinary texts, one on the word stems of toxic texts
that ordinary ones hardly have. The first HEAD bytes of each word are marked (letters as capitals), so that a stem at
the start of a word is not met inside another. A text is cut at blanks into windows; each window is compressed with
the ordinary dictionary and with both (the toxic one farther off, so that what is common costs the same), and the
bytes saved are its distance. Windows count from a threshold that few ordinary windows reach; a logistic curve turns a
text's sums into a score. Threshold and curve are fitted to both halves of the sample, each compressed with what the
other half trained; of the lengths of stems in STEMS those are taken whose curve loses least there, and their
dictionaries are trained on the whole sample.

The toxic dictionary holds stretches around word stems, as one trained on whole toxic texts tells them from ordinary
ones too rarely (README has the figures). A text's sums are clipped before the curve, at MOST_SUM and MOST_ONE bytes:
beyond them a text is toxic however much more it holds.

The fit reads at most MOST_TOXIC + MOST_ORDINARY labelled texts, the least by a hash of the id, less those of over
MOST_BYTES; scoring reads every whole text, however long. Null and blank texts have no windows and get the curve's
lowest score. Without sample texts of both kinds every score is 0. Repeated labels of an id count once, toxic if any
says so; repeated document rows are scored each. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

MOST_TOXIC, MOST_ORDINARY, MOST_BYTES = 1600, 2800, 1 << 15
#: Bytes of a window, of a word's head, and of the two dictionaries.
WINDOW, HEAD, TOXIC_BYTES, ORDINARY_BYTES = 208, 4, 1400, 1200
#: Bytes of the stems compared, the blank before a word included: the choices.
STEMS = ((5,), (5, 8))
#: A stem is toxic from this share of toxic texts on, if that is so many times its share of ordinary ones.
SHARE, RATIO = 0.015, 30
#: Share of ordinary windows that may reach the window threshold.
FALSE_WINDOWS = 0.002
#: Saved bytes that count, of all windows over the threshold and of the best one.
MOST_SUM, MOST_ONE = 40, 12


#: Bytes of a word's head: small letters as capitals, bytes beyond ASCII as others beyond ASCII.
MARKED = np.arange(256, dtype=np.uint8)
MARKED[97:123] ^= 0x20
MARKED[128:] ^= 0x20


def prepared(text: str | None) -> bytes:
    """Lower case, lines joined by blanks, the first HEAD bytes after each blank marked."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass").replace(b"\n", b" ")
    data = np.frombuffer(raw, np.uint8)
    blank = np.append(True, data == 32)  # a blank before the first byte
    near = blank[:-1].copy()
    for k in range(1, HEAD):
        near[k:] |= blank[: max(0, len(data) - k)]
    return np.where(near & ~blank[1:], MARKED[data], data).tobytes()


def stems(text: bytes, lengths: tuple[int, ...]) -> set[bytes]:
    return {x[i : i + n] for w in set(text.split()) for x in (b" " + w,) for n in lengths for i in range(len(x) - n + 1)}


def toxic_text(text: bytes, toxic: set[bytes], lengths: tuple[int, ...]) -> bytes:
    """The stretches of the words that hold toxic stems."""
    out = []
    for w in text.split():
        x = b" " + w
        hit = [(i, i + n) for n in lengths for i in range(len(x) - n + 1) if x[i : i + n] in toxic]
        if hit:
            out.append(x[min(i for i, _ in hit) : max(j for _, j in hit)])
    return b"".join(out)


def trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """Content of a trained dictionary; the samples themselves where they are too few to train on."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstd.train_dictionary(size + 256, samples, k=k, d=d).as_bytes()[-size:]
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


class Model:
    def __init__(self, toxic: bytes, ordinary: bytes, threshold: float = 2, weights: tuple[float, ...] = ()):
        self.toxic, self.ordinary, self.threshold, self.weights = toxic, ordinary, threshold, weights

    def compressors(self) -> tuple:
        params = zstd.ZstdCompressionParameters(
            window_log=12, hash_log=11, chain_log=11, search_log=3, min_match=5, target_length=16, strategy=zstd.STRATEGY_BTOPT, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        out = []
        for content in (self.ordinary, self.toxic + self.ordinary):
            d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            out.append(zstd.ZstdCompressor(dict_data=d, compression_params=params).compress)
        return tuple(out)


@lru_cache(4)
def compressors(toxic: bytes, ordinary: bytes) -> tuple:
    return Model(toxic, ordinary).compressors()


def windows(text: bytes) -> list[bytes]:
    out, i, n = [], 0, len(text)
    while i < n:
        j = i + WINDOW
        if j < n:
            cut = text.find(b" ", j, j + 48)
            j = cut if cut >= 0 else j
        out.append(text[i:j])
        i = j
    return out


def saved(raw: bytes, model: Model) -> list[int]:
    plain, both = compressors(model.toxic, model.ordinary)
    return [len(plain(w)) - len(both(w)) for w in windows(raw)]


def distances(text: str | None, model: Model) -> list[int]:
    return saved(prepared(text), model)


def features(found: list[int], threshold: float) -> list[float]:
    over = [d for d in found if d >= threshold]
    return [1.0, float(min(sum(over), MOST_SUM)), float(min(max(found, default=0), MOST_ONE)), np.log1p(len(over)), np.log1p(len(found)), sum(found) / (len(found) + 4)]


def score(found: list[int], model: Model) -> float:
    if not model.weights:
        return 0.0
    x = float(np.dot(features(found, model.threshold), model.weights))
    return float(1 / (1 + np.exp(-np.clip(x, -50, 50))))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Newton steps of a ridge logistic regression; the ridge spares the constant."""
    w, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    keep[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        w = w + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (y - p) - keep @ w)
    return w


def dictionaries(ordinary: list[bytes], toxic: list[bytes], lengths: tuple[int, ...]) -> Model:
    seen = [Counter(), Counter()]
    for counter, texts in zip(seen, (ordinary, toxic)):
        for t in texts:
            counter.update(stems(t, lengths))
    marked = {s for s, c in seen[1].items() if c >= max(2, SHARE * len(toxic)) and c / len(toxic) >= RATIO * (seen[0][s] + 0.25) / len(ordinary)}
    return Model(trained([toxic_text(t, marked, lengths) for t in toxic], TOXIC_BYTES, 24, 6), trained(ordinary, ORDINARY_BYTES, 48, 8))


def calibrated(ordinary: list[bytes], toxic: list[bytes], lengths: tuple[int, ...]) -> tuple[float, float, np.ndarray]:
    """(loss, threshold, weights) of the curve of each half's texts by the dictionaries of the other half."""
    found: list[list[list[int]]] = [[], []]
    for half in (0, 1):
        model = dictionaries(ordinary[1 - half :: 2], toxic[1 - half :: 2], lengths)
        for of_kind, texts in zip(found, (ordinary, toxic)):
            of_kind += [saved(t, model) for t in texts[half::2]]
    threshold = float(max(2, np.quantile(np.array([d for x in found[0] for d in x] or [0]), 1 - FALSE_WINDOWS)))
    x = np.array([features(d, threshold) for of_kind in found for d in of_kind])
    y = np.repeat([0.0, 1.0], [len(of_kind) for of_kind in found])
    w = logistic(x, y)
    z = np.clip(x @ w, -50, 50)
    return float(np.mean(np.log1p(np.exp(z)) - y * z)), threshold, w


def fit(sample: list[tuple[str, int]], share: float | None = None) -> Model:
    """sample: (text, toxic 0/1). share: toxic ones among all."""
    ordinary, toxic = ([prepared(t) for t, y in sample if y == k] for k in (0, 1))
    if not (len(ordinary) > 1 and len(toxic) > 1):
        return Model(b"", b"")
    (_, threshold, w), lengths = min(((calibrated(ordinary, toxic, x), x) for x in STEMS), key=lambda c: c[0][0])
    model = dictionaries(ordinary, toxic, lengths)
    mean = len(toxic) / (len(toxic) + len(ordinary))
    p = float(np.clip(share if share is not None else mean, 1e-3, 1 - 1e-3))
    w[0] += np.log(p / (1 - p)) - np.log(mean / (1 - mean))  # the sample holds more toxic texts than the labels do
    model.threshold, model.weights = threshold, tuple(w.tolist())
    return model


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[str, int]], float | None]:
    """A bounded sample and the share of toxic ones among all labelled ids; fold 0 is left for testing."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id") != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((0, MOST_ORDINARY), (1, MOST_TOXIC))]
    ids = first[0].union(first[1])
    texts = docs.where(F.octet_length("text") <= MOST_BYTES).select("doc_id", F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    return [(r.text, r.toxic) for r in sorted(rows, key=lambda r: r.doc_id)], known.agg(F.avg("toxic")).first()[0]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row: a narrow map over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [score(distances(t.as_py(), model), model) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double")


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs, fit(*training_sample(docs, labels)))
    return out.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
