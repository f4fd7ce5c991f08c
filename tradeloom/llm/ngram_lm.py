"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays, mapped into memory.

Words get ids by their place in the sorted array of their 64-bit hashes. A counting task turns its texts into sorted
distinct tuples of ids with counts and deals them to buckets by context, as delta and byte-plane packed columns; the
number of buckets follows the bytes of text. A bucket's task adds them up and writes one file of sorted arrays of
64-bit hashes to the shared folder: tuples with counts, and contexts with their total and how many tuples occur once,
twice and more. The distinct tuples' suffixes, dealt on in the same way, give the continuation counts of the next
lower order. Scoring maps the arrays (numpy memmap), looks up each chunk's distinct tuples, and interpolates from the
lowest order up. A context's distinct tuples are in one bucket: at most as many as there are words.

A document is its words and one end token; a start mark is context only. Null and blank texts are the end token
alone; very long ones are counted and scored whole. Documents without an id are learned from; repeated rows count and
are scored each; without training texts every word is unknown. An empty table gives no rows; other columns are not
read. The shared folder must be a mounted one (file:), as maps need. What is gathered from the corpus grows with it;
no count is cut off.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, local_path, mix64, new_path, text_chunks
from .shingles import word_hashes, words

START, UNKNOWN = 0xFFFFFFFE, 0xFFFFFFFF
END_HASH = np.uint64(0x1D1E57A0C0FFEE11)
STEP = np.uint64(0x9E3779B97F4A7C15)
BLOB = "bucket int, data binary"
#: Tuples that a counting task gathers before it sorts and sends them.
GATHER = 6 << 20
#: Bytes of text that a bucket stands for, about: what a task holds does not grow with the corpus.
BUCKET_BYTES, LEAST_BUCKETS = 12 << 20, 16


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, number of tokens per text); each text ends with the end token."""
    text, starts, ends, first = words(data, offsets)
    n = np.diff(first)
    out = np.empty(len(starts) + len(n), np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[np.cumsum(n + 1) - 1] = True
    out[is_end] = END_HASH
    out[~is_end] = word_hashes(text, starts, ends)
    return out, n + 1


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def fold_in(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a tuple from that of its context and its last word."""
    return mix64(h * STEP + word.astype(np.uint64) + np.uint64(1))


def tuple_hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = fold_in(h, c)
    return h


def planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unplanes(raw: bytes, kind: np.dtype) -> np.ndarray:
    kind = np.dtype(kind)
    return np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T.copy().view(kind).ravel()


def pack(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Rows sorted by their first column, which is sent as differences."""
    head = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    parts = [planes(np.ascontiguousarray(c)) for c in (head, *columns[1:], counts.astype(np.uint32))]
    return np.uint32(len(counts)).tobytes() + b"".join(parts)


def unpack(raw: bytes, kinds: list[np.dtype]) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(raw, np.uint32, 1)[0]), 4, []
    for kind in (*kinds, np.uint32):
        size = n * np.dtype(kind).itemsize
        out.append(unplanes(raw[at : at + size], kind))
        at += size
    out[0] = np.cumsum(out[0], dtype=kinds[0])
    return out


def sort_order(columns: list[np.ndarray]) -> np.ndarray:
    """Lexicographic order of rows; of ids by one sort of packed numbers where they fit into 64 bits."""
    if len(columns) == 1:
        return np.argsort(columns[0])
    if columns[0].itemsize == 4:
        most = max(int(np.where(c < START, c, 0).max()) for c in columns) + 2
        bits = most.bit_length()
        if bits * len(columns) <= 64:
            key = np.zeros(len(columns[0]), np.uint64)
            for c in columns:  # START and UNKNOWN stay the largest
                key = key << np.uint64(bits) | np.where(c < START, c, most - 1 + (c - np.uint32(START)).astype(np.int64)).astype(np.uint64)
            return np.argsort(key)
    return np.lexsort(columns[::-1])


def summed(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order, counts added up."""
    if not len(counts):
        return columns, counts.astype(np.int64)
    order = sort_order(columns)
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    heads = np.flatnonzero(new)
    return [c[heads] for c in columns], np.add.reduceat(counts[order].astype(np.int64), heads)


def dealt(columns: list[np.ndarray], counts: np.ndarray, bucket: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> one packed row for each bucket."""
    order = np.argsort(bucket, kind="stable")
    stops = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(stops)).tolist():
        mine = order[stops[b] : stops[b + 1]]
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([pack([c[mine] for c in columns], counts[mine])], pa.binary())], ["bucket", "data"])


def save(path: str, **arrays: np.ndarray) -> None:
    """The arrays in one file, whole and under its final name only, whichever attempt of a task is first.

    Not a table: workers map it, which needs raw arrays in a file of a known name.
    """
    head, at = {}, 0
    for name, x in arrays.items():
        head[name] = (x.dtype.str, at, len(x))
        at += -(-x.nbytes // 64) * 64
    raw = json.dumps(head).encode()
    raw += b" " * (-(len(raw) + 8) % 64)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(len(raw).to_bytes(8, "little") + raw)
        for x in arrays.values():
            f.write(x.tobytes() + b"\0" * (-x.nbytes % 64))
    os.replace(part, f"{path}.arrays")


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file of save(), mapped; none where it does not exist."""
    if not os.path.exists(path):
        return {}
    data = np.memmap(path, np.uint8, "r")
    size = int.from_bytes(data[:8].tobytes(), "little")
    head = json.loads(data[8 : 8 + size].tobytes())
    return {name: data[8 + size + at :][: n * np.dtype(kind).itemsize].view(kind) for name, (kind, at, n) in head.items()}


class Arrays:
    """The model's files, mapped on first use: one a bucket and order."""

    def __init__(self, folder: str, buckets: int):
        self.folder, self.buckets, self.open = folder, buckets, {}

    def get(self, name: str) -> dict[str, np.ndarray]:
        if name not in self.open:
            self.open[name] = mapped(f"{self.folder}/{name}.arrays")
        return self.open[name]

    def look_up(self, prefix: str, keys: np.ndarray, bucket: np.ndarray, fields: list[str], key: str = "key") -> list[np.ndarray]:
        """Fields of each key, 0 where it is missing; `found` first. Keys are sorted within buckets for the search."""
        order = np.lexsort((keys, bucket))
        stops = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        out = [np.zeros(len(keys), np.int64) for _ in range(len(fields) + 1)]
        for b in np.flatnonzero(np.diff(stops)).tolist():
            own = self.get(f"{prefix}-{b}")
            held = own.get(key)
            if held is None or not len(held):
                continue
            mine = order[stops[b] : stops[b + 1]]
            at = np.searchsorted(held, keys[mine])
            at[at == len(held)] = 0
            hit = held[at] == keys[mine]
            out[0][mine] = np.where(hit, at + 1, 0)
            for x, f in zip(out[1:], fields):
                x[mine] = np.where(hit, own[f][at], 0)
        return out

    def counts(self, prefix: str, keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Counts are bytes; 255 stands for a count in the short list of large ones."""
        _, small = self.look_up(prefix, keys, bucket, ["count"])
        big = np.flatnonzero(small == 255)
        if len(big):
            small[big] = self.look_up(prefix, keys[big], bucket[big], ["large_count"], "large_key")[1]
        return small


@lru_cache(2)
def arrays(folder: str, buckets: int) -> Arrays:
    return Arrays(folder, buckets)


def word_ids(h: np.ndarray, model: Arrays, base: list[int]) -> np.ndarray:
    """Ids of words by hash; UNKNOWN where the vocabulary lacks them."""
    known, back = np.unique(h, return_inverse=True)
    bucket = bucket_of(known, model.buckets)
    at = model.look_up("word", known, bucket, [])[0]
    return np.where(at > 0, at - 1 + np.array(base)[bucket], UNKNOWN).astype(np.uint32)[back]


def contexts(ids: np.ndarray, n: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of the `order`-tuples that end at each token, start marks before a text, and the history's true length
    (marks count once)."""
    place = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
    columns = []
    for back in range(order - 1, -1, -1):
        c = np.full(len(ids), START, np.uint32)
        c[place >= back] = ids[np.flatnonzero(place >= back) - back]
        columns.append(c)
    return columns, np.minimum(place + 1, order - 1)


def reduce_blobs(df: DataFrame, kinds: list, solve, schema: str, buckets: int) -> DataFrame:
    """Each bucket's packed rows, added up, to solve(bucket, columns, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(b: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            parts = [unpack(x, kinds) for x in blobs]
            cols = [np.concatenate(x) for x in zip(*parts)]
            del parts
            yield from solve(b, *summed(cols[:-1], cols[-1]))

        at, blobs = -1, []
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if b != at and blobs:
                    yield from done(at, blobs)
                    blobs = []
                at = b
                blobs.append(raw.as_py())
        if blobs:
            yield from done(at, blobs)

    return df.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def train(docs: DataFrame, order: int = 2, bucket_bytes: int = BUCKET_BYTES) -> dict:
    """docs (text) -> a small description of the model: folder, sizes and discounts."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("bigint"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // bucket_bytes))
    where = new_path(spark, "kneser-ney")
    if not where.startswith(("file:", "/")):
        raise ValueError("the n-gram model is memory-mapped: spark.checkpoint.dir must be a mounted folder")
    folder = local_path(where)
    os.makedirs(folder, exist_ok=True)
    texts = docs.select(F.col("text").cast("string").alias("text"))

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            cols, counts = summed([np.concatenate([k for k, _ in held])], np.concatenate([c for _, c in held]))
            yield from dealt(cols, counts, bucket_of(cols[0], buckets), buckets)

        for _, data, offsets in text_chunks(batches, "text"):
            held.append(np.unique(tokens(data, offsets)[0], return_counts=True))
            if sum(len(k) for k, _ in held) > GATHER:
                yield from out()
                held = []
        if held:
            yield from out()

    def write_words(b: int, cols: list[np.ndarray], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        save(f"{folder}/word-{b}", key=cols[0], count=counts)
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([len(counts)], pa.int64()), pa.array([int(counts.sum())], pa.int64())], ["bucket", "words", "tokens"])

    found = reduce_blobs(texts.mapInArrow(vocabulary, BLOB), [np.uint64], write_words, "bucket int, words bigint, tokens bigint", buckets).collect()
    sizes = [0] * buckets
    for r in found:
        sizes[r.bucket] = r.words
    base = [0, *np.cumsum(sizes).tolist()]

    def tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, size = arrays(folder, buckets), [], 0

        def out() -> Iterator[pa.RecordBatch]:
            cols, counts = summed([np.concatenate(x) for x in zip(*[h[0] for h in held])], np.concatenate([h[1] for h in held]))
            yield from dealt(cols, counts, bucket_of(tuple_hash(cols[:-1]), buckets), buckets)

        for _, data, offsets in text_chunks(batches, "text"):
            h, n = tokens(data, offsets)
            cols, _ = contexts(word_ids(h, model, base[:-1]), n, order)
            held.append(summed(cols, np.ones(len(h), np.uint32)))
            size += len(held[-1][1])
            if size > GATHER:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    blobs, shape = texts.mapInArrow(tuples, BLOB), {"folder": folder, "buckets": buckets, "order": order, "base": base, "tokens": sum(r.tokens for r in found), "words": base[-1], "discounts": {}, "total": 0}
    schema = BLOB + ", n1 bigint, n2 bigint, n3 bigint, n4 bigint, total bigint, more bigint"
    for k in range(order, 0, -1):
        solve = order_writer(folder, k, buckets, base)
        out = scratch.write(f"order-{k}", reduce_blobs(blobs, [np.uint32] * k, solve, schema, buckets))
        s = out.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "n3", "n4", "total", "more")]).first()
        shape["discounts"][str(k)] = discounts(s.n1, s.n2, s.n3, s.n4)
        if k == 1:
            d = shape["discounts"]["1"]
            shape["total"], shape["left"] = s.total, d[0] * s.n1 + d[1] * s.n2 + d[2] * s.more
        scratch.keep(f"order-{k}")
        blobs = out.where("data IS NOT NULL").select("bucket", "data")
    scratch.keep()
    with open(f"{folder}/model.json", "w") as f:
        json.dump(shape, f)
    return shape


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    rough = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), 0.95 * (i + 1)) for i, d in enumerate(rough)]


def order_writer(folder: str, k: int, buckets: int, base: list[int]):
    """Writes a bucket of order k and sends on the suffixes of its tuples, each distinct tuple as one continuation."""

    def row(b: int | None, data: bytes | None, stats: list[int]) -> pa.RecordBatch:
        names = ["bucket", "data", "n1", "n2", "n3", "n4", "total", "more"]
        return pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([data], pa.binary()), *[pa.array([v], pa.int64()) for v in stats]], names)

    def solve(b: int, cols: list[np.ndarray], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if k == 1:
            ids = cols[0].astype(np.int64)
            known = ids < START
            dense = np.zeros(base[b + 1] - base[b], np.uint32)
            dense[ids[known] - base[b]] = counts[known]
            save(f"{folder}/next-{b}", next=dense)
            counts = counts[known]
        else:
            context = tuple_hash(cols[:-1])
            full = fold_in(context, cols[-1])
            order = np.argsort(full)
            big = order[counts[order] >= 255]
            tuples = {"key": full[order], "count": np.minimum(counts[order], 255).astype(np.uint8), "large_key": full[big], "large_count": counts[big]}
            order = np.argsort(context, kind="stable")
            heads = np.flatnonzero(np.diff(context[order], prepend=context[order][0] ^ np.uint64(1)))
            c = counts[order]
            ones, twos, more = (np.add.reduceat((x).astype(np.int64), heads) for x in (c == 1, c == 2, c > 2))
            save(f"{folder}/order{k}-{b}", **tuples, context=context[order][heads], total=np.add.reduceat(c, heads), one=ones.astype(np.uint32), two=twos.astype(np.uint32), more=more.astype(np.uint32))
            suffix, left = summed(cols[1:], np.ones(len(counts), np.uint32))
            to = np.searchsorted(base, suffix[0].astype(np.int64), "right") - 1 if k == 2 else bucket_of(tuple_hash(suffix[:-1]), buckets)
            keep = suffix[0] != START if k == 2 else suffix[-1] != START
            for batch in dealt([s[keep] for s in suffix], left[keep], to[keep], buckets):
                yield row(batch.column(0)[0].as_py(), batch.column(1)[0].as_py(), [0] * 6)
        tally = [int((counts == i).sum()) for i in (1, 2, 3, 4)]
        yield row(None, None, [*tally, int(counts.sum()), int((counts > 2).sum())])

    return solve


def discount(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def chunk_scores(data: np.ndarray, offsets: np.ndarray, shape: dict) -> tuple[np.ndarray, ...]:
    """(n_tokens, n_known, base_score, score) of each text of a chunk."""
    model, order, n_words = arrays(shape["folder"], shape["buckets"]), shape["order"], shape["words"]
    h, n = tokens(data, offsets)
    known, back = np.unique(h, return_inverse=True)
    bucket = bucket_of(known, model.buckets)
    at, count = model.look_up("word", known, bucket, ["count"])
    ids = np.where(at > 0, at - 1 + np.array(shape["base"][:-1])[bucket], UNKNOWN).astype(np.uint32)
    following = np.zeros(len(known), np.int64)
    for b in np.unique(bucket[at > 0]).tolist():
        mine = np.flatnonzero((bucket == b) & (at > 0))
        following[mine] = model.get(f"next-{b}")["next"][at[mine] - 1]
    plain = np.log10((count + 0.5) / (shape["tokens"] + 0.5 * (n_words + 1)))
    total = max(shape["total"], 1)
    spare = shape["left"] / total if shape["total"] else 1.0
    p1 = np.maximum(following - discount(following, shape["discounts"]["1"]), 0) / total + spare / (n_words + 1)
    p = p1[back]
    columns, history = contexts(ids[back], n, order)
    for k in range(2, order + 1):
        cols = columns[order - k :]
        use = np.flatnonzero(history >= k - 1)
        cols = [c[use] for c in cols]
        context = tuple_hash(cols[:-1])
        c_keys, c_back = np.unique(context, return_inverse=True)
        found, total_k, one, two, more = model.look_up(f"order{k}", c_keys, bucket_of(c_keys, model.buckets), ["total", "one", "two", "more"], "context")
        d = shape["discounts"][str(k)]
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(found > 0, (d[0] * one + d[1] * two + d[2] * more) / total_k, 1.0)
        full = fold_in(context, cols[-1])
        f_keys, first, f_back = np.unique(full, return_index=True, return_inverse=True)
        counts = model.counts(f"order{k}", f_keys, bucket_of(context[first], model.buckets))[f_back]
        with np.errstate(divide="ignore", invalid="ignore"):
            own = np.where(found[c_back] > 0, np.maximum(counts - discount(counts, d), 0) / total_k[c_back], 0.0)
        p[use] = own + left[c_back] * p[use]
    heads = np.cumsum(n) - n
    return n, np.add.reduceat((count[back] > 0).astype(np.int64), heads), np.add.reduceat(plain[back], heads), np.add.reduceat(np.log10(p), heads)


def scored(docs: DataFrame, shape: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row; perplexity is 10 ** (-score / n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_chunks(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x) for x in chunk_scores(data, offsets, shape)]], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")


def op6(docs: DataFrame, fold: Column, order: int = 2) -> DataFrame:
    held = F.coalesce(fold == 1, F.lit(False))
    shape = train(docs.where(~held), order)
    out = scored(docs, shape).withColumn("held_out", held).withColumn("train_tokens", F.lit(shape["tokens"]).cast("bigint"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
