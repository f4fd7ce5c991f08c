"""The links between groups of near copies that candidates by chance left out, all of them.

Shingles have one order: by how many texts of a bounded sample hold them, then by hash. Two texts whose shingle sets
have a similarity of `least` share one of the first n - ceil(least * n) + 1 of each (prefix filter), whatever the
order; the sample only keeps frequent shingles out of the prefixes. Texts that share one are a candidate pair if they
are in different groups so far, and if sizes and places leave room for enough common shingles. A bitmap that holds the
parity of the shingles at each place bounds the difference of two sets from below; what it leaves is for an exact
check. No step drops a pair that could be a link. A frequent shingle's texts are read by one task, as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, text_chunks
from .shingles import shingle_hashes, word_hashes, words
from .simhash import SEED

#: Texts, about, by which the order of shingles is fitted, and how often a shingle must be in them to count as frequent.
SAMPLE, OFTEN = 16384, 3
#: Pairs looked at at once.
BLOCK = 1 << 20
#: Against rounding of bounds; it only lets more pairs through.
EPS = 1e-6
#: Places by whose hash texts that nobody asks for are left out before a shuffle.
SLOTS = 1 << 20


def distinct_shingles(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(key of each text, shingle hashes, their texts), ordered by text and hash."""
    text, starts, ends, first = words(data, offsets)
    raw = text.tobytes()
    key = [xxhash.xxh64_intdigest(raw[starts[x] : ends[y - 1]] if y > x else b"", SEED) for x, y in zip(first[:-1].tolist(), first[1:].tolist())]
    s, of = shingle_hashes(word_hashes(text, starts, ends), first, width)
    order = np.lexsort((s, of))
    s, of = s[order], of[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
    return key, s[new], of[new]


def frequent(rows: DataFrame, n_texts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(d, t, text) -> (shingle hashes in order, texts of the sample that hold each), of a sample of bounded size."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_chunks(batches, "text", 2 << 20):
            _, s, _ = distinct_shingles(part, data, offsets, width)
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["s"])

    share = min(1.0, SAMPLE / max(1, n_texts))
    some = rows.where(F.pmod(F.xxhash64("d", "t"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    found = some.mapInArrow(each, "s bigint").groupBy("s").agg(F.count(F.lit(1)).cast("int").alias("n")).where(F.col("n") >= OFTEN).toArrow()
    s, n = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def prefixes(rows: DataFrame, order, width: int, least: float) -> DataFrame:
    """(d, t, text) -> (key, n, bits, prefix): number of distinct shingles, their parities, the first of them packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = order.value
        for part, data, offsets in text_chunks(batches, "text", 2 << 20):
            key, s, of = distinct_shingles(part, data, offsets, width)
            size = np.bincount(of, minlength=len(part))
            begin = np.cumsum(size) - size
            bits = []
            for a, n in zip(begin.tolist(), size.tolist()):
                b = max(512, 1 << max(0, n - 1).bit_length())
                bits.append(np.packbits((np.bincount((s[a : a + n] >> np.uint64(20) & np.uint64(b - 1)).astype(np.int64), minlength=b) & 1).astype(bool), bitorder="little").tobytes())
            rank = np.zeros(len(s), np.int64)
            if len(often) and len(s):
                at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                rank = np.where(often[at] == s, times[at], 0)
            s = s[np.argsort(of << 32 | rank, kind="stable")]
            first = np.where(size, size - np.ceil(least * size - EPS).astype(np.int64) + 1, 0)
            prefix = [s[a : a + m].tobytes() for a, m in zip(begin.tolist(), first.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(size.astype(np.int32)), pa.array(bits, pa.binary()), pa.array(prefix, pa.binary())], ["key", "n", "bits", "prefix"])

    return rows.select("text").mapInArrow(run, "key bigint, n int, bits binary, prefix binary").dropDuplicates(["key"])


def spread(texts: DataFrame) -> DataFrame:
    """(key, root, n, prefix) -> (s, root, key, size_place): a row for each shingle of a prefix."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                packed = batch.column(3).to_pylist()
                m = np.array([len(x) // 8 for x in packed], np.int64)
                key, root, n = (np.repeat(batch.column(k).to_numpy(), m) for k in range(3))
                place = np.arange(len(key)) - np.repeat(np.cumsum(m) - m, m)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(packed), np.int64)), pa.array(root), pa.array(key), pa.array(n.astype(np.int64) << 32 | place)], ["s", "root", "key", "size_place"])

    return texts.select("key", "root", "n", "prefix").mapInArrow(each, "s bigint, root bigint, key bigint, size_place bigint")


def ends_of(*columns: np.ndarray) -> np.ndarray:
    """Of each row, where the run of rows that are equal in these columns ends."""
    n = len(columns[0])
    cut = np.zeros(max(0, n - 1), bool)
    for c in columns:
        cut |= c[1:] != c[:-1]
    stops = np.append(np.flatnonzero(cut) + 1, n)
    return np.repeat(stops, np.diff(stops, prepend=0))


def crossing(entries: DataFrame, least: float) -> DataFrame:
    """Rows of spread() -> distinct pairs of keys (u > v) of different roots that may be links."""

    def pairs(s: np.ndarray, root: np.ndarray, key: np.ndarray, size_place: np.ndarray) -> Iterator[pa.RecordBatch]:
        after, stop = ends_of(s, root), ends_of(s)
        n, left = size_place >> 32, (size_place >> 32) - (size_place & 0xFFFFFFFF)
        here = np.flatnonzero(stop > after)
        many = (stop - after)[here]
        total = np.cumsum(many)
        a = 0
        while a < len(here):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + BLOCK, "right")))
            i, m = np.repeat(here[a:b], many[a:b]), many[a:b]
            j = after[i] + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
            need = np.ceil(least / (1 + least) * (n[i] + n[j]) - EPS)
            may = (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - EPS) & (np.minimum(left[i], left[j]) >= need)
            u, v = key[i[may]], key[j[may]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            new = [batch.column(k).to_numpy() for k in range(4)]
            if not len(new[0]):
                continue
            if held and new[0][-1] == held[0][0][0]:  # all of one shingle still
                held.append(new)
                continue
            rows = [np.concatenate(x) for x in zip(*held, new)]
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            yield from pairs(*[x[:last] for x in rows])
            held = [[x[last:] for x in rows]]
        if held:
            yield from pairs(*[np.concatenate(x) for x in zip(*held)])

    return entries.repartition("s").sortWithinPartitions("s", "root").mapInArrow(run, "u bigint, v bigint").distinct()


def differ(x: bytes, y: bytes) -> int:
    """Elements that only one of two sets has, at least, by their parities; the longer ones are folded."""
    a, b = (x, y) if len(x) <= len(y) else (y, x)
    few, more = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    size = 8 * len(b)
    while size > 8 * len(a):
        size //= 2
        more = more & ((1 << size) - 1) ^ more >> size
    return (few ^ more).bit_count()


def possible(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) of keys whose parities do not rule a link out."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy().astype(np.int64) + batch.column(4).to_numpy()
            most = n - 2 * np.ceil(least / (1 + least) * n - EPS)
            near = [differ(x, y) <= m for x, y, m in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), most.tolist())]
            yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    one, other = (texts.select(F.col("key").alias(k), F.col("n").alias(f"{k}_n"), F.col("bits").alias(f"{k}_bits")) for k in "uv")
    both = by_key(by_key(pairs).join(one, "u")).join(other, "v").select("u", "v", "u_n", "u_bits", "v_n", "v_bits")
    return both.mapInArrow(judge, "u bigint, v bigint")


def texts_of(pairs: DataFrame, keys: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, text) of the keys in pairs; rows at places where no such key is are left out before they are sent."""
    ends = pairs.select(F.col("u").alias("key")).union(pairs.select(F.col("v").alias("key"))).distinct()
    wanted = keys.select("key", "d", "t").join(by_key(ends), "key")
    slot = F.pmod(F.xxhash64("d", "t"), F.lit(SLOTS)).cast("int").alias("slot")
    few = rows.withColumn("slot", slot).join(F.broadcast(wanted.select(slot).distinct()), "slot", "left_semi").drop("slot")
    return few.join(by_key(wanted), ["d", "t"]).select("key", "text").dropDuplicates(["key"])
