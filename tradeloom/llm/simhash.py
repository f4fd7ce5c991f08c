"""SimHash near-duplicates with anchor-point covering.

A fingerprint's 64 bits hold two blocks of 23 bits. Each block has the perfect binary Golay code: 4096 anchors, and
every point within 3 bits of exactly one of them (covering radius 3). Two fingerprints within `threshold` bits have a
point between them, half the threshold from either; both are replicated to the anchors of all points that near
(per block: within covering radius plus the bits spent there), so they meet at that point's anchor. Fingerprints are
compared per anchor; copies share one fingerprint and are compared once.

Defined cases: null and empty texts have fingerprint zero and link like any other; repeated rows keep their rows;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_chunks
from .components import components, local_components
from .shingles import spans, words

SEED = 42
#: Generator polynomial of the binary Golay code of length 23.
GOLAY, BLOCK = 0xC75, 23
#: Groups up to this size are compared pair by pair; larger ones through the points between.
PAIRWISE = 96


@lru_cache(1)
def lanes() -> np.ndarray:
    """The bits of each byte, one to each byte of a 64-bit number."""
    return np.array([sum((b >> k & 1) << 8 * k for k in range(8)) for b in range(256)], np.uint64)


def majority(h: np.ndarray, owner: np.ndarray, n: int, used: int = 8) -> np.ndarray:
    """For each of n owners (`owner` ascends): bit i is 1 if set in over half of its hashes, in the lowest `used` bytes.

    Eight bits are added at once, in stretches of at most 255 hashes, which no lane outgrows.
    """
    total = np.bincount(owner, minlength=n)
    counts = np.zeros((n, 8 * used), np.int64)
    if len(h):
        place = np.arange(len(h)) - np.repeat(np.cumsum(total) - total, total)
        heads = np.flatnonzero(place % 255 == 0)
        own = owner[heads]
        firsts = np.flatnonzero(np.diff(own, prepend=-1))
        each = h.astype("<u8").view(np.uint8).reshape(-1, 8)
        for b in range(used):
            part = np.add.reduceat(lanes()[each[:, b]], heads).astype("<u8").view(np.uint8).reshape(-1, 8)
            counts[own[firsts], 8 * b : 8 * b + 8] = np.add.reduceat(part, firsts, axis=0, dtype=np.int64)
    out = np.zeros((n, 8), np.uint8)
    out[:, :used] = np.packbits(2 * counts > total[:, None], axis=1, bitorder="little")
    return out.view("<i8").ravel().astype(np.int64)


def hashes(raw: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(raw[x:y], SEED) for x, y in zip(a.tolist(), b.tolist())), np.uint64, len(a))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp bigint): bit i is 1 if set in over half the XXH64 hashes of the word shingles, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_chunks(batches, "text", 2 << 20):
            text, starts, ends, first = words(data, offsets)
            a, b, owner = spans(first, starts, ends, width)
            fp = majority(hashes(text.tobytes(), a, b), owner, len(part))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


class Covering:
    def __init__(self) -> None:
        one = np.zeros(BLOCK, np.int64)
        for i in range(BLOCK):
            x = 1 << i
            for k in range(BLOCK - 1, 10, -1):
                if x >> k & 1:
                    x ^= GOLAY << (k - 11)
            one[i] = x
        self.low, self.high = (self.syndromes(one[lo : lo + n]) for lo, n in ((0, 12), (12, 11)))
        self.leader = np.zeros(1 << 11, np.int64)
        for weight in (3, 2, 1, 0):
            for bits in combinations(range(BLOCK), weight):
                self.leader[np.bitwise_xor.reduce(one[list(bits)]) if bits else 0] = sum(1 << b for b in bits)

    @staticmethod
    def syndromes(one: np.ndarray) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for s in one:
            out = np.concatenate([out, out ^ s])
        return out

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return x ^ self.leader[self.low[x & 0xFFF] ^ self.high[x >> 12]]

    def anchors(self, fp: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(anchor, row) pairs, each once: the anchors of all points within `radius` bits."""
        blocks = [fp & (1 << BLOCK) - 1, fp >> BLOCK & (1 << BLOCK) - 1]
        near = [[np.stack([self.nearest(x ^ sum(1 << b for b in bits)) for bits in combinations(range(BLOCK), w)], 1) for w in range(radius + 1)] for x in blocks]
        found = [(near[0][w][:, :, None] << BLOCK | near[1][v][:, None, :]).reshape(len(fp), -1) for w in range(radius + 1) for v in range(radius + 1 - w)]
        every = np.sort(np.concatenate(found, 1), 1)
        new = np.ones(every.shape, bool)
        new[:, 1:] = every[:, 1:] != every[:, :-1]
        return every[new], np.nonzero(new)[0]


def bit_count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def group_links(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that join the members of one large group: both of each pair lie near one point between them."""
    half = (threshold + 1) // 2
    masks = np.array([sum(1 << b for b in bits) for w in range(half + 1) for bits in combinations(range(64), w)], np.uint64).view(np.int64)
    a, b = [], []
    # the points near each member, dealt by a hash of the point so that only a slice is held at a time
    slices = max(1, len(fp) * len(masks) >> 22)
    for s in range(slices):
        points, owners = [], []
        for m in masks:
            z = fp ^ m
            mine = np.flatnonzero((z.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(slices) == s)
            points.append(z[mine])
            owners.append(mine)
        z, own = np.concatenate(points), np.concatenate(owners)
        order = np.argsort(z, kind="stable")
        same = np.flatnonzero(z[order][1:] == z[order][:-1])
        x, y = own[order][same], own[order][same + 1]
        if threshold % 2:  # points within half either side may be one bit too far
            ok = bit_count(fp[x] ^ fp[y]) <= threshold
            x, y = x[ok], y[ok]
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def compare(anchor: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by anchor, whole groups: (fp, smallest fp of its links in the group) where they differ."""
    n = len(fp)
    heads = np.flatnonzero(np.diff(anchor, prepend=anchor[0] - 1 if n else 0))
    size = np.diff(np.append(heads, n))
    group = np.repeat(np.arange(len(heads)), size)
    left = n - np.arange(n) - 1
    left = np.minimum(left, (heads + size)[group] - np.arange(n) - 1)
    small = size[group] <= PAIRWISE
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lag in range(1, PAIRWISE):
        x = np.flatnonzero(small & (left >= lag))
        if not len(x):
            break
        x = x[bit_count(fp[x] ^ fp[x + lag]) <= threshold]
        a.append(x)
        b.append(x + lag)
    for g in np.flatnonzero(size > PAIRWISE):
        x, y = group_links(fp[heads[g] : heads[g] + size[g]], threshold)
        a.append(x + heads[g])
        b.append(y + heads[g])
    a, b = np.concatenate(a), np.concatenate(b)
    rows = np.unique(np.concatenate([a, b]))
    label = rows[local_components(len(rows), np.searchsorted(rows, a), np.searchsorted(rows, b))]
    far = label != rows
    return fp[rows[far]], fp[label[far]]


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of sorted rows in stretches that end where the first column changes."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if not batch.num_rows:
            continue
        if held and (cut := int(np.searchsorted(columns[0], columns[0][-1]))) + (held[-1][0][-1] != columns[0][0]):  # else one group goes on
            held.append([c[:cut] for c in columns])
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, columns = [], [c[cut:] for c in columns]
        held.append(columns)
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def links(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """Distinct fp -> edges (u, v) whose components are those of all links; at most one edge per replica."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover = Covering()
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for i in range(0, len(fp), step := 20_000 if threshold <= 2 else 2_000):
                anchor, row = cover.anchors(fp[i : i + step], (threshold + 1) // 2)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[i : i + step][row])], ["anchor", "fp"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchor, fp in whole_groups(batches):
            u, v = compare(anchor, fp, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    dealt = prints.select("fp").distinct().mapInArrow(replicate, "anchor bigint, fp bigint").repartition("anchor").sortWithinPartitions("anchor", "fp")
    return dealt.mapInArrow(link, "u bigint, v bigint")


def classes(prints: DataFrame, scratch: Scratch, threshold: int = 2) -> DataFrame:
    """(doc_id, fp) -> (doc_id, fp, component_id): the smallest doc_id reachable over links of fingerprints."""
    root = components(links(prints, threshold), scratch, "simhash-links")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = least.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.write("simhash-classes", rooted.join(named, "root").select("fp", "component_id"))  # written, so that a join on a hot fingerprint can be split
    scratch.drop("simhash-links")
    return prints.join(named, "fp")


def op7(docs: DataFrame, width: int = 3, threshold: int = 2) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    prints = scratch.write("simhash", fingerprints(docs, width))
    return classes(prints, scratch, threshold).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
