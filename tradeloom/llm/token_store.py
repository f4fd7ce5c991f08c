"""Token ids in binary shards with a minimal perfect hash index per shard.

A store is a Parquet folder with one row per shard: the raw ids of its documents end to end (`payload`, little-endian,
2 bytes an id where the vocabulary allows, else 4) and an `index` of three parts after a header of counts and seed:
bucket displacements, a 32-bit fingerprint per slot, and each slot's (offset, length) in ids. A key hashes to a
bucket, the bucket's displacement gives its slot: no key is searched for, and a foreign key fails the fingerprint.
Shards hold whole documents in ascending doc_id order (nulls first; equal ids by text), at least `shard_ids` ids
each but for the last of a partition. Spark's writer commits them, so a lost executor costs only its own tasks, and
any file system that Spark writes to will do. The key of a repeated doc_id is the id and its ordinal in the shard.

Ids come from the vocabulary's rank file, which gives those of the tokenizers library for its JSON file (tests compare
them) in less time. Nulls are empty texts; a very long text is one document of one shard. An empty table makes an
empty store; other columns are not read. Where a document starts is a sum over one row a shard.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path

TABLE_CHUNKS = 800_000
SHARD_IDS = 1 << 20
HEADER = struct.Struct("<IIQ")
SCHEMA = "shard bigint, first_id bigint, last_id bigint, n_docs bigint, n_ids bigint, width int, doc_ids array<bigint>, index binary, payload binary"


class Encoder:
    """Whole texts to raw ids; stretches between blanks are encoded once per worker and remembered."""

    def __init__(self, ranks_path: str, pattern: str, special: str, special_id: int, end_id: int):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode_plain = tiktoken.Encoding("store", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.width = 2 if max(*ranks.values(), special_id, end_id) < 1 << 16 else 4
        self.type = np.dtype(f"<u{self.width}")
        self.special, self.special_raw, self.end = special, np.array([special_id], self.type).tobytes(), np.array([end_id], self.type).tobytes()
        self.chunks: dict[str, bytes] = {}

    def new(self, chunk: str) -> bytes:
        out = np.array(self.encode_plain(chunk), self.type).tobytes()
        if len(self.chunks) >= TABLE_CHUNKS:
            self.chunks.clear()
        if len(chunk) < 64:
            self.chunks[chunk] = out
        return out

    def plain(self, text: str) -> bytes:
        if "  " in text or text[-1:] == " ":  # runs of blanks may cross the cuts
            return np.array(self.encode_plain(text), self.type).tobytes()
        first, *rest = text.split(" ")
        got, new = self.chunks.get, self.new
        return b"".join([x if (x := got(c)) is not None else new(c) for c in [first, *[" " + c for c in rest]]])

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.special not in text:
            return self.plain(text)
        return self.special_raw.join(self.plain(x) if x else b"" for x in text.split(self.special))


@lru_cache(2)
def encoder(*args) -> Encoder:
    return Encoder(*args)


def key_hash(doc_id: int | None, ordinal: int, seed: int) -> int:
    return xxhash.xxh3_128_intdigest(struct.pack("<qIB", doc_id or 0, ordinal, doc_id is None), seed)


def build_index(keys: list[tuple[int | None, int]], offsets: list[int], lengths: list[int]) -> bytes:
    """Hash and displace: the fullest buckets choose first among the displacements that hit only free slots."""
    n = len(keys)
    m = n // 3 + 1
    for seed in range(1, 1000):
        hashes = [key_hash(*k, seed) for k in keys]
        buckets: list[list[int]] = [[] for _ in range(m)]
        for i, h in enumerate(hashes):
            buckets[(h & 0xFFFFFFFF) % m].append(i)
        slots, shifts, ok = [-1] * n, [0] * m, True
        for b in sorted(range(m), key=lambda b: -len(buckets[b])):
            mine = buckets[b]
            if not mine:
                break
            for shift in range(64 * n + 64):
                at = [slot_of(hashes[i], shift, n) for i in mine]
                if len(set(at)) == len(at) and all(slots[a] < 0 for a in at):
                    break
            else:
                ok = False
                break
            shifts[b] = shift
            for i, a in zip(mine, at):
                slots[a] = i
        if ok:
            prints = np.array([hashes[i] >> 96 for i in slots], "<u4")
            where = np.array([(offsets[i], lengths[i]) for i in slots], "<u8")
            return HEADER.pack(n, m, seed) + np.array(shifts, "<u4").tobytes() + prints.tobytes() + where.tobytes()
    raise ValueError("no seed gives a perfect hash; are keys repeated?")


def slot_of(h: int, shift: int, n: int) -> int:
    return ((h >> 32 & 0xFFFFFFFF) + shift * (h >> 64 & 0xFFFFFFFF | 1) + (shift * shift * shift >> 3)) % n


class Index:
    def __init__(self, raw: bytes):
        self.n, self.m, self.seed = HEADER.unpack_from(raw)
        at = HEADER.size
        self.shifts = np.frombuffer(raw, "<u4", self.m, at)
        self.prints = np.frombuffer(raw, "<u4", self.n, at + 4 * self.m)
        self.where = np.frombuffer(raw, "<u8", 2 * self.n, at + 4 * self.m + 4 * self.n).reshape(-1, 2)

    def find(self, doc_id: int | None, ordinal: int = 0) -> tuple[int, int] | None:
        """(offset, length) in ids, or None for a key that the fingerprint refutes."""
        if not self.n:
            return None
        h = key_hash(doc_id, ordinal, self.seed)
        slot = slot_of(h, int(self.shifts[(h & 0xFFFFFFFF) % self.m]), self.n)
        return tuple(self.where[slot].tolist()) if self.prints[slot] == h >> 96 else None


def ordinals(doc_ids: list[int | None]) -> list[int]:
    out, seen = [], {}
    for d in doc_ids:
        out.append(seen.get(d, 0))
        seen[d] = out[-1] + 1
    return out


def write_store(docs: DataFrame, path: str, ranks: str, pattern: str, special: str, special_id: int, end_id: int, shard_ids: int = SHARD_IDS) -> None:
    """Encode whole texts (null: empty), end each with `end_id`, and write shards in ascending doc_id order."""
    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks, pattern, special, special_id, end_id)
        ids: list[int | None] = []
        raw: list[bytes] = []
        size, seq, part = 0, 0, 0

        def shard() -> pa.RecordBatch:
            lengths = [len(x) // encode.width for x in raw]
            offsets = [0, *np.cumsum(lengths).tolist()]
            known = [d for d in ids if d is not None]
            row = [part << 32 | seq, known[0] if known else None, known[-1] if known else None, len(ids), offsets[-1], encode.width, ids, build_index(list(zip(ids, ordinals(ids))), offsets[:-1], lengths), b"".join(raw)]
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, text, at in zip(batch.column(0), batch.column(1), batch.column(2)):
                part = at.as_py()
                ids.append(doc_id.as_py())
                raw.append(encode(text.as_py()) + encode.end)
                size += len(raw[-1]) // encode.width
                if size >= shard_ids:
                    yield shard()
                    ids, raw, size, seq = [], [], 0, seq + 1
        if ids:
            yield shard()

    ordered.mapInArrow(run, SCHEMA).write.parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, shard, at (ids before it in its shard), n_tokens, ids_crc32 -- each by its key's slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                index, ids = Index(row["index"]), np.frombuffer(row["payload"], f"<u{row['width']}")
                out: list[list] = [[], [], [], [], []]
                for key in zip(row["doc_ids"], ordinals(row["doc_ids"])):
                    at, n = index.find(*key)
                    for column, v in zip(out, (key[0], row["shard"], at, n, zlib.crc32(ids[at : at + n].astype("<u4").tobytes()))):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "shard", "at", "n_tokens", "ids_crc32"])

    return spark.read.parquet(path).select("shard", "width", "doc_ids", "index", "payload").mapInArrow(run, "doc_id bigint, shard bigint, at bigint, n_tokens bigint, ids_crc32 bigint")


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The ids of each distinct doc_id of `keys` that the store holds: (doc_id, ids array<int>), first of repeated ids.

    Only shards whose ids span some key are read (their first and last ids are in the files' statistics). Keys meet
    their shard by an equi-join on the shard's own list of ids, without its payload; payloads of shards that hold none
    are not sent. The index gives the place in the payload.
    """
    ends = keys.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    shards = spark.read.parquet(path).where((F.col("last_id") >= ends.lo) & (F.col("first_id") <= ends.hi))
    wanted = shards.select("shard", F.explode("doc_ids").alias("doc_id")).join(keys.select("doc_id").distinct(), "doc_id").groupBy("shard").agg(F.collect_set("doc_id").alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                index, ids = Index(row["index"]), np.frombuffer(row["payload"], f"<u{row['width']}")
                found = [(k, ids[at : at + n].astype(np.int32)) for k in row["wanted"] for at, n in [index.find(k)]]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([v for _, v in found], pa.list_(pa.int32()))], ["doc_id", "ids"])

    joined = shards.join(wanted, "shard").select("width", "index", "payload", "wanted")
    return joined.mapInArrow(run, "doc_id bigint, ids array<int>").dropDuplicates(["doc_id"])


def op5(docs: DataFrame, ranks: str, pattern: str, special: str, special_id: int, end_id: int = 2) -> DataFrame:
    """Write a store in the shared folder, read it back, and give each document its place among all ids."""
    spark = docs.sparkSession
    path = new_path(spark, "token-store")
    write_store(docs, path, ranks, pattern, special, special_id, end_id)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard, not a document
    starts = spark.read.parquet(path).select("shard", "n_ids").select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return read_store(spark, path).join(starts, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")

