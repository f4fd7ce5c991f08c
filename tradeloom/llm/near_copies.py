"""Near copies by word shingles: candidates from anchor-point covering, then the rest by prefixes, each link checked exactly.

1. A text's key is the hash of its words (A-Z in lower case, one blank between); texts of one key are copies and go on
   as one row. A changed word touches five shingles of five words but one word, so texts whose shingles are similar
   have SimHash fingerprints of their distinct words that differ in few bits. PRINTS independent fingerprints are
   taken, and SUBS minimum hashes of the shingles.
2. Each fingerprint is replicated to the anchors of all points within RADIUS bits (simhash.Covering). An anchor's
   texts are dealt on by one of their minimum hashes, which one the anchor says, and put in an order that differs
   from one minimum hash to the next; neighbours are a candidate pair. So an anchor gives fewer pairs than it has
   texts, however many meet there. Minimum hashes that very many texts share are cut into slices of about SLICE.
3. Texts of one template crowd the anchors, but a copy of one of them shares shingles with it that few others have. So
   each text also takes a sample of its shingles, by their hashes and nested (about 16 to 64 of them, all of a short
   text's); texts that are next to each other under a shingle of at most RARE texts are a candidate pair, if AGREE of
   their minimum hashes are equal (at a similarity of 0.8 fewer are in one of 800 pairs). Frequent shingles lead to
   the anchors' candidates only.
4. Rounds of exact checks: of each text's partners, by how often it was next to them, the first, then the next few, each
   if in another group so far; ROUNDS says how many, so that a large group has in proportion to its texts checked, not
   to its pairs.
5. These candidates are probable, not certain, and not all of them are checked. So all pairs of texts in different groups that still may be links are
   found by a prefix filter, which leaves none out, and checked too (near_exact). Pairs inside a group need no check.

A link is a similarity of `least` or more between the sets of word shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import near_exact
from .common import Scratch, by_key, mix64, text_chunks, whole_rows
from .components import components
from .shingles import shingle_hashes, word_hashes, words
from .simhash import SEED, Covering, majority

PRINTS, SUBS, RADIUS = 16, 8, 1
#: Texts that a slice of one minimum hash holds, about.
SLICE = 4096
#: Bytes of a fingerprint that the anchors use.
PRINT_BYTES = 6
#: Texts that a rare shingle is in at most, minimum hashes that a candidate pair has in common at least.
RARE, AGREE = 16, 3
#: Candidates by chance that a text has checked at most, in one round after the other, where still between groups.
ROUNDS = (1, 4, 16)
FAMILY = 0x9E3779B97F4A7C15


def families(h: np.ndarray, n: int) -> np.ndarray:
    """The n-th independent family of hashes from one."""
    return mix64(h + np.uint64(n * FAMILY & 0xFFFFFFFFFFFFFFFF))


def sampled(s: np.ndarray, owner: np.ndarray, n: int) -> list[np.ndarray]:
    """Of each of n texts' shingles s, those whose hash has so many zero bits that 16 to 64 are left; a longer text's
    rule leaves no shingle that a shorter one's drops."""
    mixed, size = families(s, PRINTS + SUBS), np.bincount(owner, minlength=n)
    bits = 2 * np.maximum(0, np.ceil(np.log2(np.maximum(size, 1) / 64) / 2)).astype(np.uint64)
    keep = mixed & ((np.uint64(1) << bits[owner]) - np.uint64(1)) == 0
    s, owner = s[keep], owner[keep]
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, owner = s[new], owner[new]
    return np.split(s, np.searchsorted(owner, np.arange(1, n)))


def text_prints(rows: DataFrame, width: int) -> DataFrame:
    """(d, t, text) -> (d, t, key, fps, subs, some): fps and subs are PRINTS and SUBS packed 64-bit numbers, some a
    sample of the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_chunks(batches, "text", 2 << 20):
            n = len(part)
            text, starts, ends, first = words(data, offsets)
            raw, owner, h = text.tobytes(), np.repeat(np.arange(n), np.diff(first)), word_hashes(text, starts, ends)
            key = [xxhash.xxh64_intdigest(raw[starts[x] : ends[y - 1]] if y > x else b"", SEED) for x, y in zip(first[:-1].tolist(), first[1:].tolist())]
            order = np.lexsort((h, owner))
            new = np.ones(len(h), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
            once, of = h[order][new], owner[order][new]
            fps = np.stack([majority(families(once, i), of, n, PRINT_BYTES) for i in range(PRINTS)], 1)
            s, of = shingle_hashes(h, first, width)
            subs = np.zeros((n, SUBS), np.uint64)
            if len(s):
                heads = np.flatnonzero(np.diff(of, prepend=-1))
                for j in range(SUBS):
                    subs[of[heads], j] = np.minimum.reduceat(families(s, PRINTS + j), heads)
            packed = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (fps, subs, sampled(s, of, n))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(key, np.uint64).view(np.int64)), *packed], ["d", "t", "key", "fps", "subs", "some"])

    return rows.select("d", "t", "text").mapInArrow(run, "d bigint, t bigint, key bigint, fps binary, subs binary, some binary")


def turned(key: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """Keys rotated by j bytes, to be sorted in another order for each j, or rotated back."""
    by = (8 * j & 63).astype(np.uint64)
    by = (np.uint64(64) - by) & np.uint64(63) if back else by
    x = key.view(np.uint64)
    return ((x << by) | (x >> ((np.uint64(64) - by) & np.uint64(63)))).view(np.int64)


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, width)


def slices_of(keys: DataFrame) -> DataFrame:
    """(key, j, n): of the minimum hashes that more than SLICE texts share, the slices that each such text's is cut into."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = unpacked(batch.column(1), SUBS)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), SUBS)), pa.array(np.tile(np.arange(SUBS, dtype=np.int32), len(s))), pa.array(s.ravel().view(np.int64))], ["key", "j", "sub"])

    every = keys.select("key", "subs").mapInArrow(each, "key bigint, j int, sub bigint")
    often = every.groupBy("j", "sub").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SLICE)
    return every.join(often, ["j", "sub"]).select("key", "j", F.ceil(F.col("n") / SLICE).cast("int").alias("n"))


def meetings(keys: DataFrame) -> DataFrame:
    """(key, fps, subs, slices) -> (meet, turn): where a text meets others, and its place there; the low three bits
    of `meet` say by how much the key is turned."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover = Covering()
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                key, fps, subs = part.column(0).to_numpy(), unpacked(part.column(1), PRINTS), unpacked(part.column(2), SUBS)
                cuts = np.ones((len(key), SUBS), np.uint64)
                for row, found in enumerate(part.column(3).to_pylist()):
                    for x in found or ():
                        cuts[row, x["j"]] = x["n"]
                anchor, at = cover.anchors(fps.ravel().view(np.int64), RADIUS)
                row, place = at // PRINTS, mix64(anchor.astype(np.uint64) << np.uint64(5) | (at % PRINTS).astype(np.uint64))
                j = (place >> np.uint64(61)).astype(np.int64)
                turn = turned(key[row], j)
                meet = mix64(place ^ mix64(subs[row, j] + turn.view(np.uint64) % cuts[row, j]))
                meet = meet & ~np.uint64(7) | j.astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(meet.view(np.int64)), pa.array(turn)], ["meet", "turn"])

    return keys.select("key", "fps", "subs", "slices").mapInArrow(replicate, "meet bigint, turn bigint")


def neighbours(met: DataFrame) -> DataFrame:
    """(meet, turn) -> distinct pairs of keys (u > v) next to each other, and how often they are."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [np.zeros(0, np.int64)] * 2
        for batch in batches:
            meet, turn = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(last))
            at = np.flatnonzero(meet[1:] == meet[:-1])
            j = meet & 7
            a, b = turned(turn[at], j[at], True), turned(turn[at + 1], j[at], True)
            apart = a != b
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)[apart]), pa.array(np.minimum(a, b)[apart])], ["u", "v"])
            last = [meet[-1:], turn[-1:]]

    sorted_ = met.repartition("meet").sortWithinPartitions("meet", "turn")
    return sorted_.mapInArrow(chain, "u bigint, v bigint").groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))


def rare_neighbours(keys: DataFrame) -> DataFrame:
    """keys (key, some) -> (u, v, n) as in neighbours(), of texts under shingles of at most RARE texts."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            some = batch.column(1).to_pylist()
            shingles.append(np.frombuffer(b"".join(some), np.int64))
            owners.append(np.repeat(batch.column(0).to_numpy(), [len(x) // 8 for x in some]))
        s, key = np.concatenate(shingles), np.concatenate(owners)
        order = np.argsort(s, kind="stable")
        s, key = s[order], key[order]
        # more than RARE in one task are too many as they are: one over is enough to tell
        nth = np.arange(len(s)) - np.searchsorted(s, s)
        few = nth <= RARE
        s, key = s[few], key[few]
        for i in range(0, len(s), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(s[i : i + (1 << 16)]), pa.array(key[i : i + (1 << 16)])], ["shingle", "key"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, key = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def pairs(s: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
            heads = np.searchsorted(s, s)
            size = np.searchsorted(s, s, "right") - heads
            at = np.flatnonzero((s[1:] == s[:-1]) & (size[1:] <= RARE)) if len(s) else np.zeros(0, np.int64)
            a, b = key[at], key[at + 1]
            apart = a != b
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)[apart]), pa.array(np.minimum(a, b)[apart])], ["u", "v"])

        for batch in batches:
            s, key = np.concatenate([s, batch.column(0).to_numpy()]), np.concatenate([key, batch.column(1).to_numpy()])
            last = int(np.searchsorted(s, s[-1])) if len(s) else 0
            yield pairs(s[:last], key[:last])
            s, key = s[last : last + RARE + 1], key[last : last + RARE + 1]  # of a frequent one no more is kept
        yield pairs(s, key)

    spread_ = keys.select("key", "some").mapInArrow(spread, "shingle bigint, key bigint")
    sorted_ = spread_.repartition("shingle").sortWithinPartitions("shingle", "key")
    return sorted_.mapInArrow(chain, "u bigint, v bigint").groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))


def agreeing(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """The pairs (u, v, n) of keys that have AGREE minimum hashes in common."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (unpacked(batch.column(3), SUBS) == unpacked(batch.column(4), SUBS)).sum(1) >= AGREE
            yield batch.select(["u", "v", "n"]).filter(pa.array(same))

    one, other = (keys.select(F.col("key").alias(k), F.col("subs").alias(f"{k}_subs")) for k in "uv")
    both = by_key(by_key(pairs).join(one, "u")).join(other, "v").select("u", "v", "n", "u_subs", "v_subs")
    return both.mapInArrow(judge, "u bigint, v bigint, n bigint")


def shingle_set(text: str, width: int) -> set[bytes]:
    """Distinct word shingles, A-Z in lower case; fewer words: the whole sequence."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def similarity(a: set[bytes], b: set[bytes]) -> float:
    """Jaccard similarity; 1 for two texts without words."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def similar(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (u, v) of keys whose texts' word shingles have at least that similarity, exactly."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [similarity(shingle_set(x, width), shingle_set(y, width)) >= least for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(near, pa.bool_()))

    one, other = (texts.select(F.col("key").alias(k), F.col("text").alias(f"{k}_text")) for k in "uv")
    return by_key(by_key(pairs).join(one, "u")).join(other, "v").select("u", "v", "u_text", "v_text").mapInArrow(judge, "u bigint, v bigint")


def strongest(pairs: DataFrame, most: int) -> DataFrame:
    """(u, v, n) -> (u, v, nth): the pairs that are among the `most` of either key that were next to each other most
    often, equals by a hash, with the better of their two places."""
    both = pairs.select("u", "v", "n", F.col("u").alias("key")).union(pairs.select("u", "v", "n", F.col("v").alias("key")))
    order = Window.partitionBy("key").orderBy(F.desc("n"), F.xxhash64("u", "v"), "u", "v")
    return both.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).groupBy("u", "v").agg(F.min("nth").alias("nth"))


def near_groups(keys: DataFrame, rows: DataFrame, scratch: Scratch, width: int, least: float) -> DataFrame:
    """keys (key, d, t, fps, subs, some) of different texts, rows (d, t, text) -> (node, root) of keys that have links."""
    slices = slices_of(keys).groupBy("key").agg(F.collect_list(F.struct("j", "n")).alias("slices"))
    shared = scratch.write("near-shared", rare_neighbours(keys))
    found = neighbours(meetings(keys.join(slices, "key", "left"))).union(agreeing(shared, keys))
    found = scratch.write("near-found", found.groupBy("u", "v").agg(F.sum("n").alias("n")))
    scratch.drop("near-shared")
    pairs = scratch.write("near-pairs", strongest(found, sum(ROUNDS)))
    scratch.drop("near-found")
    ends = pairs.select(F.col("u").alias("key")).union(pairs.select(F.col("v").alias("key"))).distinct()
    wanted = scratch.write("near-wanted", keys.select("key", "d", "t").join(ends, "key"))
    texts = rows.join(by_key(wanted), ["d", "t"]).select("key", "text")
    texts = scratch.write("near-texts", texts.dropDuplicates(["key"]))
    groups = scratch.write("near-groups", pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0))
    before = 0
    for most in ROUNDS:
        chosen = pairs.where((F.col("nth") > before) & (F.col("nth") <= before + most))
        if before:
            root = lambda k: groups.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root"))  # noqa: B023, E731
            chosen = chosen.join(root("u"), "u", "left").join(root("v"), "v", "left").where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v"))
        chosen = scratch.write("near-chosen", chosen.select("u", "v"))
        groups = components(groups.toDF("u", "v").union(similar(chosen, texts, width, least)), scratch, "near-groups")
        before += most
    return whole_groups(groups, keys, rows, scratch, width, least)


def whole_groups(groups: DataFrame, keys: DataFrame, rows: DataFrame, scratch: Scratch, width: int, least: float) -> DataFrame:
    """groups (node, root) joined wherever texts of two of them have a link, found without chance."""
    scratch.drop("near-pairs", "near-wanted", "near-texts", "near-chosen")
    spark = keys.sparkSession
    order = spark.sparkContext.broadcast(near_exact.frequent(rows, keys.count(), width))
    whole = near_exact.prefixes(rows, order, width, least).join(groups.withColumnRenamed("node", "key"), "key", "left")
    whole = scratch.write("near-prefixes", whole.withColumn("root", F.coalesce("root", "key")))
    pairs = scratch.write("near-crossing", near_exact.possible(near_exact.crossing(near_exact.spread(whole), least), whole, least))
    scratch.drop("near-prefixes")
    texts = scratch.write("near-texts", near_exact.texts_of(pairs, keys, rows))
    links = similar(pairs, texts, width, least)
    return components(groups.toDF("u", "v").union(links), scratch, "near-whole")


def deduplicated(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """`docs` without near copies: of each group the smallest doc_id stays (null first; of equal ids the least text hash).

    Null and empty texts are copies of each other, as are texts alike but for blanks and the case of A-Z. Of repeated
    rows one stays. Texts are read whole, whatever their length; an empty table stays empty; other columns, whatever
    their names, pass through.
    """
    scratch = Scratch(docs.sparkSession)
    rows = whole_rows(docs)
    prints = scratch.write("near-prints", text_prints(rows, width))
    first = F.min(F.struct("d", "t"))
    keys = scratch.write("near-keys", prints.groupBy("key").agg(first.alias("first"), F.count(F.lit(1)).alias("n"), F.first("fps").alias("fps"), F.first("subs").alias("subs"), F.first("some").alias("some")).select("key", "first.*", "n", "fps", "subs", "some"))
    root = near_groups(keys, rows.select("d", "t", "text"), scratch, width, least).withColumnRenamed("node", "key")
    rooted = scratch.write("near-rooted", keys.select("key", "d", "t", "n").join(root, "key", "left").withColumn("root", F.coalesce("root", "key")))
    stays = rooted.groupBy("root").agg(first.alias("stay"), F.sum("n").alias("n")).where("n > 1").select("root", F.col("stay.d").alias("stay_d"), F.col("stay.t").alias("stay_t"))
    stays = scratch.write("near-stays", stays)  # written, so that a join on a large group can be split
    copies = scratch.write("near-copies", rooted.join(stays, "root").select("key", "stay_d", "stay_t"))
    leaves = (F.col("d") != F.col("stay_d")) | (F.col("t") != F.col("stay_t"))
    gone = scratch.write("near-gone", prints.select("d", "t", "key").join(by_key(copies), "key").where(leaves).select("d", "t").distinct())
    again = not prints.groupBy("d", "t").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    scratch.keep("near-gone")
    kept = rows.select("row", "d", "t").join(by_key(gone), ["d", "t"], "left_anti")
    return (kept.dropDuplicates(["d", "t"]) if again else kept).select("row.*")
