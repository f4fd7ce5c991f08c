"""Similar names as a set-similarity join: prefixes under one global order of rarity, exact ratios at the end.

For a ratio r two names of T letters together match in M >= r / 2 * T letters. So their lengths are within a factor of
each other, they share M letters, as multisets and in order, and, as unmatched letters part the matching blocks, at least
(1.5 r - 1) T - 1 pairs of neighbouring letters. Pieces (pairs of letters, or single letters where T is too small for a
pair) are numbered by occurrence, so that multisets are sets. If two names share `need` pieces, they share one among the
size - need + 1 rarest of each: only those meet, under keys that hold a bucket of the length as well, so that a frequent
piece is split by length.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-9
#: Growth of the length from bucket to bucket, and the classes of letters that are counted.
BUCKET, CLASSES = 1.5, 32


def shared_pairs(total: Column, least: float) -> Column:
    """Pairs of neighbouring letters that names of `total` letters share at least; 0 where none can be told."""
    return F.greatest(F.lit(0), F.ceil(F.lit(1.5 * least - 1) * total - 1 - EPS)).cast("int")


def shared_letters(total: Column, least: float) -> Column:
    return F.ceil(F.lit(least / 2) * total - EPS).cast("int")


def pieces(name: Column, size: int) -> Column:
    """array<struct<g, k>>: the k-th occurrence of each stretch of `size` letters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(name) - (size - 1), F.lit(1)))
    all_ = F.when(F.length(name) >= size, F.transform(starts, lambda i: F.substring(name, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    return F.transform(all_, lambda g, i: F.struct(g.alias("g"), F.size(F.filter(F.slice(all_, 1, i + 1), lambda x: x == g)).alias("k")))


def letter_bits(name: Column) -> Column:
    """array<bigint>: four words with, for each class of letters, as many of eight bits set as the name has such letters,
    and the number of letters beyond eight of a class. Common bits of two names are their common letters."""
    classes = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.pmod(F.ascii(c), F.lit(CLASSES)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda k: F.size(F.filter(classes, lambda c: c == k)))
    byte = lambda c, i: F.shiftleft((F.call_function("shiftleft", F.lit(1), F.least(c, F.lit(8))) - 1).cast("bigint"), 8 * i)
    words = [reduce(lambda x, y: x.bitwiseOR(y), [byte(F.get(counts, F.lit(8 * w + i)), i) for i in range(8)]) for w in range(CLASSES // 8)]
    beyond = F.aggregate(counts, F.lit(0), lambda s, c: s + F.greatest(c - 8, F.lit(0))).cast("bigint")
    return F.array(*words, beyond)


def common_letters(a: str, b: str) -> Column:
    """At least as many letters as two names share, from their bits."""
    x, y = F.col(a), F.col(b)
    return sum(F.bit_count(x[w].bitwiseAND(y[w])) for w in range(CLASSES // 8)) + F.least(x[CLASSES // 8], y[CLASSES // 8])


def places(name: str) -> dict[str, int]:
    """Letter -> bits of the places that it is at."""
    out: dict[str, int] = {}
    for i, c in enumerate(name):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common_subsequence(at: dict[str, int], n: int, other: str) -> int:
    """Length of the longest common subsequence of a name of n letters, given by its places, and another: a bit for each
    letter of the name, all letters of the other in one sum."""
    whole = v = (1 << n) - 1
    for c in other:
        if u := v & at.get(c, 0):
            v = (v + u | v - u) & whole
    return n - v.bit_count()


def bucket(length: Column) -> Column:
    return F.floor(F.log(length.cast("double")) / F.log(F.lit(BUCKET)) + EPS).cast("int")


def candidates(names: DataFrame, size: int, need, fits, least: float) -> DataFrame:
    """names (side, name, len, letters) -> distinct (a, b) of the two sides that pass every bound.

    need(total): pieces that a pair shares at least; fits(total): whether the pair is to be found by pieces of this size.
    """
    narrow = least / (2 - least)
    tokens = names.select("side", "name", "len", F.explode(pieces(F.col("name"), size)).alias("x")).select("side", "name", "len", "x.g", "x.k")
    often = tokens.groupBy("g", "k").agg(F.count(F.lit(1)).alias("n"))
    ordered = tokens.join(often, ["g", "k"]).groupBy("side", "name", "len").agg(F.array_sort(F.collect_list(F.struct("n", "g", "k"))).alias("own"))
    shortest = F.col("len") + F.ceil(F.col("len") * narrow - EPS)  # the least total of a pair that this name may be in
    prefix = F.greatest(F.size("own") - F.greatest(need(shortest), F.lit(1)) + 1, F.lit(0))
    rows = ordered.join(names.select("side", "name", "letters"), ["side", "name"]).select("side", "name", "len", "letters", F.size("own").alias("size"), F.posexplode(F.slice("own", 1, prefix)).alias("at", "x"))
    rows = rows.select("side", "name", "len", "letters", "size", "at", F.concat("x.g", F.lit("\0"), F.col("x.k").cast("string")).alias("piece"))
    near = F.sequence(bucket(F.ceil(F.col("len") * narrow - EPS)), bucket(F.floor(F.col("len") / narrow + EPS)))
    left = rows.where("side = 'a'").withColumn("bucket", F.explode(near))
    right = rows.where("side = 'b'").withColumn("bucket", bucket(F.col("len")))
    one, other = (d.drop("side").withColumnsRenamed({c: f"{c}_{s}" for c in ("len", "letters", "size", "at")} | {"name": s}) for d, s in ((left, "a"), (right, "b")))
    total = F.col("len_a") + F.col("len_b")
    ahead = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))  # if no piece before these is shared
    bounds = fits(total) & (F.least("len_a", "len_b") >= narrow * F.greatest("len_a", "len_b") - EPS) & (ahead >= need(total)) & (common_letters("letters_a", "letters_b") >= shared_letters(total, least))
    return one.join(other, ["piece", "bucket"]).where(bounds).select("a", "b").distinct()


def similar_names(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Distinct names (a) and (b) -> (a, b, ratio) with ratio >= least > 0. Empty names are like no name but each other,
    and those are left out."""
    sides = [d.where(f"{c} <> ''").select(F.lit(c).alias("side"), F.col(c).alias("name")).distinct() for d, c in ((left, "a"), (right, "b"))]
    names = sides[0].union(sides[1]).withColumns({"len": F.length("name"), "letters": letter_bits(F.col("name"))})
    by_pairs = lambda total: shared_pairs(total, least) > 0
    long = candidates(names, 2, lambda t: shared_pairs(t, least), by_pairs, least)
    shortest = F.col("len") + F.ceil(F.col("len") * (least / (2 - least)) - EPS)
    few = names.where(~by_pairs(shortest))  # longer ones have no partner so short that pairs tell nothing
    short = candidates(few, 1, lambda t: shared_letters(t, least), lambda t: ~by_pairs(t), least)

    def ratios(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            name, at, near = None, {}, []
            for a, b in zip(f.a, f.b):
                if a != name:
                    name, at = a, places(a)
                near.append(2 * common_subsequence(at, len(a), b) >= least * (len(a) + len(b)) - EPS)  # matching blocks are one
            f = f[near]
            f = f.assign(ratio=[difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(f.a, f.b)])
            yield f[f.ratio >= least]

    return short.union(long).mapInPandas(ratios, "a string, b string, ratio double")
