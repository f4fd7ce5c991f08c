"""Nearest neighbours by inner product with a vantage-point tree per shard.

Largest inner product becomes least Euclidean distance by one added coordinate. A small vantage-point tree, fitted on
a bounded sample, deals every row to a shard; a shard with over MOST_ROWS rows of its own is split by a hash. Each
task builds its own tree. A query first searches its home shard, then, with the bound found there, every other shard
that the triangle inequality does not rule out. `factor` scales the bound in that test: one is exact, less prunes more.

Vectors that are null, zero, hold null or non-finite components, or have another length than most (so that they have
no inner product with them), take no part; nor do rows without vec_id. Equal vectors beyond the first k + 1 by id
cannot be among k nearest and are left out inside a shard. Ties of any number go to the smaller ids. Repeated ids are
candidates of their own. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, MOST_SHARDS = 4096, 256
SHARD_ROWS, MOST_ROWS, LEAF, QUERY_BLOCK = 16_384, 32_768, 256, 4096
#: Room for the rounding of distances, which the added coordinate of almost longest vectors makes largest.
SLACK = 1e-7
FACTOR = 0.55


class Tree:
    """Vantage points, radii and leaves in a heap-ordered list; built on rows of equal length."""

    def __init__(self, points: np.ndarray, leaf: int, depth: int = 60):
        self.points = points
        self.root = self.build(np.arange(len(points)), leaf, depth)

    def build(self, rows: np.ndarray, leaf: int, depth: int):
        if len(rows) <= leaf or not depth:
            return rows
        # the row farthest from the mean spreads distances most
        vantage = self.points[rows[np.argmax(((self.points[rows] - self.points[rows].mean(0)) ** 2).sum(1))]]
        d = distance(self.points[rows], vantage)
        radius = float(np.median(d))
        inside = d <= radius
        if inside.all():
            return rows
        return vantage, radius, self.build(rows[inside], leaf, depth - 1), self.build(rows[~inside], leaf, depth - 1)


def distance(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - to) ** 2).sum(1), 0))


class Search:
    """k nearest of many queries at once; each node is visited with the queries that need it.

    Candidates come from one matrix product with room for its rounding; which of them are nearest is settled by exact
    products of the vectors, ties to the smaller id, however many tie.
    """

    def __init__(self, tree: Tree, ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, own: np.ndarray, bound: np.ndarray, longest: float, k: int, factor: float):
        self.tree, self.ids, self.vectors, self.queries, self.own, self.k, self.factor = tree, ids, vectors, queries, own, k, factor
        self.norm = np.sqrt((queries * queries).sum(1)) * longest
        self.points = lifted(queries, longest, True)
        self.best = np.full((len(queries), k), -1, np.int64)  # rows of the tree
        self.score = np.full((len(queries), k), -np.inf)
        self.bound = bound.copy()
        self.visit(tree.root, np.arange(len(queries)))

    def visit(self, node, q: np.ndarray) -> None:
        if not len(q):
            return
        if isinstance(node, np.ndarray):
            for i in range(0, len(q), step := max(1, (1 << 19) // len(node))):
                self.scan(node, q[i : i + step])
            return
        vantage, radius, inner, outer = node
        d = distance(self.points[q], vantage)
        near = d <= radius
        self.visit(inner, q[near])
        self.visit(outer, q[~near])
        gap = np.abs(d - radius)
        still = gap <= self.factor * self.bound[q] + SLACK
        self.visit(outer, q[near & still])
        self.visit(inner, q[~near & still])

    def scan(self, rows: np.ndarray, q: np.ndarray) -> None:
        about = self.queries[q] @ self.vectors[rows].T
        about[self.ids[rows] == self.own[q][:, None]] = -np.inf
        room = 1e-9 * self.norm[q]
        least = self.score[q, -1] - room
        if len(rows) > self.k:
            least = np.maximum(least, np.partition(about, len(rows) - self.k, 1)[:, len(rows) - self.k] - room)
        at, col = np.nonzero((about >= least[:, None]) & np.isfinite(about))
        if not len(at):
            return
        exact = (self.queries[q[at]] * self.vectors[rows[col]]).sum(1)
        old, place = np.nonzero(self.best[q] >= 0)
        of = np.concatenate([at, old])
        row = np.concatenate([rows[col], self.best[q[old], place]])
        score = np.concatenate([exact, self.score[q[old], place]])
        order = np.lexsort((self.ids[row], -score, of))
        of, row, score = of[order], row[order], score[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        keep = rank < self.k
        self.best[q[of[keep]], rank[keep]], self.score[q[of[keep]], rank[keep]] = row[keep], score[keep]
        self.bound[q] = np.minimum(self.bound[q], reach_of(self.score[q, -1], self.norm[q]))


def reach_of(score: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """The distance, between points of lifted(), at which a product of `score` lies; norm: the query's length times the
    longest."""
    return np.where(np.isfinite(score), np.sqrt(np.maximum(2 - 2 * score / norm, 0)), np.inf)


def lifted(v: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Rows on the unit sphere, where distance falls as the inner product grows."""
    norm = np.sqrt((v * v).sum(1))
    if query:
        return np.concatenate([v / norm[:, None], np.zeros((len(v), 1))], 1)
    return np.concatenate([v / longest, np.sqrt(np.maximum(1 - (norm / longest) ** 2, 0))[:, None]], 1)


def home(tree, points: np.ndarray, names: dict) -> np.ndarray:
    out = np.zeros(len(points), np.int32)

    def down(node, rows: np.ndarray) -> None:
        if isinstance(node, np.ndarray):
            out[rows] = names[id(node)]
            return
        near = distance(points[rows], node[0]) <= node[1]
        down(node[2], rows[near])
        down(node[3], rows[~near])

    down(tree, np.arange(len(points)))
    return out


def reached(tree, points: np.ndarray, bound: np.ndarray, factor: float, names: dict) -> list[tuple[np.ndarray, int]]:
    """(rows, shard) of all shards that the relaxed triangle inequality leaves to each row."""
    out: list[tuple[np.ndarray, int]] = []

    def down(node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, np.ndarray):
            out.append((rows, names[id(node)]))
            return
        d, near = distance(points[rows], node[0]), None
        near = d <= node[1]
        still = np.abs(d - node[1]) <= factor * bound[rows] + SLACK
        down(node[2], rows[near | still])
        down(node[3], rows[~near | still])

    down(tree, np.arange(len(points)))
    return out


def leaves(node) -> list[np.ndarray]:
    return [node] if isinstance(node, np.ndarray) else leaves(node[2]) + leaves(node[3])


def unpack(column) -> np.ndarray:
    return np.stack([np.frombuffer(b, np.float64) for b in column]) if len(column) else np.zeros((0, 1))


def searched(rows: pd.DataFrame, queries: pd.DataFrame, k: int, factor: float, longest: float) -> pd.DataFrame:
    names = ["query_id", "vec_id", "score"]
    if not len(rows) or not len(queries):
        return pd.DataFrame({n: np.zeros(0, t) for n, t in zip(names, ("int64", "int64", "float64"))})
    rows = rows.sort_values("vec_id", kind="stable")
    rows = rows[rows.groupby("vector", sort=False).cumcount() <= k]  # equal vectors: the first by id
    vectors, ids = unpack(rows.vector), rows.vec_id.to_numpy()
    tree, parts = Tree(lifted(vectors, longest, False), LEAF), []
    for i in range(0, len(queries), QUERY_BLOCK):
        q = queries.iloc[i : i + QUERY_BLOCK]
        own = q.vec_id.to_numpy()
        s = Search(tree, ids, vectors, unpack(q.vector), own, q.bound.to_numpy(), longest, k, factor)
        row, col = np.nonzero(s.best >= 0)
        parts.append(pd.DataFrame({"query_id": own[row], "vec_id": ids[s.best[row, col]], "score": s.score[row, col]}))
    return pd.concat(parts, ignore_index=True)


def op3(vectors: DataFrame, every: int = 20, k: int = 20, factor: float = FACTOR, save=lambda df: df, shard_rows: int = SHARD_ROWS) -> DataFrame:
    spark = vectors.sparkSession
    found = "query_id bigint, vec_id bigint, score double"
    clean = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    clean = clean.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    size = clean.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    if size is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    clean = clean.where(F.size("v") == size.n)
    longest = math.sqrt(clean.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0])
    sample = np.array([r.v for r in clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()])
    shards = min(MOST_SHARDS, max(1, -(-size.rows // shard_rows)))
    route = Tree(lifted(sample, longest, False), max(1, len(sample) // shards), max(0, (shards - 1).bit_length())).root
    def deal(batches):
        names = {id(x): i for i, x in enumerate(leaves(route))}
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).to_pylist(), np.float64)
                own, q = home(route, lifted(x, longest, False), names), home(route, lifted(x, longest, True), names)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(own), pa.array(q)], ["vec_id", "vector", "shard", "home"])

    dealt = save(clean.mapInArrow(deal, "vec_id bigint, vector binary, shard int, home int"))
    held = {r.shard: r["count"] for r in dealt.groupBy("shard").count().collect()}  # a row for each of at most MOST_SHARDS shards
    subs = F.array(*[F.lit(max(1, -(-held.get(i, 0) // MOST_ROWS))) for i in range(len(leaves(route)))])[F.col("shard")]
    rows = dealt.select("shard", F.pmod(F.xxhash64("vec_id"), subs).cast("int").alias("sub"), "vec_id", "vector")
    asked = dealt.where(F.col("vec_id") % every == 0)
    each = F.explode(F.sequence(F.lit(0), subs - 1)).alias("sub")

    def search(q: DataFrame) -> DataFrame:
        left, right = rows.groupBy("shard", "sub"), q.groupBy("shard", "sub")
        return left.cogroup(right).applyInPandas(lambda r, x: searched(r, x, k, factor, longest), found)

    first = save(search(asked.select(F.col("home").alias("shard"), each, "vec_id", "vector", F.lit(float("inf")).alias("bound"))))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    known = first.withColumn("rank", F.row_number().over(best))

    def spread(batches):
        names = {id(x): i for i, x in enumerate(leaves(route))}
        for batch in batches:
            if batch.num_rows:
                x, at = unpack(batch.column(1).to_pylist()), batch.column(2).to_numpy()
                score = batch.column(3).to_numpy(zero_copy_only=False).astype(float)
                unit = lifted(x, longest, True)
                reach = reach_of(score, np.sqrt((x * x).sum(1)) * longest)
                for mine, shard in reached(route, unit, reach, factor, names):
                    mine = mine[at[mine] != shard]
                    if len(mine):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), shard, np.int32)), batch.column(0).take(pa.array(mine)), batch.column(1).take(pa.array(mine)), pa.array(reach[mine])], ["shard", "vec_id", "vector", "bound"])

    last = known.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth")).dropDuplicates(["vec_id"])
    second = asked.join(last, "vec_id", "left").select("vec_id", "vector", "home", "kth").mapInArrow(spread, "shard int, vec_id bigint, vector binary, bound double")
    others = search(second.select("shard", each, "vec_id", "vector", "bound"))
    ranked = first.union(others).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
