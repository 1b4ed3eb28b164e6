"""Exact search for the largest inner products by ball trees.

Vectors are dealt by hash into shards of about ``SHARD_ROWS``. A shard is a ball tree: each node has a centre and a radius,
and no vector in it has a larger inner product with a query than the centre's plus radius times the query's norm. A query is
searched first in one shard; the k-th score found there goes with it to the other shards, where nodes bounded below it are
left out. Within a shard nodes go down level by level, leaves are visited in the order of their bounds, and the k-th score
rises as they are. Queries go in blocks of ``BLOCK_QUERIES``, so that no task holds more than a shard and a block.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors of different lengths have
no inner product and are not compared; a query is not compared with rows of its own vec_id; equal query rows are asked once;
with fewer candidates than k all are returned; null vec_ids take no part; an empty table gives no rows; other columns are
left out. Sums up to 2^53 are exact."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 32_768
BLOCK_QUERIES = 4_096
LEAF = 128
EVERY = 50


class BallTree:
    """Levels of nodes over rows in tree order; node i of a level has children 2i and 2i + 1 below."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        n = len(vectors)
        self.depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf)))) if n > leaf else 0
        order, cuts = np.arange(n), np.array([0, n])
        for _ in range(self.depth):
            new = [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = order[a:b]
                mid = (b - a) // 2
                if b - a > 1:
                    v = vectors[part]
                    one = v[np.argmax(((v - v.mean(axis=0)) ** 2).sum(axis=1))]
                    two = v[np.argmax(((v - one) ** 2).sum(axis=1))]
                    order[a:b] = part[np.argpartition(v @ (two - one), mid)] if mid else part
                new += [a + mid, b]
            cuts = np.array(new)
        self.order, self.cuts = order, cuts
        self.levels = []
        for level in range(self.depth + 1):
            edges = cuts[:: 1 << (self.depth - level)]
            centre, radius = np.zeros((len(edges) - 1, vectors.shape[1])), np.full(len(edges) - 1, -1.0)
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                if b > a:
                    v = vectors[order[a:b]]
                    centre[i] = v.mean(axis=0)
                    radius[i] = np.sqrt(((v - centre[i]) ** 2).sum(axis=1).max())
            self.levels.append((centre, radius))

    def bounds(self, queries: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Upper bounds of each query in each leaf; minus infinity where a node above is bounded below ``floor``."""
        norm = np.sqrt((queries**2).sum(axis=1))
        alive = None
        for centre, radius in self.levels:
            bound = queries @ centre.T + norm[:, None] * radius[None, :]
            bound += 1e-9 * np.abs(bound) + 1e-6
            bound[:, radius < 0] = -np.inf
            if alive is not None:
                bound[~np.repeat(alive, 2, axis=1)] = -np.inf
            bound[bound < floor[:, None]] = -np.inf
            alive = bound > -np.inf
        return bound


def search(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of the k best of each query among scores of at least ``floor``; ties to the smaller id."""
    tree = BallTree(vectors)
    bound = tree.bounds(queries, floor)
    visit = np.argsort(-bound, axis=1, kind="stable")
    kth = floor.astype(float).copy()
    q, i, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for step in range(bound.shape[1]):
        leaf = visit[:, step]
        worth = np.flatnonzero((bound[np.arange(len(queries)), leaf] >= kth) & (bound[np.arange(len(queries)), leaf] > -np.inf))
        if not len(worth):
            break
        found = [(q, i, s)]
        for which in np.unique(leaf[worth]):
            asking = worth[leaf[worth] == which]
            rows = tree.order[tree.cuts[which] : tree.cuts[which + 1]]
            score = queries[asking] @ vectors[rows].T
            good = (score >= kth[asking][:, None]) & (ids[rows][None, :] != own[asking][:, None])
            a, b = np.nonzero(good)
            found.append((asking[a], ids[rows[b]], score[a, b]))
        q, i, s = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        first = np.searchsorted(q, q)
        rank = np.arange(len(q)) - first
        last = rank == k - 1
        kth[q[last]] = np.maximum(kth[q[last]], s[last])
        q, i, s = q[rank < k], i[rank < k], s[rank < k]
    return q, i, s


def _matrix(column) -> np.ndarray:
    flat = np.asarray(column.combine_chunks().flatten() if hasattr(column, "combine_chunks") else column.flatten()).astype(np.float64)
    return flat.reshape(len(column), -1)


RESULT = "query_id long, vec_id long, score long"


def _ask(shards: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``shards``: shard, dim, vec_id, v; ``asked``: shard, dim, block, query_id, floor, v."""

    def answer(left, right):
        import pyarrow as pa

        empty = [pa.array([], pa.int64())] * 3
        if not left.num_rows or not right.num_rows:
            return pa.table(empty, names=["query_id", "vec_id", "score"])
        own = np.asarray(right["query_id"])
        q, i, s = search(_matrix(left["v"]), np.asarray(left["vec_id"]), _matrix(right["v"]), own, np.asarray(right["floor"]), k)
        return pa.table([pa.array(own[q]), pa.array(i), pa.array(s.astype(np.int64))], names=["query_id", "vec_id", "score"])

    keys = ["shard", "dim", "block"]
    blocks = asked.select(*keys).distinct()
    spread = shards.join(blocks, ["shard", "dim"]).select(*keys, "vec_id", "v")
    own = asked.select(*[F.col(c).alias(c) for c in (*keys, "query_id", "floor", "v")])  # columns apart from those of ``spread``
    return spread.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInArrow(answer, RESULT)


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score; both inputs have vec_id and v (arrays of whole doubles, none null)."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.size("v").alias("dim"))
    queries = queries.select(F.col("vec_id").cast("long").alias("query_id"), "v", F.size("v").alias("dim")).distinct()
    shards, blocks = max(1, -(-vectors.count() // shard_rows)), max(1, -(-queries.count() // block_queries))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("home", F.pmod(F.xxhash64("query_id", F.lit(2)), F.lit(shards)).cast("int"))
    low = F.lit(float("-inf"))
    first = _ask(dealt, asked.select(F.col("home").alias("shard"), "dim", "block", "query_id", low.alias("floor"), "v"), k)
    if shards > 1:
        kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(low).alias("floor"))
        known = asked.join(kth, "query_id", "left").withColumn("floor", F.coalesce("floor", low))
        rest = known.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard <> home")
        first = first.unionByName(_ask(dealt, rest.select("shard", "dim", "block", "query_id", "floor", "v"), k))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")  # at most k rows a shard
    return first.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame, by: int = 256) -> DataFrame:
    """vec_id and v: floor(by * x) of every component, for the vectors that take part."""
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.filter(usable).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * by).cast("double")).alias("v"))


def search_table(embeddings: DataFrame, k: int = 5, every: int = EVERY, **sizes) -> DataFrame:
    """The k best of every row whose vec_id is divisible by ``every`` among all other rows."""
    v = quantised(embeddings)
    return top_inner_products(v, v.filter(F.col("vec_id") % every == 0), k, **sizes)
