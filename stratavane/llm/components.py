"""Connected components of an edge table: by alternating large and small stars, each round written to the shared folder, or
in one executor task where the edges are few."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


#: Edges up to which one task joins them; the result is the same either way.
FEW = 1_000_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    def union(batches):
        import pyarrow as pa

        up: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (y := up.setdefault(top, top)) != top:
                top = y
            while up[x] != top:
                up[x], x = top, up[x]
            return top

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(u), root(v)
                up[max(a, b)] = min(a, b)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(union, "node long, component long")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())


def connected_components(edges: DataFrame, most_rounds: int = 100, few: int = FEW) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v long): component is the smallest node reachable."""
    edges = edges.filter("u <> v").select("u", "v")
    if edges.count() <= few:
        return _in_one_task(edges)
    now = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    state = _state(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = materialise(small.filter("u <> v").distinct(), "cc")
        before, state = state, _state(now)
        if state == before:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    if state[0]:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
