import math
import random

import numpy as np
import pytest

from stratavane.llm import topk


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in ok:
        if q % 50 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))
            out |= {(q, r + 1, i, -v) for r, (v, i) in enumerate(s[:k])}
    return out


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 60, "block_queries": 2}])
def test_against_all_products(spark, sizes):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(i, rows[i % 7][1]) for i in range(300, 360)]  # ties
    rows += [(1000, None), (1050, [1.0, None]), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (None, [1.0] * 8), (1200, []), (1250, [1.0, 2.0]), (1251, [3.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 7) for i, v in rows], "vec_id long, embedding array<float>, label string, dim int")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search_table(df, **sizes).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_empty_table(spark):
    assert topk.search_table(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(1000, 6)), rng.normal(size=(20, 6))
    tree = topk.BallTree(v, 32)
    bound = tree.bounds(q, np.full(20, -np.inf))
    for leaf in range(bound.shape[1]):
        rows = tree.order[tree.cuts[leaf] : tree.cuts[leaf + 1]]
        assert ((q @ v[rows].T).max(axis=1) <= bound[:, leaf]).all()
    assert sorted(tree.order) == list(range(1000))
