import random
import zlib

import numpy as np
import pytest
from helpers import AWKWARD, corpus, table

from stratavane.llm import packing
from stratavane.llm.tokens import encoder, vocabulary

NAME = "byte_bpe_50k.json"


def test_pieces_and_places(spark):
    rows = corpus(5, 40) + AWKWARD
    got = packing.pack_documents(table(spark, rows), shard_items=16).collect()
    enc = encoder(vocabulary(NAME))
    want = []
    for i, t, *_ in rows:
        ids = [*enc.tok.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_table(spark):
    assert packing.pack_documents(table(spark, [])).collect() == []


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_constraint_holds(rule):
    rng = np.random.default_rng(3)
    length = rng.integers(1, 100, 500)
    demands = np.stack([length, np.ones_like(length), length**2], axis=1)
    capacities = np.array([100, 4, 6000])
    demands = demands[demands[:, 2] <= 6000]
    bins = packing.best_fit(demands, capacities, np.array([1.0, 0.1, 0.1]), rule)
    for b in np.unique(bins):
        assert (demands[bins == b].sum(axis=0) <= capacities).all()
    assert sorted(np.unique(bins)) == list(range(bins.max() + 1))


def test_few_bins():
    rng = random.Random(1)
    length = np.array([rng.randrange(1, 2048) for _ in range(3000)])
    demands = np.stack([length, np.ones_like(length), length**2], axis=1)
    bins = packing.best_fit(demands, np.array([2048, 2048, 2048**2]), np.array([1.0, 0.05, 0.05]))
    assert bins.max() + 1 <= 1.03 * -(-length.sum() // 2048)


def test_items_over_the_capacity():
    with pytest.raises(ValueError, match="exceeds"):
        packing.best_fit(np.array([[5, 1, 25]]), np.array([4, 1, 25]), np.ones(3))
