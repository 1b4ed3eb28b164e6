import collections
import random
import re

import numpy as np
import pytest
from helpers import AWKWARD, corpus, table, words

from stratavane.llm import components, neardup


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, threshold=85):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    up = {i: i for i, _ in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and a and 100 * len(a & b) >= threshold * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sorted(((i, len(s), root(i) if i is not None else None, i is None or root(i) == i) for i, s in sets), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_all_pairs(spark):
    rows = corpus(4, 120) + AWKWARD
    assert got(neardup.near_duplicates(table(spark, rows).repartition(3))) == brute(rows)


def test_a_large_group_whose_members_differ_from_their_hub(spark):
    rng = random.Random(2)
    base = words(rng, 200).split(" ")
    rows = []
    for i in range(80):
        own = list(base)
        for _ in range(rng.randrange(1, 5)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(own), "a"))
    assert got(neardup.near_duplicates(table(spark, rows))) == brute(rows)


def in_one_bucket(spark, sets):
    member = spark.createDataFrame([(1, node, len(sets)) for node in sets], "bucket long, node long, size long")
    return member, spark.createDataFrame([(node, bytearray(s.tobytes())) for node, s in sets.items()], "node long, shingles binary")


def test_links_between_a_copy_of_the_hub_and_what_is_just_not_similar_to_it(spark):
    rng = np.random.default_rng(4)
    hub = np.unique(rng.integers(0, 2**63, 1000, dtype=np.uint64))
    sets = {10**6: hub}
    for k in range(30):  # the second of each pair lacks what the first lacks and more, and is similar to it alone
        gone = rng.permutation(len(hub))[:151]
        sets[2 * k], sets[2 * k + 1] = np.delete(hub, gone[:5]), np.delete(hub, gone)
    found = neardup.links(*in_one_bucket(spark, sets))
    linked = {frozenset((r["u"], r["v"])) for r in found.collect()}
    assert all({2 * k, 2 * k + 1} in linked for k in range(30))


def test_members_that_share_edits_without_being_similar_are_not_compared_with_each_other(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    variants = rng.integers(0, 2**63, (400, 4), dtype=np.uint64)
    sets = {}
    for node in range(300):  # 50 elements of its own and some edits that others have too
        own, places = base.copy(), rng.permutation(400)
        own[places[:50]] = rng.integers(0, 2**63, 50, dtype=np.uint64)
        own[places[50:60]] = variants[places[50:60], rng.integers(0, 4, 10)]
        sets[node] = np.unique(own)
    compared, compare = [], neardup.compare

    def counting(pairs, *args):
        compared.append(pairs.count())
        return compare(pairs, *args)

    monkeypatch.setattr(neardup, "compare", counting)
    assert neardup.links(*in_one_bucket(spark, sets)).filter("u <> v").count() == 0
    assert sum(compared) < 5 * len(sets)


def test_one_id_for_two_texts_ties_their_groups(spark):
    rng = random.Random(3)
    a, b = words(rng, 50), words(rng, 50)
    rows = [(5, a, "x"), (6, a, "x"), (6, b, "x"), (7, b, "x")]
    assert {r["component_id"] for r in neardup.near_duplicates(table(spark, rows)).collect()} == {5}


def test_empty_table(spark):
    assert neardup.near_duplicates(table(spark, [])).collect() == []


def test_dropping_keeps_columns_and_one_of_each_group(spark):
    rows = [(1, "a b c d e f", "s"), (2, "A b c d e f", "s"), (3, "other words here", "s"), (4, None, "s")]
    out = neardup.drop_near_duplicates(table(spark, rows))
    assert out.columns == table(spark, rows).columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4]


def test_estimates_are_unbiased():
    import numpy as np

    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        every = rng.integers(0, 2**63, 300, dtype=np.uint64)
        a, b = np.unique(every[:200]), np.unique(every[100:])
        errors.append((neardup.signature(a) == neardup.signature(b)).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


@pytest.mark.parametrize("few", [components.FEW, 0])
def test_components(spark, few):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)]
    up = collections.defaultdict(lambda: None)
    groups = {}
    for u, v in edges:
        if u != v:
            a, b = groups.get(u, {u}), groups.get(v, {v})
            both = a | b
            for x in both:
                groups[x] = both
    want = {x: min(g) for x, g in groups.items()}
    found = components.connected_components(spark.createDataFrame(edges, "u long, v long"), few=few)
    assert {r["node"]: r["component"] for r in found.collect()} == want and up is not None
