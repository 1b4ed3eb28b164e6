import random
import re

import pytest
from helpers import AWKWARD, corpus, table

from stratavane.llm import mixing


def water_level(sizes, weights, times):
    target, free, rest = {}, dict(weights), sum(sizes.values())
    while free:
        level = rest / sum(free.values())
        full = [s for s in free if level * free[s] >= times * sizes[s]]
        if not full:
            return target | {s: level * w for s, w in free.items()}
        for s in full:
            target[s] = times * sizes[s]
            rest -= target[s]
            del free[s]
    return target


def check(spark, rows, block_words):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = water_level(sizes, {s: float(k % 3 + 1) for k, s in enumerate(order)}, 3)
    source = {}
    for i, t, s in rows:
        source.setdefault((i, size(t)), set()).add(s)
    got = mixing.mix(table(spark, rows).repartition(3), block_words=block_words).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), size(t)) for i, t, _ in rows)
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        s = next(x for x in source[r["doc_id"], r["size"]] if sizes[x] == r["source_size"])
        assert r["target"] == pytest.approx(target[s])
        taken[s] = taken.get(s, 0) + r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 1
    again = mixing.mix(table(spark, rows), block_words=block_words).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


@pytest.mark.parametrize("block_words", [4, 512])
def test_targets_and_takes(spark, block_words):
    check(spark, corpus(8, 60) + AWKWARD, block_words)


def test_a_small_source_is_taken_three_times(spark):
    rng = random.Random(1)
    check(spark, [(0, "tiny source", "a"), (1, "x " * 5, "z")] + [(i, "w " * rng.randrange(50), "m") for i in range(2, 40)], 8)


@pytest.mark.parametrize("rows", [[], [(1, None, "a")], [(1, "", None), (2, " ", "b")]])
def test_no_words(spark, rows):
    assert sorted((r["doc_id"], r["taken"], r["target"]) for r in mixing.mix(table(spark, rows)).collect()) == [(i, 0, 0.0) for i, *_ in rows]


def test_the_schedule_interleaves_sources(spark):
    plan = spark.createDataFrame([(0, 10), (1, 30), (2, 60)], "sid long, slots long")
    got = sorted((r["position"], r["sid"], r["rank"]) for r in mixing.schedule(plan, 8).collect())
    for sid, n in ((0, 10), (1, 30), (2, 60)):
        assert [r for _, s, r in got if s == sid] == list(range(n))
    for k in range(10, 101, 10):
        assert abs(sum(s == 2 for _, s, _ in got[:k]) - 0.6 * k) <= 3


def test_resample(spark):
    rows = [(i, "w " * 50, "a" if i < 5 else "b") for i in range(30)] + [(99, None, "b")]
    out = mixing.resample(table(spark, rows), block_words=10)
    assert out.columns == table(spark, rows).columns
    counts = {}
    for r in out.collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert max(counts.values()) <= 3 and sum(n for i, n in counts.items() if i < 5) >= 9


def test_rows_without_an_id_leave_as_often_as_the_mix_takes_them(spark):
    rows = [(i, "w " * 50, "a" if i < 5 else "b") for i in range(30)] + [(None, "n " * 40, "a"), (None, "n " * 60, None), (None, None, "a"), (None, " ", "b")]
    taken = {r["size"]: r["taken"] for r in mixing.mix(table(spark, rows), block_words=10).collect() if r["doc_id"] is None}
    out = [r["text"] for r in mixing.resample(table(spark, rows), block_words=10).collect() if r["doc_id"] is None]
    assert taken[40] > 0 and taken[60] > 0
    assert {t: out.count(t) for t in set(out)} == {"n " * n: round(taken[n] / n) for n in (40, 60)}


def test_rows_of_one_id_each_leave_as_often_as_the_mix_takes_them(spark):
    rows = [(i, "w " * 50, "a" if i < 5 else "b") for i in range(30)] + [(7, "x " * 50, "a"), (7, "x " * 49, "a"), (7, "y " * 50, "a"), (8, "same " * 50, "a"), (8, "same " * 50, "a")]
    mixed = [r for r in mixing.mix(table(spark, rows), block_words=10).collect() if r["doc_id"] in (7, 8)]
    out = [r["text"] for r in mixing.resample(table(spark, rows), block_words=10).collect() if r["doc_id"] in (7, 8)]
    assert len(out) == sum(round(r["taken"] / r["size"]) for r in mixed) and set(out) > {"x " * 50, "x " * 49, "y " * 50, "same " * 50}
