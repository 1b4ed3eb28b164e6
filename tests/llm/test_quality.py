import random
import zlib

import numpy as np
import pytest
from helpers import AWKWARD, corpus, table, words

from stratavane.llm import quality


def marked(n=240):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.6
        text = words(rng, rng.randrange(5, 80))
        rows.append((i, text if good else " ".join(w + rng.choice(["***", "$$$"]) for w in text.split(" ")), "a"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = marked()
    marks = spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(table(spark, rows + AWKWARD).repartition(3), marks).collect()
    assert len(got) == len(rows) + len(AWKWARD)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r["doc_id"] in truth and r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_no_labels_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.classify(table(spark, AWKWARD), none).collect()} == {0.5}
    assert quality.classify(table(spark, []), none).collect() == []


def test_rejected_documents_go(spark):
    rows, labels = marked()
    kept = quality.keep_good(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == table(spark, rows).columns
    ids = {r["doc_id"] for r in kept.collect()}
    truth = {i: q for i, q, _ in labels}
    assert sum(truth[i] for i in ids) / len(ids) > 0.97 and len(ids) > 0.95 * sum(truth.values())


def test_a_text_scores_the_same_alone():
    texts = [b"", b"One two two THREE!!", b"x", b"a b c d"]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    rows = quality.sparse_rows(data, off)
    for t, (where, value) in zip(texts, rows):
        own = quality.sparse_rows(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]
        assert np.array_equal(own[0], where) and np.allclose(own[1], value)


def test_updates_against_plain_loops():
    import math

    rng = np.random.default_rng(4)
    rows = [(np.sort(rng.choice(50, 8, replace=False)), rng.random(8)) for _ in range(40)]
    labels = rng.integers(0, 2, 40).astype(float)
    z, n, bias = {}, {}, 1 << quality.BITS
    alpha, beta, l1, l2 = 1.0, 1.0, 0.02, 0.1

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(3):
        for (where, value), label in zip(rows, labels):
            x = {**dict(zip(where.tolist(), value.tolist())), bias: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * w[i]
                n[i] = before + g * g
    got = quality.fit_ftrl(rows, labels, 3)
    assert np.allclose(got[sorted(z)], [weight(i) for i in sorted(z)], atol=1e-5) and not np.delete(got, sorted(z)).any()


def test_a_score_is_the_sparse_dot_product_of_its_features(spark):
    rng = np.random.default_rng(5)
    weights = rng.normal(0, 0.3, (1 << quality.BITS) + 1).astype(np.float32)
    rows = corpus(5, 30) + AWKWARD
    got = {(r["doc_id"], r["text"]): r["score"] for r in quality.score(table(spark, rows), weights, ("doc_id", "text")).collect()}
    for i, t, _ in rows:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        (where, value), = quality.sparse_rows(raw, np.array([0, len(raw)]))
        assert got[i, t] == pytest.approx(1 / (1 + np.exp(-(weights[where].astype(float) @ value + weights[-1]))), rel=1e-6)


def test_many_documents_of_one_labelled_id(spark):
    rows = [(1, f"good words here {i}", "a") for i in range(300)] + [(2, "$$ ## !!", "a"), (3, "fine words there", "a")]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in quality.classify(table(spark, rows), labels, folds=10**9, held=-1, sample_rows=50).collect()}
    assert set(got) == {1, 2, 3} and got[1] == 1
