import hashlib
import math

import numpy as np
import pytest
from helpers import AWKWARD, corpus, table

from stratavane.llm import digest


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


def slow_code(text):
    """Quartile of each bucket's count, and the length step, one triplet at a time."""
    counts = [0] * 256
    for at in range(len(text)):
        for (i, j, k), (a, b, c) in zip(((0, 2, 4), (0, 1, 4), (0, 3, 4)), digest._MULT.tolist()):
            if at + k < len(text):
                counts[(text[at + i] * a + text[at + j] * b + text[at + k] * c) % 2**32 >> 24] += 1
    cuts = [sorted(counts)[n] for n in (63, 127, 191)]
    return [sum(c > x for x in cuts) for c in counts], min(255, math.floor(8 * math.log2(len(text) + 1)))


def slow_text(code):
    return bytes([code[1], *(sum(code[0][4 * i + j] << 2 * j for j in range(4)) for i in range(64))]).hex()


def slow_likeness(a, b):
    score = sum((0, 1, 3, 6)[abs(x - y)] for x, y in zip(a[0], b[0])) + abs(a[1] - b[1])
    return 1.0 - min(score, 384) / 384


@pytest.mark.parametrize("block_bytes", [2000, digest.BLOCK_BYTES])
def test_edited_texts(spark, block_bytes):
    rows = in_order(corpus(9, 50) + AWKWARD)
    got = digest.edited_likeness(table(spark, rows).repartition(3), block_bytes).collect()
    want = []
    for (i, t, _), (_, n, _) in zip(rows, rows[1:] + rows[:1]):
        t, n = t or "", n or ""
        m = len(t) // 4
        e = t[: len(t) - m] + n[:m]
        a, b, c = (slow_code(x.encode()) for x in (t, e, n))
        want.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), slow_text(a), slow_text(b), slow_likeness(a, b), slow_likeness(a, c)))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in got) == sorted(want)
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        a, b = digest.from_text_form(r["fingerprint"]), digest.from_text_form(r["edited_fingerprint"])
        assert r["near_edited"] == pytest.approx(float(digest.likeness(a[None], b[None])[0]))


@pytest.mark.parametrize("rows", [[], [(4, "alone in its table", "a")], [(None, None, None)]])
def test_tiny_tables(spark, rows):
    got = digest.edited_likeness(table(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["near_next"] == 1.0 for r in got)


def test_counts_are_those_of_each_text():
    texts = [b"", b"ab", b"abc", b"hello world " * 20, "é漢字".encode() * 9]
    together = digest.codes(texts)
    for t, code in zip(texts, together):
        assert np.array_equal(digest.codes([t])[0], code)


def test_near_texts_are_nearer(spark):
    rows = [(i, t, "a") for i, (_, t, _) in enumerate(r for r in corpus(10, 60) if len(r[1]) > 600)]
    got = digest.edited_likeness(table(spark, rows)).collect()
    assert np.mean([r["near_edited"] for r in got]) > np.mean([r["near_next"] for r in got])


def test_fingerprints_of_equal_texts(spark):
    got = {r["doc_id"]: r["fingerprint"] for r in digest.fingerprints(table(spark, [(1, "same", "a"), (2, "same", "b"), (3, None, "c"), (4, "", "c")])).collect()}
    assert got[1] == got[2] and got[3] == got[4] and got[1] != got[3]
