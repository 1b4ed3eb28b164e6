import hashlib
import random

import numpy as np
import pytest
from helpers import AWKWARD, corpus, table

from stratavane.llm import repeats


def brute(rows):
    seen, order = {}, sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    out = []
    for i, t, *_ in [*order, *(r for r in rows if r[0] is None)]:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if i is not None and seen.get(b[s : s + 50], i) < i:
                gone[s : s + 50] = b"\1" * 50
        if i is not None:
            for s in range(len(b) - 49):
                seen[b[s : s + 50]] = min(i, seen.get(b[s : s + 50], i))
        spans = sum(gone[k] and (not k or not gone[k - 1]) for k in range(len(b)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_against_all_windows(spark, hot):
    rows = corpus(3) + AWKWARD
    got = repeats.repeats(table(spark, rows).repartition(5), hot)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert repeats.repeats(table(spark, [])).collect() == []


def test_strip_keeps_columns_rows_and_characters(spark):
    line = "é" * 30 + " a passage that two documents hold, word for word "
    rows = [(1, line + "first", "a"), (2, "second " + line, "b"), (None, line, None), (3, None, "c")]
    got = repeats.strip(table(spark, rows))
    assert got.columns == table(spark, rows).columns
    found = {r["doc_id"]: r for r in got.collect()}
    assert found[1]["text"] == line + "first" and found[2]["text"] == "second " and found[None]["text"] == line
    assert found[3]["text"] is None and found[2]["n_chars"] == 7


def test_maximal_repeats_against_all_pairs():
    rng = random.Random(5)
    for _ in range(30):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 6))]
        least = 7
        want = set()
        subs = {}
        for n, t in enumerate(texts):
            for s in range(len(t)):
                for e in range(s + least, len(t) + 1):
                    subs.setdefault(t[s:e], []).append((n, s))
        for sub, at in subs.items():
            if len(at) < 2:
                continue
            left = {texts[n][s - 1] if s else (n, "start") for n, s in at}
            right = {texts[n][s + len(sub)] if s + len(sub) < len(texts[n]) else (n, "end") for n, s in at}
            if len(left) > 1 and len(right) > 1:
                want.add((len(sub), tuple(sorted(at))))
        got = {(size, tuple(at)) for size, at in repeats.maximal_repeats(texts, least)}
        assert got == want


def test_contexts_cover_every_window():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    off = np.array([0, 10, 59, 60, 1500, 3000])
    _, _, start, count = repeats.contexts(data, off)
    windows = sorted(s + k for s, c in zip(start.tolist(), count.tolist()) for k in range(c))
    assert windows == [s for a, b in zip(off[:-1], off[1:]) for s in range(a, b - 49)]
