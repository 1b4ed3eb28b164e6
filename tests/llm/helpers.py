"""Small document tables with every awkward row."""

import random

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, places string, key long, block int, size long, h long"


def table(spark, rows):
    """rows: (doc_id, text, source); with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 0.5, "p", 1, 2, 3, None) for i, t, s in rows], EXTRA)


def words(rng, n, vocabulary=400):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    rows, passage = [], words(rng, 30)
    texts = []
    for i in range(n):
        kind = rng.randrange(6)
        if kind == 0 and texts:
            t = rng.choice(texts)
        elif kind == 1 and texts:
            own = rng.choice(texts).split(" ")
            for _ in range(max(1, len(own) // 60)):
                own[rng.randrange(len(own))] = "Edit"
            t = " ".join(own)
        elif kind == 2:
            t = words(rng, 20) + passage + words(rng, rng.randrange(1, 30))
        else:
            t = words(rng, rng.randrange(1, 200))
        texts.append(t)
        rows.append((3 * i - 7, t, f"s{rng.randrange(4)}"))
    return rows


AWKWARD = [
    (1000, None, "a"),
    (1001, "", "a"),
    (1002, " \t\n ", None),
    (1003, "one", None),
    (1004, "One", "b"),
    (1005, "ééé ñ 漢字 \U0001f600 Tail" * 3, "b"),
    (1006, "x" * 40_000 + " y" * 3000, "c"),
    (1007, "same row", "c"),
    (1007, "same row", "c"),
    (1008, "null\0byte and \x1c separators \x85 here\xa0too", "a"),
    (None, "without an id, and long enough to hold a window of fifty bytes for sure", "a"),
    (None, None, None),
]
