"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Words are runs of letters, of digits and of other signs; letters are taken in lower case, and each word also has a shape
(its signs themselves; lower, capital or upper case; digits by number). Features are words, pairs of words and triplets of
shapes, hashed into 2^18 weights; a feature's value is its share of the text's words, so a score is a sparse dot product.

The model is fitted on at most ``sample_rows`` labelled rows, the first by a hash of doc_id; every row is scored. Only the
weights (1 MB) pass the driver. Defined results: null and empty texts get the score of the bias; null labels are not
learned from; of several documents of one labelled doc_id each is a row; with no labelled row every score is 0.5; equal rows get
equal scores; texts of any length are read whole; other columns have no part in a score, and ``keep_good`` keeps them, also where
they are named as its own are; an empty table gives no rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, _MULT, batches_of_text, hash_ranges, mix64, unused

BITS = 18
SAMPLE_ROWS = 10_000
EPOCHS = 3
_SCALE = 16.0
_KIND = np.full(256, 3, np.uint8)  # 0 space, 1 letter, 2 digit, 3 other sign
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[48:58] = 2
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight numbers, text numbers and values of all features of the texts at ``offsets`` in ``data``."""
    n_texts = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    kind = _KIND[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    is_word = kind[starts] != 0
    starts, ends = starts[is_word], ends[is_word]
    text = np.searchsorted(offsets, starts, side="right") - 1
    low = _LOWER[data]
    with np.errstate(over="ignore"):
        word = hash_ranges(low, starts, ends)
        upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
        k, capitals, size = kind[starts], upper[ends] - upper[starts], ends - starts
        case = np.where(capitals == 0, 0, np.where((capitals == size) & (size > 1), 2, np.where(capitals == 1, 1, 3)))
        shape = np.where(k == 3, word, np.where(k == 2, 100 + np.minimum(size, 12), 10 + case).astype(np.uint64) * _MULT)
        pair = mix64(word[:-1] * np.uint64(3) + word[1:])
        pair[word[:-1] == word[1:]] = _MULT  # a word said twice is one feature, whatever the word
        triplet = mix64(shape[:-2] * np.uint64(25) + shape[1:-1] * np.uint64(5) + shape[2:] + np.uint64(77))
    shift = np.uint64(64 - BITS)
    pair_in, triplet_in = text[:-1] == text[1:], text[:-2] == text[2:]
    where = np.concatenate([word >> shift, (pair >> shift)[pair_in], (triplet >> shift)[triplet_in]]).astype(np.int64)
    of = np.concatenate([text, text[:-1][pair_in], text[:-2][triplet_in]])
    per = _SCALE / np.maximum(np.bincount(text, minlength=n_texts), 1)
    return where, of, per[of]


def sparse_rows(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    where, of, value = features(data, offsets)
    key, inverse = np.unique(of * (1 << BITS) + where, return_inverse=True)
    total = np.bincount(inverse, weights=value, minlength=len(key))
    cut = np.searchsorted(key, np.arange(len(offsets)) << BITS)
    return [(key[a:b] & ((1 << BITS) - 1), total[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """Weights, the bias last, after ``epochs`` passes of follow-the-regularised-leader updates over the rows."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        for (where, value), label in zip(rows, labels):
            i, x = np.append(where, size - 1), np.append(value, 1.0)
            zi, root = z[i], np.sqrt(n[i])
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + root) / alpha + l2))
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -35, 35)))
            g = (p - label) * x
            step = (np.sqrt(n[i] + g * g) - root) / alpha
            z[i] += g - step * w
            n[i] += g * g
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2)).astype(np.float32)


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of doc_id as text, modulo ``of``."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(of))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights learned from at most ``sample_rows`` rows of ``labels`` (doc_id and ``label``, 0 or 1)."""
    usable = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("_label"))
    sample = usable.orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample_rows)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "_label", "text")

    def vectors(batches):
        import pyarrow as pa

        for batch in batches:
            for i, j, data, off in batches_of_text(batch.column(2)):
                got = sparse_rows(data, off)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).cast(pa.int64()), batch.column(1).slice(i, j - i), pa.array([a.astype("<i4").tobytes() for a, _ in got]), pa.array([b.astype("<f4").tobytes() for _, b in got])],
                    names=["doc_id", "label", "at", "value"],
                )

    def fit(batches):
        import pyarrow as pa

        table = pa.Table.from_batches(list(batches), schema=pa.schema([("doc_id", pa.int64()), ("label", pa.float64()), ("at", pa.binary()), ("value", pa.binary())]))
        ids, labels = np.asarray(table["doc_id"]), np.asarray(table["label"])
        order = np.lexsort((labels, (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)))
        at, value = table["at"].to_pylist(), table["value"].to_pylist()
        got = [(np.frombuffer(at[i], "<i4"), np.frombuffer(value[i], "<f4").astype(float)) for i in order]
        yield pa.RecordBatch.from_arrays([pa.array([fit_ftrl(got, labels[order]).tobytes()], pa.binary())], names=["weights"])

    sparse = rows.mapInArrow(vectors, "doc_id long, label double, at binary, value binary")
    # one task, of at most ``sample_rows`` rows, also where documents share a labelled doc_id
    few = sparse.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "at", "value").limit(sample_rows)
    got = few.mapInArrow(fit, "weights binary").collect()
    return np.frombuffer(got[0]["weights"], np.float32) if got else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, keep: tuple[str, ...] = ("doc_id",), into: str = "score") -> DataFrame:
    """The columns ``keep`` of every row and its score in ``into``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 1 MB whatever the input
    k = len(keep)

    def scores(batches):
        import pyarrow as pa

        w = shared.value.astype(np.float64)
        for batch in batches:
            for i, j, data, off in batches_of_text(batch.column(k)):
                where, of, value = features(data, off)
                total = np.bincount(of, weights=w[where] * value, minlength=j - i) + w[-1]
                p = 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(k)), pa.array(p)], names=[*keep, into])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", `{into}` double"
    return docs.select(*keep, F.col("text").cast("string").alias(unused(list(keep), "text"))).mapInArrow(scores, schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; labels of the held-out fold are not learned from."""
    weights = train(docs, labels.filter(fold(F.col("doc_id"), folds) != held), sample_rows=sample_rows)
    got = score(docs, weights)
    out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    return got.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows, all columns, that the classifier does not reject; fitted on all labelled rows' sample."""
    weights = train(docs, labels, sample_rows=sample_rows)
    names = docs.columns
    into = unused(names, "score")
    return score(docs, weights, tuple(names), into).filter(F.col(into) >= 0.5).select(*names)
