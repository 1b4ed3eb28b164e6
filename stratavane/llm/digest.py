"""Quartile bucket digests of documents.

The byte triplets of a text, in windows of five bytes, are hashed into 256 buckets; each bucket's count is encoded by the
quartile of the text's own counts that it falls in (two bits), and the length by a logarithmic step (one byte). Digests are
compared by a difference score: per bucket 0, 1, 3 or 6 for quartiles 0 to 3 apart, plus the difference in length steps,
bounded by ``BOUND``; likeness is 1 - score / BOUND.

Defined results: null texts are empty; empty texts and texts under three bytes have the digest of no triplets; equal texts
have equal digests; documents with one doc_id follow each other ordered by text, null doc_ids first; a table of one
document is its own next document; an empty table gives no rows; other columns are left out."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_order, materialise

BUCKETS = 256
BLOCK_BYTES = 16 << 20
#: Score of two texts that have nothing in common but a language; larger differences count as this one.
BOUND = 384
_APART = np.array([0, 1, 3, 6], np.int64)
_KINDS = ((0, 2, 4), (0, 1, 4), (0, 3, 4))
_MULT = np.array([[2654435761, 2246822519, 3266489917], [668265263, 374761393, 2869860233], [3362132053, 1759714725, 2788349879]], np.uint32)


def codes(texts: list[bytes], most: int = 1 << 20) -> np.ndarray:
    """Per text the quartile code of each bucket and, last, its length step."""
    out = np.zeros((len(texts), BUCKETS + 1), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    i = 0
    while i < len(texts):
        j, total = i + 1, sizes[i]
        while j < len(texts) and total + sizes[j] <= most:
            total += sizes[j]
            j += 1
        out[i:j, :BUCKETS] = _quartiles(_counts(texts[i:j], sizes[i:j]))
        i = j
    out[:, BUCKETS] = np.minimum(255, np.floor(8 * np.log2(sizes + 1)))
    return out


def _counts(texts: list[bytes], sizes: np.ndarray) -> np.ndarray:
    data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8).astype(np.uint32)
    n = len(data) - 8
    ends = np.repeat(np.cumsum(sizes), sizes)
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * BUCKETS, sizes)
    here = np.arange(n)
    total = np.zeros(len(texts) * BUCKETS, np.int64)
    for kind, mult in zip(_KINDS, _MULT):
        h = (data[kind[0] : n + kind[0]] * mult[0] + data[kind[1] : n + kind[1]] * mult[1] + data[kind[2] : n + kind[2]] * mult[2]) >> np.uint32(24)
        inside = here + kind[2] < ends
        total += np.bincount((row + h)[inside], minlength=len(total))
    return total.reshape(len(texts), BUCKETS)


def _quartiles(counts: np.ndarray) -> np.ndarray:
    ordered = np.sort(counts, axis=1)
    cut = ordered[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    return (counts[:, :, None] > cut[:, None, :]).sum(axis=2).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = np.abs(a.astype(np.int16) - b.astype(np.int16))
    score = _APART[gap[:, :BUCKETS]].sum(axis=1) + gap[:, BUCKETS]
    return 1.0 - np.minimum(score, BOUND) / BOUND


def text_form(code: np.ndarray) -> list[str]:
    """Hexadecimal digests: length step, then four buckets a byte."""
    q = code[:, :BUCKETS].reshape(len(code), BUCKETS // 4, 4)
    packed = q[:, :, 0] | q[:, :, 1] << 2 | q[:, :, 2] << 4 | q[:, :, 3] << 6
    return [bytes(r).hex() for r in np.concatenate([code[:, BUCKETS:], packed], axis=1)]


def from_text_form(digest: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(digest), np.uint8)
    q = np.stack([raw[1:] & 3, raw[1:] >> 2 & 3, raw[1:] >> 4 & 3, raw[1:] >> 6], axis=1).reshape(-1)
    return np.append(q, raw[0]).astype(np.uint8)


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and a digest of the text of every row."""
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep) + ", fingerprint string"

    def digest(batches):
        import pyarrow as pa

        for batch in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(text_form(codes(raw)), pa.string())], names=[*keep, "fingerprint"])

    return docs.select(*keep, F.col(text).cast("string")).mapInArrow(digest, schema)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_END = "kind int, part int, text string"


def _compared(doc_id: list, text: list[str], after: list[str], code: np.ndarray, code_after: np.ndarray, share: int) -> list:
    """Result columns of documents and their next ones."""
    import pyarrow as pa

    edited = []
    for t, nxt in zip(text, after):
        m = len(t) // share
        edited.append((t[: len(t) - m] + nxt[:m]).encode("utf-8", "surrogatepass"))
    e = codes(edited)
    return [
        pa.array(doc_id, pa.int64()),
        pa.array([len(t) for t in text], pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()),
        pa.array(text_form(code), pa.string()),
        pa.array(text_form(e), pa.string()),
        pa.array(likeness(code, e), pa.float64()),
        pa.array(likeness(code, code_after), pa.float64()),
    ]


def edited_likeness(docs: DataFrame, block_bytes: int = BLOCK_BYTES, share: int = 4) -> DataFrame:
    """Each document's digest against that of its edited text (its last 1/``share`` of code points replaced by the first
    of the next document) and against that of the next document. Texts are shuffled once, in order; the last document of a
    partition and the first of the next one meet by a join of these alone."""
    spark = docs.sparkSession
    names = [c.split()[0] for c in f"{EDITED}, {_END}".split(", ")]

    def compare(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = None  # the last row, whose next is yet to come: doc_id, text, code

        def end(kind, doc_id, text):
            row = [[doc_id], *[[None]] * 6, [kind], [part], [text]]
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            doc_id, text = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            code = codes([t.encode("utf-8", "surrogatepass") for t in text])
            if held is None:
                yield end(1, doc_id[0], text[0])
            else:
                doc_id, text, code = [held[0], *doc_id], [held[1], *text], np.concatenate([held[2][None], code])
            held = doc_id[-1], text[-1], code[-1]
            n = len(text) - 1
            if n:
                got = _compared(doc_id[:-1], text[:-1], text[1:], code[:-1], code[1:], share)
                yield pa.RecordBatch.from_arrays([*got, pa.array([0] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array([None] * n, pa.string())], names=names)
        if held is not None:
            yield end(2, *held[:2])

    def meet(batches):
        import pyarrow as pa

        for batch in batches:
            doc_id, text, after = (c.to_pylist() for c in batch.columns)
            code, code_after = (codes([t.encode("utf-8", "surrogatepass") for t in x]) for x in (text, after))
            yield pa.RecordBatch.from_arrays(_compared(doc_id, text, after, code, code_after, share), names=names[:7])

    found = materialise(in_order(docs, block_bytes).mapInArrow(compare, f"{EDITED}, {_END}"), "digests")
    parts = sorted(r["part"] for r in found.filter("kind = 1").select("part").collect())  # a number for each partition
    following = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]])), "part int, next int")
    first = found.filter("kind = 1").select(F.col("part").alias("next"), F.col("text").alias("after"))
    last = found.filter("kind = 2").select("part", "doc_id", "text").join(following, "part").join(first, "next")
    return found.filter("kind = 0").select(*names[:7]).unionByName(last.select("doc_id", "text", "after").mapInArrow(meet, EDITED))
