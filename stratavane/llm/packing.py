"""Vector best-fit packing of token sequences.

A bin has residual capacities for tokens, documents and attention cost (the sum of squared lengths). Items, longest
first, go to the open bin that can take them under every constraint and scores best: the smallest weighted norm of what
would be left (``norm``), or the largest weighted dot product of the item's demand and the residual (``dot``).

Items are dealt by hash into shards of about ``shard_items``, each packed by itself, so that no task grows with the input
and a shard leaves at most a few bins that are not full. Defined results: null texts are empty and hold only the end id;
a document over the tokens of a sequence is cut, one of any length whole otherwise; rows with a null or repeated doc_id, and
repeated rows, are packed each by itself; items of equal demand go in order of doc_id, piece and start, and bins of equal score
by age; an empty table gives no rows; other columns are left out."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

SEQUENCE_TOKENS = 2048
SHARD_ITEMS = 8192
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(demands: np.ndarray, capacities: np.ndarray, weights: np.ndarray, rule: str = "norm") -> np.ndarray:
    """Bin number of each item; demands are whole numbers, one row per item and one column per constraint."""
    demands, capacities = demands.astype(np.int64), capacities.astype(np.int64)
    if len(demands) and (demands > capacities).any():
        raise ValueError("an item exceeds the capacity of an empty bin")
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule}")
    scale = 1.0 / np.maximum(capacities, 1)
    order = np.lexsort((np.arange(len(demands)), -demands[:, 0]))
    least = demands.min(axis=0) if len(demands) else capacities
    residual = np.zeros((64, len(capacities)), np.int64)
    names = np.zeros(64, np.int64)
    used = bins = 0
    out = np.zeros(len(demands), np.int64)
    for n, i in enumerate(order.tolist()):
        need = demands[i]
        left = residual[:used] - need
        fits = np.flatnonzero((left >= 0).all(axis=1)) if used else ()
        if len(fits):
            if rule == "norm":
                score = (weights * (left[fits] * scale) ** 2).sum(axis=1)
            else:
                score = -(weights * (need * scale) * (residual[fits] * scale)).sum(axis=1)
            at = fits[int(np.argmin(score))]
            residual[at] -= need
            out[i] = names[at]
        else:
            out[i] = bins
            rest = capacities - need
            if (rest >= least).all():
                if used == len(residual):
                    residual = np.concatenate([residual, np.zeros_like(residual)])
                    names = np.concatenate([names, np.zeros_like(names)])
                residual[used], names[used] = rest, bins
                used += 1
            bins += 1
        if n % 256 == 255 and used:  # bins that can take nothing more are closed
            open_ = np.flatnonzero((residual[:used] >= least).all(axis=1))
            residual[: len(open_)], names[: len(open_)], used = residual[open_], names[open_], len(open_)
    return out


def pieces(docs: DataFrame, vocabulary_name: str, most: int = SEQUENCE_TOKENS) -> DataFrame:
    """The token pieces of each document: only documents over ``most`` tokens are cut, and only the first piece may be shorter."""

    def cut(batches):
        import pyarrow as pa

        from .tokens import encoder, vocabulary

        enc = encoder(vocabulary(vocabulary_name))
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode(text.as_py() or "") + end
                n = len(ids) // 4
                at, k = 0, 0
                size = n if n <= most else n % most or most
                while at < n:
                    for c, v in zip(cols, (doc_id, k, at, size, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + size)]))):
                        c.append(v)
                    at, k, size = at + size, k + 1, most
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def pack(
    items: DataFrame,
    shards: int,
    tokens: int = SEQUENCE_TOKENS,
    documents: int | None = None,
    attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
    rule: str = "norm",
) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece, start, length and ids_crc32. ``documents`` and
    ``attention`` bound the items of a sequence and the sum of their squared lengths; by default neither binds
    before ``tokens`` does."""
    capacities = np.array([tokens, documents or tokens, attention or tokens * tokens], np.int64)
    w = np.array(weights)

    def shard(table):
        import pyarrow as pa

        order = np.lexsort([np.asarray(table[c].fill_null(-1)) for c in ("start", "piece", "doc_id")])
        table = table.take(pa.array(order))
        length = np.asarray(table["length"])
        bins = best_fit(np.stack([length, np.ones_like(length), length * length], axis=1), capacities, w, rule)
        by_bin = np.lexsort((np.arange(len(bins)), bins))
        ends = np.cumsum(length[by_bin])
        begin = ends - length[by_bin]
        first = np.r_[True, bins[by_bin][1:] != bins[by_bin][:-1]]
        base = begin[first][np.cumsum(first) - 1]
        offset = np.empty(len(bins), np.int64)
        offset[by_bin] = begin - base
        ids = (np.int64(table["shard"][0].as_py()) << np.int64(32)) + bins
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset))

    dealt = items.withColumn("shard", F.pmod(F.xxhash64(*items.columns), F.lit(shards))).select("doc_id", "piece", "start", "length", "ids_crc32", "shard")
    return dealt.groupBy("shard").applyInArrow(shard, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary_name: str = "byte_bpe_50k.json", shard_items: int = SHARD_ITEMS, **limits) -> DataFrame:
    """All pieces of ``docs``, packed. They are numbered and counted where they are stored, so that equal rows go to
    different shards and shards are as many as pieces need."""
    items = pieces(docs, vocabulary_name, limits.get("tokens", SEQUENCE_TOKENS)).withColumn("number", F.monotonically_increasing_id())
    items = materialise(items, "pieces")
    return pack(items, max(1, -(-items.count() // shard_items)), **limits)
