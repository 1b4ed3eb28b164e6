"""Token ids in Arrow stream files of fixed-size lists, with zero-copy random access.

The ids of all documents, in ascending order of doc_id, form one sequence per block of documents; it is cut into rows of
``row_tokens`` ids, and the last row of a file is padded. A row has ``ids`` (fixed-size list of 16-bit ids, or 32-bit ids
for a larger vocabulary) and ``mask`` (fixed-size list of booleans, false for padding). Beside each file lies a second
stream with doc_id, start and n_tokens. Readers map a local file into memory and slice it without copying.

Defined results: null texts are empty and have only the end id; rows with one doc_id follow each other ordered by text;
null doc_ids come first; an empty table gives no files; other columns are left out. Files are written under a name of the
task attempt and renamed when whole, so an attempt that is lost leaves nothing that is read."""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import fresh_path
from .common import in_order, prepare

ROW_TOKENS = 2048
ROWS_PER_BATCH = 128
BLOCK_BYTES = 16 << 20
END_ID = 2


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(use_mmap=True), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(use_mmap=True), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


class _Writer:
    def __init__(self, folder: str, block: int, row_tokens: int, wide: bool):
        import pyarrow as pa

        self.fs, path = _filesystem(folder)
        self.fs.create_dir(path, recursive=True)
        self.final = [f"{path}/block-{block:06d}.ids.arrows", f"{path}/block-{block:06d}.docs.arrows"]
        self.part = [f"{p}.{uuid.uuid4().hex}" for p in self.final]
        self.kind = pa.uint32() if wide else pa.uint16()
        self.dtype = "<u4" if wide else "<u2"
        self.n = row_tokens
        self.schema = pa.schema([("ids", pa.list_(self.kind, row_tokens)), ("mask", pa.list_(pa.bool_(), row_tokens))])
        self.sink = self.fs.open_output_stream(self.part[0])
        self.stream = pa.ipc.new_stream(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.tokens = 0
        self.docs: tuple[list, list, list] = ([], [], [])

    def add(self, doc_id, ids: np.ndarray) -> None:
        for c, v in zip(self.docs, (doc_id, self.tokens, len(ids))):
            c.append(v)
        self.tokens += len(ids)
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        if self.n_held >= self.n * ROWS_PER_BATCH:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.n * self.n
            self._rows(flat[:whole], whole)
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _rows(self, flat: np.ndarray, valid: int) -> None:
        import pyarrow as pa

        ids = pa.FixedSizeListArray.from_arrays(pa.array(flat, self.kind), self.n)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(flat)) < valid), self.n)
        self.stream.write_batch(pa.RecordBatch.from_arrays([ids, mask], schema=self.schema))

    def close(self) -> int:
        import pyarrow as pa

        if self.n_held:
            flat = np.concatenate(self.held)
            padded = np.zeros(-(-len(flat) // self.n) * self.n, self.dtype)
            padded[: len(flat)] = flat
            self._rows(padded, len(flat))
        self.stream.close()
        self.sink.close()
        docs = pa.table({"doc_id": pa.array(self.docs[0], pa.int64()), "start": pa.array(self.docs[1], pa.int64()), "n_tokens": pa.array(self.docs[2], pa.int64())})
        with self.fs.open_output_stream(self.part[1]) as sink, pa.ipc.new_stream(sink, docs.schema) as out:
            out.write_table(docs)
        for a, b in zip(self.part, self.final):
            self.fs.move(a, b)
        return self.tokens


class TokenFile:
    """Random access to one block: row(i) and tokens(start, n) are views of the mapped file."""

    def __init__(self, folder: str, block: int):
        import pyarrow as pa

        fs, path = _filesystem(folder)
        with pa.ipc.open_stream(fs.open_input_file(f"{path}/block-{block:06d}.ids.arrows")) as r:
            batches = list(r)
        with pa.ipc.open_stream(fs.open_input_file(f"{path}/block-{block:06d}.docs.arrows")) as r:
            self.docs = r.read_all()
        self.ids = [b.column(0).flatten().to_numpy(zero_copy_only=True) for b in batches]
        self.masks = [b.column(1).flatten() for b in batches]
        self.n = batches[0].column(0).type.list_size if batches else ROW_TOKENS
        self.ends = np.cumsum([len(x) for x in self.ids])
        self.valid = sum(m.true_count for m in self.masks)

    def __len__(self) -> int:
        return int(self.ends[-1]) // self.n if len(self.ends) else 0

    def row(self, i: int):
        k = int(np.searchsorted(self.ends, i * self.n, side="right"))
        at = i * self.n - (int(self.ends[k - 1]) if k else 0)
        return self.ids[k][at : at + self.n], self.masks[k].slice(at, self.n)

    def tokens(self, start: int, n: int):
        """Views that together hold ids start to start + n."""
        k = int(np.searchsorted(self.ends, start, side="right"))
        while n > 0:
            at = start - (int(self.ends[k - 1]) if k else 0)
            part = self.ids[k][at : at + n]
            yield part
            start, n, k = start + len(part), n - len(part), k + 1


def write(docs: DataFrame, vocabulary_name: str, folder: str, end_id: int = END_ID, row_tokens: int = ROW_TOKENS, block_bytes: int = BLOCK_BYTES) -> list[tuple[int, int]]:
    """Writes the files; (block, ids in it) in order. Only these totals, one a block, come to the driver."""

    def put(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import encoder, vocabulary

        enc = encoder(vocabulary(vocabulary_name))
        wide = enc.tok.get_vocab_size() > 65536
        end = np.array([end_id], "<u4").tobytes()
        block, writer = TaskContext.get().partitionId(), None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                writer = writer or _Writer(folder, block, row_tokens, wide)
                writer.add(doc_id, np.frombuffer(enc.encode(text.as_py() or "") + end, "<u4"))
        if writer:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([writer.close()], pa.int64())], names=["block", "n"])

    return sorted((r["block"], r["n"]) for r in in_order(docs, block_bytes).mapInArrow(put, "block int, n long").collect())


def read(spark: SparkSession, folder: str, blocks: list[tuple[int, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files, which are read through once, a batch at a time."""
    rows, base = [], 0
    for block, n in blocks:
        rows.append((block, base, n))
        base += n

    def get(batches):
        import pyarrow as pa

        for batch in batches:
            for block, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                fs, path = _filesystem(folder)
                with fs.open_input_file(f"{path}/block-{block:06d}.docs.arrows") as source, pa.ipc.open_stream(source) as r:
                    docs = r.read_all()
                sizes = docs["n_tokens"].to_pylist()
                crcs, crc, left, k, seen = [], 0, sizes[0] if sizes else 0, 0, 0
                with fs.open_input_file(f"{path}/block-{block:06d}.ids.arrows") as source, pa.ipc.open_stream(source) as r:
                    for part in r:
                        valid = part.column(1).flatten().true_count
                        ids = part.column(0).flatten().to_numpy(zero_copy_only=True)[:valid].astype("<u4")
                        seen, at = seen + valid, 0
                        while at < valid:
                            take = min(left, valid - at)
                            crc, at, left = zlib.crc32(ids[at : at + take], crc), at + take, left - take
                            if not left:  # every document has its end id
                                crcs.append(crc)
                                crc, k = 0, k + 1
                                left = sizes[k] if k < len(sizes) else valid + 1
                if seen != n or len(crcs) != len(sizes):
                    raise ValueError(f"block {block} holds {seen} ids, not {n}")
                yield pa.RecordBatch.from_arrays(
                    [docs["doc_id"].combine_chunks(), pa.array(np.asarray(docs["start"]) + first), docs["n_tokens"].combine_chunks(), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = spark.createDataFrame(rows, "block int, first long, n long").repartition(max(1, len(rows)))
    return files.mapInArrow(get, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary_name: str = "word_bpe_49k.json", **options) -> DataFrame:
    spark = prepare(docs.sparkSession)
    folder = fresh_path(spark, "token-files")
    return read(spark, folder, write(docs, vocabulary_name, folder, **options))
