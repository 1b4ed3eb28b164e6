"""Repeated passages across documents, by enhanced suffix arrays.

A window is a string of ``WINDOW`` bytes. Every window has an anchor: the k-gram of smallest hash in it, the leftmost of
equals. Neighbouring windows share their anchor, so a document is a chain of contexts: the bytes of all windows of one
anchor, 50 to 80. Equal windows have equal anchors, so only contexts with one anchor hash can hold a repeat.

1. Contexts are sorted by anchor hash, context hash and doc_id. Where a context was seen in a smaller document, all its
   windows are repeats; only its first document goes on, and only if the anchor has different contexts. Each task does the
   same to its own contexts before the shuffle, so a passage that a third of all documents hold arrives once per task.
2. The contexts that go on meet by anchor in suffix arrays of about half a megabyte. Only suffixes
   whose first 50 bytes another document's suffix has are sorted; the LCP array is scanned with a stack for the nodes of the common-prefix interval tree; nodes whose occurrences differ in the
   byte before them are the maximal repeats, each with all its occurrences; an occurrence is a repeat if a smaller document
   holds another. A node whose occurrences all have the same byte before them is covered by the node one byte longer.
   An anchor with more than ``HOT`` different contexts is dealt again window by window, and each task merges equal
   windows first, so it isn't gathered anywhere.

Defined results: null texts are empty; texts under 50 bytes keep all; rows with one doc_id never cover each other; rows with
a null doc_id keep all and cover nothing; an empty table gives no rows; other columns are left out, by ``strip`` kept."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of_text, gathered, hash_ranges, materialise, mix64, unused, utf8_column

WINDOW = 50
GRAM = 20
HOT = 4_000
_SPAN = WINDOW - GRAM + 1
_BLOCK = 1 << 19
_GRAM_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
# a place: 27 bits of the text's hash | 31 bits start (a string has under 2^31 bytes) | 6 bits number of windows
_TAG, _START, _COUNT = 37, 6, 63


def gram_hashes(data: np.ndarray) -> np.ndarray:
    n = len(data) - GRAM + 1
    raw = np.ascontiguousarray(data)
    eight = np.lib.stride_tricks.as_strided(raw[: max(len(raw) - 7, 0)].view(np.uint8), (max(len(raw) - 7, 0), 8), (1, 1))
    words = np.ascontiguousarray(eight).view("<u8").reshape(-1)
    with np.errstate(over="ignore"):
        return mix64(words[:n] * _GRAM_MULT[0] + (words[8 : n + 8] ^ _GRAM_MULT[2]) * _GRAM_MULT[1] + words[GRAM - 8 : n + GRAM - 8] * _GRAM_MULT[2])


def contexts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: anchor hash, context hash, first window's start in ``data`` and number of windows of each context."""
    out: list[tuple] = []
    for at in range(0, max(len(data) - WINDOW + 1, 0), _BLOCK):
        part = data[at : at + _BLOCK + WINDOW - 1]
        n = len(part) - WINDOW + 1
        h = gram_hashes(part)
        x = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
        low, size = x, 1
        while size * 2 <= _SPAN:
            low, size = np.minimum(low[:-size], low[size:]), size * 2
        low = np.minimum(low[: len(low) - (_SPAN - size)], low[_SPAN - size :])[:n]
        anchor = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
        ok = np.zeros(n + 1, np.int32)
        first, last = np.maximum(offsets[:-1] - at, 0), np.minimum(offsets[1:] - WINDOW + 1 - at, n)
        some = last > first
        np.add.at(ok, first[some], 1)
        np.add.at(ok, last[some], -1)
        starts = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
        if not len(starts):
            continue
        text = np.searchsorted(offsets, starts + at, side="right")
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[starts[1:]] != anchor[starts[:-1]]) | (starts[1:] != starts[:-1] + 1) | (text[1:] != text[:-1])
        begin = np.flatnonzero(new)
        s = starts[begin]
        count = np.diff(np.append(begin, len(starts)))
        out.append((h[anchor[s]], hash_ranges(part, s, s + count + WINDOW - 1), s + at, count))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*out))


def text_tags(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return (hash_ranges(data, offsets[:-1], offsets[1:]) >> np.uint64(_TAG)).astype(np.int64)


def places(tag: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (tag.astype(np.uint64) << np.uint64(_TAG) | start.astype(np.uint64) << np.uint64(_START) | count.astype(np.uint64)).view(np.int64)


def split_places(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u = place.view(np.uint64)
    return (u >> np.uint64(_TAG)).astype(np.int64), ((u & np.uint64((1 << _TAG) - 1)) >> np.uint64(_START)).astype(np.int64), (u & np.uint64(_COUNT)).astype(np.int64)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before it."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def enhanced_suffix_array(data: np.ndarray, offsets: np.ndarray, least: int, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of the texts at ``offsets`` in ``data`` that begin with ``least`` bytes which another one begins with (of
    another ``owner``, if given), others share no prefix so long: text number, start, the byte before (unique where there is
    none), and the LCP with the suffix before (0 if under ``least``). Sorted by hash of the first ``least`` bytes, then by
    the bytes that follow, 32 at a time until no two that agree so far go on."""
    first, last = offsets[:-1], np.maximum(offsets[1:] - least + 1, offsets[:-1])
    sizes = last - first
    text = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(sizes.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    h = hash_ranges(data, at, at + least)
    order = np.argsort(h)
    h, at, text = h[order], at[order], text[order]
    new = _runs(h)
    run = np.cumsum(new) - 1
    keep = np.bincount(run)[run] > 1 if len(run) else new
    if owner is not None and keep.any():
        own, begin = owner[text], np.flatnonzero(new)
        keep &= (np.minimum.reduceat(own, begin) < np.maximum.reduceat(own, begin))[run]
    at, text, group = at[keep], text[keep], run[keep]
    rest = offsets[1:][text] - at
    lcp = np.zeros(len(at), np.int64)
    padded = np.concatenate([data, np.zeros(40, np.uint8)])
    depth, same = least, ~_runs(group)
    while same.any():
        words = []
        for k in range(depth, depth + 32, 8):
            i = np.minimum(at + k, len(data))
            word = padded[i[:, None] + np.arange(8)].view(">u8").reshape(-1).astype(np.uint64)
            short = np.clip(rest - k, 0, 8).astype(np.uint64)  # bytes that the suffix still has
            words.append(np.where(short == 0, np.uint64(0), word >> ((np.uint64(8) - short) % np.uint64(8) * np.uint64(8)) << ((np.uint64(8) - short) % np.uint64(8) * np.uint64(8))))
        order = np.lexsort((rest, *words[::-1], group))
        at, text, rest = at[order], text[order], rest[order]
        words = [w[order] for w in words]
        agree, live = np.full(len(at), depth), same.copy()
        for w in words:  # how far neighbours agree
            apart = np.zeros(len(at), np.uint64)
            apart[1:] = w[1:] ^ w[:-1]
            ahead = np.where(apart == 0, 8, 7 - np.floor(np.log2(np.maximum(apart, np.uint64(1)).astype(np.float64))).astype(np.int64) // 8)
            agree += np.where(live, ahead, 0)
            live &= apart == 0
        bound = np.minimum(rest, np.concatenate([[0], rest[:-1]])) if len(rest) else rest
        lcp = np.where(same, np.minimum(agree, bound), lcp)
        depth += 32
        same = same & live & (bound > depth)
        group = np.cumsum(~same)
    left = np.where(at > offsets[:-1][text], data[np.maximum(at - 1, 0)].astype(np.int64), -1 - np.arange(len(at)))
    return text, at - offsets[:-1][text], left, lcp


def interval_nodes(lcp: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Nodes (length, first, last) of the common-prefix interval tree whose occurrences differ in the byte before them.

    A stack holds the open nodes while the LCP array is scanned; runs between zeros are trees of their own, and a run of two
    is one node."""
    other = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])])
    linked = np.concatenate([lcp > 0, [False]])
    heads = np.flatnonzero(linked[1:] & ~linked[:-1])
    tails = np.flatnonzero(~linked[1:] & linked[:-1])
    diverse = other[tails] > other[heads]
    two = tails - heads == 1
    for lb, rb in zip(heads[diverse & two].tolist(), tails[diverse & two].tolist()):
        yield int(lcp[rb]), lb, rb
    for head, tail in zip(heads[diverse & ~two].tolist(), tails[diverse & ~two].tolist()):
        values = lcp[head + 1 : tail + 1].tolist()
        stack: list[tuple[int, int]] = []
        for i, depth in enumerate([*values, 0], head + 1):
            lb = i - 1
            while stack and stack[-1][0] > depth:
                size, lb = stack.pop()
                if other[i - 1] > other[lb]:
                    yield size, lb, i - 1
            if depth and (not stack or stack[-1][0] < depth):
                stack.append((depth, lb))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def maximal_repeats(texts: list[bytes], least: int = WINDOW) -> list[tuple[int, list[tuple[int, int]]]]:
    """All maximal repeat groups of at least ``least`` bytes: length and every occurrence (text number, start)."""
    text, start, left, lcp = enhanced_suffix_array(*_joined(texts), least)
    return [(size, sorted(zip(text[lb : rb + 1].tolist(), start[lb : rb + 1].tolist()))) for size, lb, rb in interval_nodes(lcp, left)]


def covered_by_smaller(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, least: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text numbers, starts and lengths of the maximal repeats' occurrences that a smaller document holds too."""
    text, start, left, lcp = enhanced_suffix_array(data, offsets, least, docs)
    doc = docs[text]
    found: list[tuple] = []
    for size, lb, rb in interval_nodes(lcp, left):
        if rb - lb == 1:
            if doc[lb] != doc[rb]:
                i = lb if doc[lb] > doc[rb] else rb
                found.append(([text[i]], [start[i]], [size]))
        else:
            own = doc[lb : rb + 1]
            i = lb + np.flatnonzero(own > own.min())
            if len(i):
                found.append((text[i], start[i], np.full(len(i), size)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(c).astype(np.int64) for c in zip(*found))


def _sorted_by_context(h, c, doc, place):
    order = np.lexsort((place, doc, c, h))
    h, c, doc, place = h[order], c[order], doc[order], place[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    return h, c, doc, place, new


ROWS = "h long, c long, doc_id long, place long, covered boolean"


def _rows(h, c, doc, place, covered):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(doc), pa.array(place), pa.array(covered)], names=["h", "c", "doc_id", "place", "covered"])


def _combine(h, c, doc, place):
    """One task's contexts: those that a smaller document of the same task holds are covered already."""
    h, c, doc, place, new = _sorted_by_context(h, c, doc, place)
    least = doc[new][np.cumsum(new) - 1] if len(doc) else doc
    rows = _rows(h, c, doc, place, doc > least)
    for i in range(0, rows.num_rows, 1 << 16):
        yield rows.slice(i, 1 << 16)


def anchored(docs: DataFrame) -> DataFrame:
    """A row for each context of each document."""

    def chain(batches):
        held, n = [], 0
        for batch in batches:
            for i, j, data, off in batches_of_text(batch.column(1)):
                ids = np.asarray(batch.column(0).slice(i, j - i))
                h, c, start, count = contexts(data, off)
                text = np.searchsorted(off, start, side="right") - 1
                held.append((h, c, ids[text], places(text_tags(data, off)[text], start - off[text], count)))
                n += len(h)
                if n >= 500_000:
                    yield from _combine(*(np.concatenate(x) for x in zip(*held)))
                    held, n = [], 0
        if n:
            yield from _combine(*(np.concatenate(x) for x in zip(*held)))

    return docs.filter("doc_id is not null").mapInArrow(chain, ROWS)


def _dealt():
    """Rows meet by anchor hash; those that are decided only pass through, so a passage that many documents hold meets no
    task with them."""
    return F.when(F.col("covered"), F.xxhash64("doc_id", "place")).otherwise(F.col("h"))


SEEN = "h long, doc_id long, place long, covered boolean"


def seen_before(rows: DataFrame) -> DataFrame:
    """Covered contexts, and those that go on: the first document's of each context, where its anchor has others."""

    def scan(batches):
        import pyarrow as pa

        def out(h, doc, place, covered):
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc), pa.array(place), pa.array(covered)], names=["h", "doc_id", "place", "covered"])

        last = None  # h, c and first document of the context that the last batch ended in
        held = [np.zeros(0, np.int64)] * 3  # contexts of an anchor that has had only one kind so far
        several = False  # whether that anchor has had more
        for h, c, doc, place, done in gathered(batches):
            if done.any():
                yield out(h[done], doc[done], place[done], done[done])
                h, c, doc, place = (x[~done] for x in (h, c, doc, place))
            if not len(h):
                continue
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            first = np.where(new, doc, 0)
            if last is not None and last[0] == h[0] and last[1] == c[0]:
                new[0], first[0] = False, last[2]
                kind = np.cumsum(new)
                least = np.concatenate([[last[2]], doc[new]])[kind]
            else:
                least = doc[new][np.cumsum(new) - 1]
            covered = doc > least
            if covered.any():
                yield out(h[covered], doc[covered], place[covered], covered[covered])
            # anchors with more than one kind of context
            begin = np.ones(len(h), bool)
            begin[1:] = h[1:] != h[:-1]
            run = np.cumsum(begin) - 1
            kinds = np.bincount(run, weights=new)
            joined = last is not None and last[0] == h[0]
            if joined and (several or kinds[0] > 0):
                kinds[0] = 2
            go = ~covered & (kinds[run] > 1)
            stay = ~covered & (run == run[-1]) & (kinds[run] <= 1)
            if len(held[0]):
                if joined and kinds[0] > 1:
                    yield out(*held, np.zeros(len(held[0]), bool))
                    held = [np.zeros(0, np.int64)] * 3
                elif not (joined and run[-1] == 0):
                    held = [np.zeros(0, np.int64)] * 3
            if go.any():
                yield out(h[go], doc[go], place[go], covered[go])
            if stay.any():
                held = [np.concatenate([a, b]) for a, b in zip(held, (h[stay], doc[stay], place[stay]))]
            several = bool(kinds[-1] > 1)
            last = (h[-1], c[-1], least[-1])

    order = ["h", "c", "doc_id", "place"]
    return rows.repartition(_dealt()).sortWithinPartitions(*order).mapInArrow(scan, SEEN)


BYTES = "h long, doc_id long, place long, covered boolean, bytes binary"


def with_bytes(docs: DataFrame, going: DataFrame) -> DataFrame:
    """The contexts that go on with their bytes, in one row each, or one for each window of a hot anchor."""
    asked = going.groupBy("doc_id").agg(F.collect_list(F.struct("h", "place", "hot")).alias("asked"))

    def fetch(batches):
        import pyarrow as pa

        def out(h, doc, place, covered, lens, flat):
            raw = pa.Array.from_buffers(pa.binary(), len(lens), [pa.py_buffer(np.packbits(~covered, bitorder="little")) if covered.any() else None, pa.py_buffer(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.py_buffer(flat)])
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc), pa.array(place), pa.array(covered), raw], names=["h", "doc_id", "place", "covered", "bytes"])

        def pieces(data, start, lens):
            ends = np.cumsum(lens)
            return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + lens, lens)]

        def merged(held):
            h, doc, place, raw = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((doc, h))
            h, doc, place, raw = h[order], doc[order], place[order], raw[order]
            new = _runs(h)
            covered = doc > doc[new][np.cumsum(new) - 1]
            return out(h, doc, place, covered, np.where(covered, 0, WINDOW), raw[~covered].reshape(-1))

        held: list[tuple] = []
        n_held = 0
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for i, j, data, off in batches_of_text(batch.column(1)):
                tags = text_tags(data, off)
                ask = batch.column(2).slice(i, j - i)
                row = np.repeat(np.arange(j - i), np.diff(np.asarray(ask.offsets)))
                ask = ask.flatten()
                h, place, hot = np.asarray(ask.field(0)), np.asarray(ask.field(1)), np.asarray(ask.field(2).to_numpy(zero_copy_only=False))
                tag, start, count = split_places(place)
                mine = tag == tags[row]
                begin, doc = off[row] + start, ids[i:j][row]
                e = mine & ~hot
                lens = count[e] + WINDOW - 1
                yield out(h[e], doc[e], place[e], np.zeros(len(lens), bool), lens, pieces(data, begin[e], lens))
                e = np.flatnonzero(mine & hot)
                if len(e):
                    n = count[e]
                    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    at = np.repeat(begin[e], n) + step
                    held.append((hash_ranges(data, at, at + WINDOW).view(np.int64), np.repeat(doc[e], n), places(np.repeat(tag[e], n), np.repeat(start[e], n) + step, np.ones(len(step), np.int64)), data[at[:, None] + np.arange(WINDOW)]))
                    n_held += len(step)
                if n_held >= 200_000:
                    yield merged(held)
                    held, n_held = [], 0
        if held:
            yield merged(held)

    return docs.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(fetch, BYTES)


def resolve(rows: DataFrame, batch_bytes: int = 1 << 19) -> DataFrame:
    """Covered places (doc_id, place) from the suffix arrays of contexts that share an anchor."""

    def arrays(batches):
        import pyarrow as pa

        def out(doc, place):
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(place, pa.int64())], names=["doc_id", "place"])

        def solve(h, doc, place, lens, raw):
            tag, start, _ = split_places(place)
            text, at, size = covered_by_smaller(raw, np.concatenate([[0], np.cumsum(lens)]), doc)
            return out(doc[text], places(tag[text], start[text] + at, size - WINDOW + 1))

        held: list[tuple] = []
        total = 0
        for batch in batches:
            done = batch.column(3).to_numpy(zero_copy_only=False)
            if done.any():
                keep = pa.array(done)
                yield out(batch.column(1).filter(keep), batch.column(2).filter(keep))
                batch = batch.filter(pa.array(~done))
            raw, ends = utf8_column(batch.column(4))
            held.append((*(np.asarray(batch.column(i)) for i in range(3)), np.diff(ends), raw))
            total += len(raw)
            if total >= batch_bytes:
                held = [tuple(np.concatenate(x) for x in zip(*held))]
                h, lens = held[0][0], held[0][3]
                cut = int(np.searchsorted(h, h[-1]))  # the last anchor may have more
                if cut:
                    split = int(lens[:cut].sum())
                    yield solve(*(x[:cut] for x in held[0][:4]), held[0][4][:split])
                    held = [(*(x[cut:] for x in held[0][:4]), held[0][4][split:])]
                    total = len(held[0][4])
        if held:
            yield solve(*(np.concatenate(x) for x in zip(*held)))

    return rows.repartition(_dealt()).sortWithinPartitions("h").mapInArrow(arrays, "doc_id long, place long")


def covered_places(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id and the places of repeats that a smaller document holds, for documents that have any."""
    seen = materialise(seen_before(anchored(docs)), "contexts")
    going = seen.filter("not covered")
    crowded = going.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("h", F.lit(True).alias("hot"))
    going = going.join(crowded, "h", "left").select("h", "doc_id", "place", F.coalesce("hot", F.lit(False)).alias("hot"))
    more = resolve(with_bytes(docs, going))
    every = seen.filter("covered").select("doc_id", "place").unionByName(more)
    return every.groupBy("doc_id").agg(F.collect_list("place").alias("places"))


def removed_mask(n: int, tag: int, place: np.ndarray) -> np.ndarray:
    t, start, count = split_places(place)
    mine = t == tag
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start[mine], 1)
    np.add.at(edge, start[mine] + count[mine] + WINDOW - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _each_text(batch, text_at: int, places_at: int):
    """(bytes, mask of removed bytes) of each row."""
    for i, j, data, off in batches_of_text(batch.column(text_at)):
        tags = text_tags(data, off)
        for r in range(i, j):
            own = data[off[r - i] : off[r - i + 1]]
            given = batch.column(places_at)[r]
            if given.is_valid and len(own):
                yield own, removed_mask(len(own), int(tags[r - i]), np.asarray(given.values))
            else:
                yield own, np.zeros(len(own), bool)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    docs = _texts(docs)

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for own, gone in _each_text(batch, 1, 2):
                cols[0].append(len(own))
                cols[1].append(int(gone.sum()))
                cols[2].append(int((gone[1:] & ~gone[:-1]).sum() + (gone[:1].sum() if len(gone) else 0)))
                cols[3].append(hashlib.sha256(own[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = docs.join(covered_places(docs, hot), "doc_id", "left").select("doc_id", "text", "places")
    return joined.mapInArrow(measure, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """The rows, all columns, without the bytes that repeat a smaller document; n_chars, if there, counts what is left.
    A character that loses a byte goes whole."""
    names = docs.columns
    rest = [c for c in names if c not in ("text", "n_chars")]

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            kept = []
            for own, gone in _each_text(batch, 0, 1):
                if gone.any():
                    lead = (own & 0xC0) != 0x80  # each character goes or stays as a whole
                    char = np.cumsum(lead) - 1
                    hit = np.bincount(char, weights=gone) > 0
                    kept.append(own[~hit[char]].tobytes().decode("utf-8"))
                else:
                    kept.append(own.tobytes().decode("utf-8"))
            text = pa.array([None if v is None and not k else k for v, k in zip(batch.column(0).to_pylist(), kept)], pa.string())
            cols = {"text": text, "n_chars": pa.array([len(k) for k in kept], pa.int64())} | {c: batch.column(2 + i) for i, c in enumerate(rest)}
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)

    schema = ", ".join(f"`{c}` {'long' if c == 'n_chars' else 'string' if c == 'text' else docs.schema[c].dataType.simpleString()}" for c in names)
    key, found = unused(names, "key"), unused(names, "places")
    own = covered_places(_texts(docs), hot).select(F.col("doc_id").alias(key), F.col("places").alias(found))
    joined = docs.join(own, F.col("doc_id") == F.col(key), "left")
    return joined.select(F.col("text").cast("string").alias("text"), found, *rest).mapInArrow(cut, schema)
