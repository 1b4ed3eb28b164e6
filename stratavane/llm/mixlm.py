"""Language-model scores by logistic mixing of hashed-context bit predictors.

Each bit of a text's bytes is predicted by several contexts: the last two, three, four and five bytes. With the bits of the
byte that are known, a context has counts of ones and zeros over all training documents; these are read as one of 224 states,
and a state's logit is what followed that state. The contexts' logits are combined by weights that are gated by the bits known
and by how many of the two longest contexts are new, and the result is refined by an adaptive map from (bits known, logit) to
probability. A text's score is the sum over its bits, and those of an end byte.

What is counted is how often each byte follows each context; the counts of its bits are sums of these. They grow with the
input and are kept in a table that is partitioned by context hash; no task holds more than its share. A block of documents
asks for the contexts that it has, each once, and gets a state for each bit. Contexts are exact. Beside this stands the exact
unigram score over the words, by 64-bit hashes, from counts that go the same way.

States' logits, weights and map are learned from all training documents. A block's documents are met as new text is: by the
counts of all others, its own taken off; scores are by the counts of all. There are ``FEWEST_BLOCKS`` blocks or more, so that
little is taken off. Logits are from sums over all blocks. Weights and map are learned by each block, bit position by bit
position in batches of ``BATCH`` distinct events (a context and its byte), in mixed order, each with the weight of how often it
occurs, and averaged by bytes. Only these 60 kB, and totals, pass the driver.

Defined results: null texts are empty, have the end only, and score as that; rows with a null doc_id are scored, not learned
from and not held out; rows of one doc_id, equal or not, each count; texts of any length are taken whole, in slices between
documents; a text's score doesn't depend on the other texts that are scored; with no training document counts are 0 and the
predictors know nothing; an empty table gives no rows; other columns are left out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, _SPACE, batches_of_text, discard, hash_ranges, materialise, mix64, release
from .quality import fold

#: Bytes of each context.
BYTES = (2, 3, 4, 5)
KINDS = len(BYTES)
_LONG, _TOKEN = KINDS - 1, KINDS  # kinds of keys: contexts by number, then whole words
BLOCK_BYTES = 12 << 20
FEWEST_BLOCKS = 16
BATCH = 8192
RATE = 0.02
MAP_RATE = 0.02
_SLICE = 1 << 20
_GATES = 3 * 256
_MAP = 33
_PAD = 7
_MASKS = [np.uint64((1 << 8 * (k + 1)) - 1) for k in BYTES]
_END_WORD = np.uint64(0x5DEECE66D1234567)
#: Distinct keys that a task gathers before it sends them.
_GATHER = 1_500_000


def events(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all bytes of the texts and an end byte each: the five bytes before and the byte, and the text's number; then the
    hash of each word, in lower case, and its text's number."""
    n_texts = len(offsets) - 1
    sizes = np.diff(offsets)
    joined = np.zeros(_PAD + len(data) + _PAD * n_texts, np.uint8)
    valid = np.zeros(len(joined), bool)
    begin = _PAD + offsets[:-1] + _PAD * np.arange(n_texts)
    for at, a, b in zip(begin.tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
        joined[at : at + b - a] = data[a:b]
        valid[at : at + b - a] = True
    apart = ~valid | _SPACE[joined]
    valid[begin + sizes] = True
    text = np.repeat(np.arange(n_texts), sizes + 1)
    eight = np.lib.stride_tricks.as_strided(joined, (len(joined) - _PAD, 8), (1, 1))
    key = np.ascontiguousarray(eight).view(">u8").reshape(-1).astype(np.uint64)[valid[_PAD:]] & _MASKS[-1]
    first, last = np.flatnonzero(apart[:-1] & ~apart[1:]) + 1, np.flatnonzero(~apart[:-1] & apart[1:]) + 1
    return key, text, hash_ranges(_LOWER[joined], first, last), np.searchsorted(begin, first, side="right") - 1


def _new(a: np.ndarray) -> np.ndarray:
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    return new


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    at = np.flatnonzero(_new(keys))
    return keys[at], np.diff(np.append(at, len(keys)))


def added(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(_new(keys))
    if not len(at):
        return (keys, *counts)
    return (keys[at], *(np.add.reduceat(c[order], at) for c in counts))


def bucket_of(kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """All keys of a context share a bucket."""
    with np.errstate(over="ignore"):
        h = mix64((keys >> np.uint64(8)) + np.uint64(kind + 1) * np.uint64(0x9E3779B97F4A7C15))
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def squeezed(raw: bytes) -> bytes:
    """Compressed by entropy too, which shuffles aren't; the length comes first."""
    import pyarrow as pa

    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def loosened(raw: bytes) -> bytes:
    import pyarrow as pa

    return pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers byte by byte, all highest bytes first and so on, which compresses well."""
    return squeezed(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(loosened(raw), np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


class Tally:
    """The distinct keys of texts, and how often they occur in all (``met``) and in some of these (``held``)."""

    def __init__(self):
        self.parts: dict[int, list] = {_LONG: [], _TOKEN: []}
        self.merged = dict.fromkeys(self.parts, 0)

    def add(self, data: np.ndarray, offsets: np.ndarray, mixer: np.ndarray | None = None) -> None:
        key, text, token, of = events(data, offsets)
        n_texts = len(offsets) - 1
        tokens, of = np.concatenate([token, np.full(n_texts, _END_WORD)]), np.concatenate([of, np.arange(n_texts)])
        for kind, keys, owner in ((_LONG, key, text), (_TOKEN, tokens, of)):
            found, met = counted(keys)
            held = np.zeros(len(met), np.int64)
            if mixer is not None and mixer.any():
                own, n = counted(keys[mixer[owner]])
                held[np.searchsorted(found, own)] = n
            parts = self.parts[kind]
            parts.append((found, met, held))
            if sum(len(p[0]) for p in parts) > 2 * self.merged[kind] + 500_000:
                self._merge(kind)

    def full(self) -> bool:
        """Whether there are more distinct keys than a task should gather."""
        size = lambda: sum(len(p[0]) for parts in self.parts.values() for p in parts)
        if size() > 2 * _GATHER:
            for kind in self.parts:
                self._merge(kind)
            return size() > _GATHER
        return False

    def _merge(self, kind: int) -> None:
        if len(self.parts[kind]) > 1:
            self.parts[kind] = [added(*(np.concatenate(c) for c in zip(*self.parts[kind])))]
        self.merged[kind] = sum(len(p[0]) for p in self.parts[kind])

    def kinds(self):
        """(kind, keys, met, held) of all kinds; shorter contexts are from the longest."""
        for kind, parts in self.parts.items():
            self._merge(kind)
        for kind in (_TOKEN, _LONG):
            for keys, met, held in self.parts[kind]:
                yield kind, keys, met, held
        for keys, met, held in self.parts[_LONG]:
            for kind in range(_LONG - 1, -1, -1):
                keys, met, held = added(keys & _MASKS[kind], met, held)
                yield kind, keys, met, held


class Events:
    """The distinct events of texts, that is the longest context and the byte, and which of them each byte of the texts is."""

    def __init__(self, texts):
        held: list[np.ndarray] = []
        self.places: list[tuple] = []
        tokens: list[np.ndarray] = [np.array([_END_WORD])]
        size = merged = 0
        for _, _, data, offsets in batches_of_text(texts, _SLICE):
            key, _, token, of = events(data, offsets)
            order = np.argsort(key)
            key = key[order]
            new = _new(key)
            inverse = np.empty(len(order), np.uint32)
            inverse[order] = np.cumsum(new) - 1
            held.append(key[new])
            self.places.append((held[-1], inverse, offsets, token, of))
            tokens.append(counted(token)[0])
            size += len(held[-1])
            if size > 2 * merged + 500_000:
                held = [counted(np.concatenate(held))[0]]
                size = merged = len(held[0])
        self.keys = counted(np.concatenate(held))[0]
        self.tokens = counted(np.concatenate(tokens))[0]

    def kinds(self):
        """(kind, keys) of all kinds, as a ``Tally`` has them."""
        yield _TOKEN, self.tokens
        yield from Asked(self.keys).kinds()


class Asked:
    """The distinct events of a block without its texts."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys

    def kinds(self):
        keys = self.keys
        for kind in range(_LONG, -1, -1):
            keys = counted(keys & _MASKS[kind])[0]
            yield kind, keys


#: Levels of how often a context was met (fixed values).
_SURE = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 128, 256, 512])
_MIXED = np.array([2, 3, 5, 9, 17, 65, 257, 2049])
_STEPS = 24


def states(met: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """State of each counter: 0 new; 1 to 30 one kind of bit only, by how often; then by logit and how often."""
    out = _SMALL[np.minimum(met, 127) << 7 | np.minimum(ones, 127)]
    large = np.flatnonzero(met > 127)
    out[large] = _states(met[large], ones[large])
    return out


def _states(met: np.ndarray, ones: np.ndarray) -> np.ndarray:
    zeros = met - ones
    level = np.searchsorted(_SURE, met, side="right")
    sure = np.where(ones > 0, 15 + level, level)
    step = np.clip(np.floor(np.log((ones + 0.4) / (zeros + 0.4)) * 1.5) + _STEPS // 2, 0, _STEPS - 1).astype(np.int64)
    mixed = 31 + step * len(_MIXED) + np.searchsorted(_MIXED, met, side="right") - 1
    return np.where(met == 0, 0, np.where((ones == 0) | (zeros == 0), sure, mixed)).astype(np.uint8)


_SMALL = _states(*(np.maximum(x, 0) for x in (np.repeat(np.arange(128), 128), np.minimum(np.tile(np.arange(128), 128), np.repeat(np.arange(128), 128)))))


def _prior() -> np.ndarray:
    """What a state's logit is before anything is learned of it."""
    out = np.zeros(256)
    often = np.log((_SURE + 0.4) / 0.4)
    out[1:16], out[16:31] = -often, often
    out[31 : 31 + _STEPS * len(_MIXED)] = np.repeat((np.arange(_STEPS) - _STEPS // 2 + 0.5) / 1.5, len(_MIXED))
    return out




def bit_counts(keys: np.ndarray, met: np.ndarray):
    """For each of the eight bits of the keys' bytes: how often the bits before it were met, and how often a one followed."""
    for bit in range(8):
        at = np.flatnonzero(_new(keys >> np.uint64(8 - bit)))
        times = np.diff(np.append(at, len(keys)))
        one = (keys >> np.uint64(7 - bit) & np.uint64(1)).astype(np.int64)
        yield np.repeat(np.add.reduceat(met, at), times), np.repeat(np.add.reduceat(met * one, at), times), one


def bit_states(keys: np.ndarray, met: np.ndarray) -> np.ndarray:
    """The state of each context before each of the eight bits of the keys' bytes; keys in order."""
    out = np.zeros((len(keys), 8), np.uint8)
    if len(keys):
        for bit, (n, ones, _) in enumerate(bit_counts(keys, met)):
            out[:, bit] = states(n, ones)
    return out


class Mixer:
    """Logits of states, gated weights and the adaptive map."""

    def __init__(self):
        self.logit = np.tile(_prior().astype(np.float32), (KINDS, 1))
        self.weights = np.full((KINDS, _GATES), 0.25, np.float32)
        centre = (np.arange(_MAP) - _MAP // 2) / 2
        self.map = np.tile((1 / (1 + np.exp(-centre))).astype(np.float32), 256)
        self.seen = np.full((KINDS, _GATES), 1e-4, np.float32)

    def learn_states(self, sums: np.ndarray) -> None:
        prior = 1 / (1 + np.exp(-_prior()))
        p = (sums[1] + 4 * prior) / (sums[0] + 4)
        self.logit = np.clip(np.log(p / (1 - p)), -9, 9).astype(np.float32)

    def _predict(self, known, state):
        gate = known + (((state[_LONG] == 0).astype(np.int64) + (state[_LONG - 1] == 0)) << 8)
        logit = [self.logit[o][x] for o, x in enumerate(state)]
        dot = self.weights[0][gate] * logit[0]
        for o in range(1, KINDS):
            dot += self.weights[o][gate] * logit[o]
        x = np.clip(dot * 2 + _MAP // 2, 0, _MAP - 1.001)
        low = x.astype(np.int64)
        part = x - low
        cell = known * _MAP + low
        plain = 1 / (1 + np.exp(-np.clip(dot, -30, 30)))
        return gate, logit, plain, self.map[cell] * (1 - part) + self.map[cell + 1] * part, cell, part

    @staticmethod
    def _bits(byte: np.ndarray):
        sym, known = byte.astype(np.int64), np.ones(len(byte), np.int64)
        for k in range(8):
            bit = sym >> (7 - k) & 1
            yield k, known, bit
            known = known << 1 | bit

    def cost(self, state: list[np.ndarray], byte: np.ndarray) -> np.ndarray:
        """log2 of the probability of each byte, negated; ``state``: for each context its states before the eight bits."""
        product = np.ones(len(byte))
        for k, known, bit in self._bits(byte):
            _, _, plain, refined, _, _ = self._predict(known, [s[:, k] for s in state])
            p = np.clip((plain.astype(np.float64) + refined) / 2, 1e-5, 1 - 1e-5)
            product *= np.where(bit == 1, p, 1 - p)
        return -np.log2(product)

    def learn(self, state: list[np.ndarray], byte: np.ndarray, times: np.ndarray | None = None) -> None:
        """One update after each bit position of the batch; ``times``: how often each event occurs."""
        times = np.ones(len(byte)) if times is None else times
        for k, known, bit in self._bits(byte):
            gate, logit, plain, refined, cell, part = self._predict(known, [s[:, k] for s in state])
            wrong = (bit - plain) * times
            for o, x in enumerate(logit):
                step = np.bincount(gate, weights=wrong * x, minlength=_GATES)
                self.seen[o] += step * step
                self.weights[o] += RATE * step / np.sqrt(self.seen[o])
            miss, high, low = bit - refined, times * part, times * (1 - part)
            hits = np.bincount(cell, weights=low, minlength=256 * _MAP) + np.bincount(cell + 1, weights=high, minlength=256 * _MAP)
            gap = np.bincount(cell, weights=miss * low, minlength=256 * _MAP) + np.bincount(cell + 1, weights=miss * high, minlength=256 * _MAP)
            self.map += gap / np.maximum(hits, 1e-9) * (1 - (1 - MAP_RATE) ** hits)
            np.clip(self.map, 1e-4, 1 - 1e-4, out=self.map)


class Known:
    """The distinct events of a block's texts and what was answered about their contexts."""

    def __init__(self, met: Events | Asked, answers: dict[int, np.ndarray], buckets: int):
        self.keys, self.state, self.met = {}, {}, met
        for kind, keys in met.kinds():
            if kind not in answers:
                continue
            order = np.argsort(bucket_of(kind, keys, buckets), kind="stable")
            got = answers[kind]
            if len(got) != len(keys):
                raise ValueError("a block's answers don't fit its keys")
            self.keys[kind], self.state[kind] = keys, np.empty_like(got)
            self.state[kind][order] = got
        self.byte = met.keys & np.uint64(255)
        self.place = [np.searchsorted(self.keys[o], met.keys & _MASKS[o]).astype(np.int32) for o in range(_LONG)]

    def states_of(self, some) -> list[np.ndarray]:
        """The states of each context before the eight bits of some of the distinct events."""
        return [*(self.state[o][self.place[o][some]] for o in range(_LONG)), self.state[_LONG][some]]

    def score(self, mixer: Mixer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: log10 of its probability, its words and the end, those that are known, and the sum of
        log10(count + 0.5) over them. Each distinct event is priced once."""
        price = np.empty(len(self.byte))
        for i in range(0, len(price), 1 << 14):
            some = slice(i, i + (1 << 14))
            price[some] = mixer.cost(self.states_of(some), self.byte[some])
        out = []
        for keys, inverse, offsets, token, of in self.met.places:
            n = len(offsets) - 1
            each = price[np.searchsorted(self.met.keys, keys)][inverse]
            text, of = np.repeat(np.arange(n), np.diff(offsets) + 1), np.concatenate([of, np.arange(n)])
            count = self.state[_TOKEN][np.searchsorted(self.keys[_TOKEN], np.concatenate([token, np.full(n, _END_WORD)]))]
            out.append((-np.log10(2.0) * np.bincount(text, weights=each, minlength=n), np.bincount(of, minlength=n), np.bincount(of, weights=count > 0, minlength=n).astype(np.int64), np.bincount(of, weights=np.log10(count + 0.5), minlength=n)))
        return tuple(np.concatenate(c) for c in zip(*out))


ASKED = "bucket int, block int, kind int, keys binary, met binary, held binary"


def _asked(tally: Tally, buckets: int, block: int, counts: bool):
    """A row for each bucket and kind."""
    import pyarrow as pa

    types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    for kind, keys, met, held in tally.kinds():
        bucket = bucket_of(kind, keys, buckets)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        some = np.flatnonzero(cut[1:] > cut[:-1]).tolist()
        for i in range(0, len(some), 16):
            own = [order[cut[b] : cut[b + 1]] for b in some[i : i + 16]]
            sent = ([packed(met[x]) if counts else b"" for x in own], [packed(held[x]) if held.any() else b"" for x in own])
            columns = (some[i : i + 16], [block] * len(own), [kind] * len(own), [packed(keys[x]) for x in own], *sent)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["bucket", "block", "kind", "keys", "met", "held"])


TABLE = "bucket int, kind int, keys binary, met binary, held binary, total long, n long"


def count_corpus(train: DataFrame, buckets: int) -> DataFrame:
    """The table of counts: of each bucket and kind its keys, how often they occur in training documents and in those marked
    ``for_mixer``, and the sum and number of the former."""

    def count(batches):
        tally = Tally()
        for batch in batches:
            mixer = np.asarray(batch.column(1).to_numpy(zero_copy_only=False))
            for i, j, data, off in batches_of_text(batch.column(0), _SLICE):
                tally.add(data, off, mixer[i:j])
                if tally.full():
                    yield from _asked(tally, buckets, 0, True)
                    tally = Tally()
        yield from _asked(tally, buckets, 0, True)

    def merge(table):
        import pyarrow as pa

        rows = []
        kinds = np.asarray(table["kind"])
        for kind in np.unique(kinds).tolist():
            own = table.filter(pa.array(kinds == kind))
            keys = [unpacked(x) for x in own["keys"].to_pylist()]
            held = [unpacked(x).astype(np.int64) if x else np.zeros(len(k), np.int64) for x, k in zip(own["held"].to_pylist(), keys)]
            keys, met, held = added(np.concatenate(keys), np.concatenate([unpacked(x).astype(np.int64) for x in own["met"].to_pylist()]), np.concatenate(held))
            rows.append((table["bucket"][0].as_py(), kind, packed(keys), packed(met), packed(held), int(met.sum()), len(keys)))
        types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["bucket", "kind", "keys", "met", "held", "total", "n"])

    parts = train.select("text", "for_mixer").mapInArrow(count, ASKED)
    return parts.groupBy("bucket").applyInArrow(merge, TABLE)


ANSWERS = "block int, bucket int, kind int, states binary, learned binary, keys binary, held binary, sums binary"


def answered(docs: DataFrame, table: DataFrame, buckets: int) -> DataFrame:
    """Of each block of ``docs`` (block, text, train), kind and bucket: the states (for words: the counts) of the keys asked for
    by all counts, and by those without the block's training documents; with the longest contexts these keys and how often they
    occur in the latter. In a row without a block, for each bucket and kind: how often each of the latter states was met in
    training documents, and how often a one followed."""

    def ask(group):
        import pyarrow as pa

        tally = Tally()
        train = np.asarray(group["train"])
        for i, j, data, off in batches_of_text(group["text"], _SLICE):
            tally.add(data, off, train[i:j])
        return pa.Table.from_batches(list(_asked(tally, buckets, group["block"][0].as_py(), False)))

    def answer(asks, counts):
        import pyarrow as pa

        have = {k: (unpacked(a), unpacked(b).astype(np.int64)) for k, a, b in zip(*(counts[x].to_pylist() for x in ("kind", "keys", "met")))}
        kinds = np.asarray(asks["kind"])
        out: list[tuple] = []
        for kind in np.unique(kinds).tolist():
            own = asks.filter(pa.array(kinds == kind))
            wanted = [unpacked(x) for x in own["keys"].to_pylist()]
            keys, met = have.get(kind, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            every, number = added(np.concatenate([keys, *wanted]), np.concatenate([met, np.zeros(sum(map(len, wanted)), np.int64)]))
            places = [np.searchsorted(every, w) for w in wanted]
            rows = list(zip(own["block"].to_pylist(), own["bucket"].to_pylist(), own["held"].to_pylist()))
            if kind == _TOKEN:
                out += [(block, bucket, kind, packed(number[at]), *[None] * 4) for at, (block, bucket, _) in zip(places, rows)]
                continue
            held = [unpacked(h).astype(np.int64) if h else np.zeros(len(at), np.int64) for at, (*_, h) in zip(places, rows)]
            state = [np.zeros((8, len(at)), np.uint8) for at in places]
            learned = [np.zeros((8, len(at)), np.uint8) for at in places]
            sums = np.zeros((2, 256))
            less = [bit_counts(w, h) for w, h in zip(wanted, held)]
            for bit, (n, ones, _) in enumerate(bit_counts(every, number)):
                all_states = states(n, ones)
                for at, h, s, l, own_counts in zip(places, held, state, learned, less):
                    s[bit] = all_states[at]
                    own_n, own_ones, one = next(own_counts)
                    some = np.flatnonzero(h)
                    x = l[bit, some] = states(n[at[some]] - own_n[some], ones[at[some]] - own_ones[some])
                    sums[0] += np.bincount(x, weights=h[some], minlength=256)
                    sums[1] += np.bincount(x, weights=h[some] * one[some], minlength=256)
            events = [(packed(w), packed(h)) if kind == _LONG else (None, None) for w, h in zip(wanted, held)]
            out += [(block, bucket, kind, squeezed(s.tobytes()), squeezed(l.tobytes()), *e, None) for s, l, e, (block, bucket, _) in zip(state, learned, events, rows)]
            out.append((None, rows[0][1], kind, *[None] * 4, sums.tobytes()))
        types = (*[pa.int32()] * 3, *[pa.binary()] * 5)
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["block", "bucket", "kind", "states", "learned", "keys", "held", "sums"])

    asks = docs.groupBy("block").applyInArrow(ask, ASKED).select("bucket", "block", "kind", "keys", "held")
    counts = table.select("bucket", "kind", "keys", "met")
    return asks.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(answer, ANSWERS)


def _got(answers, column: str) -> dict[int, np.ndarray]:
    """Of each kind what was answered, bucket by bucket."""
    import pyarrow as pa

    kinds, bucket = np.asarray(answers["kind"]), np.asarray(answers["bucket"])
    got = {}
    for kind in np.unique(kinds).tolist():
        own = np.flatnonzero(kinds == kind)
        raw = answers[column].take(pa.array(own[np.argsort(bucket[own])])).to_pylist()
        parts = [unpacked(x).astype(np.int64) if kind == _TOKEN else np.frombuffer(loosened(x), np.uint8).reshape(8, -1).T for x in raw]
        got[kind] = np.concatenate(parts)
    return got


def _learned(answers, buckets: int) -> tuple[Known, np.ndarray]:
    """A block's events by the counts without it, and how often each occurs in its training documents."""
    import pyarrow as pa

    longest = answers.filter(pa.array(np.asarray(answers["kind"]) == _LONG))
    keys, times = (np.concatenate([unpacked(x) for x in longest[c].to_pylist()]) for c in ("keys", "held"))
    order = np.argsort(keys)
    return Known(Asked(keys[order]), _got(answers, "learned"), buckets), times[order].astype(np.int64)


def _averaged(parts: DataFrame, groups: int, weight: str, columns: list[str]) -> dict[str, np.ndarray] | None:
    """The sum of ``weight``-ed float64 arrays over all rows, first within groups of rows."""

    def add(table):
        import pyarrow as pa

        w = np.asarray(table[weight])
        sums = [sum(x * np.frombuffer(r, np.float64) for x, r in zip(w, table[c].to_pylist())) for c in columns]
        return pa.table([pa.array([w.sum()], pa.int64()), *(pa.array([np.asarray(x).tobytes()], pa.binary()) for x in sums)], names=[weight, *columns])

    met = parts.withColumn("part", F.pmod(F.col("part"), F.lit(groups))).groupBy("part").applyInArrow(add, f"{weight} long, " + ", ".join(f"{c} binary" for c in columns))
    rows = met.collect()  # as many rows as the root of the parts' number
    if not rows:
        return None
    total = sum(r[weight] for r in rows)
    return {"weight": total} | {c: sum(np.frombuffer(r[c], np.float64) for r in rows) for c in columns}


def fit_mixer(answers: DataFrame, buckets: int, blocks: int) -> Mixer:
    """Learned from all training documents; ``answers``: see ``answered``."""
    mixer = Mixer()
    sums = np.zeros((KINDS, 2, 256))
    for kind in range(KINDS):
        own = _averaged(answers.filter(F.col("block").isNull() & (F.col("kind") == kind)).select(F.col("bucket").alias("part"), F.lit(1).cast("long").alias("one"), "sums"), max(1, round(buckets**0.5)), "one", ["sums"])
        if own:
            sums[kind] = own["sums"].reshape(2, 256)
    if not sums.any():
        return mixer
    mixer.learn_states(sums.transpose(1, 0, 2))
    logit = mixer.logit

    def fit(answers):
        import pyarrow as pa

        own = Mixer()
        own.logit = logit
        known, times = _learned(answers, buckets)
        some = np.random.default_rng(5).permutation(np.flatnonzero(times))
        for k in range(0, len(some), BATCH):
            batch = some[k : k + BATCH]
            own.learn(known.states_of(batch), known.byte[batch], times[batch])
        return pa.table([answers["block"].slice(0, 1).combine_chunks(), pa.array([int(times.sum())], pa.int64()), *(pa.array([x.astype(np.float64).tobytes()], pa.binary()) for x in (own.weights, own.map))], names=["part", "size", "weights", "map"])

    off = answers.filter(F.col("block").isNotNull() & (F.col("kind") != _TOKEN)).select("block", "bucket", "kind", "learned", "keys", "held")
    parts = off.groupBy("block").applyInArrow(fit, "part int, size long, weights binary, map binary")
    got = _averaged(parts, max(1, round(blocks**0.5)), "size", ["weights", "map"])
    if got and got["weight"]:
        mixer.weights = (got["weights"] / got["weight"]).astype(np.float32).reshape(mixer.weights.shape)
        mixer.map = (got["map"] / got["weight"]).astype(np.float32)
    return mixer


SCORES = "doc_id long, n_tokens long, n_known long, base double, score double"


def score_all(docs: DataFrame, answers: DataFrame, mixer: Mixer, buckets: int) -> DataFrame:
    """Scores of all documents (columns doc_id, text, block); base is the sum of log10(count + 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(mixer)  # 60 kB whatever the input

    def price(group, answers):
        import pyarrow as pa

        score, tokens, seen, base = Known(Events(group["text"]), _got(answers, "states"), buckets).score(shared.value)
        return pa.table([group["doc_id"].combine_chunks(), pa.array(tokens), pa.array(seen), pa.array(base), pa.array(score)], names=["doc_id", "n_tokens", "n_known", "base", "score"])

    by_all = answers.filter("block is not null").select("block", "bucket", "kind", "states")
    return docs.groupBy("block").cogroup(by_all.groupBy("block")).applyInArrow(price, SCORES)


def scores(docs: DataFrame, folds: int = 5, held: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("train", F.coalesce(fold(F.col("doc_id"), folds) != held, F.lit(False)))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // block_bytes))
    blocks = max(buckets, FEWEST_BLOCKS)
    table = materialise(count_corpus(docs.filter("train").withColumn("for_mixer", F.lit(False)), buckets), "counts")
    release(docs.sparkSession)
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    answers = materialise(answered(dealt, table, buckets), "answers")
    words = table.filter(F.col("kind") == _TOKEN).agg(F.sum("total").alias("total"), F.sum("n").alias("n")).first()
    tokens, distinct = words["total"] or 0, words["n"] or 0
    discard(table)
    release(docs.sparkSession)
    mixer = fit_mixer(answers, buckets, blocks)
    release(docs.sparkSession)
    got = score_all(dealt, answers, mixer, buckets)
    floor = float(np.log10(tokens + 0.5 * (distinct + 1)))
    held_out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    return got.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(floor)).alias("base_score"), "score")
