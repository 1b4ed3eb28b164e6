import collections
import math
import re
import zlib

import numpy as np
import pytest
from helpers import AWKWARD, corpus, table

from stratavane.llm import mixlm


def brute(rows):
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None]
    fold = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 5
    count = collections.Counter(w for i, t, *_ in rows if fold(i) not in (None, 1) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    out = []
    for i, t, *_ in rows:
        w = tokens(t)
        out.append((str(i), fold(i) == 1, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)))
    return sorted(out)


def test_unigram_scores_and_model(spark):
    rows = corpus(11, 150) + AWKWARD
    got = mixlm.scores(table(spark, rows).repartition(3), block_bytes=20_000).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == brute(rows)
    size = {i: len((t or "").encode()) for i, t, *_ in rows}
    held = [r for r in got if r["held_out"] and size[r["doc_id"]] > 50]
    bits = [-r["score"] / math.log10(2) / size[r["doc_id"]] for r in held]
    assert all(r["score"] < 0 for r in got) and np.mean(bits) < 4.5  # of 8


def test_empty_table(spark):
    assert mixlm.scores(table(spark, [])).collect() == []


def test_nothing_to_learn_from(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1]
    got = mixlm.scores(table(spark, [(i, "some text", "a") for i in held])).collect()
    assert {(r["n_known"], r["train_tokens"]) for r in got} == {(0, 0)} and all(math.isfinite(r["score"]) for r in got)


def joined(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def contexts(text, at):
    """All contexts of the byte at ``at``, written out."""
    padded = bytes(7) + text
    return [padded[at + 7 - k : at + 7] for k in mixlm.BYTES]


def slow_counts(texts):
    count = collections.Counter()
    for t in texts:
        for at, byte in enumerate([*t, 0]):
            for kind, c in enumerate(contexts(t, at)):
                for k in range(8):
                    before = (1 << k) | byte >> (8 - k)
                    count[kind, c, before, byte >> (7 - k) & 1] += 1
    return count


def slow_score(mixer, count, text):
    """Bit by bit, in plain Python."""
    total = 0.0
    for at, byte in enumerate([*text, 0]):
        for k in range(8):
            before, bit = (1 << k) | byte >> (8 - k), byte >> (7 - k) & 1
            state = []
            for kind, c in enumerate(contexts(text, at)):
                zeros, ones = count[kind, c, before, 0], count[kind, c, before, 1]
                state.append(int(mixlm.states(np.array([zeros + ones]), np.array([ones]))[0]))
            gate = before + 256 * ((state[-2] == 0) + (state[-1] == 0))
            dot = sum(float(mixer.weights[o][gate]) * float(mixer.logit[o][x]) for o, x in enumerate(state))
            place = min(max(dot * 2 + 16, 0), 31.999)
            low = int(place)
            refined = mixer.map[before * 33 + low] * (1 - place + low) + mixer.map[before * 33 + low + 1] * (place - low)
            p = min(max((1 / (1 + math.exp(-dot)) + refined) / 2, 1e-5), 1 - 1e-5)
            total += math.log10(p if bit else 1 - p)
    return total


def known_of(texts, learned, buckets=3):
    """What a block of ``texts`` is answered, with counts of ``learned``."""
    import pyarrow as pa

    ours, asked = mixlm.Tally(), mixlm.Events(pa.array(texts, pa.binary()))
    ours.add(*joined(learned))
    have, answers = {k: (a, b) for k, a, b, _ in ours.kinds()}, {}
    for kind, keys in asked.kinds():
        every, met = mixlm.added(np.concatenate([have[kind][0], keys]), np.concatenate([have[kind][1], np.zeros(len(keys), np.int64)]))
        order = np.argsort(mixlm.bucket_of(kind, keys, buckets), kind="stable")
        got = met if kind == mixlm._TOKEN else mixlm.bit_states(every, met)
        answers[kind] = got[np.searchsorted(every, keys)][order]
    return mixlm.Known(asked, answers, buckets)


LEARNED = [b"an expectation of rain", b"An Expectation of\train\x00\xc3\xa9", b"a new station opens", b""] * 3
TEXTS = [b"an expectation of rain", b"the information desk", b"a new station opens", b"its foundation holds", b"", b"\x00NUL \xc3\xa9"]


def a_mixer():
    rng, mixer = np.random.default_rng(2), mixlm.Mixer()
    mixer.weights = (mixer.weights + rng.normal(0, 0.05, mixer.weights.shape)).astype(np.float32)
    mixer.map = np.clip(mixer.map + rng.normal(0, 0.01, mixer.map.shape), 1e-4, 1 - 1e-4).astype(np.float32)
    return mixer


def test_scores_agree_with_a_slow_model_and_do_not_depend_on_other_texts():
    mixer, count = a_mixer(), slow_counts(LEARNED)
    together = known_of(TEXTS * 2, LEARNED).score(mixer)[0]
    for k, text in enumerate(TEXTS):
        want = slow_score(mixer, count, text)
        assert together[k] == pytest.approx(want, rel=1e-4)
        assert known_of([text], LEARNED).score(mixer)[0][0] == together[k] == together[k + len(TEXTS)]


def test_probabilities_of_all_bytes_sum_to_one():
    mixer, text = a_mixer(), TEXTS[0]
    every = [text[:7] + bytes([b]) for b in range(256)]
    known = known_of(every, LEARNED)
    places = [np.searchsorted(known.met.keys, keys)[inverse] for keys, inverse, *_ in known.met.places]
    at = np.concatenate(places).reshape(256, 9)[:, 7]
    cost = mixer.cost(known.states_of(at), known.byte[at])
    assert np.sum(2.0**-cost) == pytest.approx(1, abs=0.01)


def test_learning_lowers_the_cost():
    mixer = mixlm.Mixer()
    learned = [b"the cat sat on the mat and the hat "] * 5
    known = known_of(learned, learned)
    state = known.states_of(slice(None))
    before = mixer.cost(state, known.byte).sum()
    for _ in range(20):
        mixer.learn(state, known.byte)
    assert mixer.cost(state, known.byte).sum() < 0.8 * before


@pytest.mark.parametrize("gather", [50, 2_000_000])
def test_the_table_counts_all_training_documents_and_those_of_the_mixer(spark, monkeypatch, gather):
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixlm, "_GATHER", gather)
    rows = [(i, f"text number {i} of the corpus", "a") for i in range(40)]
    docs = table(spark, rows).select("doc_id", "text").withColumn("for_mixer", F.col("doc_id") % 8 == 0)
    got = {}
    for r in mixlm.count_corpus(docs.repartition(3), 3).collect():
        for key, met, held in zip(*(mixlm.unpacked(r[c]).tolist() for c in ("keys", "met", "held"))):
            assert (r["kind"], key) not in got
            got[r["kind"], key] = met, held
    want = {}
    for part, keep in ((0, rows), (1, [r for r in rows if r[0] % 8 == 0])):
        key, _, token, _ = mixlm.events(*joined([r[1].encode() for r in keep]))
        kinds = [(o, key & mixlm._MASKS[o]) for o in range(len(mixlm.BYTES))] + [(mixlm._TOKEN, np.concatenate([token, np.full(len(keep), mixlm._END_WORD)]))]
        for kind, keys in kinds:
            for k, n in collections.Counter(keys.tolist()).items():
                want.setdefault((kind, k), [0, 0])[part] = n
    assert got == {k: tuple(v) for k, v in want.items()}


def test_the_mixer_learns_from_every_training_document(spark, monkeypatch):
    rows, sizes, averaged = corpus(12, 90) + AWKWARD, [], mixlm._averaged

    def recording(parts, groups, weight, columns):
        got = averaged(parts, groups, weight, columns)
        sizes.extend([got["weight"]] if weight == "size" else [])
        return got

    monkeypatch.setattr(mixlm, "_averaged", recording)
    mixlm.scores(table(spark, rows))
    assert sizes == [sum(len((t or "").encode()) + 1 for i, t, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1)]


def test_a_block_is_learned_by_the_counts_of_the_others(spark):
    from pyspark.sql import functions as F

    texts = [*LEARNED, *TEXTS, b"the information desk"]
    docs = spark.createDataFrame([(k, k % 3, k % 4 > 0, t.decode()) for k, t in enumerate(texts)], "doc_id long, block int, train boolean, text string")
    counted = mixlm.count_corpus(docs.filter("train").withColumn("for_mixer", F.lit(False)), 2)
    answers = mixlm.answered(docs, counted, 2).toArrow()
    for block in range(3):
        own = [t for k, t in enumerate(texts) if k % 3 == block and k % 4]
        count = slow_counts([t for k, t in enumerate(texts) if k % 3 != block and k % 4])
        asked = (np.asarray(answers["block"].fill_null(-1)) == block) & (np.asarray(answers["kind"]) != mixlm._TOKEN)
        known, times = mixlm._learned(answers.filter(asked), 2)
        assert times.sum() == sum(len(t) + 1 for t in own)
        want = {}
        for t in own:
            for at, byte in enumerate([*t, 0]):
                met = [[(count[kind, c, before, 0], count[kind, c, before, 1]) for before in ((1 << k) | byte >> (8 - k) for k in range(8))] for kind, c in enumerate(contexts(t, at))]
                want[int.from_bytes(contexts(t, at)[-1] + bytes([byte]), "big")] = [[int(mixlm.states(np.array([z + o]), np.array([o]))[0]) for z, o in kind] for kind in met]
        some = np.flatnonzero(times)
        state = known.states_of(some)
        assert {int(key): [s[j].tolist() for s in state] for j, key in enumerate(known.met.keys[some])} == want
    sums = answers.filter(np.asarray(answers["kind"]) == 0)["sums"].drop_null().to_pylist()
    assert sum(np.frombuffer(x).reshape(2, 256)[0].sum() for x in sums) == 8 * sum(len(t) + 1 for k, t in enumerate(texts) if k % 4)
