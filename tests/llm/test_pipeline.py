import test_neardup
import test_repeats
from helpers import AWKWARD, corpus, table

import corpus_pipeline
from stratavane.llm import mixing, packing, quality
from stratavane.llm.queries import ORACLES, QUERIES


def test_stages_over_awkward_rows(spark, tmp_path):
    rows = corpus(12, 60) + AWKWARD
    docs = table(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert final.filter("length > 2048 or offset + length > 2048").count() == 0 and final.count() > 20


def rows_of(df):
    return sorted(((r["doc_id"], r["text"], r["source"]) for r in df.collect()), key=str)


def test_each_stage_does_to_every_row_what_it_should(spark, tmp_path):
    """Awkward rows and all others, followed through the stages by brute force."""
    rows = sorted(corpus(13, 80) + AWKWARD + [(1001, "a second text of one id " * 9, "b"), (None, "w " * 30, "a")], key=str)
    docs = table(spark, rows)
    labels = spark.createDataFrame([(r[0], int(k % 3 > 0), 0) for k, r in enumerate(rows) if r[0] is not None], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    good, near, cut, mixed, packed = (stage for _, stage in corpus_pipeline.STAGES)
    at = str(tmp_path)
    weights = quality.train(docs, labels)
    scores = {(r["doc_id"], r["text"]): r["score"] for r in quality.score(docs, weights, ("doc_id", "text")).collect()}
    kept = [r for r in rows if scores[r[:2]] >= 0.5]
    assert rows_of(good(spark, docs, at)) == kept and len(kept) > 20
    rows = kept
    alive = {i for i, _, component, keep in test_neardup.brute(rows, 80) if keep}
    kept = [r for r in rows if r[0] is None or r[0] in alive]
    assert rows_of(near(spark, table(spark, rows), at)) == kept and len(kept) < len(rows)
    rows = kept
    got = rows_of(cut(spark, table(spark, rows), at))
    left = {}
    for i, n, removed, *_ in test_repeats.brute(rows):
        left.setdefault(i, []).append(n - removed)
    for i in {r[0] for r in rows}:  # no text here loses a part of a character
        assert sorted(len((t or "").encode()) for j, t, _ in got if j == i) == sorted(left[i])
    assert [(i, s) for i, _, s in got] == [(i, s) for i, _, s in rows]
    rows = got
    taken = {}
    for r in mixing.mix(table(spark, rows)).collect():
        taken.setdefault((r["doc_id"], r["size"]), []).append(round(r["taken"] / r["size"]) if r["size"] else 0)
    got = rows_of(mixed(spark, table(spark, rows), at))
    assert len(got) == sum(map(sum, taken.values())) and set(got) <= set(rows)
    rows = got
    pieces = lambda df: sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect()), key=str)
    found = packed(spark, table(spark, rows), at)
    assert pieces(found) == pieces(packing.pieces(table(spark, rows), "byte_bpe_50k.json"))
    ends = {}
    for r in sorted(found.collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048


def test_near_copies_of_similarity_from_80_per_cent_go(spark, tmp_path):
    rows = []
    for k in range(20):  # 200 of 244 shingles are shared (0.82), and 20 of 32 (0.63)
        text = [f"w{k}x{i}" for i in range(204)]
        rows.append((10 * k, " ".join(text + [f"b{k}x{i}" for i in range(22)]), "s"))
        rows.append((10 * k + 1, " ".join(text + [f"c{k}x{i}" for i in range(22)]), "s"))
        rows.append((10 * k + 2, " ".join(f"d{k}x{i}" for i in range(30)), "s"))
        rows.append((10 * k + 3, " ".join([f"d{k}x{i}" for i in range(24)] + [f"e{k}x{i}" for i in range(6)]), "s"))
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, table(spark, rows), str(tmp_path)).collect()}
    assert kept == {10 * k + d for k in range(20) for d in (0, 2, 3)}


def test_registered_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
