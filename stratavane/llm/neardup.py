"""Near-duplicate documents by min-max hashing.

Under each of ``PERMUTATIONS`` hash functions both the smallest and the largest value of a document's shingle set are kept,
so half as many evaluations give a signature of as many values, whose agreement is an unbiased estimate of the similarity
with a lower variance than minima alone. Bands of ``ROWS`` values make candidates: a pair at the threshold of 0.85 shares
none of the 25 bands with a probability of 4e-7. Every link is confirmed on the full shingle sets.

Documents of equal sets form a class, which goes on as one node. Within a band's bucket no pairs are spelled out: members are
compared with a hub first, the member of most and largest buckets. What stays split goes on by differences from the hub h: the
shingles that a member has beyond h, and those of h that it lacks. Sets u and v are similar if their intersection is at least
s * (|u| + |v|); then their differences share R = s * (|u| + |v|) - |h| + lacks(u) + lacks(v) elements or more. Where u isn't
similar to h, R is over (1 - s) * lacks(v) + s * has(v), and at least (s * (|u| + |h|) - |u and h|) / (1 - s), both over 0. Pairs
that are both similar to h are linked through it. So in one order of all differences from h two such sets first meet where
each has R elements left. The order is from rare to common, counted over all members: what only one member has comes first
and meets nothing, and the edits that many members share come last, where few elements are left. Members that meet are
compared if they are of different components and R elements are left from there to both ends; buckets of at most ``SMALL``
members are compared at once. Nothing is capped.

Defined results: null and empty texts, and texts without words, have no shingles and are linked with nothing; texts under
``SHINGLE_WORDS`` words have one shingle; rows with one doc_id are one document, linked with what any of them is linked
with; rows with a null doc_id are linked with nothing and kept; an empty table gives no rows; other columns are left out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _LOWER, _MULT, batches_of_text, discard, distinct, hash_ranges, materialise, mix64, word_ranges
from .components import connected_components

SHINGLE_WORDS = 5
PERMUTATIONS = 64
ROWS = 5
BANDS = 2 * PERMUTATIONS // ROWS
THRESHOLD = 85  # per cent
#: Members of a bucket up to which those of different components are compared without a look at differences first.
SMALL = 8
_RNG = np.random.default_rng(85)
_A = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_ORDER = _RNG.permutation(2 * PERMUTATIONS)[: BANDS * ROWS]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    starts, ends, text = word_ranges(data, offsets)
    low = _LOWER[data]
    k = SHINGLE_WORDS
    with np.errstate(over="ignore"):
        word = hash_ranges(low, starts, ends)
        n = max(len(word) - k + 1, 0)
        total = np.zeros(n, np.uint64)
        for i in range(k):
            total = total * _MULT + word[i : n + i]
        total = mix64(total)
    cut = np.searchsorted(text, np.arange(len(offsets)))
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if b - a >= k:
            out.append(distinct(total[a : b - k + 1]))
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in word[a:b]:
                    h = h * _MULT + w
                out.append(mix64(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima and maxima under every permutation."""
    low, high = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 2048):
            v = _A[:, None] * shingles[None, i : i + 2048] + _B[:, None]
            low, high = np.minimum(low, v.min(axis=1)), np.maximum(high, v.max(axis=1))
    return np.concatenate([low, high])


def band_keys(signatures: np.ndarray) -> np.ndarray:
    picked = signatures[:, _ORDER].reshape(len(signatures), BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signatures), 1))
        for i in range(ROWS):
            key = mix64(key * _MULT + picked[:, :, i])
    return key


def _keys(shingles: np.ndarray) -> tuple[int, int]:
    """Two keys of a set, as signed numbers."""
    with np.errstate(over="ignore"):
        both = np.array([shingles.sum(dtype=np.uint64) ^ np.uint64(len(shingles)), mix64(shingles + _MULT).sum(dtype=np.uint64)], np.uint64)
    return tuple(both.view(np.int64).tolist())


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the set's two keys and its band keys, for every row."""

    def sketch(batches):
        import pyarrow as pa

        for batch in batches:
            for i, j, data, off in batches_of_text(batch.column(1)):
                sets = shingle_sets(data, off)
                n = np.array([len(s) for s in sets], np.int64)
                k1, k2 = zip(*(_keys(s) for s in sets))
                full = n > 0
                bands = np.zeros((0, BANDS), np.uint64)
                if full.any():
                    bands = band_keys(np.stack([signature(s) for s in sets if len(s)]))
                ends = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.reshape(-1).view(np.int64)))],
                    names=["doc_id", "n", "k1", "k2", "bands"],
                )

    return _texts(docs).mapInArrow(sketch, "doc_id long, n long, k1 long, k2 long, bands array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def shingle_table(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n and the sorted shingle hashes of each of ``nodes`` (doc_id, node), from the texts of their documents."""

    def sets(batches):
        import pyarrow as pa

        for batch in batches:
            for i, j, data, off in batches_of_text(batch.column(1)):
                found = shingle_sets(data, off)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*(_keys(s) for s in found))), pa.array([s.tobytes() for s in found], pa.binary())], names=["k1", "k2", "shingles"])

    wanted = nodes.select("doc_id").distinct()
    got = docs.join(wanted, "doc_id", "left_semi").mapInArrow(sets, "k1 long, k2 long, shingles binary")
    return got.select(F.xxhash64("k1", "k2").alias("node"), "shingles").join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _differences(a: np.ndarray, b: np.ndarray, hub: int, threshold: int, deep: bool) -> tuple[bool, int, np.ndarray]:
    """Whether the sets are similar, how many of the hub's set b are not in a, and, where ``deep``, keys of all differences."""
    shared = b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a
    common = int(shared.sum())
    linked = common > 0 and 100 * common >= threshold * (len(a) + len(b) - common)
    if not deep:
        return linked, len(b) - common, a[:0]
    missing = np.ones(len(b), bool)
    missing[np.searchsorted(b, a[shared])] = False
    salt = np.array([hub], np.int64).view(np.uint64) * _MULT
    return linked, len(b) - common, np.concatenate([mix64(a[~shared] ^ salt), mix64(~b[missing] ^ salt)])


def compare(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """u, v, whether their full sets are similar, these sets' sizes, how many of v's elements u lacks, and, where ``deep``, keys
    of u's differences from v."""

    def check(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            with np.errstate(over="ignore"):
                for v, deep, a, b in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                    a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                    linked, lacks, keys = _differences(a, b, v, threshold, deep)
                    rows.append((linked, len(a), len(b), lacks, keys.view(np.int64)))
            linked, n, n_v, lacks, keys = zip(*rows) if rows else [()] * 5
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            numbers = [pa.array(c, pa.int64()) for c in (n, n_v, lacks)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), *numbers, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["u", "v", "linked", "n", "n_v", "lacks", "keys"])

    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("set_u"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("set_v"))
    met = pairs.join(left, "u").join(right, "v").select("u", "v", "deep", "set_u", "set_v")
    return met.mapInArrow(check, "u long, v long, linked boolean, n long, n_v long, lacks long, keys array<long>")


def meetings(checked: DataFrame, comps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Distinct pairs (u, v) of different components among which are all similar ones that were compared with one hub, by the
    differences in ``checked`` (see ``compare``)."""
    t = threshold
    has = F.size("keys") - F.col("lacks")
    own = F.floor((100 * F.col("lacks") + t * has) / (100 + t)) + 1
    far = F.ceil((t * (F.col("n") + F.col("n_v")) - (100 + t) * (F.col("n_v") - F.col("lacks"))) / 100)
    far = F.when(F.col("linked"), own).otherwise(F.greatest(far, F.lit(1)))
    # ``far`` elements are shared with any, ``near`` where the other one isn't similar to the hub either
    each = checked.select(F.col("u").alias("node"), F.col("v").alias("hub"), "linked", "n", "n_v", "lacks", far.alias("far"), F.greatest(own, far).alias("near"), F.explode("keys").alias("bucket"))
    going = each.groupBy("bucket").agg(F.count("*").alias("c"), F.max(~F.col("linked")).alias("some")).filter("c > 1 and some").select("bucket", "c")
    # elements from this one to the end; those that aren't going come before
    order = Window.partitionBy("node", "hub").orderBy(F.desc("c"), F.desc("bucket"))
    first = each.join(going, "bucket").withColumn("left", F.row_number().over(order)).filter("left >= far")
    first = first.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("hub", "far", "c", "component")
    split = first.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(~F.col("linked")).alias("some")).filter("lo < hi and some").select("bucket")
    first = materialise(first.join(split, "bucket"), "differences")
    other = first.select("bucket", *(F.col(c).alias(f"{c}_2") for c in ("node", "linked", "n", "lacks", "near", "left", "comp")))
    enough = f"{100 + t} * least(left, left_2) >= {t} * (n + n_2) - {100 + t} * (n_v - lacks - lacks_2)"
    met = first.join(other, "bucket").filter("comp < comp_2 and not (linked and linked_2)").filter("(linked_2 or left >= near) and (linked or left_2 >= near_2)").filter(enough)
    out = materialise(met.select(F.least("node", "node_2").alias("u"), F.greatest("node", "node_2").alias("v")).distinct(), "meetings")
    discard(first)
    return out


def _one_of_equals(member: DataFrame) -> DataFrame:
    """Of buckets that hold the same nodes one is enough; those of a single node go."""
    kinds = member.groupBy("bucket").agg(F.count("*").alias("c"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node", F.lit(3))).alias("y")).filter("c > 1")
    shared = kinds.groupBy("c", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", F.col("c").alias("size"))
    return member.join(shared, "bucket").select("bucket", "node", "size")


def _with_hub(member: DataFrame) -> DataFrame:
    """Each bucket's members and its hub: the member whose buckets are most and largest."""
    centre = member.groupBy("node").agg(F.sum("size").alias("weight"))
    hubs = member.join(centre, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node"))["node"].alias("hub"))
    return member.join(hubs, "bucket")


def links(member: DataFrame, sets: DataFrame, threshold: int = THRESHOLD, small: int = SMALL) -> DataFrame:
    """Confirmed links (u, v) that connect all nodes of ``member`` (bucket, node, size) which share a bucket and are similar,
    directly or through others; ``sets`` has the nodes' shingles."""
    # first each node against one hub: that of most of its buckets
    votes = _with_hub(member).filter("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("votes"))
    best = votes.groupBy("node").agg(F.max_by("hub", F.struct("votes", "hub")).alias("hub"))
    shallow, deep = F.lit(False).alias("deep"), F.lit(True).alias("deep")
    checked = materialise(compare(best.select(F.col("node").alias("u"), F.col("hub").alias("v"), shallow), sets, threshold), "checked")
    found = checked.filter("linked").select("u", "v")
    placed = member.join(connected_components(found), "node", "left").select("bucket", "node", "size", F.coalesce("component", "node").alias("comp"))
    split = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("bucket")
    open_ = materialise(placed.join(split, "bucket"), "open")
    # what stays split: small buckets pair by pair, others against a hub again, with all differences
    near = open_.filter(F.col("size") <= small)
    other = near.select("bucket", F.col("node").alias("v"), F.col("comp").alias("comp_v"))
    pairs = near.join(other, "bucket").filter("comp < comp_v").select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v"), shallow)
    hubs = _with_hub(open_.filter(F.col("size") > small)).filter("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"), deep)
    checked = materialise(compare(pairs.unionByName(hubs).distinct(), sets, threshold), "checked")
    found = found.unionByName(checked.filter("linked").select("u", "v"))
    met = meetings(checked, connected_components(found), threshold)
    last = materialise(compare(met.withColumn("deep", F.lit(False)), sets, threshold), "checked")
    discard(open_, met)
    return found.unionByName(last.filter("linked").select("u", "v"))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept, for every row."""
    docs = _texts(docs)
    sketch = materialise(sketches(docs).withColumn("node", F.xxhash64("k1", "k2")).drop("k1", "k2"), "sketches")
    whole = sketch.filter("n > 0 and doc_id is not null")
    classes = materialise(whole.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    banded = classes.select("node", F.explode("bands").alias("bucket"))
    member = materialise(_one_of_equals(banded), "buckets")
    wanted = classes.join(member.select("node").distinct(), "node", "left_semi").select(F.col("rep").alias("doc_id"), "node")
    sets = materialise(shingle_table(docs, wanted), "shingles")
    found = links(member, sets, threshold)
    discard(member, sets)
    # rows of one doc_id in several classes tie these together
    several = whole.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("top")).filter("v < top").select("doc_id", "v")
    ties = materialise(whole.select("doc_id", F.col("node").alias("u")).join(several, "doc_id").filter("u <> v").select("u", "v").distinct(), "ties")
    met = classes.select("node", "rep").join(connected_components(found.unionByName(ties)), "node")
    least = met.groupBy("component").agg(F.min("rep").alias("least"))
    reached = met.join(least, "component").select("node", "least")
    named = classes.select("node", "rep").join(reached, "node", "left").select("node", F.coalesce("least", "rep").alias("component"))
    out = sketch.select("doc_id", "n", "node").join(named, "node", "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows, all columns, of one document of each group: that of the smallest doc_id."""
    gone = near_duplicates(docs, threshold).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
