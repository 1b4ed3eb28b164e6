"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Each source's documents, shuffled by a hash, form a ring of words that is cut into blocks of ``block_words``. Slot i of the
schedule has the golden-ratio point of i; the cumulative shares of the sources map it to a source; slots are ranked within
their source, and rank j takes block j of the source's ring, over and over, until the source's target is reached. A source
that has too few slots when the schedule ends gets its last blocks then, so what is taken differs from the target by
rounding only. No source is taken more than ``most_times`` times its size, and then no document is either.

Defined results: null texts have size 0 and are taken 0 times; a null source is a source of its own, last; equal rows
count each; an empty table gives no rows; other columns are left out. The hash seed fixes the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, unused

BLOCK_WORDS = 512
MOST_TIMES = 3
WEIGHTS = (1, 2, 3)
_RING = 1 << 31
#: The golden ratio's fractional part times 2^31, made odd (fixed value).
_GOLDEN = 1327217885
_CELL_BITS = 21
_CHUNK = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """One row per source: its number, size and target; targets share the total size by weight, and what lies above
    ``most_times`` times a source's size is shared anew among the others."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # as many rows as there are sources
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("sid"), F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("sid", (F.row_number().over(order) - 1).cast("long")).withColumn("weight", w)
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("cap", (F.col("source_size") * most_times).cast("double"))
    free = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    by = by.withColumn("level", F.greatest(rest, F.lit(0.0)) / free)
    full = F.col("cap") <= F.col("level") * F.col("weight")
    by = by.withColumn("share", F.max(F.when(~full, F.col("level"))).over(whole))
    return by.select("sid", "source", "source_size", F.when(full, F.col("cap")).otherwise(F.least("cap", F.col("share") * F.col("weight"))).alias("target"))


def _running(df: DataFrame, keys: list[str], value: str, order: list, into: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(into, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))


def ring(sizes: DataFrame, seed: int) -> DataFrame:
    """The place ``at`` of each document in its source's shuffled ring of words. Sums go up over two levels of hash
    prefixes, so that a source of any size is spread over many tasks. Rows of one doc_id are told apart by their texts."""
    keyed = sizes.withColumn("h", F.xxhash64("doc_id", "text_hash", F.lit(seed)))
    keyed = keyed.withColumn("g1", F.shiftright("h", 56)).withColumn("g2", F.shiftright("h", 48))
    fine = keyed.groupBy("sid", "g1", "g2").agg(F.sum("size").alias("s"))
    coarse = _running(fine.groupBy("sid", "g1").agg(F.sum("s").alias("s")), ["sid"], "s", ["g1"], "b1").drop("s")
    fine = _running(fine, ["sid", "g1"], "s", ["g2"], "b2").drop("s").join(coarse, ["sid", "g1"])
    fine = fine.select("sid", "g2", (F.col("b1") + F.col("b2")).alias("base"))
    keyed = keyed.drop("g1").join(fine, ["sid", "g2"])
    inner = _running(keyed, ["sid", "g2"], "size", ["h", "doc_id", "size", "text_hash", "key"], "inner")
    return inner.withColumn("at", F.col("base") + F.col("inner")).drop("g2", "h", "base", "inner", "text_hash")


def schedule(plan: DataFrame, block_words: int) -> DataFrame:
    """Slots (sid, rank, position): for each source ranks 0 to slots - 1, placed by the golden-ratio sequence.

    ``plan`` has sid and slots (how many blocks its source needs)."""
    spark = plan.sparkSession
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    plan = plan.filter("slots > 0").withColumn("n", F.sum("slots").over(total))
    low = F.coalesce(F.sum("slots").over(before), F.lit(0)).cast("double") / F.col("n")
    high = (F.coalesce(F.sum("slots").over(before), F.lit(0)) + F.col("slots")).cast("double") / F.col("n")
    parts = plan.withColumn("lo", F.floor(low * _RING)).withColumn("hi", F.floor(high * _RING)).filter("hi > lo")
    cells = parts.withColumn("cell", F.explode(F.expr(f"sequence(shiftright(lo, {_CELL_BITS}), shiftright(hi - 1, {_CELL_BITS}))")))
    n = plan.agg(F.max("n")).first()[0] or 0
    i = F.col("id")
    x = F.pmod(F.pmod(i, F.lit(_RING)) * F.lit(_GOLDEN), F.lit(_RING))
    points = spark.range(n).select(i.alias("position"), x.alias("x")).withColumn("cell", F.shiftright("x", _CELL_BITS))
    hit = points.join(cells.select("cell", "lo", "hi", "sid", "slots"), "cell").filter("x >= lo and x < hi")
    hit = hit.withColumn("chunk", F.floor(F.col("position") / _CHUNK))
    counts = _running(hit.groupBy("sid", "chunk").agg(F.count("*").alias("c")), ["sid"], "c", ["chunk"], "base")
    w = Window.partitionBy("sid", "chunk").orderBy("position")
    ranked = hit.withColumn("r", F.row_number().over(w) - 1).join(counts.select("sid", "chunk", "base"), ["sid", "chunk"])
    ranked = ranked.select("sid", (F.col("base") + F.col("r")).alias("rank"), "position", "slots").filter("rank < slots").drop("slots")
    had = counts.groupBy("sid").agg(F.sum("c").alias("had"))
    late = plan.join(had, "sid", "left").withColumn("had", F.coalesce("had", F.lit(0))).filter("had < slots")
    late = late.select("sid", F.explode(F.expr("sequence(had, slots - 1)")).alias("rank"), "n")
    return ranked.unionByName(late.select("sid", "rank", (F.col("n") + F.col("rank")).alias("position")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes of the document, repeats counted) and first_slot
    (the first place in the schedule that takes any of it; null if none does)."""
    return _mix(docs, F.lit(0).cast("long"), **options).drop("key")


def _mix(docs: DataFrame, key: Column, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES, block_words: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """What ``mix`` gives, and the rows' ``key``."""
    sizes = materialise(docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"), key.alias("key")), "mix-sizes")
    plan = targets(sizes, weights, most_times).withColumn("want", F.round("target").cast("long"))
    blocks = F.ceil(F.col("source_size") / block_words)
    slots = F.when(F.col("source_size") > 0, F.floor(F.col("want") / F.col("source_size")) * blocks + F.ceil(F.pmod("want", "source_size") / block_words)).otherwise(0)
    plan = materialise(plan.withColumn("blocks", blocks.cast("long")).withColumn("slots", slots.cast("long")), "mix-plan")
    placed = schedule(plan.select("sid", "slots"), block_words).join(plan.select("sid", "source_size", "blocks", "want"), "sid")
    # words [begin, stop) of its block that a slot takes: all but in the source's last slot
    begin = F.pmod("rank", "blocks") * block_words
    turn = F.floor(F.col("rank") / F.col("blocks")) * F.col("source_size")
    stop = F.least(begin + block_words, F.col("source_size"), F.col("want") - turn)
    placed = placed.select("sid", F.pmod("rank", "blocks").alias("block"), begin.alias("begin"), stop.alias("stop"), "position")
    # equal takes of a block become one row before the join: whole ones, and at most one part
    takes = placed.groupBy("sid", "block", "begin", "stop").agg(F.count("*").alias("times"), F.min("position").alias("position"))

    known = sizes.withColumn("known", F.struct("source"))
    named = plan.select(F.struct("source").alias("known"), "sid", "source_size", "target")
    laid = ring(known.join(named, "known").drop("known"), seed)
    spans = laid.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(at div {block_words}, (at + size - 1) div {block_words})")))
    met = spans.join(takes, ["sid", "block"])
    overlap = F.greatest(F.least(F.col("at") + F.col("size"), F.col("stop")) - F.greatest("at", "begin"), F.lit(0)) * F.col("times")
    met = met.withColumn("words", overlap).filter("words > 0")
    taken = met.groupBy("sid", "at").agg(F.sum("words").alias("taken"), F.min("position").alias("first_slot"))
    some = laid.filter("size > 0").join(taken, ["sid", "at"], "left")
    none = laid.filter("size = 0").withColumn("taken", F.lit(None).cast("long")).withColumn("first_slot", F.lit(None).cast("long"))
    return some.unionByName(none).select("doc_id", "key", "size", "source_size", F.col("target").cast("double").alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def resample(docs: DataFrame, **options) -> DataFrame:
    """The documents, each repeated as many times as the mix takes it, rounded: all columns, rows per document 0 to
    ``most_times``. Each row counts by itself, also one whose doc_id is null or another row's; rows without words are taken 0
    times and go. Rows are numbered in a copy in the shared folder, so that both reads of them see the same numbers."""
    names = docs.columns
    times, copy, number, key = (unused(names, c) for c in ("times", "copy", "number", "row_key"))
    numbered = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "mix-rows")
    counted = _mix(numbered, F.col(number), **options).filter("size > 0").select(F.col("key").alias(key), F.round(F.col("taken") / F.col("size")).cast("int").alias(times))
    met = numbered.join(counted.filter(F.col(times) > 0), F.col(number) == F.col(key))
    return met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*names)
