"""Bit-matrix evaluation of small components, for recursions over pairs of integers that join derived relations with each other.

Where every rule's body is connected by its variables, a derived pair lies within one connected component of the pairs that
the rules read. So the rows are dealt by component, and the rules are evaluated over many small components at once: a relation
is a matrix for each of them, and a rule is a product of matrices. Joins then cost no shuffle, and a pair that is found in many
ways costs no row for each. Components of more than ``NODES`` values or ``EDGES`` rows are left to the iteration of
``fixpoint``, whole; so is everything where components aren't local enough to be found in two passes, or where a row holds a null.

Components are found within chunks of a range of values first, and then among the chunks that share a value."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import drop_path, fresh_path, store
from .analysis import INTEGRAL, Stratum
from .ast import Atom, Program, Rule, Var, Wild, variables

NODES, EDGES = 64, 1024
#: Links between chunks up to which one task joins them.
LINKS = 1_000_000
_CHUNK = 1 << 19
_BLOCK = 1 << 16
_CELLS = 1 << 20

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors needn't have this package


def _connected(rule: Rule) -> bool:
    rest = [set(variables(a)) for a in rule.atoms]
    reached = rest.pop(0)
    while met := [v for v in rest if v & reached]:
        rest = [v for v in rest if not v & reached]
        reached = reached.union(*met)
    return not rest


def fits(program: Program, stratum: Stratum) -> bool:
    """Whether all rules are connected joins of integer pairs, and some rule joins derived relations with each other."""
    rules = (*stratum.base, *stratum.recursive)
    for rule in rules:
        if not rule.body or rule.flags or not all(isinstance(x, Atom) for x in rule.body):
            return False
        for atom in (rule.head, *rule.atoms):
            if len(atom.args) != 2 or any(a.type not in INTEGRAL for a in program.relations[atom.relation].attributes):
                return False
        if not all(isinstance(a, Var) for a in rule.head.args) or not all(isinstance(a, Var | Wild) for x in rule.atoms for a in x.args):
            return False
        if not all(variables(a) for a in rule.atoms) or not _connected(rule):
            return False
    return any(sum(a.relation in stratum.relations for a in r.atoms) > 1 for r in stratum.recursive)


def roots(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of each edge, the smallest value that it is connected with."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    up = np.arange(len(names))
    a, b = at[: len(u)], at[len(u) :]
    while True:
        a, b = up[a], up[b]
        apart = a != b
        if not apart.any():
            return names[up[at[: len(u)]]]
        a, b = a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (nxt := up[up]).tobytes() != up.tobytes():
            up = nxt


def _chunks(batches, rows: int):
    held, n = [], 0
    for batch in batches:
        held.append([np.asarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns])
        n += batch.num_rows
        if n >= rows:
            yield [np.concatenate(c) for c in zip(*held)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held)]


def _batch(names: str, *columns: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names.split())


class Rules:
    """The rules of a stratum as products of matrices."""

    def __init__(self, stratum: Stratum, inputs: list[str]):
        self.names = [*stratum.relations, *inputs]
        self.n_derived = len(stratum.relations)
        self.base = [self._product(r) for r in stratum.base]
        self.recursive = [self._product(r) for r in stratum.recursive]

    def _product(self, rule: Rule) -> tuple[int, str, list[int], bool]:
        letters: dict[str, str] = {}
        free = iter("abcdefghijklmnopqrstuvwxyABCDEFGHIJKLMNOPQRSTUVWXY")
        terms = ["Z" + "".join(next(free) if isinstance(a, Wild) else letters.get(a.name) or letters.setdefault(a.name, next(free)) for a in atom.args) for atom in rule.atoms]
        head = "".join(letters[a.name] for a in rule.head.args)
        same = head[0] == head[1]
        return self.names.index(rule.head.relation), ",".join(terms) + "->Z" + (head[0] if same else head), [self.names.index(a.relation) for a in rule.atoms], same

    def _apply(self, product, held: list[np.ndarray], into: list[np.ndarray]) -> None:
        head, text, atoms, same = product
        got = np.einsum(text, *(held[i] for i in atoms), optimize="greedy" if len(atoms) > 2 else False) > 0
        if same:
            i = np.arange(got.shape[1])
            into[head][:, i, i] = np.maximum(into[head][:, i, i], got)
        else:
            np.maximum(into[head], got, out=into[head])

    def settle(self, held: list[np.ndarray]) -> None:
        """Fills the derived relations' matrices, component by rows and columns, from the inputs'."""
        for product in self.base:
            self._apply(product, held, held)
        live = np.arange(len(held[0]))
        while len(live):
            own = [m[live] for m in held]
            before = [m.sum(axis=(1, 2)) for m in own[: self.n_derived]]
            for product in self.recursive:
                self._apply(product, own, own)
            grown = np.any([m.sum(axis=(1, 2)) > b for m, b in zip(own, before)], axis=0)
            for m, o in zip(held[: self.n_derived], own):
                m[live] = o
            live = live[grown]

    def solve(self, comp: np.ndarray, rel: np.ndarray, x: np.ndarray, y: np.ndarray):
        """(relation, x, y) of all derived pairs of whole components; those that are too large come back as they are, with
        relations counted on behind the derived ones."""
        n, d = len(comp), self.n_derived
        value, owner = np.concatenate([x, y]), np.concatenate([comp, comp])
        order = np.lexsort((value, owner))
        v, o = value[order], owner[order]
        new_owner = np.concatenate([[True], o[1:] != o[:-1]])
        new = new_owner | np.concatenate([[True], v[1:] != v[:-1]])
        node = np.empty(2 * n, np.int64)
        node[order] = np.cumsum(new) - 1
        values, first = v[new], np.flatnonzero(new_owner[new])
        number = np.cumsum(new_owner[new]) - 1
        place = np.arange(len(values)) - first[number]
        size = np.diff(np.append(first, len(values)))
        own, px, py = number[node[:n]], place[node[:n]], place[node[n:]]
        large = size[own] > NODES
        if large.any():
            yield (rel[large] + d).astype(np.int32), x[large], y[large]
        at = np.empty(len(size), np.int64)
        least = 0
        for k in (4, 8, 16, 32, NODES):
            fit = np.flatnonzero((size > least) & (size <= k))
            least = k
            step = max(1, _CELLS // (k * k))
            for lo in range(0, len(fit), step):
                some = fit[lo : lo + step]
                at[:] = -1
                at[some] = np.arange(len(some))
                held = [np.zeros((len(some), k, k), np.float32) for _ in self.names]
                edges = np.flatnonzero(at[own] >= 0)
                for i in range(d, len(self.names)):
                    e = edges[rel[edges] == i - d]
                    held[i][at[own[e]], px[e], py[e]] = 1
                self.settle(held)
                names = np.zeros((len(some), k), np.int64)
                inside = np.flatnonzero(at[number] >= 0)
                names[at[number[inside]], place[inside]] = values[inside]
                for i in range(d):
                    c, a, b = np.nonzero(held[i])
                    yield np.full(len(c), i, np.int32), names[c, a], names[c, b]


def _components(edges: DataFrame, where) -> DataFrame | None:
    """The edges (rel, x, y) with ``comp``, or nothing where their chunks share too many values."""

    def within(batches):
        for rel, x, y in _chunks(batches, _CHUNK):
            yield _batch("root rel x y", roots(x, y), rel, x, y)

    least = F.least("x", "y")
    rooted = where(edges.repartitionByRange(least).sortWithinPartitions(least).mapInArrow(within, "root long, rel int, x long, y long"), "rooted")
    met = rooted.select(F.col("x").alias("node"), "root").unionByName(rooted.select(F.col("y").alias("node"), "root"))
    several = met.groupBy("node").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("node", "lo")
    links = where(met.join(several, "node").filter("root <> lo").select(F.col("root").alias("u"), F.col("lo").alias("v")).distinct(), "links")
    n = links.count()
    if not n:
        return rooted.withColumnRenamed("root", "comp")
    if n > LINKS:
        return None

    def among(batches):
        for u, v in _chunks(batches, 2 * LINKS):
            top = roots(u, v)
            node, one = np.unique(np.concatenate([u, v]), return_index=True)
            yield _batch("root comp", node, np.concatenate([top, top])[one])

    joined = where(links.coalesce(1).mapInArrow(among, "root long, comp long"), "joined")
    return rooted.join(joined, "root", "left").select(F.coalesce("comp", "root").alias("comp"), "rel", "x", "y")


def evaluate(stratum: Stratum, tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame] | None]:
    """The derived pairs of all small components by relation, and the input rows of all others (nothing where there are none)."""
    inputs = list(dict.fromkeys(a.relation for r in (*stratum.base, *stratum.recursive) for a in r.atoms if a.relation not in stratum.relations))
    spark = tables[inputs[0]].sparkSession
    scratch: list[str] = []

    def where(df: DataFrame, tag: str) -> DataFrame:
        path = fresh_path(spark, tag)
        store(df, path)
        scratch.append(path)
        return spark.read.schema(df.schema).parquet(path)

    edges = None
    for i, name in enumerate(inputs):
        x, y = (F.col(f"`{c}`").cast("long").alias(a) for c, a in zip(tables[name].columns, "xy"))
        part = tables[name].select(F.lit(i).alias("rel"), x, y)
        edges = part if edges is None else edges.unionByName(part)
    edges = where(edges, "pairs")
    # nulls join with nothing, but a rule can drop them
    placed = _components(edges, where) if edges.filter("x is null or y is null").isEmpty() else None
    if placed is None:
        for path in scratch:
            drop_path(spark, path)
        return {}, {name: tables[name] for name in inputs}
    rules = Rules(stratum, inputs)
    d = rules.n_derived
    big = where(placed.groupBy("comp").count().filter(F.col("count") > EDGES).select("comp"), "large")
    some = not big.isEmpty()
    dealt = placed.join(big, "comp", "left_anti") if some else placed

    def solve(batches):
        kept = None
        for chunk in _chunks(batches, _BLOCK):
            if kept is not None:
                chunk = [np.concatenate(c) for c in zip(kept, chunk)]
            cut = int(np.searchsorted(chunk[0], chunk[0][-1]))  # the last component may go on
            kept = [c[cut:] for c in chunk]
            if cut:
                for got in rules.solve(*(c[:cut] for c in chunk)):
                    yield _batch("rel x y", *got)
        if kept is not None:
            for got in rules.solve(*kept):
                yield _batch("rel x y", *got)

    solved = where(dealt.select("comp", "rel", "x", "y").repartition("comp").sortWithinPartitions("comp").mapInArrow(solve, "rel int, x long, y long"), "solved")
    read = scratch[-1:]
    rest = solved.filter(F.col("rel") >= d).withColumn("rel", F.col("rel") - d)
    if some:
        others = where(placed.join(big, "comp", "left_semi").select("rel", "x", "y"), "others")
        read += scratch[-1:]
        rest = rest.unionByName(others)
    for path in scratch:
        if path not in read:
            drop_path(spark, path)

    derived = {name: solved.filter(F.col("rel") == i).select("x", "y") for i, name in enumerate(stratum.relations)}
    if not some and rest.isEmpty():
        return derived, None
    left = {}
    for i, name in enumerate(inputs):
        columns = [F.col(a).cast(f.dataType).alias(f.name) for a, f in zip("xy", tables[name].schema.fields)]
        left[name] = rest.filter(F.col("rel") == i).select(*columns)
    return derived, left
