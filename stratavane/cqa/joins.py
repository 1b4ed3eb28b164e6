"""Certain answers of queries whose joins form trees, from the non-key attributes of one relation to the whole key of another.

Candidates are what the plain join returns with the keys of the roots; a root's key is filtered out if any tuple of its block,
followed down the tree, ends at a missing tuple or fails a constant, and keys that have more than one candidate are. Trees are
filtered each by itself, as their relations have repairs of their own: several roots either share all of their keys' variables
or have none in common."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ast import Atom, Const, Program, Var
from .attack import NotRewritable, Query
from .certain import bindings


def join_graph(query: Query) -> dict[str, set[str]]:
    """Edges from the relation that holds a key's variables among its non-key attributes; checks that the method applies."""
    graph: dict[str, set[str]] = {a.relation: set() for a in query.atoms}
    parents: dict[str, str] = {}
    for child in query.atoms:
        names = [x.name for x in child.args if isinstance(x, Var)]
        if len(set(names)) < len(names):
            raise NotRewritable(f"{child.relation} holds a variable twice")
        rest = query.vars(child) - query.key_vars(child)
        for other in query.atoms:
            if other is child:
                continue
            apart = query.vars(other) - query.key_vars(other)
            if rest & apart:
                raise NotRewritable(f"{child.relation} and {other.relation} join by non-key attributes")
            if query.key_vars(child) & query.key_vars(other) and query.key_vars(child) != query.key_vars(other):
                raise NotRewritable(f"{child.relation} and {other.relation} share a part of their keys")
            met = apart & query.key_vars(child)
            if met:
                if met != query.key_vars(child) or len(query.key_places(child)) != len(met):
                    raise NotRewritable(f"{other.relation} joins a part of {child.relation}'s key")
                if child.relation in parents:
                    raise NotRewritable(f"{child.relation} has two parents")
                parents[child.relation] = other.relation
                graph[other.relation].add(child.relation)
    if parents and not all(_root(a, parents) for a in parents):
        raise NotRewritable("the joins have a cycle")
    for a in query.atoms:
        for b in query.atoms:
            if a is not b and query.key_vars(a) & query.key_vars(b) and (a.relation in parents or b.relation in parents):
                raise NotRewritable(f"{a.relation} and {b.relation} join by keys below a root")
    return graph


def _root(name: str, parents: dict[str, str]) -> bool:
    """Whether the way up ends."""
    seen = set()
    while name in parents and name not in seen:
        seen.add(name)
        name = parents[name]
    return name not in parents


def by_join_graph(program: Program, query: Query, tables: dict[str, DataFrame]) -> DataFrame:
    graph = join_graph(query)
    atoms = {a.relation: a for a in query.atoms}
    children = {c for hit in graph.values() for c in hit}
    roots = [a for a in query.atoms if a.relation not in children]
    for root in roots:
        if not query.key_vars(root):
            raise NotRewritable(f"the key of {root.relation} is constant")
    every = sorted(set().union(*(query.key_vars(r) for r in roots)))
    projected = sorted(set(query.free))
    candidates = bindings(program, query, tables).select(*dict.fromkeys([*every, *projected])).distinct()

    def facts(atom: Atom, rename: dict[str, str]) -> tuple[DataFrame, list, list]:
        """Columns by variable; conditions that key constants and other constants must meet."""
        df = tables[atom.relation]
        place = query.key_places(atom)
        for i in place:
            if isinstance(atom.args[i], Const):
                df = df.filter(F.col(f"`{df.columns[i]}`") == F.lit(atom.args[i].value))
        picked = [F.col(f"`{df.columns[i]}`").alias(rename.get(x.name, x.name) if isinstance(x, Var) else f"__c_{atom.relation}_{i}") for i, x in enumerate(atom.args)]
        fails = [F.col(f"__c_{atom.relation}_{i}") != F.lit(x.value) for i, x in enumerate(atom.args) if isinstance(x, Const) and i not in place]
        return df.select(*picked), place, fails

    kept = candidates
    for root in roots:
        keys = sorted(query.key_vars(root))
        own, _, fails = facts(root, {})
        walked = candidates.select(*keys).distinct().join(own, keys)
        bad = list(fails)
        front = [root.relation]
        while front:
            for child in sorted(graph[front.pop()]):
                rename = {v: f"__k_{v}" for v in query.key_vars(atoms[child])}
                df, _, fails = facts(atoms[child], rename)
                on = reduce(lambda a, b: a & b, [F.col(v) == F.col(k) for v, k in rename.items()])
                walked = walked.join(df, on, "left")
                bad += [F.col(k).isNull() for k in rename.values()] + fails
                front.append(child)
        if bad:
            filtered = walked.filter(F.coalesce(reduce(lambda a, b: a | b, bad), F.lit(True))).select(*keys).distinct()
            kept = kept.join(filtered, keys, "left_anti")
    several = candidates.groupBy(*every).agg(F.count("*").alias("__n")).filter("__n > 1").select(*every)
    kept = kept.join(several, every, "left_anti")
    return kept.select(*projected).distinct() if projected else kept.limit(1)
