"""Certain answers along the order of an acyclic attack graph.

From the last atom to the first, a candidate (values of the variables so far and of the atom's key) is dropped if its block
holds any tuple that doesn't fit: one that differs from a constant or a known value, or leads to no candidate that is left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ast import Const, Program, Rule, Var
from ..plans.rules import _Body, atom_order as join_order, scan
from .attack import Query, atom_order

_ONE = "__one"


def bindings(program: Program, query: Query, tables: dict[str, DataFrame]) -> DataFrame:
    """Distinct values of all variables that the plain join finds."""
    rule = Rule(query.rule.head, query.atoms, frozenset(), query.rule.line)
    body = _Body(program, rule)
    for i in join_order(rule, None):
        body.join(*scan(tables[query.atoms[i].relation], query.atoms[i], f"a{i}"), query.atoms[i])
    names = sorted(body.bound)
    return body.df.select(*names, F.lit(1).alias(_ONE)).distinct()


def by_attack_graph(program: Program, query: Query, tables: dict[str, DataFrame]) -> DataFrame:
    atoms = atom_order(query)
    every = bindings(program, query, tables)
    free = [set(query.free)]
    for a in atoms:
        free.append(free[-1] | query.vars(a))
    left: DataFrame | None = None
    for i in range(len(atoms) - 1, -1, -1):
        atom = atoms[i]
        known = sorted(free[i] | query.key_vars(atom))
        wanted = [_ONE, *known]
        candidates = every.select(*wanted).distinct()
        keys = query.key_places(atom)
        facts = tables[atom.relation]
        facts = facts.select(*[F.col(f"`{c}`").alias(f"__f{j}") for j, c in enumerate(facts.columns)])
        on, names = [], {v: F.col(v) for v in known}
        for j in keys:
            x = atom.args[j]
            if isinstance(x, Const):
                facts = facts.filter(F.col(f"__f{j}") == F.lit(x.value))
            else:
                on.append(F.col(x.name) == F.col(f"__f{j}"))
        blocks = candidates.join(facts, reduce(lambda a, b: a & b, on)) if on else candidates.join(facts.withColumn("__same", F.lit(1)), F.col(_ONE) == F.col("__same")).drop("__same")
        fits = F.lit(True)
        for j, x in enumerate(atom.args):
            if j in keys:
                continue
            own = F.col(f"__f{j}")
            if isinstance(x, Const):
                fits = fits & (own == F.lit(x.value))
            elif x.name in names:
                fits = fits & (own == names[x.name])
            else:
                names[x.name] = own
        blocks = blocks.withColumn("__fits", fits)
        if left is not None:
            further = sorted(free[i + 1])
            named = blocks.select(*wanted, "__fits", *[names[v].alias(f"__v_{v}") for v in further])
            yes = left.select(F.col(_ONE).alias("__yes"), *[F.col(v).alias(f"__v_{v}") for v in further])
            if further:
                met = named.join(yes, [f"__v_{v}" for v in further], "left")
            else:
                met = named.join(yes, F.col(_ONE) == F.col("__yes"), "left")
            blocks = met.withColumn("__fits", F.col("__fits") & F.col("__yes").isNotNull())
        bad = blocks.filter(~F.col("__fits")).select(*wanted).distinct()
        left = candidates.join(bad, wanted, "left_anti").select(_ONE, *sorted(free[i])).distinct()
    return left.drop(_ONE) if query.free else left
