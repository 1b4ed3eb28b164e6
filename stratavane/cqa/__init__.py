"""Consistent query answering: answers that hold in every repair of data that violates its keys.

A repair keeps one tuple of each block of tuples with equal keys. ``attack_graph`` answers every conjunctive query without
self-joins whose attack graph has no cycle; ``join_graph`` those whose joins go from non-key attributes to whole keys and form
trees; ``pair_pruning`` applies the latter to each rule of a union by itself, which is sound but can miss answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import SPARK_TYPES, column
from ..operators import union_all
from ..plans.analysis import stratify, variable_types
from ..plans.ast import Atom, Const, Program, Relation, Rule, Var, Wild, variables
from .attack import NotRewritable, Query, attack_graph, atom_order, parts, to_dot
from .certain import by_attack_graph
from .joins import by_join_graph, join_graph

__all__ = ["NotRewritable", "Query", "attack_graph", "atom_order", "certain_answers", "join_graph", "queries_of", "to_dot"]


def queries_of(program: Program) -> list[Query]:
    """Each rule of the program as a conjunctive query over its inputs."""
    stratify(program)
    inputs = {r.name: r for r in program.inputs}
    found = []
    for rule in program.rules:
        names = [a.relation for a in rule.atoms]
        if any(n not in inputs for n in names):
            raise NotRewritable("the query reads a derived relation")
        if len(rule.atoms) != len(rule.body) or rule.aggregates:
            raise NotRewritable("only atoms can be in the query")
        if len(set(names)) < len(names):
            raise NotRewritable("the query has a self-join")
        if any(not isinstance(x, Var | Const | Wild) for a in rule.atoms for x in a.args):
            raise NotRewritable("only variables and constants can be in the query's atoms")
        taken, n, atoms = set(variables(rule.head)) | {v for a in rule.atoms for v in variables(a)}, 0, []
        for a in rule.atoms:
            args = []
            for x in a.args:
                if isinstance(x, Wild):
                    while f"any{n}" in taken:
                        n += 1
                    taken.add(f"any{n}")
                    x = Var(f"any{n}")
                args.append(x)
            atoms.append(Atom(a.relation, tuple(args)))
        found.append(Query(tuple(atoms), tuple(variables(rule.head)), inputs, rule))
    return found


def certain_answers(program: Program, tables: dict[str, DataFrame], method: str = "attack_graph") -> DataFrame:
    queries = queries_of(program)
    if len(queries) > 1 and method != "pair_pruning":
        raise NotRewritable("the query has several rules")
    solve = by_attack_graph if method == "attack_graph" else by_join_graph
    found = [_head(program, q.rule, _product([(p, solve(program, p, tables)) for p in parts(q)])) for q in queries]
    if len(found) == 1 and _keeps(program, queries[0]):
        return found[0]
    return union_all(found).distinct()


def _product(answers: list[tuple[Query, DataFrame]]) -> DataFrame:
    """All combinations of the parts' answers, distinct as these are; none is shuffled or stored. A part without head
    variables only says whether there are any."""
    given = [df for q, df in answers if q.free]
    asked = [df.limit(1) for q, df in answers if not q.free]
    first = given.pop(0) if given else asked.pop(0)
    for df in asked:
        first = first.join(F.broadcast(df.select(F.lit(1).alias("__any"))), F.lit(True), "left_semi")  # one row
    return reduce(DataFrame.crossJoin, [first, *given])


def _keeps(program: Program, query: Query) -> bool:
    """Whether distinct answers stay distinct in the head's types."""
    head, types = program.relations[query.rule.head.relation], variable_types(program, query.rule)
    kept = {x.name for x, a in zip(query.rule.head.args, head.attributes) if isinstance(x, Var) and types[x.name] == a.type}
    return set(query.free) <= kept


def _head(program: Program, rule: Rule, answers: DataFrame) -> DataFrame:
    head: Relation = program.relations[rule.head.relation]
    if not head.attributes:
        return answers.select(F.lit(True).alias("answer"))
    return answers.select(*[column(x, {}).cast(SPARK_TYPES[a.type]).alias(a.name) for x, a in zip(rule.head.args, head.attributes)])
