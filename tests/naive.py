"""A slow evaluator of programs over Python sets, to compare with."""

import itertools
import operator

from stratavane.plans.analysis import stratify
from stratavane.plans.ast import Agg, Assign, Atom, Compare, Const, Math, Negation, Var, Wild

OPS = {"==": operator.eq, "!=": operator.ne, ">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt, "+": operator.add, "-": operator.sub, "*": operator.mul, "/": lambda a, b: int(a / b)}


def value(e, env):
    return env[e.name] if isinstance(e, Var) else e.value if isinstance(e, Const) else OPS[e.op](value(e.left, env), value(e.right, env))


def match(atom, row, env):
    env = dict(env)
    for arg, v in zip(atom.args, row):
        if isinstance(arg, Wild) or isinstance(arg, Math):
            continue
        if isinstance(arg, Const):
            if arg.value != v:
                return None
        elif env.setdefault(arg.name, v) != v:
            return None
    return env


def solve(rule, tables):
    envs = [({}, [])]
    for atom in rule.atoms:
        envs = [(m, [*rows, (atom, row)]) for env, rows in envs for row in tables[atom.relation] if (m := match(atom, row, env)) is not None]
    out = []
    for env, rows in envs:
        env, good, pending = dict(env), True, [x for x in rule.body if isinstance(x, Assign)]
        while pending:
            for a in list(pending):
                try:
                    v = value(a.expr, env)
                except KeyError:
                    continue
                good = good and env.setdefault(a.var, v) == v
                pending.remove(a)
        good = good and all(value(arg, env) == v for atom, row in rows for arg, v in zip(atom.args, row) if isinstance(arg, Math))
        for x in rule.body:
            if isinstance(x, Compare):
                good = good and OPS[x.op](value(x.left, env), value(x.right, env))
            elif isinstance(x, Negation):
                hits = (m for row in tables[x.atom.relation] if (m := match(x.atom, row, env)) is not None and all(value(a, env) == v for a, v in zip(x.atom.args, row) if isinstance(a, Math)))
                good = good and next(hits, None) is None
        if good:
            out.append(env)
    return out


def heads(rule, tables):
    if rule.is_fact:
        return {tuple(a.value for a in rule.head.args)}
    envs = solve(rule, tables)
    if not rule.aggregates:
        return {tuple(value(a, e) for a in rule.head.args) for e in envs}
    groups = {}
    for e in envs:
        groups.setdefault(tuple(value(a, e) for a in rule.head.args if not isinstance(a, Agg)), []).append(e)
    kinds = {"MIN": min, "MAX": max, "SUM": sum, "COUNT": len, "COUNT_DISTINCT": lambda v: len(set(v))}
    out = set()
    for key, members in groups.items():
        k = iter(key)
        out.add(tuple(kinds[a.op]([value(a.arg, e) for e in members]) if isinstance(a, Agg) else next(k) for a in rule.head.args))
    return out


def evaluate(program, tables):
    tables = {k: set(v) for k, v in tables.items()} | {r.name: set() for r in program.derived}
    for stratum in stratify(program):
        rules = [*stratum.base, *stratum.recursive]
        while True:
            before = sum(map(len, tables.values()))
            for r in rules:
                tables[r.head.relation] |= heads(r, tables)
            if not stratum.recursive or sum(map(len, tables.values())) == before:
                break
        for name in stratum.relations:
            marks = {(i, a.op) for r in rules if r.head.relation == name for i, a in r.aggregates}
            if stratum.recursive and marks:
                i, op = next(iter(marks))
                best = {}
                for row in tables[name]:
                    key = row[:i] + row[i + 1 :]
                    best[key] = row[i] if key not in best else (min if op == "MIN" else max)(best[key], row[i])
                tables[name] = {(*k[:i], v, *k[i:]) for k, v in best.items()}
    return tables


def repairs(rows, keys):
    blocks = {}
    for row in rows:
        blocks.setdefault(tuple(row[i] for i in keys), []).append(row)
    return [set(r) for r in itertools.product(*blocks.values())]


__all__ = ["Atom", "evaluate", "repairs"]
