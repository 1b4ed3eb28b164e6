"""One rule as a DataFrame plan, given a DataFrame for each of its positive atoms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import SPARK_TYPES, aggregate, column, comparison, literal, quoted, schema_of
from ..operators import unless_any
from .analysis import variable_types
from .ast import Agg, Assign, Atom, Compare, Const, Math, Program, Rule, Var, variables


def scan(df: DataFrame, atom: Atom, tag: str) -> tuple[DataFrame, list[tuple[str, Math]]]:
    """The atom's variables as columns, constants and repeated variables applied as filters before any join. Arguments that
    are expressions stay as columns of their own, returned with their expressions."""
    conditions, columns, held = [], {}, []
    for i, (name, arg) in enumerate(zip(df.columns, atom.args)):
        own = F.col(quoted(name))
        if isinstance(arg, Const):
            conditions.append(own == literal(arg.value))
        elif isinstance(arg, Var):
            if arg.name in columns:
                conditions.append(own == columns[arg.name])
            else:
                columns[arg.name] = own
        elif isinstance(arg, Math):
            held.append((f"__{tag}_{i}", arg, own))
    if conditions:
        df = df.filter(reduce(lambda a, b: a & b, conditions))
    picked = [c.alias(v) for v, c in columns.items()] + [own.alias(name) for name, _, own in held]
    return df.select(*(picked or [F.lit(1).alias(f"__{tag}")])), [(name, arg) for name, arg, _ in held]


class _Body:
    """The join of the atoms taken so far, and what waits for variables still unbound."""

    def __init__(self, program: Program, rule: Rule):
        self.types = variable_types(program, rule)
        self.df: DataFrame | None = None
        self.bound: set[str] = set()
        self.compares = [x for x in rule.body if isinstance(x, Compare)]
        self.assigns = [x for x in rule.body if isinstance(x, Assign)]
        self.held: list[tuple[str, Math]] = []

    def known(self, term) -> bool:
        return set(variables(term)) <= self.bound

    def join(self, scanned: DataFrame, held: list[tuple[str, Math]], atom: Atom) -> None:
        names = set(variables(Atom("", tuple(a for a in atom.args if isinstance(a, Var)))))
        if self.df is None:
            self.df, self.held = scanned, held
        else:
            keys = sorted(names & self.bound)
            for name, expr in held:  # computed keys join by hash, like others
                if self.known(expr):
                    self.df = self.df.withColumn(name, column(expr, self.types))
                    keys.append(name)
                else:
                    self.held.append((name, expr))
            if keys:
                drop = [k for k in keys if k.startswith("__")]
                self.df = self.df.join(scanned, keys, "inner").drop(*drop)
            else:
                self.df = self.df.crossJoin(scanned)
        self.bound |= names
        self.settle()

    def settle(self) -> None:
        """Applies all assignments, comparisons and computed arguments whose variables are bound."""
        progress = True
        while progress:
            progress = False
            for a in [a for a in self.assigns if self.known(a.expr)]:
                self.assigns.remove(a)
                value = column(a.expr, self.types)
                if a.var in self.bound:
                    self.filter(F.col(quoted(a.var)) == value)
                else:
                    self.df = self._frame().withColumn(a.var, value.cast(SPARK_TYPES[self.types[a.var]]))
                    self.bound.add(a.var)
                progress = True
        for c in [c for c in self.compares if self.known(c)]:
            self.compares.remove(c)
            self.filter(comparison(c.op, column(c.left, self.types), column(c.right, self.types)))
        for name, expr in [h for h in self.held if self.known(h[1])]:
            self.held.remove((name, expr))
            self.filter(F.col(name) == column(expr, self.types))
            self.df = self.df.drop(name)

    def _frame(self) -> DataFrame:
        return self.df

    def filter(self, condition) -> None:
        self.df = self._frame().filter(condition)


def atom_order(rule: Rule, first: int | None) -> list[int]:
    """Join order: the delta's atom (or the first) and then always one that shares a bound variable, if there is one."""
    atoms = rule.atoms
    rest = list(range(len(atoms)))
    order = [rest.pop(rest.index(first if first is not None else 0))] if rest else []
    bound = set(variables(atoms[order[0]])) if order else set()
    while rest:
        for a in (x for x in rule.body if isinstance(x, Assign)):
            if set(variables(a.expr)) <= bound:
                bound.add(a.var)

        def linked(i: int) -> tuple:
            atom = atoms[i]
            shared = len(set(variables(Atom("", tuple(x for x in atom.args if isinstance(x, Var))))) & bound)
            computed = sum(isinstance(x, Math) and set(variables(x)) <= bound for x in atom.args)
            constants = sum(isinstance(x, Const) for x in atom.args)
            return (-(shared + computed > 0), -(shared + computed), -constants, i)

        nxt = min(rest, key=linked)
        rest.remove(nxt)
        order.append(nxt)
        bound |= set(variables(atoms[nxt]))
    return order


def build(program: Program, rule: Rule, tables: dict[int, DataFrame], negated: dict[str, DataFrame], first: int | None = None, spark=None) -> DataFrame:
    """The rule's head tuples, with duplicates. ``tables``: by place among the positive atoms; ``negated``: by name."""
    head = program.relations[rule.head.relation]
    if rule.is_fact:
        return spark.createDataFrame([tuple(a.value for a in rule.head.args)]).select(*[F.col(f"_{i + 1}").cast(SPARK_TYPES[a.type]).alias(a.name) for i, a in enumerate(head.attributes)])
    body = _Body(program, rule)
    if not rule.atoms:
        body.df = spark.range(1).drop("id").withColumn("__one", F.lit(1))
        body.settle()
    for i in atom_order(rule, first):
        body.join(*scan(tables[i], rule.atoms[i], f"a{i}"), rule.atoms[i])
    df = body.df
    for k, atom in enumerate(rule.negations):
        scanned, held = scan(negated[atom.relation], atom, f"n{k}")
        keys = [c for c in scanned.columns if not c.startswith("__")]
        for name, expr in held:
            df = df.withColumn(name, column(expr, body.types))
            keys.append(name)
        df = df.join(scanned, keys, "left_anti").drop(*[n for n, _ in held]) if keys else unless_any(df, scanned)
    return project_head(df, rule, head, body.types)


def project_head(df: DataFrame, rule: Rule, head, types: dict[str, str]) -> DataFrame:
    keys, aggregates, final = [], [], []
    for i, (arg, attribute) in enumerate(zip(rule.head.args, head.attributes)):
        name = f"__h{i}"
        if isinstance(arg, Agg):
            aggregates.append(aggregate(arg, types).alias(name))
        else:
            keys.append(column(arg, types).alias(name))
        final.append(F.col(name).cast(SPARK_TYPES[attribute.type]).alias(attribute.name))
    if not aggregates:
        return df.select(*[column(a, types).cast(SPARK_TYPES[t.type]).alias(t.name) for a, t in zip(rule.head.args, head.attributes)])
    if keys:
        names = [f"__h{i}" for i, a in enumerate(rule.head.args) if not isinstance(a, Agg)]
        inputs = df.select(*keys, *[F.col(quoted(v)) for v in dict.fromkeys(v for _, a in rule.aggregates for v in variables(a))])
        return inputs.groupBy(*names).agg(*aggregates).select(*final)
    return df.agg(*aggregates, F.count(F.lit(1)).alias("__n")).filter("__n > 0").select(*final)


def empty(spark, relation) -> DataFrame:
    return spark.createDataFrame([], schema_of(relation))
