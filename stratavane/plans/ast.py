"""Programs as immutable values; str() of each gives text that parses to the same value."""

from __future__ import annotations

from dataclasses import dataclass, field

TYPES = ("int", "long", "float", "double", "varchar", "char", "date", "datetime")
AGGREGATES = ("MIN", "MAX", "SUM", "COUNT", "COUNT_DISTINCT")
COMPARISONS = ("==", "!=", ">=", "<=", ">", "<")


class ProgramError(ValueError):
    """A program that can't be parsed or evaluated; the message says where and why."""


@dataclass(frozen=True)
class Attribute:
    name: str
    type: str
    key: bool = False

    def __str__(self) -> str:
        return f"[{self.name}] {self.type}" if self.key else f"{self.name} {self.type}"


@dataclass(frozen=True)
class Relation:
    name: str
    attributes: tuple[Attribute, ...]

    def __str__(self) -> str:
        return f"{self.name}({', '.join(map(str, self.attributes))})"

    @property
    def columns(self) -> list[str]:
        return [a.name for a in self.attributes]


@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Const:
    value: int | float | str

    def __str__(self) -> str:
        return "'" + self.value.replace("'", "''") + "'" if isinstance(self.value, str) else str(self.value)


@dataclass(frozen=True)
class Wild:
    def __str__(self) -> str:
        return "_"


@dataclass(frozen=True)
class Math:
    op: str
    left: Expr
    right: Expr

    def __str__(self) -> str:
        side = lambda e: f"({e})" if isinstance(e, Math) else str(e)
        return f"{side(self.left)} {self.op} {side(self.right)}"


@dataclass(frozen=True)
class Agg:
    op: str
    arg: Expr

    def __str__(self) -> str:
        return f"{self.op}({self.arg})"


Expr = Var | Const | Math
Term = Var | Const | Wild | Math | Agg


@dataclass(frozen=True)
class Atom:
    relation: str
    args: tuple[Term, ...]

    def __str__(self) -> str:
        return f"{self.relation}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Negation:
    atom: Atom

    def __str__(self) -> str:
        return f"!{self.atom}"


@dataclass(frozen=True)
class Compare:
    op: str
    left: Expr
    right: Expr

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"


@dataclass(frozen=True)
class Assign:
    var: str
    expr: Expr

    def __str__(self) -> str:
        return f"{self.var} = {self.expr}"


Literal = Atom | Negation | Compare | Assign


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Literal, ...] = ()
    flags: frozenset[str] = frozenset()
    line: int = field(default=0, compare=False)

    def __str__(self) -> str:
        flags = "".join(f" [{f}]" for f in sorted(self.flags))
        return f"{self.head} :-{' ' if self.body else ''}{', '.join(map(str, self.body))}{flags}."

    @property
    def atoms(self) -> list[Atom]:
        return [x for x in self.body if isinstance(x, Atom)]

    @property
    def negations(self) -> list[Atom]:
        return [x.atom for x in self.body if isinstance(x, Negation)]

    @property
    def aggregates(self) -> list[tuple[int, Agg]]:
        return [(i, a) for i, a in enumerate(self.head.args) if isinstance(a, Agg)]

    @property
    def is_fact(self) -> bool:
        return not self.body


@dataclass(frozen=True)
class Program:
    inputs: tuple[Relation, ...]
    derived: tuple[Relation, ...]
    rules: tuple[Rule, ...]

    def __str__(self) -> str:
        parts = (("EDB_DECL", self.inputs), ("IDB_DECL", self.derived), ("RULE_DECL", self.rules))
        return "\n\n".join("\n".join([f"{name}:", *map(str, items)]) for name, items in parts) + "\n"

    @property
    def relations(self) -> dict[str, Relation]:
        return {r.name: r for r in (*self.inputs, *self.derived)}


def variables(term) -> list[str]:
    """Variables of a term, atom or literal, in order of first appearance."""
    if isinstance(term, Var):
        return [term.name]
    if isinstance(term, Math | Compare):
        found = variables(term.left) + variables(term.right)
    elif isinstance(term, Agg):
        found = variables(term.arg)
    elif isinstance(term, Atom):
        found = [v for a in term.args for v in variables(a)]
    elif isinstance(term, Negation):
        found = variables(term.atom)
    elif isinstance(term, Assign):
        found = [term.var, *variables(term.expr)]
    else:
        found = []
    return list(dict.fromkeys(found))
