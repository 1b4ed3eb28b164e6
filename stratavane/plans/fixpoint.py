"""Evaluation of strata: lazily where nothing recurs, by semi-naive iteration where something does.

An iteration joins only the tuples that the last one found (the delta) with the rest. For a rule with k recursive atoms, the
j-th plan takes the delta for atom j, everything including the delta for the atoms before it and everything before the delta
for those after it; together the k plans find each new combination once. Each delta is written to the shared folder with its
count taken in the same job, so neither plans nor lineage grow, and a lost executor costs no iteration. A relation is the
union of its deltas' files; they are rewritten into one when they become many."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import SPARK_TYPES
from ..operators import best_per_key, difference, difference_two_phase, distinct, undominated, union_all
from ..sources import drop_path, fresh_path, store
from . import dense
from .analysis import Stratum, recursive_aggregate
from .ast import Const, Program, ProgramError, Rule, Var, variables
from .rules import build, empty

log = logging.getLogger("stratavane")

#: Cost of building against probing a hash table, and the thresholds that follow from it (fixed values).
ALPHA = 1.38
ONE_PHASE_UP_TO, TWO_PHASE_FROM = ALPHA / (ALPHA - 1), 2 * ALPHA / (ALPHA - 1)


@dataclass
class Iteration:
    stratum: tuple[str, ...]
    iteration: int
    new: dict[str, int]
    total: dict[str, int]
    seconds: float


@dataclass
class Options:
    max_iterations: int = 10_000
    stop_after: int | None = None
    set_difference: str = "dynamic"  # one_phase, two_phase or dynamic
    bags: frozenset[str] = frozenset()
    compact_every: int = 16
    broadcast_rows: int = 200_000
    two_phase_rows: int = 4_000_000  # of a relation that is shuffled without a thought below


@dataclass
class State:
    """A recursive relation while its stratum is evaluated."""

    full: DataFrame
    delta: DataFrame
    prev: DataFrame
    count: int
    new: int
    paths: list[str] = field(default_factory=list)
    overlap: float | None = None  # share of the last candidates that the relation had already
    doomed: list[str] = field(default_factory=list)  # files that only the next iteration still reads


class Evaluator:
    def __init__(self, spark: SparkSession, program: Program, tables: dict[str, DataFrame], options: Options):
        self.spark, self.program, self.tables, self.options = spark, program, dict(tables), options
        self.metrics: list[Iteration] = []
        self.sets: set[str] = set()  # derived relations that are known to hold no row twice

    def rule(self, rule: Rule, special: dict[int, DataFrame] | None = None, first: int | None = None) -> DataFrame:
        tables = {i: (special or {}).get(i, self.tables.get(a.relation)) for i, a in enumerate(rule.atoms)}
        return build(self.program, rule, tables, self.tables, first, self.spark)

    def union(self, name: str, rules: list[Rule]) -> DataFrame:
        parts = [self.rule(r) for r in rules]
        return union_all(parts) if parts else empty(self.spark, self.program.relations[name])

    def evaluate(self, stratum: Stratum, materialise: bool) -> None:
        if stratum.recursive:
            o = self.options
            if o.set_difference == "dynamic" and o.stop_after is None and dense.fits(self.program, stratum):
                self.by_component(stratum)
            else:
                self.recursive(stratum)
            return
        name = stratum.relations[0]
        rules = list(stratum.base)
        df = self.union(name, rules)
        bag = name in self.options.bags or all("!dedup" in r.flags for r in rules)
        grouped = len(rules) == 1 and rules[0].aggregates  # groups are distinct already
        if not bag and not grouped and not self._apart(rules):
            df = distinct(df)
        if materialise:
            path = fresh_path(self.spark, name)
            store(df, path)
            df = self.spark.read.schema(df.schema).parquet(path)
        self.tables[name] = df

    def _apart(self, rules: list[Rule]) -> bool:
        """Whether rules only copy whole sets, each with a constant of its own in one place, so that no row comes twice."""
        for r in rules:
            if r.flags or len(r.body) != 1 or len(r.atoms) != 1 or r.atoms[0].relation not in self.sets:
                return False
            if not all(isinstance(a, Var) for a in r.atoms[0].args) or not all(isinstance(a, Var | Const) for a in r.head.args):
                return False
            if not set(variables(r.atoms[0])) <= set(variables(r.head)):
                return False
        columns = zip(*(r.head.args for r in rules))
        return any(all(isinstance(a, Const) for a in c) and len({a.value for a in c}) == len(rules) for c in columns)

    # recursion

    def by_component(self, stratum: Stratum) -> None:
        """Small components at once, by matrices; what is left by iteration."""
        began = time.time()
        solved, left = dense.evaluate(stratum, self.tables)
        log.info("%s: small components in %.2f s", ", ".join(stratum.relations), time.time() - began)
        if left is not None:
            given = {name: self.tables[name] for name in left}
            self.tables |= left
            self.recursive(stratum)
            self.tables |= given
        for name, df in solved.items():
            relation = self.program.relations[name]
            df = df.select(*[F.col(c).cast(SPARK_TYPES[a.type]).alias(a.name) for c, a in zip("xy", relation.attributes)])
            self.tables[name] = df if left is None else df.unionByName(self.tables[name])
            self.sets.add(name)

    def _write(self, df: DataFrame, name: str) -> tuple[DataFrame, int, str]:
        path = fresh_path(self.spark, name)
        n = store(df, path)
        return self.spark.read.schema(df.schema).parquet(path), n, path

    def recursive(self, stratum: Stratum) -> None:
        o = self.options
        group = set(stratum.relations)
        lattice = {n: recursive_aggregate([r for r in (*stratum.base, *stratum.recursive) if r.head.relation == n]) for n in stratum.relations}
        states: dict[str, State] = {}
        for name in stratum.relations:
            df = distinct(self.union(name, [r for r in stratum.base if r.head.relation == name]))
            if lattice[name]:
                df = best_per_key(df, *self._keys(name, lattice[name]))
            df, n, path = self._write(df, name)
            states[name] = State(df, df, empty(self.spark, self.program.relations[name]), n, n, [path])
            self.tables[name] = df
        turn = 0
        while any(s.new for s in states.values()):
            if o.stop_after is not None and turn >= o.stop_after:
                break
            if turn >= o.max_iterations:
                raise ProgramError(f"{', '.join(stratum.relations)} didn't settle in {o.max_iterations} iterations")
            turn += 1
            began = time.time()
            found: dict[str, tuple[DataFrame, int, str] | None] = {}
            for name in stratum.relations:
                plans = []
                for rule in (r for r in stratum.recursive if r.head.relation == name):
                    plans += self._delta_plans(rule, group, states)
                found[name] = self._new(name, plans, states[name], lattice[name], [r for r in stratum.recursive if r.head.relation == name]) if plans else None
            for name, got in found.items():
                self._advance(name, states[name], got, lattice[name])
            m = Iteration(stratum.relations, turn, {n: s.new for n, s in states.items()}, {n: s.count for n, s in states.items()}, time.time() - began)
            self.metrics.append(m)
            log.info("%s: iteration %d, new %s, total %s, %.2f s", ", ".join(stratum.relations), turn, m.new, m.total, m.seconds)
        for name, s in states.items():
            self.tables[name] = s.full

    def _delta_plans(self, rule: Rule, group: set[str], states: dict[str, State]) -> list[DataFrame]:
        places = [i for i, a in enumerate(rule.atoms) if a.relation in group]
        plans = []
        for j in places:
            if not states[rule.atoms[j].relation].new:
                continue
            special = {}
            for i in places:
                s = states[rule.atoms[i].relation]
                special[i] = s.delta if i == j else s.full if i < j else s.prev
            plans.append(self.rule(rule, special, first=j))
        return plans

    def _keys(self, name: str, aggregate: tuple[int, str]) -> tuple[list[str], str, str]:
        columns = self.program.relations[name].columns
        return [c for i, c in enumerate(columns) if i != aggregate[0]], columns[aggregate[0]], aggregate[1]

    def _new(self, name: str, plans: list[DataFrame], state: State, aggregate, rules: list[Rule]):
        found = union_all(plans)
        if aggregate:
            keys, value, op = self._keys(name, aggregate)
            return self._write(undominated(best_per_key(found, keys, value, op), state.full, keys, value, op), name)
        found = distinct(found)
        if rules and all(r.flags & {"!set-diff", "dedup-only"} for r in rules):
            return self._write(found, name)
        if not state.count:
            return self._write(found, name)
        if self._two_phase(state):
            # the candidates' number is known before anything is broadcast
            candidates, n, path = self._write(found, name)
            few = n <= self.options.broadcast_rows
            got = self._write((difference_two_phase if few else difference)(candidates, state.full), name)
            drop_path(self.spark, path)
        elif state.count <= self.options.two_phase_rows:  # the overlap decides nothing
            return self._write(difference(found, state.full), name)
        else:
            seen = Observation()
            got = self._write(difference(found.observe(seen, F.count(F.lit(1)).alias("n")), state.full), name)
            n = seen.get.get("n", 0)
        state.overlap = max(0.0, 1 - got[1] / n) if n else None
        return got

    def _two_phase(self, state: State) -> bool:
        """Whether the relation is so much larger than what an iteration finds that it shouldn't be shuffled for it. One
        phase costs the building of the relation, two phases that of the candidates and of what both have; between the
        thresholds the last iteration's overlap decides."""
        if self.options.set_difference != "dynamic":
            return self.options.set_difference == "two_phase"
        ratio = state.count / max(state.new, 1)
        if state.count <= self.options.two_phase_rows or ratio <= ONE_PHASE_UP_TO:
            return False
        return ratio >= TWO_PHASE_FROM or state.overlap is not None and state.overlap < ratio / ONE_PHASE_UP_TO - 1

    def _advance(self, name: str, s: State, got, aggregate) -> None:
        s.prev = s.full
        doomed, s.doomed = s.doomed, []
        self._replace(name, s, got, aggregate)
        for path in doomed:
            drop_path(self.spark, path)

    def _replace(self, name: str, s: State, got, aggregate) -> None:
        if got is None or not got[1]:
            if got is not None:
                drop_path(self.spark, got[2])
            s.new, s.delta = 0, empty(self.spark, self.program.relations[name])
            return
        s.delta, s.new, path = got
        if aggregate:
            s.full, s.count, whole = self._write(best_per_key(s.full.unionByName(s.delta), *self._keys(name, aggregate)), name)
            s.doomed, s.paths = [*s.paths, path], [whole]
        else:
            s.paths.append(path)
            s.count += s.new
            if len(s.paths) > self.options.compact_every:
                s.full, _, whole = self._write(self.spark.read.schema(s.delta.schema).parquet(*s.paths), name)
                s.doomed, s.paths = s.paths, [whole]
            else:
                s.full = self.spark.read.schema(s.delta.schema).parquet(*s.paths)
        self.tables[name] = s.full
