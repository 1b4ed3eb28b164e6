"""Engine: runs programs and answers queries over inconsistent data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .config import EngineConfig
from .plans.analysis import Stratum, stratify
from .plans.ast import Program, ProgramError
from .plans.fixpoint import Evaluator, Iteration, Options
from .plans.parser import parse
from .sources import input_relation, write_csv


@dataclass
class Result:
    """Derived relations by name, and what each iteration found."""

    relations: dict[str, DataFrame]
    metrics: list[Iteration] = field(default_factory=list)

    def __getitem__(self, name: str) -> DataFrame:
        return self.relations[name]


class Engine:
    def __init__(self, spark: SparkSession, config: EngineConfig | None = None):
        self.spark, self.config = spark, config or EngineConfig()
        self.views: list[str] = []

    def parse(self, text: str | Program) -> Program:
        return parse(text) if isinstance(text, str) else text

    def _inputs(self, program: Program, given: dict[str, DataFrame]) -> dict[str, DataFrame]:
        unknown = set(given) - {r.name for r in program.inputs}
        if unknown:
            raise ProgramError(f"not inputs of the program: {', '.join(sorted(unknown))}")
        c = self.config
        return {r.name: input_relation(self.spark, r, given.get(r.name), c.preload, c.input_dir, c.csv_delimiter) for r in program.inputs}

    def _options(self, program: Program) -> Options:
        c = self.config
        bags = {r.name for r in program.derived} - set(c.dedup_relation_list) if c.selective_dedup else set()
        return Options(c.max_iterations, c.stop_after, c.set_difference, frozenset(bags))

    def run(self, text: str | Program, edb: dict[str, DataFrame] | None = None) -> Result:
        """Evaluates a program; recursion runs now, the rest when its result is used."""
        program = self.parse(text)
        strata = stratify(program)
        if self.config.preload and self.config.analyze != "off":  # before plans are made
            for r in program.inputs:
                if r.name not in (edb or {}):
                    self.spark.sql(f"ANALYZE TABLE {r.name} COMPUTE STATISTICS" + (" FOR ALL COLUMNS" if self.config.analyze == "full" else ""))
        evaluator = Evaluator(self.spark, program, self._inputs(program, edb or {}), self._options(program))
        for r in program.derived:  # relations without rules are empty
            if not any(r.name in s.relations for s in strata):
                evaluator.tables[r.name] = evaluator.union(r.name, [])
        for k, stratum in enumerate(strata):
            evaluator.evaluate(stratum, self._read_often(stratum, strata[k + 1 :]))
        relations = {r.name: evaluator.tables[r.name] for r in program.derived}
        if self.config.retain_final_output_only:
            relations = {n: df for n, df in relations.items() if n in self.config.final_output_relations}
        for name, df in relations.items():
            df.createOrReplaceTempView(name)
            self.views.append(name)
        if self.config.write_to_csv:
            wanted = self.config.final_output_relations or list(relations)
            for name in wanted:
                write_csv(relations[name], self.config.output_dir or ".", name, self.config.csv_delimiter)
        return Result(relations, evaluator.metrics)

    @staticmethod
    def _read_often(stratum: Stratum, later: list[Stratum]) -> bool:
        """Whether to store a relation that isn't recursive: every iteration, or several rules, would compute it anew."""
        name = stratum.relations[0]
        uses = 0
        for s in later:
            for r in (*s.base, *s.recursive):
                n = sum(a.relation == name for a in (*r.atoms, *r.negations))
                uses += 2 * n if r in s.recursive else n
        return uses > 1

    def to_dataframe(self, text: str | Program, relation: str, edb: dict[str, DataFrame] | None = None) -> DataFrame:
        """One relation of a program without recursion as one lazy plan."""
        program = self.parse(text)
        strata = stratify(program)
        if any(s.recursive for s in strata):
            raise ProgramError("the program is recursive")
        evaluator = Evaluator(self.spark, program, self._inputs(program, edb or {}), self._options(program))
        for s in strata:
            evaluator.evaluate(s, False)
        return evaluator.tables[relation]

    def explain(self, text: str | Program) -> str:
        """Strata in order of evaluation, without running anything."""
        lines = []
        for k, s in enumerate(stratify(self.parse(text))):
            lines.append(f"{k}: {', '.join(s.relations)}" + (" (recursive)" if s.recursive else ""))
            lines += [f"   {r}" for r in (*s.base, *s.recursive)]
        return "\n".join(lines)

    def certain(self, text: str | Program, edb: dict[str, DataFrame] | None = None, method: str | None = None) -> DataFrame:
        """Answers of the program's query that hold in every repair of the key-violating inputs."""
        from . import cqa

        program = self.parse(text)
        return cqa.certain_answers(program, self._inputs(program, edb or {}), method or self.config.cqa or "attack_graph")

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the derived relations of earlier runs."""
        return self.spark.sql(text)

    def close(self) -> None:
        for name in self.views:
            self.spark.catalog.dropTempView(name)
        self.views.clear()
