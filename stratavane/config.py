"""Engine settings, from code or a JSON file."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields


@dataclass
class EngineConfig:
    input_dir: str | None = None
    output_dir: str | None = None
    csv_delimiter: str = ","
    preload: bool = False
    write_to_csv: bool = False
    retain_final_output_only: bool = False
    final_output_relations: list[str] = field(default_factory=list)
    selective_dedup: bool = False
    dedup_relation_list: list[str] = field(default_factory=list)
    set_difference: str = "dynamic"
    max_iterations: int = 10_000
    stop_after: int | None = None
    analyze: str = "off"  # off, minimum (sizes) or full (columns too): statistics of stored tables that are given by name
    cqa: str | None = None  # attack_graph, join_graph or pair_pruning
    jobs: int | None = None

    def __post_init__(self) -> None:
        if self.set_difference not in ("dynamic", "one_phase", "two_phase"):
            raise ValueError(f"set_difference: {self.set_difference}")
        if self.analyze not in ("off", "minimum", "full"):
            raise ValueError(f"analyze: {self.analyze}")
        if self.cqa not in (None, "attack_graph", "join_graph", "pair_pruning"):
            raise ValueError(f"cqa: {self.cqa}")

    @classmethod
    def from_json(cls, path: str) -> EngineConfig:
        with open(path) as f:
            given = json.load(f)
        unknown = set(given) - {x.name for x in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**given)
