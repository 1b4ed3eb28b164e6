"""python -m stratavane.cli --program p.datalog [--input DIR] [--output DIR] [--jobs N] [--config FILE] [--sql QUERY]
[--mode network|interactive]. Without --config, Config.json in the folder of CONFIG_FILE_DIR is read if that is set."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .config import EngineConfig
from .engine import Engine


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="stratavane", description=__doc__)
    p.add_argument("--program", required=True)
    p.add_argument("--input")
    p.add_argument("--output")
    p.add_argument("--jobs", type=int)
    p.add_argument("--config")
    p.add_argument("--explain", action="store_true", help="print the strata and stop")
    p.add_argument("--certain", action="store_true", help="answers that hold in every repair")
    p.add_argument("--sql", help="Spark SQL over the derived relations")
    p.add_argument("--mode", choices=("network", "interactive"), default="network", help="interactive: then read SQL, a query a line")
    a = p.parse_args(argv)
    folder = os.environ.get("CONFIG_FILE_DIR")
    path = a.config or (os.path.join(folder, "Config.json") if folder else None)
    config = EngineConfig.from_json(path) if path else EngineConfig()
    config.input_dir = a.input or config.input_dir
    config.jobs = a.jobs or config.jobs
    if a.output:
        config.output_dir, config.write_to_csv = a.output, True
    with open(a.program, encoding="utf-8") as f:
        text = f.read()
    builder = SparkSession.builder.appName("stratavane")
    if config.jobs:
        builder = builder.master(f"local[{config.jobs}]").config("spark.sql.shuffle.partitions", config.jobs)
    spark = builder.getOrCreate()
    engine = Engine(spark, config)
    if a.explain:
        print(engine.explain(text))
    elif a.certain:
        engine.certain(text).show(truncate=False)
    else:
        result = engine.run(text)
        if a.sql:
            engine.sql(a.sql).show(truncate=False)
        else:
            for name, df in result.relations.items():
                print(name, df.count())
        if a.mode == "interactive":
            shell(engine)
    return 0


def shell(engine: Engine, lines=sys.stdin) -> None:
    """Runs each line as Spark SQL over the derived relations, until ``quit`` or the end."""
    for line in lines:
        query = line.strip().rstrip(";")
        if query in ("quit", "exit"):
            return
        if query:
            try:
                engine.sql(query).show(truncate=False)
            except Exception as error:  # a mistake in one line doesn't end the session
                print(str(error).split("\n")[0])


if __name__ == "__main__":
    raise SystemExit(main())
