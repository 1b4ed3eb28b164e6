"""Reading input relations, writing results, and storage of intermediate ones."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import SPARK_TYPES, schema_of
from ..plans.ast import ProgramError, Relation


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one where none is named and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = getattr(spark, "_stratavane_shared", None)
    if own is None and not spark.sparkContext.master.startswith("local"):
        raise ProgramError("set spark.checkpoint.dir to a folder that all executors share")
    if own is None:
        own = spark._stratavane_shared = "file://" + tempfile.mkdtemp(prefix="stratavane-")
    return own


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def store(df: DataFrame, path: str) -> int:
    """Writes Parquet and counts the rows in the same job."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return seen.get["n"]


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read_csv(spark: SparkSession, relation: Relation, folder: str, delimiter: str = ",") -> DataFrame:
    """<folder>/<name>.csv without a header, in the declared types; a value that doesn't parse is an error."""
    path = f"{folder.rstrip('/')}/{relation.name}.csv"
    if "://" not in path and not os.path.exists(path):
        raise ProgramError(f"no input {path} for {relation.name}")
    return spark.read.schema(schema_of(relation)).option("sep", delimiter).option("mode", "FAILFAST").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


def conform(df: DataFrame, relation: Relation) -> DataFrame:
    """A caller's DataFrame as the relation: its columns by name, or else by place, in the declared types."""
    if len(df.columns) < len(relation.attributes):
        raise ProgramError(f"{relation.name} needs {len(relation.attributes)} columns")
    lower = {c.lower(): c for c in df.columns}
    if all(a.name.lower() in lower for a in relation.attributes):
        picked = [F.col(f"`{lower[a.name.lower()]}`") for a in relation.attributes]
    elif len(df.columns) == len(relation.attributes):
        picked = [F.col(f"`{c}`") for c in df.columns]
    else:
        raise ProgramError(f"{relation.name}: columns {df.columns} don't name its attributes")
    return df.select(*[c.cast(SPARK_TYPES[a.type]).alias(a.name) for c, a in zip(picked, relation.attributes)])


def input_relation(spark: SparkSession, relation: Relation, given: DataFrame | None, preload: bool, folder: str | None, delimiter: str) -> DataFrame:
    if given is not None:
        return conform(given, relation)
    if preload:
        return conform(spark.table(relation.name), relation)
    if folder is None:
        raise ProgramError(f"no data for {relation.name}")
    return read_csv(spark, relation, folder, delimiter)


def write_csv(df: DataFrame, folder: str, name: str, delimiter: str = ",") -> None:
    df.write.mode("overwrite").option("sep", delimiter).csv(f"{folder.rstrip('/')}/{name}.csv")


def append(source: DataFrame, target: DataFrame, dedup: bool = False) -> DataFrame:
    """``target`` with the rows of ``source``; with ``dedup`` only new ones, each once."""
    fresh = source.join(target, target.columns, "left_anti").distinct() if dedup else source
    return target.unionByName(fresh)
