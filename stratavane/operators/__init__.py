"""Relational operators on DataFrames without nulls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` that ``right`` has too."""
    return left.join(right, left.columns, "left_semi")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` that ``right`` doesn't have: one anti-join."""
    return left.join(right, left.columns, "left_anti")


def difference_two_phase(left: DataFrame, right: DataFrame) -> DataFrame:
    """The same in two steps, for a small ``left`` whose size is known: neither step shuffles ``right``."""
    common = right.join(F.broadcast(left), left.columns, "left_semi")
    return left.join(F.broadcast(common.distinct()), left.columns, "left_anti")


def undominated(left: DataFrame, right: DataFrame, keys: list[str], value: str, op: str) -> DataFrame:
    """Rows of ``left`` that no row of ``right`` with the same keys equals or betters (MIN: smaller, MAX: larger)."""
    best = right.select(*keys, F.col(value).alias("_best"))
    better = F.col("_best") <= F.col(value) if op == "MIN" else F.col("_best") >= F.col(value)
    if not keys:
        top = best.agg((F.min if op == "MIN" else F.max)("_best").alias("_best"))
        return left.join(F.broadcast(top), better, "left_anti")  # one row
    same = reduce(lambda a, b: a & b, [left[k] == best[k] for k in keys])
    return left.join(best, same & (best["_best"] <= left[value] if op == "MIN" else best["_best"] >= left[value]), "left_anti")


def best_per_key(df: DataFrame, keys: list[str], value: str, op: str) -> DataFrame:
    agg = (F.min if op == "MIN" else F.max)(value).alias(value)
    if keys:
        return df.groupBy(*keys).agg(agg).select(*df.columns)
    return df.agg(agg).filter(F.col(value).isNotNull())


def unless_any(left: DataFrame, right: DataFrame) -> DataFrame:
    """All of ``left`` if ``right`` is empty, else nothing."""
    return left.join(F.broadcast(right.limit(1).select(F.lit(1).alias("_any"))), F.lit(True), "left_anti")  # one row at most
