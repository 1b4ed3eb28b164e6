"""Scalar expressions and aggregates as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.analysis import INTEGRAL, expression_type
from ..plans.ast import Agg, Const, Relation, Var

SPARK_TYPES = {"int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "varchar": T.StringType(), "char": T.StringType(), "date": T.DateType(), "datetime": T.TimestampType()}


def schema_of(relation: Relation) -> T.StructType:
    return T.StructType([T.StructField(a.name, SPARK_TYPES[a.type], True, {"key": a.key}) for a in relation.attributes])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(value) -> Column:
    return F.lit(value)


def column(expr, types: dict[str, str]) -> Column:
    """A variable, constant or arithmetic expression; / of two integers is integer division."""
    if isinstance(expr, Var):
        return F.col(quoted(expr.name))
    if isinstance(expr, Const):
        return literal(expr.value)
    left, right = column(expr.left, types), column(expr.right, types)
    if expr.op == "+":
        return left + right
    if expr.op == "-":
        return left - right
    if expr.op == "*":
        return left * right
    if all(expression_type(e, types) in INTEGRAL for e in (expr.left, expr.right)):
        return (left - left % right) / right  # exact; cast to the declared type by the head
    return left / right


def comparison(op: str, left: Column, right: Column) -> Column:
    return {"==": left == right, "!=": left != right, ">=": left >= right, "<=": left <= right, ">": left > right, "<": left < right}[op]


def aggregate(agg: Agg, types: dict[str, str]) -> Column:
    arg = column(agg.arg, types)
    return {"MIN": F.min, "MAX": F.max, "SUM": F.sum, "COUNT": F.count, "COUNT_DISTINCT": F.count_distinct}[agg.op](arg)
