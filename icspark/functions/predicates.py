"""Comparisons with exact null rules: equal is false on null, unequal is true on null, order is false on null."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = ("==", "!=", ">=", "<=", ">", "<")
Literal = str | int | float | bool


def _kind(value: Literal) -> str:
    return "bool" if isinstance(value, bool) else "str" if isinstance(value, str) else "num"


def _type_kind(kind: T.DataType) -> str:
    kinds = {"bool": T.BooleanType, "num": T.NumericType, "str": T.StringType, "time": (T.DateType, T.TimestampType, T.TimestampNTZType)}
    return next((name for name, types in kinds.items() if isinstance(kind, types)), "other")


def _moment(value: Literal) -> str | None:
    """A literal that is the text of a date or a time, in the usual form."""
    try:
        return datetime.datetime.fromisoformat(value).isoformat(sep=" ") if isinstance(value, str) else None
    except ValueError:
        return None


def compare(column: Column, kind: T.DataType, op: str, value: Literal) -> Column:
    """column op value. The literal's type is checked when planning: unlike types are never equal, and can't be ordered."""
    have, given = _type_kind(kind), _kind(value)
    if have == "bool" and given == "str" and value.lower() in ("true", "false"):
        given, value = "bool", value.lower() == "true"
    if have == "bool" and given == "num":
        column, have = column.cast("int"), "num"
    if have == "num" and given == "bool":
        given, value = "num", int(value)
    lit = F.lit(value)
    if have == "time" and (moment := _moment(value)):  # a day means its first moment
        given, lit = "time", F.lit(moment).cast("timestamp_ntz" if isinstance(kind, T.TimestampNTZType) else "timestamp")
        column = column.cast("timestamp") if isinstance(kind, T.DateType) else column
    if have != given:
        if op == "==":
            return F.lit(False)
        if op == "!=":
            return F.lit(True)
        raise TypeError(f"can't order {kind.simpleString()} and {value!r}")
    if op == "==":
        return F.coalesce(column == lit, F.lit(False))
    if op == "!=":
        return ~column.eqNullSafe(lit)
    made = {">": column > lit, "<": column < lit, ">=": column >= lit, "<=": column <= lit}[op]
    return F.coalesce(made, F.lit(False))


def in_cell(column: Column, kind: T.DataType, value: str) -> Column:
    """A cell of a conditional dependency: a value, or `lo-hi` on a numeric column."""
    if _type_kind(kind) == "num":
        low, dash, high = value.partition("-") if not value.startswith("-") else (value, "", "")
        try:
            made = column.between(float(low), float(high)) if dash and high else column == float(value)
        except ValueError:  # no number: nothing equals it
            return F.lit(False)
        return F.coalesce(made, F.lit(False))
    return F.coalesce(column.cast("string") == value, F.lit(False))


AGGREGATES = ("mean", "sum", "count", "min", "max", "std", "var", "median")


def aggregate(name: str, column: Column, kind: T.DataType, rows: bool = False) -> Column:
    """One of the eight aggregates; rows: count counts rows, not values. A sum of nothing is 0."""
    if isinstance(kind, T.BooleanType) and name not in ("count", "min", "max"):
        column = column.cast("int")
    if name == "count":
        return F.count(F.lit(1)) if rows else F.count(column)
    if name == "sum":
        return F.coalesce(F.sum(column), F.lit(0))
    return {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp, "median": F.median}[name](column)
