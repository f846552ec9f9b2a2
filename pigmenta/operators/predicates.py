"""Metadata predicates: built from plain values, evaluated with absent keys as false."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
}


def build_where(filters: dict[str, object]) -> dict | None:
    """A clause for these values: equality unless a value is a clause itself; null and empty values are left out."""
    parts = [{k: v if isinstance(v, dict) else {"$eq": v}} for k, v in filters.items() if v is not None and v != ""]
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else {"$and": parts}


def where_column(clause: dict | None) -> Column:
    """The clause as a filter that the scan can take over. An absent value is false for every
    operator, ``$ne`` too; an unknown operator is false; no clause is true."""
    if not clause:
        return F.lit(True)
    parts: list[Column] = []
    for key, value in clause.items():
        if key == "$and":
            parts += [where_column(c) for c in value]
        elif isinstance(value, dict):
            parts += [OPERATORS[op](F.col(f"`{key}`"), v) if op in OPERATORS else F.lit(False) for op, v in value.items()]
        else:
            parts.append(F.col(f"`{key}`") == value)
    return reduce(lambda a, b: a & b, parts, F.lit(True)) if len(parts) != 1 else parts[0]
