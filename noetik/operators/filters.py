"""Structured search: filters built from a validated dictionary, never from SQL text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operations a plan may ask for.
OPERATIONS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: ~c.eqNullSafe(v),
    "in": lambda c, v: c.isin(list(v)),
    "ge": lambda c, v: c >= v,
    "le": lambda c, v: c <= v,
    "lt": lambda c, v: c < v,
    "between": lambda c, v: c.between(*v),
    "contains": lambda c, v: F.lower(c).contains(v.lower()),
    "starts": lambda c, v: F.lower(c).startswith(v.lower()),
}


class RejectedPlan(ValueError):
    """The plan names an operation or a field that does not exist."""


def validate(filters: dict[str, dict[str, object]], fields: list[str]) -> None:
    for name, asked in filters.items():
        if name not in fields:
            raise RejectedPlan(f"unknown field {name}")
        for op in asked:
            if op not in OPERATIONS:
                raise RejectedPlan(f"unknown operation {op}")


def search(df: DataFrame, filters: dict[str, dict[str, object]], text: str | None = None, text_fields: tuple[str, ...] = ()) -> DataFrame:
    """Rows that satisfy every filter, {field: {operation: value}}, and hold the text in one of the fields."""
    validate(filters, df.columns)
    tests: list[Column] = [OPERATIONS[op](F.col(name), v) for name, asked in filters.items() for op, v in asked.items()]
    if text:
        tests.append(reduce(lambda a, b: a | b, [OPERATIONS["contains"](F.col(f), text) for f in text_fields]))
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def with_state(df: DataFrame, states: DataFrame, key: str, default: str | None = None) -> DataFrame:
    """df with the state of each key; the default where there is none."""
    out = df.join(states.select(key, "state"), key, "left")
    return out.withColumn("state", F.coalesce("state", F.lit(default))) if default is not None else out


def in_state(df: DataFrame, state: str, negate: bool = False) -> DataFrame:
    """Rows in a state, or not in it; a missing state is not the state."""
    same = F.col("state").eqNullSafe(state)
    return df.where(~same if negate else same)


def visible(df: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Rows whose source is not kept to its metadata."""
    return df.join(decisions.where("action = 'metadata_only'").select(key), key, "left_anti")


def skipped(df: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    return df.join(decisions.where("action = 'metadata_only'"), key)


def valid_at(df: DataFrame, at_ms: int, start: str = "valid_from_ms", end: str = "valid_to_ms") -> DataFrame:
    """Rows whose interval, open where null, holds the time; the end is outside."""
    return df.where((F.col(start).isNull() | (F.col(start) <= at_ms)) & (F.col(end).isNull() | (F.col(end) > at_ms)))


def range_match(low: Column, high: Column, bound: float) -> Column:
    """How a range satisfies an upper bound: full, partial or null."""
    return F.when(high <= bound, "full").when(low <= bound, "partial")
