"""Conditions as data: a tree becomes a short program in postfix order, which a fold evaluates row by row.

A program is an array of (op, field, values, arity): a predicate's operator with its field and
values, or ALL, ANY, NOT, which take the results of the `arity` steps before them.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F

from .conditions import _number, _plain

PROGRAM = "array<struct<op:string,field:string,values:array<string>,arity:int>>"
_STACK = "array<struct<truth:boolean,pending:array<string>>>"
OPERATORS = frozenset("EQ NEQ IN NOT_IN GT GTE LT LTE EXISTS NOT_EXISTS".split())


def program(tree: object) -> list[tuple[str, str | None, list[str], int]]:
    """The steps of a tree; what is malformed is a step UNKNOWN, no tree is the empty program (true)."""
    if tree is None:
        return []
    if isinstance(tree, dict):
        for key, op in (("all", "ALL"), ("any", "ANY")):
            if isinstance(tree.get(key), list):
                return [s for t in tree[key] for s in (program(t) or [("ALL", None, [], 0)])] + [(op, None, [], len(tree[key]))]
        if "not" in tree:
            return [*(program(tree["not"]) or [("ALL", None, [], 0)]), ("NOT", None, [], 1)]
        field, op, value = tree.get("field"), tree.get("operator"), tree.get("value")
        if isinstance(field, str) and op in OPERATORS:
            if op in ("IN", "NOT_IN"):
                return [(op if isinstance(value, list) else "UNKNOWN", field, [v for v in map(_plain, value) if v is not None] if isinstance(value, list) else [], 0)]
            if op in ("EXISTS", "NOT_EXISTS"):
                return [(op, field, [], 0)]
            told = _plain(value) if op in ("EQ", "NEQ") else None if _number(value) is None else repr(_number(value))
            return [(op if told is not None or op in ("EQ", "NEQ") else "UNKNOWN", field, [] if told is None else [told], 0)]
        if isinstance(field, str):
            return [("UNKNOWN", field, [], 0)]
    return [("UNKNOWN", None, [], 0)]


def programs(condition: Column) -> Column:
    """Programs of conditions as JSON; null is no condition, what isn't JSON is unknown."""

    def one(text: str | None) -> list:
        try:
            return program(None if text is None else json.loads(text))
        except ValueError:
            return [("UNKNOWN", None, [], 0)]

    @F.pandas_udf(PROGRAM)
    def told(conditions: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("op", "field", "values", "arity"), s, strict=True)) for s in one(t)] for t in conditions], dtype=object)

    return told(condition)


def evaluated(steps: Column, facts: Column) -> Column:
    """(truth, pending) of a program on facts, a map of strings: truth is null if unknown, pending the fields that keep it so, in order."""
    none = F.array().cast("array<string>")

    def predicate(x: Column) -> Column:
        actual, op = F.try_element_at(facts, F.coalesce(x["field"], F.lit(""))), x["op"]
        number = F.trim(actual).try_cast("double")
        number, limit = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number), F.get(x["values"], F.lit(0)).try_cast("double")
        hit = F.array_contains(x["values"], F.lower(actual))
        told = F.when(op.isin("EQ", "IN"), hit).when(op.isin("NEQ", "NOT_IN"), ~hit).when(op == "GT", number > limit).when(op == "GTE", number >= limit).when(op == "LT", number < limit).when(op == "LTE", number <= limit)
        truth = F.when(op == "EXISTS", actual.isNotNull()).when(op == "NOT_EXISTS", actual.isNull()).when(actual.isNotNull(), told)
        return F.struct(truth.alias("truth"), F.when(truth.isNull() & x["field"].isNotNull(), F.array(x["field"])).otherwise(none).alias("pending"))

    def step(stack: Column, x: Column) -> Column:
        n = F.size(stack) - x["arity"]
        taken = F.slice(stack, n + 1, x["arity"])
        joined = F.when(x["op"] == "ALL", F.forall(taken, lambda t: t["truth"])).when(x["op"] == "ANY", F.exists(taken, lambda t: t["truth"])).when(x["op"] == "NOT", ~F.get(taken, F.lit(0))["truth"])
        own = F.struct(joined.alias("truth"), F.when(joined.isNull(), F.array_distinct(F.flatten(taken["pending"]))).otherwise(none).alias("pending"))
        return F.concat(F.slice(stack, 1, n), F.array(F.when(x["op"].isin("ALL", "ANY", "NOT"), own).otherwise(predicate(x)))).cast(_STACK)

    stack = F.aggregate(steps, F.array().cast(_STACK), step)
    empty = F.struct(F.lit(True).alias("truth"), none.alias("pending"))
    return F.when(steps.isNull() | (F.size(steps) == 0), empty).otherwise(F.element_at(stack, 1))
