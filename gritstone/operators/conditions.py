"""Three-valued conditions: a tree of predicates becomes one Column; null stands for unknown."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, functions as F


def _number(value: object) -> float | None:
    """A finite number, or a text that reads as one."""
    if isinstance(value, bool) or not isinstance(value, (int, float, str)) or (isinstance(value, str) and not value.strip()):
        return None
    try:
        told = float(value)
    except ValueError:
        return None
    return told if math.isfinite(told) else None


def _plain(value: object) -> str | None:
    """How a scalar reads in comparisons without case; null and nested values equal nothing."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value).lower() if isinstance(value, (int, float, str)) else None


def condition(tree: dict | None, facts: dict[str, Column], lists: frozenset[str] = frozenset()) -> Column:
    """True, false or null of tree: {all}, {any}, {not} or {field, operator, value}.

    No tree is true, an empty `all` true, an empty `any` false. A field that facts lacks, or that
    is null, is unknown but for EXISTS and NOT_EXISTS, which are always decided. What is
    malformed is unknown: a tree that isn't one of these, an unknown operator, IN without a list,
    an order comparison with what isn't a finite number. Fields named in `lists` hold arrays of
    strings: IN asks whether they overlap, EQ is false.
    """
    unknown = F.lit(None).cast("boolean")
    if tree is None:
        return F.lit(True)
    if not isinstance(tree, dict):
        return unknown
    for key, join, start in (("all", lambda a, b: a & b, True), ("any", lambda a, b: a | b, False)):
        if key in tree:
            return reduce(join, (condition(t, facts, lists) for t in tree[key]), F.lit(start)) if isinstance(tree[key], list) else unknown
    if "not" in tree:
        return ~condition(tree["not"], facts, lists)
    field, operator, value = tree.get("field"), tree.get("operator"), tree.get("value")
    if not isinstance(field, str):
        return unknown
    if operator in ("EXISTS", "NOT_EXISTS"):
        there = facts[field].isNotNull() if field in facts else F.lit(False)
        return there if operator == "EXISTS" else ~there
    if field not in facts:
        return unknown
    actual, many = facts[field], field in lists
    known = lambda c: F.when(actual.isNotNull(), c)
    among = lambda values: F.exists(actual, lambda x: F.lower(x).isin(values)) if many else F.lower(actual.cast("string")).isin(values) if values else F.lit(False)
    if operator in ("EQ", "NEQ"):
        same = F.lit(False) if many or _plain(value) is None else among([_plain(value)])
        return known(same if operator == "EQ" else ~same)
    if operator in ("IN", "NOT_IN"):
        if not isinstance(value, list):
            return unknown
        hit = among([v for v in map(_plain, value) if v is not None]) if value else F.lit(False)
        return known(hit if operator == "IN" else ~hit)
    limit = _number(value)
    if operator not in ("GT", "GTE", "LT", "LTE") or limit is None or many:
        return unknown
    number = F.trim(actual.cast("string")).try_cast("double")
    number = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    return {"GT": number > limit, "GTE": number >= limit, "LT": number < limit, "LTE": number <= limit}[operator]


def truth(c: Column) -> Column:
    return F.when(c, "TRUE").when(~c, "FALSE").otherwise("UNKNOWN")


def fields(tree: dict | None) -> list[str]:
    """Fields of a tree in the order they are first named."""
    if not isinstance(tree, dict):
        return []
    below = [f for key in ("all", "any") if isinstance(tree.get(key), list) for t in tree[key] for f in fields(t)] + fields(tree.get("not"))
    return list(dict.fromkeys(below + ([tree["field"]] if isinstance(tree.get("field"), str) else [])))


def unresolved(tree: dict | None, facts: dict[str, Column]) -> Column:
    """Fields that keep the tree unknown, in order: those of predicates under sub-trees that are unknown."""

    def walk(t: dict, above: Column) -> list[Column]:
        here = above & condition(t, facts).isNull()
        if not isinstance(t, dict):
            return []
        if "field" in t:
            return [] if t.get("operator") in ("EXISTS", "NOT_EXISTS") else [F.when(here, F.lit(t["field"]))]
        return [c for key in ("all", "any") if isinstance(t.get(key), list) for x in t[key] for c in walk(x, here)] + (walk(t["not"], here) if "not" in t else [])

    found = walk(tree, F.lit(True)) if tree else []
    return F.array_distinct(F.array_compact(F.array(*found))) if found else F.array().cast("array<string>")


def group_truth(mode: Column, need: Column, members: Column, have: Column, open_: Column) -> Column:
    """Whether enough of a requirement group's applicable members are held; open_ are those that can't be decided."""
    least = F.when(mode == "ALL_OF", members).when(mode == "ANY_OF", F.least(F.lit(1), members)).otherwise(F.least(F.greatest(F.coalesce(need, F.lit(1)), F.lit(0)), members))
    return F.when(have >= least, F.lit(True)).when(have + open_ >= least, F.lit(None)).otherwise(F.lit(False))
