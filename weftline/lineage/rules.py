"""Selectivity and transfer rules over metadata, compiled to Column expressions.

A rule set is {key: {"$eq": v} | {"$gt": v} | {"$lt": v} | {"$gt": v, "$lt": w}}.
The first key of the rules that a metadata item has decides about the item; both
bounds together are an open interval.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = dict[str, dict[str, object]]


def holds(value: Column, rule: dict[str, object]) -> Column:
    if "$eq" in rule:
        return value == F.lit(rule["$eq"])
    parts = []
    if "$gt" in rule:
        parts.append(value > F.lit(rule["$gt"]))
    if "$lt" in rule:
        parts.append(value < F.lit(rule["$lt"]))
    if not parts:
        raise ValueError(f"no known operator in {rule}")
    return reduce(lambda a, b: a & b, parts)


def _first(values: dict[str, Column], rules: Rules, absent: bool) -> Column:
    out = F.lit(absent)
    for key, rule in reversed(list(rules.items())):
        if key in values:
            out = F.when(values[key].isNotNull(), F.coalesce(holds(values[key], rule), F.lit(False))).otherwise(out)
    return out


def keeps(values: dict[str, Column], rules: Rules) -> Column:
    """Whether lineage of a datum is kept; true where no rule's key is present."""
    return _first(values, rules, True)


def transfers(values: dict[str, Column], rules: Rules) -> Column:
    """Whether a datum is moved on; false where no rule's key is present."""
    return _first(values, rules, False)


def keeps_map(metadata: Column, rules: Rules) -> Column:
    """:func:`keeps` over a map<string,string> column; numbers are compared as numbers."""
    return _map(metadata, rules, True)


def transfers_map(metadata: Column, rules: Rules) -> Column:
    return _map(metadata, rules, False)


def _map(metadata: Column, rules: Rules, absent: bool) -> Column:
    values = {}
    for key, rule in rules.items():
        text = F.try_element_at(metadata, F.lit(key))
        numeric = all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in rule.values())
        values[key] = text.try_cast("double") if numeric else text
    return _first(values, rules, absent)


def any_item_keeps(items: Column, rules: Rules) -> Column:
    """Over an array of metadata maps: the first item that has a rule's key decides."""
    hit = F.filter(items, lambda m: reduce(lambda a, b: a | b, (F.map_contains_key(m, k) for k in rules), F.lit(False)))
    return F.when(F.size(hit) > 0, keeps_map(F.element_at(hit, 1), rules)).otherwise(F.lit(True))
