"""Applicability rules: a tree of two-valued predicates over case attributes and activities.

Short form: ``{attribute: [values], ...}``. Full form: ``all`` / ``any`` / ``not`` over leaves ``{"attr": name, op: value}``,
``has`` and ``lacks`` activities. A NULL attribute is in no set and meets no comparison; a negation of that is true.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from normslice.errors import NormError
from normslice.functions.core import either, every, member, number
from normslice.plans.constraints import finite, labels

COMPARISONS: dict[str, Callable[[Column, float], Column]] = {
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}
OPERATORS = {"in", "not_in", "eq", "ne", "isna", "notna", *COMPARISONS}
TREE = {"all", "any", "not", "attr", "has", "lacks"}


def normalised(rule: Any) -> dict[str, Any] | None:
    """A checked rule; bare values of the short form become lists, an empty rule is None."""
    if rule is None or rule == {}:
        return None
    if not isinstance(rule, Mapping):
        raise NormError(f"a rule is an object, not {rule!r}")
    if set(rule) & TREE:
        _check(rule)
        return dict(rule)
    out = {k: list(v) if isinstance(v, (list, tuple, set)) else [v] for k, v in rule.items()}
    if empty := [k for k, v in out.items() if not v]:
        raise NormError(f"a rule lists no value for {empty}")
    return out


def _check(rule: Any) -> None:
    if not isinstance(rule, Mapping) or not rule:
        raise NormError(f"a rule is a non-empty object, not {rule!r}")
    kinds = set(rule) & TREE
    if not kinds:
        normalised(rule)
        return
    kind = min(kinds)
    if kind == "attr":
        ops = set(rule) - {"attr"}
        if len(ops) != 1 or not ops <= OPERATORS:
            raise NormError(f"a leaf needs one operator of {sorted(OPERATORS)}: {dict(rule)!r}")
        op = ops.pop()
        value = rule[op]
        if op in COMPARISONS:
            finite(value, f"rule {op}")
        elif op in ("in", "not_in") and (not isinstance(value, (list, tuple, set)) or not value):
            raise NormError(f"rule {op} needs a non-empty list")
        elif op in ("isna", "notna") and not isinstance(value, bool):
            raise NormError(f"rule {op} needs true or false")
        return
    if len(rule) != 1:
        raise NormError(f"{kind} must stand alone: {dict(rule)!r}")
    value = rule[kind]
    if kind in ("has", "lacks"):
        labels(value, kind)
    elif kind == "not":
        _check(value)
    else:
        if not isinstance(value, (list, tuple)) or not value:
            raise NormError(f"{kind} needs a non-empty list of rules")
        for part in value:
            _check(part)


def _walk(rule: Any):
    """All leaves: ``(kind, payload)``."""
    if not rule:
        return
    kinds = set(rule) & TREE
    if not kinds:
        for k, v in rule.items():
            yield "short", (k, v if isinstance(v, list) else [v])
    elif "attr" in kinds:
        yield "attr", rule
    elif "has" in kinds or "lacks" in kinds:
        kind = kinds.pop()
        yield kind, rule[kind]
    elif "not" in kinds:
        yield from _walk(rule["not"])
    else:
        for part in rule[kinds.pop()]:
            yield from _walk(part)


def activities(rule: Any) -> set[str]:
    return {x for kind, v in _walk(rule) if kind in ("has", "lacks") for x in labels(v, kind)}


def attributes(rule: Any) -> set[str]:
    return {v[0] for kind, v in _walk(rule) if kind == "short"} | {v["attr"] for kind, v in _walk(rule) if kind == "attr"}


def why_not(rule: Any, attribute: Callable[[str], Column], count: Callable[[tuple[str, ...]], Column]) -> Column:
    """Why a rule does not hold: the first part that fails, in words; NULL where it holds. Built beside ``column``, of the same parts."""
    if not rule:
        return F.lit(None).cast("string")
    kinds = set(rule) & TREE
    holds = column(rule, attribute, count)
    said = lambda text: F.when(~holds, F.lit(text))
    if not kinds:
        parts = [F.when(attribute(k).isNull(), F.lit(f"{k} is unknown")).when(~member(attribute(k), v if isinstance(v, list) else [v]), F.lit(f"{k} is not listed")) for k, v in rule.items()]
        return F.coalesce(*parts)
    if "attr" in kinds:
        op = next(k for k in rule if k != "attr")
        name = rule["attr"]
        if op in ("isna", "notna"):
            return F.when(~holds, F.when(attribute(name).isNull(), F.lit(f"{name} is unknown")).otherwise(F.lit(f"{name} is known")))
        return F.when(~holds, F.when(attribute(name).isNull(), F.lit(f"{name} is unknown")).otherwise(F.lit(f"{name}: {op} fails")))
    if "has" in kinds:
        return said(f"no {'|'.join(labels(rule['has'], 'has'))}")
    if "lacks" in kinds:
        return said(f"has {'|'.join(labels(rule['lacks'], 'lacks'))}")
    if "not" in kinds:
        return said("excluded")
    if "any" in kinds:
        return said(f"none of {len(rule['any'])} alternatives")
    return F.coalesce(*(why_not(part, attribute, count) for part in rule["all"]))


def column(rule: Any, attribute: Callable[[str], Column], count: Callable[[tuple[str, ...]], Column]) -> Column:
    """The rule as a BOOLEAN that is never NULL."""
    if not rule:
        return F.lit(True)
    kinds = set(rule) & TREE
    if not kinds:
        return every([member(attribute(k), v if isinstance(v, list) else [v]) for k, v in rule.items()])
    if "attr" in kinds:
        c = attribute(rule["attr"])
        op = next(k for k in rule if k != "attr")
        value = rule[op]
        if op in ("in", "not_in"):
            inside = member(c, value)
            return inside if op == "in" else ~inside
        if op in ("eq", "ne"):
            same = F.coalesce(c == value, F.lit(False))
            return same if op == "eq" else ~same
        if op in ("isna", "notna"):
            return c.isNull() if (op == "isna") == value else c.isNotNull()
        return F.coalesce(COMPARISONS[op](number(c), float(value)), F.lit(False))
    if "has" in kinds:
        return count(labels(rule["has"], "has")) > 0
    if "lacks" in kinds:
        return count(labels(rule["lacks"], "lacks")) == 0
    if "not" in kinds:
        return ~column(rule["not"], attribute, count)
    kind = kinds.pop()
    parts = [column(part, attribute, count) for part in rule[kind]]
    return every(parts) if kind == "all" else either(parts)
