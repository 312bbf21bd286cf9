"""Derived case attributes: declared as recipes, compiled to Columns over primitives and earlier attributes."""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from normslice.errors import NormError
from normslice.functions.core import UNIT_SECONDS, duration, every, member, number
from normslice.plans.constraints import choice, finite, labels
from normslice.plans.patterns import java

#: The kinds of recipes, what each needs and what it may have, and the quantile that scales by default.
AGGREGATES = ("sum", "mean", "max", "min", "std", "first", "last")
NEEDS = {
    "count": {"activities"},
    "count_events": {"where"},
    "nunique": {"column"},
    "agg": {"column", "agg"},
    "cv": {"column"},
    "lag": {"a", "b"},
    "ratio": {"numerator", "denominator"},
    "quantile_scale": {"attribute"},
    "indicator_times": {"activities", "attribute"},
    "eval": {"expr"},
}
MAY = {
    "count": {"after", "before"},
    "nunique": {"where"},
    "agg": {"where"},
    "cv": {"where", "eps"},
    "lag": {"unit", "activation", "response", "allow_negative"},
    "quantile_scale": {"q"},
}
QUANTILE = 0.95


def check(recipe: Mapping[str, Any]) -> None:
    name, kind = recipe.get("name"), recipe.get("kind")
    if not isinstance(name, str) or not name:
        raise NormError(f"a recipe needs a name: {dict(recipe)!r}")
    if kind not in NEEDS:
        raise NormError(f"recipe {name!r}: unknown kind {kind!r}")
    given = set(recipe) - {"name", "kind", "description"}
    if lacking := NEEDS[kind] - given:
        raise NormError(f"recipe {name!r} lacks {sorted(lacking)}")
    if extra := given - NEEDS[kind] - MAY.get(kind, set()):
        raise NormError(f"recipe {name!r}: unknown options {sorted(extra)}")
    if kind == "agg":
        choice(recipe["agg"], f"recipe {name!r}, agg", AGGREGATES)
    if kind == "quantile_scale" and finite(recipe.get("q", QUANTILE), f"recipe {name!r}, q", least=0, text=True) > 1:
        raise NormError(f"recipe {name!r}: q is out of range")
    if kind == "lag":
        choice(recipe.get("unit", "D"), f"recipe {name!r}, unit", tuple(UNIT_SECONDS))
    if kind == "eval":
        expression(recipe["expr"], None)
    for test in _tests(recipe.get("where")):
        if len(test) != 2 or "column" not in test or not set(test) <= {"column", "in", "not_in", "eq", "regex"}:
            raise NormError(f"recipe {name!r}: a where test is a column and one of in, not_in, eq, regex: {test!r}")
        if "regex" in test:
            java(test["regex"])  # refused now, not when the log is read


def _tests(where: Any) -> list[dict[str, Any]]:
    if not where:
        return []
    if isinstance(where, Mapping) and "column" in where:
        return [dict(where)]
    if isinstance(where, Mapping):  # {column: test or values}
        return [{"column": k, **v} if isinstance(v, Mapping) else {"column": k, "in": v if isinstance(v, list) else [v]} for k, v in where.items()]
    return [dict(t) for t in where]


def where(condition: Any) -> Column:
    """Event predicate; NULL is in no set, equals nothing and matches no pattern, so ``not_in`` takes it."""
    parts = []
    for test in _tests(condition):
        c = F.col(f"`{test['column']}`")
        if "in" in test or "not_in" in test:
            inside = member(c, test.get("in", test.get("not_in")))
            parts.append(inside if "in" in test else ~inside)
        elif "eq" in test:
            parts.append(F.coalesce(c == test["eq"], F.lit(False)))
        else:
            parts.append(F.coalesce(c.cast("string").rlike(java(test["regex"])), F.lit(False)))
    return every(parts)


def activities(recipe: Mapping[str, Any]) -> set[str]:
    return {x for k in ("activities", "after", "before", "a", "b") if recipe.get(k) for x in labels(recipe[k], k)}


def columns(recipe: Mapping[str, Any]) -> set[str]:
    """The event columns that a recipe reads."""
    return {t["column"] for t in _tests(recipe.get("where"))} | ({recipe["column"]} if "column" in recipe else set())


_QUOTED = re.compile(r"`([^`]*)`")
_COMPARE = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne}
#: Functions of one number.
_FUNCTIONS = {"abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "expm1": F.expm1, "log": F.ln, "log10": F.log10, "log1p": F.log1p, "floor": F.floor, "ceil": F.ceil, "sin": F.sin, "cos": F.cos, "tan": F.tan}
_AND_OR = {"&": "and", "|": "or"}
_ARITHMETIC = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: lambda x, y: F.try_divide(x, y), ast.Pow: lambda x, y: F.pow(x, y)}


def expression(text: Any, attribute: Callable[[str], Column] | None) -> Column | None:
    """An ``eval`` expression as a DOUBLE: names (in backticks if they are no words), numbers, ``+ - * / **``, comparisons (also in chains), brackets,
    functions of one number, and ``and``, ``or``, ``not`` (``&``, ``|``, ``~`` bind as loosely as these) over comparisons.

    A division by zero and a result that is no number are NULL; a comparison gives 1 or 0, also of an unknown value (0). Without
    ``attribute`` the expression is only checked.
    """
    quoted: list[str] = []

    def plain(m: re.Match) -> str:
        quoted.append(m[1])
        return f"_quoted_{len(quoted) - 1}_"

    try:
        loose = re.sub("[&|]", lambda m: f" {_AND_OR[m[0]]} ", re.sub("~", " not ", _QUOTED.sub(plain, text)))
        tree = ast.parse(loose.strip(), mode="eval").body
    except (SyntaxError, TypeError, ValueError):
        raise NormError(f"{text!r} is no expression") from None

    def made(node: ast.expr) -> Column | None:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(float(node.value)) if attribute else None
        if isinstance(node, ast.Name):
            name = quoted[int(node.id[8:-1])] if node.id.startswith("_quoted_") else node.id
            return number(attribute(name)) if attribute else None
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            x = made(node.operand)
            return x if x is None or isinstance(node.op, ast.UAdd) else -x
        if isinstance(node, ast.BinOp) and type(node.op) in _ARITHMETIC:
            x, y = made(node.left), made(node.right)
            return _ARITHMETIC[type(node.op)](x, y) if attribute else None
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _FUNCTIONS and len(node.args) == 1 and not node.keywords:
            x = made(node.args[0])
            return _FUNCTIONS[node.func.id](x).cast("double") if attribute else None
        if isinstance(node, (ast.Compare, ast.BoolOp)) or isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            truth = judged(node)
            return truth.cast("double") if attribute else None
        raise NormError(f"an expression takes names, numbers, + - * / **, comparisons, and, or, not, brackets and {sorted(_FUNCTIONS)}: {text!r}")

    def judged(node: ast.expr) -> Column | None:
        """A condition, never NULL."""
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            x = judged(node.operand)
            return ~x if attribute else None
        if isinstance(node, ast.BoolOp):
            parts = [judged(v) for v in node.values]
            return reduce(operator.and_ if isinstance(node.op, ast.And) else operator.or_, parts) if attribute else None
        if isinstance(node, ast.Compare) and all(type(o) in _COMPARE for o in node.ops):
            sides = [made(x) for x in (node.left, *node.comparators)]
            links = [_COMPARE[type(o)](x, y) for o, x, y in zip(node.ops, sides, sides[1:], strict=False)] if attribute else []
            return F.coalesce(reduce(operator.and_, links), F.lit(False)) if attribute else None
        raise NormError(f"and, or, not take comparisons: {text!r}")

    out = made(tree)
    return None if out is None else F.when(F.abs(number(out)) < float("inf"), number(out))


def column(recipe: Mapping[str, Any], primitives: Any, attribute: Callable[[str], Column]) -> Column | tuple[Column, float]:
    """The attribute over the case table; for ``quantile_scale`` the base attribute and the quantile still to be found."""
    kind = recipe["kind"]
    p = primitives
    side = lambda k: labels(recipe[k], k) if recipe.get(k) else None
    if kind == "count":
        return p.scoped_count(side("activities"), side("after"), side("before")).cast("double")
    if kind == "count_events":
        return p.events_where(recipe.get("where")).cast("double")
    if kind == "nunique":
        return p.distinct(recipe["column"], recipe.get("where")).cast("double")
    if kind == "agg":
        return p.aggregate(recipe["column"], recipe["agg"], recipe.get("where"))
    if kind == "cv":
        mean, spread = (p.aggregate(recipe["column"], a, recipe.get("where")) for a in ("mean", "std"))
        return F.when(mean.isNotNull(), F.coalesce(spread, F.lit(0.0)) / F.greatest(F.abs(mean), F.lit(float(recipe.get("eps", 1e-9)))))
    if kind == "lag":
        overall = recipe.get("response", "first_after") == "first_overall"
        start = p.last(side("a")) if recipe.get("activation", "first") == "last" else p.first(side("a"))
        end = p.first(side("b")) if overall else p.first_from(side("b"), start)
        value = duration(start, end, recipe.get("unit", "D"))
        return F.when(value >= 0, value) if overall and not recipe.get("allow_negative") else value
    if kind == "ratio":
        return F.try_divide(number(attribute(recipe["numerator"])), number(attribute(recipe["denominator"])))
    if kind == "quantile_scale":
        return number(attribute(recipe["attribute"])), float(recipe.get("q", QUANTILE))
    if kind == "indicator_times":
        return F.when(p.count(side("activities")) > 0, F.coalesce(number(attribute(recipe["attribute"])), F.lit(0.0))).otherwise(F.lit(0.0))
    return expression(recipe["expr"], attribute)
