"""Families of activities: names for patterns over a log's labels, usable wherever a label set is.

A pattern is a label, or a beginning of labels with a ``*`` behind it. All patterns go into one prefix tree, which each label of the log
walks once; what comes out is a dictionary from labels to families. Norms name a family as ``@name``: it is replaced by its labels before
anything is compiled, so families cost nothing at run time. Event frames get the dictionary joined as a column.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normslice.errors import NormError
from normslice.plans.norm import Norm, NormConstraint

MARK = "@"
_RECIPE_LABELS = ("activities", "after", "before", "a", "b")


class Families:
    """``{name: [patterns]}``."""

    def __init__(self, patterns: Mapping[str, Sequence[str]]) -> None:
        self.names = tuple(patterns)
        self._root: dict[str, Any] = {}
        for name, own in patterns.items():
            if isinstance(own, str) or not own or not all(isinstance(p, str) and p for p in own):
                raise NormError(f"family {name!r} needs a list of labels and beginnings of labels")
            for pattern in own:
                node = self._root
                for letter in pattern.removesuffix("*"):
                    node = node.setdefault(letter, {})
                node.setdefault("*prefix" if pattern.endswith("*") else "*whole", set()).add(name)

    def of(self, label: str) -> tuple[str, ...]:
        """The families of a label, in the order in which they were given."""
        node, found = self._root, set()
        for letter in label:
            found |= node.get("*prefix", set())
            if (node := node.get(letter)) is None:
                break
        else:
            found |= node.get("*prefix", set()) | node.get("*whole", set())
        return tuple(n for n in self.names if n in found)

    def dictionary(self, labels: Iterable[str]) -> dict[str, tuple[str, ...]]:
        """``family: its labels`` among those of a log."""
        members: dict[str, list[str]] = {n: [] for n in self.names}
        for label in sorted(set(labels)):
            for name in self.of(label):
                members[name].append(label)
        return {n: tuple(m) for n, m in members.items()}

    def labelled(self, events: DataFrame, activity_col: str, labels: Iterable[str], column: str = "family") -> DataFrame:
        """Events with one row for each family of their activity; NULL for those of none. ``labels`` are the log's (a bounded list)."""
        rows = [(label, name) for name, own in self.dictionary(labels).items() for label in own]
        table = events.sparkSession.createDataFrame(rows, f"__label string, `{column}` string")
        return events.join(F.broadcast(table), F.col(f"`{activity_col}`").cast("string") == F.col("__label"), "left").drop("__label")


def expand(norm: Norm, families: Families, labels: Iterable[str]) -> Norm:
    """The norm with every ``@name`` replaced by the family's labels. A family that the log lacks stays as a label that never occurs."""
    members = families.dictionary(labels)

    def flat(value: Any) -> Any:
        if value is None:
            return None
        out: list[str] = []
        for x in [value] if isinstance(value, str) else value:
            if x.startswith(MARK) and x[1:] not in members:
                raise NormError(f"there is no family {x[1:]!r}")
            out += (members[x[1:]] or (x,)) if x.startswith(MARK) else (x,)
        return tuple(dict.fromkeys(out))

    def ruled(rule: Any) -> Any:
        if isinstance(rule, Mapping):
            return {k: list(flat(v)) if k in ("has", "lacks") else ruled(v) if k in ("all", "any", "not") else v for k, v in rule.items()}
        return [ruled(x) for x in rule] if isinstance(rule, (list, tuple)) else rule

    def changed(nc: NormConstraint) -> NormConstraint:
        c = nc.constraint
        named = {f: flat(getattr(c, f)) for f in c.label_fields if getattr(c, f) is not None}
        return nc.replace(constraint=dataclasses.replace(c, **named), applicability=ruled(nc.applicability))

    recipes = tuple({k: list(flat(v)) if k in _RECIPE_LABELS and v else v for k, v in r.items()} for r in norm.derived_attributes)
    return norm.map_constraints(changed).replace(derived_attributes=recipes)
