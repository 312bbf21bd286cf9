"""Case scores: violations weighted by stakeholder views, renormalised over what could be evaluated.

``score`` compiles norm and log into one wide case table: violations ``v__<id>``, scope flags ``s__<id>``, and for each view
``score__<view>`` and layer contributions ``contrib__<view>__<layer>``. All of it is row arithmetic above the one event shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normslice.errors import NormError, NotScoredError
from normslice.functions.core import either, every, total
from normslice.plans.compiler import compiled
from normslice.plans.norm import MODES, Norm

_ZERO = 0.0


def q(name: str) -> Column:
    """A column by its exact name."""
    return F.col(f"`{name}`")


def weight_columns(weights: Mapping[str, float], layer_of: Mapping[str, str], mode: str, violation=lambda c: q(f"v__{c}")) -> tuple[dict[str, Column], Column]:
    """Effective weight of each constraint (0 where it was not evaluated) and whether the case is scored."""
    live = {c: F.when(violation(c).isNotNull(), F.lit(float(w))).otherwise(F.lit(_ZERO)) for c, w in weights.items() if w > 0}
    if not live:
        raise NormError("no constraint has a positive weight")
    if mode == "flat":
        base = total(list(live.values()))
        return {c: F.when(base > 0, w / base).otherwise(F.lit(_ZERO)) for c, w in live.items()}, base > 0
    members: dict[str, list[str]] = {}
    for c in live:
        members.setdefault(layer_of[c], []).append(c)
    share = {layer: sum(float(weights[c]) for c in ids) for layer, ids in members.items()}
    inner = {layer: total([live[c] for c in ids]) for layer, ids in members.items()}
    active = total([F.when(inner[layer] > 0, F.lit(share[layer])).otherwise(F.lit(_ZERO)) for layer in members])
    effective = {c: F.when(inner[layer] > 0, share[layer] * live[c] / inner[layer] / active).otherwise(F.lit(_ZERO)) for layer, ids in members.items() for c in ids}
    return effective, active > 0


def with_scores(df: DataFrame, norm: Norm, views: Sequence[str], mode: str) -> DataFrame:
    """Adds ``score__<view>`` and ``contrib__<view>__<layer>``; NULL for a case that the view cannot score.

    Sums per layer, then what is active, then contributions, then the score: each step reads columns of the one before, so
    no sum is written out twice in the plan.
    """
    # as text: a Column is a dozen calls into the JVM, and there are views times constraints of them
    kept, layer_of, layers = df.columns, norm.layer_of, norm.layer_ids
    plans: dict[str, dict[str, float]] = {}
    first: list[str] = []
    for i, view in enumerate(views):
        weights = {c: float(w) for c, w in norm.raw_weights(view).items() if w > 0}
        members = {x: [c for c in weights if layer_of[c] == x] for x in layers}
        plans[view] = {x: sum(weights[c] for c in ids) for x, ids in members.items() if ids}
        for j, ids in enumerate(ids for ids in members.values() if ids):
            first.append(_sum(f"IF(`v__{c}` IS NOT NULL, {weights[c]!r}D, 0.0D)" for c in ids) + f" AS __in_{i}_{j}")
            first.append(_sum(f"coalesce(`v__{c}`, 0.0D) * {weights[c]!r}D" for c in ids) + f" AS __pen_{i}_{j}")
    df = df.selectExpr("*", *first)
    second = []
    for i, view in enumerate(views):
        inner = [f"__in_{i}_{j}" for j in range(len(plans[view]))]
        active = inner if mode == "flat" else [f"IF({x} > 0, {w!r}D, 0.0D)" for x, w in zip(inner, plans[view].values(), strict=True)]
        second.append(f"{_sum(active)} AS __act_{i}")
    df = df.selectExpr("*", *second)
    third = []
    for i, view in enumerate(views):
        place = {x: j for j, x in enumerate(plans[view])}
        for x in layers:
            part = "0.0D"
            if x in place:
                inner, penalty = f"__in_{i}_{place[x]}", f"__pen_{i}_{place[x]}"
                part = f"{penalty} / __act_{i}" if mode == "flat" else f"IF({inner} > 0, {plans[view][x]!r}D * {penalty} / {inner} / __act_{i}, 0.0D)"
            third.append(f"IF(__act_{i} > 0, {part}, NULL) AS `contrib__{view}__{x}`")
    df = df.selectExpr("*", *third)
    scores = [f"IF(__act_{i} > 0, 1 - {_sum(f'`contrib__{v}__{x}`' for x in layers)}, NULL) AS `score__{v}`" for i, v in enumerate(views)]
    return df.selectExpr(*(f"`{c}`" for c in kept), *scores, *(f"`contrib__{v}__{x}`" for v in views for x in layers))


def _sum(terms: Iterable[str]) -> str:
    return f"({' + '.join(['0.0D', *terms])})"


def score(log: Any, norm: Norm, *, views: Sequence[str] | None = None, mode: str | None = None, derive: bool = True) -> ScoreResult:
    """Score every case of the log under every view of the norm (lazily)."""
    mode = mode or norm.scoring_mode
    if mode not in MODES:
        raise NormError(f"scoring mode must be one of {', '.join(MODES)}")
    names = list(views or norm.view_names)
    norm.validate()
    return ScoreResult(with_scores(compiled(log, norm, derive), norm, names, mode), norm, names, mode, log)


class ScoreResult:
    """The scored case table and what is read off it. ``persist()`` keeps it for several reports."""

    def __init__(self, table: DataFrame, norm: Norm, views: list[str], mode: str, log: Any = None) -> None:
        self.table, self.norm, self.views, self.mode, self.log = table, norm, views, mode, log
        self.fingerprint = norm.fingerprint

    def persist(self) -> ScoreResult:
        self.table = self.table.persist()
        return self

    def unpersist(self) -> None:
        self.table.unpersist()

    def view(self, name: str | None) -> str:
        name = name or self.views[0]
        if name not in self.views:
            raise NormError(f"view {name!r} was not scored; there are {', '.join(self.views)}")
        return name

    @property
    def ids(self) -> list[str]:
        return self.norm.constraint_ids

    def where(self, condition: Column | Mapping[str, Any] | None) -> Column:
        """A filter: a Column, or attribute values that must all hold (a list means any of its values)."""
        if condition is None:
            return F.lit(True)
        if isinstance(condition, Column):
            return F.coalesce(condition, F.lit(False))
        if extra := sorted(set(condition) - set(self.table.columns)):
            raise NormError(f"the case table has no columns {extra}")
        return every([F.coalesce(q(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else q(k) == v, F.lit(False)) for k, v in condition.items()])

    def is_scored(self, view: str) -> Column:
        """True for cases with an evaluated constraint of positive weight. As a filter it is cheaper than ``score is not null``:
        pushed below the projections it repeats the violations once, not all of the score's arithmetic."""
        weights = self.norm.raw_weights(self.view(view))
        return either([q(f"v__{c}").isNotNull() for c, w in weights.items() if w > 0])

    def case_columns(self) -> list[str]:
        return [c for c in self.table.columns if not c.startswith(("v__", "s__", "score__", "contrib__"))]

    def frame(self, view: str | None = None) -> DataFrame:
        """Per case: one view's ``score`` and ``contrib__<layer>``, or all views with their names in the columns."""
        own = [q(c) for c in self.case_columns()]
        if view is None and len(self.views) > 1:
            return self.table.select(*own, *(q(c) for c in self.table.columns if c.startswith(("score__", "contrib__"))))
        v = self.view(view)
        return self.table.select(*own, q(f"score__{v}").alias("score"), *(q(f"contrib__{v}__{x}").alias(f"contrib__{x}") for x in self.norm.layer_ids))

    def violations(self) -> DataFrame:
        return self.table.select("case_id", *(q(f"v__{c}").alias(c) for c in self.ids))

    def in_scope(self) -> DataFrame:
        return self.table.select("case_id", *(q(f"s__{c}").alias(c) for c in self.ids))

    def applicable(self) -> DataFrame:
        """Which constraints were evaluated, per case."""
        return self.table.select("case_id", *(q(f"v__{c}").isNotNull().alias(c) for c in self.ids))

    def effective_weights(self, view: str | None = None) -> DataFrame:
        """Per case, 0 for an unscored one."""
        effective, _ = weight_columns(self.norm.raw_weights(self.view(view)), self.norm.layer_of, self.mode)
        return self.table.select("case_id", *(effective.get(c, F.lit(_ZERO)).alias(c) for c in self.ids))

    def penalty(self, view: str | None = None) -> dict[str, Column]:
        effective, _ = weight_columns(self.norm.raw_weights(self.view(view)), self.norm.layer_of, self.mode)
        return {c: effective[c] * F.coalesce(q(f"v__{c}"), F.lit(_ZERO)) if c in effective else F.lit(_ZERO) for c in self.ids}

    def penalties(self, view: str | None = None) -> DataFrame:
        return self.table.select("case_id", *(c.alias(k) for k, c in self.penalty(view).items()))

    def summary(self) -> DataFrame:
        """A row for each view: scored cases, mean score, mean contribution of each layer."""
        layers = self.norm.layer_ids
        rows = [
            F.struct(
                F.lit(v).alias("view"), F.count(q(f"score__{v}")).alias("n_scored"), F.avg(q(f"score__{v}")).alias("mean_score"), *(F.avg(q(f"contrib__{v}__{x}")).alias(f"mean_contrib__{x}") for x in layers)
            )
            for v in self.views
        ]
        return self.table.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))

    def applicability_density(self, scope: bool = False) -> DataFrame:
        """One row: the mean share of constraints evaluated (or in scope) per case."""
        marks = [(q(f"s__{c}") if scope else q(f"v__{c}").isNotNull()).cast("double") for c in self.ids]
        return self.table.agg(F.avg(total(marks) / len(marks)).alias("density"))

    def check_decomposition(self, atol: float = 1e-9) -> float:
        """The largest gap between a score and its layer contributions; raises when above ``atol``."""
        gaps = [F.max(F.abs(total([q(f"contrib__{v}__{x}") for x in self.norm.layer_ids]) - (1 - q(f"score__{v}")))).alias(f"g{i}") for i, v in enumerate(self.views)]
        worst = max((g for g in self.table.agg(*gaps).first() if g is not None), default=0.0)
        if worst > atol:
            raise NotScoredError(f"contributions miss the score by {worst}")
        return worst

    def worst_cases(self, view: str | None = None, n: int = 10, where: Any = None) -> DataFrame:
        """The ``n`` lowest scores, ties by case id."""
        v = self.view(view)
        return self.table.where(self.where(where) & self.is_scored(v)).orderBy(q(f"score__{v}"), "case_id").limit(n).select("case_id", q(f"score__{v}").alias("score"))


def violation_matrix(log: Any, norm: Norm, derive: bool = True) -> DataFrame:
    """``case_id`` with ``v__`` and ``s__`` columns."""
    table = compiled(log, norm, derive)
    return table.select("case_id", *(q(c) for c in table.columns if c.startswith(("v__", "s__"))))


def evaluate_constraint(log: Any, nc: Any, norm: Norm | None = None) -> DataFrame:
    """``case_id, violation`` of a single constraint."""
    alone = (norm or Norm((nc,))).replace(constraints=(nc,), layers=(), views=())
    return compiled(log, alone).select("case_id", q(f"v__{nc.id}").alias("violation"))


def reasons(log: Any, norm: Norm, derive: bool = True) -> DataFrame:
    """``case_id, constraint, state, reason`` for every case and constraint: ``assessed``, ``out_of_scope`` or ``unavailable``, and why (NULL if assessed).

    A scope that does not hold names the first part of the rule that fails; missing evidence names what is missing.
    """
    table = compiled(log, norm, derive, reasons=True)
    each = F.array(*(F.struct(F.lit(c.id).alias("constraint"), F.when(~q(f"s__{c.id}"), "out_of_scope").when(q(f"v__{c.id}").isNull(), "unavailable").otherwise("assessed").alias("state"), q(f"r__{c.id}").alias("reason")) for c in norm.constraints))
    return table.select("case_id", *(q(c) for c in table.columns if not c.startswith(("v__", "s__", "r__")) and c != "case_id"), F.inline(each))


def reason_profile(found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cases by group, constraint, state and reason of ``reasons``."""
    return found.groupBy(*map(q, by), "constraint", "state", "reason").agg(F.count(F.lit(1)).alias("n_cases"))


def first_examples(found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """For each group, constraint, state and reason of ``reasons``: how many cases, and the one of smallest id as its example."""
    return found.groupBy(*map(q, by), "constraint", "state", "reason").agg(F.count(F.lit(1)).alias("n_cases"), F.min("case_id").alias("example"))
