"""Criteria over measures of cases: what a domain's rules need that no event-log constraint expresses.

Measures (runs, returns, spans, breadth, date slips, …) come from ``operators.sequences`` as frames of one row a case. They are attached
to the universe of cases; each criterion turns one of them into a severity by a ramp, within its scope, and says why where it cannot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normslice.errors import NormError
from normslice.functions.core import finite_or_none, number, saturate
from normslice.operators.assessments import score_prepared
from normslice.operators.scoring import ScoreResult, q


@dataclass(frozen=True)
class Criterion:
    """Severity 0 up to ``threshold``, 1 from ``threshold + width`` on; a width of 0 is a strict step.

    ``scope`` (all cases if None; NULL is outside) decides where it applies, ``outside`` says why not; ``missing`` says what is
    missing where the measure is NULL: a text, or a column such as the state of a span.
    """

    measure: str | Column
    threshold: float
    width: float
    scope: Column | None = None
    outside: str = "out of scope"
    missing: str | Column = "no measure"

    def __post_init__(self) -> None:
        for what, value in (("threshold", self.threshold), ("width", self.width)):
            if value is None:
                raise NormError(f"a criterion needs a {what}")
            finite_or_none(value, what, 0.0 if what == "width" else None)


def attach(cases: DataFrame, measures: Sequence[DataFrame], on: str) -> DataFrame:
    """Every row of ``cases`` (one for each case) with the columns of the measures' rows of its key; NULL where a measure has none.

    Left joins keep the partitioning of the cases and measures come grouped by the key, so nothing is shuffled again. Columns of
    one name in two frames are refused; so are measures without the key.
    """
    seen = {c.lower() for c in cases.columns}
    for m in measures:
        own = [c for c in m.columns if c != on]
        if on not in m.columns:
            raise NormError(f"a measure has no column {on!r}")
        if twice := [c for c in own if c.lower() in seen]:
            raise NormError(f"measures share the columns {twice}")
        seen |= {c.lower() for c in own}
        cases = cases.join(m, on, "left")
    return cases


def prepare(measured: DataFrame, criteria: Mapping[str, Criterion], on: str, keep: Sequence[str] = ()) -> DataFrame:
    """``case_id``, the kept columns, and ``sev__``, ``scope__`` and ``reason__`` of each criterion.

    A reason is NULL where the case was assessed. Measures that are text without a number, or NaN, are missing.
    """
    out = [q(on).cast("string").alias("case_id"), *(q(c) for c in keep)]
    for name, c in criteria.items():
        z = number(q(c.measure) if isinstance(c.measure, str) else c.measure)
        inside = F.lit(True) if c.scope is None else F.coalesce(c.scope, F.lit(False))
        why = F.lit(c.missing) if isinstance(c.missing, str) else F.coalesce(c.missing, F.lit("no measure"))
        out += [
            F.when(inside, saturate(z, float(c.threshold), float(c.width))).alias(f"sev__{name}"),
            inside.alias(f"scope__{name}"),
            F.when(~inside, F.lit(c.outside)).when(z.isNull(), why).alias(f"reason__{name}"),
        ]
    return measured.select(*out)


def assess(prepared: DataFrame, criteria: Sequence[str], weights: Mapping[str, Mapping[str, float]], validate: bool = False) -> ScoreResult:
    """Flat scores of prepared criteria in views that differ only in weights."""
    return score_prepared(prepared.drop(*(f"reason__{c}" for c in criteria)), list(criteria), weights, validate=validate)


def evidence(prepared: DataFrame, criteria: Sequence[str]) -> DataFrame:
    """``case_id, constraint, state, reason`` and the kept columns: the long form that ``scoring.reason_profile`` and ``first_examples`` count."""
    rows = [
        F.struct(F.lit(c).alias("constraint"), F.when(~q(f"scope__{c}"), "out_of_scope").when(q(f"sev__{c}").isNull(), "unavailable").otherwise("assessed").alias("state"), q(f"reason__{c}").alias("reason"))
        for c in criteria
    ]
    kept = [q(c) for c in prepared.columns if not c.startswith(("sev__", "scope__", "reason__"))]
    return prepared.select(*kept, F.inline(F.array(*rows)))
