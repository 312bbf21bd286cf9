"""Compiles a norm into one aggregation of the events and row expressions over its result.

Everything that recipes, rules and constraints want to know about a case is requested from ``Primitives``, which names each
distinct request once. The event log then answers all requests in a single ``groupBy(case).agg(...)``: one event-level
shuffle with map-side partial aggregates, whatever the size of the norm.

As-of pairings and counts between anchors read arrays of a case's instants in that aggregation. For logs with traces too long for an
array (``long_traces``) they are second requests: the anchors of the first aggregation are joined back to the events, where adaptive
execution can split the rows of one giant case, and a second aggregation with partial sums answers them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normslice.errors import NormError
from normslice.functions.core import NEVER, duration, member, number, saturate
from normslice.functions.ranks import quantile
from normslice.plans import recipes, rules
from normslice.plans.constraints import Balance, Constraint, Exclusion, Lag, Metric, Precedence, Presence, Singularity

Set = tuple[str, ...]


class Primitives:
    """Requests for per-case aggregates; each distinct one is computed once.

    ``late`` holds those that read the answers of others, ``paired`` the label sets whose next instant each event must know.
    """

    def __init__(self, long_traces: bool = False) -> None:
        self.requests: dict[str, tuple[str, Column]] = {}
        self.long_traces = long_traces
        self.late: dict[str, tuple[str, Column]] = {}
        self.paired: dict[str, tuple[str, Set]] = {}

    def _ask(self, key: Any, aggregate: Callable[[], Column]) -> Column:
        key = json.dumps(key, sort_keys=True, default=str)
        if key not in self.requests:
            self.requests[key] = (f"p{len(self.requests)}", aggregate())
        return F.col(self.requests[key][0])

    def _ask_late(self, key: Any, aggregate: Callable[[], Column]) -> Column:
        key = json.dumps(key, sort_keys=True, default=str)
        if key not in self.late:
            self.late[key] = (f"q{len(self.late)}", aggregate())
        return F.col(self.late[key][0])

    @property
    def names(self) -> set[str]:
        """The columns that hold answers."""
        return {name for name, _ in (*self.requests.values(), *self.late.values())}

    @property
    def aggregates(self) -> list[Column]:
        return [c.alias(name) for name, c in self.requests.values()]

    @staticmethod
    def _hit(activities: Set) -> Column:
        return member(F.col("__act"), activities)

    @staticmethod
    def _order() -> Column:
        return F.struct(F.coalesce("__us", F.lit(NEVER)), F.col("__tie"))

    def count(self, activities: Set) -> Column:
        """Events of the set, those without a time included."""
        return self._ask(["count", activities], lambda: F.count_if(self._hit(activities)))

    def first(self, activities: Set) -> Column:
        return self._ask(["first", activities], lambda: F.min(F.when(self._hit(activities), F.col("__us"))))

    def last(self, activities: Set) -> Column:
        return self._ask(["last", activities], lambda: F.max(F.when(self._hit(activities), F.col("__us"))))

    def times(self, activities: Set) -> Column:
        """All known instants of the set, unordered."""
        return self._ask(["times", activities], lambda: F.collect_list(F.when(self._hit(activities), F.col("__us"))))

    def first_from(self, activities: Set, start: Column) -> Column:
        """The earliest instant of the set at or after ``start``: an as-of pairing inside the aggregation."""
        if self.long_traces:
            return self._ask_late(["from", activities, str(start._jc)], lambda: F.min(F.when(self._hit(activities) & (F.col("__us") >= start), F.col("__us"))))
        return F.array_min(F.filter(self.times(activities), lambda t: t >= start))

    def scoped_count(self, activities: Set, after: Set | None, before: Set | None) -> Column:
        """Events with a time, strictly after / before the first of the anchors; NULL if an anchor has none."""
        start = self.first(after) if after else None
        end = self.first(before) if before else None
        if start is None and end is None:
            return self._ask(["timed", activities], lambda: F.count_if(self._hit(activities) & F.col("__us").isNotNull()))

        def inside(t: Column) -> Column:
            c = F.lit(True)
            c = c & (t > start) if start is not None else c
            return c & (t < end) if end is not None else c

        known = F.lit(True)
        for anchor in (start, end):
            known = known & anchor.isNotNull() if anchor is not None else known
        if self.long_traces:
            hit = lambda: F.count_if(self._hit(activities) & F.coalesce(inside(F.col("__us")), F.lit(False)))
            return F.when(known, F.coalesce(self._ask_late(["between", activities, after, before], hit), F.lit(0)))
        return F.when(known, F.size(F.filter(self.times(activities), inside)))

    def mean_over(self, a: Set, b: Set, judged: Callable[[Column, Column], Column], key: Any) -> tuple[Column, Column]:
        """Over the case's timed ``a``: the mean of what is judged of each and the next ``b`` (NULL: none known), and how many there are."""
        if self.long_traces:
            name = self.paired.setdefault(json.dumps(b), (f"__next{len(self.paired)}", b))[0]
            timed = self._hit(a) & F.col("__us").isNotNull()
            mean = self._ask_late(["each", a, b, key], lambda: F.avg(F.when(timed, judged(F.col("__us"), F.col(name)))))
            return mean, self.scoped_count(a, None, None)
        starts, ends = self.times(a), self.times(b)
        # both sides merged from the last instant to the first, a ``b`` before an ``a`` of the same instant: one pass knows the next ``b``
        side = lambda times, kind: F.transform(times, lambda t: F.struct((-t).alias("back"), F.lit(kind).alias("kind")))
        points = F.sort_array(F.concat(side(ends, 0), side(starts, 1)))
        nothing = F.struct(F.lit(None).cast("long").alias("next"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n"))

        def step(acc: Column, p: Column) -> Column:
            found = F.when(p["kind"] == 1, judged(-p["back"], acc["next"]))
            after = F.when(p["kind"] == 0, -p["back"]).otherwise(acc["next"])
            return F.struct(after.alias("next"), (acc["sum"] + F.coalesce(found, F.lit(0.0))).alias("sum"), (acc["n"] + found.isNotNull().cast("long")).alias("n"))

        folded = F.aggregate(points, nothing, step, lambda acc: F.when(acc["n"] > 0, acc["sum"] / acc["n"]))
        return folded, F.size(starts)

    def total(self, column: str, activities: Set, agg: str) -> Column:
        """Aggregate of a numeric column over the set; what is no number counts as 0, no event gives 0."""

        def made() -> Column:
            x = F.coalesce(number(F.col(f"`{column}`")), F.lit(0.0))
            hit = self._hit(activities)
            plain = {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg}
            if agg in plain:
                return F.coalesce(plain[agg](F.when(hit, x)), F.lit(0.0))
            pick = F.min_by if agg == "first" else F.max_by
            return F.coalesce(pick(F.when(hit, x), F.when(hit, self._order())), F.lit(0.0))

        return self._ask(["total", column, activities, agg], made)

    def events_where(self, where: Any) -> Column:
        return self._ask(["where", where], lambda: F.count_if(recipes.where(where)))

    def distinct(self, column: str, where: Any) -> Column:
        return self._ask(["distinct", column, where], lambda: F.size(F.collect_set(F.when(recipes.where(where), F.col(f"`{column}`")))))

    def aggregate(self, column: str, agg: str, where: Any) -> Column:
        """Numeric aggregate over matching events; NULL for a case without one, sums of unknowns are 0."""

        def made() -> Column:
            hit = recipes.where(where)
            x = F.when(hit, number(F.col(f"`{column}`")))
            plain = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "std": F.stddev_samp}
            if agg == "sum":
                return F.when(F.count_if(hit) > 0, F.coalesce(F.sum(x), F.lit(0.0)))
            if agg in plain:
                return plain[agg](x)
            pick = F.min_by if agg == "first" else F.max_by
            return pick(x, F.when(x.isNotNull(), self._order()))

        return self._ask(["agg", column, agg, where], made)


def lag_violation(c: Lag, p: Primitives, window_end: int | None) -> Column:
    a, b = c.a, c.b
    one, unknown = F.lit(1.0), F.lit(None).cast("double")

    def judged(start: Column, end: Column) -> Column:
        late = duration(start, end, c.unit)
        if c.response == "first_overall":
            late = F.when(late >= 0, late)
        met = F.lit(0.0) if c.delta is None else saturate(late, c.delta, c.width)
        if c.missing_b == "violate":
            open_ = one
        elif c.missing_b == "skip":
            open_ = unknown
        else:
            open_ = saturate(duration(start, F.lit(window_end), c.unit), c.delta or 0.0, c.width)
        return F.when(late.isNull(), open_).otherwise(met)

    without = one if c.missing_a == "violate" else unknown
    if c.activation == "each":
        mean, n = p.mean_over(a, b, judged, c.params)
        return F.when(n == 0, without).otherwise(mean)
    start = p.last(a) if c.activation == "last" else p.first(a)
    end = p.first(b) if c.response == "first_overall" else p.first_from(b, start)
    return F.when(start.isNull(), without).otherwise(judged(start, end))


def violation(c: Constraint, p: Primitives, attribute: Callable[[str], Column], window_end: Callable[[], int | None]) -> Column:
    """The violation of a constraint in [0, 1], NULL where it cannot be evaluated."""
    if isinstance(c, Presence):
        return 1 - F.least(p.count(c.activity) / float(c.m), F.lit(1.0))
    if isinstance(c, (Exclusion, Singularity)):
        n = p.scoped_count(c.activity, c.after, c.before) if c.after or c.before else p.count(c.activity)
        if isinstance(c, Exclusion):
            return (n > 0).cast("double")
        return saturate(n.cast("double"), float(c.k), c.K)
    if isinstance(c, Lag):
        return lag_violation(c, p, window_end() if c.missing_b == "censor" else None)
    if isinstance(c, Precedence):
        n = p.scoped_count(c.b, None, c.a)
        v = F.when(n.isNull(), F.lit(1.0 if c.missing_a == "violate" else None).cast("double")).otherwise(saturate(n.cast("double"), float(c.k), c.K))
        return F.when(p.count(c.b) > 0, v) if c.missing_b == "skip" else v
    if isinstance(c, Balance):
        x, y = p.total(c.attr_x, c.activities_x, c.agg), p.total(c.attr_y, c.activities_y, c.agg)
        gap = F.abs(x - y) / F.greatest(x, y, F.lit(c.eps))
        refuse = F.raise_error(F.lit(f"balance of {c.attr_x} and {c.attr_y}: a total is negative"))
        return F.when((x < 0) | (y < 0), refuse.cast("double")).otherwise(saturate(gap, c.tau, c.width))
    if isinstance(c, Metric):
        z = number(attribute(c.attribute))
        return saturate(z, c.threshold, c.width) if c.direction == "high" else saturate(F.lit(c.threshold) - z, 0.0, c.width)
    raise NormError(f"{c!r} is no known constraint")


def unavailable(c: Constraint, p: Primitives, attribute: Callable[[str], Column]) -> Column:
    """Why a constraint in scope has no violation, in words: its missing evidence."""
    named = "|".join
    first = lambda *pairs: F.coalesce(*(F.when(missing, F.lit(text)) for missing, text in pairs), F.lit("unknown"))
    none = lambda x: p.count(x) == 0
    if isinstance(c, (Exclusion, Singularity)):
        return first(*((none(x), f"no {named(x)}") for x in (c.after, c.before) if x))
    if isinstance(c, Lag):
        return first((none(c.a), f"no {named(c.a)}"), (none(c.b), f"no {named(c.b)}"), (F.lit(True), f"no {named(c.b)} after {named(c.a)}"))
    if isinstance(c, Precedence):
        return first((none(c.a), f"no {named(c.a)}"), (none(c.b), f"no {named(c.b)}"))
    if isinstance(c, Balance):
        sides = ((c.attr_x, c.activities_x), (c.attr_y, c.activities_y))
        return first(*((p.total(x, labels, c.agg).isNull(), f"no {c.agg} of {x} on {named(labels)}") for x, labels in sides))
    if isinstance(c, Metric):
        return first((attribute(c.attribute).isNull(), f"{c.attribute} is unknown"), (F.lit(True), f"{c.attribute} is no number"))
    return F.lit("unknown")


def compiled(log: Any, norm: Any, derive: bool = True, reasons: bool = False) -> DataFrame:
    """The case table with ``v__<id>`` (violation) and ``s__<id>`` (in scope) for each constraint of the norm; with ``reasons`` also
    ``r__<id>``: why a constraint is out of scope or cannot be evaluated, NULL where it has been."""
    p = Primitives(log.has_long_traces(norm.looks_around))
    known = {*log.case_attributes, *log.builtin_attributes}

    def attribute(name: str) -> Column:
        if name not in known:
            raise NormError(f"the case table has no attribute {name!r}")
        return F.col(f"`{name}`")

    derived: list[tuple[str, Any]] = []
    for recipe in norm.derived_attributes if derive else ():
        recipes.check(recipe)
        derived.append((recipe["name"], recipes.column(recipe, p, attribute)))
        known.add(recipe["name"])
    columns = []
    for nc in norm.constraints:
        scope = rules.column(nc.applicability, attribute, p.count)
        nu = violation(nc.constraint, p, attribute, log.censoring_end_us)
        columns += [F.when(scope, nu).alias(f"v__{nc.id}"), scope.alias(f"s__{nc.id}")]
        if reasons:
            lacking = F.when(nu.isNull(), unavailable(nc.constraint, p, attribute))
            columns.append(F.when(scope, lacking).otherwise(rules.why_not(nc.applicability, attribute, p.count)).alias(f"r__{nc.id}"))
    cases = with_derived(log.aggregated(p), derived)
    kept = [c for c in cases.columns if c not in p.names]
    return cases.select(*(F.col(f"`{c}`") for c in kept), *columns)


def with_derived(cases: DataFrame, derived: list[tuple[str, Any]]) -> DataFrame:
    """Adds attributes one after the other; a quantile scale needs its divisor from all cases first."""
    for name, made in derived:
        if isinstance(made, tuple):
            base, q = made
            divisor = quantile(cases, base, q)
            divisor = divisor if divisor and divisor > 0 else 1.0
            made = F.when(base.isNotNull(), F.least(F.greatest(base / F.lit(divisor), F.lit(0.0)), F.lit(1.0)))
        cases = cases.withColumn(name, made)
    return cases
