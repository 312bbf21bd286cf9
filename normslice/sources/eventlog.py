"""The event log: a DataFrame of events with named roles, checked once, never sorted or collected.

Events carry ``__case, __act, __us`` (microseconds, NULL for a missing time) and ``__tie``. Equal times are simultaneous for all
constraints; the tie (``order_col``, or a hash of the row where there is none) only orders first / last values and traces.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normslice.errors import LogSchemaError
from normslice.functions.core import NEVER, UNIT_SECONDS, instant, member, micros, number
from normslice.functions.ranks import order_statistic
from normslice.plans import recipes
from normslice.plans.compiler import Primitives, with_derived
from normslice.plans.constraints import labels

CASE, ACTIVITY, TIMESTAMP = "case:concept:name", "concept:name", "time:timestamp"
#: A column of more distinct labels is refused where labels come to the driver.
MAX_LABELS = 100_000
#: Instants of a case that one array may hold.
LONG_TRACE = 50_000
#: A long trace is paired in stretches of this many microseconds (a day).
STRETCH = 86_400_000_000
RESERVED = ("case_id", "n_events", "first_ts", "last_ts", "exposure", "score")
RESERVED_PREFIXES = ("contrib__", "score__", "v__", "s__", "__")
EXPOSURE_AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg, "first": None, "last": None, "median": F.median}


class EventLog:
    """Roles over a DataFrame of events. ``validate=False`` skips the one aggregate that checks the data.

    ``long_traces`` says whether a case may have more than ``LONG_TRACE`` events; if it is not said, it is counted once, when it matters.
    """

    def __init__(
        self,
        df: DataFrame,
        *,
        case_col: str = CASE,
        activity_col: str = ACTIVITY,
        timestamp_col: str = TIMESTAMP,
        case_attributes: Sequence[str] = (),
        exposure_col: str | None = None,
        exposure_agg: str = "max",
        order_col: str | None = None,
        event_id_col: str | None = None,
        lifecycle_col: str | None = None,
        keep_transitions: Sequence[str] = ("complete",),
        utc: bool = False,
        timestamp_format: str | None = None,
        dayfirst: bool = False,
        missing_timestamps: str = "raise",
        window: tuple[Any, Any] | None = None,
        keep_columns: Sequence[str] | None = None,
        dedupe: bool = False,
        validate: bool = True,
        long_traces: bool | None = None,
    ) -> None:
        roles = [case_col, activity_col, timestamp_col, *case_attributes, *(c for c in (exposure_col, order_col, event_id_col, lifecycle_col) if c)]
        if lacking := sorted(set(roles) - set(df.columns)):
            raise LogSchemaError(f"the log lacks the columns {lacking}")
        if clash := [a for a in case_attributes if a in RESERVED or a.startswith(RESERVED_PREFIXES)]:
            raise LogSchemaError(f"reserved names cannot be case attributes: {clash}")
        if missing_timestamps not in ("raise", "drop", "keep"):
            raise LogSchemaError("missing_timestamps must be raise, drop or keep")
        if exposure_agg not in EXPOSURE_AGGREGATES:
            raise LogSchemaError(f"exposure_agg must be one of {', '.join(EXPOSURE_AGGREGATES)}")
        self.case_col, self.activity_col, self.timestamp_col = case_col, activity_col, timestamp_col
        self.case_attributes = list(dict.fromkeys(case_attributes))
        self.exposure_col, self.exposure_agg = exposure_col, exposure_agg
        self.order_col, self.event_id_col = order_col, event_id_col
        self.window = window
        self._added: list[tuple[str, DataFrame]] = []
        self._derived: list[Mapping[str, Any]] = []
        self._censoring_us: int | None = None
        self._long_traces = long_traces
        if lifecycle_col:
            df = df.where(F.coalesce(F.lower(F.col(f"`{lifecycle_col}`").cast("string")).isin([t.lower() for t in keep_transitions]), F.lit(False)))
        tie = F.col(f"`{order_col}`") if order_col else F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in df.columns))
        kept = df.columns if keep_columns is None else [c for c in df.columns if c in {*keep_columns, *roles}]
        events = df.select(
            *(F.col(f"`{c}`") for c in kept),
            F.col(f"`{case_col}`").alias("__case"),
            F.col(f"`{activity_col}`").cast("string").alias("__act"),
            micros(_instant(df, timestamp_col, timestamp_format, dayfirst, utc)).alias("__us"),
            tie.alias("__tie"),
        )
        if missing_timestamps == "drop":
            events = events.where(F.col("__us").isNotNull())
        if dedupe:
            first = Window.partitionBy("__case", "__act", "__us").orderBy("__tie")
            events = events.withColumn("__row", F.row_number().over(first)).where("__row = 1").drop("__row")
        self.events = events
        if validate:
            self._check(missing_timestamps)

    def _check(self, missing_timestamps: str) -> None:
        """One aggregate over the events for all eager checks."""
        row = self.events.agg(F.count_if(F.col("__case").isNull()).alias("cases"), F.count_if(F.col("__us").isNull()).alias("times")).first()
        if row["cases"]:
            raise LogSchemaError(f"{row['cases']} events have no case id")
        if missing_timestamps == "raise" and row["times"]:
            raise LogSchemaError(f"{row['times']} events have no usable timestamp")
        if self.exposure_col and self.aggregated(Primitives()).where("exposure < 0").limit(1).count():
            raise LogSchemaError("a case has a negative exposure")

    # case table

    def has_long_traces(self, matters: bool = True) -> bool:
        """Whether a case has more than ``LONG_TRACE`` events, as declared or counted (once for a log)."""
        if self._long_traces is None and matters:
            self._long_traces = self.events.groupBy("__case").count().where(F.col("count") > LONG_TRACE).limit(1).count() > 0
        return bool(self._long_traces) and matters

    @property
    def builtin_attributes(self) -> list[str]:
        """Columns of every case table that rules, metrics and recipes may use."""
        return ["case_id", "n_events", "first_ts", "last_ts", *(["exposure"] if self.exposure_col else []), *(name for name, _ in self._added), *(r["name"] for r in self._derived)]

    def aggregated(self, primitives: Primitives) -> DataFrame:
        """``case_id``, case columns and the requested primitives: the one shuffle of the events."""
        order = F.struct(F.coalesce("__us", F.lit(NEVER)), F.col("__tie"))
        picked = []
        for name in self.case_attributes:
            value = F.col(f"`{name}`")
            picked.append(F.min_by(value, F.when(value.isNotNull(), order)).alias(name))
        if self.exposure_col:
            x = number(F.col(f"`{self.exposure_col}`"))
            if self.exposure_agg in ("first", "last"):
                pick = F.min_by if self.exposure_agg == "first" else F.max_by
                made = pick(x, F.when(x.isNotNull(), order))
            else:
                made = EXPOSURE_AGGREGATES[self.exposure_agg](x)
            picked.append(F.coalesce(made, F.lit(0.0)).alias("exposure"))
        cases = self.events.groupBy(F.col("__case").alias("case_id")).agg(
            F.count(F.lit(1)).alias("n_events"), instant(F.min("__us")).alias("first_ts"), instant(F.max("__us")).alias("last_ts"), *picked, *primitives.aggregates
        )
        if primitives.late:
            cases = self._with_late(cases, primitives)
        for name, values in self._added:
            cases = cases.join(values.select(F.col(values.columns[0]).alias("case_id"), F.col(values.columns[1]).alias(name)), "case_id", "left")
        return cases

    def _with_late(self, cases: DataFrame, primitives: Primitives) -> DataFrame:
        """Adds the requests that read other answers: these are joined back to the events, which are aggregated once more."""
        events = self.events
        for name, b in primitives.paired.values():
            events = _with_next(events, b, name)
        anchors = cases.select(F.col("case_id").alias("__id"), *(F.col(name) for name, _ in primitives.requests.values()))
        late = events.join(anchors, F.col("__case") == F.col("__id")).groupBy(F.col("__case").alias("__of")).agg(*(c.alias(name) for name, c in primitives.late.values()))
        return cases.join(late, F.col("case_id") == F.col("__of"), "left").drop("__of")

    @property
    def cases(self) -> DataFrame:
        """One row per case: counts, first and last time, attributes, exposure, derived attributes."""
        p = Primitives(self.has_long_traces(any(r["kind"] in ("count", "lag") for r in self._derived)))
        known = {*self.case_attributes, *self.builtin_attributes}
        made = [(r["name"], recipes.column(r, p, lambda n: self._attribute(n, known))) for r in self._derived]
        cases = with_derived(self.aggregated(p), made)
        return cases.drop(*p.names)

    @staticmethod
    def _attribute(name: str, known: set[str]) -> Column:
        if name not in known:
            raise LogSchemaError(f"the case table has no attribute {name!r}")
        return F.col(f"`{name}`")

    def _copy(self) -> EventLog:
        new = object.__new__(EventLog)
        new.__dict__ = dict(self.__dict__)
        return new

    def derive(self, derived: Sequence[Mapping[str, Any]], overwrite: bool = False) -> EventLog:
        """A log whose case table has these recipes too; the log itself is unchanged."""
        for r in derived:
            recipes.check(r)
            if not overwrite and r["name"] in {*self.case_attributes, *self.builtin_attributes}:
                raise LogSchemaError(f"the case table has {r['name']!r} already")
        new = self._copy()
        new._derived = [*self._derived, *derived]
        return new

    def add_case_attribute(self, name: str, values: DataFrame | Mapping[Any, Any]) -> EventLog:
        """A log with an attribute aligned on the case id from a two-column DataFrame or a mapping; no match is an error."""
        if isinstance(values, Mapping):
            values = self.events.sparkSession.createDataFrame(list(values.items()), ["case_id", name])
        if not self.events.join(values, F.col("__case") == F.col(values.columns[0]), "left_semi").limit(1).count():
            raise LogSchemaError(f"no case id matches the values of {name!r}")
        new = self._copy()
        new._added = [*self._added, (name, values)]
        return new

    # primitives of single label sets

    def _single(self, ask: Any, scoped: bool = False) -> DataFrame:
        p = Primitives(self.has_long_traces(scoped))
        column = ask(p)
        return self.aggregated(p).select("case_id", column.alias("value"))

    def count(self, activity: Any) -> DataFrame:
        return self._single(lambda p: p.count(labels(activity, "activity")))

    def first_ts(self, activity: Any) -> DataFrame:
        return self._single(lambda p: instant(p.first(labels(activity, "activity"))))

    def last_ts(self, activity: Any) -> DataFrame:
        return self._single(lambda p: instant(p.last(labels(activity, "activity"))))

    def first_after(self, a: Any, b: Any, activation: str = "first", response: str = "first_after") -> DataFrame:
        """``case_id, t_a, t_b``."""
        a, b, p = labels(a, "a"), labels(b, "b"), Primitives(self.has_long_traces(response != "first_overall"))
        start = p.last(a) if activation == "last" else p.first(a)
        end = p.first(b) if response == "first_overall" else p.first_from(b, start)
        return self.aggregated(p).select("case_id", instant(start).alias("t_a"), instant(end).alias("t_b"))

    def activation_lags(self, a: Any, b: Any, unit: str = "D") -> DataFrame:
        """``case_id, t_a, lag``: each timed ``a`` with the first ``b`` at or after it, by one running minimum along the trace, from its end."""
        a, b = labels(a, "a"), labels(b, "b")
        ahead = Window.partitionBy("__case").orderBy(F.col("__us").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        timed = self.events.where(F.col("__us").isNotNull() & member(F.col("__act"), {*a, *b}))
        paired = timed.withColumn("__b", F.min(F.when(member(F.col("__act"), b), F.col("__us"))).over(ahead)).where(member(F.col("__act"), a))
        return paired.select(F.col("__case").alias("case_id"), instant(F.col("__us")).alias("t_a"), ((F.col("__b") - F.col("__us")) / 1e6 / UNIT_SECONDS[unit]).alias("lag"))

    def count_scoped(self, activity: Any, after: Any = None, before: Any = None) -> DataFrame:
        side = lambda x: labels(x, "anchor") if x else None
        return self._single(lambda p: p.scoped_count(labels(activity, "activity"), side(after), side(before)), scoped=bool(after or before))

    def count_before(self, b: Any, a: Any) -> DataFrame:
        return self.count_scoped(b, before=a)

    def count_after(self, b: Any, a: Any) -> DataFrame:
        return self.count_scoped(b, after=a)

    def total(self, attr: str, activity: Any, agg: str = "sum") -> DataFrame:
        return self._single(lambda p: p.total(attr, labels(activity, "activity"), agg))

    def attribute(self, name: str) -> DataFrame:
        return self.cases.select("case_id", number(F.col(f"`{name}`")).alias("value"))

    # metadata and traces

    def case_ids(self) -> DataFrame:
        return self.events.select(F.col("__case").alias("case_id")).distinct()

    def activity_labels(self) -> list[str]:
        """The distinct labels, sorted; as many as the process has activities."""
        rows = self.events.where("__act is not null").select("__act").distinct().limit(MAX_LABELS + 1).collect()
        if len(rows) > MAX_LABELS:
            raise LogSchemaError(f"the log has more than {MAX_LABELS} activity labels: is {self.activity_col!r} the activity?")
        return sorted(r["__act"] for r in rows)

    def trace(self, case_id: Any) -> DataFrame:
        """The ordered events of a case."""
        return self.events.where(F.col("__case") == F.lit(case_id)).orderBy(F.col("__us").asc_nulls_last(), "__tie").drop("__case", "__act", "__us", "__tie")

    # observation window

    def _explicit(self, side: int) -> int | None:
        if self.window is None or self.window[side] is None:
            return None
        spark = self.events.sparkSession
        return spark.range(1).select(micros(F.lit(str(self.window[side])))).first()[0]

    def _extremes(self) -> tuple[int | None, int | None]:
        row = self.events.agg(F.min("__us").alias("a"), F.max("__us").alias("b")).first()
        return row["a"], row["b"]

    def window_us(self, q: float = 0.001) -> tuple[int | None, int | None]:
        """Start and end in microseconds: explicit, else robust quantiles of first and last case times (nearest ranks inward)."""
        start, end = self._explicit(0), self._explicit(1)
        if start is not None and end is not None:
            return start, end
        ends = self.events.groupBy("__case").agg(F.min("__us").alias("a"), F.max("__us").alias("b"))
        n = ends.where("a is not null").count()
        if not n:
            return start, end
        if q * (n - 1) < 0.5:
            low, high = self._extremes()
        else:
            low, high = order_statistic(ends, "a", -int(-q * (n - 1) // 1)), order_statistic(ends, "b", int((1 - q) * (n - 1)))
        return (low if start is None else start), (high if end is None else end)

    def observation_window(self, q: float = 0.001) -> DataFrame:
        """One row: ``window_start, window_end``."""
        a, b = self.window_us(q)
        return self.events.sparkSession.range(1).select(instant(F.lit(a).cast("long")).alias("window_start"), instant(F.lit(b).cast("long")).alias("window_end"))

    def censoring_end_us(self, tolerance_days: float = 30.0, q: float = 0.001) -> int | None:
        """The time at which open cases are judged: explicit end, else the robust end; warns of events far beyond it."""
        if self._censoring_us is None:
            end = self._explicit(1)
            if end is None:
                end = self.window_us(q)[1]
                last = self._extremes()[1]
                if end is not None and last - end > tolerance_days * 86_400_000_000:
                    warnings.warn("events lie far beyond the robust end of the log; give an explicit window", stacklevel=2)
            self._censoring_us = end
        return self._censoring_us

    def quality_report(self, q: float = 0.001) -> DataFrame:
        """One row of counts: events, cases, activities, window, missing and outlying times, ties, varying attributes, zero exposure."""
        a, b = self.window_us(q)
        e = self.events
        us = F.col("__us")
        out = us.isNotNull() & ((us < F.lit(a)) | (us > F.lit(b)))
        flat = e.agg(
            F.count(F.lit(1)).alias("n_events"),
            F.count_distinct("__case").alias("n_cases"),
            F.count_distinct("__act").alias("n_activities"),
            instant(F.max("__us")).alias("raw_max"),
            F.count_if(us.isNull()).alias("missing_timestamps"),
            F.count_if(out).alias("outlying_timestamps"),
            F.count_if(F.col("__act").isNull()).alias("null_activities"),
        )
        ties = e.where(us.isNotNull()).groupBy("__case", "__us").agg(F.count(F.lit(1)).alias("n"))
        per_case = ties.groupBy("__case").agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("tied"), F.sum("n").alias("n"))
        tied = per_case.agg(F.coalesce(F.sum("tied") / F.sum("n"), F.lit(0.0)).alias("tied_event_share"), F.coalesce(F.avg((F.col("tied") > 0).cast("double")), F.lit(0.0)).alias("tied_case_share"))
        report = flat.crossJoin(F.broadcast(tied))  # one row each
        if self.case_attributes:
            varies = e.groupBy("__case").agg(*(F.count_distinct(F.col(f"`{c}`")).alias(c) for c in self.case_attributes))
            report = report.crossJoin(F.broadcast(varies.agg(*(F.count_if(F.col(f"`{c}`") > 1).alias(f"varying__{c}") for c in self.case_attributes))))
        if self.exposure_col:
            report = report.crossJoin(F.broadcast(self.aggregated(Primitives()).agg(F.count_if(F.col("exposure") == 0).alias("zero_exposure"))))
        return report

    def to_events(self) -> DataFrame:
        """The events under the standard names of event-log files."""
        names = {self.case_col: CASE, self.activity_col: ACTIVITY, self.timestamp_col: TIMESTAMP}
        return self.events.drop("__case", "__act", "__us", "__tie").withColumnsRenamed(names)


def _with_next(events: DataFrame, b: tuple[str, ...], name: str) -> DataFrame:
    """Adds to each event the first instant of ``b`` at or after it. Long traces are cut into stretches of time: the running minimum
    inside a stretch, or else the first ``b`` of the stretches after it, so a giant case is many tasks' work."""
    hit = F.when(member(F.col("__act"), b), F.col("__us"))
    dealt = events.withColumn("__stretch", F.floor(F.col("__us") / STRETCH))
    back = Window.partitionBy("__case", "__stretch").orderBy(F.col("__us").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy("__c").orderBy(F.col("__s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy(F.col("__case").alias("__c"), F.col("__stretch").alias("__s")).agg(F.min(hit).alias("__f"))
    ahead = firsts.select("__c", "__s", F.min("__f").over(later).alias("__ahead"))
    inside = dealt.withColumn("__inside", F.min(hit).over(back))
    joined = inside.join(ahead, (F.col("__case") == F.col("__c")) & F.col("__stretch").eqNullSafe(F.col("__s")), "left")
    return joined.withColumn(name, F.when(F.col("__us").isNotNull(), F.coalesce("__inside", "__ahead"))).drop("__stretch", "__inside", "__c", "__s", "__ahead")


def _instant(df: DataFrame, name: str, fmt: str | None, dayfirst: bool, utc: bool) -> Column:
    """The timestamp column without zone; text is parsed by the format, then by common ones, failures are NULL."""
    c = F.col(f"`{name}`")
    kind = dict(df.dtypes)[name]
    if kind == "string":
        tries = [fmt] if fmt else []
        common = ["dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy HH:mm:ss", "dd.MM.yyyy HH:mm:ss", "dd/MM/yyyy"] if dayfirst else ["MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy"]
        parsed = [F.try_to_timestamp(c, F.lit(f)) for f in tries] + [F.try_to_timestamp(c)] + [F.try_to_timestamp(c, F.lit(f)) for f in common]
        return F.coalesce(*parsed).cast("timestamp_ntz")
    if kind == "timestamp" and utc:
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz"))
    return c.cast("timestamp_ntz")
