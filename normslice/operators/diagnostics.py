"""What a slice's gap may owe to the data: open and truncated cases, replicated events, outlying times."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normslice.errors import NormError
from normslice.functions.core import UNIT_SECONDS
from normslice.operators.backlog import keys, ordered, unfiltered
from normslice.operators.scoring import ScoreResult, q
from normslice.plans.compiler import Primitives
from normslice.plans.constraints import finite, labels


def observation_window(log: Any, q: float = 0.001) -> DataFrame:
    return log.observation_window(q)


def _us(window: float, unit: str) -> int:
    return int(finite(window, "window", least=0) * UNIT_SECONDS[unit] * 1_000_000)


def timestamp_outliers(log: Any, window: tuple[Any, Any] | None = None, q: float = 0.001) -> DataFrame:
    """The events with a flag ``outlier``: a known time outside the window (an open side is no bound)."""
    if window is not None:
        log = log._copy()
        log.window = window
    a, b = (log._explicit(0), log._explicit(1)) if log.window is not None else log.window_us(q)
    us = F.col("__us")
    low = us < F.lit(a) if a is not None else F.lit(False)
    high = us > F.lit(b) if b is not None else F.lit(False)
    return log.events.withColumn("outlier", F.coalesce(low | high, F.lit(False)))


def right_censored(log: Any, closure: Any, window: float, *, unit: str = "D", opened_by: Any = None, q: float = 0.001) -> DataFrame:
    """``case_id, censored``: no closing event, and still active within ``window`` of the end."""
    p = Primitives()
    closed = p.count(labels(closure, "closure")) > 0
    opened = p.count(labels(opened_by, "opened_by")) > 0 if opened_by else F.lit(True)
    last = p._ask(["last of all"], lambda: F.max("__us"))
    end = log._explicit(1)
    end = log.window_us(q)[1] if end is None else end
    flag = ~closed & opened & F.coalesce(last >= F.lit(end - _us(window, unit)), F.lit(False))
    return log.aggregated(p).select("case_id", flag.alias("censored"))


def left_truncated(log: Any, opening: Any, window: float, *, unit: str = "D", q: float = 0.001) -> DataFrame:
    """``case_id, truncated``: no opening event, and active within ``window`` of the start."""
    p = Primitives()
    opened = p.count(labels(opening, "opening")) > 0
    first = p._ask(["first of all"], lambda: F.min("__us"))
    start = log._explicit(0)
    start = log.window_us(q)[0] if start is None else start
    flag = ~opened & F.coalesce(first <= F.lit(start + _us(window, unit)), F.lit(False))
    return log.aggregated(p).select("case_id", flag.alias("truncated"))


def event_replication(log: Any) -> DataFrame:
    """Per case: events, distinct times, events per time, share of events that share their time."""
    times = log.events.groupBy("__case", "__us").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("__us").isNotNull()
    return times.groupBy(F.col("__case").alias("case_id")).agg(
        F.sum("n").alias("n_events"),
        F.count_if(known).alias("n_distinct_ts"),
        F.try_divide(F.sum(F.when(known, F.col("n")).otherwise(0)).cast("double"), F.count_if(known)).alias("ratio"),
        F.try_divide(F.sum(F.when(known & (F.col("n") > 1), F.col("n")).otherwise(0)).cast("double"), F.sum(F.when(known, F.col("n")).otherwise(0))).alias("tied_share"),
    )


def cross_case_replication(log: Any, group_col: str, event_keys: Sequence[str] | None = None) -> DataFrame:
    """``case_id, shared``: the share of a case's events that occur, with equal group and keys, in other cases too.

    The key groups are aggregated to "more than one case" first, so no group is collected whatever its size.
    """
    events = log.events
    on = [group_col, *(event_keys or ["__act", "__us"]), *([log.event_id_col] if log.event_id_col else [])]
    if lacking := [c for c in on if c not in events.columns]:
        raise NormError(f"the log lacks the columns {lacking}")
    on = list(dict.fromkeys(on))
    groups = events.groupBy(*(q(c).alias(f"_{c}") for c in on)).agg((F.min("__case") != F.max("__case")).alias("several"))
    condition = F.lit(True)
    for c in on:
        condition = condition & q(c).eqNullSafe(q(f"_{c}"))
    return events.join(groups, condition).groupBy(F.col("__case").alias("case_id")).agg(F.avg(F.col("several").cast("double")).alias("shared"))


def gap_retained(result: ScoreResult, by: str | Sequence[str], exclude: DataFrame, *, view: str | None = None, gamma: float = 0.0) -> DataFrame:
    """How much of each slice's stable gap remains without the flagged cases, against the same population mean.

    ``exclude`` is ``case_id`` and a boolean; both backlogs come from one grouped aggregate.
    """
    by = keys(by)
    frame = unfiltered(result, view)
    flags = exclude.select(F.col(exclude.columns[0]).alias("_id"), F.col(exclude.columns[1]).alias("_out"))
    frame = frame.join(flags, F.col("case_id") == F.col("_id"), "left").withColumn("_keep", ~F.coalesce("_out", F.lit(False)))
    kept = F.when(F.col("_keep"), F.col("score"))
    slices = frame.groupBy(*(q(k) for k in by)).agg(F.count("score").alias("n_cases"), F.count(kept).alias("n_kept"), F.avg("score").alias("m"), F.avg(kept).alias("mk"), F.sum("score").alias("_sum")).where("n_cases > 0")
    slices = slices.crossJoin(F.broadcast(slices.agg((F.sum("_sum") / F.nullif(F.sum("n_cases"), F.lit(0))).alias("global_mean"))))  # one row
    stable = lambda n, m: F.greatest(n / (n + float(gamma)) * (F.col("global_mean") - m), F.lit(0.0))
    out = slices.withColumn("stable_gap", stable(F.col("n_cases"), F.col("m"))).withColumn("kept_gap", F.when(F.col("n_kept") > 0, stable(F.col("n_kept"), F.col("mk"))))
    out = out.withColumn("retained", F.when(F.col("stable_gap") > 0, F.coalesce("kept_gap", F.lit(0.0)) / F.nullif(F.col("stable_gap"), F.lit(0.0))))
    return out.select(*(q(k) for k in by), "n_cases", "n_kept", "stable_gap", "kept_gap", "retained").orderBy(*ordered(F.col("stable_gap") * F.col("n_cases"), by))


def validation_table(
    result: ScoreResult,
    by: str | Sequence[str],
    *,
    view: str | None = None,
    censored: DataFrame | None = None,
    replication: DataFrame | None = None,
    gamma: float = 0.0,
    ratio_flag: float = 1.5,
    top: int = 10,
) -> DataFrame:
    """The top of the backlog with the shares of open and replicated cases and a reading of both, from one grouped aggregate."""
    by = keys(by)
    frame = unfiltered(result, view).select("score", "case_id", *(q(k) for k in by if k != "case_id"))
    known = F.col("score").isNotNull()
    sums = {"n_cases": F.count("score"), "_sum": F.sum("score")}
    for name, flags in (("_c", censored), ("_r", replication)):
        if flags is not None:
            value = flags.columns[1] if name == "_c" else "ratio"
            frame = frame.join(flags.select(F.col(flags.columns[0]).alias(f"_id{name}"), F.col(value).alias(name)), F.col("case_id") == F.col(f"_id{name}"), "left")
    if censored is not None:
        open_ = F.coalesce("_c", F.lit(False))
        sums |= {"n_kept": F.count(F.when(~open_, F.col("score"))), "_kept": F.sum(F.when(~open_, F.col("score"))), "share_censored": F.avg(F.when(known, open_.cast("double")))}
    if replication is not None:
        sums["share_replicated"] = F.avg(F.when(known, (F.coalesce("_r", F.lit(0.0)) >= ratio_flag).cast("double")))
    slices = frame.groupBy(*(q(k) for k in by)).agg(*(c.alias(k) for k, c in sums.items())).where("n_cases > 0")
    out = slices.crossJoin(F.broadcast(slices.agg((F.sum("_sum") / F.nullif(F.sum("n_cases"), F.lit(0))).alias("_mean"))))  # one row
    gap = lambda n, total: F.greatest((F.col("_mean") - F.col(total) / F.nullif(F.col(n), F.lit(0))) * F.col(n) / (F.col(n) + float(gamma)), F.lit(0.0))
    out = out.withColumn("stable_gap", gap("n_cases", "_sum")).withColumn("stable_PI", F.col("stable_gap") * F.col("n_cases"))
    notes, extra = [], []
    if censored is not None:
        kept = F.when(F.col("n_kept") > 0, gap("n_kept", "_kept")).otherwise(F.lit(0.0))
        out = out.withColumn("retained", F.when(F.col("stable_gap") > 0, kept / F.nullif(F.col("stable_gap"), F.lit(0.0))))
        notes += [F.when(F.col("share_censored") >= 0.5, "mostly open cases"), F.when(F.col("retained") < 0.5, "gap fades without open cases")]
        extra += ["share_censored", "retained"]
    if replication is not None:
        notes.append(F.when(F.col("share_replicated") >= 0.5, "mostly replicated events"))
        extra.append("share_replicated")
    out = out.select(*(q(k) for k in by), "n_cases", "stable_gap", "stable_PI", *extra)
    text = F.concat_ws("; ", *notes) if notes else F.lit("")
    out = out.withColumn("reading", F.when(text == "", "stable signal").otherwise(text))
    return out.orderBy(*ordered(F.col("stable_PI"), by)).limit(top)


