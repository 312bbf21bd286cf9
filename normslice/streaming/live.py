"""Scores of cases while their events arrive.

Violations of one case need no other case, so a stream can keep per-case aggregates in Spark's state store: counts, first and last
times by activity, and totals. The state of a case grows with its activities, not its events. Every trigger emits the
cases that changed; a foreach-batch sink upserts them and slices stay batch queries on that table.

A case's state ends when nothing has come for it for ``idle``: cases are sessions, and the watermark drops a session that it has
passed. Events later than the watermark are dropped with it; a case that wakes up after ``idle`` starts anew, as another row with
a later ``opened``. A stream must say which it wants: ``idle``, or ``keep_forever``, where a case is one row and its state is never dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normslice.errors import NormError
from normslice.functions.core import duration, member, micros, number, saturate
from normslice.operators.scoring import with_scores
from normslice.plans.constraints import Balance, Constraint, Exclusion, Lag, Presence, Singularity
from normslice.plans.norm import Norm


def _aggregates(c: Constraint) -> dict[str, Column]:
    """The incremental aggregates that a constraint reads, named by content."""
    hit = lambda labels: member(F.col("__act"), labels)
    name = lambda kind, labels: f"{kind}:{'|'.join(labels)}"
    if isinstance(c, (Presence, Exclusion, Singularity)):
        return {name("n", c.activity): F.count_if(hit(c.activity))}
    if isinstance(c, Lag):
        return {name("a", c.a): F.min(F.when(hit(c.a), F.col("__us"))), name("a", c.b): F.min(F.when(hit(c.b), F.col("__us")))}
    return {f"t:{x}:{'|'.join(s)}": F.coalesce(F.sum(F.when(hit(s), F.coalesce(number(F.col(f"`{x}`")), F.lit(0.0)))), F.lit(0.0)) for x, s in ((c.attr_x, c.activities_x), (c.attr_y, c.activities_y))}


def _streamable(norm: Norm) -> None:
    for nc in norm.constraints:
        c = nc.constraint
        fits = isinstance(c, Presence) or (isinstance(c, (Exclusion, Singularity)) and not c.after and not c.before)
        fits = fits or (isinstance(c, Lag) and c.activation == "first" and c.response == "first_overall" and c.missing_b != "censor") or (isinstance(c, Balance) and c.agg == "sum")
        if not fits or nc.applicability:
            raise NormError(f"constraint {nc.id!r} needs the whole case; score it in batch")


def live_scores(events: DataFrame, norm: Norm, *, case_col: str, activity_col: str, timestamp_col: str, watermark: str | None = "1 day", idle: str | None = None, keep_forever: bool = False) -> DataFrame:
    """Scores per case of a (streaming or batch) frame of events: ``case_id``, with ``idle`` also ``opened``, counts and scores.

    A stream that keeps its cases for ever is written in mode ``update``; with ``idle`` in ``append``, when a case is over (Spark
    emits sessions only then). A watermark needs a TIMESTAMP column.
    """
    _streamable(norm)
    if idle and keep_forever or events.isStreaming and not (idle or keep_forever):
        raise NormError("a stream of cases needs either idle, after which a case's state ends, or keep_forever")
    if watermark and events.isStreaming:
        events = events.withWatermark(timestamp_col, watermark)
    rows = events.select("*", F.col(f"`{activity_col}`").cast("string").alias("__act"), micros(F.col(f"`{timestamp_col}`")).alias("__us"))
    wanted = {k: v for nc in norm.constraints for k, v in _aggregates(nc.constraint).items()}
    session = [F.session_window(F.col(f"`{timestamp_col}`"), idle).alias("session")] if idle else []
    cases = rows.groupBy(F.col(f"`{case_col}`").alias("case_id"), *session).agg(F.count(F.lit(1)).alias("n_events"), *(v.alias(k) for k, v in wanted.items()))
    columns = []
    for nc in norm.constraints:
        c = nc.constraint
        x, *rest = (F.col(f"`{k}`") for k in _aggregates(c))
        if isinstance(c, Presence):
            v = 1 - F.least(x / float(c.m), F.lit(1.0))
        elif isinstance(c, Exclusion):
            v = (x > 0).cast("double")
        elif isinstance(c, Singularity):
            v = saturate(x.cast("double"), float(c.k), c.K)
        elif isinstance(c, Lag):
            late = duration(x, rest[0], c.unit)
            late = F.when(late >= 0, late)
            open_ = F.lit(1.0) if c.missing_b == "violate" else F.lit(None).cast("double")
            met = F.lit(0.0) if c.delta is None else saturate(late, c.delta, c.width)
            v = F.when(x.isNull(), F.lit(1.0 if c.missing_a == "violate" else None).cast("double")).otherwise(F.when(late.isNull(), open_).otherwise(met))
        else:
            y = rest[0] if rest else x
            refuse = F.raise_error(F.lit(f"balance of {c.attr_x} and {c.attr_y}: a total is negative")).cast("double")
            v = F.when((x < 0) | (y < 0), refuse).otherwise(saturate(F.abs(x - y) / F.greatest(x, y, F.lit(c.eps)), c.tau, c.width))
        columns.append(v.alias(f"v__{nc.id}"))
    opened = [F.col("session.start").alias("opened")] if idle else []
    scored = cases.select("case_id", *opened, "n_events", *columns)
    return with_scores(scored, norm, norm.view_names, norm.scoring_mode)


def upsert(scores: DataFrame, write: Callable[[DataFrame, int], Any], checkpoint: str, trigger: dict[str, Any] | None = None, mode: str = "update"):
    """Starts the stream; ``write(batch, id)`` gets the cases that changed (``append``: that are over) in each trigger."""
    return scores.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def event_windows(events: DataFrame, timestamp_col: str, activity_col: str, width: str, slide: str | None = None, watermark: str = "1 hour", extra: Sequence[str] = ()) -> DataFrame:
    """Event counts by time window and activity, late events within the watermark included."""
    rows = events.withWatermark(timestamp_col, watermark) if events.isStreaming else events
    grouped = rows.groupBy(F.window(F.col(timestamp_col), width, slide), F.col(activity_col).alias("activity"), *extra).agg(F.count(F.lit(1)).alias("n_events"))
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "activity", *extra, "n_events")
