"""Any norm on a stream: scoped counts, as-of responses, every activation, censoring and truncation included.

Such rules need a case's instants, not only its counts. The events of open cases, reduced to the columns that the norm reads, are
kept as a table beside the stream's checkpoint, one for each trigger. A trigger joins its new events to the open ones of their cases
and hands the cases that changed over whole, and the batch's own compiled plan scores them, so a stream and the batch cannot differ.
All of it is joins and windows on the shuffle, whatever the number of cases, and no Python. Events of cases that did not change are
copied into the next table (a scan of what is open, not shuffled while a trigger's events are few).

Events of a case that lie more than ``idle`` apart belong to different stretches, which their ``opened`` instant tells apart. A stretch is over when the
watermark (the newest event of all triggers so far, less the delay) has passed its last event by ``idle``: the trigger that moves the watermark hands it over
for the last time, marked ``closed``, and it is in no later table. A late event (within the watermark) can still join two open stretches; the earlier one then
has all their events. Events older than the watermark that the triggers before have left are dropped; those within the delay never are. (Spark's own stateful
operators drop by the watermark of one trigger earlier, unless a trigger without data came between.)
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from normslice.errors import NormError
from normslice.functions.core import micros
from normslice.functions.shared import remove
from normslice.operators.scoring import score
from normslice.plans.norm import Norm
from normslice.sources.eventlog import EventLog

#: Columns that are added: the instant, the first instant of the case, and whether it is over; the case's last instant, whether a trigger tells it, and the event time.
INSTANT, OPENED, CLOSED = "instant_us", "opened_us", "case_closed"
_LATEST, _TOLD, _TIME = "latest_us", "case_told", "event_time_us"
#: The new events of a trigger whose cases may be sent to every task.
FEW = 100_000


class ChangedCases:
    """A stream of events by case; the open ones lie in a folder of the checkpoint, as the last triggers left them."""

    def __init__(self, rows: DataFrame, case: str, delay_us: int, idle_us: int) -> None:
        self._rows, self._case, self._delay_us, self._idle_us = rows, F.col(f"`{case}`"), delay_us, idle_us
        self._names = [f"`{c}`" for c in rows.columns if c != _TIME]
        added = [StructField(OPENED, LongType()), StructField(_LATEST, LongType()), StructField(CLOSED, BooleanType()), StructField(_TOLD, BooleanType())]
        self._kept = StructType([*(f for f in rows.schema.fields if f.name != _TIME), *added])

    def start(self, hand: Callable[[DataFrame, int], Any], checkpoint: str, trigger: dict[str, Any] | None = None):
        """Starts the stream. ``hand(events, id)`` gets all events of the cases that a trigger changes or closes, with ``opened_us`` and ``case_closed``."""
        folder = f"{checkpoint.rstrip('/')}/cases"
        spark = self._rows.sparkSession  # the session of a batch does not adapt its plans to sizes

        def step(batch: DataFrame, number: int) -> None:
            here, before = f"{folder}/{number}", f"{folder}/{number - 1}"
            batch.write.mode("overwrite").parquet(f"{here}/new")
            new = spark.read.schema(self._rows.schema).parquet(f"{here}/new")
            newest, n = new.agg(F.max(_TIME), F.count(F.lit(1))).first()
            passed, open_ = self._left(before) if number else (None, spark.createDataFrame([], self._kept).drop(CLOSED, _TOLD))
            marks = [passed, None if newest is None else newest // 1000 * 1000 - self._delay_us]
            mark = max((m for m in marks if m is not None), default=None)
            fresh = new if passed is None else new.where(F.col(_TIME) >= passed)
            self._joined(open_, fresh.select(*self._names), n <= FEW, mark).write.mode("overwrite").parquet(f"{here}/events")
            spark.range(1).select(F.lit(mark).cast("long").alias("us")).write.mode("overwrite").parquet(f"{here}/watermark")
            remove(spark, f"{here}/new")
            hand(spark.read.schema(self._kept).parquet(f"{here}/events").where(_TOLD).drop(_LATEST, _TOLD), number)
            remove(spark, f"{folder}/{number - 2}")  # a trigger that is run again reads the one before

        return self._rows.writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def _left(self, path: str) -> tuple[int | None, DataFrame]:
        """The watermark and the open events that a trigger left."""
        spark = self._rows.sparkSession
        try:
            passed = spark.read.schema("us long").parquet(f"{path}/watermark").first()["us"]
        except AnalysisException as e:
            raise NormError(f"the checkpoint has no open cases in {path}; a checkpoint of an older version cannot go on") from e
        return passed, spark.read.schema(self._kept).parquet(f"{path}/events").where(f"not {CLOSED}").drop(CLOSED, _TOLD)

    def _joined(self, open_: DataFrame, fresh: DataFrame, few: bool, mark: int | None) -> DataFrame:
        """Open and new events by stretch, with what the trigger tells and what is over at the watermark ``mark``."""
        told = fresh.select(self._case.alias("__told")).distinct()
        told = F.broadcast(told) if few else told.hint("merge")
        same = self._case.eqNullSafe(F.col("__told"))
        by = Window.partitionBy(self._case).orderBy(INSTANT)
        starts = F.coalesce(F.col(INSTANT) - F.lag(INSTANT).over(by) > self._idle_us, F.lit(True))
        changed = open_.join(told, same, "left_semi").select(*self._names).union(fresh)
        changed = changed.withColumn(OPENED, F.when(starts, F.col(INSTANT))).withColumn(OPENED, F.last(OPENED, ignorenulls=True).over(by))
        changed = changed.withColumn(_LATEST, F.max(INSTANT).over(Window.partitionBy(self._case, OPENED)))
        over = F.lit(False) if mark is None else F.col(_LATEST) + self._idle_us < micros(F.timestamp_micros(F.lit(mark)))
        same_as_before = open_.join(told, same, "left_anti").withColumn(CLOSED, over).withColumn(_TOLD, F.col(CLOSED))
        return changed.withColumn(CLOSED, over).withColumn(_TOLD, F.lit(True)).union(same_as_before)


def changed_cases(events: DataFrame, columns: Sequence[str], *, case_col: str, timestamp_col: str, watermark: str = "1 day", idle_seconds: int) -> ChangedCases:
    """The stream ``events`` by case, with ``columns``; its ``start`` hands over changed cases.

    ``events`` has a TIMESTAMP column. Events without an instant cannot be ordered by a watermark and are refused.
    """
    spark = events.sparkSession
    if not events.isStreaming:
        raise NormError("changed_cases takes a stream; score a batch with score()")
    if dict(events.dtypes)[timestamp_col] != "timestamp":
        raise NormError(f"{timestamp_col} must be a TIMESTAMP for a watermark")
    if clash := sorted({INSTANT, OPENED, CLOSED, _LATEST, _TOLD, _TIME} & {c.lower() for c in (case_col, *columns)}):
        raise NormError(f"the names {clash} are added to the events; rename these columns")
    events.withWatermark(timestamp_col, watermark)  # refuses what is no delay
    delay = micros(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.lit(watermark).cast("interval"))
    kept = [c for c in dict.fromkeys(columns) if c not in (case_col, timestamp_col)]
    when = F.col(f"`{timestamp_col}`")
    instant = F.coalesce(micros(when), F.raise_error(F.lit(f"an event has no {timestamp_col}")).cast("long"))
    rows = events.select(F.col(f"`{case_col}`"), *(F.col(f"`{c}`") for c in kept), instant.alias(INSTANT), F.unix_micros(when).alias(_TIME))
    return ChangedCases(rows, case_col, spark.range(1).select(delay).first()[0], idle_seconds * 1_000_000)


def score_stream(
    events: DataFrame,
    norm: Norm,
    write: Callable[[DataFrame, int], Any],
    checkpoint: str,
    *,
    roles: dict[str, Any],
    idle_seconds: int,
    watermark: str = "1 day",
    columns: Sequence[str] = (),
    views: Sequence[str] | None = None,
    trigger: dict[str, Any] | None = None,
):
    """Starts the stream. ``write(batch, id)`` gets ``case_id, opened, closed`` and the columns of ``ScoreResult.frame()`` for every case that a trigger
    changes or closes; ``opened`` and ``case_id`` are its key. ``roles`` are those of ``EventLog``; ``columns`` names further event columns that the norm reads.
    """
    case, when = roles["case_col"], roles["timestamp_col"]
    named = [roles["activity_col"], *roles.get("case_attributes", ()), *(roles[k] for k in ("exposure_col", "order_col") if roles.get(k)), *columns]
    changed = changed_cases(events, named, case_col=case, timestamp_col=when, watermark=watermark, idle_seconds=idle_seconds)

    def handle(batch: DataFrame, number: int) -> None:
        key = F.to_json(F.struct(F.col(f"`{case}`").alias("case"), F.col(OPENED).alias("opened"), F.col(CLOSED).alias("closed")))
        keyed = batch.select("*", key.alias("__key"), F.timestamp_micros(INSTANT).alias(when))
        log = EventLog(keyed, **(roles | {"case_col": "__key", "timestamp_col": when, "validate": False, "long_traces": False}))
        frame = score(log, norm, views=views).frame()
        parts = F.from_json("case_id", f"case {batch.schema[case].dataType.simpleString()}, opened long, closed boolean")
        told = frame.select(parts.alias("__k"), *(c for c in frame.columns if c != "case_id"))
        write(told.select(F.col("__k.case").alias("case_id"), F.timestamp_micros("__k.opened").alias("opened"), F.col("__k.closed").alias("closed"), *(F.col(f"`{c}`") for c in told.columns if c != "__k")), number)

    return changed.start(handle, checkpoint, trigger)
