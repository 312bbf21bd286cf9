"""XES event logs, read in byte ranges.

Spark's text reader cuts a file behind each ``</event>``, so its ranges (``spark.sql.files.maxPartitionBytes``) split files of any size, a
giant trace among them, and compressed files pass as streams. A record holds one event and what stands before it: the end of
the last trace, the start and attributes of its own, or the head of the file. A range that starts inside a trace does not know it; the
last trace of the range before it, and how many of its events came before, are carried over by a row for each range.

Nothing is guessed: DOCTYPE and entity declarations, entities that XML does not define, CDATA, encodings other than UTF-8, events without end, trace
attributes behind events and markup that is not well-formed are refused with the file's name. An event end inside a comment cuts the comment
and is refused with it. Other comments are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normslice.functions.shared import in_arrow
from normslice.sources.eventlog import ACTIVITY, CASE, TIMESTAMP

_COMMENT = re.compile(r"<!--.*?-->", re.DOTALL)
_ENCODING = re.compile(r"""<\?xml[^>]*\sencoding\s*=\s*["']([^"']+)""")
_RANGE = ["path", "range"]


def _children(xml: str, strict: bool) -> dict[str, str]:
    """The attributes of one element: keys and values of its children. Nested attributes are left out (``strict``: refused)."""
    found: dict[str, str] = {}
    depth = 0

    def start(name: str, attributes: dict[str, str]) -> None:
        nonlocal depth
        depth += 1
        if depth == 2 and "key" in attributes:
            key = attributes["key"]
            if strict and key in found:
                raise ValueError(f"an element has the key {key!r} more than once")
            found[key] = attributes.get("value", "")
        elif strict and depth > 1:
            raise ValueError(f"{name} is nested in an attribute" if depth > 2 else f"{name} has no key")

    def end(_: str) -> None:
        nonlocal depth
        depth -= 1

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.Parse(xml, True)
    return found


class _Range:
    """Reads the records of one byte range in order."""

    def __init__(self, prefix: str, strict: bool, whole: bool) -> None:
        self._event = re.compile(rf"<{prefix}event(?=[\s/>])")
        self._trace = re.compile(rf"<{prefix}trace(?:\s[^<>]*)?(/?)>")
        self._event_end, self._trace_end, self._log_end = f"</{prefix}event>", f"</{prefix}trace>", f"</{prefix}log>"
        self._strict, self._whole = strict, whole
        self.enter(True)

    def enter(self, first: bool) -> None:
        """``first``: the range starts where the file starts."""
        self._head = first
        self.trace, self.place, self.attributes = 0, -1, None  # trace 0 is the one that the range before has begun

    def read(self, record: str) -> dict[str, str] | None:
        """The event's attributes (``{}`` if they are not asked for); None behind the last event."""
        if "<!" in record:
            record = _COMMENT.sub("", record)
            if "<!" in record:
                raise ValueError("declarations, CDATA and comments that hold an event end are refused")
        if self._head and (named := _ENCODING.search(record)) and named[1].lower() not in ("utf-8", "utf8", "us-ascii"):
            raise ValueError(f"the encoding is {named[1]}, not UTF-8")
        at = self._event.search(record)
        before = record if at is None else record[: at.start()]
        starts = [m for m in self._trace.finditer(before) if not m[1]]
        ended = before[: starts[0].start()] if starts else before
        rest = self._trace.sub("", ended).replace(self._trace_end, "").replace(self._log_end, "")
        if rest.strip() and not self._head:
            raise ValueError("a trace has attributes or other content behind its events")
        self._head = False
        if at is None:
            if before.count(self._trace_end) < len(starts):
                raise ValueError("the last trace has no end")
            return None
        if starts:
            self.trace += 1
            self.place = -1
            self.attributes = _children(before[starts[-1].start() :] + self._trace_end, self._strict)
        elif self._trace_end in before:
            raise ValueError("an event stands outside of a trace")
        self.place += 1
        return _children(record[at.start() :] + self._event_end, self._strict) if self._whole else {}

    def ends(self, record: str) -> bool:
        return self._log_end in record


def _records(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    text = spark.read.option("lineSep", f"</{prefix}event>").text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range"), "value")


def _parsed(records: DataFrame, attributes: Sequence[str], event_attributes: Sequence[str], prefix: str, strict: bool, whole: bool) -> DataFrame:
    """``path, range, trace, place, ended, t0, t1, ..., e0, e1, ...``: a row for each event, and one for the end of a file."""
    names = [*_RANGE, "trace", "place", "ended", *(f"t{i}" for i in range(len(attributes))), *(f"e{i}" for i in range(len(event_attributes)))]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()] + [pa.string()] * (len(names) - 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, at = _Range(prefix, strict, whole), None
        for batch in batches:
            rows = []
            for path, start, record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (path, start) != at:
                    at = (path, start)
                    reader.enter(start == 0)
                try:
                    event = reader.read(record)
                except (ValueError, expat.ExpatError) as e:
                    raise ValueError(f"{path}: {e} (in {record[:200].strip()!r})") from e
                own = reader.attributes or {}
                if event is not None:
                    rows.append((path, start, reader.trace, reader.place, False, *map(own.get, attributes), *map(event.get, event_attributes)))
                elif reader.ends(record):
                    rows.append((path, start, reader.trace, reader.place, True, *map(own.get, attributes), *(None for _ in event_attributes)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([] for _ in types), types, strict=True)], names)

    schema = ", ".join(f"{n} {'boolean' if n == 'ended' else 'long' if n in ('range', 'trace', 'place') else 'string'}" for n in names)
    return records.transform(in_arrow, run, schema)


def _carried(summary: DataFrame, n: int) -> DataFrame:
    """``path, range, c0, c1, ..., more, traces``: the trace that is open where a range starts, its events so far, and the traces begun before."""
    attributes = [f"t{i}" for i in range(n)]
    events = F.when(~F.col("ended"), F.col("place") + 1)
    ranges = summary.groupBy(*_RANGE).agg(F.max("trace").alias("begun"), F.max_by(events, F.when(~F.col("ended"), F.struct("trace", "place"))).alias("tail"), F.max("ended").alias("ended"), *(F.max_by(a, "trace").alias(a) for a in attributes))
    in_file = Window.partitionBy("path").orderBy("range")
    grouped = ranges.withColumn("run", F.count_if(F.col("begun") > 0).over(in_file))
    open_ = Window.partitionBy("path", "run").orderBy("range")  # a range that begins traces, and those that only go on with its last one
    sums = grouped.select("*", F.sum("tail").over(open_).alias("so_far"), *(F.first(a).over(open_).alias(f"o{i}") for i, a in enumerate(attributes)), (F.sum("begun").over(in_file)).alias("all"))
    back = [F.lag(f"o{i}").over(in_file).alias(f"c{i}") for i in range(n)]
    whole = F.max("ended").over(Window.partitionBy("path"))
    return sums.select(*_RANGE, *back, F.lag("so_far", 1, 0).over(in_file).alias("more"), F.lag("all", 1, 0).over(in_file).alias("traces"), whole.alias("whole"))


def read_xes(
    spark: SparkSession, path: str, attributes: Sequence[str] = (), event_attributes: Sequence[str] = (ACTIVITY, TIMESTAMP, "lifecycle:transition", "org:resource"), strict: bool = False, prefix: str = ""
) -> DataFrame:
    """One row for each event of XES files: case id, named trace and event attributes, the trace's number among its file's traces that have events, and the event's place in its trace.

    Attribute values stay text but for the times; a bad date is NULL. A repeated key in one element takes the last value. ``strict``
    refuses repeated keys, nested attributes and files without an end. ``prefix`` is that of the XES namespace with its colon, if the file uses one.
    """
    traced = [ACTIVITY, *attributes]
    records = _records(spark, path, prefix)
    rows = _parsed(records, traced, event_attributes, prefix, strict, True)
    carried = _carried(_parsed(records, traced, (), prefix, False, False), len(traced))
    placed = rows.where("not ended").join(carried, _RANGE)
    goes_on = F.col("trace") == 0

    def own(i: int) -> Column:
        return F.when(goes_on, F.col(f"c{i}")).otherwise(F.col(f"t{i}"))

    case = own(0)
    if strict:
        cut = F.concat(F.col("path"), F.lit(": the log has no end"))
        case = F.when(F.col("whole"), case).otherwise(F.raise_error(cut).cast("string"))
    events = [(F.try_to_timestamp(F.col(f"e{i}")).cast("timestamp_ntz") if a == TIMESTAMP else F.col(f"e{i}")).alias(a) for i, a in enumerate(event_attributes)]
    return placed.select(
        case.alias(CASE),
        *(own(i + 1).alias(f"case:{a}") for i, a in enumerate(attributes)),
        (F.col("trace") + F.col("traces")).alias("trace_position"),
        (F.col("place") + F.when(goes_on, F.col("more")).otherwise(0)).cast("int").alias("event_position"),
        *events,
    )


def repeated_traces(events: DataFrame) -> DataFrame:
    """Case ids that more than one trace of a file has, with their number: traces are never merged silently."""
    return events.groupBy(CASE).agg(F.count_distinct("trace_position").alias("n")).where("n > 1")
