"""Object-centric logs (OCEL 2.0) as tables: JSON in byte ranges, XML by row tag, flat CSV.

A JSON document is one line, often. Spark's text reader cuts it behind each ``}``, so ranges split it anywhere. An event or object of the
log is the only JSON object that has an ``id`` and a ``type``: what it holds has other keys, and text that looks like one has escaped
quotes and does not parse. A range so finds its first whole element by itself; from there on it reads one after the other. What
lies before that and what is left at its end are put together with the neighbouring ranges' and read once more.

Elements that do not parse, and files that end inside one, are refused with the file's name and the text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normslice.functions.shared import in_arrow, stored

TABLES = ("events", "objects", "links", "object_links", "object_attributes")
_EVENT = "id string, type string, time string, attributes array<struct<name:string,value:string>>, relationships array<struct<objectId:string,qualifier:string>>"
_OBJECT = "id string, type string, attributes array<struct<name:string,time:string,value:string>>, relationships array<struct<objectId:string,qualifier:string>>"
_DECODE = json.JSONDecoder().raw_decode
_SHOWN = 160


def _element(found: object) -> str | None:
    """``event`` or ``object``; None for what is neither."""
    if not isinstance(found, dict) or not isinstance(found.get("id"), str) or not isinstance(found.get("type"), str):
        return None
    return "event" if "time" in found else "object"


class _Reader:
    """Takes the text of one range piece by piece and gives back whole elements."""

    def __init__(self, first: bool, between: bool = False) -> None:
        """``first``: a file starts here, so the document's own brace comes first; ``between``: a list's elements start here."""
        self.synced = first or between
        self.head, self.text = "", ""
        self._brace, self._open, self._tried = first, 0, 64

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        self.text += piece
        self._open += piece.count("{") - piece.count("}")
        if self._brace and "{" in self.text:
            self.text = self.text[self.text.index("{") + 1 :]
            self._brace, self._open = False, self._open - 1
        # an element can only be whole where braces are even; braces inside texts may hide that, so it is tried anyway now and then
        if (self.synced and self._open <= 0) or 2 * len(self.text) >= 3 * self._tried:
            yield from self.finish()

    def finish(self) -> Iterator[tuple[str, str]]:
        """Elements that are whole by now."""
        self._tried = max(len(self.text), 64)
        at = 0 if self.synced else self._first()
        if at < 0:
            return
        if not self.synced:
            self.head, self.synced = self.text[:at], True
        while (start := self.text.find("{", at)) >= 0:
            try:
                found, end = _DECODE(self.text, start)
            except ValueError as e:
                at = start
                if e.pos >= len(self.text.rstrip()) or "Unterminated string" in e.msg or "escape" in e.msg and e.pos > len(self.text) - 8:
                    break  # not all of it is there
                raise ValueError(f"{e.msg}: {self.text[start : start + _SHOWN]!r}") from e
            if kind := _element(found):
                yield kind, self.text[start:end]
            elif "events" in found or "objects" in found:
                raise ValueError("a file holds more than one document")
            at = end
        self.text = self.text[at:]
        self._open = self.text.count("{") - self.text.count("}")
        self._tried = max(len(self.text), 64)

    def _first(self) -> int:
        """Where the first whole element starts; -1 if there is none yet."""
        at = self.text.find("{")
        while at >= 0:
            try:
                if _element(_DECODE(self.text, at)[0]):
                    return at
            except ValueError:
                pass  # inside a text, or not all of it is there
            at = self.text.find("{", at + 1)
        return -1


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range"), "value")


def _in_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, at, rows = None, None, []

    def ended() -> list[tuple]:
        if reader is None:
            return []
        whole = [(*at, kind, text) for kind, text in reader.finish()]
        head = [] if at[1] == 0 else [(*at, "head", reader.head if reader.synced else reader.text)]
        return whole + head + ([(*at, "tail", reader.text)] if reader.synced else [])

    def out() -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["path", "range", "kind", "value"])

    for batch in batches:
        for path, start, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (path, start) != at:
                rows += ended()
                at, reader = (path, start), _Reader(start == 0)
            try:
                rows += [(*at, kind, text) for kind, text in reader.feed(piece + "}")]
            except ValueError as e:
                raise ValueError(f"{path}: {e}") from e
        yield out()
        rows = []
    rows += ended()
    yield out()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements that were cut by the ends of ranges: ``path, last, value`` with the parts put together; the last part of a file must end it."""
    for batch in batches:
        rows = []
        for path, last, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            reader = _Reader(False, between=True)
            reader.text = text
            rows += reader.finish()
            if reader.text.lstrip().startswith("{") or last and "}" not in reader.text:
                raise ValueError(f"{path}: the file ends inside an element, or one is damaged: {reader.text.lstrip()[:_SHOWN]!r}")
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["kind", "value"])


def _elements(spark: SparkSession, path: str) -> DataFrame:
    """``kind, value``: the JSON text of every event and object."""
    found = stored(_pieces(spark, path).transform(in_arrow, _in_ranges, "path string, range long, kind string, value string"), "ocel-elements")
    parts = found.where(F.col("kind").isin("head", "tail"))
    order = Window.partitionBy("path").orderBy("range", "kind")  # a range's head comes before its tail
    # a tail opens a group that the heads of the ranges behind it go on with
    grouped = parts.withColumn("group", F.count_if(F.col("kind") == "tail").over(order))
    lists = grouped.groupBy("path", "group").agg(F.sort_array(F.collect_list(F.struct("range", "kind", "value"))).alias("p"))
    last = F.col("group") == F.max("group").over(Window.partitionBy("path"))
    cut = lists.select("path", last.alias("last"), F.array_join(F.transform("p", lambda x: x["value"]), "").alias("value")).transform(in_arrow, _joined, "kind string, value string")
    return found.where(F.col("kind").isin("event", "object")).select("kind", "value").unionByName(cut)


def tables_of(events: DataFrame, objects: DataFrame) -> dict[str, DataFrame]:
    """The tables of a log from ``events (id, type, time, relationships)`` and ``objects (id, type, attributes, relationships)``."""
    kinds = objects.select(F.col("id").alias("_id"), F.col("type").alias("object_type"))
    links = events.select(F.col("id").alias("event_id"), F.inline("relationships")).select("event_id", F.col("objectId").alias("object_id"), "qualifier")
    return {
        "events": events.select(F.col("id").alias("event_id"), F.col("type").alias("activity"), F.try_to_timestamp("time").cast("timestamp_ntz").alias("time")),
        "objects": kinds.toDF("object_id", "object_type"),
        "links": links.join(kinds, F.col("object_id") == F.col("_id"), "left").drop("_id"),
        "object_links": objects.select(F.col("id").alias("object_id"), F.inline("relationships")).select("object_id", F.col("objectId").alias("other_id"), "qualifier"),
        "object_attributes": objects.select(F.col("id").alias("object_id"), F.inline("attributes")).select("object_id", "name", "time", "value"),
    }


def read_ocel(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """An OCEL 2.0 JSON log as tables: ``events``, ``objects``, ``links`` (event-object), ``object_links``, ``object_attributes``."""
    elements = _elements(spark, path)
    of = lambda kind, schema: elements.where(F.col("kind") == kind).select(F.from_json("value", schema).alias("x")).select("x.*")
    return tables_of(of("event", _EVENT), of("object", _OBJECT))


_RELATED = "struct<relationship:array<struct<`_object-id`:string,_qualifier:string>>>"


def read_ocel_xml(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The same tables from OCEL 2.0 XML files, by Spark's XML reader (a file is one task)."""
    related = lambda: F.transform("objects.relationship", lambda x: F.struct(x["_object-id"].alias("objectId"), x["_qualifier"].alias("qualifier"))).alias("relationships")
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    events = read("event", f"_id string, _type string, _time string, objects {_RELATED}")
    objects = read("object", f"_id string, _type string, objects {_RELATED}, attributes struct<attribute:array<struct<_name:string,_time:string,_VALUE:string>>>")
    attributes = F.transform("attributes.attribute", lambda x: F.struct(x["_name"].alias("name"), x["_time"].alias("time"), x["_VALUE"].alias("value"))).alias("attributes")
    return tables_of(events.select(F.col("_id").alias("id"), F.col("_type").alias("type"), F.col("_time").alias("time"), related()), objects.select(F.col("_id").alias("id"), F.col("_type").alias("type"), attributes, related()))


def python_list(column: Column) -> Column:
    """The items of a list written as text, such as ``['a', 'b']``."""
    inner = F.regexp_extract(column, r"^\s*\[(.*)\]\s*$", 1)
    return F.when(column.isNotNull(), F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), r"^['\"]|['\"]$", "")), lambda x: x != ""))


def read_ocel_flat(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``events`` and ``links`` from a flat table: a list of object ids in a column ``ocel:type:<type>`` each. It has no qualifiers and no objects' history."""
    flat = spark.read.options(header=True, escape='"').csv(path)
    kinds = [c for c in flat.columns if c.startswith("ocel:type:")]
    event = F.col("`ocel:eid`").alias("event_id")
    lists = F.array(*(F.struct(F.lit(c.removeprefix("ocel:type:")).alias("object_type"), python_list(F.col(f"`{c}`")).alias("ids")) for c in kinds))
    each = flat.select(event, F.inline(lists)).select("event_id", F.explode("ids").alias("object_id"), "object_type")
    return {"events": flat.select(event, F.col("`ocel:activity`").alias("activity"), F.try_to_timestamp("`ocel:timestamp`").cast("timestamp_ntz").alias("time")), "links": each}


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """``check, n``: repeated ids and links, links to objects that the log lacks, and events without a usable time."""
    events, objects, links = tables["events"], tables["objects"], tables["links"]
    twice = lambda df: df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))
    known = objects.select(F.col("object_id").alias("_known")).distinct()
    dangling = lambda df, c: df.join(known, F.col(c) == F.col("_known"), "left_anti").agg(F.count(F.lit(1)).alias("n"))
    checks = {
        "repeated event ids": twice(events.select("event_id")),
        "repeated object ids": twice(objects.select("object_id")),
        "repeated event-object links": twice(links.select("event_id", "object_id", "qualifier")),
        "events linked to unknown objects": dangling(links, "object_id"),
        "events without a time": events.where("time is null").agg(F.count(F.lit(1)).alias("n")),
    }
    if "object_links" in tables:
        checks["repeated object-object links"] = twice(tables["object_links"])
        checks["objects linked to unknown objects"] = dangling(tables["object_links"], "other_id")
    out = None
    for name, n in checks.items():
        row = n.select(F.lit(name).alias("check"), F.col("n").cast("long").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out
