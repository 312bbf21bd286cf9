"""Event data in files: CSV and Parquet by extension, XES (``sources/xes.py``), OCEL 2.0, XLSX, and file catalogues.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normslice.errors import LogSchemaError
from normslice.functions.shared import in_arrow
from normslice.sources.eventlog import ACTIVITY, CASE, TIMESTAMP, EventLog
from normslice.sources.ocel import python_list, read_ocel, read_ocel_flat, read_ocel_xml
from normslice.sources.xes import read_xes, repeated_traces

__all__ = ["catalogue", "duplicate_keys", "from_objects", "python_list", "read_log", "read_ocel", "read_ocel_flat", "read_ocel_xml", "read_strings", "read_table", "read_xes", "read_xlsx", "repeated_traces", "verify", "write_backlog", "write_cases", "write_xes"]



def read_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None, **options: Any) -> DataFrame:
    """Parquet for ``.parquet`` / ``.pq``, else CSV with a header; a schema saves the inference pass."""
    if path.rstrip("/").lower().endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    reader = spark.read.options(**({"header": True} | options))
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def read_log(spark: SparkSession, path: str, *, schema: Any = None, read_options: Mapping[str, Any] | None = None, **roles: Any) -> EventLog:
    return EventLog(read_table(spark, path, schema, **(read_options or {})), **roles)


#: The characters that the Windows code page 1252 has in place of Latin-1's controls 0x80 to 0x9F.
WINDOWS_1252 = "\u20ac\x81\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\x8d\u017d\x8f\x90\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\x9d\u017e\u0178"
_CONTROLS = "".join(map(chr, range(0x80, 0xA0)))


def read_strings(spark: SparkSession, path: str, columns: Sequence[str] | None = None, encoding: str = "windows-1252") -> DataFrame:
    """All columns as trimmed text under trimmed names, with the file each row came from.

    Spark's reader has no Windows code page: its bytes are read as Latin-1 and the controls mapped to what they stand for.
    """
    windows = encoding.lower() in ("windows-1252", "cp1252")
    raw = spark.read.options(header=True, encoding="ISO-8859-1" if windows else encoding, inferSchema=False).csv(path)
    table = str.maketrans(_CONTROLS, WINDOWS_1252) if windows else {}
    names = {c: c.translate(table).strip() for c in raw.columns}
    wanted = [c for c in raw.columns if columns is None or names[c] in columns]
    text = lambda c: F.translate(F.col(f"`{c}`"), _CONTROLS, WINDOWS_1252) if windows else F.col(f"`{c}`")
    return raw.select(*(F.trim(text(c)).alias(names[c]) for c in wanted), F.col("_metadata.file_path").alias("source_file"))


def from_objects(spark: SparkSession, events: Any, **roles: Any) -> EventLog:
    """A log from a pandas frame under the standard names."""
    return EventLog(spark.createDataFrame(events), **({"case_col": CASE, "activity_col": ACTIVITY, "timestamp_col": TIMESTAMP} | roles))


def write_xes(events: DataFrame, path: str, *, case_col: str, activity_col: str, timestamp_col: str, case_attributes: Sequence[str] = (), order: Sequence[str] = ()) -> None:
    """A log as XES files below ``path``, each a whole document: traces with text attributes, events with activity and time in order."""
    pair = lambda key, c: F.struct(F.lit(key).alias("_key"), c.cast("string").alias("_value"))
    when = F.date_format(F.col(f"`{timestamp_col}`"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    keys = [F.col(f"`{c}`") for c in (timestamp_col, *order)]
    event = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), F.struct(F.array(pair(ACTIVITY, F.col(f"`{activity_col}`"))).alias("string"), F.array(pair(TIMESTAMP, when)).alias("date")).alias("e"))
    traces = events.groupBy(F.col(f"`{case_col}`").alias("case"), *(F.col(f"`{a}`") for a in case_attributes)).agg(F.sort_array(F.collect_list(event)).alias("es"))
    own = F.array(pair(ACTIVITY, F.col("case")), *(pair(a, F.col(f"`{a}`")) for a in case_attributes))
    traces.select(own.alias("string"), F.transform("es", lambda x: x["e"]).alias("event")).write.format("xml").options(rootTag="log", rowTag="trace", arrayElementName="item").save(path)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The key values that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Strings, and rows, that are handed on at once.
_AT_ONCE = 1 << 14


def _opened(path: str) -> Any:
    """A file as a stream that can be sought, from any store that Arrow opens."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if _STREAMED.get(scheme) == "file":  # paths are spelled as they are, not as in URIs
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    store, inner = fs.FileSystem.from_uri(f"{_STREAMED[scheme]}:{rest}")
    return store.open_input_file(inner)


def _ended(stream: Any, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of one tag as they end, each forgotten behind it: a part of a workbook is never held whole."""
    above: list[ElementTree.Element] = []
    for event, element in ElementTree.iterparse(stream, events=("start", "end")):
        if event == "start":
            above.append(element)
            continue
        above.pop()
        if element.tag == f"{_SHEET}{tag}":
            yield element
            if above:
                above[-1].remove(element)


def _cells(sheet: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def text(of: ElementTree.Element) -> str:
        return "".join(t.text or "" for t in of.iter(f"{_SHEET}t"))

    def shared(book: zipfile.ZipFile) -> pa.ChunkedArray:
        chunks: list[pa.Array] = []
        held: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as stream:
                for si in _ended(stream, "si"):
                    held.append(text(si))
                    if len(held) == _AT_ONCE:
                        chunks.append(pa.array(held, pa.string()))
                        held = []
        return pa.chunked_array([*chunks, pa.array(held, pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _opened(path) as file, zipfile.ZipFile(file) as book:
                    strings = shared(book)  # as Arrow text: their bytes and an offset each
                    with book.open("xl/workbook.xml") as stream:
                        late = any(x.get("date1904") in ("1", "true") for x in _ended(stream, "workbookPr"))
                    lines: list[list[str | None]] = []
                    done = 0
                    with book.open(f"xl/worksheets/sheet{sheet}.xml") as stream:
                        for line in _ended(stream, "row"):
                            values: list[str | None] = []
                            for c in line.iter(f"{_SHEET}c"):
                                column = 0
                                for ch in (x for x in c.get("r", "") if x.isalpha()):
                                    column = column * 26 + ord(ch.upper()) - 64
                                values += [None] * ((column or len(values) + 1) - len(values))
                                v = c.find(f"{_SHEET}v")
                                own = text(c) if c.get("t") == "inlineStr" else v.text if v is not None else None
                                values[(column or len(values)) - 1] = strings[int(own)].as_py() if c.get("t") == "s" and own is not None else own
                            lines.append(values)
                            if len(lines) == _AT_ONCE:
                                yield made(lines, done, late)
                                done, lines = done + len(lines), []
                    yield made(lines, done, late)

    def made(lines: list[list[str | None]], done: int, late: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(range(done, done + len(lines)), pa.int64()), pa.array(lines, pa.list_(pa.string())), pa.array([late] * len(lines))], ["row", "cells", "late"])

    return run


def read_xlsx(spark: SparkSession, path: str, sheet: int = 1, dates: Sequence[str] = ()) -> DataFrame:
    """A workbook's sheet as text columns (``dates``: serial days as timestamps, in the workbook's own date system).

    A task reads the sheet as a stream of cells; only the header comes to the driver. Shared strings are held as Arrow text in that task.
    """
    file = spark.read.format("binaryFile").load(path).select("path")
    rows = file.transform(in_arrow, _cells(sheet), "row long, cells array<string>, late boolean")
    head = rows.where("row = 0").first()
    if head is None:
        raise LogSchemaError(f"sheet {sheet} of {path} is empty")
    header = {i: str(v).strip() for i, v in enumerate(head["cells"]) if v}
    epoch = datetime.datetime(1904, 1, 1) if head["late"] else datetime.datetime(1899, 12, 30)

    def column(i: int, name: str) -> Column:
        value = F.get("cells", F.lit(i))
        if name not in dates:
            return value.alias(name)
        micros = F.round(value.try_cast("double") * 86_400_000_000).cast("long")
        return (F.lit(epoch).cast("timestamp_ntz") + F.make_dt_interval(secs=micros / 1_000_000)).alias(name)

    return rows.where("row > 0").select(*(column(i, name) for i, name in header.items()))


#: The stores that Arrow opens as streams.
_STREAMED = {"file": "file", "s3": "s3", "s3a": "s3", "gs": "gs", "hdfs": "hdfs"}
_CHUNK = 8 << 20


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = []
        for path in batch.column(0).to_pylist():
            made = hashlib.sha256()
            with _opened(path) as stream:
                while chunk := stream.read(_CHUNK):
                    made.update(chunk)
            digests.append(made.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests)], ["path", "length", "sha256"])


def catalogue(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``path, relative, bytes, sha256`` of every file below a path; ``relative`` starts below it (a single file: its name).

    Files of any size are digested as streams, in pieces of 8 MB, where Arrow opens their store (files, S3, GCS, HDFS). In other stores Spark
    reads a file whole, which ends at 2 GB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    plain = F.regexp_replace("path", "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    root = re.sub("^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "", path).rstrip("/")
    below = F.when(F.startswith(plain, F.lit(root + "/")), F.substring(plain, len(root) + 2, 1 << 30)).otherwise(F.substring_index(plain, "/", -1))
    scheme = re.match("([a-zA-Z][a-zA-Z0-9+.-]*):", path)
    if scheme is None or scheme[1] in _STREAMED:
        found = files.select("path", "length").transform(in_arrow, _digests, "path string, length long, sha256 string")
    else:
        found = files.select("path", "length", F.sha2("content", 256).alias("sha256"))
    return found.select("path", below.alias("relative"), F.col("length").alias("bytes"), "sha256")


def verify(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Entries of ``expected (path, sha256)`` whose file is missing from a catalogue or differs; paths are relative to its root.

    Refuses paths that leave the root; that is looked up when the comparison is built.
    """
    want = F.regexp_replace("path", r"^(\./)+", "")
    e = expected.select(want.alias("want_path"), F.col("sha256").alias("want_sha256"))
    if e.where(F.col("want_path").rlike(r"(^/)|(^|/)\.\.(/|$)")).limit(1).count():
        raise LogSchemaError("catalogue paths must be relative and stay inside their folder")
    both = e.join(found, F.col("relative") == F.col("want_path"), "left")
    return both.where(~F.col("sha256").eqNullSafe(F.col("want_sha256"))).select("want_path", "want_sha256", "sha256")


def write_backlog(backlog: DataFrame, path: str) -> None:
    backlog.write.mode("overwrite").option("header", True).csv(path)


def write_cases(result: Any, path: str, fmt: str = "parquet") -> None:
    result.frame().write.mode("overwrite").option("header", True).format(fmt).save(path)
