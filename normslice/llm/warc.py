"""WARC archives: writing with revisit records, reading back, and a globally ordered capture index.

Writing. Payloads are digested where they lie; for each digest of several pages a grouped minimum names the one whose record is the
response, all others become revisits without payload. Records are text (html in UTF-8), so Spark's text writer makes real archive files on
any store, with the record end ``CRLF CRLF`` as its line separator.

Index. Each archive yields a run of capture entries sorted by URL key and timestamp, which is written. Runs are cut into ranges
of the full key (a URL captured a million times spans many ranges) of a bounded number of entries, and in each range a loser tree
merges the stretches of the k runs that reach into it: one comparison per level for each entry, where a heap needs two. Ranges
in order make the global capture history: what comes out of the trees gives each capture its position in it and the capture
of the same URL before it, and is the result.

Defined results: null html is an empty payload and counts like any other; a null page id has no response role in a group with
ids, makes a revisit there, and is a response if its group has no id; rows repeating the smallest id of a payload are all
responses; pages have no capture time unless a column is named (all are then of one instant, and captures of one URL are in the order of their ids, of any size); a null url is recorded as ``about:blank``; line ends in urls are escaped; an empty table writes no record; page ids
are whole numbers. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normslice.llm.common import shared_path, stored, whole_ids

RECORD_END = "\r\n\r\n"
#: The capture time of pages that have none.
NO_TIME = "2024-01-01T00:00:00Z"
#: Records and bytes in one archive file at most (one record may be longer): the reader holds one file at a time.
RECORDS_PER_FILE = 2_000
FILE_BYTES = 64 << 20
LARGE = 1 << 20  # payloads above this are written one to a file
#: Entries that one range of the index holds, about: they are merged in the memory of one task.
RANGE_ENTRIES = 50_000
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each 20 bits are five hex digits and four base-32 digits."""
    hexed = F.sha1(payload.cast("binary"))
    quads = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*quads)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, time_col: str | None = None) -> None:
    """A record for each row of ``pages (page_id, url, html)``, as archive files below ``path``; ``time_col`` has capture times."""
    whole_ids(pages, "page_id")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), _stamp(pages, time_col).alias("when"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html")))
    # only payloads that several pages have are looked up; their table is written, so Spark knows its size when it plans the join
    again = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(stored(again.select("digest", "first"), "repeated-payloads"), "digest", "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("about:blank")), "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit(_HTTP), F.lit("Content-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Date", F.col("when")),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", name(F.col("first"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    sized = rows.select(record.alias("value"), F.octet_length("html").alias("size"))
    small, large = F.col("size") <= LARGE, F.col("size") > LARGE
    most = pages.select(F.octet_length(F.col("html").cast("string")).alias("size")).agg(F.max(F.when(small, F.col("size"))).alias("small"), F.count_if(large).alias("large")).first()
    for part, records_per_file in ((small, min(RECORDS_PER_FILE, FILE_BYTES // ((most["small"] or 0) + 4096))), (large, 1)):
        if part is small or most["large"]:
            sized.where(part).select("value").write.mode("append").option("lineSep", RECORD_END).option("maxRecordsPerFile", records_per_file).text(path)


def _stamp(pages: DataFrame, time_col: str | None) -> Column:
    """The capture time in whole seconds of the years 1 to 9999 (UTC sessions); unknown times are ``NO_TIME``."""
    if time_col is None:
        return F.lit(NO_TIME)
    first, last = (F.lit(x).cast("timestamp") for x in ("0001-01-01 00:00:00", "9999-12-31 23:59:59"))
    when = F.col(f"`{time_col}`").cast("timestamp")
    text = F.date_format(F.least(F.greatest(when, first), last), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(when.isNull(), NO_TIME).otherwise(text)


def url_key(url: str) -> str:
    """Sort-friendly key: host labels reversed, then path and query, in lower case, without scheme, www, port and fragment."""
    try:
        parts = urlsplit(url.strip().lower())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def records(data: bytes) -> Iterator[tuple[dict[str, str], int, int, bytes]]:
    """``(headers, offset, length, block)`` of each record of an archive."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or head < 0:
            raise ValueError(f"no record at byte {at}")
        lines = data[at:head].decode("utf-8").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        block = data[head + 4 : head + 4 + size]
        if len(block) != size:
            raise ValueError(f"record at byte {at} is cut off")
        end = head + 4 + size + 4
        yield headers, at, end - at, block
        at = end


_ENTRY = "url_key string, timestamp string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, file string, offset long, length long, run long, place int"
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
_NAMES = [x.split()[0] for x in _ENTRY.split(", ")]


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted run of each archive; a response's digest is made anew from the stored bytes and must agree."""
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            entries = []
            for headers, offset, length, block in records(content.as_py()):
                kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(http.rpartition(b"Content-Length: ")[2])  # of the payload, which a revisit does not repeat
                if kind == "response":
                    if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"payload mismatch in {path.as_py()} at byte {offset}")
                stamp = "".join(c for c in headers["warc-date"] if c.isdigit())[:14]
                entries.append((url_key(headers["warc-target-uri"]), stamp, _page(headers["warc-record-id"]), kind, size, digest, _page(headers.get("warc-refers-to")), path.as_py(), offset, length))
            entries.sort(key=_order)
            run = int.from_bytes(hashlib.sha1(path.as_py().encode()).digest()[:8], "big", signed=True)
            columns = [*(list(c) for c in zip(*entries, strict=True))] if entries else [[] for _ in range(10)]
            columns += [[run] * len(entries), list(range(len(entries)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def _order(entry: tuple) -> tuple:
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[7], entry[8]


class LoserTree:
    """Merges sorted runs: inner nodes hold the losers of their matches, the winner comes out on top."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.k = max(1, len(runs))
        self.iterators = [iter(r) for r in runs] or [iter(())]
        self.head: list[tuple | None] = [next(i, None) for i in self.iterators]
        self.key = [None if h is None else _order(h) for h in self.head]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._replay(leaf, building=True)

    def _beats(self, a: int, b: int) -> bool:
        if self.key[a] is None or self.key[b] is None:
            return self.key[b] is None and (self.key[a] is not None or a < b)
        return (self.key[a], a) < (self.key[b], b)

    def _replay(self, leaf: int, building: bool = False) -> None:
        """Play from a leaf to the top; while building, the first to reach a match waits there for its rival."""
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            rival = self.losers[node]
            if rival < 0 and building:
                self.losers[node] = winner
                return
            if rival >= 0 and self._beats(rival, winner):
                self.losers[node], winner = winner, rival
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while (entry := self.head[best := self.losers[0]]) is not None:
            yield entry
            self.head[best] = entry = next(self.iterators[best], None)
            self.key[best] = None if entry is None else _order(entry)
            self._replay(best)


_CAPTURE = _ENTRY.replace("run long, place int", "range int, at long, previous_page long, first boolean")
_CAPTURE_TYPES = [*_TYPES[:10], pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
_CAPTURE_NAMES = [x.split()[0] for x in _CAPTURE.split(", ")]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One key range: its entries come run by run and leave in key order, each with its place and the same URL's capture before it."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    runs: list[list[tuple]] = []
    last = None
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(len(_NAMES))), strict=True):
            if row[10] != last:
                runs.append([])
                last = row[10]
            runs[-1].append(row)
    out: list[tuple] = []
    before: tuple | None = None
    for at, row in enumerate(LoserTree(runs)):
        same = before is not None and before[0] == row[0]
        out.append((*row[:10], part, at, before[2] if same else None, before is None))
        before = row
        if len(out) == 10_000:
            yield _columns(out)
            out = []
    if out:
        yield _columns(out)


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CAPTURE_TYPES, strict=True)], _CAPTURE_NAMES)


def capture_index(archives: DataFrame) -> DataFrame:
    """The capture history of archive files ``(path, content)``: entries with their ``position`` in global order and ``previous_page``."""
    runs = stored(archives.select("path", "content").mapInArrow(_runs, _ENTRY), "capture-runs")
    ranges = max(1, -(-runs.count() // RANGE_ENTRIES))
    dealt = runs.repartitionByRange(ranges, "url_key", "timestamp", "page_id", "offset")
    merged = stored(dealt.sortWithinPartitions("run", "place").mapInArrow(_merge, _CAPTURE), "captures")
    ends = merged.groupBy("range").agg(F.count(F.lit(1)).alias("_n"), F.max_by(F.struct("url_key", "page_id"), "at").alias("_end"))
    order = Window.orderBy("range")  # a row for each range
    ends = ends.select(F.col("range").alias("_range"), F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_below"), F.lag("_end").over(order).alias("_last"))
    placed = merged.join(stored(ends, "range-ends"), F.col("range") == F.col("_range"))  # written first: its size is known when the join is planned
    carried = F.when(F.col("first") & (F.col("_last.url_key") == F.col("url_key")), F.col("_last.page_id")).otherwise(F.col("previous_page"))
    return placed.select(*_NAMES[:10], (F.col("_below") + F.col("at")).alias("position"), carried.alias("previous_page"))


def read_archives(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def archive_and_index(pages: DataFrame, path: str | None = None, time_col: str | None = None) -> DataFrame:
    """Write the archives, read them back, merge their index: the capture history, one row for each page.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, timestamp, file, offset, length, position, previous_page``.
    """
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write_archives(pages, path, time_col)
    return capture_index(read_archives(spark, path))
