"""Media columns in Matroska: muxing payloads and parsing files into packet tables.

``mux`` stores bytes as 8-bit PCM samples of one audio track: an EBML header, then a segment with a seek head, info, tracks,
clusters of laced blocks, and cues. ``parse`` reads any Matroska bytes of this shape element by element (variable-length ids and
sizes, unknown sizes, clusters, simple blocks and block groups, the four lacings, cues); ``packet_table`` has one row for each
packet, with track, timestamp and byte range. ``seek`` goes the way of a player: by the seek head to the cues, by the cues to the
clusters, and reads nothing else; payloads are read back through the packets that it finds.

Defined results: a null payload is empty and is padded to one unit; media that do not parse, or whose cues point to no cluster of
that time, raise ValueError with a byte position; null media have no packets; equal payloads have equal media; a payload of any
length lies in clusters of at most 32 KiB. Extra columns are not read; rows keep their ids and these their type, null ones too.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normslice.llm.common import id_type

#: Ids of the elements used here, and the versions of the format that a file claims.
EBML_VERSION, EBML_READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4287, 0x4285
SEEK_HEAD, SEEK, SEEK_ID, SEEK_POSITION = 0x114D9B74, 0x4DBB, 0x53AB, 0x53AC
MUXING_APP, WRITING_APP, TRACK_UID = 0x4D80, 0x5741, 0x73C5
VERSIONS = {EBML_VERSION: 1, EBML_READ_VERSION: 1, MAX_ID: 4, MAX_SIZE: 8, DOC_TYPE_VERSION: 4, DOC_TYPE_READ_VERSION: 2}
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, TIMESTAMP_SCALE, DURATION = 0x4282, 0x2AD7B1, 0x4489
TRACK, TRACK_NUMBER, TRACK_TYPE, CODEC, DEFAULT_DURATION = 0xAE, 0xD7, 0x83, 0x86, 0x23E383
AUDIO, RATE, CHANNELS, DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS}
TOP_LEVEL = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES}

UNIT = 64  # payloads are padded to a multiple of this
SAMPLE_RATE = 8000
TICK_NS = 1_000_000_000 // SAMPLE_RATE  # one sample
FRAME = 512
BLOCK_FRAMES = 8
CLUSTER_BYTES = 1 << 15  # a block's time in its cluster is a signed 16-bit number of samples
LACINGS = ("none", "xiph", "fixed", "ebml")


def vint(value: int) -> bytes:
    """A size as the shortest variable-length integer; all ones are reserved for unknown sizes."""
    length = 1
    while value >= (1 << 7 * length) - 1:
        length += 1
    return (value | 1 << 7 * length).to_bytes(length, "big")


def element(identity: int, content: bytes) -> bytes:
    return identity.to_bytes((identity.bit_length() + 7) // 8, "big") + vint(len(content)) + content


def number(identity: int, value: int) -> bytes:
    return element(identity, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def padded(payload: bytes) -> bytes:
    return payload + bytes(max(UNIT, -(-len(payload) // UNIT) * UNIT) - len(payload))


def _block(track: int, time: int, frames: list[bytes]) -> bytes:
    """A simple block: no lacing for one frame, fixed for frames of one size, else the shorter of Xiph's and EBML's (first size, then differences)."""
    sizes = [len(f) for f in frames]
    if len(frames) == 1:
        kind, lace = 0, b""
    elif len(set(sizes)) == 1:
        kind, lace = 2, bytes([len(frames) - 1])
    elif max(sizes[:-1]) < 255:  # a byte each: EBML's is no shorter
        kind, lace = 1, bytes([len(frames) - 1, *sizes[:-1]])
    else:
        kind, lace = 3, bytes([len(frames) - 1]) + vint(sizes[0])
        for before, size in zip(sizes, sizes[1:-1], strict=False):
            lace += _signed_vint(size - before)
    return vint(track) + time.to_bytes(2, "big", signed=True) + bytes([0x80 | kind << 1]) + lace + b"".join(frames)


def _signed_vint(value: int) -> bytes:
    length = 1
    while not -((1 << 7 * length - 1) - 1) <= value <= (1 << 7 * length - 1) - 1:
        length += 1
    return (value + (1 << 7 * length - 1) - 1 | 1 << 7 * length).to_bytes(length, "big")


def mux(payload: bytes, frame: int = FRAME) -> bytes:
    """The payload as a Matroska file of ``frame``-byte packets; its length must be positive."""
    if not payload:
        raise ValueError("no payload")
    versions = {k: number(k, v) for k, v in VERSIONS.items()}
    head = element(EBML, b"".join([*list(versions.values())[:4], element(DOC_TYPE, b"matroska"), *list(versions.values())[4:]]))
    info = element(INFO, number(TIMESTAMP_SCALE, TICK_NS) + element(MUXING_APP, b"normslice") + element(WRITING_APP, b"normslice") + element(DURATION, np.array(len(payload), ">f8").tobytes()))
    audio = element(AUDIO, element(RATE, np.array(SAMPLE_RATE, ">f8").tobytes()) + number(CHANNELS, 1) + number(DEPTH, 8))
    track = number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, frame * TICK_NS) + audio
    seek = lambda at: element(SEEK_HEAD, element(SEEK, element(SEEK_ID, CUES.to_bytes(4, "big")) + element(SEEK_POSITION, at.to_bytes(8, "big"))))
    body = [info, element(TRACKS, element(TRACK, track))]
    at, cues = len(seek(0)) + sum(map(len, body)), []
    step = frame * BLOCK_FRAMES
    for start in range(0, len(payload), CLUSTER_BYTES):
        end = min(start + CLUSTER_BYTES, len(payload))
        blocks = [number(CLUSTER_TIME, start)]
        for b in range(start, end, step):
            frames = [payload[f : min(f + frame, end)] for f in range(b, min(b + step, end), frame)]
            blocks.append(element(SIMPLE_BLOCK, _block(1, b - start, frames)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, start) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join([seek(at), *body, element(CUES, b"".join(cues))]))


@dataclass
class Media:
    """What a file holds: packets ``(track, time in ns, byte offset, bytes, cluster, lacing, key frame)`` and its tables."""

    scale: int = 1_000_000
    tracks: dict[int, dict[str, object]] = field(default_factory=dict)
    clusters: list[int] = field(default_factory=list)  # byte offsets in the segment
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time in ticks, track, cluster offset
    packets: list[tuple[int, int, int, int, int, str, bool]] = field(default_factory=list)


def _vint_at(data: bytes, at: int, keep_marker: bool) -> tuple[int, int, bool]:
    """``(value, next position, all ones)`` of the variable-length integer at ``at``."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    length = 9 - data[at].bit_length()
    raw = int.from_bytes(data[at : at + length], "big")
    if at + length > len(data):
        raise ValueError(f"the file ends in the integer at byte {at}")
    value = raw if keep_marker else raw & (1 << 7 * length) - 1
    return value, at + length, raw & (1 << 7 * length) - 1 == (1 << 7 * length) - 1


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """``(id, element start, content start, content end)`` of the children; an unknown size runs to the next element above it."""
    while at < end:
        identity, body, _ = _vint_at(data, at, True)
        size, content, unknown = _vint_at(data, body, False)
        stop = content + size
        if unknown:
            stop = end
            if identity == CLUSTER:
                inner = content
                while inner < end:
                    child, inner_body, _ = _vint_at(data, inner, True)
                    if child in TOP_LEVEL:
                        stop = inner
                        break
                    inner_size, inner_content, _ = _vint_at(data, inner_body, False)
                    inner = inner_content + inner_size
        if stop > end:
            raise ValueError(f"the element at byte {at} ends beyond its parent")
        yield identity, at, content, stop
        at = stop


def _frames(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block whose lace head starts at ``at``."""
    if not lacing:
        return [(at, end - at)]
    if at >= end:
        raise ValueError(f"no lace head at byte {at}")
    count, at = data[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % count:
            raise ValueError(f"{end - at} bytes at byte {at} are no {count} frames of one size")
        sizes = [(end - at) // count] * count
    else:
        sizes = []
        for i in range(count - 1):
            if lacing == 1:
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                size, at = size + data[at], at + 1
            else:
                size, after, _ = _vint_at(data, at, False)
                if i:
                    size += sizes[-1] - ((1 << 7 * (after - at) - 1) - 1)
                at = after
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    out = []
    for size in sizes:
        if size < 0 or at + size > end:
            raise ValueError(f"bad lace before byte {at}")
        out.append((at, size))
        at += size
    return out


class _Reader:
    """Reads the parts of one file into ``media``; ``at`` is where it has come to."""

    def __init__(self, data: bytes) -> None:
        self.data, self.media, self.at = data, Media(), 0

    def uint(self, a: int, b: int) -> int:
        return int.from_bytes(self.data[a:b], "big")

    def facts(self, a: int, b: int) -> dict[int, tuple[int, int]]:
        return {k: (x, y) for k, _, x, y in self.children(a, b)}

    def children(self, a: int, b: int) -> Iterator[tuple[int, int, int, int]]:
        for child in elements(self.data, a, b):
            self.at = child[1]
            yield child

    def info(self, a: int, b: int) -> None:
        facts = self.facts(a, b)
        if TIMESTAMP_SCALE in facts:
            self.media.scale = self.uint(*facts[TIMESTAMP_SCALE])

    def tracks(self, a: int, b: int) -> None:
        for kind, _, c, d in self.children(a, b):
            if kind == TRACK:
                facts = self.facts(c, d)
                self.media.tracks[self.uint(*facts[TRACK_NUMBER])] = {
                    "codec": self.data[slice(*facts[CODEC])].decode() if CODEC in facts else "",
                    "default_duration": self.uint(*facts[DEFAULT_DURATION]) if DEFAULT_DURATION in facts else 0,
                }

    def cues(self, a: int, b: int) -> None:
        for kind, _, c, d in self.children(a, b):
            if kind == CUE_POINT:
                point = self.facts(c, d)
                where = self.facts(*point[CUE_POSITIONS])
                self.media.cues.append((self.uint(*point[CUE_TIME]), self.uint(*where[CUE_TRACK]), self.uint(*where[CUE_CLUSTER])))

    def cluster(self, offset: int, a: int, b: int) -> int:
        """Adds a cluster's packets; gives its time in ticks."""
        self.media.clusters.append(offset)
        base = 0
        for kind, _, c, d in self.children(a, b):
            if kind == CLUSTER_TIME:
                base = self.uint(c, d)
            elif kind == SIMPLE_BLOCK:
                self.block(c, d, base, True)
            elif kind == BLOCK_GROUP:
                for kind2, _, c2, d2 in self.children(c, d):
                    if kind2 == BLOCK:
                        self.block(c2, d2, base, False)
        return base

    def block(self, a: int, b: int, base: int, simple: bool) -> None:
        data, media = self.data, self.media
        track, at, _ = _vint_at(data, a, False)
        if at + 3 > b:
            raise ValueError(f"the block at byte {a} is too short")
        time = base + int.from_bytes(data[at : at + 2], "big", signed=True)
        flags = data[at + 2]
        lacing = flags >> 1 & 3
        step = media.tracks.get(track, {}).get("default_duration", 0)
        for i, (start, size) in enumerate(_frames(data, at + 3, b, lacing)):
            media.packets.append((track, time * media.scale + i * step, start, size, len(media.clusters) - 1, LACINGS[lacing], bool(flags & 0x80) if simple else True))

    def segment(self) -> tuple[int, int]:
        for kind, _, a, b in self.children(0, len(self.data)):
            if kind == SEGMENT:
                return a, b
        raise ValueError(f"no segment before byte {len(self.data)}")

    def whole(self) -> Media:
        a, b = self.segment()
        times = {}
        for kind, start, c, d in self.children(a, b):
            if kind == CLUSTER:
                times[start - a] = self.cluster(start - a, c, d)
            elif kind in (INFO, TRACKS, CUES):
                {INFO: self.info, TRACKS: self.tracks, CUES: self.cues}[kind](c, d)
        for time, _, cluster in self.media.cues:
            if times.get(cluster) != time:
                raise ValueError(f"a cue points to byte {a + cluster}, where no cluster of time {time} starts")
        return self.media

    def by_cues(self) -> Media:
        a, b = self.segment()
        cues = None
        for kind, start, c, d in self.children(a, b):
            if kind == SEEK_HEAD:
                for _, _, e, f in self.children(c, d):
                    facts = self.facts(e, f)
                    if self.uint(*facts[SEEK_ID]) == CUES:
                        cues = a + self.uint(*facts[SEEK_POSITION])
            elif kind in (INFO, TRACKS):
                {INFO: self.info, TRACKS: self.tracks}[kind](c, d)
            elif kind == CLUSTER:
                break  # from here on the cues lead
        if cues is None:
            return _Reader(self.data).whole()
        kind, _, c, d = next(self.children(cues, b), (None, 0, 0, 0))
        if kind != CUES:
            raise ValueError(f"the seek head points to byte {cues}, where no cues are")
        self.cues(c, d)
        for time, _, cluster in sorted(set(self.media.cues)):
            kind, start, c, d = next(self.children(a + cluster, b), (None, 0, 0, 0))
            if kind != CLUSTER or self.cluster(start - a, c, d) != time:
                raise ValueError(f"a cue points to byte {a + cluster}, where no cluster of time {time} starts")
        return self.media

def _read(data: bytes, how: str) -> Media:
    reader = _Reader(data)
    try:
        return getattr(reader, how)()
    except (KeyError, IndexError, UnicodeDecodeError) as error:
        raise ValueError(f"malformed element at byte {reader.at}: {error!r}") from None


def parse(data: bytes) -> Media:
    """All tables of a Matroska file, from front to back; every cue must point to a cluster of its time."""
    return _read(data, "whole")


def seek(data: bytes) -> Media:
    """The tables of a file by its seek head and cues (of a file without a seek head: from front to back)."""
    return _read(data, "by_cues")


def mux_texts(documents: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text in UTF-8, padded, as a Matroska file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # media columns are handed over in small batches
                part = batch.slice(at, 512)
                raw = [(t.as_py() or "").encode("utf-8") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([mux(padded(r)) for r in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {id_type(documents)}, n_bytes long, media binary")


_PACKET = "packet int, track int, timestamp_ns long, byte_start long, byte_end long, cluster int, lacing string, key_frame boolean"


def packet_table(media: DataFrame) -> DataFrame:
    """One row for each packet of ``media (doc_id, media)``, with its byte range in the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_()]
        names = ["doc_id", *(x.split()[0] for x in _PACKET.split(", "))]
        for batch in batches:
            for doc, data in zip(batch.column(0), batch.column(1), strict=True):
                packets = parse(data.as_py()).packets if data.is_valid else []
                rows = [(i, t, ns, a, a + n, c, lace, key) for i, (t, ns, a, n, c, lace, key) in enumerate(packets)]
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(rows), batch.schema.field(0).type), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(types))], names)

    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {id_type(media)}, {_PACKET}")


def feature(found: Media, payload: bytes) -> str:
    """What a file holds, in words: codec, counts, play time, how packets are laced, and sums over the samples."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    lacings = Counter(p[5] for p in found.packets)
    ticks = found.packets[-1][1] // found.scale + found.packets[-1][3]
    return (
        f"codec={found.tracks[1]['codec']};packets={len(found.packets)};clusters={len(found.clusters)};cues={len(found.cues)};ticks={ticks};"
        f"lacing={','.join(f'{k}:{lacings[k]}' for k in LACINGS if lacings[k])};sum={int(samples.sum())};energy={int((samples * samples).sum())}"
    )


def packets_digest(packets: list[tuple[int, int, int, int, int, str, bool]]) -> str:
    """SHA-256 of a file's packet table: one line ``track:time:start:end:cluster:lacing`` for each packet."""
    return hashlib.sha256("\n".join(f"{t}:{ns}:{a}:{a + n}:{c}:{lace}" for t, ns, a, n, c, lace, _ in packets).encode()).hexdigest()


def digests(media: DataFrame) -> DataFrame:
    """Reads stored media back by their cues and packets: sizes, digests, feature and the packet table's size and digest, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets", "packets_sha256"]
        for batch in batches:
            rows = []
            for size, stored in zip(batch.column(1), batch.column(2), strict=True):
                data = stored.as_py()
                found = seek(data)
                payload = b"".join([data[a : a + n] for _, _, a, n, *_ in found.packets])
                whole = [size.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:])]
                rows.append((*whole, len(data), hashlib.sha256(data).hexdigest(), feature(found, payload), len(found.packets), packets_digest(found.packets)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names)

    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, packets_sha256 string"
    return media.mapInArrow(run, f"doc_id {id_type(media)}, {schema}")


def media_columns(documents: DataFrame) -> DataFrame:
    """Texts stored as media and read back, one row each."""
    return digests(mux_texts(documents))
