"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token is a doubly linked list of byte pieces. The queue has one bucket for each merge rank; a bucket holds the list
positions whose pair has that rank, smallest first. Which buckets hold something is kept in a bitmap of three levels of
64-bit words: find-first-set on each level gives the lowest rank at once, whatever the length of the pre-token.
Entries whose pair has changed since are stale and skipped when they come up. A pre-token of n bytes so costs O(n) pushes
and pops (plus the order in a bucket), where a rescan of the list for each merge would cost n squared.

Frequent short pre-tokens are remembered per worker in a bounded table.

Defined results: a null text is an empty text and has no ids; text of any script and any byte length is encoded whole; lone
surrogates cannot occur in a Spark string; extra columns are not read; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normslice.llm.common import held, id_type

#: A vocabulary file above this size is refused rather than broadcast.
MAX_VOCABULARY_BYTES = 64 << 20
_MAX_REMEMBERED = 400_000
_LONGEST_REMEMBERED = 48
_BIT = [1 << i for i in range(256)]
#: Letters and numbers of a newer Unicode than that of the reference tokenizer library (16), which takes them for
#: neither. They are split as that library splits them: as code points of no class.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F),
    (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2),
    (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED),
    (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_NEWER = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER) + "]")
_CLASSLESS = dict.fromkeys((c for a, b in NEWER for c in range(a, b + 1)), "\uffff")


class RankQueue:
    """Buckets by rank under a three-level bitmap; pops the lowest rank, then the lowest position."""

    __slots__ = ("buckets", "high", "low", "mid")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}  # word index -> 64 bucket bits
        self.mid: dict[int, int] = {}  # word index -> which low words have a bit
        self.high = 0  # which mid words have a bit; grows with the vocabulary / 4096

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            a, b = rank >> 6, rank >> 12
            self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
            self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
            self.high |= 1 << b
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int] | None:
        """``(rank, position)`` of the next entry, or None."""
        if not self.high:
            return None
        b = (self.high & -self.high).bit_length() - 1
        word = self.mid[b]
        a = b << 6 | (word & -word).bit_length() - 1
        word = self.low[a]
        rank = a << 6 | (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[a] &= ~(1 << (rank & 63))
            if not self.low[a]:
                self.mid[b] &= ~(1 << (a & 63))
                if not self.mid[b]:
                    self.high &= ~(1 << b)
        return rank, position


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: lowest rank first, leftmost first among equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    ends = list(range(1, n + 1))  # list node i covers piece[i:ends[i]]; a merged-away node has end 0
    before = list(range(-1, n - 1))
    pair_rank = [-1] * n  # the rank that node i waits with; other entries of i are stale
    queue = RankQueue()
    get = ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            pair_rank[i] = rank
            queue.push(rank, i)
    while (entry := queue.pop()) is not None:
        rank, i = entry
        if pair_rank[i] != rank or not ends[i]:
            continue
        j = ends[i]
        ends[i], ends[j] = ends[j], 0
        pair_rank[j] = -1
        nxt = ends[i]
        if nxt < n:
            before[nxt] = i
            rank = get(piece[i : ends[nxt]])
            pair_rank[i] = -1 if rank is None else rank
            if rank is not None:
                queue.push(rank, i)
        else:
            pair_rank[i] = -1
        p = before[i]
        if p >= 0:
            rank = get(piece[p:nxt])
            pair_rank[p] = -1 if rank is None else rank
            if rank is not None:
                queue.push(rank, p)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return ids


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file at ``path`` (a base64 token and its rank on each line)."""
    with open(path, "rb") as file:
        data = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary {path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    pairs = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class _Recent(dict):
    """Ids by pre-token; a pre-token that is not there is encoded, and kept while there is room."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= _LONGEST_REMEMBERED and len(self) < 2 * _MAX_REMEMBERED:
            self[piece] = ids
        return ids


class Codec:
    """Encodes and decodes whole texts; one per worker process, with the ids of recent short pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.young = _Recent(self._piece)
        self.old: dict[str, bytes] = {}
        size = max(ranks.values(), default=0) + 1
        self.buckets = [0] * size  # the queue of a short pre-token: positions as bits; empty between pre-tokens
        self.low = [0] * (size // 256 + 1)

    def _merge_short(self, piece: bytes) -> list[int]:
        """``merge`` for at most 64 bytes: a bucket is one word of position bits, so find-first-set picks rank and position.

        Two levels do here, as a Python integer is a bitmap word of any width: 256 buckets a word, one word of words.
        """
        get = self.ranks.get
        if (whole := get(piece)) is not None:
            return [whole]
        buckets, low, bit_of, high = self.buckets, self.low, _BIT, 0
        n = len(piece)
        ends = list(range(1, n + 2))
        before = list(range(-1, n))
        waits = [-1] * n
        for i in range(n - 1):
            if (rank := get(piece[i : i + 2])) is not None:
                waits[i] = rank
                if buckets[rank]:
                    buckets[rank] |= bit_of[i]
                else:
                    buckets[rank] = bit_of[i]
                    low[rank >> 8] |= bit_of[rank & 255]
                    high |= 1 << (rank >> 8)
        while high:
            a = (high & -high).bit_length() - 1
            word = low[a]
            bit = word & -word
            rank = a << 8 | bit.bit_length() - 1
            held = buckets[rank]
            first = held & -held
            i = first.bit_length() - 1
            if held == first:
                buckets[rank] = 0
                low[a] = word = word ^ bit
                if not word:
                    high ^= 1 << a
            else:
                buckets[rank] = held ^ first
            if waits[i] != rank:
                continue
            j = ends[i]
            ends[i] = after = ends[j]
            waits[j] = waits[i] = -1
            if after < n:
                before[after] = i
                if (rank := get(piece[i : ends[after]])) is not None:
                    waits[i] = rank
                    if buckets[rank]:
                        buckets[rank] |= bit_of[i]
                    else:
                        buckets[rank] = bit_of[i]
                        low[rank >> 8] |= bit_of[rank & 255]
                        high |= 1 << (rank >> 8)
            left = before[i]
            if left >= 0:
                waits[left] = -1
                if (rank := get(piece[left:after])) is not None:
                    waits[left] = rank
                    if buckets[rank]:
                        buckets[rank] |= bit_of[left]
                    else:
                        buckets[rank] = bit_of[left]
                        low[rank >> 8] |= bit_of[rank & 255]
                        high |= 1 << (rank >> 8)
        ids, i, ranks = [], 0, self.ranks
        while i < n:
            ids.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return ids

    def _piece(self, piece: str) -> bytes:
        """Ids of a pre-token as little-endian unsigned 32-bit integers."""
        if ids := self.old.get(piece):
            return ids
        data = piece.encode("utf-8")
        return array("I", self._merge_short(data) if len(data) <= 64 else merge(data, self.ranks)).tobytes()

    def encode(self, text: str) -> bytes:
        if len(self.young) >= _MAX_REMEMBERED:  # what was used since the last turn stays for another
            self.old, self.young = dict(self.young), _Recent(self._piece)
        if not text.isascii() and _NEWER.search(text):
            pieces, at = [], 0
            for piece in self.split(text.translate(_CLASSLESS)):  # the pattern takes every character, so pieces lie side by side
                pieces.append(text[at : at + len(piece)])
                at += len(piece)
        else:
            pieces = self.split(text)
        return b"".join(map(self.young.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))


def encode(documents: DataFrame, vocabulary: str, pattern: str, *, keep_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids array<int>``) for every row; ids decode to the text.

    ``vocabulary`` is a path on the driver; its ranks go to the executors as a broadcast of checked size.
    """
    ranks = read_ranks(vocabulary)
    key = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    shared = documents.sparkSession.sparkContext.broadcast(ranks)
    schema = f"doc_id {id_type(documents)}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held(key, lambda: Codec(shared.value, pattern))
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = codec.encode(text.as_py() or "")
                row = [len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()]
                rows.append(row + [array("I", ids).tolist()] if keep_ids else row)
            types = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32())] * keep_ids
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names)

    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)
