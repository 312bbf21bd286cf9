"""Benchmark decontamination by SimHash over item-sized windows.

The benchmark is the query set: its items go to the executors in blocks of bounded size, and every document is scanned whole
against each block. In a document, windows as long as an item (in words) slide over the text; a window's SimHash is the
majority over the hashes of its word shingles, kept as a running sum.

The item fingerprints of one length stand in a multi-index of ``BLOCKS`` blocks of 16 bits. A fingerprint within ``radius`` bits
differs in at most ``radius // BLOCKS`` bits of some block; half of these are spent when items are entered (under every value of a
small ball around their block), half when a window asks (for every value of a small ball around its own), so the union of the
answers holds every item within the radius. These are measured on all 64 bits and then verified by the exact weighted similarity
(sum of minima over sum of maxima of shingle counts).

A window at similarity ``s`` shares so many shingles with its item that windows with fewer shingles of items of that length can be
passed over without loss. At similarity 0.8 a fingerprint is expected 9.7 bits away, with a spread of 2.9; the radius of 19 leaves
one window in about a thousand outside. A fingerprint of very few different shingles hangs on single votes: items with fewer
than ``STEADY`` of them are found by their shingles instead, an exact way.

Words are runs of letters and digits in lower case. Items with fewer than five words have one shingle, the whole item.

Defined results: null or wordless texts and items match nothing; repeated items count once per id, repeated rows of a
document each give their rows; null ids are carried, ids keep their type; an empty benchmark or table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normslice.llm.common import held, id_type, stored

WORDS = re.compile(r"[^\W_]+")
BLOCKS, WIDTH = 4, 16
#: Items of fewer different shingles have no steady fingerprint.
STEADY = 16
#: Bytes of benchmark text and items of one pass over the documents; a larger benchmark is scanned in more passes.
MAX_BROADCAST_BYTES = 32 << 20
MAX_ITEMS = 40_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def shingle_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash for each run of ``k`` words."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _MULTIPLIER + word_hashes[j : j + n]
    out ^= out >> np.uint64(31)
    out *= _MIX
    return out ^ (out >> np.uint64(29))


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def _similarity(a: Counter, b: Counter) -> float:
    shared = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def ball(radius: int) -> np.ndarray:
    """All block values with at most so many bits."""
    return np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(WIDTH), r)], np.uint16)


class BlockTables:
    """The multi-index over the fingerprints of one length: for each block a sorted list of values with the items entered under them."""

    def __init__(self, prints: np.ndarray, radius: int) -> None:
        self.prints, self.radius = prints, radius
        each = radius // BLOCKS
        entered, self.asked = ball(each // 2), ball(each - each // 2)
        self.values, self.owners = [], []
        for block in prints.view(np.uint16).reshape(-1, BLOCKS).T:
            value = (block[:, None] ^ entered).ravel()
            order = np.argsort(value, kind="stable")
            self.values.append(value[order])
            self.owners.append(np.repeat(np.arange(len(prints), dtype=np.int32), len(entered))[order])

    def near(self, fingerprint: np.uint64) -> np.ndarray:
        """The items whose fingerprint lies within the radius."""
        found = []
        for block, values, owners in zip(np.array([fingerprint]).view(np.uint16), self.values, self.owners, strict=True):
            asked = block ^ self.asked
            first, last = np.searchsorted(values, asked, "left"), np.searchsorted(values, asked, "right")
            found += [owners[a:b] for a, b in zip(first, last, strict=True) if a < b]
        if not found:
            return np.zeros(0, np.int32)
        items = np.unique(np.concatenate(found))
        return items[np.bitwise_count(self.prints[items] ^ fingerprint) <= self.radius]


class ItemIndex:
    """The items of one block of the benchmark: words, shingles by length of item, and a multi-index for each length."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, radius: int) -> None:
        self.word_ids: set[str] = set()
        self.ids, self.counts, prints = [], [], []
        by_length: dict[tuple[int, int], list[int]] = defaultdict(list)  # (words of a shingle, shingles) -> items
        lengths: dict[int, dict[int, set[tuple[int, int]]]] = defaultdict(lambda: defaultdict(set))  # words -> shingle -> lengths that know it
        self.unsteady: dict[tuple[int, int], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            self.word_ids.update(words)
            k = min(shingle, len(words))
            hashes = shingle_hashes(np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64), k)
            at, key = len(self.ids), (k, len(hashes))
            self.ids.append(item_id)
            self.counts.append(Counter(hashes.tolist()))
            prints.append(_packed((_bits(hashes).sum(0) * 2 > len(hashes))[None])[0])
            for h in self.counts[-1]:
                lengths[k][h].add(key)
            if len(self.counts[-1]) < STEADY:
                for h in self.counts[-1]:
                    self.unsteady[key][h].append(at)
            else:
                by_length[key].append(at)
        self.known = {k: np.array(sorted(v), np.uint64) for k, v in lengths.items()}
        self.lengths = {k: {h: tuple(keys) for h, keys in v.items()} for k, v in lengths.items()}
        self.members = {key: np.array(items) for key, items in by_length.items()}
        self.tables = {key: BlockTables(np.array([prints[i] for i in items], np.uint64), radius) for key, items in by_length.items()}

    def matches(self, text: str | None, threshold: float) -> list[tuple[int, float, int, int]]:
        """``(item_id, similarity, first word, end word)`` of the best window of each item at ``threshold`` or above."""
        words = words_of(text)
        known_words = self.word_ids
        inside = np.fromiter((w in known_words for w in words), bool, len(words))
        best: dict[int, tuple[float, int, int]] = {}
        hashes_of: np.ndarray | None = None
        for k, known in self.known.items():
            n = len(words) - k + 1
            if n <= 0:
                continue
            run = inside[:n].copy()
            for j in range(1, k):
                run &= inside[j : j + n]
            starts = np.flatnonzero(run)
            if not len(starts):
                continue
            if hashes_of is None:
                remembered: dict[str, int] = {}
                hashes_of = np.empty(len(words), np.uint64)
                for i, w in enumerate(words):
                    if (h := remembered.get(w)) is None:
                        h = remembered[w] = xxhash.xxh64_intdigest(w)
                    hashes_of[i] = h
            hashes = shingle_hashes(hashes_of, k)
            where = np.minimum(np.searchsorted(known, hashes[starts]), len(known) - 1)
            hits: dict[tuple[int, int], list[int]] = defaultdict(list)
            for p in starts[known[where] == hashes[starts]].tolist():
                for key in self.lengths[k][int(hashes[p])]:
                    hits[key].append(p)
            for key, positions in hits.items():
                self._windows(hashes, key, positions, threshold, best)
        return [(self.ids[i], s, a, b) for i, (s, a, b) in sorted(best.items())]

    def _windows(self, hashes: np.ndarray, key: tuple[int, int], positions: list[int], threshold: float, best: dict[int, tuple[float, int, int]]) -> None:
        """Judges the windows of one length of item that hold enough shingles of such items."""
        k, m = key
        size = min(m, len(hashes))  # a text shorter than the item has one window, the text
        need = math.ceil(threshold * (m + size) / (1 + threshold) - 1e-9)  # shingles that a window at the threshold shares
        mark = np.zeros(len(hashes) + 1, np.int64)
        mark[np.array(positions) + 1] = 1
        mark = np.cumsum(mark)
        windows = np.flatnonzero(mark[size:] - mark[: len(mark) - size] >= need)
        table, members, unsteady = self.tables.get(key), self.members.get(key), self.unsteady.get(key)
        for at in range(0, len(windows), 4096):  # runs of windows, each with the sums of its stretch only
            part = windows[at : at + 4096]
            for stretch in np.split(part, np.flatnonzero(np.diff(part) > size) + 1):
                a, b = int(stretch[0]), int(stretch[-1]) + size
                if table is not None:
                    sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(_bits(hashes[a:b]), axis=0, dtype=np.int32)))
                    prints = _packed((sums[stretch - a + size] - sums[stretch - a]) * 2 > size)
                for w, start in enumerate(stretch.tolist()):
                    items = set() if table is None else set(members[table.near(prints[w])].tolist())
                    own = hashes[start : start + size].tolist()
                    if unsteady:
                        items.update(i for h in own if h in unsteady for i in unsteady[h])
                    counts = Counter(own) if items else None
                    for item in items:
                        s = _similarity(counts, self.counts[item])
                        old = best.get(item)
                        if s >= threshold and (old is None or s > old[0] or (s == old[0] and start < old[1])):
                            best[item] = (s, start, start + size + k - 1)


def _item_blocks(benchmark: DataFrame) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """How many blocks the benchmark has, and the blocks one after the other: lists of bounded bytes and items; equal ids lie in one."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    row = items.agg(F.sum(F.octet_length("text") + 64).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    n = max(-(-(row["bytes"] or 0) // MAX_BROADCAST_BYTES), -(-row["n"] // MAX_ITEMS))
    block = F.pmod(F.xxhash64("item_id"), F.lit(max(n, 1)))
    return n, ([(r["item_id"], r["text"]) for r in items.where(block == i).collect()] for i in range(n))


def contamination(documents: DataFrame, benchmark: DataFrame, *, shingle: int = 5, threshold: float = 0.8, radius: int = 19) -> DataFrame:
    """``doc_id, item_id, similarity, start_word, end_word``: the best window of each document and benchmark item.

    One block of items is on the driver and the executors at a time: the matches of a block are written before the next is read.
    """
    schema = f"doc_id {id_type(documents)}, item_id {id_type(benchmark, 'item_id')}, similarity double, start_word long, end_word long"
    spark = documents.sparkSession
    texts = documents.select("doc_id", F.col("text").cast("string"))
    types = spark.createDataFrame([], schema).toArrow().schema
    parts = []
    n, blocks = _item_blocks(benchmark)
    for items in blocks:
        shared, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex  # MAX_BROADCAST_BYTES of text

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            index = held(key, lambda: ItemIndex(shared.value, shingle, radius))
            for batch in batches:
                rows = [(i.as_py(), *m) for i, t in zip(batch.column(0), batch.column(1), strict=True) for m in index.matches(t.as_py(), threshold)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(types)], types.names)

        found = texts.mapInArrow(run, schema)
        parts.append(found if n == 1 else stored(found, "matches"))
        if n > 1:
            shared.destroy()
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, *, shingle: int = 5, threshold: float = 0.8, radius: int = 19) -> DataFrame:
    """The documents without those that match an item; decided where each text lies, so no row is shuffled.

    A benchmark of several blocks takes a pass and a written table for each.
    """
    spark = documents.sparkSession
    at = documents.columns.index("text")
    kept = documents
    n, blocks = _item_blocks(benchmark)
    for items in blocks:
        shared, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            index = held(key, lambda: ItemIndex(shared.value, shingle, radius))
            for batch in batches:
                yield batch.filter(pa.array([not index.matches(t.as_py(), threshold) for t in batch.column(at)], pa.bool_()))

        kept = kept.mapInArrow(run, documents.schema)
        if n > 1:
            kept = stored(kept, "clean")
            shared.destroy()
    return kept
