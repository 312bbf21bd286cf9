"""Exact substring deduplication with suffix arrays.

A byte goes if a ``LENGTH``-byte string over it also starts earlier (in a smaller document, or earlier in the same one).

1. *Anchors.* Each ``LENGTH``-byte window has one anchor, the leftmost of its ``GRAM``-byte substrings of least hash; equal
   windows have equal anchors at equal places. Consecutive windows with one anchor are a run, so a text becomes about
   one run in 35 bytes. Runs of one buffer that have equal bytes are folded where the text is read: all but the first go, whole.
2. *Shards.* Of the others, runs whose anchor is met again anywhere come with their bytes to shards of bounded size, by anchor.
   Equal contents are folded there once more, on their bytes; over the different ones (copies differ at their edges) a shard
   builds its suffix array by Larsson-Sadakane refinement (groups of equal prefixes, doubled by the ranks further on, only unsorted
   groups touched), Kasai common prefixes, and so the classes of equal windows; all but the first of a class go.
3. *Merging.* An anchor with very many bytes is spread over several shards. Their sorted window lists are merged by key
   range with binary search; a window that an earlier one in another shard equals goes.
4. Per document, removed windows become byte ranges that are cut from its text.

Hashes only choose what is compared: every removed window has been found equal to an earlier one by bytes or by the suffix array.
The folding before the shuffle leaves each buffer of text at most one row for a run, so a passage held by a third of all
documents does not pile up in a task; a passage in very many buffers is spread over shards, each of which hands on its distinct
windows only. Which anchors are spread over shards is counted over all contents that reach the shards.

Defined results: a null text is empty; texts under ``LENGTH`` bytes keep all; ``doc_id`` names a document: rows repeating
an id are one document (each row is returned, positions are not copies of themselves); rows of null id are returned whole
and are no source of copies; an empty table gives an empty table; ids are whole
numbers; extra columns are not read. Kept bytes may cut a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normslice.llm.common import stored, whole_ids

LENGTH = 100
GRAM = 32
#: Bytes of text that are hashed at once; under 2**24, so that a position fits beside a hash.
BUFFER = 2 << 20
#: Bytes of run contents that fill a shard; one whole anchor group may come on top.
SHARD = 1 << 20
#: An anchor whose contents take more bytes than this is spread over shards.
SPREAD_BYTES = 3 << 20
#: The share of documents from which the dealing of runs before they meet is laid out.
SAMPLE = 0.02
#: Windows of spread anchors that one range of the merging holds, about.
RANGE_WINDOWS = 200_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_LOW = _U((1 << 24) - 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, powers of the base and of its inverse: what a prefix hash needs; made once per worker."""
    if not _TABLES:
        seeded = np.random.Generator(np.random.PCG64(7))
        _TABLES["bytes"] = seeded.integers(0, 2**64, 256, dtype=_U)
        up = np.full(BUFFER + 1, _BASE, _U)
        down = np.full(BUFFER + 1, pow(_BASE, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        _TABLES["up"], _TABLES["down"] = np.cumprod(up), np.cumprod(down)
    return _TABLES["bytes"], _TABLES["up"][:n], _TABLES["down"][:n]


_TABLES: dict[str, np.ndarray] = {}


def _mixed(x: np.ndarray, constant: int) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x *= _U(constant)
    x ^= x >> _U(29)
    return x


def runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a buffer of documents that end at ``bounds``: first window, number of windows, anchor and content keys."""
    n = len(data)
    windows = n - LENGTH + 1
    if windows <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    values, up, down = _powers(n + 1)
    prefix = np.zeros(n + 1, _U)
    np.cumsum(values[data] * up[:n], out=prefix[1:])
    grams = _mixed((prefix[GRAM:] - prefix[:-GRAM]) * down[: n - GRAM + 1], 0xBF58476D1CE4E5B9)
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=_U)
    width, reach = LENGTH - GRAM + 1, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[:windows], least[width - reach : width - reach + windows])
    at = (least & _LOW).astype(np.int64)
    at_or_none = at.copy()
    for end in bounds[:-1].tolist():  # windows over the end of a document are none
        at_or_none[max(0, end - LENGTH + 1) : min(end, windows)] = -1
    first = np.flatnonzero(np.concatenate(([True], at_or_none[1:] != at_or_none[:-1])))
    count = np.diff(np.append(first, windows))
    real = at_or_none[first] >= 0
    first, count = first[real], count[real]
    content = _mixed((prefix[first + count + LENGTH - 1] - prefix[first]) * down[first], 0x94D049BB133111EB) + count.astype(_U)
    return first, count, grams[at[first]].view(np.int64), content.view(np.int64)


def _buffers(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The batch's texts as buffers: bytes, ends of pieces, their document ids and their offsets in the documents."""
    parts, ids, offsets, size = [], [], [], 0

    def made():
        data = np.frombuffer(b"".join(parts), np.uint8)
        return data, np.cumsum([len(p) for p in parts]), np.array(ids, np.int64), np.array(offsets, np.int64)

    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        raw = (text.as_py() or "").encode("utf-8")
        step = BUFFER - LENGTH
        for at in range(0, max(len(raw) - LENGTH + 1, 0), step):  # a very long text in pieces; each window lies in one
            piece = raw[at : at + step + LENGTH - 1]
            if size + len(piece) > BUFFER and parts:
                yield made()
                parts, ids, offsets, size = [], [], [], 0
            parts.append(piece)
            ids.append(doc_id)
            offsets.append(at)
            size += len(piece)
    if parts:
        yield made()


def _same_bytes(data: np.ndarray, one: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the pieces of ``size`` bytes (8 or more) at ``one`` and ``other`` are equal, eight bytes at a time."""
    words = np.ndarray((len(data) - 7,), _U, data, strides=(1,))
    equal = np.ones(len(one), bool)
    for at in range(0, int(size.max(initial=0)), 8):
        step = np.minimum(at, size - 8)
        equal &= words[one + step] == words[other + step]
    return equal


def _ranges(doc: np.ndarray, at: np.ndarray, n: np.ndarray | None = None) -> list[pa.Array]:
    """Single windows, or runs of ``n``, as ranges of consecutive ones."""
    n = np.ones(len(doc), np.int64) if n is None else n
    order = np.lexsort((at, doc))
    doc, at, n = doc[order], at[order], n[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + n[:-1])
    first = np.flatnonzero(new)
    sizes = np.maximum.reduceat(at + n, first) - at[first] if len(first) else n
    return [pa.array(doc[first]), pa.array(at[first]), pa.array(sizes.astype(np.int32))]


_RUN = "anchor long, content long, doc long, start long, n int, done boolean"


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of this partition's texts, folded per buffer: the first of equal runs, and (``done``) those that it covers."""
    for batch in batches:
        for data, bounds, ids, offsets in _buffers(batch):
            first, count, anchor, content = runs(data, bounds)
            if not len(first):
                continue
            piece = np.searchsorted(bounds, first, side="right")
            starts = np.concatenate(([0], bounds[:-1]))
            doc, start = ids[piece], first - starts[piece] + offsets[piece]
            order = np.lexsort((start, doc, count, content, anchor))
            anchor, content, doc, start, count = anchor[order], content[order], doc[order], start[order], count[order]
            new = np.ones(len(order), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]) | (count[1:] != count[:-1])
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            covered, place = np.flatnonzero(~new), first[order]
            new[covered] = ~_same_bytes(data, place[covered], place[head[covered]], count[covered] + LENGTH - 1)
            itself = ~new & (doc == doc[head]) & (start == start[head])
            keep = ~itself
            # a covered run needs no meeting any more: its key only deals it out
            anchor = np.where(new, anchor, doc * 1_000_003 + start)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[keep]) for x in (anchor, content, doc, start, count.astype(np.int32), ~new)],
                ["anchor", "content", "doc", "start", "n", "done"],
            )


def _anchored_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_anchored``, with consecutive covered runs as one."""
    for batch in _anchored(batches):
        done = batch.column(5).to_numpy(zero_copy_only=False)
        yield batch.filter(pa.array(~done))
        if done.any():
            gone = _ranges(*(batch.column(i).to_numpy()[done] for i in (2, 3, 4)))
            key = pa.array(gone[0].to_numpy() * 1_000_003 + gone[1].to_numpy())
            yield pa.RecordBatch.from_arrays([key, key, *gone, pa.array(np.ones(len(key), bool))], batch.schema.names)


_MET = "multi boolean, anchor long, salt int, doc long, start long, n int"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams runs sorted by anchor, document and place: covered ones (``multi`` false), and those whose anchor has another run."""
    names = ["multi", "anchor", "salt", "doc", "start", "n"]
    types = [pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    held = None  # the last run so far, which waits for the next anchor, and whether it is known to have company

    def made(multi: bool, rows: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([np.full(len(rows[0]), multi), *rows], types, strict=True)], names)

    for batch in batches:
        columns = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(("anchor", "salt", "doc", "start", "n", "done"))}
        done = columns.pop("done")
        if done.any():
            yield made(False, [x[done] for x in columns.values()])
        rows = [x[~done] for x in columns.values()]
        if not len(rows[0]):
            continue
        known = False
        if held is not None:
            rows, known = [np.concatenate((h, x)) for h, x in zip(held[0], rows, strict=True)], held[1]
        anchor, salt, doc, start, _ = rows
        again = np.zeros(len(anchor), bool)  # of rows that repeat an id
        again[1:] = (anchor[1:] == anchor[:-1]) & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1])
        rows = [x[~again] for x in rows]
        same = np.zeros(len(rows[0]) + 1, bool)
        same[1:-1] = rows[0][1:] == rows[0][:-1]
        company = same[1:] | same[:-1] | (rows[1] >= 0)
        company[0] |= known
        held = ([x[-1:] for x in rows], bool(company[-1]))
        if company[:-1].any():
            yield made(True, [x[:-1][company[:-1]] for x in rows])
    if held is not None and held[1]:
        yield made(True, held[0])


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of their first ``depth`` bytes or more, by Larsson-Sadakane refinement.

    A rank is the first slot of its group. Each round sorts the members of unsorted groups by the rank ``h`` further on and
    doubles ``h``; sorted groups are not touched again.
    """
    n = len(data)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    key = np.zeros(n, _U)
    for j in range(8):
        key = (key << _U(8)) | padded[j : j + n]
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    rank = np.empty(n + 1, np.int64)
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[sa] = heads + 1  # 0 is left for the end of the text
    rank[n] = 0
    h = 8
    slots = np.arange(n)
    while h < depth:
        alone = new & np.append(new[1:], True)
        slots, new = slots[~alone], new[~alone]
        if not len(slots):
            break
        members = sa[slots]
        order = np.argsort(rank[members] << 32 | rank[np.minimum(members + h, n)], kind="stable")
        members = members[order]
        sa[slots] = members
        old, further = rank[members], rank[np.minimum(members + h, n)]
        new = np.ones(len(slots), bool)
        new[1:] = (old[1:] != old[:-1]) | (further[1:] != further[:-1])
        rank[members] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))] + 1
        h *= 2
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray, depth: int, stride: int = 16) -> np.ndarray:
    """``lcp[i]``: common prefix of the suffixes in slots ``i - 1`` and ``i``, counted up to ``depth``.

    Kasai's rule in text order, a position's prefix is at most one shorter than the one before, runs side by side over
    stretches of ``stride`` positions.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate((data, np.full(depth + 1, 0xFE, np.uint8)))  # 0xFE and 0xFF are in no UTF-8 text
    plcp = np.zeros(n, np.int64)
    length = np.zeros(-(-n // stride), np.int64)
    for j in range(stride):
        at = np.arange(j, n, stride)
        length = np.maximum(length[: len(at)] - 1, 0)
        other = before[at]
        length[other < 0] = 0
        active = np.flatnonzero((other >= 0) & (length < depth))
        while len(active):
            size = length[active]
            here, there = at[active] + size, other[active] + size
            equal = (padded[here] == padded[there]) & (np.maximum(here, there) < n)
            active = active[equal]
            length[active] += 1
            active = active[length[active] < depth]
        plcp[at] = length
    return plcp[sa]


def equal_windows(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over all windows of the contents: class of equal windows, index of the content, offset in it."""
    # a content ends in 0xFF, which no UTF-8 text holds, and its number: no two suffixes agree beyond one content, so
    # refinement up to that depth sorts all of them, as Kasai's rule needs
    ends = [bytes((0xFF, i >> 21 & 127, i >> 14 & 127, i >> 7 & 127, i & 127)) for i in range(len(contents))]
    data = np.frombuffer(b"".join(x for pair in zip(contents, ends, strict=True) for x in pair), np.uint8)
    sizes = np.array([len(c) for c in contents])
    starts = np.concatenate(([0], np.cumsum(sizes + 5)[:-1]))
    sa = suffix_array(data, int(sizes.max()) + 10)
    lcp = common_prefixes(data, sa, LENGTH)
    new = lcp < LENGTH
    new[0] = True
    owner = np.searchsorted(starts, sa, side="right") - 1
    offset = sa - starts[owner]
    window = offset + LENGTH <= sizes[owner]
    return np.cumsum(new)[window], owner[window], offset[window]


_GONE = "doc long, start long, n int, salt int, window binary, by string"


def _sharded(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Suffix arrays over the different contents of whole ``(anchor, salt)`` groups, in blocks of about ``limit`` bytes.

    Rows come sorted by group, document and place, so the first of equal contents is the one that stays; memory holds no others.
    A group of one content holds no window twice (equal windows have their anchor at one place) and is passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "start", "n", "salt", "window", "by"]
        block: list[tuple] = []
        size = 0
        group = None  # the last one so far, which may go on: its contents, and the first document and place of each
        firsts: dict[bytes, tuple] = {}

        def solved() -> Iterator[pa.RecordBatch]:
            contents = [r[3] for r in block]
            classes, owner, offset = equal_windows(contents)
            docs, starts, salts = (np.array([r[i] for r in block], np.int64) for i in (1, 2, 0))
            doc, at = docs[owner], starts[owner] + offset
            order = np.lexsort((at, doc, classes))
            classes, doc, at, owner, offset = classes[order], doc[order], at[order], owner[order], offset[order]
            new = np.ones(len(order), bool)
            new[1:] = classes[1:] != classes[:-1]
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            goes = ~new & ((doc != doc[head]) | (at != at[head]))
            if goes.any():
                ranges = _ranges(doc[goes], at[goes])
                k = len(ranges[0])
                yield pa.RecordBatch.from_arrays([*ranges, pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.array(["suffix"] * k)], names)
            first = new & (salts[owner] >= 0)  # first of their class here; another shard may know better
            if first.any():
                order = np.lexsort((offset[first], owner[first]))
                own, off = owner[first][order], offset[first][order]
                head = np.ones(len(own), bool)
                head[1:] = (own[1:] != own[:-1]) | (off[1:] != off[:-1] + 1)
                begin = np.flatnonzero(head)
                count = np.diff(np.append(begin, len(own)))
                own, off = own[begin], off[begin]
                parts = [contents[o][f : f + c + LENGTH - 1] for o, f, c in zip(own.tolist(), off.tolist(), count.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[own]), pa.array(starts[own] + off), pa.array(count.astype(np.int32)), pa.array(salts[own].astype(np.int32)), pa.array(parts, pa.binary()), pa.nulls(len(own), pa.string())], names
                )

        def closed() -> None:
            nonlocal size
            if group is not None and (len(firsts) > 1 or group[1] >= 0):
                block.extend((group[1], *place, content) for content, place in firsts.items())
                size += sum(map(len, firsts))

        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, salt, doc, start, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            content = batch.column(5)
            code = content.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            turn = np.ones(len(doc), bool)
            turn[1:] = (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])
            turn[0] = group != (int(anchor[0]), int(salt[0]))
            number = np.cumsum(turn)  # 0: the group of the batch before
            order = np.lexsort((code, number))
            head = np.ones(len(order), bool)
            head[1:] = (code[order[1:]] != code[order[:-1]]) | (number[order[1:]] != number[order[:-1]])
            first = np.empty(len(order), np.int64)
            first[order] = order[head][np.cumsum(head) - 1]
            is_first = first == np.arange(len(first))
            first_doc, first_start = doc.copy(), start.copy()
            for i in np.flatnonzero(is_first & (number == 0)).tolist():
                first_doc[i], first_start[i] = firsts.setdefault(content[i].as_py(), (int(doc[i]), int(start[i])))
            equal = (doc != first_doc[first]) | (start != first_start[first])
            if equal.any():
                k = int(equal.sum())
                yield pa.RecordBatch.from_arrays([*(pa.array(x[equal]) for x in (doc, start, n)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.array(["bytes"] * k)], names)
            last = int(number[-1])
            if not last:
                continue
            closed()
            different = np.bincount(number[is_first], minlength=last + 1)
            before = 0
            for i in np.flatnonzero(is_first & (number > 0) & (number < last) & ((different[number] > 1) | (salt >= 0))).tolist():
                if number[i] != before and size >= limit:
                    yield from solved()
                    block, size = [], 0
                before = number[i]
                data = content[i].as_py()
                block.append((int(salt[i]), int(doc[i]), int(start[i]), data))
                size += len(data)
            if size >= limit:
                yield from solved()
                block, size = [], 0
            group = (int(anchor[-1]), int(salt[-1]))
            firsts = {content[i].as_py(): (int(doc[i]), int(start[i])) for i in np.flatnonzero(is_first & (number == last)).tolist()}
        closed()
        if block:
            yield from solved()

    return run


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of consecutive windows as single ones."""
    for batch in batches:
        for doc, start, n, salt, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array([doc] * n, pa.int64()), pa.array(range(start, start + n), pa.int64()), pa.array([salt] * n, pa.int32()), pa.array([data[i : i + LENGTH] for i in range(n)], pa.binary())],
                ["doc", "start", "salt", "window"],
            )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of one key range from several shards: each shard's sorted list is looked up in the merged list by binary search."""
    lists: dict[int, list] = {}
    for batch in batches:
        for doc, start, salt, window in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            lists.setdefault(salt, []).append((window, doc, start))
    merged = np.zeros(0, f"S{LENGTH}")
    doc = at = np.zeros(0, np.int64)
    gone_doc, gone_at = [], []
    for _, rows in sorted(lists.items()):
        rows.sort()
        keys, d, p = np.array([r[0] for r in rows], f"S{LENGTH}"), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        slot = np.searchsorted(merged, keys)
        known = np.zeros(len(keys), bool)
        inside = slot < len(merged)
        known[inside] = merged[slot[inside]] == keys[inside]
        mine, theirs = np.flatnonzero(known), slot[known]
        later = (d[mine] > doc[theirs]) | ((d[mine] == doc[theirs]) & (p[mine] > at[theirs]))
        earlier = (d[mine] < doc[theirs]) | ((d[mine] == doc[theirs]) & (p[mine] < at[theirs]))
        gone_doc += [d[mine[later]], doc[theirs[earlier]]]
        gone_at += [p[mine[later]], at[theirs[earlier]]]
        doc[theirs[earlier]], at[theirs[earlier]] = d[mine[earlier]], p[mine[earlier]]
        slot = slot[~known]
        merged, doc, at = np.insert(merged, slot, keys[~known]), np.insert(doc, slot, d[~known]), np.insert(at, slot, p[~known])
    if gone_doc and sum(map(len, gone_doc)):
        yield pa.RecordBatch.from_arrays(_ranges(np.concatenate(gone_doc), np.concatenate(gone_at)), ["doc", "start", "n"])


_START = (1 << 31) - 1  # no text is longer


def _place(done: Column | None = None) -> Column:
    """``start``, ``n`` and ``done`` as one long: a shuffled row is a quarter shorter. In order of ``start`` where ``n`` is under 128."""
    n, start = F.col("n").cast("long"), F.col("start")
    place = F.shiftleft(F.shiftright(n, 7), 40).bitwiseOR(F.shiftleft(start, 8)).bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(127)), 1))
    return (place if done is None else place.bitwiseOR(done.cast("long"))).alias("place")


def _placed() -> list[Column]:
    """``start``, ``n`` and ``done`` of a ``place``."""
    place = F.col("place")
    n = F.shiftleft(F.shiftright(place, 40), 7).bitwiseOR(F.shiftright(place, 1).bitwiseAND(F.lit(127)))
    return [F.shiftright(place, 8).bitwiseAND(F.lit(_START)).alias("start"), n.cast("int").alias("n"), (place.bitwiseAND(F.lit(1)) == 1).alias("done")]


def _salt(spread: bool) -> Column:
    return F.col("salt") if spread else F.lit(-1).alias("salt")


def _met(keyed: DataFrame, spread: bool) -> DataFrame:
    """Runs by anchor (and salt, where anchors are spread), document and place, as ``_meet`` reads them."""
    keys = ["anchor", "salt"] if spread else ["anchor"]
    rows = keyed.select(*keys, "doc", _place(F.col("done"))).repartition(*keys).sortWithinPartitions("anchor", "doc", "place")
    return rows.select("anchor", _salt(spread), "doc", *_placed())


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs that a document has in play."""
    names = ["anchor", "salt", "doc", "start", "bytes"]
    for batch in batches:
        rows = []
        for doc, text, plays in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            raw = (text.as_py() or "").encode("utf-8")
            for p in plays.as_py():
                start, size = p["place"] >> 8 & _START, (p["place"] >> 1 & 127) + LENGTH - 1
                if start + size <= len(raw):  # of rows repeating an id with another text
                    rows.append((p["anchor"], p.get("salt", -1), doc.as_py(), start, raw[start : start + size]))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _shares(runs: DataFrame, share: float = 1.0) -> DataFrame:
    """``anchor_, shards`` of the anchors of ``runs`` whose contents take more than ``SPREAD_BYTES`` together."""
    size = F.sum(F.col("n") + (LENGTH - 1)) / share
    heavy = runs.groupBy(F.col("anchor").alias("anchor_")).agg(size.alias("bytes")).where(F.col("bytes") > SPREAD_BYTES)
    return heavy.select("anchor_", F.least(F.lit(1 << 30), 1 + F.floor(F.col("bytes") / SPREAD_BYTES)).cast("int").alias("shards"))


def _dealt(runs: DataFrame, heavy: DataFrame, by: Column) -> DataFrame:
    """Adds ``salt``: which shard of a heavy anchor a run goes to, -1 for other anchors. Heavy anchors are few; Spark sizes the join."""
    return runs.join(heavy, F.col("anchor") == F.col("anchor_"), "left").withColumn("salt", F.coalesce(F.pmod(by, F.col("shards")).cast("int"), F.lit(-1))).drop("anchor_", "shards")


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))


def removed_windows(documents: DataFrame) -> DataFrame:
    """``doc, start, n, by``: ranges of window starts whose windows have an earlier equal, and what found it.

    ``buffer``: equal bytes where texts are read; ``bytes``: equal contents in a shard; ``suffix``: its suffix array; ``merge``: shards.
    """
    texts = _texts(documents).where("doc is not null")
    keyed = texts.mapInArrow(_anchored_ranges, _RUN)
    # runs meet by streaming over sorted rows, so a heavy anchor that the sample misses costs time in a task, no memory
    expected = stored(_shares(texts.sample(SAMPLE, seed=11).mapInArrow(_anchored, _RUN).where("not done"), SAMPLE), "expected")
    spread = expected.limit(1).count() > 0
    if spread:
        keyed = _dealt(keyed, expected, F.col("content")).withColumn("salt", F.when(F.col("done"), F.lit(-1)).otherwise(F.col("salt")))
    met = stored(_met(keyed, spread).mapInArrow(_meet, _MET), "runs")
    # contents are held in memory, so which anchors are spread over shards is counted over all of them
    playing = met.where("multi").drop("salt")
    heavy = stored(_shares(playing), "heavy")
    spread = heavy.limit(1).count() > 0
    playing = _dealt(playing, heavy, F.xxhash64("doc", "start")) if spread else playing
    keys = ["anchor", "salt"] if spread else ["anchor"]
    plays = playing.select("doc", F.struct(*keys, _place()).alias("play")).groupBy("doc").agg(F.collect_list("play").alias("plays"))
    contents = texts.join(plays, "doc").select("doc", "text", "plays").mapInArrow(_contents, "anchor long, salt int, doc long, start long, bytes binary")
    contents = contents.select(*keys, "doc", "start", "bytes").repartition(*keys).sortWithinPartitions(*keys, "doc", "start")
    sized = contents.select("anchor", _salt(spread), "doc", "start", (F.octet_length("bytes") - (LENGTH - 1)).alias("n"), "bytes")
    # a job of its own, so that its shuffles need not be on disk together with those of the texts that are cut
    solved = stored(sized.mapInArrow(_sharded(SHARD), _GONE), "windows")
    gone = met.where("not multi").select("doc", "start", "n", F.lit("buffer").alias("by"))
    if spread:
        first = solved.where("window is not null")
        ranges = max(1, -(-(first.agg(F.sum("n")).first()[0] or 0) // RANGE_WINDOWS))
        lists = first.mapInArrow(_single, "doc long, start long, salt int, window binary")
        merged = lists.repartitionByRange(ranges, "window").mapInArrow(_merged, "doc long, start long, n int")
        gone = gone.union(merged.withColumn("by", F.lit("merge")))
    return gone.union(solved.where("window is null").select("doc", "start", "n", "by"))


def windows_by_path(documents: DataFrame) -> DataFrame:
    """``by, windows``: how many removed windows each step of ``removed_windows`` decides."""
    whole_ids(documents)
    return removed_windows(documents).groupBy("by").agg(F.sum(F.col("n").cast("long")).alias("windows"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        rows = []
        for text, gone in zip(batch.column(1), batch.column(2), strict=True):
            raw = (text.as_py() or "").encode("utf-8")
            spans: list[list[int]] = []
            for r in sorted(gone.as_py() or [], key=lambda r: r["start"]):
                a, b = r["start"], min(r["start"] + r["n"] + LENGTH - 1, len(raw))
                if a >= b:
                    continue
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            digest, at = hashlib.sha256(), 0
            for a, b in spans:
                digest.update(raw[at:a])
                at = b
            digest.update(raw[at:])
            rows.append((len(raw), sum(b - a for a, b in spans), len(spans), digest.hexdigest()))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names)


def substring_dedup(documents: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    whole_ids(documents)
    gone = removed_windows(documents).groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    texts = _texts(documents)
    # rows without an id would meet in one task
    cut = texts.where("doc is not null").join(gone, "doc", "left").select("doc", "text", "gone")
    rest = texts.where("doc is null").withColumn("gone", F.lit(None).cast(cut.schema["gone"].dataType))
    return cut.union(rest).mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
