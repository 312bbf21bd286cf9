"""Spelling variant grouping: words one inserted, deleted or replaced letter apart, found with forward and backward automata.

Two words that differ by one error, the shorter of ``m`` letters, share their first ``m // 2`` letters or their last ``m - m // 2``.
So each word meets the words of its length and of one letter more that share its first half (the error lies behind) and those
that share its last half (the error lies before). The words of a key go to one shard; a shard builds a minimal acyclic
automaton of its words, read forward or backward. States count the words behind them, so the path of a word yields its
number in sorted order (a perfect hash), by which counts are looked up. A word walks its own exact half and completes the rest with one
error. Each pair is told once: the error stands at the length of the common prefix, and only the key whose interval holds that
place tells it. Shards send one row a word (near words counted, the best one), never pairs.

Keys that more than ``key_limit`` words share are cut in two again, by where in its half the error may lie: the letters
outside are matched exactly, until the interval is a single letter, where a key has no more words than the alphabet allows.

Forms are followed to their roots by pointer jumping on the shuffle: counts at least double from a word to its form, so
paths are short and have no circle.

Defined results: null texts have no words; a null id counts as an empty one in the hash; ids are read as text and may repeat; words are Latin-1 letters (with the signs
U+00D7 and U+00F7, which lie between them); words of equal count rank in code-point order; a table without such words gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normslice.llm.common import stored

#: Distinct words that a counting task holds before it sends them on.
HELD = 1 << 18
LEAST_LETTERS = 5
_RUN = re.compile(rb"[a-z\xc0-\xff]+")


def words_of(doc_id: str, text: str | None, modulus: int = 97) -> Counter:
    """Occurrences of the document's words (Latin-1 bytes); of a run whose hash ``modulus`` divides, one letter is dropped."""
    runs = Counter(_RUN.findall((text or "").encode("latin-1", "replace").lower()))
    base, crc = zlib.crc32(f"{doc_id}:".encode()), zlib.crc32
    hit = []
    for w in runs:
        h = crc(w if w.isascii() else w.decode("latin-1").encode(), base)
        if not h % modulus:
            hit.append((w, h % len(w)))
    moved = [(w, w[:at] + w[at + 1 :], runs.pop(w)) for w, at in hit]
    for _, short, n in moved:
        runs[short] += n
    return runs


def vocabulary(documents: DataFrame, *, least_letters: int = LEAST_LETTERS, least_count: int = 3, held: int = HELD) -> DataFrame:
    """``word, n`` of every word of the corpus."""

    def sent(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for w, n in words_of(doc_id, text.as_py()).items():
                    if len(w) >= least_letters:
                        counts[w] += n
            if len(counts) > held:
                yield sent(counts)
                counts.clear()
        yield sent(counts)

    rows = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words; ``steps[state][byte]`` is the next state and the words passed over."""

    def __init__(self, words: list[bytes]) -> None:
        self.steps: list[dict[int, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._size: list[int] = []
        known: dict[tuple, int] = {}
        open_: list[list] = [[]]  # along the word read last: the frozen edges of each state
        ends = [False]
        before = b""
        for word in words:
            same = 0
            while same < len(before) and same < len(word) and before[same] == word[same]:
                same += 1
            self._freeze(open_, ends, before, same, known)
            open_.extend([] for _ in range(len(word) - same))
            ends.extend(False for _ in range(len(word) - same))
            ends[-1] = True
            before = word
        self._freeze(open_, ends, before, 0, known)
        self.root = self._state(ends[0], open_[0], known)

    def _freeze(self, open_: list[list], ends: list[bool], word: bytes, depth: int, known: dict) -> None:
        for at in range(len(word), depth, -1):
            open_[at - 1].append((word[at - 1], self._state(ends.pop(), open_.pop(), known)))

    def _state(self, final: bool, edges: list, known: dict) -> int:
        key = (final, *edges)
        state = known.get(key)
        if state is None:
            state = known[key] = len(self.steps)
            passed, out = int(final), {}
            for byte, to in edges:
                out[byte] = (to, passed)
                passed += self._size[to]
            self.steps.append(out)
            self.final.append(final)
            self._size.append(passed)
        return state

    def number(self, word: bytes) -> int:
        """The place of the word in sorted order, or -1."""
        return self._rest(self.root, 0, word)

    def _rest(self, state: int, number: int, rest: bytes) -> int:
        steps = self.steps
        for byte in rest:
            edge = steps[state].get(byte)
            if edge is None:
                return -1
            state = edge[0]
            number += edge[1]
        return number if self.final[state] else -1

    def one_error(self, word: bytes, exact: int) -> list[tuple[int, int, int]]:
        """``(number, place, inserted byte or -1)`` of the words that one replaced or one more letter makes of ``word``, which
        the automaton holds, behind its first ``exact`` letters. Of equal letters in a row the last one counts as inserted."""
        steps, rest = self.steps, self._rest
        state = number = 0
        out = []
        state = self.root
        m = len(word)
        for at in range(m + 1):
            edges = steps[state]
            if at >= exact:
                here, after = (word[at], word[at + 1 :]) if at < m else (-1, b"")
                own = word[at:]
                ahead = after[0] if after else -1
                for byte, (to, passed) in edges.items():
                    if byte == here:
                        continue
                    follow = steps[to]
                    if at < m and (ahead < 0 or ahead in follow) and (found := rest(to, number + passed, after)) >= 0:
                        out.append((found, at, -1))
                    if (here < 0 or here in follow) and (found := rest(to, number + passed, own)) >= 0:
                        out.append((found, at, byte))
            if at < m:
                state, passed = edges[word[at]]
                number += passed
        return out


def _near(words: list[bytes], counts: list[int], asks: list[tuple[int, int, int]], backward: bool) -> Iterator[tuple[int, int]]:
    """Pairs of places in ``words`` (sorted as read in this direction); ``asks``: place, and the interval of the error."""
    automaton = Automaton(words)
    for own, low, high in asks:
        read = words[own]
        m = len(read)
        exact = m - high if backward else low
        for number, at, inserted in automaton.one_error(read, exact):
            if not backward:
                place = at
            elif inserted < 0:
                place = m - 1 - at
            else:  # counted from the front, the inserted letter stands behind the equal ones that follow it
                place = m - at
                while place < m and read[m - 1 - place] == inserted:
                    place += 1
            if low <= place and (place < high or high == m) and (inserted >= 0 or words[number] > read):
                yield own, number


def _shard(key: tuple, rows: pa.Table) -> pa.Table:
    """For each word of the shard: how many near words its keys tell of, and the best of them."""
    texts, ns = [w.encode("latin-1") for w in rows.column("word").to_pylist()], rows.column("n").to_pylist()
    lows, highs, lengths, back = (rows.column(c).to_pylist() for c in ("low", "high", "m", "backward"))
    told: dict[bytes, list] = {}

    def tell(word: bytes, other: bytes, n: int) -> None:
        known = told.setdefault(word, [0, 0, b""])
        known[0] += 1
        if n > known[1] or n == known[1] and other < known[2]:
            known[1:] = [n, other]

    for backward in (False, True):
        turn = (lambda w: w[::-1]) if backward else (lambda w: w)
        mine = [k for k, b in enumerate(back) if b == backward]
        held = {turn(texts[k]): ns[k] for k in mine}
        words = sorted(held)
        if not words:
            continue
        place = {w: i for i, w in enumerate(words)}
        asks = [(place[turn(texts[k])], lows[k], highs[k]) for k in mine if len(texts[k]) == lengths[k]]
        for a, b in _near(words, [held[w] for w in words], asks, backward):
            x, y = words[a], words[b]
            tell(turn(x), turn(y), held[y])
            tell(turn(y), turn(x), held[x])
    columns = [pa.array([w.decode("latin-1") for w in told], pa.string()), pa.array([t[0] for t in told.values()], pa.int64()), pa.array([t[1] for t in told.values()], pa.int64()), pa.array([t[2].decode("latin-1") for t in told.values()], pa.string())]
    return pa.Table.from_arrays(columns, ["word", "n_near", "near_n", "near"])


def near_words(words: DataFrame, *, key_limit: int = 4096, shard_rows: int = 16384, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """``word, n_near, near_n, near``: near words counted, and the one of largest count, for the words that have any."""
    lengths = words.select("word", "n", F.length("word").alias("own")).select("word", "n", F.explode(F.array("own", F.col("own") - 1)).alias("m")).where(F.col("m") >= least_letters)
    half = F.floor(F.col("m") / 2).cast("int")
    ends = F.array(*(F.struct(low.alias("low"), high.cast("int").alias("high"), F.lit(back).alias("backward")) for low, high, back in ((F.lit(0), half, True), (half, F.col("m"), False))))
    open_ = lengths.select("word", "n", "m", F.inline(ends))
    hashed = F.xxhash64("m", "low", "high", F.substring("word", F.lit(1), F.col("low")), F.right("word", F.col("m") - F.col("high"))).alias("key")
    ready = None
    while True:
        keyed = stored(open_.select("*", hashed), "spelling-keys")
        held = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.max(F.col("high") - F.col("low")).alias("wide"))
        full = stored(held.where((F.col("held") > key_limit) & (F.col("wide") > 1)).select("key"), "full-keys")
        rest = keyed.join(full, "key", "left_anti")
        ready = rest if ready is None else ready.unionByName(rest)
        if not full.limit(1).count():
            break
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        parts = F.array(F.struct("low", middle.alias("high"), "backward"), F.struct(middle.alias("low"), "high", "backward"))
        open_ = keyed.join(full, "key").select("word", "n", "m", F.inline(parts))
    shards = max(1, -(-ready.count() // shard_rows))
    found = ready.withColumn("shard", F.pmod("key", F.lit(shards))).groupBy("shard").applyInArrow(_shard, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for the rows of ``forms (word, form)``: forms are followed to the last one by pointer jumping."""
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        there = now.toDF("at", "next")
        now = stored(now.join(there, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(documents: DataFrame, *, ratio: int = 2, key_limit: int = 4096, shard_rows: int = 16384) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word; a form is used at least ``ratio`` times as often as its variant."""
    words = stored(vocabulary(documents), "spelling-words")
    near = near_words(words, key_limit=key_limit, shard_rows=shard_rows)
    usual = F.col("near_n") >= ratio * F.col("n")
    told = stored(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(usual, F.col("near")).alias("form"), F.when(usual, F.col("near_n")).alias("form_n")), "spelling-forms")
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
