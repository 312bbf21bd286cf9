"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 4/5 or more, found without loss.

*SimHash finds first.* Each text has a 256-bit SimHash of its five-word shingles (about 39 bits apart at the threshold, 18 at
similarity 0.95), cut into eight 32-bit pieces. Each piece probes its ball of radius 1, half of it: of two pieces one bit apart
the one with the bit unset asks. What meets is compared with the smallest and largest text of the bucket, so a giant family costs
its size; pairs within ``RADIUS`` bits go to the exact similarity, and linked texts become one component. Copies are folded first.

*An exact way for the rest.* No table of pieces holds all pairs of that similarity, so what SimHash leaves in different components
is searched by prefix filtering, which misses none: in any one order of all shingles, two such sets share a shingle among the
first fifth of each, at places that leave room for the overlap they owe. Shingles that many texts hold come last in the order, as
a sample of whole texts tells (any order finds the same pairs): a common passage brings nobody together, and of a large family of
edited texts only those meet whose own shingles, which come first, leave room for the overlap. Texts are compared with the most central holders of their shingles in other
components, and then all pairs of different components that still meet are compared. Of the components that meet at a shingle the
largest is never compared with itself. Only this last step can be large: where many texts hold the same shingles without being
near copies.

All pairs that meet are tested by two lower bounds on the shingles that differ (a 256-bit parity fingerprint, then counts in about
a quarter as many buckets as shingles, 1/32 of the set's bytes) and then by the exact similarity.

Spark takes a table to be as large as its files, and an exploded one as large as what it was made of: the 132 questions of a text
would count as one row and be broadcast. The joins of questions and of shared shingles are therefore told to shuffle and merge.

Defined results as in ``simhash``: texts without words are copies of each other, a text of one to four words has one
shingle, null ids take no part in the choice of the smallest id, extra columns are not read; ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normslice.functions.shared import remove, stored_at
from normslice.llm.common import components, held, stored, whole_ids
from normslice.llm.simhash import text_hash

SHINGLE = 5
SEED = 42
PARITY = [f"p{k}" for k in range(4)]
#: The words of the 256-bit SimHash, of two 32-bit pieces each.
PRINT = [f"f{k}" for k in range(4)]
#: Fingerprints further apart go no further: at the threshold 39 bits with a deviation of 6, unrelated texts 128.
RADIUS = 64
#: One text in so many is in the sample that lays out the order of shingles. Any sample gives the same groups.
SAMPLED = 16
#: So many shingles at most come last, those that most texts of the sample hold; a map of ``_MAP_BITS`` has room for more.
COMMON = 1 << 20
_MAP_BITS = 24
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_WORDS = 1 << 16
_HEADS = 4


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


class _WordHashes(dict):
    """XXH64 of a word, worked out once; emptied when it holds ``_WORDS`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word, SEED)
        return out


def shingles(words: list[bytes]) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending: a polynomial of the hashes of the words in order."""
    if not words:
        return np.zeros(0, np.int64)
    each = np.fromiter(map(held("word hashes", _WordHashes).__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = out * _MULTIPLIER + each[k : k + n]
    out = np.sort(out.view(np.int64))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


_SALTS = np.array([0, 0xD6E8FEB86659FD93, 0xA5A3564E27F8861B, 0x2545F4914F6CDD1D], np.uint64)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The 256-bit SimHash of a set of shingles, in four words: a bit is set where over half of the shingles have it."""
    ones = np.zeros(64 * len(_SALTS), np.int64)
    for at in range(0, len(hashes), 255):  # so many fit the counts of a byte
        x = hashes[at : at + 255].view(np.uint64)[:, None] ^ _SALTS
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)


def prefix(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first ``n - ceil(4 n / 5) + 1`` shingles in the order: those marked as common come last."""
    n = len(hashes)
    if not n:
        return hashes
    late = _marked(common, hashes)
    return np.concatenate((hashes[~late], hashes[late]))[: n - (4 * n + 4) // 5 + 1]


def _marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.view(np.uint64) >> np.uint64(64 - _MAP_BITS)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bucket_counts(hashes: np.ndarray) -> bytes:
    """Shingles by the low bits of their hash, a byte each (255: so many or more)."""
    size = 1 << max(4, (len(hashes) // 4).bit_length())
    return np.minimum(np.bincount(hashes & (size - 1), minlength=size), 255).astype(np.uint8).tobytes()


def counted_apart(x: bytes, y: bytes) -> int:
    """At most the number of shingles that only one of the texts has: bucket by bucket, the longer text's buckets folded."""
    u, v = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    size = min(len(u), len(v))
    return int(np.abs(u.reshape(-1, size).sum(0) - v.reshape(-1, size).sum(0)).sum())


def _bitmap(values: DataFrame, column: str) -> np.ndarray:
    """A map of 2 MB, whatever the number of values: set at the high bits of each. More may be set than asked for."""
    at = F.shiftrightunsigned(column, 64 - _MAP_BITS)
    words = values.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - _MAP_BITS}) & 63 as int))").alias("b"))
    out = np.zeros(1 << (_MAP_BITS - 6), np.int64)
    for r in words.groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        out[r["w"]] = r["b"]
    return out.view(np.uint64)


def _prints(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, counts, parity, prints = [], [], [], [], []
            for t in batch.column(1):
                words = words_of(t.as_py())
                keys.append(xxhash.xxh3_128_digest(b" ".join(words), SEED))
                h = shingles(words)
                sizes.append(len(h))
                counts.append(bucket_counts(h))
                parity.append(np.packbits((np.bincount(h & 255, minlength=256) & 1).astype(bool)).view(np.int64))
                prints.append(fingerprint(h))
            words = np.hstack([np.array(x, np.int64).reshape(-1, 4) for x in (parity, prints)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(counts, pa.binary()), *(pa.array(words[:, k]) for k in range(8))], ["doc_id", "text_hash", "key", "n", "counts", *PARITY, *PRINT])

    return texts.mapInArrow(run, "doc_id long, text_hash long, key binary, n long, counts binary, " + ", ".join(f"{p} long" for p in (*PARITY, *PRINT)))


def common_shingles(texts: DataFrame) -> DataFrame:
    """``token, held``: at most ``COMMON`` of the shingles that two texts or more of the sample hold, the most frequent ones.

    Whole texts are counted and not their prefixes: when the shingles of one prefix come last, others of the same texts take
    their places, and a large family would meet at those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(words_of(t.as_py())))], ["token"])

    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).select("text")
    counts = stored(sample.mapInArrow(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "common-shingles")
    least, total = 1 << 10, 0
    for held_by, tokens in sorted(counts.groupBy(F.least("held", F.lit(least))).count().collect(), reverse=True):
        total += tokens
        if total > COMMON:
            break
        least = held_by
    return counts.where(F.col("held") >= least)


def _prefixes(texts: DataFrame, common: np.ndarray) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                tokens, ids, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
                for i, t in zip(batch.column(0)[at : at + 64].to_pylist(), batch.column(1)[at : at + 64], strict=True):
                    p = prefix(shingles(words_of(t.as_py())), shared.value)
                    tokens.append(p)
                    ids.append(np.full(len(p), i, np.int64))
                    places.append(np.arange(len(p), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, ids, places)], ["token", "node", "place"])

    return texts.mapInArrow(run, "token long, node long, place int")


def _sets(texts: DataFrame, wanted: np.ndarray) -> DataFrame:
    """``node, hashes`` of the documents whose id is marked: the texts themselves are not shuffled."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_marked(shared.value, batch.column(2).to_numpy(zero_copy_only=False))))
            sets = [shingles(words_of(t.as_py())).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "hashes"])

    return texts.withColumn("_at", F.xxhash64("doc_id")).mapInArrow(run, "node long, hashes binary")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``pairs (a, b, ...)``, all columns long, of exact similarity 4/5 or more."""
    names = pairs.columns
    schema = ", ".join(f"{c} long" for c in names)

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = (batch.column(c).to_pylist() for c in ("na", "nb", "ca", "cb"))
            may = [9 * counted_apart(x, y) <= n + m for n, m, x, y in zip(*sides, strict=True)]
            yield batch.select(names).filter(pa.array(may, pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column("ha"), batch.column("hb"), strict=True):
                u, v = np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                near.append(9 * both >= 4 * (len(u) + len(v)))
            yield batch.select(names).filter(pa.array(near, pa.bool_()))

    sized = nodes.select("node", "n", "counts")
    pairs = pairs.join(sized.toDF("a", "na", "ca"), "a").join(sized.toDF("b", "nb", "cb"), "b").select(*names, "na", "nb", "ca", "cb")
    pairs = stored(pairs.mapInArrow(possible, schema), "pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    sets = _sets(texts, _bitmap(ends.select(F.xxhash64("node").alias("h")), "h"))
    left, right = sets.toDF("a", "ha"), sets.toDF("b", "hb")
    return pairs.join(left, "a").join(right, "b").select(*names, "ha", "hb").mapInArrow(run, schema)


def _bits_apart(x: str, y: str, words: list[str]) -> Column:
    return sum((F.bit_count(F.col(f"{x}.{w}").bitwiseXOR(F.col(f"{y}.{w}"))) for w in words), F.lit(0))


def _sizes_and_parity(x: str, y: str) -> Column:
    """Necessary for similarity 4/5: sizes and the parity bound."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * _bits_apart(x, y, PARITY) <= n + m)


def _may_be_near(x: str, y: str) -> Column:
    """Necessary for similarity 4/5 of texts that share a shingle: room for the overlap behind the shared place, too."""
    c = lambda side, name: F.col(f"{side}.{name}")
    room = 9 * F.least(c(x, "n") - c(x, "place"), c(y, "n") - c(y, "place")) >= 4 * (c(x, "n") + c(y, "n"))
    return room & _sizes_and_parity(x, y)


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """``a, b``: nodes within ``RADIUS`` bits that met in a bucket of pieces, each with its smallest and largest."""
    piece = lambda k: F.shiftrightunsigned(PRINT[k // 2], 32 * (k % 2)).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(k << 32))
    table = nodes.select("node", F.explode(F.array(*(piece(k) for k in range(2 * len(PRINT))))).alias("piece"))
    buckets = table.groupBy("piece").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    ball = F.array(*(F.lit(m).cast("long") for m in (0, *(1 << k for k in range(32)))))
    asks = table.select("node", "piece", F.explode(ball).alias("mask")).where("piece & mask = 0").select("node", F.col("piece").bitwiseXOR(F.col("mask")).alias("piece"))
    met = asks.hint("merge").join(buckets, "piece").select("node", F.explode(F.array("low", "high")).alias("other")).where("node <> other")
    met = met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    sized = nodes.select("node", "n", *PARITY, *PRINT)
    x, y = sized.alias("x"), sized.alias("y")
    met = met.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node"))
    return met.where(_sizes_and_parity("x", "y") & (_bits_apart("x", "y", PRINT) <= RADIUS)).select("a", "b")


def simhash_links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, ga, gb``: the pairs that SimHash finds and the exact similarity confirms, each node a group of its own."""
    return _verified(simhash_pairs(nodes), nodes, texts).select("a", "b", F.col("a").alias("ga"), F.col("b").alias("gb"))


def _relabelled(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """``rows`` with their ``group`` as ``merged (g, to)`` has it."""
    return rows.join(merged, F.col("group") == F.col("g"), "left").withColumn("group", F.coalesce("to", "group")).drop("g", "to")


def _merged(links: DataFrame) -> DataFrame:
    return components(links, "ga", "gb").toDF("g", "to")


def folded(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts of rows with an id, the prints of all rows, and a node for each different text: its smallest id."""
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    prints = stored(_prints(texts.withColumn("text_hash", text_hash())), "copy-prints")
    nodes = stored(prints.groupBy("key").agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in ("n", "counts", *PARITY, *PRINT))), "copy-nodes")
    return texts.where("doc_id is not null"), prints, nodes


def near_copies(documents: DataFrame) -> DataFrame:
    """``doc_id, text_hash, component_id`` for every row; documents linked by near copies share the smallest id."""
    whole_ids(documents)
    named, prints, nodes = folded(documents)
    known = nodes.where("node is not null")
    found = _merged(simhash_links(known, named))
    sized = _relabelled(known.select("node", "n", *PARITY, F.col("node").alias("group")), found)
    # from here on only texts of different components are compared
    rows, rows_path = stored_at(_prefixes(named, _bitmap(common_shingles(named), "token")), "prefixes")
    met = rows.groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("token")
    members, members_path = stored_at(rows.join(met, "token").join(sized, "node"), "members")
    remove(documents.sparkSession, rows_path)  # nothing reads the prefixes any more
    of_head = ("place", "node", "n", *PARITY, "group")
    central = [F.min(F.struct("place", F.xxhash64("node", F.lit(k)).alias("h"), *of_head[1:])).alias(f"h{k}") for k in range(_HEADS)]
    heads = members.groupBy("token").agg(*central).select("token", F.explode(F.array_distinct(F.array(*(F.struct(*(F.col(f"h{k}.{c}") for c in of_head)) for k in range(_HEADS))))).alias("h")).select("token", "h.*")
    pair = (F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), F.least("x.group", "y.group").alias("ga"), F.greatest("x.group", "y.group").alias("gb"))
    first = members.alias("x").hint("merge").join(heads.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.group") != F.col("y.group")) & _may_be_near("x", "y")).select(*pair).distinct()
    central_found = _merged(_verified(first, nodes, named))
    placed = _relabelled(members, central_found)
    shares = placed.groupBy("token", "group").agg(F.count(F.lit(1)).alias("share"))
    open_ = shares.groupBy("token").agg(F.max(F.struct("share", "group")).alias("top"), F.count(F.lit(1)).alias("groups")).where("groups > 1").select("token", F.col("top.group").alias("main"))
    rest = stored(placed.join(open_, "token").withColumn("main", F.col("group") == F.col("main")), "open")
    remove(documents.sparkSession, members_path)
    other = (F.col("x.token") == F.col("y.token")) & (F.col("x.group") != F.col("y.group")) & (F.col("y.main") | (F.col("x.node") < F.col("y.node")))
    second = rest.where("not main").alias("x").hint("merge").join(rest.alias("y"), other & _may_be_near("x", "y")).select(*pair).distinct()
    last_found = _merged(_verified(second, nodes, named))
    resolved = nodes.select("key", F.col("node").alias("group"))
    for merged in (found, central_found, last_found):
        resolved = _relabelled(resolved, merged)
    return prints.select("doc_id", "text_hash", "key").join(resolved.withColumnRenamed("group", "component_id"), "key").select("doc_id", "text_hash", "component_id")
