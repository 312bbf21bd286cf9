"""MinHash near-duplicates with sequential Bayesian verification.

Every text becomes its set of five-word shingles (64-bit hashes) and a signature of ``HASHES`` minima. Texts of equal sets are
folded. Signatures are cut into bands; sets that agree in a band are candidates. At similarity 0.85 a pair shares no band of 4 in 32 with
probability 6e-11. Candidates are verified in sequence: signatures are compared 16 minima at a time, and after each batch a
pair is dropped if, given its matches so far and a uniform prior, the probability that its similarity reaches the threshold
is below ``miss``. For ``m`` matches in ``n`` that probability is the binomial tail ``P(Bin(n + 1, t) <= m)``, so the least
numbers of matches are worked out once in whole numbers. Pairs that survive are confirmed on their full sets.

A family of near copies is not compared pair by pair. In the first round each member of a band's bucket is compared with two
heads: the member that meets most others over all its bands (the original of a family of edited copies) and one by hash.
Linked sets become one component. In the second round sets of different components that still share a bucket are
compared, except for pairs within the largest component at the bucket. No bucket is capped and no pair of different components is left out.
Only sets that meet another one carry their signature beyond the folding.
Members carry their set's size and the parities of its hashes in 512 classes: as many shingles differ as parities do, so
the join itself passes over most pairs of a family that lie below the threshold, and none above it.

Defined results: a null text is an empty one; texts without words have an empty set, are linked with nothing and keep their
own id as component; each row is judged by its own text, so rows that repeat an id with other texts can lie in different
components; null ids take no part in the choice of the smallest id, and a group of null ids only has a null component and is
kept; ids of any type are compared as their type orders them; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normslice.functions.shared import remove, stored_at
from normslice.llm.common import components, id_type, stored
from normslice.llm.near_copies import shingles, words_of

HASHES = 128
BAND = 4
BATCH = 16
SEED = 42
_CHUNK = 2048
_PARITY = [f"p{k}" for k in range(8)]
_draw = np.random.default_rng(SEED)
_FACTORS = _draw.integers(0, 1 << 63, HASHES, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_ADDENDS = _draw.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minima of a set of shingle hashes under ``HASHES`` random maps, 32 bits each."""
    least = np.full(HASHES, (1 << 64) - 1, np.uint64)
    values = hashes.view(np.uint64)
    for at in range(0, len(values), _CHUNK):
        mixed = values[at : at + _CHUNK, None] * _FACTORS + _ADDENDS
        np.minimum(least, mixed.min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


@lru_cache(maxsize=16)
def least_matches(percent: int, miss: float) -> tuple[int, ...]:
    """For 16, 32, ... compared minima: the matches that a pair needs, so that the posterior chance of a similarity of
    ``percent`` or more is ``miss`` at least."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0, -1
        while total < miss * 100 ** (n + 1):  # whole numbers: the tail times 100^(n + 1)
            m += 1
            total += comb(n + 1, m) * percent**m * (100 - percent) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def may_be_near(left: np.ndarray, right: np.ndarray, percent: int, miss: float) -> np.ndarray:
    """Pairs of signatures (rows) that no batch has ruled out."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    for k, needed in enumerate(least_matches(percent, miss)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (left[alive, part] == right[alive, part]).sum(1)
        stay = matches >= needed
        alive, matches = alive[stay], matches[stay]
    out = np.zeros(len(left), bool)
    out[alive] = True
    return out


def prints(documents: DataFrame) -> DataFrame:
    """``doc_id, mark, key, n_shingles, signature`` for every row: equal keys are equal sets, null without words; ``mark`` tells rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, marks, odd = [], [], [], []
            for text in batch.column(2):
                h = shingles(words_of(text.as_py()))
                sizes.append(len(h))
                keys.append(xxhash.xxh3_128_digest(h.tobytes(), SEED) if len(h) else None)
                marks.append(signature(h).tobytes() if len(h) else None)
                odd.append(np.packbits((np.bincount(h & 511, minlength=512) & 1).astype(bool)).view(np.int64))
            columns = [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary())]
            columns += [pa.array(c) for c in np.array(odd, np.int64).reshape(-1, len(_PARITY)).T]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "key", "n_shingles", "signature", *_PARITY])

    schema = f"doc_id {id_type(documents)}, mark long, key binary, n_shingles long, signature binary, " + ", ".join(f"{p} long" for p in _PARITY)
    return _marked_texts(documents).mapInArrow(run, schema)


def _marked_texts(documents: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return documents.select("doc_id", F.xxhash64("doc_id", text).alias("mark"), text.alias("text"))


def _room(percent: int) -> Column:
    """Necessary for the similarity of members ``x`` and ``y``: sizes, and no more differing parities than shingles may differ."""
    n, m = F.col("x.n_shingles"), F.col("y.n_shingles")
    differ = sum((F.bit_count(F.col(f"x.{p}").bitwiseXOR(F.col(f"y.{p}"))) for p in _PARITY), F.lit(0))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * differ <= (100 - percent) * (n + m))


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int, miss: float) -> DataFrame:
    """The rows of ``pairs (a, b, ...)`` whose sizes allow the similarity and that the signatures do not rule out."""
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sa", "sb"))
            yield batch.select(names).filter(pa.array(may_be_near(left, right, percent, miss), pa.bool_()))

    sized = nodes.select("key", "n_shingles", "signature")
    both = pairs.join(sized.toDF("a", "na", "sa"), "a").join(sized.toDF("b", "nb", "sb"), "b")
    both = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select(*names, "sa", "sb")
    return both.mapInArrow(run, pairs.schema)


def _bit_map(values: DataFrame, column: str) -> tuple[int, np.ndarray]:
    """Bits set at the high bits of each hash: 16 bits a value, 8 MB at most. Beyond four million values more is let through, which changes no result."""
    bits = min(26, max(12, (16 * values.count()).bit_length()))
    at = F.shiftrightunsigned(column, 64 - bits)
    words = values.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int))").alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return bits, out.view(np.uint64)


def _confirmed(pairs: DataFrame, nodes: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs (a, b, ...)`` whose full sets have the similarity. Sets are made again from the texts of the pairs'
    keys only, where the texts lie; no text is shuffled."""
    names = pairs.columns
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    bits, wanted = _bit_map(nodes.join(ends, "key", "left_semi").select("holder"), "holder")
    shared = documents.sparkSession.sparkContext.broadcast(wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(1).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            batch = batch.filter(pa.array((shared.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1))
            each = [shingles(words_of(t.as_py())).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(h, SEED) for h in each], pa.binary()), pa.array(each, pa.binary())], ["key", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column("ha"), batch.column("hb"), strict=True):
                u, v = np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                near.append(100 * both >= percent * (len(u) + len(v) - both))
            yield batch.select(names).filter(pa.array(near, pa.bool_()))

    found = _marked_texts(documents).mapInArrow(sets, "key binary, hashes binary").join(ends, "key", "left_semi").dropDuplicates(["key"])
    found = stored(found, "near-sets")
    return pairs.join(found.toDF("a", "ha"), "a").join(found.toDF("b", "hb"), "b").select(*names, "ha", "hb").mapInArrow(run, pairs.schema)


def _met(nodes: DataFrame) -> DataFrame:
    """``bucket, key, held``: the members of band buckets of two sets or more. Most sets meet none, so entries travel as bucket and
    key only; signatures, sizes and parities are joined to the members that are left."""
    width = 4 * BAND
    bands = F.array(*(F.xxhash64(F.lit(k), F.substring("signature", k * width + 1, width)) for k in range(HASHES // BAND)))
    entries = nodes.select("key", F.explode(bands).alias("bucket"))
    met = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    return stored(entries.join(met, "bucket"), "met-buckets")


def near_duplicates(documents: DataFrame, *, percent: int = 85, miss: float = 1e-9) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row; documents linked at ``percent`` similarity share the smallest id."""
    spark = documents.sparkSession
    full, full_path = stored_at(prints(documents), "minhash-prints")
    worded = full.where("key is not null")
    nodes = worded.groupBy("key").agg(F.min("doc_id").alias("least"), F.min("mark").alias("holder"), *(F.first(c).alias(c) for c in ("n_shingles", "signature", *_PARITY)))
    nodes, node_path = stored_at(nodes, "minhash-nodes")
    rows = stored(full.select("doc_id", "n_shingles", "key"), "minhash-rows")
    remove(spark, full_path)

    entries = _met(nodes)
    near = stored(nodes.drop("least").join(entries.groupBy("key").agg(F.sum("held").alias("weight")), "key"), "band-nodes")
    smallest = stored(nodes.select("key", "least"), "minhash-least")
    remove(spark, node_path)
    members = stored(entries.join(near.select("key", "weight", "n_shingles", *_PARITY), "key").drop("held"), "band-members")
    central = (F.max(F.struct("weight", "key")).alias("most"), F.min(F.struct(F.xxhash64("key").alias("h"), "key")).alias("any"))
    heads = members.groupBy("bucket").agg(*central).select("bucket", F.explode(F.array_distinct(F.array("most.key", "any.key"))).alias("key"))
    heads = heads.join(near.select("key", "n_shingles", *_PARITY), "key")
    members = members.drop("weight")
    least, greatest = (lambda c, f=f: f("x." + c, "y." + c) for f in (F.least, F.greatest))
    met = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.key") != F.col("y.key")) & _room(percent)
    first = members.alias("x").join(heads.alias("y"), met).select(least("key").alias("a"), greatest("key").alias("b")).distinct()
    first = stored(_possible(first, near, percent, miss), "near-pairs")
    linked = components(_confirmed(first, near, documents, percent), "a", "b").toDF("key", "linked")

    group = F.coalesce("linked", "key").alias("group")
    placed = members.join(linked, "key", "left").select(*members.columns, group)
    shares = placed.groupBy("bucket", "group").agg(F.count(F.lit(1)).alias("share"))
    open_ = shares.groupBy("bucket").agg(F.max(F.struct("share", "group")).alias("top"), F.count(F.lit(1)).alias("groups")).where("groups > 1").select("bucket", F.col("top.group").alias("main"))
    rest = stored(placed.join(open_, "bucket").select(*members.columns, "group", (F.col("group") == F.col("main")).alias("main")), "open-buckets")
    other = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.group") != F.col("y.group")) & (F.col("y.main") | (F.col("x.key") < F.col("y.key")))
    second = rest.where("not main").alias("x").join(rest.alias("y"), other & _room(percent)).select(least("key").alias("a"), greatest("key").alias("b"), least("group").alias("ga"), greatest("group").alias("gb")).distinct()
    second = stored(_possible(second, near, percent, miss), "near-pairs")
    merged = components(_confirmed(second, near, documents, percent), "ga", "gb").toDF("group", "merged")

    of_key = smallest.join(linked, "key", "left").select("key", "least", group).join(merged, "group", "left").select("key", "least", F.coalesce("merged", "group").alias("component"))
    of_key = stored(of_key, "near-components")
    ids = of_key.groupBy("component").agg(F.min("least").alias("component_id"))
    resolved = of_key.join(ids, "component").select("key", "component_id")
    alone = rows.where("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = rows.where("key is not null").join(resolved, "key").select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
