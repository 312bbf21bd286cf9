"""SimHash near-duplicates by multi-index hashing.

Fingerprints are 64-bit SimHashes over word shingles. To link fingerprints that differ in at most ``radius`` bits, every
fingerprint is cut into ``segments`` pieces: by the pigeonhole principle a linked pair agrees in some piece up to
``radius // segments`` bits, so each fingerprint probes the small Hamming ball around each of its pieces in a table
of pieces, and fetched matches are verified on all 64 bits.

A table entry that holds more than ``bucket_limit`` fingerprints (one big family of near copies) would verify all pairs of
the family. Its members take an exact way of linear cost instead: two fingerprints differ in at most ``2 k`` bits exactly
if the full 64-bit balls of radius ``k`` around them meet, so each member is sent to the points of its ball, and those
that meet at a point are linked to the smallest there.

Copies are folded into their fingerprint before any of this, so a text repeated a million times costs one fingerprint.

Defined results: a null text is an empty text; texts without words have fingerprint 0 and are linked like any other;
null ids take no part in the choice of the smallest id (a group of null ids only has a null component); rows that repeat
an id are one document in the components, and each gives a result row; ids of any type are compared as their type orders them; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normslice.llm.common import components, fresh, id_type, stored

BITS = 64
SEED = 42
_BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash (unsigned): a bit is set where over half of the shingle hashes have it."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, blanks 0x20 and 0x09-0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(joined)]
    first = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, _BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + _BLOCK], last[at : at + _BLOCK], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, text_hash, fp`` (signed 64-bit) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], ["doc_id", "text_hash", "fp"])

    rows = documents.select("doc_id", text_hash().alias("text_hash"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id {id_type(documents)}, text_hash long, fp long")


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(width), k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(nodes: DataFrame, *, radius: int = 2, segments: int = 2, bucket_limit: int = 48) -> DataFrame:
    """Edges ``(a, b)`` of ``node`` ids whose fingerprints ``fp`` (distinct rows) differ in ``radius`` bits or fewer.

    Every linked pair outside overfull table entries is an edge; inside them the edges connect the same fingerprints.
    """
    if radius % 2 or not 0 < segments <= BITS or BITS % segments:
        raise ValueError("radius must be even and segments must divide 64")
    width = BITS // segments
    mask = (1 << width) - 1
    small = _ball(width, radius // segments)

    def piece(k: int) -> Column:
        return F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit(_signed(mask)))

    pieces = F.array(*(F.struct(F.lit(k).alias("seg"), piece(k).alias("value")) for k in range(segments)))
    table = nodes.select("node", "fp", F.inline(pieces))
    masks = F.array(*(F.lit(_signed(m)).cast("long") for m in small))
    probes = table.select("node", "fp", "seg", F.col("value").alias("own"), F.explode(masks).alias("mask")).select(
        "seg", F.col("own").bitwiseXOR(F.col("mask")).alias("value"), F.col("node").alias("p_node"), F.col("fp").alias("p_fp"), "mask", "own"
    )
    if radius // segments == 1:
        # of two pieces that differ in one bit only the one with the bit unset asks: half the probes, every pair still met
        probes = probes.where(F.col("own").bitwiseAND(F.col("mask")) == 0)
    probes = probes.drop("own")
    full = table.groupBy("seg", "value").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > bucket_limit).select("seg", "value", F.lit(True).alias("full"))
    full = stored(full, "full-buckets")
    if full.limit(1).count():
        table_full = table.join(full, ["seg", "value"], "left")
        probes_full = probes.join(full, ["seg", "value"], "left")
        crowd = (
            table_full.where("full").select("node", "fp")
            .union(probes_full.where("full").select("p_node", "p_fp"))
            .distinct()
        )
        table, probes = table_full.where("full is null").drop("full"), probes_full.where("full is null").drop("full")
        points = F.array(*(F.lit(_signed(m)).cast("long") for m in _ball(BITS, radius // 2)))
        met = crowd.select("node", F.explode(points).alias("mask"), "fp").select("node", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"))
        least = met.groupBy("point").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        crowd_edges = met.join(least, "point").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    else:
        crowd_edges = None
    found = (
        probes.join(table, ["seg", "value"])
        .where(((F.col("mask") != 0) | (F.col("p_node") < F.col("node"))) & (F.col("p_node") != F.col("node")))
        .where(_distance("fp", "p_fp") <= radius)
        .select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b"))
    )
    return found.union(crowd_edges) if crowd_edges is not None else found


def near_duplicates(documents: DataFrame, *, shingle: int = 3, radius: int = 2, segments: int = 2, bucket_limit: int = 48) -> DataFrame:
    """``doc_id, fingerprint (16 hex digits), component_id, text_hash`` for every row; linked documents share the smallest id."""
    prints = stored(fingerprints(documents, shingle), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "fp-nodes")
    joined = components(links(nodes.where("node is not null"), radius=radius, segments=segments, bucket_limit=bucket_limit), "a", "b")
    resolved = nodes.join(joined.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select(
        "fp", F.coalesce("component", "node").alias("component_id")
    )
    return prints.join(resolved, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash")


def drop_near_duplicates(documents: DataFrame, **parameters) -> DataFrame:
    """The rows of ``documents`` without all but the smallest id of each group; rows of null id stay."""
    return keep_smallest(documents, near_duplicates(documents, **parameters))


def text_hash() -> Column:
    """What tells the texts of rows that repeat an id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def keep_smallest(documents: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose id is the ``component_id`` of their group in ``marks (doc_id, text_hash, component_id)``.

    Every row is judged by its own text: of rows that repeat an id with different texts, each stays or goes with the group of
    its text. Of repeated rows of one id and text that stays, one stays; rows of null id stay. Only the ids and hashes of
    rows that go are joined to the texts.
    """
    from pyspark.sql import Window

    gone, other, own, row = (fresh(documents.columns, n) for n in ("_gone", "_other", "_own", "_row"))
    goes = marks.where("doc_id <> component_id").select(F.col("doc_id").alias(gone), F.col("text_hash").alias(other)).distinct()
    kept = documents.withColumn(own, text_hash()).join(goes, (F.col("doc_id") == F.col(gone)) & (F.col(own) == F.col(other)), "left_anti")
    again = marks.where("doc_id = component_id").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if not again:
        return kept.drop(own)
    order = Window.partitionBy("doc_id", own).orderBy(own)
    ranked = kept.where("doc_id is not null").withColumn(row, F.row_number().over(order)).where(F.col(row) == 1).drop(row)
    return ranked.unionByName(kept.where("doc_id is null")).drop(own)
