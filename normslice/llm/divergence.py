"""Source divergence audit: how far the word use of each source lies from the other sources of its language, in exact integers.

Each (language, source) group gives every kept term a share of a thousand million, ``p = 1 + floor(10^9 (n + 5) / (N + 5 V))``,
where absent terms have ``n = 0``, so a group's share ``z`` of an absent term is one number. The distance of two groups is the
sum of ``|p - q|`` over all kept terms; it is split by how many groups hold a term:

* if no term occurred, the distance would be ``V * |z_g - z_h|``; what follows is added to that;
* *heavy* terms, held by many groups, are dealt in blocks; each block meets each pair of group tiles as a dense numpy matrix;
* *light* terms are never laid out. A posting of one group alone moves the distance by ``|z_g - p| - |z_g - z_h|``, summed over a histogram of counts; a term that both hold is
  corrected by ``|p_g - p_h| - |z_g - p_h| - |p_g - z_h| + |z_g - z_h|``, over the few pairs of its posting list.

Both partial sums are whole numbers and are added exactly. Terms are counted inside the tasks that read the texts (tables of at
most ``HELD`` entries and one document), so a hot source sends one entry a term and task, not one an occurrence. A row has a term
with the entries of all sources that the task met, and rows are dealt by term once: the counts of a source and those of its
language come out of the same shuffle.

Defined results: null text, lang and source count as empty ones; every row is a document, also where ids are null or repeat
(ids are not read); a language without kept terms has distances of 0 and no term rows; a language of one source has no pairs;
equal values rank by the UTF-8 order of the item; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normslice.llm.common import stored

#: Entries that a counting task holds before it sends them on.
HELD = 1 << 18
#: Rows of a batch that it sends.
SENT = 1 << 13
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_GROUP = ["lang", "source"]
#: Groups on a side of a dense tile, and about as many terms in a block.
TILE = 64
BLOCK = 2048


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and of anything beyond ASCII; only A-Z are lower-cased."""
    return _TERM.findall((text or "").encode("utf-8", "replace").lower())


def _sent(groups: dict) -> Iterator[pa.RecordBatch]:
    """Counts by group as rows of a language's term, with an entry for each source."""
    of_lang: dict[str, list] = {}
    for (lang, source), (times, docs) in groups.items():
        of_lang.setdefault(lang, []).append((source, times, docs))
    for lang, own in of_lang.items():
        words = pa.array([w for _, times, _ in own for w in times], pa.binary()).cast(pa.string()).dictionary_encode()
        code, names = words.indices.to_numpy(), words.dictionary
        at = np.argsort(code, kind="stable")
        source = np.repeat(np.arange(len(own)), [len(times) for _, times, _ in own])[at]
        n = np.fromiter((k for _, times, _ in own for k in times.values()), np.int64, len(code))[at]
        df = np.fromiter((k for _, times, docs in own for k in map(docs.__getitem__, times)), np.int64, len(code))[at]
        entries = pa.StructArray.from_arrays([pa.array([x[0] for x in own], pa.string()).take(pa.array(source)), pa.array(n), pa.array(df)], ["source", "n", "docs"])
        ends = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(names)))]).astype(np.int32)
        rows = pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), names, pa.ListArray.from_arrays(ends, entries)], ["lang", "term", "entries"])
        for first in range(0, rows.num_rows, SENT):
            yield rows.slice(first, SENT)


def counted(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """``lang, term, entries`` of batches of ``lang, source, text``; a full table is sent on behind any document, also inside a batch."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            times, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            found = terms(text.as_py())
            size -= len(times)
            times.update(found)
            docs.update(set(found))
            size += len(times)
            if size > held:
                yield from _sent(groups)
                groups.clear()
                size = 0
    yield from _sent(groups)


def term_counts(documents: DataFrame, held: int = HELD) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and documents that hold the term. Rows are dealt by language and term."""
    rows = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in _GROUP), F.col("text").cast("string"))
    parts = rows.mapInArrow(lambda batches: counted(batches, held), "lang string, term string, entries array<struct<source: string, n: bigint, docs: bigint>>")
    dealt = parts.repartition("lang", "term").select("lang", "term", F.inline("entries"))
    return dealt.groupBy(*_GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str) -> Column:
    """The share of a term; counts are multiplied as decimals, which no corpus overflows."""
    return F.expr(f"1 + (1000000000BD * ({n} + 5)) div nullif({total} + 5 * v, 0)")


def _dense(key: tuple, rows: pa.Table, side: int) -> pa.Table:
    """What the terms of one block add to the distances of the groups of two tiles, beyond that of absent terms. Rows without a
    term carry a group's share of absent terms; terms that no group of the two tiles holds are not in the matrix and add nothing."""
    gid, share = (rows.column(c).to_numpy() for c in ("gid", "p"))
    words = rows.column("term").combine_chunks().dictionary_encode()
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    code = words.indices.fill_null(-1).to_numpy()
    groups = np.unique(gid)
    at = np.searchsorted(groups, gid)
    matrix = np.zeros((len(groups), max(1, len(words.dictionary))), np.int64)
    absent = np.zeros(len(groups), np.int64)
    absent[at[code < 0]] = share[code < 0]
    matrix[:] = absent[:, None]
    matrix[at[code >= 0], code[code >= 0]] = share[code >= 0]
    first, second = (np.flatnonzero(groups // side == key[k].as_py()) for k in (2, 3))
    left, right, value = [], [], []
    for g in first:
        other = second[second > g]
        left.append(np.full(len(other), groups[g]))
        right.append(groups[other])
        value.append((np.abs(matrix[other] - matrix[g]) - np.abs(absent[other] - absent[g])[:, None]).sum(1))
    columns = [pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)) for x in (left, right, value)]
    return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(columns[0]), pa.string()), *columns], ["lang", "a", "b", "value"])


def divergence(documents: DataFrame, *, least_docs: int = 30, top_terms: int = 50, light_share: int = 12, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` has the distance to every other source of the language, part
    ``term`` the ``top_terms`` terms that the source uses most beyond its language.

    A term is light if at most one in ``light_share`` groups of its language holds it, or at most four. Dense matrices hold
    ``tile`` groups a side and about ``block`` terms. Any of these numbers gives the same result.
    """
    by_term = Window.partitionBy("lang", "term")
    kept = (
        term_counts(documents)
        .select("*", F.sum("docs").over(by_term).alias("df"), F.count(F.lit(1)).over(by_term).alias("holders"), F.sum("n").over(by_term).alias("lang_n"), (F.row_number().over(by_term.orderBy("source")) == 1).alias("head"))
        .where(F.col("df") >= least_docs)
        .drop("docs", "df")
    )
    kept = stored(kept, "kept-terms")
    occurring = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in _GROUP)).distinct()
    numbered = occurring.select("*", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("gid"))
    sizes = numbered.groupBy("lang").agg(F.count(F.lit(1)).alias("groups"))
    light = F.col("holders") <= F.greatest(F.lit(4), F.floor(F.col("groups") / light_share))
    marked = kept.join(sizes, "lang").withColumn("light", light)
    langs = marked.where("head").groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"), F.count_if("light").alias("n_light"))
    totals = kept.groupBy(*_GROUP).agg(F.sum("n").alias("total"))
    wide = numbered.join(sizes, "lang").join(langs, "lang", "left").join(totals, _GROUP, "left")
    groups = stored(wide.select(*_GROUP, "gid", "groups", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("v", "lang_total", "n_light", "total"))).withColumn("z", F.coalesce(_share("0L", "total"), F.lit(0)).cast("long")), "term-groups")

    postings = kept.join(groups, _GROUP).withColumn("p", _share("n", "total")).withColumn("light", light)
    gain = postings.select(*_GROUP, F.col("term").alias("item"), (F.col("p") - _share("lang_n", "lang_total")).alias("value")).where("value > 0")
    best = Window.partitionBy(*_GROUP).orderBy(F.col("value").desc(), "item")
    terms_ = gain.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms).withColumn("part", F.lit("term"))

    pairs = _pairs(groups, postings, tile, block)
    names = groups.select("lang", "gid", "source")
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("gid"), F.col("b").alias("other")), F.struct(F.col("b").alias("gid"), F.col("a").alias("other")))).alias("x"), "value").select("lang", "x.*", "value")
    named = both.join(names, ["lang", "gid"]).join(names.toDF("lang", "other", "item"), ["lang", "other"]).select(*_GROUP, "item", "value")
    ranked = named.withColumn("rank", F.row_number().over(best)).withColumn("part", F.lit("pair"))
    order = [*_GROUP, "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")]
    return ranked.select(*order).unionByName(terms_.select(*order))


def _pairs(groups: DataFrame, postings: DataFrame, side: int, block: int) -> DataFrame:
    """``lang, a, b, value``: the distance of every two groups of a language (numbers ``a < b``)."""
    narrow = groups.select("lang", "gid", "z", "v")
    every = narrow.toDF("lang", "a", "za", "v").join(narrow.drop("v").toDF("lang", "b", "zb"), "lang").where("a < b")
    absent = every.select("lang", "a", "b", (F.col("v") * F.abs(F.col("za") - F.col("zb"))).alias("value"))

    rare = postings.where("light").select("lang", "term", "gid", "p", "z")
    counts = rare.groupBy("lang", "gid", "p").agg(F.count(F.lit(1)).alias("m"))
    one = []
    for here, there in (("a", "b"), ("b", "a")):  # postings of one group against the other's share of absent terms
        own = counts.withColumnRenamed("gid", here)
        moved = F.col("m") * (F.abs(F.col(f"z{there}") - F.col("p")) - F.abs(F.col("za") - F.col("zb")))
        one.append(every.join(own, ["lang", here]).groupBy("lang", "a", "b").agg(F.sum(moved).alias("value")))
    x, y = rare.toDF("lang", "term", "a", "pa", "za"), rare.toDF("lang", "term", "b", "pb", "zb")
    d = lambda u, v: F.abs(F.col(u) - F.col(v))
    shared = x.join(y, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(d("pa", "pb") - d("za", "pb") - d("pa", "zb") + d("za", "zb")).alias("value"))

    tile, tiles = F.floor(F.col("gid") / side), F.expr(f"sequence(0L, (groups - 1) div {side})")
    blocks = F.expr(f"(v - n_light + {block - 1}) div {block}")  # heavy terms, by hash
    common = postings.where("not light").select("lang", "groups", "gid", "term", "p", F.pmod(F.xxhash64("term"), blocks).alias("block"))
    zeros = groups.where("v > n_light").select("lang", "groups", "gid", F.lit(None).cast("string").alias("term"), F.col("z").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    laid = common.unionByName(zeros).withColumn("other", F.explode(tiles))
    keyed = laid.select("lang", "block", F.least(tile, "other").alias("ta"), F.greatest(tile, "other").alias("tb"), "gid", "term", F.col("p").cast("long").alias("p"))
    dense = keyed.groupBy("lang", "block", "ta", "tb").applyInArrow(lambda key, rows: _dense(key, rows, side), "lang string, a long, b long, value long")

    parts = absent
    for more in (*one, shared, dense):
        parts = parts.unionByName(more)
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
