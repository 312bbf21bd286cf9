"""Language identification by rank-order profiles.

A language's profile lists its most frequent letter n-grams in order, learnt from labelled documents. A document's own list is
compared to each profile by the out-of-place distance: for each n-gram of the document the difference of its ranks, or
``PROFILE`` if the language does not list it. The language of least distance wins (ties: first in the alphabet).

Words are runs of letters in lower case, framed by blanks; n-grams have 1 to 3 characters.

Defined results: a null text or one without a letter is ``und`` with score 0; texts of any length are counted whole; with
nothing to learn from every text is ``und``; of rows that repeat an id each teaches its own text under its own language; null ids are carried; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normslice.llm.common import class_shares, crc_bucket, id_type, stored, under_share

ALNUM = re.compile(r"[^\W\d_]+")
PROFILE = 400
MAX_LANGUAGES = 5_000
#: Words that are counted at once; a longer text is counted in parts that are summed.
_PART = 100_000
_SPACE = 32


def gram_code(gram: str) -> int:
    """Up to three characters as one integer; integers sort like the texts."""
    return sum(ord(c) << 21 * (2 - i) for i, c in enumerate(gram))


def gram_text(code: int) -> str:
    return "".join(chr(code >> 21 * (2 - i) & 0x1FFFFF) for i in range(3)).rstrip("\0")


def words_of(text: str | None) -> list[str]:
    """Runs of letters (general category L) in lower case."""
    words = ALNUM.findall((text or "").lower())
    if "".join(words).isalpha():
        return words
    return [run for w in words for run in "".join(c if c.isalpha() else " " for c in w).split()]  # fractions, circled digits and the like are no letters


def _counted(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the 1- to 3-grams of words that are framed by blanks."""
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    pairs = c[:-1] << 42 | c[1:] << 21
    triples = (pairs[:-1] | c[2:])[c[1:-1] != _SPACE]
    return np.unique(np.concatenate((c[c != _SPACE] << 42, pairs, triples)), return_counts=True)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of a whole text; empty without a letter."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes, counts = _counted(words[:_PART])
    for at in range(_PART, len(words), _PART):
        more, n = _counted(words[at : at + _PART])
        codes, where = np.unique(np.concatenate((codes, more)), return_inverse=True)
        counts = np.bincount(where, weights=np.concatenate((counts, n))).astype(np.int64)
    return codes, counts


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The codes of the most frequent n-grams, ties in character order."""
    if len(codes) > size:
        keep = counts >= np.partition(counts, -size)[-size]
        codes, counts = codes[keep], counts[keep]
    return codes[np.argsort(-counts, kind="stable")[:size]]  # codes come sorted


def fit(documents: DataFrame, *, held_out_mod: int = 4, held_out_rest: int = 2, max_per_language: int = 2_000) -> dict[str, list[int]]:
    """A profile (gram codes in order of rank) for each language, from about ``max_per_language`` documents of it (ids of smallest hash).

    Counts are summed on the shuffle; ``PROFILE`` n-grams of each language reach the driver, for ``MAX_LANGUAGES`` at most: a
    column of more values is refused as no language.
    """
    usable = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc_bucket(F.col("doc_id"), held_out_mod) != held_out_rest))
    # written first, so Spark knows its few rows when it plans the join and leaves the texts where they lie
    shares = stored(class_shares(usable, "lang", max_per_language), "shares")
    train = usable.select("doc_id", "lang", F.col("text").cast("string").alias("text")).join(shares, "lang").where(under_share("doc_id")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes, counts = gram_counts(text.as_py())
                total.setdefault(lang, Counter()).update(dict(zip(codes.tolist(), counts.tolist(), strict=True)))
            for lang, grams in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(list(grams), pa.int64()), pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])

    counts = train.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), F.col("gram"))
    ranked_grams = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE)
    rows = ranked_grams.limit(MAX_LANGUAGES * PROFILE + 1).collect()
    if len(rows) > MAX_LANGUAGES * PROFILE:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    profiles: dict[str, list[tuple[int, int]]] = {}
    for r in rows:
        profiles.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return {lang: [g for _, g in sorted(p)] for lang, p in profiles.items()}


def tables(profiles: dict[str, list[int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, all n-grams of their profiles, and the rank of each n-gram in each profile (-1: not listed; last row: in none)."""
    languages = sorted(profiles)
    grams = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
    ranks = np.full((len(grams) + 1, len(languages)), -1, np.int32)
    for i, lang in enumerate(languages):
        ranks[np.searchsorted(grams, np.array(profiles[lang], np.int64)), i] = np.arange(len(profiles[lang]))
    return languages, grams, ranks


def judge(text: str | None, names: list[str], known: np.ndarray, table: np.ndarray) -> tuple[str, float]:
    """The language of least out-of-place distance, and how much closer it is than the farthest possible list."""
    own = ranked(*gram_counts(text))
    if not len(own) or not names:
        return "und", 0.0
    row = np.minimum(np.searchsorted(known, own), len(known) - 1)
    theirs = table[np.where(known[row] == own, row, len(known))]
    distance = np.where(theirs < 0, PROFILE, np.abs(theirs - np.arange(len(own))[:, None])).sum(0)
    best = int(distance.argmin())
    return names[best], 1.0 - float(distance[best]) / (PROFILE * len(own))


def identify(documents: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """``doc_id, lang_pred, score``."""
    shared = documents.sparkSession.sparkContext.broadcast(tables(profiles))  # PROFILE n-grams of MAX_LANGUAGES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(t.as_py(), *shared.value) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {id_type(documents)}, lang_pred string, score double")


def language_id(documents: DataFrame, **parameters) -> DataFrame:
    """Learn the profiles from documents that are not held out, then judge every text: ``doc_id, held_out, lang_pred, score``."""
    found = identify(documents, fit(documents, **parameters))
    return found.select("doc_id", (crc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
