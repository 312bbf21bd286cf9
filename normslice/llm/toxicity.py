"""Toxicity by maximum-scoring segments of token log-odds, calibrated with extreme-value statistics.

1. ``fit``: the numbers of toxic and clean labelled documents that hold a word give it a log-odds under a two-level Dirichlet
   prior: a word is shrunk to its stem (first letters), a stem to the global rate. Rare and unseen words so borrow
   from their stem.
2. ``segments``: over the scores of a whole text, in which a positive word counts once in ``REPEAT`` + 1 words, the linear-time all-maximal-segments scan finds every disjoint passage
   of maximal score; an E-value from Karlin-Altschul statistics (lambda from the word
   tokens of clean training documents, K from their maxima) tells which passages are significant.
3. ``score``: a logistic link over the extreme-value statistics of the document's passages, fitted on the training rows.

Defined results: a null or wordless text has no passage and gets the score of an empty text (intercept only); repeated
rows are scored alike; a label other than 0 or 1 and null ids are ignored in training; with no labelled rows of one
of the classes every score is 0; ids keep their type. Clashing extra columns of the input are never read.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normslice.llm.common import crc_bucket, held, id_type, sampled_ids, stored

WORDS = re.compile(r"[^\W_]+")
STEM = 6
#: A positive word counts again only more than this many words after it last counted.
REPEAT = 8


@dataclass(frozen=True)
class ToxicityModel:
    """Word and stem scores (drift already taken off), Karlin-Altschul parameters and the logistic link."""

    words: dict[str, float]
    stems: dict[str, float]
    default: float
    lam: float
    log_k: float
    link: tuple[float, ...]

    def scores(self, text: str | None) -> np.ndarray:
        words, stems, default = self.words, self.stems, self.default
        found = WORDS.findall((text or "").lower())
        out = np.fromiter(
            (words[w] if w in words else stems.get(w[:STEM], default) for w in found), float, len(found)
        )
        last: dict[str, int] = {}
        for i in np.flatnonzero(out > 0).tolist():  # a word said again at once adds nothing to its passage
            if i - last.get(found[i], -REPEAT - 1) <= REPEAT:
                out[i] = 0.0
            else:
                last[found[i]] = i
        return out

    def e_value(self, segment_score: float, n_tokens: int) -> float:
        return math.exp(min(50.0, self.log_k + math.log(max(n_tokens, 1)) - self.lam * segment_score))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)`` of a score sequence, disjoint, in linear time.

    Candidates are kept on a list with the prefix sums left and right of each; a new positive item merges with the last
    candidate that starts lower as long as it ends lower too. Only positive items start work, so a long text costs one
    cumulative sum and a step for each positive word.
    """
    if not len(scores):
        return []
    prefix = np.concatenate(([0.0], np.cumsum(scores)))
    kept: list[list[float]] = []  # [start, end, prefix before, prefix after, index of the last candidate starting lower]
    for i in np.flatnonzero(scores > 0):
        item = [i, i + 1, prefix[i], prefix[i + 1], 0]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= item[2]:
                j = int(kept[j][4])
            item[4] = j
            if j < 0 or kept[j][3] >= item[3]:
                kept.append(item)
                break
            item = [kept[j][0], item[1], kept[j][2], item[3], kept[j][4]]
            del kept[j:]
    return [(int(a), int(b), float(r - lo)) for a, b, lo, r, _ in kept]


def _features(model: ToxicityModel, scores: np.ndarray, alpha: float) -> tuple[np.ndarray, int, int]:
    """What the link sees: the best passage's calibrated score, its raw score, the excess of all significant ones."""
    n = len(scores)
    segments = maximal_segments(scores)
    best = max((s for _, _, s in segments), default=0.0)
    significant = [(a, b, s) for a, b, s in segments if model.e_value(s, n) <= alpha]
    excess = sum(model.lam * s - model.log_k - math.log(max(n, 1)) for _, _, s in significant)
    calibrated = model.lam * best - model.log_k - math.log(max(n, 1)) if segments else 0.0
    covered = sum(b - a for a, b, _ in significant)
    return np.array([1.0, min(calibrated, 60.0), min(model.lam * best, 60.0), math.log1p(max(excess, 0.0))]), len(significant), covered


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of each class hold a word, and how often, in this partition; flushed when the table grows large."""
    counts: dict[tuple[str, int], list[int]] = {}

    def flush() -> pa.RecordBatch:
        items = list(counts.items())
        counts.clear()
        columns = [[k[0] for k, _ in items], [k[1] for k, _ in items], [v[0] for _, v in items], [v[1] for _, v in items]]
        types = (pa.string(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["word", "toxic", "n", "m"])

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
            label = toxic.as_py()
            for word, times in Counter(WORDS.findall((text.as_py() or "").lower())).items():  # a word that one text repeats is one witness
                own = counts.setdefault((word, label), [0, 0])
                own[0] += 1
                own[1] += times
            if len(counts) > 200_000:
                yield flush()
    yield flush()


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def _karlin_lambda(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1 by bisection (mean score is negative, some score is positive)."""
    weights = weights / weights.sum()
    if scores.max() <= 0 or float(scores @ weights) >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    value = lambda x: float(weights @ np.exp(np.minimum(x * scores, 700.0))) - 1.0
    while value(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return (low + high) / 2


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps on the bounded training sample."""
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        gradient = x.T @ (y - p) - penalty @ beta
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def fit(
    documents: DataFrame,
    labels: DataFrame,
    *,
    held_out_mod: int = 5,
    held_out_rest: int = 0,
    max_per_class: int = 8_000,
    stem_prior: float = 10.0,
    word_prior: float = 6.0,
    drift: float = 0.75,
    alpha: float = 0.05,
) -> ToxicityModel:
    """Learn from about ``max_per_class`` labelled rows of each class (bounded sample, ids of smallest hash).

    Rows with ``crc32(id) mod held_out_mod == held_out_rest`` are never learnt from. What reaches the driver are the words and
    stems of the sampled texts, all of them, and four features for each sampled row.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & (crc_bucket(F.col("doc_id"), held_out_mod) != held_out_rest))
    ids = sampled_ids(usable.groupBy(F.col("doc_id").cast(id_type(documents)).alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")), "doc_id", "toxic", max_per_class)
    train = stored(documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select("text", "toxic"), "toxicity")  # two classes
    counts = train.mapInArrow(_counts, "word string, toxic int, n long, m long")
    of = lambda label, column: F.sum(F.when(F.col("toxic") == label, F.col(column)).otherwise(0))
    table = stored(counts.groupBy("word").agg(of(1, "n").alias("t"), of(0, "n").alias("c"), of(0, "m").alias("tokens")), "words")
    alone = F.col("t") + F.col("c") < 2  # a word of one text scores as its stem
    by_stem = table.groupBy(F.substring("word", 1, STEM).alias("stem")).agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum(F.when(alone, F.col("tokens")).otherwise(0)).alias("tokens")).collect()
    toxic, clean = sum(r["t"] for r in by_stem), sum(r["c"] for r in by_stem)
    if not toxic or not clean:
        return ToxicityModel({}, {}, -drift, 1.0, 0.0, (-50.0, 0.0, 0.0, 0.0))
    base = toxic / (toxic + clean)
    by_word = table.where(~alone).collect()
    rate_of = {r["stem"]: (r["t"] + stem_prior * base) / (r["t"] + r["c"] + stem_prior) for r in by_stem}
    shift = _logit(base) + drift
    stem_scores = {s: _logit(p) - shift for s, p in rate_of.items()}
    word_scores = {r["word"]: _logit((r["t"] + word_prior * rate_of[r["word"][:STEM]]) / (r["t"] + r["c"] + word_prior)) - shift for r in by_word}
    # the null: tokens of clean texts, each by the score that it has in a scan
    null = [(word_scores[r["word"]], r["tokens"]) for r in by_word if r["tokens"]] + [(stem_scores[r["stem"]], r["tokens"]) for r in by_stem if r["tokens"]]
    values, weights = np.array([x for x, _ in null]), np.array([n for _, n in null], float)
    # it must have some positive score: clean words above the drift, or one pseudo-count of the most toxic word or stem
    values, weights = np.append(values, max([*word_scores.values(), *stem_scores.values()])), np.append(weights, 1.0)
    draft = ToxicityModel(word_scores, stem_scores, -drift, _karlin_lambda(values, weights), 0.0, (0.0,) * 4)
    maxima = _over_sample(train.where("toxic = 0"), draft, lambda m, scores: [float(len(scores)), max((s for _, _, s in maximal_segments(scores)), default=0.0)])
    # a Gumbel maximum has mean (ln(K n) + Euler's constant) / lambda: K by moments over the clean rows
    seen = [(n, best) for _, (n, best) in maxima if n and best > 0]
    log_k = float(np.mean([draft.lam * best - math.log(n) for n, best in seen])) - 0.5772156649 if seen else 0.0
    model = replace(draft, log_k=log_k)
    sample = _over_sample(train, model, lambda m, scores: _features(m, scores, alpha)[0].tolist())
    return replace(model, link=_logistic(np.array([x for _, x in sample]), np.array([y for y, _ in sample], float)))


def _over_sample(train: DataFrame, model: ToxicityModel, measure: Callable[[ToxicityModel, np.ndarray], list[float]]) -> list[tuple[int, list[float]]]:
    """``(toxic, measures)`` of every sampled row; the sample is bounded, and so is what comes to the driver."""
    shared = train.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(shared.value, shared.value.scores(t.as_py())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "x"])

    return [(r["toxic"], r["x"]) for r in train.mapInArrow(run, "toxic int, x array<double>").collect()]


def score(documents: DataFrame, model: ToxicityModel, *, alpha: float = 0.05, passages: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, score, predicted, n_passages, toxic_tokens`` (``passages``: with their token spans)."""
    shared, key = documents.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    schema = f"doc_id {id_type(documents)}, score double, predicted int, n_passages int, toxic_tokens int"
    schema += ", passages array<struct<start:int,end:int,score:double,e_value:double>>" if passages else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held(key, lambda: shared.value)
        link = np.array(m.link)
        for batch in batches:
            out = []
            for text in batch.column(1):
                scores = m.scores(text.as_py())
                x, n_sig, covered = _features(m, scores, alpha)
                p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(x @ link)))))
                row = [p, int(p >= 0.5), n_sig, covered]
                if passages:
                    row.append([{"start": a, "end": b, "score": s, "e_value": m.e_value(s, len(scores))} for a, b, s in maximal_segments(scores) if m.e_value(s, len(scores)) <= alpha])
                out.append(row)
            types = [pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            names = ["score", "predicted", "n_passages", "toxic_tokens"]
            if passages:
                types.append(pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())])))
                names.append("passages")
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], t) for i, t in enumerate(types))], ["doc_id", *names])

    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def drop_toxic(documents: DataFrame, model: ToxicityModel, *, alpha: float = 0.05) -> DataFrame:
    """The documents without those scored 0.5 or more, all columns kept; decided in place, so no row is shuffled."""
    shared, key = documents.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held(key, lambda: shared.value)
        link = np.array(m.link)
        for batch in batches:
            yield batch.filter(pa.array([float(_features(m, m.scores(t.as_py()), alpha)[0] @ link) < 0 for t in batch.column(at)], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def toxicity(documents: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """Fit on the labelled rows that are not held out, then score every whole text.

    Columns: ``doc_id, held_out, score, predicted, n_passages, toxic_tokens``.
    """
    scored = score(documents, fit(documents, labels, **parameters))
    return scored.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "n_passages", "toxic_tokens")
