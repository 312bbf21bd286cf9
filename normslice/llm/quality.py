"""Quality by hierarchical empirical Bayes over sites.

1. A document classifier (logistic over text statistics, fitted on a bounded sample of labelled rows) gives each document's
   probability of good quality.
2. Sites: what is believed of each document (its label where it may be learnt from, else the classifier's evidence) is summed
   over paths and, from these, over hosts. Priors are fitted by moments over all groups: the spread of host means
   beyond what their sizes explain sets how strongly a host is shrunk to the global mean; the spread of path means within
   hosts sets how strongly a path is shrunk to its host. Sparse sites so fall back to what is known above them.
3. The document's log-odds are moved by how far its path's posterior lies from the global mean. Its own belief is taken out of
   its path and host first, so it does not count twice.

Only grouped sums travel: a host with a third of all rows is folded before the shuffle, and its rows meet the posteriors
in a join that adaptive execution can split.

Defined results: null and empty texts have the statistics of an empty text; a null host or path is the empty name; rows
repeating an id have that id's label in common, whatever their texts; labels other than 0 and 1 are ignored; with no labels of one class the classifier
says 0.5; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normslice.llm.common import crc_bucket, id_type, sampled_ids, stored

_WORDS = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"\d")
_ODD = re.compile(r"[^\w\s.,;:!?'\"()-]")
N_FEATURES = 12


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text, by the same rules at every length (digits are decimal digits of any script)."""
    text = text or ""
    n = max(len(text), 1)
    words = _WORDS.findall(text)
    m = max(len(words), 1)
    lower = Counter(w.lower() for w in words)
    lines = [x for x in text.split("\n") if x.strip()]
    distinct_lines = len(set(lines))
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    return [
        1.0,
        math.log1p(len(words)),
        len(lower) / m,
        max(lower.values(), default=0) / m,
        sum(map(len, words)) / m / 10,
        upper / m,
        len(_ODD.findall(text)) / n * 10,
        len(_DIGIT.findall(text)) / n * 10,
        1 - distinct_lines / max(len(lines), 1),
        math.log1p(n / max(len(lines), 1)) / 10,
        text.count(".") / m * 5,
        text.count("!") / m * 5,
    ]


@dataclass(frozen=True)
class Classifier:
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]


def fit(documents: DataFrame, labels: DataFrame, *, held_out_mod: int = 5, held_out_rest: int = 0, max_per_class: int = 8_000, ridge: float = 1.0) -> Classifier:
    """Logistic regression on about ``max_per_class`` labelled rows of each class (ids of smallest hash)."""
    usable = labels.where(F.col("quality").isin(0, 1) & (crc_bucket(F.col("doc_id"), held_out_mod) != held_out_rest))
    ids = sampled_ids(usable.groupBy(F.col("doc_id").cast(id_type(documents)).alias("doc_id")).agg(F.max("quality").cast("int").alias("quality")), "doc_id", "quality", max_per_class)
    train = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select("quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["quality", "x"])

    rows = train.mapInArrow(run, "quality int, x array<double>").collect()  # two classes of max_per_class rows at most
    y = np.array([r["quality"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Classifier((0.0,) * N_FEATURES, (0.0,) * N_FEATURES, (1.0,) * N_FEATURES)
    x = np.array([r["x"] for r in rows])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    mean[0], scale[0] = 0.0, 1.0
    z = np.clip((x - mean) / scale, -8, 8)
    beta, penalty = np.zeros(N_FEATURES), ridge * np.eye(N_FEATURES)
    penalty[0, 0] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -35, 35)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(tuple(beta.tolist()), tuple(mean.tolist()), tuple(scale.tolist()))


def classify(documents: DataFrame, model: Classifier, host: Column, path: Column) -> DataFrame:
    """``doc_id, host, path, evidence``."""
    weights, mean, scale = (np.array(v) for v in (model.weights, model.mean, model.scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(3)]).reshape(-1, N_FEATURES)
            p = 1 / (1 + np.exp(-np.clip(np.clip((x - mean) / scale, -8, 8) @ weights, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(p, pa.float64())], ["doc_id", "host", "path", "evidence"])

    named = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = documents.select("doc_id", named(host).alias("host"), named(path).alias("path"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id {id_type(documents)}, host string, path string, evidence double")


def _strength(groups: DataFrame, n: str, total: str, squares: str, centre: Column) -> float:
    """Prior strength in documents, by moments: within-group variance over the variance of true group means around ``centre``."""
    mean = F.col(total) / F.col(n)
    row = groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum(n).alias("rows"),
        F.sum(F.col(squares) - F.col(n) * mean * mean).alias("within"),
        F.sum(F.col(n) * (mean - centre) * (mean - centre)).alias("between"),
        F.sum(F.col(n) * F.col(n)).alias("n2"),
    ).first()
    k, rows = row["groups"], row["rows"] or 0
    if k < 2 or rows <= k:
        return 10.0
    sigma2 = max(row["within"], 0.0) / (rows - k)
    tau2 = (row["between"] - (k - 1) * sigma2) / max(rows - row["n2"] / rows, 1e-9)
    return float(min(max(sigma2 / tau2, 1.0), 1e6)) if tau2 > 0 and sigma2 > 0 else 1e6 if sigma2 > 0 else 10.0


@dataclass(frozen=True)
class Priors:
    """The global mean, and how many documents' worth it weighs against a host's own, and a host's against a path's."""

    mean: float
    host: float
    path: float


def site_sums(evidence: DataFrame) -> tuple[DataFrame, Priors]:
    """``host, path, n_path, sum_path, n_host, sum_host`` for every path over ``evidence (host, path, belief)``, and the priors by moments."""
    belief = F.col("belief")
    paths = stored(evidence.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n_path"), F.sum(belief).alias("sum_path"), F.sum(belief * belief).alias("sq_path")), "paths")
    hosts = stored(paths.groupBy("host").agg(F.sum("n_path").alias("n_host"), F.sum("sum_path").alias("sum_host"), F.sum("sq_path").alias("sq_host")), "hosts")
    total = hosts.agg(F.sum("sum_host").alias("s"), F.sum("n_host").alias("n")).first()
    mean = min(max(total["s"] / total["n"], 1e-6), 1 - 1e-6) if total["n"] else 0.5
    both = paths.join(hosts, "host")
    priors = Priors(mean, _strength(hosts, "n_host", "sum_host", "sq_host", F.lit(mean)), _strength(both, "n_path", "sum_path", "sq_path", F.col("sum_host") / F.col("n_host")))
    return both.select("host", "path", "n_path", "sum_path", "n_host", "sum_host"), priors


def posteriors(sites: DataFrame, priors: Priors, own: Column | None = None) -> DataFrame:
    """Adds ``host_posterior`` and ``path_posterior``; with ``own``, a row's own belief is first taken out of its host and path."""
    one, less = (F.lit(0), F.lit(0.0)) if own is None else (F.lit(1), own)
    of = lambda n, total, strength, centre: (F.col(total) - less + strength * centre) / (F.col(n) - one + strength)
    out = sites.withColumn("host_posterior", of("n_host", "sum_host", F.lit(priors.host), F.lit(priors.mean)))
    return out.withColumn("path_posterior", of("n_path", "sum_path", F.lit(priors.path), F.col("host_posterior")))


def _log_odds(p: Column) -> Column:
    clipped = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(clipped / (1 - clipped))


def quality(documents: DataFrame, labels: DataFrame, *, host: str = "source", path: str = "lang", keep_from: float = 0.5, held_out_mod: int = 5, held_out_rest: int = 0, **parameters) -> DataFrame:
    """One row per document: ``doc_id, held_out, evidence, host_posterior, path_posterior, score, keep``."""
    model = fit(documents, labels, held_out_mod=held_out_mod, held_out_rest=held_out_rest, **parameters)
    evidence = classify(documents, model, F.col(host), F.col(path))
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_bucket(F.col("doc_id"), held_out_mod) != held_out_rest))
    known = known.groupBy(F.col("doc_id").cast(id_type(documents)).alias("_id")).agg(F.max("quality").cast("double").alias("_label"))
    believed = stored(evidence.join(known, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "host", "path", "evidence", F.coalesce("_label", "evidence").alias("belief")), "evidence")
    sites, priors = site_sums(believed)
    placed = posteriors(believed.join(sites, ["host", "path"]), priors, F.col("belief"))
    odds = _log_odds(F.col("evidence")) + _log_odds(F.col("path_posterior")) - _log_odds(F.lit(priors.mean))
    score = 1 / (1 + F.exp(-odds))
    return placed.select(
        "doc_id", (crc_bucket(F.col("doc_id"), held_out_mod) == held_out_rest).alias("held_out"), "evidence", "host_posterior", "path_posterior", score.alias("score"), (score >= keep_from).cast("int").alias("keep")
    )
