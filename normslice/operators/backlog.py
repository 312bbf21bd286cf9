"""Ranked slices: where the lost score is, how sure that is, and what drives it.

Every report is one grouped aggregate of the case table on the slice keys, with population scalars joined in as one row.
Rankings order by the metric and then by the keys, so they do not depend on partitions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normslice.errors import NormError, NotScoredError
from normslice.functions.core import average_rank, correlation, finite_or_none
from normslice.functions.ranks import rank_correlation, spearman_all
from normslice.functions.shared import stored
from normslice.operators.scoring import ScoreResult, q


def keys(by: str | Sequence[str]) -> list[str]:
    found = [by] if isinstance(by, str) else list(by)
    if not found or len(set(found)) != len(found):
        raise NormError(f"slice keys must be distinct names: {by!r}")
    return found


def unfiltered(data: ScoreResult | DataFrame, view: str | None, score_col: str = "score") -> DataFrame:
    """The frame with a ``score`` column. Aggregates skip its NULLs, so no filter repeats the score's arithmetic below them."""
    return data.frame(data.view(view)) if isinstance(data, ScoreResult) else data.withColumn("score", q(score_col))


def ordered(metric: Column, by: Sequence[str], *others: Column) -> list[Column]:
    return [metric.desc_nulls_last(), *others, *(q(k).asc_nulls_last() for k in by)]


def prioritize(
    data: ScoreResult | DataFrame,
    by: str | Sequence[str],
    *,
    view: str | None = None,
    gamma: float = 0.0,
    volume: str = "count",
    min_cases: int = 0,
    z: float | None = None,
    score_col: str = "score",
    baseline: float | None = None,
    population: DataFrame | None = None,
) -> DataFrame:
    """The backlog: slices by how much score they lose against the population, shrunk by ``n / (n + gamma)``.

    ``volume`` is ``count`` or a column to sum. NULL keys are a slice; small slices go after the population mean is taken.
    """
    by = keys(by)
    finite_or_none(gamma, "gamma", least=0)
    finite_or_none(min_cases, "min_cases", least=0)
    finite_or_none(z, "z", least=0)
    finite_or_none(baseline, "baseline")
    frame = unfiltered(data, view, score_col)
    if lacking := [k for k in by if k not in frame.columns]:
        raise NormError(f"no slice keys {lacking}")
    amount = F.count("score").cast("double") if volume == "count" else F.coalesce(F.sum(F.when(F.col("score").isNotNull(), q(volume))), F.lit(0.0))
    slices = frame.groupBy(*(q(k) for k in by)).agg(
        F.count("score").alias("n_cases"), F.avg("score").alias("mean_score"), F.stddev_samp("score").alias("sd_score"), amount.cast("double").alias("volume"), F.sum("score").alias("_sum")
    )
    slices = slices.where("n_cases > 0")
    if baseline is None:
        # the population mean comes from the slices' sums: the case table is not scored a second time
        means = population.agg(F.avg("score").alias("global_mean")) if population is not None else slices.agg((F.sum("_sum") / F.nullif(F.sum("n_cases"), F.lit(0))).alias("global_mean"))
        slices = slices.crossJoin(F.broadcast(means))  # one row
    else:
        slices = slices.withColumn("global_mean", F.lit(float(baseline)))
    gap = F.greatest(F.col("global_mean") - F.col("mean_score"), F.lit(0.0))
    shrink = F.col("n_cases") / (F.col("n_cases") + float(gamma)) if gamma else F.lit(1.0)
    out = slices.drop("_sum").withColumn("gap", gap).withColumn("PI", F.col("volume") * F.col("gap")).withColumn("shrink", shrink)
    out = out.withColumn("stable_mean", F.col("global_mean") + F.col("shrink") * (F.col("mean_score") - F.col("global_mean")))
    out = out.withColumn("stable_gap", F.greatest(F.col("global_mean") - F.col("stable_mean"), F.lit(0.0))).withColumn("stable_PI", F.col("volume") * F.col("stable_gap"))
    if z is not None:
        out = out.withColumn("se", F.col("sd_score") / F.sqrt(F.col("n_cases").cast("double")))
        out = out.withColumn("gap_lower", F.greatest(F.col("stable_gap") - float(z) * F.coalesce("se", F.lit(0.0)) * F.col("shrink"), F.lit(0.0)))
        out = out.withColumn("PI_lower", F.col("volume") * F.col("gap_lower"))
    return out.where(F.col("n_cases") >= min_cases).orderBy(*ordered(F.col("stable_PI"), by, F.col("n_cases").desc()))


def layer_drivers(result: ScoreResult, by: str | Sequence[str], *, view: str | None = None, layers: Sequence[str] | None = None) -> DataFrame:
    """Mean layer contribution per slice, its distance from the population, and the layer that stands out most."""
    by = keys(by)
    layers = list(layers or result.norm.layer_ids)
    frame = unfiltered(result, view)
    means = frame.groupBy(*(q(k) for k in by)).agg(F.count("score").alias("n_cases"), *(F.avg(q(f"contrib__{x}")).alias(f"mean__{x}") for x in layers))
    overall = means.where("n_cases > 0").agg(*((F.sum(q(f"mean__{x}") * F.col("n_cases")) / F.nullif(F.sum("n_cases"), F.lit(0))).alias(f"all__{x}") for x in layers))
    out = means.where("n_cases > 0").crossJoin(F.broadcast(overall))
    deltas = [(q(f"mean__{x}") - q(f"all__{x}")) for x in layers]
    array = F.array(*deltas)
    top = F.element_at(F.array(*map(F.lit, layers)), F.array_position(array, F.array_max(array)).cast("int"))
    return out.select(
        *(q(k) for k in by), "n_cases", *(q(f"mean__{x}") for x in layers), *(d.alias(f"delta__{x}") for d, x in zip(deltas, layers, strict=True)), F.when(F.array_max(array) > 0, top).alias("dominant_layer")
    ).orderBy(*(q(k).asc_nulls_last() for k in by))


def constraint_drivers(result: ScoreResult, *, view: str | None = None, where: Any = None) -> DataFrame:
    """A row for each constraint: mean penalty over scored cases, and how often it applies, can be evaluated, is violated."""
    v = result.view(view)
    penalty = result.penalty(v)
    is_scored = q(f"score__{v}").isNotNull()
    rows = [
        F.struct(
            F.lit(c).alias("constraint"),
            F.lit(result.norm.layer_of[c]).alias("layer"),
            F.lit(i).alias("place"),
            F.avg(F.when(is_scored, penalty[c])).alias("mean_penalty"),
            F.avg(q(f"v__{c}")).alias("mean_violation"),
            F.avg((q(f"v__{c}") > 0).cast("double")).alias("share_violated"),
            F.avg(q(f"s__{c}").cast("double")).alias("share_in_scope"),
            F.avg(q(f"v__{c}").isNotNull().cast("double")).alias("share_evaluated"),
        )
        for i, c in enumerate(result.ids)
    ]
    out = result.table.where(result.where(where)).agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    return out.orderBy(F.col("mean_penalty").desc_nulls_last(), F.col("mean_violation").desc_nulls_last(), "place").drop("place")


def _with_shares(df: DataFrame, metric: str, by: Sequence[str]) -> DataFrame:
    """Rank, share and running share along the metric; the slice table is small beside the cases."""
    order = Window.orderBy(*ordered(q(metric), by))
    whole = F.sum(q(metric)).over(Window.partitionBy(F.lit(1)))
    share = F.when(whole > 0, q(metric) / whole).otherwise(F.lit(0.0))
    ranked = df.withColumn("rank", F.row_number().over(order)).withColumn("share", share)
    return ranked.withColumn("cum_share", F.sum("share").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))


def penalty_mass(result: ScoreResult, by: str | Sequence[str], *, view: str | None = None, where: Any = None) -> DataFrame:
    """Total lost score per slice with its share of the whole."""
    by = keys(by)
    v = result.view(view)
    frame = result.table if where is None else result.table.where(result.where(where))
    mass = frame.groupBy(*(q(k) for k in by)).agg(F.count(q(f"score__{v}")).alias("n_cases"), F.sum(1 - q(f"score__{v}")).alias("penalty_mass"), F.avg(1 - q(f"score__{v}")).alias("mean_penalty"))
    return _with_shares(mass.where("n_cases > 0"), "penalty_mass", by).orderBy("rank")


def pareto(backlog: DataFrame, by: str | Sequence[str], metric: str = "stable_PI") -> DataFrame:
    return _with_shares(backlog, metric, keys(by)).orderBy("rank")


def concentration(backlog: DataFrame, by: str | Sequence[str], thresholds: Sequence[float] = (0.5, 0.8, 0.9), metric: str = "stable_PI") -> DataFrame:
    """How many slices, from the top, hold each share of the metric."""
    curve = _with_shares(backlog, metric, keys(by))
    rows = [
        F.struct(F.lit(float(t)).alias("threshold"), F.least(F.count_if(F.col("cum_share") < t) + 1, F.count(F.lit(1))).alias("n_slices"), F.count(F.lit(1)).alias("n_all"))
        for t in thresholds
    ]
    return curve.agg(F.array(*rows).alias("rows")).select(F.inline("rows")).withColumn("share_of_slices", F.try_divide(F.col("n_slices").cast("double"), F.col("n_all"))).orderBy("threshold")


def _top(backlog: DataFrame, by: Sequence[str], k: int, metric: str) -> DataFrame:
    return backlog.where(q(metric) > 0).orderBy(*ordered(q(metric), by)).limit(k).select(*(F.coalesce(q(c).cast("string"), F.lit("")).alias(c) for c in by))


def top_k_overlap(a: DataFrame, b: DataFrame, by: str | Sequence[str], *, k: int = 20, metric: str = "stable_PI") -> DataFrame:
    """One row: Jaccard similarity of the two top-``k`` sets of positive slices; NULL if both are empty."""
    by = keys(by)
    sides = _top(a, by, k, metric).withColumn("a", F.lit(1)).withColumn("b", F.lit(0)).union(_top(b, by, k, metric).withColumn("a", F.lit(0)).withColumn("b", F.lit(1)))
    both = sides.groupBy(*(q(c) for c in by)).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return both.agg(F.try_divide(F.count_if((F.col("a") > 0) & (F.col("b") > 0)).cast("double"), F.count(F.lit(1))).alias("overlap"))


def view_agreement(result: ScoreResult, by: str | Sequence[str], *, k: int = 20, gamma: float = 0.0, method: str = "spearman", metric: str = "stable_PI") -> DataFrame:
    """A row for each pair of views: overlap of their top slices and correlation of their case scores.

    The scored cases are written once to the shared folder (keys and scores only) and read for everything else: slices, whose
    backlogs for all views are one grouped aggregate, and correlations. Metrics and scores are compared at 9 decimals, so that the last
    bits of a sum, which depend on partitions, cannot reorder equal ones.
    """
    if method not in ("pearson", "spearman", "kendall"):
        raise NormError("method must be pearson, spearman or kendall")
    if metric not in ("PI", "stable_PI", "gap", "stable_gap"):
        raise NormError(f"agreement cannot rank by {metric!r}")
    by, views = keys(by), result.views
    pairs = [(i, j) for i in range(len(views)) for j in range(i + 1, len(views))]
    if not pairs:
        raise NotScoredError("agreement needs two views")
    score_of = {i: q(f"score__{v}") for i, v in enumerate(views)}
    cases = stored(result.table.select(*(q(c) for c in by), *score_of.values()), "scored-cases")
    slices = cases.groupBy(*(q(c) for c in by)).agg(*(x for i, s in score_of.items() for x in (F.count(s).alias(f"_n{i}"), F.avg(s).alias(f"_m{i}"), F.sum(s).alias(f"_s{i}"))))
    overall = slices.agg(*(F.try_divide(F.sum(f"_s{i}"), F.sum(f"_n{i}")).alias(f"_g{i}") for i in score_of))
    wide = slices.crossJoin(F.broadcast(overall))  # one row
    value = {}
    for i in score_of:
        gap = F.greatest(F.col(f"_g{i}") - F.col(f"_m{i}"), F.lit(0.0))
        gap = gap * F.col(f"_n{i}") / (F.col(f"_n{i}") + float(gamma)) if metric.startswith("stable") and gamma else gap
        value[i] = F.coalesce(F.round(gap * F.col(f"_n{i}") if metric.endswith("PI") else gap, 9), F.lit(0.0))
    wide = wide.select(*(q(c) for c in by), *(x.alias(f"_x{i}") for i, x in value.items()))
    places = {i: F.row_number().over(Window.orderBy(*ordered(F.col(f"_x{i}"), by))) for i in score_of}
    tops = wide.select(*(((places[i] <= k) & (F.col(f"_x{i}") > 0)).alias(f"_top{i}") for i in score_of))

    def rows(correlation_of: Any) -> Column:
        return F.array(*(F.struct(F.lit(views[i]).alias("view_a"), F.lit(views[j]).alias("view_b"), correlation_of(i, j)) for i, j in pairs))

    top = lambda i: F.col(f"_top{i}")
    overlaps = tops.agg(rows(lambda i, j: F.try_divide(F.count_if(top(i) & top(j)).cast("double"), F.count_if(top(i) | top(j))).alias("overlap")).alias("r")).select(F.inline("r"))
    if method == "pearson":
        flat = cases.select(*(s.alias(f"_s{i}") for i, s in score_of.items()))
        found = flat.agg(rows(lambda i, j: correlation(f"_s{i}", f"_s{j}").alias("correlation")).alias("r")).select(F.inline("r"))
    elif method == "spearman":
        flat = cases.select(*(F.round(s, 9).alias(f"_s{i}") for i, s in score_of.items()))
        names = F.array(*map(F.lit, views))
        found = spearman_all(flat, [f"_s{i}" for i in score_of]).select(names[F.col("i")].alias("view_a"), names[F.col("j")].alias("view_b"), "correlation")
    else:
        parts = []
        for i, j in pairs:
            pair = cases.select(F.round(score_of[i], 9).alias("x"), F.round(score_of[j], 9).alias("y"))
            parts.append(score_correlation(pair, method).select(F.lit(views[i]).alias("view_a"), F.lit(views[j]).alias("view_b"), "correlation"))
        found = reduce(DataFrame.union, parts)
    return overlaps.join(F.broadcast(found), ["view_a", "view_b"])  # a row for each pair of views


def score_correlation(pair: DataFrame, method: str) -> DataFrame:
    """One row ``correlation`` of columns ``x, y``, exact at any size."""
    return rank_correlation(pair, method)


def hotspot_table(backlog: DataFrame, by: str | Sequence[str], *, top: int = 10, drivers: DataFrame | None = None) -> DataFrame:
    """The top slices with a role: ``reservoir`` (volume outranks severity most), ``severity`` (the reverse), else ``mechanism``."""
    by = keys(by)
    head = backlog.where("stable_PI > 0").orderBy(*ordered(F.col("stable_PI"), by)).limit(top)
    place = Window.orderBy(*ordered(F.col("stable_PI"), by))
    ranked = head.withColumn("place", F.row_number().over(place)).withColumn("volume_rank", average_rank(F.col("n_cases"))).withColumn("gap_rank", average_rank(F.col("stable_gap")))
    lead = ranked.withColumn("lead", F.col("volume_rank") - F.col("gap_rank"))
    first = F.row_number().over(Window.orderBy(F.col("lead").desc(), "place"))
    marked = lead.withColumn("reservoir", (first == 1) & (F.col("lead") > 0))
    second = F.row_number().over(Window.orderBy(F.col("reservoir"), F.col("lead").asc(), "place"))
    role = F.when(F.col("reservoir"), "reservoir").when((second == 1) & (F.col("lead") < 0), "severity").otherwise("mechanism")
    out = marked.withColumn("role", role).drop("lead", "reservoir", "volume_rank", "gap_rank")
    if drivers is not None:
        side = drivers.select(*(q(k).alias(f"_{k}") for k in by), "dominant_layer")
        condition = F.lit(True)
        for k in by:
            condition = condition & q(k).eqNullSafe(q(f"_{k}"))
        out = out.join(side, condition, "left").drop(*(f"_{k}" for k in by))
    return out.orderBy("place").drop("place")


def compare_periods(previous: DataFrame, current: DataFrame, by: str | Sequence[str], metrics: Sequence[str] = ("n_cases", "stable_gap", "stable_PI")) -> DataFrame:
    """Full outer join of two backlogs on their (null-safe) keys, with changes; an absent slice counts as 0."""
    by = keys(by)
    old = previous.select(*(q(k).alias(f"_{k}") for k in by), *(q(m).alias(f"{m}_before") for m in metrics), F.lit(True).alias("_old"))
    new = current.select(*(q(k) for k in by), *(q(m).alias(f"{m}_now") for m in metrics), F.lit(True).alias("_new"))
    condition = F.lit(True)
    for k in by:
        condition = condition & q(k).eqNullSafe(q(f"_{k}"))
    both = new.join(old, condition, "full_outer")
    named = [F.when(F.col("_new"), q(k)).otherwise(q(f"_{k}")).alias(k) for k in by]
    change = [(F.coalesce(q(f"{m}_now").cast("double"), F.lit(0.0)) - F.coalesce(q(f"{m}_before").cast("double"), F.lit(0.0))).alias(f"{m}_change") for m in metrics]
    out = both.select(*named, *(q(f"{m}_{t}") for m in metrics for t in ("before", "now")), *change)
    return out.orderBy(*ordered(q(f"{metrics[-1]}_now"), by))


def estimate_gamma(data: ScoreResult | DataFrame, by: str | Sequence[str], *, view: str | None = None, score_col: str = "score") -> float:
    """Shrinkage strength by moments: variance within slices over variance of true slice means; inf if these do not differ."""
    by = keys(by)
    slices = unfiltered(data, view, score_col).groupBy(*(q(k) for k in by)).agg(F.count("score").alias("n"), F.avg("score").alias("m"), F.var_samp("score").alias("v")).where("n >= 2")
    row = slices.agg(
        F.count(F.lit(1)).alias("k"), (F.sum(F.col("v") * (F.col("n") - 1)) / F.sum(F.col("n") - 1)).alias("within"), F.var_samp("m").alias("between"), F.avg(1.0 / F.col("n")).alias("inverse")
    ).first()
    if row["k"] < 2:
        raise NotScoredError("gamma needs two slices of two cases")
    true = row["between"] - row["within"] * row["inverse"]
    return row["within"] / true if true > 0 else math.inf
