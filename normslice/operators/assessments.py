"""Prepared assessments: severities and scopes that came from elsewhere, scored, bounded, compared, resampled.

A prepared frame has ``case_id``, ``sev__<criterion>`` (0 to 1, NULL: not evaluable) and ``scope__<criterion>``.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normslice.errors import NormError
from normslice.functions.core import number, saturate, total
from normslice.functions.ranks import quantiles
from normslice.functions.shared import stored
from normslice.operators.backlog import keys, ordered, prioritize, score_correlation, top_k_overlap
from normslice.operators.scoring import ScoreResult, q, with_scores
from normslice.plans.constraints import Metric
from normslice.plans.norm import Layer, Norm, NormConstraint, View


def check_prepared(df: DataFrame, criteria: Sequence[str]) -> None:
    """One aggregate: ids present and unique, severities within [0, 1], none outside the scope."""
    bad = [F.count_if((q(f"sev__{c}") < 0) | (q(f"sev__{c}") > 1) | F.isnan(q(f"sev__{c}"))).alias(f"range__{c}") for c in criteria]
    out = [F.count_if(q(f"sev__{c}").isNotNull() & ~F.coalesce(q(f"scope__{c}"), F.lit(False))).alias(f"scope__{c}") for c in criteria]
    row = df.agg(F.count_if(F.col("case_id").isNull()).alias("null_ids"), (F.count("case_id") - F.count_distinct("case_id")).alias("repeated_ids"), *bad, *out).first()
    if wrong := {k: v for k, v in row.asDict().items() if v}:
        raise NormError(f"the assessment is not usable: {wrong}")


def assessment_norm(criteria: Sequence[str], weights: Mapping[str, Mapping[str, float]], layers: Mapping[str, str] | None = None, mode: str = "flat") -> Norm:
    """A norm whose constraints pass the severities through; one view for each weight vector."""
    layers = layers or {c: c for c in criteria}
    constraints = tuple(NormConstraint(c, layers[c], Metric(f"sev__{c}", 0.0, 1.0)) for c in criteria)
    return Norm(constraints, tuple(Layer(x) for x in dict.fromkeys(layers[c] for c in criteria)), tuple(View(v, constraint_weights=dict(w)) for v, w in weights.items()), scoring_mode=mode)


def score_prepared(df: DataFrame, criteria: Sequence[str], weights: Mapping[str, Mapping[str, float]], layers: Mapping[str, str] | None = None, mode: str = "flat", validate: bool = True) -> ScoreResult:
    """Scores a prepared frame by the same row arithmetic as an event log; no event stage is run."""
    if validate:
        check_prepared(df, criteria)
    norm = assessment_norm(criteria, weights, layers, mode)
    scope = {c: F.coalesce(q(f"scope__{c}"), F.lit(False)) for c in criteria}
    others = [q(c) for c in df.columns if not c.startswith(("sev__", "scope__"))]
    wide = df.select(*others, *(F.when(scope[c], number(q(f"sev__{c}"))).alias(f"v__{c}") for c in criteria), *(scope[c].alias(f"s__{c}") for c in criteria))
    return ScoreResult(with_scores(wide, norm, norm.view_names, mode), norm, norm.view_names, mode)


def coverage_columns(weights: Mapping[str, float]) -> dict[str, Column]:
    """Weighted coverage, counts, and the flat bounds of the penalty over all completions of the missing severities."""
    sev, scope = (lambda c: q(f"v__{c}")), (lambda c: q(f"s__{c}"))
    w = {c: float(x) for c, x in weights.items() if x > 0}
    scoped = total([F.when(scope(c), F.lit(x)).otherwise(0.0) for c, x in w.items()])
    available = total([F.when(sev(c).isNotNull(), F.lit(x)).otherwise(0.0) for c, x in w.items()])
    known = total([F.coalesce(sev(c), F.lit(0.0)) * x for c, x in w.items()])
    return {
        "coverage": F.when(scoped > 0, available / scoped),
        "n_in_scope": total([scope(c).cast("double") for c in weights]).cast("long"),
        "n_evaluated": total([sev(c).isNotNull().cast("double") for c in weights]).cast("long"),
        "n_weighted": total([(sev(c).isNotNull() & F.lit(x > 0)).cast("double") for c, x in weights.items()]).cast("long"),
        "penalty_low": F.when(scoped > 0, known / scoped),
        "penalty_high": F.when(scoped > 0, (known + scoped - available) / scoped),
    }


def assessed(result: ScoreResult, view: str | None = None) -> DataFrame:
    """Per case: score, clipped penalty, coverage, counts and completion bounds."""
    v = result.view(view)
    s = q(f"score__{v}")
    extra = coverage_columns(result.norm.raw_weights(v))
    return result.table.select(*(q(c) for c in result.case_columns()), s.alias("score"), F.when(s.isNotNull(), F.least(F.greatest(1 - s, F.lit(0.0)), F.lit(1.0))).alias("penalty"), *(c.alias(k) for k, c in extra.items()))


def group_priorities(df: DataFrame, by: str | Sequence[str], *, gamma: float = 0.0, baseline: float | None = None, exposure: str | None = None, min_cases: int = 0) -> DataFrame:
    """Backlog over a ``score`` column that also counts unscored cases; a constant score has no gap."""
    by = keys(by)
    s = F.col("score")
    amount = F.count(s).cast("double") if exposure is None else F.coalesce(F.sum(F.when(s.isNotNull(), q(exposure))), F.lit(0.0))
    groups = df.groupBy(*(q(k) for k in by)).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(s.isNull()).alias("n_unscored"), F.count(s).alias("n_cases"), F.avg(s).alias("mean_score"), F.avg(1 - s).alias("mean_penalty"), F.sum(1 - s).alias("total_penalty"), amount.alias("volume")
    )
    overall = df.agg((F.avg(s) if baseline is None else F.lit(float(baseline))).alias("global_mean"), F.coalesce(F.min(s) == F.max(s), F.lit(True)).alias("_flat"))
    out = groups.crossJoin(F.broadcast(overall))  # one row
    flat = F.col("_flat") if baseline is None else F.lit(False)
    out = out.withColumn("gap", F.when(flat, 0.0).otherwise(F.greatest(F.col("global_mean") - F.col("mean_score"), F.lit(0.0))))
    out = out.withColumn("PI", F.col("volume") * F.col("gap")).withColumn("stable_gap", F.col("gap") * F.try_divide(F.col("n_cases").cast("double"), F.col("n_cases") + float(gamma)))
    out = out.withColumn("stable_PI", F.col("volume") * F.col("stable_gap")).drop("_flat").where(F.col("n_cases") >= max(1, min_cases))
    return out.orderBy(*ordered(F.col("stable_PI"), by, F.col("n_cases").desc()))


def signed_components(result: ScoreResult, by: str | Sequence[str], *, view: str | None = None, gamma: float = 0.0) -> DataFrame:
    """Per group and criterion the signed distance of its mean penalty from the population, times shrunk volume; only the sum is clipped."""
    by = keys(by)
    v = result.view(view)
    penalty = result.penalty(v)
    ids = result.ids
    frame = result.table.where(result.is_scored(v)).select(*(q(k) for k in by), *(penalty[c].alias(f"pen__{c}") for c in ids))
    overall = frame.agg(*(F.avg(q(f"pen__{c}")).alias(f"all__{c}") for c in ids))
    groups = frame.groupBy(*(q(k) for k in by)).agg(F.count(F.lit(1)).alias("n_cases"), *(F.avg(q(f"pen__{c}")).alias(f"mean__{c}") for c in ids)).crossJoin(F.broadcast(overall))
    size = F.col("n_cases") * F.col("n_cases") / (F.col("n_cases") + float(gamma))
    parts = {c: (q(f"mean__{c}") - q(f"all__{c}")) * size for c in ids}
    return groups.select(*(q(k) for k in by), "n_cases", *(p.alias(f"component__{c}") for c, p in parts.items()), F.greatest(total(list(parts.values())), F.lit(0.0)).alias("stable_PI")).orderBy(
        *ordered(F.col("stable_PI"), by)
    )


def coco_same_target(df: DataFrame, by: str | Sequence[str]) -> DataFrame:
    """Per group the lost score against the mean as a fraction of all cases' lost score; NULL if none is lost."""
    by = keys(by)
    penalty = 1 - F.col("score")
    frame = df.where("score is not null")
    distance = penalty - F.col("_mean")
    groups = frame.crossJoin(F.broadcast(frame.agg(F.avg(penalty).alias("_mean")))).groupBy(*(q(k) for k in by)).agg(F.count(F.lit(1)).alias("n_cases"), F.sum(distance).alias("numerator"), F.sum(F.greatest(distance, F.lit(0.0))).alias("_lost"))
    out = groups.crossJoin(F.broadcast(groups.agg(F.sum("_lost").alias("_all"))))  # one row
    return out.withColumn("coco", F.when(F.col("_all") > 0, F.col("numerator") / F.nullif(F.col("_all"), F.lit(0.0)))).drop("_lost", "_all").orderBy(*ordered(F.col("coco"), by))


def coverage_diagnostics(result: ScoreResult, by: str | Sequence[str], *, view: str | None = None) -> DataFrame:
    """Per group: mean, least and 10 % coverage, scored cases, and how many different evidence signatures it has.

    Coverage has few distinct values, as many as there are signatures, so its quantile needs only their counts.
    """
    by, v = keys(by), result.view(view)
    coverage = coverage_columns(result.norm.raw_weights(v))["coverage"]
    cases = result.table.select(*(q(k) for k in by), q(f"score__{v}").alias("score"), coverage.alias("coverage"), signature(result).alias("signature"))
    return cases.groupBy(*(q(k) for k in by)).agg(
        F.count(F.lit(1)).alias("n_cases"), F.count("score").alias("n_scored"), F.avg("coverage").alias("mean_coverage"), F.min("coverage").alias("min_coverage"), F.percentile("coverage", F.lit(0.1)).alias("q10_coverage"), F.count_distinct("signature").alias("n_signatures")
    )


def signature(result: ScoreResult) -> Column:
    """The criteria that a case has evidence for, as text."""
    return F.concat_ws("|", *(F.when(q(f"v__{c}").isNotNull(), c) for c in result.ids))


def signature_counts(result: ScoreResult) -> DataFrame:
    return result.table.groupBy(signature(result).alias("signature")).agg(F.count(F.lit(1)).alias("n_cases")).orderBy(F.col("n_cases").desc(), "signature")


def observed_balance(x: Column, y: Column, tau: float, width: float, eps: float = 1e-9) -> Column:
    """Balance of two observed totals where a missing one is unknown, not zero."""
    known = F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) / F.greatest(x, y, F.lit(eps)))
    return saturate(known, tau, width)


def parity_residual(left: DataFrame, right: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row: keys on one side only, NULLs on one side only, and the largest difference of each value column."""
    l = left.select(*(q(k).alias(f"l_{k}") for k in on), *(q(v).alias(f"lv_{v}") for v in values), F.lit(True).alias("_l"))
    r = right.select(*(q(k).alias(f"r_{k}") for k in on), *(q(v).alias(f"rv_{v}") for v in values), F.lit(True).alias("_r"))
    condition = reduce(lambda a, b: a & b, (q(f"l_{k}").eqNullSafe(q(f"r_{k}")) for k in on))
    both = l.join(r, condition, "full_outer")
    odd = reduce(lambda a, b: a + b, (F.count_if(F.col("_l") & F.col("_r") & (q(f"lv_{v}").isNull() != q(f"rv_{v}").isNull())) for v in values))
    gap = [F.coalesce(F.max(F.abs(q(f"lv_{v}") - q(f"rv_{v}"))), F.lit(0.0)).alias(f"residual__{v}") for v in values]
    return both.agg(F.count_if(F.col("_l").isNull() | F.col("_r").isNull()).alias("unmatched_keys"), odd.alias("null_mismatches"), *gap)


def states(result: ScoreResult) -> DataFrame:
    """Long form: ``case_id, criterion, state, severity`` with state out_of_scope, not_evaluable or evaluated."""
    rows = [
        F.struct(F.lit(c).alias("criterion"), F.when(~q(f"s__{c}"), "out_of_scope").when(q(f"v__{c}").isNull(), "not_evaluable").otherwise("evaluated").alias("state"), q(f"v__{c}").alias("severity"))
        for c in result.ids
    ]
    return result.table.select(*(q(c) for c in result.case_columns()), F.inline(F.array(*rows)))


def criterion_profiles(result: ScoreResult, by: str | Sequence[str]) -> DataFrame:
    """Per group and criterion: cases by state and mean severity."""
    by = keys(by)
    return states(result).groupBy(*(q(k) for k in by), "criterion").agg(
        F.count_if(F.col("state") == "evaluated").alias("n_evaluated"), F.count_if(F.col("state") == "not_evaluable").alias("n_not_evaluable"), F.count_if(F.col("state") == "out_of_scope").alias("n_out_of_scope"), F.avg("severity").alias("mean_severity")
    )


def pivot_severities(long: DataFrame, criteria: Sequence[str]) -> DataFrame:
    """``case_id, criterion, severity`` to ``sev__<criterion>`` columns; the criteria are given, so no extra pass finds them."""
    wide = long.groupBy("case_id").pivot("criterion", list(criteria)).agg(F.first("severity", ignorenulls=True))
    return wide.select("case_id", *(q(c).alias(f"sev__{c}") for c in criteria))


def draw(seed: int, rep: Column, cluster: Column) -> Column:
    """A cluster's multiplicity in a replicate: Poisson(1), cut at 12, from the first 52 bits of an MD5 of seed, replicate and cluster."""
    key = F.concat_ws("|", F.lit(str(seed)), rep.cast("string"), F.coalesce(cluster.cast("string"), F.lit("")))
    u = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return reduce(lambda a, b: a + b, ((u >= x).cast("int") for x in POISSON))


def _poisson(limit: int = 12) -> list[float]:
    out, p, acc = [], math.exp(-1), 0.0
    for k in range(limit):
        acc += p
        out.append(acc)
        p /= k + 1
    return out


POISSON = _poisson()


def numbered(clusters: DataFrame) -> DataFrame:
    """``_cluster, number``: distinct clusters numbered from 0 in the order of their MD5, in tasks by its first three digits."""
    hashed = clusters.select("_cluster", F.md5(F.coalesce(F.col("_cluster").cast("string"), F.lit(""))).alias("_h")).withColumn("_prefix", F.substring("_h", 1, 3))
    below = F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # 4,096 prefixes at most
    bases = hashed.groupBy(F.col("_prefix").alias("_p")).agg(F.count(F.lit(1)).alias("n")).select("_p", F.coalesce(below, F.lit(0)).alias("_below"))
    inside = F.row_number().over(Window.partitionBy("_prefix").orderBy("_h", "_cluster"))
    return hashed.withColumn("_inside", inside).join(bases, F.col("_prefix") == F.col("_p")).select("_cluster", (F.col("_below") + F.col("_inside") - 1).alias("number"))


def multinomial(spark: SparkSession, clusters: int, replicates: int, seed: int) -> DataFrame:
    """``rep, number, m``: how often each replicate draws a cluster, out of as many draws as there are clusters. Clusters that it does not draw are left out.

    A draw is a number that its own hash picks, so draws are made where they are counted and no list of them goes anywhere.
    """
    drawn = spark.range(clusters * replicates).select((F.col("id") % replicates).cast("int").alias("rep"), F.floor(F.col("id") / replicates).alias("i"))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}"), F.col("rep").cast("string"), F.lit("draw"), F.col("i").cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return drawn.select("rep", F.floor(u * float(clusters)).alias("number")).groupBy("rep", "number").agg(F.count(F.lit(1)).alias("m"))


def cluster_bootstrap(df: DataFrame, cluster: str, group: str, *, replicates: int = 200, seed: int = 7, top: int = 5, method: str = "poisson") -> DataFrame:
    """Bootstrap of ``PI`` by group over clusters of cases: median, 2.5 and 97.5 % quantiles, share of replicates in the top.

    Scores are summed per (cluster, group) first. Multiplicities come from hashes, so they are the same on any partitioning and after a
    lost executor: ``poisson`` draws each cluster by itself, without a shuffle; ``multinomial`` draws as many clusters as there are in
    every replicate. A replicate in which a group has no cluster counts with a PI of 0.
    """
    if method not in ("poisson", "multinomial"):
        raise NormError("method must be poisson or multinomial")
    cells = stored(df.groupBy(q(cluster).alias("_cluster"), q(group).alias("_group")).agg(F.count("score").alias("n"), F.sum("score").alias("s")).where("n > 0"), "cells")
    every = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")
    if method == "poisson":
        drawn = cells.select("*", every).withColumn("m", draw(seed, F.col("rep"), F.col("_cluster"))).where("m > 0")
    else:
        names = stored(numbered(cells.select("_cluster").distinct()), "clusters")
        placed = cells.join(names.withColumnRenamed("_cluster", "_c"), F.col("_cluster").eqNullSafe(F.col("_c")))
        drawn = multinomial(df.sparkSession, names.count(), replicates, seed).join(placed, "number")
    sums = drawn.groupBy("rep", "_group").agg(F.sum(F.col("m") * F.col("n")).alias("n"), F.sum(F.col("m") * F.col("s")).alias("s"))
    sums = stored(sums, "replicates")
    means = sums.groupBy(F.col("rep").alias("_rep")).agg((F.sum("s") / F.sum("n")).alias("mean"))
    grid = cells.select("_group").distinct().select(F.col("_group").alias("_g"), every)
    pi = grid.join(sums.withColumnRenamed("rep", "_r"), (F.col("rep") == F.col("_r")) & F.col("_g").eqNullSafe(F.col("_group")), "left").join(means, F.col("rep") == F.col("_rep"), "left")
    loss = F.round(F.greatest(F.col("mean") - F.col("s") / F.col("n"), F.lit(0.0)) * F.col("n"), 12)
    pi = pi.select("rep", "_g", F.coalesce(loss, F.lit(0.0)).alias("PI"))
    rank = F.row_number().over(Window.partitionBy("rep").orderBy(F.col("PI").desc(), F.col("_g").asc_nulls_last()))
    return (
        pi.withColumn("in_top", ((rank <= top) & (F.col("PI") > 0)).cast("double"))
        .groupBy(F.col("_g").alias(group))
        .agg(F.percentile("PI", F.lit(0.025)).alias("low"), F.percentile("PI", F.lit(0.5)).alias("median"), F.percentile("PI", F.lit(0.975)).alias("high"), (F.sum("in_top") / replicates).alias("top_share"))  # ``replicates`` values a group
    )


def compare_tables(a: DataFrame, b: DataFrame, by: str | Sequence[str], metric: str = "stable_PI", k: int = 10) -> DataFrame:
    """One row: Spearman correlation of the metric on common groups, and overlap of the top ``k``."""
    by = keys(by)
    right = b.select(*(q(c).alias(f"_{c}") for c in by), q(metric).alias("y"))
    condition = reduce(lambda x, y: x & y, (q(c).eqNullSafe(q(f"_{c}")) for c in by))
    common = a.select(*(q(c) for c in by), q(metric).alias("x")).join(right, condition).select("x", "y")
    return top_k_overlap(a, b, by, k=k, metric=metric).crossJoin(F.broadcast(score_correlation(common, "spearman")))


def witnesses(result: ScoreResult, by: str | Sequence[str], *, view: str | None = None) -> DataFrame:
    """Per group the case of lowest score (ties: smallest id) and the case nearest to the group's median."""
    by = keys(by)
    v = result.view(view)
    frame = stored(result.table.where(result.is_scored(v)).select(*(q(k) for k in by), "case_id", q(f"score__{v}").alias("score")), "scored-cases")
    middle = quantiles(frame, "score", [0.5], by).select(*(q(k).alias(f"_{k}") for k in by), F.col("q0").alias("median"))
    condition = reduce(lambda x, y: x & y, (q(c).eqNullSafe(q(f"_{c}")) for c in by))
    both = frame.join(middle, condition)
    return both.groupBy(*(q(k) for k in by)).agg(
        F.min_by("case_id", F.struct("score", "case_id")).alias("worst_case"), F.min("score").alias("worst_score"), F.min_by("case_id", F.struct(F.abs(F.col("score") - F.col("median")), F.col("case_id"))).alias("median_case")
    )


def without_criterion(result: ScoreResult, criterion: str) -> ScoreResult:
    """The same cases scored without one criterion: a new plan over the same table."""
    norm = result.norm
    left = tuple(c for c in norm.constraints if c.id != criterion)
    drop = {c.layer for c in norm.constraints} - {c.layer for c in left}
    views = []
    for v in norm.views:
        weights = {k: w for k, w in v.weights.items() if k != (criterion if not v.by_layer else None) and not (v.by_layer and k in drop)}
        views.append(View(v.name, layer_weights=weights) if v.by_layer else View(v.name, constraint_weights=weights))
    norm = norm.replace(constraints=left, layers=tuple(x for x in norm.layers if x.id not in drop), views=tuple(views))
    base = result.table.select(*(c for c in result.table.columns if not c.startswith(("score__", "contrib__")) and c not in (f"v__{criterion}", f"s__{criterion}")))
    return ScoreResult(with_scores(base, norm, norm.view_names, result.mode), norm, norm.view_names, result.mode, result.log)


def rescaled(norm: Norm, cid: str, **parameters: float) -> Norm:
    """The norm with other parameters (a threshold, a width, a count) in one constraint."""
    return norm.replace_constraint(cid, constraint=replace(norm.get_constraint(cid).constraint, **parameters))


def cohort(result: ScoreResult, condition: Column | Mapping[str, object]) -> ScoreResult:
    """The scored cases that meet a condition; their scores stay."""
    return ScoreResult(result.table.where(result.where(condition)), result.norm, result.views, result.mode, result.log)


def sensitivity(base: ScoreResult, variants: Mapping[str, ScoreResult], by: str | Sequence[str], *, view: str | None = None, gamma: float = 0.0, min_cases: Mapping[str, int] | None = None, k: int = 10) -> DataFrame:
    """A row for each variant (another norm, mode, log or cohort, or by ``min_cases`` another support): how many cases it scores, their mean,
    and how its backlog agrees with the base's: rank correlation on common slices, overlap of the top ``k``.
    """
    first = prioritize(base, by, view=view, gamma=gamma)
    rows = []
    for name, variant in variants.items():
        backlog = prioritize(variant, by, view=view, gamma=gamma, min_cases=(min_cases or {}).get(name, 0))
        cases = backlog.agg(F.sum("n_cases").alias("n_scored"), F.try_divide(F.sum(F.col("mean_score") * F.col("n_cases")), F.sum("n_cases")).alias("mean_score"))
        metric = lambda df: df.withColumn("stable_PI", F.round("stable_PI", 9))
        rows.append(compare_tables(metric(first), metric(backlog), by, k=k).crossJoin(F.broadcast(cases)).select(F.lit(name).alias("variant"), "n_scored", "mean_score", "correlation", "overlap"))  # one row each
    return reduce(DataFrame.union, rows)
