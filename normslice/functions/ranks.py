"""Exact ranks, quantiles and rank correlations of columns with any number of distinct values.

A window without partition key puts all its rows into one task. Here values are first counted, then dealt into ranges by
cuts from a sketch (the cuts shape the layout only), ranked inside their range, and lifted by what lies in the ranges below.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normslice.functions.core import correlation
from normslice.functions.shared import stored

#: Ranges that distinct values are dealt into.
RANGES = 128
#: Distinct pairs that one task compares at once for Kendall's correlation.
BLOCK = 200_000


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def cuts(df: DataFrame, value: str, ranges: int = RANGES) -> list[float]:
    """Values that split the rows into about equal ranges: one sketch, merged on the way."""
    points = F.percentile_approx(_q(value), F.array(*(F.lit(i / ranges) for i in range(1, ranges))), 10_000)
    return sorted(set(df.agg(points.alias("p")).first()["p"] or ()))


def before(counts: DataFrame, value: str, n: str = "n", by: Sequence[str] = (), ranges: int = RANGES) -> DataFrame:
    """Adds ``before``: how many rows have a smaller value. ``counts`` has one row for each (group and) value, stored."""
    bounds = cuts(counts, value, ranges)
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda c: c <= _q(value))) if bounds else F.lit(0)
    dealt = counts.withColumn("__range", place)
    keys = [_q(k) for k in by]
    sums = dealt.groupBy(*keys, "__range").agg(F.sum(n).alias("__n"))
    below = F.sum("__n").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*(k.alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__range").alias("__r"), F.coalesce(below, F.lit(0)).alias("__below"))  # RANGES rows a group
    inside = F.sum(n).over(Window.partitionBy(*keys, "__range").orderBy(_q(value)).rowsBetween(Window.unboundedPreceding, -1))
    ranked = dealt.withColumn("__inside", F.coalesce(inside, F.lit(0)))
    on = reduce(lambda a, b: a & b, (k.eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)), F.col("__range") == F.col("__r"))
    return ranked.join(offsets, on).select(*(_q(c) for c in counts.columns), (F.col("__below") + F.col("__inside")).alias("before"))


def quantiles(df: DataFrame, value: str, qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Per group (null keys are one) the interpolated quantiles ``q0, q1, …`` of a numeric column; NULLs are left out."""
    keys = [_q(k) for k in by]
    counts = stored(df.where(_q(value).isNotNull()).groupBy(*keys, _q(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("n")), "value-counts")
    ranked = before(counts, "__v", by=by)
    sizes = counts.groupBy(*(k.alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.sum("n").alias("__size"))
    on = reduce(lambda a, b: a & b, (k.eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)), F.lit(True))
    placed = ranked.join(sizes, on) if by else ranked.crossJoin(F.broadcast(sizes))  # one row
    out = []
    for i, q in enumerate(qs):
        at = F.lit(float(q)) * (F.col("__size") - 1)
        inside = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
        low, high = (F.max(F.when(inside(k), F.col("__v"))) for k in (F.floor(at), F.ceil(at)))
        share = F.max(at - F.floor(at))
        out.append((low + (high - low) * share).alias(f"q{i}"))
    return placed.groupBy(*keys).agg(*out)


def quantile(df: DataFrame, value: Column, q: float) -> float | None:
    """One interpolated quantile of all rows; None without a known value."""
    row = quantiles(df.select(value.alias("x")), "x", [q]).first()
    return row["q0"] if row else None


def order_statistic(df: DataFrame, value: str, k: int) -> int:
    """The value of 0-based rank ``k`` from below of a whole-number column."""
    counts = stored(df.where(_q(value).isNotNull()).groupBy(_q(value).alias("__v")).agg(F.count(F.lit(1)).alias("n")), "value-counts")
    return before(counts, "__v").where((F.col("before") <= k) & (F.col("before") + F.col("n") > k)).first()["__v"]


def spearman(pairs: DataFrame, weighted: bool = False) -> DataFrame:
    """One row ``correlation`` of the columns ``x, y`` by average ranks; rows where one is unknown are left out. ``weighted``: a row stands for ``n``."""
    times = F.sum("n") if weighted else F.count(F.lit(1))
    counts = stored(pairs.where("x is not null and y is not null").groupBy("x", "y").agg(times.alias("n")), "pair-counts")
    for c in ("x", "y"):
        ranks = before(counts.groupBy(c).agg(F.sum("n").alias("n")), c)
        counts = counts.join(ranks.select(F.col(c).alias(f"__{c}"), (F.col("before") + (F.col("n") + 1) / 2.0).alias(f"r{c}")), F.col(c) == F.col(f"__{c}"))
    x, y, n = F.col("rx"), F.col("ry"), F.col("n").cast("double")
    mean = counts.agg((F.sum(n * x) / F.sum(n)).alias("mx"), (F.sum(n * y) / F.sum(n)).alias("my"))
    a, b = x - F.col("mx"), y - F.col("my")
    sums = counts.crossJoin(F.broadcast(mean)).agg(F.sum(n * a * b).alias("ab"), F.sum(n * a * a).alias("aa"), F.sum(n * b * b).alias("bb"))  # one row
    return sums.select(F.try_divide(F.col("ab"), F.sqrt(F.col("aa")) * F.sqrt(F.col("bb"))).alias("correlation"))


def spearman_all(values: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``i, j, correlation`` for every two of the columns, by average ranks over the rows that know both.

    Rows are folded to distinct combinations. All columns are ranked in one pass, and one aggregate has the products of all pairs; the mean of
    average ranks is known beforehand. Ranks over the rows of a pair only differ where one column is unknown and the other is not;
    such pairs are ranked by themselves.
    """
    folded = stored(values.groupBy(*map(_q, columns)).agg(F.count(F.lit(1)).alias("__n")), "score-counts")
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    known = [_q(c).isNotNull() for c in columns]
    apart = folded.agg(*(F.max(known[i] != known[j]).alias(f"p{i}_{j}") for i, j in pairs)).first()
    alone = [(i, j) for i, j in pairs if apart[f"p{i}_{j}"]]
    together = [p for p in pairs if p not in alone]
    parts = []
    if together:
        stack = F.array(*(F.struct(F.lit(i).alias("column"), _q(columns[i]).cast("double").alias("x")) for i in sorted({k for p in together for k in p})))
        counts = stored(folded.select("__n", F.inline(stack)).where("x is not null").groupBy("column", "x").agg(F.sum("__n").alias("n")), "value-counts")
        ranks = before(counts, "x", by=["column"])
        ranked = folded
        for i in sorted({k for p in together for k in p}):
            own = ranks.where(F.col("column") == i).select(F.col("x").alias(f"__x{i}"), (F.col("before") + (F.col("n") + 1) / 2.0).alias(f"__r{i}"))
            ranked = ranked.join(own, _q(columns[i]).cast("double") == F.col(f"__x{i}"), "left")
        n = F.col("__n").cast("double")
        # average ranks of N rows have the mean (N + 1) / 2: sums of squares and products are taken about it afterwards
        sums = [F.sum(F.when(F.col(f"__r{i}").isNotNull() & F.col(f"__r{j}").isNotNull(), n)).alias(f"n{i}_{j}") for i, j in together]
        total = ranked.agg(F.max(F.lit(1)).alias("one"), *sums).first()
        shift = {p: ((total[f"n{p[0]}_{p[1]}"] or 0.0) + 1) / 2 for p in together}
        product = lambda i, j, m: F.sum(n * (F.col(f"__r{i}") - m) * (F.col(f"__r{j}") - m))
        rows = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.try_divide(product(i, j, shift[i, j]), F.sqrt(product(i, i, shift[i, j])) * F.sqrt(product(j, j, shift[i, j]))).alias("correlation")) for i, j in together]
        parts.append(ranked.agg(F.array(*rows).alias("r")).select(F.inline("r")))
    for i, j in alone:
        pair = folded.select(_q(columns[i]).alias("x"), _q(columns[j]).alias("y"), F.col("__n").alias("n"))
        parts.append(spearman(pair, weighted=True).select(F.lit(i).alias("i"), F.lit(j).alias("j"), "correlation"))
    return reduce(DataFrame.union, parts)


def pearson(pairs: DataFrame) -> DataFrame:
    return pairs.agg(correlation("x", "y").alias("correlation"))


def balance(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Weighted concordant minus discordant pairs of distinct points, in ``n log n``: one stable pass for each bit of the rank of y.

    In the order of x, two points part at the highest bit in which their y ranks differ: whoever has it unset is lower.
    """
    order = np.lexsort((y, x))
    x, n = x[order], n[order].astype(float)
    _, rank = np.unique(y[order], return_inverse=True)
    # points that share x are in the order of y and would count as concordant
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    tie = np.cumsum(new) - 1
    weight, square = np.bincount(tie, n), np.bincount(tie, n * n)
    total = -float((weight * weight - square).sum()) / 2
    for bit in range(int(rank.max()).bit_length() - 1, -1, -1) if len(rank) else ():
        prefix = rank >> (bit + 1)
        by_prefix = np.argsort(prefix, kind="stable")
        one = (rank[by_prefix] >> bit & 1).astype(bool)
        w = n[by_prefix]
        start = np.concatenate(([0], np.flatnonzero(np.diff(prefix[by_prefix])) + 1))
        group = np.zeros(len(w), np.int64)
        group[start] = 1
        group = np.cumsum(group) - 1
        zeros, ones = np.cumsum(np.where(one, 0.0, w)), np.cumsum(np.where(one, w, 0.0))
        base_zeros, base_ones = zeros[start] - np.where(one[start], 0.0, w[start]), ones[start] - np.where(one[start], w[start], 0.0)
        total += float((w * (zeros - base_zeros[group]))[one].sum()) - float((w * (ones - base_ones[group]))[~one].sum())
    return total


def _blocks(counts: DataFrame, value: str, size: int) -> DataFrame:
    """``__v, __b``: for each value its block of about ``size`` points; a value that fills one alone gets an odd number."""
    per = stored(counts.groupBy(_q(value).alias("__v")).agg(F.count(F.lit(1)).alias("n")), "axis")
    at = (F.floor(F.col("before") / size) * 2 + (F.col("n") >= size).cast("int")).cast("long")
    return before(per, "__v").select("__v", at.alias("__b"))


def _balances(points: DataFrame, block: str, x: str, y: str, odd: bool) -> DataFrame:
    def one(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [balance(p["x"].to_numpy(), p["y"].to_numpy(), p["n"].to_numpy())]})

    rows = points if odd else points.where(_q(block) % 2 == 0)  # points of one value are tied: nothing to count
    return rows.select(_q(block).alias("b"), _q(x).cast("double").alias("x"), _q(y).cast("double").alias("y"), "n").groupBy("b").applyInPandas(one, "s double")


def _balance_of(counts: DataFrame, size: int) -> float:
    """Concordant minus discordant pairs of a table of distinct points ``x, y, n``.

    Small tables are one block. Others are cut into blocks along both axes: pairs in one x block are compared there, pairs in
    one y block but different x blocks there by their x block, and all others differ in both blocks: the same question again
    over the far fewer pairs of blocks.
    """
    if counts.limit(size + 1).count() <= size:
        return _balances(counts.withColumn("b", F.lit(0)), "b", "x", "y", True).agg(F.sum("s")).first()[0] or 0.0
    placed = counts
    for axis in ("x", "y"):
        places = _blocks(counts, axis, size)
        placed = placed.join(places.select(F.col("__v").alias(f"__{axis}"), F.col("__b").alias(f"b{axis}")), F.col(axis) == F.col(f"__{axis}"))
    placed = stored(placed.select("x", "y", "n", "bx", "by"), "placed-pairs")
    inside = _balances(placed, "bx", "x", "y", False).agg(F.sum("s")).first()[0] or 0.0
    strip = placed.groupBy("by", F.col("bx").alias("x"), "y").agg(F.sum("n").alias("n"))
    across = _balances(strip, "by", "x", "y", False).agg(F.sum("s")).first()[0] or 0.0
    coarse = stored(placed.groupBy(F.col("bx").alias("x"), F.col("by").alias("y")).agg(F.sum("n").alias("n")), "coarse-pairs")
    return inside + across + _balance_of(coarse, size)


def kendall(pairs: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row ``correlation``: tau-b of the columns ``x, y``, exact for any number of distinct pairs."""
    counts = stored(pairs.where("x is not null and y is not null").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return counts.sparkSession.createDataFrame([(None,)], "correlation double")
    different = {}
    for axis in ("x", "y"):
        squares = counts.groupBy(axis).agg(F.sum("n").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0]
        different[axis] = (float(total) ** 2 - squares) / 2
    base = (different["x"] ** 0.5) * (different["y"] ** 0.5)
    return counts.sparkSession.createDataFrame([(_balance_of(counts, size) / base if base else None,)], "correlation double")


def rank_correlation(pairs: DataFrame, method: str) -> DataFrame:
    """One row ``correlation`` of the columns ``x, y``."""
    return {"pearson": pearson, "spearman": spearman, "kendall": kendall}[method](pairs)
