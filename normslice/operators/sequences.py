"""Order within cases: runs, returns, states, durations; and the audits that come before scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normslice.errors import LogSchemaError
from normslice.functions.core import duration
from normslice.operators.scoring import q


def _stretches(events: DataFrame, case: str, order: Sequence[str], value: str, stretches: int) -> tuple[DataFrame, DataFrame]:
    """Heads of the runs inside each stretch (``_run`` counts them, ``_n`` is their length), and a summary for each case and stretch.

    Stretches are ranges of (case, order), so a giant case is many of them and equal places are never parted.
    """
    dealt = events.repartitionByRange(stretches, q(case), *(q(o) for o in order)).withColumn("_stretch", F.spark_partition_id())
    w = Window.partitionBy(q(case), "_stretch").orderBy(*(q(o) for o in order))
    peers = Window.partitionBy(q(case), "_stretch", *(q(o) for o in order))
    placed = dealt.select(q(case), "_stretch", q(value).alias("_v"), *(q(o).alias(f"_o{i}") for i, o in enumerate(order)), F.row_number().over(w).alias("_row"), F.lag(q(value)).over(w).alias("_before"), (F.count(F.lit(1)).over(peers) > 1).alias("_tied"))
    w = Window.partitionBy(q(case), "_stretch").orderBy("_row")
    marked = placed.withColumn("_run", F.sum(((F.col("_row") == 1) | ~F.col("_v").eqNullSafe(F.col("_before"))).cast("int")).over(w))
    each = marked.groupBy(q(case), "_stretch", "_run").agg(F.first("_v").alias("_v"), F.count(F.lit(1)).alias("_n"), F.max("_tied").alias("_tied"))
    by_run = Window.partitionBy(q(case), "_stretch").orderBy("_run")
    last = Window.partitionBy(q(case), "_stretch").orderBy(F.col("_run").desc())
    heads = each.select("*", F.lag("_v", 2).over(by_run).alias("_two"), F.row_number().over(last).alias("_back"))
    at = lambda place, k: F.max(F.when(F.col(place) == k, F.struct(F.col("_v").alias("v"))))  # noqa: E731  a struct, so that a NULL value is not an absent run
    summary = heads.groupBy(q(case), "_stretch").agg(
        F.count(F.lit(1)).alias("r"), F.count_if((F.col("_run") > 2) & F.col("_v").eqNullSafe(F.col("_two"))).alias("back"), F.max("_tied").alias("tied"), at("_run", 1).alias("v1"), at("_run", 2).alias("v2"), at("_back", 1).alias("z1"), at("_back", 2).alias("z2")
    )
    return heads, summary


def _then(a: Column, b: Column) -> Column:
    """The summary of two stretches that follow each other. It is associative: any grouping of a case's stretches gives the same."""
    same = lambda x, y: x.isNotNull() & y.isNotNull() & x.eqNullSafe(y)
    joined = same(a["z1"], b["v1"])
    one = lambda condition: condition.cast("long")
    across = F.when(joined, one(same(a["z2"], b["v2"]))).otherwise(one(same(a["z2"], b["v1"])) + one(same(a["z1"], b["v2"])))
    return F.struct(
        (a["r"] + b["r"] - one(joined)).alias("r"),
        (a["back"] + b["back"] + across).alias("back"),
        (a["tied"] | b["tied"]).alias("tied"),
        a["v1"].alias("v1"),
        F.when(a["r"] > 1, a["v2"]).when(joined, b["v2"]).otherwise(b["v1"]).alias("v2"),
        b["z1"].alias("z1"),
        F.when(b["r"] > 1, b["z2"]).when(joined, a["z2"]).otherwise(a["z1"]).alias("z2"),
    )


def runs(events: DataFrame, case: str, order: Sequence[str], value: str, stretches: int | None = None) -> DataFrame:
    """Run-length form of a value along each case: ``case, run, value, length``; NULL values stand for themselves.

    ``stretches``: cases may be giant, and are cut into so many ranges of the whole log; else a case is one task's work.
    """
    if stretches:
        heads, summary = _stretches(events, case, order, value, stretches)
        in_case = Window.partitionBy(q(case)).orderBy("_stretch")  # a row for each stretch
        goes_on = F.coalesce(F.lag("z1").over(in_case).eqNullSafe(F.col("v1")) & F.lag("z1").over(in_case).isNotNull(), F.lit(False))
        counted = summary.select(q(case).alias("_case"), F.col("_stretch").alias("_s"), "r", goes_on.cast("long").alias("on"))
        ahead = Window.partitionBy("_case").orderBy("_s")
        offsets = counted.select("_case", "_s", (F.coalesce(F.sum("r").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.sum("on").over(ahead)).alias("_more"))
        numbered = heads.join(offsets, q(case).eqNullSafe(F.col("_case")) & (F.col("_stretch") == F.col("_s")))
        return numbered.groupBy(q(case), (F.col("_run") + F.col("_more")).alias("run"), F.col("_v").alias(value)).agg(F.sum("_n").alias("length"))
    w = Window.partitionBy(q(case)).orderBy(*(q(o) for o in order))
    first = F.row_number().over(w) == 1
    change = first | ~q(value).eqNullSafe(F.lag(q(value)).over(w))
    marked = events.withColumn("_change", change.cast("int"))
    marked = marked.withColumn("_run", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(q(case), F.col("_run").alias("run"), q(value)).agg(F.count(F.lit(1)).alias("length"))


def returns(events: DataFrame, case: str, order: Sequence[str], value: str, stretches: int | None = None) -> DataFrame:
    """Per case: changes of the value, and returns A-B-A over its runs; ties in the order make both unknown.

    ``stretches`` as in ``runs``: stretches are summed up where they lie, and a case folds its few summaries in order.
    """
    if stretches:
        _, summary = _stretches(events, case, order, value, stretches)
        parts = F.sort_array(F.collect_list(F.struct("_stretch", "r", "back", "tied", "v1", "v2", "z1", "z2")))  # one for each stretch at most
        plain = lambda x: F.struct(*(x[c].alias(c) for c in ("r", "back", "tied", "v1", "v2", "z1", "z2")))
        folded = summary.groupBy(q(case)).agg(parts.alias("_p")).select(q(case), F.aggregate(F.slice("_p", F.lit(2), F.size("_p")), plain(F.col("_p")[0]), lambda a, b: _then(a, b)).alias("_x"))
        known = ~F.col("_x.tied")
        return folded.select(q(case), F.when(known, F.col("_x.r") - 1).alias("n_changes"), F.when(known, F.col("_x.back")).alias("n_returns"))
    w = Window.partitionBy(q(case)).orderBy(*(q(o) for o in order))
    peers = Window.partitionBy(q(case), *(q(o) for o in order))
    tied = events.select("*", F.count(F.lit(1)).over(peers).alias("_n")).groupBy(q(case).alias("_case")).agg((F.max("_n") > 1).alias("_tied"))
    changed = events.withColumn("_before", F.lag(q(value)).over(w)).withColumn("_row", F.row_number().over(w))
    heads = changed.where((F.col("_row") == 1) | ~q(value).eqNullSafe(F.col("_before")))
    back = heads.withColumn("_two", F.lag(q(value), 2).over(w)).withColumn("_k", F.row_number().over(w))
    counts = back.groupBy(q(case)).agg((F.count(F.lit(1)) - 1).alias("n_changes"), F.count_if((F.col("_k") > 2) & q(value).eqNullSafe(F.col("_two"))).alias("n_returns"))
    out = counts.join(tied, q(case) == F.col("_case"))
    return out.select(q(case), *(F.when(~F.col("_tied"), F.col(c)).alias(c) for c in ("n_changes", "n_returns")))


def repeated_states(events: DataFrame, case: str, state: str) -> DataFrame:
    """Per case: events beyond the first of each state."""
    return events.where(q(state).isNotNull()).groupBy(q(case), q(state)).agg(F.count(F.lit(1)).alias("n")).groupBy(q(case)).agg(F.sum(F.col("n") - 1).alias("n_repeated"))


def active_after(events: DataFrame, case: str, order: str, state: str, final: str) -> DataFrame:
    """Per case: does anything follow the last event of the final state; NULL if the state is never reached."""
    last = F.max(F.when(q(state) == final, q(order)))
    return events.groupBy(q(case)).agg(F.when(last.isNotNull(), F.max(q(order)) > last).alias("active_after"))


def constant_in_case(events: DataFrame, case: str, column: str) -> DataFrame:
    """Per case the column's value if all events have the same known one, else NULL."""
    c = q(column)
    return events.groupBy(q(case)).agg(F.when((F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c)), F.min(c)).alias(column))


def counter_total(events: DataFrame, case: str, column: str) -> DataFrame:
    """Per case the end of a cumulative counter: its maximum, if every event has a valid non-negative number."""
    x = q(column).try_cast("double")
    return events.groupBy(q(case)).agg(F.when(F.bool_and(F.coalesce(x >= 0, F.lit(False))), F.max(x)).alias(column))


def span(events: DataFrame, case: str, act: str, us: str, start: Sequence[str], end: Sequence[str], unit: str = "D") -> DataFrame:
    """Per case: first start to last end, with a state that says what is missing."""
    a, b = F.min(F.when(q(act).isin(list(start)), q(us))), F.max(F.when(q(act).isin(list(end)), q(us)))
    pair = events.groupBy(q(case)).agg(a.alias("_a"), b.alias("_b"))
    state = F.when(F.col("_a").isNull() & F.col("_b").isNull(), "no_evidence").when(F.col("_a").isNull(), "no_start").when(F.col("_b").isNull(), "no_end").when(F.col("_b") < F.col("_a"), "reversed").otherwise("measured")
    return pair.select(q(case), F.when(state == "measured", duration(F.col("_a"), F.col("_b"), unit)).alias("span"), state.alias("state"))


def first_interval(events: DataFrame, case: str, act: str, us: str, start: Sequence[str], end: Sequence[str], unit: str = "D") -> DataFrame:
    """Per case: first start to first end, with its state. Without a start the interval is out of scope; a start or end without an
    instant makes it invalid, and no later one repairs that."""
    is_start, is_end = (q(act).isin(list(x)) for x in (start, end))
    found = events.groupBy(q(case)).agg(F.min(F.when(is_start, q(us))).alias("_a"), F.min(F.when(is_end, q(us))).alias("_b"), F.count_if(is_start).alias("_n"), F.count_if((is_start | is_end) & q(us).isNull()).alias("_bad"))
    state = F.when(F.col("_n") == 0, "out_of_scope").when(F.col("_bad") > 0, "invalid").when(F.col("_b").isNull(), "no_end").when(F.col("_b") < F.col("_a"), "reversed").otherwise("measured")
    return found.select(q(case), F.when(state == "measured", duration(F.col("_a"), F.col("_b"), unit)).alias("span"), state.alias("state"))


def band(value: Column, limits: Sequence[float], names: Sequence[str]) -> Column:
    """The name of the first limit that the value lies under; the last name at or above all limits."""
    out = F.lit(names[-1])
    for limit, name in reversed(list(zip(limits, names, strict=False))):
        out = F.when(value < limit, F.lit(name)).otherwise(out)
    return F.when(value.isNotNull(), out)


def period_labels(ts: Column) -> dict[str, Column]:
    """``quarter`` and ``month`` labels of a time."""
    return {"quarter": F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string")), "month": F.date_format(ts, "yyyy-MM")}


def breadth(events: DataFrame, case: str, act: str, resource: str) -> DataFrame:
    """Per case: repeated activities and distinct resources, from one two-level aggregate."""
    cells = events.groupBy(q(case), q(act)).agg(F.count(F.lit(1)).alias("n"), F.collect_set(q(resource)).alias("r"))
    return cells.groupBy(q(case)).agg(F.sum(F.col("n") - 1).alias("n_repeats"), F.size(F.array_distinct(F.flatten(F.collect_list("r")))).alias("n_resources"))


def same_sets(left: DataFrame, right: DataFrame, case: str, column: str) -> DataFrame:
    """Per case: do both sides name the same set of values."""
    made = lambda df, name: df.where(q(column).isNotNull()).groupBy(q(case).alias(f"_{name}")).agg(F.array_sort(F.collect_set(q(column))).alias(name))
    both = made(left, "l").join(made(right, "r"), F.col("_l") == F.col("_r"), "full_outer")
    return both.select(F.coalesce("_l", "_r").alias(case), F.coalesce(F.col("l") == F.col("r"), F.lit(False)).alias("same"))


def project_objects(links: DataFrame, focus: str, other: str) -> DataFrame:
    """Event-object links ``event_id, object_id, object_type`` to one row per focus object: events, and most events of one linked object."""
    a = links.where(F.col("object_type") == focus).select("event_id", F.col("object_id").alias("case_id"))
    b = links.where(F.col("object_type") == other).select(F.col("event_id").alias("_event"), F.col("object_id").alias("_other"))
    pairs = a.join(b, F.col("event_id") == F.col("_event"), "left").groupBy("case_id", "_other").agg(F.count_distinct("event_id").alias("n"))
    per = pairs.groupBy("case_id").agg(F.count("_other").alias("n_linked"), F.coalesce(F.max(F.when(F.col("_other").isNotNull(), F.col("n"))), F.lit(0)).alias("max_events_of_one"))
    events = a.groupBy(F.col("case_id").alias("_case")).agg(F.count_distinct("event_id").alias("n_events"))
    return events.join(per, F.col("_case") == F.col("case_id")).select("case_id", "n_events", "n_linked", "max_events_of_one")


def case_universe(master: DataFrame, activity: DataFrame, on: str) -> DataFrame:
    """All keys of either side with flags, by a full outer join of distinct keys."""
    a, b = master.select(q(on).alias("_a")).distinct(), activity.select(q(on).alias("_b")).distinct()
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(on), F.col("_a").isNotNull().alias("in_master"), F.col("_b").isNotNull().alias("in_activity"))


def referential_audit(master: DataFrame, activity: DataFrame, on: str) -> DataFrame:
    """One row: master keys without activity, activity keys without master, keys in both."""
    u = case_universe(master, activity, on)
    return u.agg(F.count_if(~F.col("in_activity")).alias("master_only"), F.count_if(~F.col("in_master")).alias("orphans"), F.count_if(F.col("in_master") & F.col("in_activity")).alias("matched"))


def label_sets(events: DataFrame, case: str, column: str, separator: str = " + ") -> DataFrame:
    """Per case the sorted distinct labels as one text."""
    return events.groupBy(q(case)).agg(F.array_join(F.array_sort(F.collect_set(q(column))), separator).alias("label_set"))


def extra_observations(events: DataFrame, case: str, act: str, excluded: Sequence[str] = ()) -> DataFrame:
    """Per case: observations beyond the first of each activity outside an excluded set."""
    cells = events.groupBy(q(case), q(act)).agg(F.count(F.lit(1)).alias("n"))
    counts = ~F.coalesce(q(act).isin(list(excluded)), F.lit(False)) if excluded else F.lit(True)
    return cells.groupBy(q(case)).agg(F.sum(F.when(counts, F.col("n") - 1).otherwise(0)).alias("n_extra"))


def disjoint_union(parts: Sequence[DataFrame], on: str) -> DataFrame:
    """The union of frames whose key sets must not meet (checked by one aggregate)."""
    marked = reduce(DataFrame.unionByName, (p.select(q(on)).distinct() for p in parts))
    if marked.groupBy(q(on)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        raise LogSchemaError(f"the parts share values of {on!r}")
    return reduce(DataFrame.unionByName, parts)


def is_subset(part: DataFrame, whole: DataFrame) -> DataFrame:
    """One row: how many rows of ``part`` (with multiplicity) ``whole`` lacks."""
    return part.exceptAll(whole.select(*part.columns)).agg(F.count(F.lit(1)).alias("n_missing"))


def relabel(column: Column, mapping: Mapping[str, str]) -> Column:
    """A label mapped through a dictionary; labels without an entry stay."""
    out = column
    for old, new in mapping.items():
        out = F.when(column == old, F.lit(new)).otherwise(out)
    return out
