"""Queries of norm documents, of readers and writers (round trips through files), and of a purchase-to-pay norm end to end."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from normslice.functions.shared import shared_path
from normslice.operators.backlog import prioritize
from normslice.operators.scoring import score
from normslice.plans.constraints import Presence
from normslice.plans.norm import Layer, Norm, NormConstraint, View
from normslice.queries.logs import DAYS, ORDERS, ROLES, events, order_log, query, r, sat, table, user_days
from normslice.queries.reports import S_LB, _tail, backlog_sql, result
from normslice.sources import formats
from normslice.sources.eventlog import EventLog

# a norm document with all kinds of constraints and recipes, over the order log

SHIPPED = ["ship_A", "ship_N", "ship_R"]
FLOWS = ["F", "O", "P"]
TOUCH = {"column": "act", "regex": "(?i)^(?!(?:place|none|\\s*$))ship_[rn]"}
LAYER_WEIGHTS = {"Finance": {"closure": 0.3, "flow": 0.1, "time": 0.25, "rework": 0.1, "value": 0.2, "effort": 0.05}, "Control": {"closure": 0.1, "flow": 0.4, "time": 0.1, "rework": 0.2, "value": 0.2}}
#: id: layer, type, parameters, weight in the layer, statuses that it applies to
BODY = {
    "returned_or_accepted": ("closure", "pres", {"activity": ["ship_A", "ship_R"], "m": 1}, 1.2, ["F", "P"]),
    "shipped_twice": ("closure", "presence", {"activity": "ship_N", "m": "2"}, 1.4, ["O", "P"]),
    "ship_after_place": ("flow", "order", {"a": "place", "b": SHIPPED, "k": 0, "K": 2, "missing_a": "skip", "missing_b": "skip"}, 1.0, FLOWS),
    "no_return": ("flow", "excl", {"activity": "ship_R", "after": None, "before": None}, 0.8, ["F", "O"]),
    "place_to_ship": ("time", "lag", {"a": "place", "b": SHIPPED, "delta": 30, "width": 60, "unit": "D", "missing": "skip", "response": "first_overall"}, 1.5, FLOWS),
    "accept_to_return": ("time", "lag", {"a": "ship_A", "b": "ship_R", "delta": 10, "width": "20", "missing_a": "skip"}, 1.0, ["F"]),
    "fragments": ("rework", "sing", {"activity": SHIPPED, "k": 2, "K": 3}, 1.2, FLOWS),
    "amounts": ("value", "bal", {"attr_x": "amount", "activities_x": "ship_A", "attr_y": "amount", "activities_y": "ship_R", "tau": 0.05, "width": 0.5}, 1.0, ["F"]),
    "dear_return": ("value", "metric", {"attribute": "return_x_size", "threshold": 0, "width": 1}, 1.2, FLOWS),
    "volatility": ("value", "metric", {"attribute": "amount_cv", "threshold": 0.5, "width": 1}, 1.0, FLOWS),
    "touches": ("effort", "metric", {"attribute": "touches", "threshold": 2, "width": 3}, 1.4, FLOWS),
    "kinds": ("effort", "metric", {"attribute": "kinds", "threshold": 1, "width": 1}, 1.1, FLOWS),
    "length": ("effort", "metric", {"attribute": "length", "threshold": 4, "width": 4}, 1.0, FLOWS),
    "touch_share": ("effort", "metric", {"attribute": "touch_share", "threshold": 0.5, "width": 0.5}, 0.9, FLOWS),
}
DOCUMENT = {
    "schema_version": 2,
    "name": "orders to shipping",
    "version": "1.0",
    "description": "flow-aware: what applies hangs on the order's status",
    "scoring_mode": "layer_balanced",
    "metadata": {"primary_slice": ["o_orderstatus", "c_mktsegment"]},
    "layers": {x: {"name": x.title(), "description": ""} for x in LAYER_WEIGHTS["Finance"]},
    "views": [{"name": v, "description": f"what {v.lower()} minds", "layer_weights": w} for v, w in LAYER_WEIGHTS.items()],
    "derived_attributes": [
        {"name": "touches", "kind": "count_events", "where": TOUCH},
        {"name": "kinds", "kind": "nunique", "column": "act", "where": TOUCH},
        {"name": "length", "kind": "eval", "expr": "n_events"},
        {"name": "touch_share", "kind": "ratio", "numerator": "touches", "denominator": "n_events"},
        {"name": "amount_cv", "kind": "cv", "column": "amount"},
        {"name": "size", "kind": "quantile_scale", "attribute": "exposure"},
        {"name": "return_x_size", "kind": "indicator_times", "activities": ["ship_R"], "attribute": "size"},
    ],
    "constraints": [{"id": c, "layer": layer, "type": t, "params": p, "weight": w, "applicability": {"o_orderstatus": on}, "description": c.replace("_", " ")} for c, (layer, t, p, w, on) in BODY.items()],
}

_V = {
    "returned_or_accepted": "CASE WHEN na + nr > 0 THEN 0.0 ELSE 1.0 END",
    "shipped_twice": "1 - least(nn / 2.0, 1)",
    "ship_after_place": f"CASE WHEN na + nr + nn > 0 AND p1 IS NOT NULL THEN {sat('CAST(eb AS DOUBLE)', 0.0, 2.0)} END",
    "no_return": "CASE WHEN nr > 0 THEN 1.0 ELSE 0.0 END",
    "place_to_ship": sat("CASE WHEN s1 >= p1 THEN (s1 - p1) / 1e6 / 86400.0 END", 30.0, 60.0),
    "accept_to_return": f"CASE WHEN a1 IS NOT NULL THEN coalesce({sat('(ra - a1) / 1e6 / 86400.0', 10.0, 20.0)}, 1.0) END",
    "fragments": sat("CAST(na + nr + nn AS DOUBLE)", 2.0, 3.0),
    "amounts": sat("abs(xa - xr) / greatest(xa, xr, 1e-9)", 0.05, 0.5),
    "dear_return": sat("CASE WHEN nr > 0 THEN least(greatest(mx / q95, 0), 1) ELSE 0.0 END", 0.0, 1.0),
    "volatility": sat("coalesce(sd, 0) / greatest(abs(mean), 1e-9)", 0.5, 1.0),
    "touches": sat("CAST(nn + nr AS DOUBLE)", 2.0, 3.0),
    "kinds": sat("CAST((CASE WHEN nn > 0 THEN 1 ELSE 0 END) + (CASE WHEN nr > 0 THEN 1 ELSE 0 END) AS DOUBLE)", 1.0, 1.0),
    "length": sat("CAST(n_events AS DOUBLE)", 4.0, 4.0),
    "touch_share": sat("(nn + nr) / n_events", 0.5, 0.5),
}


def _scores() -> str:
    """SQL of the document's layer-balanced scores, from weights in the table above."""
    columns = []
    for view, of_layer in LAYER_WEIGHTS.items():
        penalties, actives = [], []
        for layer, a in of_layer.items():
            ids = {c: b[3] for c, b in BODY.items() if b[0] == layer}
            live = " + ".join(f"(CASE WHEN {c} IS NULL THEN 0.0 ELSE {w!r} END)" for c, w in ids.items())
            lost = " + ".join(f"coalesce({c}, 0.0) * {w!r}" for c, w in ids.items())
            actives.append(f"(CASE WHEN {live} > 0 THEN {a!r} ELSE 0.0 END)")
            penalties.append(f"(CASE WHEN {live} > 0 THEN {a!r} * ({lost}) / nullif({live}, 0) ELSE 0.0 END)")
        active = " + ".join(actives)
        columns.append(f"CASE WHEN {active} > 0 THEN 1 - ({' + '.join(penalties)}) / nullif({active}, 0) END AS score_{view}")
    return ", ".join(columns)


_ORDER_SCORES = f"""{ORDERS},
g AS (SELECT case_id, any_value(o_orderstatus) AS o_orderstatus, any_value(c_mktsegment) AS c_mktsegment, count(*) AS n_events, min(us) FILTER (act = 'place') AS p1, min(us) FILTER (act <> 'place') AS s1, min(us) FILTER (act = 'ship_A') AS a1,
  count(*) FILTER (act = 'ship_A') AS na, count(*) FILTER (act = 'ship_R') AS nr, count(*) FILTER (act = 'ship_N') AS nn, coalesce(sum(amount) FILTER (act = 'ship_A'), 0) AS xa, coalesce(sum(amount) FILTER (act = 'ship_R'), 0) AS xr,
  max(amount) AS mx, stddev_samp(amount) AS sd, avg(amount) AS mean FROM ev GROUP BY case_id),
k AS (SELECT case_id, min(us) FILTER (act = 'ship_R' AND us >= a1) AS ra, count(*) FILTER (act <> 'place' AND us < p1) AS eb FROM ev JOIN (SELECT case_id, a1, p1 FROM g) USING (case_id) GROUP BY case_id),
z AS (SELECT quantile_cont(mx, 0.95) AS q95 FROM g),
v AS (SELECT case_id, o_orderstatus, c_mktsegment, {', '.join('CASE WHEN o_orderstatus IN (%s) THEN %s END AS %s' % (', '.join(f"'{x}'" for x in BODY[c][4]), sql, c) for c, sql in _V.items())} FROM g JOIN k USING (case_id), z),
s AS (SELECT *, {_scores()} FROM v)"""


def document_scores(spark, d):
    log = order_log(spark, d, exposure_col="amount", exposure_agg="max")
    return score(log, Norm.loads(json.dumps(DOCUMENT)))


@query("norm_document_scores", f"WITH {_ORDER_SCORES} SELECT case_id, {', '.join(f'{r(c)} AS v__{c}' for c in _V)}, {r('score_Finance')} AS score__Finance, {r('score_Control')} AS score__Control FROM s")
def _(spark, d):
    return document_scores(spark, d).table.select("case_id", *(f"v__{c}" for c in BODY), "score__Finance", "score__Control")


@query("norm_document_backlog", f"WITH {backlog_sql(['o_orderstatus', 'c_mktsegment'], view='Control', gamma=20, base=_ORDER_SCORES)} {_tail(['o_orderstatus', 'c_mktsegment'])}")
def _(spark, d):
    return prioritize(document_scores(spark, d), ["o_orderstatus", "c_mktsegment"], view="Control", gamma=20)




@query("norm_weight_table", f"WITH c AS (SELECT event_type AS a, count(*) AS n FROM events GROUP BY event_type), l AS (SELECT a, n, CASE WHEN a < 'm' THEN 'early' ELSE 'late' END AS layer FROM c), s AS (SELECT layer, sum(n) AS n FROM l GROUP BY layer) SELECT l.a AS \"constraint\", l.layer, v.view, {r('CASE v.view WHEN 1 THEN l.n ELSE (CASE l.layer WHEN $$early$$ THEN 3 ELSE 1 END) * l.n / s.n END')} AS weight FROM l JOIN s USING (layer), (VALUES (1), (2)) v(view)".replace("v.view, round", "CASE v.view WHEN 1 THEN 'own' ELSE 'layered' END AS view, round"))
def _(spark, d):
    """The weights of a norm that asks for every activity of the log, by how often it occurs."""
    found = {x["event_type"]: x["count"] for x in table(spark, d, "events").groupBy("event_type").count().collect()}  # the process's activities
    layer = lambda a: "early" if a < "m" else "late"
    made = Norm(
        tuple(NormConstraint(a, layer(a), Presence(a), float(n)) for a, n in found.items()), tuple(Layer(x) for x in sorted({layer(a) for a in found})),
        (View("own", constraint_weights={a: float(n) for a, n in found.items()}), View("layered", layer_weights={"early": 3.0, "late": 1.0})),
    )
    return spark.createDataFrame(made.weight_table(), "constraint string, layer string, view string, weight double")


# readers and writers: what was written must come back

_CASES = f"WITH {DAYS} SELECT case_id, count(*) AS n_events, min(ts) AS first_ts, {r('sum(value)')} AS exposure FROM ev GROUP BY case_id"


def _written(spark, d, fmt, end):
    path = shared_path(spark, fmt) + end
    events(spark, d).drop("props").write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").format(fmt).save(path)
    return path


for _fmt, _end in (("csv", ""), ("parquet", ".parquet")):

    @query(f"src_read_{_fmt}", _CASES)
    def _(spark, d, fmt=_fmt, end=_end):
        schema = "case string, event_type string, ts timestamp_ntz, event_id long, value double, segment string, weekday string, user_id long" if fmt == "csv" else None
        options = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"} if fmt == "csv" else {}
        log = formats.read_log(spark, _written(spark, d, fmt, end), schema=schema, read_options=options, **ROLES, exposure_col="value", exposure_agg="sum", validate=False)
        return log.cases.select("case_id", "n_events", "first_ts", "exposure")


@query("src_read_xes", f"WITH {DAYS} SELECT case_id, any_value(segment) AS segment, count(*) AS n_events, min(ts) AS first_ts, count(DISTINCT act) AS n_labels FROM ev GROUP BY case_id")
def _(spark, d):
    path = shared_path(spark, "xes")
    formats.write_xes(events(spark, d), path, case_col="case", activity_col="event_type", timestamp_col="ts", case_attributes=["segment"], order=["event_id"])
    rows = formats.read_xes(spark, path, ["segment"], strict=True)
    log = EventLog(rows, case_attributes=["case:segment"], order_col="event_position", validate=False)
    return log.cases.withColumnRenamed("case:segment", "segment").join(
        rows.groupBy(F.col("`case:concept:name`").alias("_c")).agg(F.count_distinct("`concept:name`").alias("n_labels")), F.col("case_id") == F.col("_c")
    ).select("case_id", "segment", "n_events", "first_ts", "n_labels")


@query("src_read_strings", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment FROM customer")
def _(spark, d):
    path = shared_path(spark, "strings")
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias(" c_custkey "), F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")).alias("c_mktsegment "))
    c.write.options(header=True, encoding="ISO-8859-1", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return formats.read_strings(spark, path, ["c_custkey", "c_mktsegment"]).drop("source_file")


@query("src_catalogue", "SELECT CAST(c_nationkey AS VARCHAR) AS nation, CAST(strlen(t) AS BIGINT) AS bytes, sha256(t) AS sha256 FROM (SELECT c_nationkey, string_agg(c_name || chr(10), '' ORDER BY c_custkey) AS t FROM customer GROUP BY c_nationkey)")
def _(spark, d):
    """A file for each nation's customers, catalogued by size and digest."""
    path = shared_path(spark, "catalogue")
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("value"), F.col("c_nationkey").alias("nation"))
    rows.repartition("nation").sortWithinPartitions("nation", "c_custkey").select("value", "nation").write.partitionBy("nation").text(path)
    found = formats.catalogue(spark, path).where("relative like '%.txt'")
    return found.select(F.regexp_extract("relative", "nation=([0-9]+)/", 1).alias("nation"), "bytes", "sha256")


@query("src_catalogue_damage", "SELECT 'nation=' || c_nationkey AS want_path FROM (SELECT DISTINCT c_nationkey FROM customer) WHERE c_nationkey % 5 = 1 UNION ALL SELECT 'gone.txt'")
def _(spark, d):
    """Of the catalogued files, those that differ from what was expected, and one that is missing."""
    path = shared_path(spark, "catalogue")
    rows = table(spark, d, "customer").select(F.col("c_name").alias("value"), F.col("c_nationkey").alias("nation"))
    rows.repartition("nation").write.partitionBy("nation").text(path)
    found = formats.catalogue(spark, path).where("relative like '%.txt'").withColumn("relative", F.substring_index("relative", "/", 1))
    damaged = F.split_part("relative", F.lit("="), F.lit(2)).cast("int") % 5 == 1
    expected = found.select(F.col("relative").alias("path"), F.when(damaged, F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"))
    return formats.verify(found, expected.union(spark.createDataFrame([("./gone.txt", "0")], "path string, sha256 string"))).select("want_path")


@query("sink_cases", f"WITH {S_LB} SELECT case_id, {r('score_Ops')} AS score__Ops, {r('d_Finance_match')} AS contrib__Finance__match FROM s")
def _(spark, d):
    path = shared_path(spark, "cases")
    formats.write_cases(result(spark, d), path)
    return spark.read.parquet(path).select("case_id", "score__Ops", "contrib__Finance__match")


@query("sink_backlog", f"WITH {backlog_sql(['segment'], gamma=20)} SELECT segment, n_cases, {r('stable_PI')} AS stable_PI FROM b")
def _(spark, d):
    path = shared_path(spark, "backlog")
    formats.write_backlog(prioritize(result(spark, d), "segment", gamma=20), path)
    return spark.read.option("header", True).csv(path).select("segment", F.col("n_cases").cast("long").alias("n_cases"), F.col("stable_PI").cast("double").alias("stable_PI"))
