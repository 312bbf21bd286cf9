"""Rules of whole domains end to end: incidents, loans, order items; measures of cases, ramps, scopes, reasons, scores, priorities."""

from __future__ import annotations

from pyspark.sql import functions as F

from normslice.operators import assessments as A
from normslice.operators import criteria as C
from normslice.operators import sequences as S
from normslice.operators.scoring import first_examples, reason_profile
from normslice.queries.logs import DAYS, ORDERS, order_log, query, r, sat, table, user_days

#: id: measure, threshold, width, weights in the two views; the SQL of scope and reasons stands beside the Spark form below
INCIDENTS = {"changes": ("n_changes", 1, 2, 2, 1), "returns": ("n_returns", 0, 2, 3, 1), "repeated": ("n_repeated", 0, 3, 1, 0), "waits": ("n_waits", 0, 1, 1, 2), "span": ("span", 1, 6, 2, 4), "reopened": ("reopened", 0, 1, 1, 3)}
LOANS = {"span": ("span", 30, 30, 3, 1), "repeats": ("n_repeats", 0, 5, 1, 1), "breadth": ("n_resources", 2, 5, 1, 2), "offers": ("n_offers", 1, 3, 1, 0), "incomplete": ("n_open", 0, 3, 2, 2)}
ITEMS = {"slip": ("slip", 30, 60, 2, 1), "redated": ("n_redated", 0, 3, 1, 2), "shortfall": ("shortfall", 0, 1, 2, 3)}


def _criteria(rules, **how):
    return {k: C.Criterion(z, threshold, width, **how.get(k, {})) for k, (z, threshold, width, *_) in rules.items()}


def _assessed(prepared, rules):
    weights = {v: {k: x[3 + i] for k, x in rules.items()} for i, v in enumerate(("Service", "Control"))}
    return C.assess(prepared, list(rules), weights)


def _sql(rules, scope, why):
    """SQL of ``p`` (severities, scopes and reasons from the measures ``m``) and ``s`` (scores)."""
    columns = []
    for k, (z, threshold, width, *_) in rules.items():
        inside, outside = scope.get(k, ("true", ""))
        columns.append(f"CASE WHEN {inside} THEN {sat(f'CAST({z} AS DOUBLE)', float(threshold), float(width))} END AS sev__{k}, {inside} AS scope__{k}, CASE WHEN NOT ({inside}) THEN '{outside}' WHEN {z} IS NULL THEN {why.get(k, chr(39) + 'no measure' + chr(39))} END AS reason__{k}")
    scores = []
    for i, view in enumerate(("Service", "Control")):
        w = {k: float(x[3 + i]) for k, x in rules.items() if x[3 + i]}
        live = " + ".join(f"CASE WHEN sev__{k} IS NULL THEN 0.0 ELSE {x} END" for k, x in w.items())
        scores.append(f"1 - ({' + '.join(f'{x} * coalesce(sev__{k}, 0)' for k, x in w.items())}) / nullif({live}, 0) AS score__{view}")
    return f"p AS (SELECT *, {', '.join(columns)} FROM m), s AS (SELECT *, {', '.join(scores)} FROM p)"


def _rows_sql(rules, keep):
    return f"SELECT case_id, {keep}, " + ", ".join(r(f"sev__{k}") + f" AS v__{k}" for k in rules) + ", " + ", ".join(r(f"score__{v}") + f" AS score__{v}" for v in ("Service", "Control")) + " FROM s"


def _rows(prepared, rules, keep):
    return _assessed(prepared, rules).table.select("case_id", keep, *(f"v__{k}" for k in rules), "score__Service", "score__Control")


def _evidence_sql(rules, keep):
    return " UNION ALL ".join(f"SELECT case_id, {keep}, '{k}' AS \"constraint\", CASE WHEN NOT scope__{k} THEN 'out_of_scope' WHEN sev__{k} IS NULL THEN 'unavailable' ELSE 'assessed' END AS state, reason__{k} AS reason FROM p" for k in rules)


# incidents: a user's day; the types of its events are the teams that it passes through


def incidents(spark, d):
    e = user_days(spark, d).events
    cases = e.groupBy("case").agg(F.first("segment").alias("segment"), F.count_if(F.col("event_type") == "error").alias("n_waits"))
    final = S.active_after(e, "case", "__us", "event_type", "purchase").select("case", F.col("active_after").cast("int").alias("reopened"))
    measured = C.attach(cases, [S.returns(e, "case", ["__us"], "event_type"), S.repeated_states(e, "case", "event_type"), S.span(e, "case", "event_type", "__us", ["view"], ["purchase"], "h"), final], "case")
    tied = {"missing": "tied order"}
    rules = _criteria(INCIDENTS, changes=tied, returns=tied, waits={"scope": F.col("segment") != "7", "outside": "segment 7 does not wait"}, span={"missing": F.col("state")}, reopened={"missing": "never final"})
    return C.prepare(measured, rules, "case", ["segment"])


_INCIDENTS = f"""{DAYS},
l AS (SELECT case_id, act, ts, event_id, lag(act) OVER w AS before, row_number() OVER w AS i, count(*) OVER (PARTITION BY case_id, ts) AS same FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_id)),
h AS (SELECT case_id, act, lag(act, 2) OVER (PARTITION BY case_id ORDER BY ts, event_id) AS two FROM l WHERE i = 1 OR act <> before),
c AS (SELECT case_id, count(*) - 1 AS changes, count(*) FILTER (act = two) AS back FROM h GROUP BY case_id), t AS (SELECT case_id, max(same) > 1 AS tied FROM l GROUP BY case_id),
g AS (SELECT case_id, any_value(segment) AS segment, count(*) FILTER (act = 'error') AS n_waits, count(*) - count(DISTINCT act) AS n_repeated, min(us) FILTER (act = 'view') AS a, max(us) FILTER (act = 'purchase') AS b, max(us) AS z FROM ev GROUP BY case_id),
m AS (SELECT g.*, CASE WHEN NOT tied THEN changes END AS n_changes, CASE WHEN NOT tied THEN back END AS n_returns, CASE WHEN b >= a THEN (b - a) / 1e6 / 3600 END AS span,
  CASE WHEN a IS NULL AND b IS NULL THEN 'no_evidence' WHEN a IS NULL THEN 'no_start' WHEN b IS NULL THEN 'no_end' WHEN b < a THEN 'reversed' ELSE 'measured' END AS state, CASE WHEN b IS NOT NULL THEN CAST(z > b AS INTEGER) END AS reopened
  FROM g JOIN c USING (case_id) JOIN t USING (case_id)),
{_sql(INCIDENTS, {"waits": ("segment <> '7'", "segment 7 does not wait")}, {"changes": "'tied order'", "returns": "'tied order'", "span": "state", "reopened": "'never final'"})}"""


@query("dom_incidents_scores", f"WITH {_INCIDENTS} {_rows_sql(INCIDENTS, 'segment')}")
def _(spark, d):
    """Changes of team, returns, repeated states, waiting, span and work after the end, scored in two views."""
    return _rows(incidents(spark, d), INCIDENTS, "segment")


@query("dom_incidents_evidence", f"WITH {_INCIDENTS} SELECT segment, \"constraint\", state, reason, count(*) AS n_cases FROM ({_evidence_sql(INCIDENTS, 'segment')}) GROUP BY ALL")
def _(spark, d):
    return reason_profile(C.evidence(incidents(spark, d), list(INCIDENTS)), ["segment"])


@query("dom_incidents_priorities", f"WITH {_INCIDENTS}, o AS (SELECT avg(score__Control) AS mean FROM s), slices AS (SELECT segment, count(*) AS n_total, count(score__Control) AS n_cases, avg(score__Control) AS mean_score FROM s GROUP BY segment HAVING count(score__Control) > 0) SELECT segment, n_total, n_cases, {r('mean_score')} AS mean_score, {r('n_cases * greatest(mean - mean_score, 0)')} AS \"PI\" FROM slices, o")
def _(spark, d):
    scored = A.assessed(_assessed(incidents(spark, d), INCIDENTS), "Control")
    return A.group_priorities(scored, "segment").select("segment", "n_total", "n_cases", "mean_score", "PI")


# loans: an order; its suppliers are the resources, its kinds of lines the repeated activities


def loans(spark, d):
    o = table(spark, d, "orders")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("case"), "l_returnflag", "l_suppkey", "l_partkey", "l_linestatus")
    cases = o.select(F.col("o_orderkey").cast("string").alias("case"), "o_orderstatus")
    log = order_log(spark, d)
    span = S.span(log.events, "case", "act", "__us", ["place"], ["ship_A", "ship_N", "ship_R"])
    offers = lines.groupBy("case").agg(F.count_distinct("l_partkey").alias("n_offers"), F.count_if(F.col("l_linestatus") == "O").alias("n_open"))
    measured = C.attach(cases, [span, S.breadth(lines, "case", "l_returnflag", "l_suppkey"), offers], "case")
    none = {"missing": "no lines"}
    rules = _criteria(LOANS, span={"missing": F.col("state")}, repeats=none, breadth=none, offers=none, incomplete=none | {"scope": F.col("o_orderstatus") != "F", "outside": "the order is closed"})
    return C.prepare(measured, rules, "case", ["o_orderstatus"])


_LOANS = f"""{ORDERS},
u AS (SELECT case_id, min(us) FILTER (act = 'place') AS a, max(us) FILTER (act <> 'place') AS b FROM ev GROUP BY case_id),
l AS (SELECT CAST(l_orderkey AS VARCHAR) AS case_id, count(*) - count(DISTINCT l_returnflag) AS n_repeats, count(DISTINCT l_suppkey) AS n_resources, count(DISTINCT l_partkey) AS n_offers, count(*) FILTER (l_linestatus = 'O') AS n_open FROM lineitem GROUP BY 1),
m AS (SELECT CAST(o_orderkey AS VARCHAR) AS case_id, o_orderstatus, l.* EXCLUDE (case_id), CASE WHEN b >= a THEN (b - a) / 1e6 / 86400 END AS span,
  CASE WHEN a IS NULL AND b IS NULL THEN 'no_evidence' WHEN a IS NULL THEN 'no_start' WHEN b IS NULL THEN 'no_end' WHEN b < a THEN 'reversed' ELSE 'measured' END AS state
  FROM orders LEFT JOIN l ON l.case_id = CAST(o_orderkey AS VARCHAR) LEFT JOIN u ON u.case_id = CAST(o_orderkey AS VARCHAR)),
{_sql(LOANS, {"incomplete": ("o_orderstatus <> 'F'", "the order is closed")}, {"span": "state"} | dict.fromkeys(("repeats", "breadth", "offers", "incomplete"), "'no lines'"))}"""


@query("dom_loans_scores", f"WITH {_LOANS} {_rows_sql(LOANS, 'o_orderstatus')}")
def _(spark, d):
    """Span, repeated starts, breadth of resources, offers and open parts, scored in two views."""
    return _rows(loans(spark, d), LOANS, "o_orderstatus")


@query("dom_loans_examples", f"WITH {_LOANS} SELECT o_orderstatus, \"constraint\", state, reason, count(*) AS n_cases, min(case_id) AS example FROM ({_evidence_sql(LOANS, 'o_orderstatus')}) GROUP BY ALL")
def _(spark, d):
    return first_examples(C.evidence(loans(spark, d), list(LOANS)), ["o_orderstatus"])


# order items: keys of the order book (closed ones left out) and of the deliveries, whichever has them


def items(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("due"))
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "key")
    amount = F.sum("l_quantity")
    came = lines.groupBy("key").agg(F.max("l_shipdate").alias("last"), (F.count_distinct("l_shipdate") - 1).alias("n_redated"), F.try_divide(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)), amount).alias("shortfall"))
    measured = C.attach(S.case_universe(o, lines, "key"), [o, came], "key").withColumn("slip", F.timestamp_diff("DAY", "due", "last"))
    side = F.when(F.col("in_master") & F.col("in_activity"), "both").when(F.col("in_master"), "book only").otherwise("deliveries only").alias("side")
    why = {"missing": F.when(~F.col("in_master"), "not in the book").otherwise("no delivery")}
    rules = _criteria(ITEMS, slip=why, redated={"missing": "no delivery"}, shortfall={"missing": "no delivery"})
    return C.prepare(measured.select("*", side), rules, "key", ["side"])


_ITEMS = f"""b AS (SELECT o_orderkey AS key, o_orderdate AS due FROM orders WHERE o_orderstatus <> 'P'),
d AS (SELECT l_orderkey AS key, max(l_shipdate) AS last, count(DISTINCT l_shipdate) - 1 AS n_redated, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END) / nullif(sum(l_quantity), 0) AS shortfall FROM lineitem GROUP BY 1),
m AS (SELECT CAST(coalesce(b.key, d.key) AS VARCHAR) AS case_id, CASE WHEN d.key IS NULL THEN 'book only' WHEN b.key IS NULL THEN 'deliveries only' ELSE 'both' END AS side, datesub('day', due, last) AS slip, n_redated, shortfall FROM b FULL JOIN d ON b.key = d.key),
{_sql(ITEMS, {}, {"slip": "CASE WHEN side = 'deliveries only' THEN 'not in the book' ELSE 'no delivery' END", "redated": "'no delivery'", "shortfall": "'no delivery'"})}"""


@query("dom_items_scores", f"WITH {_ITEMS} {_rows_sql(ITEMS, 'side')}")
def _(spark, d):
    """Date slips, changes of date and shortfalls over keys of either side."""
    return _rows(items(spark, d), ITEMS, "side")


@query("dom_items_evidence", f"WITH {_ITEMS} SELECT side, \"constraint\", state, reason, count(*) AS n_cases FROM ({_evidence_sql(ITEMS, 'side')}) GROUP BY ALL")
def _(spark, d):
    return reason_profile(C.evidence(items(spark, d), list(ITEMS)), ["side"])
