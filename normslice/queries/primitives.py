"""Queries of sources, primitives, constraints, rules and recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from normslice.operators.scoring import evaluate_constraint
from normslice.plans.constraints import Balance, Exclusion, Lag, Metric, Precedence, Presence, Singularity
from normslice.plans.norm import Norm, NormConstraint
from normslice.queries.logs import DAYS, ORDERS, ROLES, USERS, events, order_log, query, r, sat, table, user_days, users
from normslice.sources.eventlog import EventLog

# sources

_NULLED = "CASE WHEN event_id % 97 = 0 THEN NULL ELSE ts END"


def _nulled(spark, d):
    return events(spark, d).withColumn("ts", F.when(F.col("event_id") % 97 != 0, F.col("ts")))


@query("src_lifecycle_filter", f"WITH {DAYS} SELECT case_id, count(*) AS n_events FROM ev WHERE act IN ('click', 'view') GROUP BY case_id")
def _(spark, d):
    log = user_days(spark, d, lifecycle_col="event_type", keep_transitions=["CLICK", "view"])
    return log.cases.select("case_id", "n_events")


@query("src_dedupe", f"WITH {DAYS}, t AS (SELECT case_id, act, date_trunc('day', ts) AS ts, value, row_number() OVER (PARTITION BY case_id, act, date_trunc('day', ts) ORDER BY event_id) AS i FROM ev) SELECT case_id, count(*) AS n_events, {r('sum(value)')} AS exposure FROM t WHERE i = 1 GROUP BY case_id")
def _(spark, d):
    e = events(spark, d).withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return EventLog(e, **ROLES, exposure_col="value", exposure_agg="sum", dedupe=True, validate=False).cases.select("case_id", "n_events", "exposure")


@query("src_timestamps_drop", f"WITH {DAYS} SELECT case_id, count(*) AS n_events, min(ts) AS first_ts FROM ev WHERE event_id % 97 <> 0 GROUP BY case_id")
def _(spark, d):
    return EventLog(_nulled(spark, d), **ROLES, missing_timestamps="drop", validate=False).cases.select("case_id", "n_events", "first_ts")


@query("src_timestamps_keep", f"WITH {DAYS} SELECT case_id, count(*) AS n_events, min({_NULLED}) AS first_ts, max({_NULLED}) AS last_ts FROM ev GROUP BY case_id")
def _(spark, d):
    return EventLog(_nulled(spark, d), **ROLES, missing_timestamps="keep", validate=False).cases.select("case_id", "n_events", "first_ts", "last_ts")


@query("src_timestamps_text", f"WITH {DAYS} SELECT case_id, min(date_trunc('second', ts)) AS first_ts, max(date_trunc('second', ts)) AS last_ts FROM ev GROUP BY case_id")
def _(spark, d):
    e = events(spark, d).withColumn("ts", F.date_format("ts", "dd.MM.yyyy HH:mm:ss"))
    return EventLog(e, **ROLES, timestamp_format="dd.MM.yyyy HH:mm:ss", validate=False).cases.select("case_id", "first_ts", "last_ts")


@query("src_standard_names", "SELECT event_type AS activity, count(*) AS n FROM events GROUP BY event_type")
def _(spark, d):
    return user_days(spark, d).to_events().groupBy(F.col("`concept:name`").alias("activity")).agg(F.count(F.lit(1)).alias("n"))


# primitives


@query("prim_case_table", f"WITH {DAYS} SELECT case_id, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts, any_value(segment) AS segment, any_value(weekday) AS weekday, {r('sum(value)')} AS exposure FROM ev GROUP BY case_id")
def _(spark, d):
    return user_days(spark, d).cases


@query("prim_first_attribute", f"WITH {USERS} SELECT case_id, arg_min(CAST(value AS VARCHAR), us) FILTER (value > 50) AS pick FROM ev GROUP BY case_id")
def _(spark, d):
    e = events(spark, d, by_day=False).withColumn("pick", F.when(F.col("value") > 50, F.col("value").cast("string")))
    return EventLog(e, **ROLES, case_attributes=["pick"], validate=False).cases.select("case_id", "pick")


for _name, _labels, _sql in (("prim_count", "click", "act = 'click'"), ("prim_count_label_set", ["click", "view"], "act IN ('click', 'view')")):

    @query(_name, f"WITH {DAYS} SELECT case_id, count(*) FILTER ({_sql}) AS value FROM ev GROUP BY case_id")
    def _(spark, d, labels=_labels):
        return user_days(spark, d).count(labels)


@query("prim_first_ts", f"WITH {DAYS} SELECT case_id, min(ts) FILTER (act = 'view') AS value FROM ev GROUP BY case_id")
def _(spark, d):
    return user_days(spark, d).first_ts("view")


@query("prim_last_ts", f"WITH {DAYS} SELECT case_id, max(ts) FILTER (act = 'view') AS value FROM ev GROUP BY case_id")
def _(spark, d):
    return user_days(spark, d).last_ts("view")


def _pairing(base: str, anchor: str) -> str:
    return f"WITH {base}, a AS (SELECT case_id, {anchor}(ts) FILTER (act = 'view') AS t_a FROM ev GROUP BY case_id) SELECT case_id, any_value(t_a) AS t_a, min(ts) FILTER (act = 'purchase' AND ts >= t_a) AS t_b FROM ev JOIN a USING (case_id) GROUP BY case_id"


@query("prim_first_after", _pairing(USERS, "min"))
def _(spark, d):
    return users(spark, d).first_after("view", "purchase")


@query("prim_last_after", _pairing(USERS, "max"))
def _(spark, d):
    return users(spark, d).first_after("view", "purchase", activation="last")


@query("prim_activation_lags", f"WITH {USERS} SELECT a.case_id, a.ts AS t_a, {r('(min(b.us) - any_value(a.us)) / 1e6 / 3600')} AS lag FROM ev a LEFT JOIN ev b ON a.case_id = b.case_id AND b.act = 'purchase' AND b.us >= a.us WHERE a.act = 'view' GROUP BY a.case_id, a.event_id, a.ts")
def _(spark, d):
    return users(spark, d).activation_lags("view", "purchase", "h")


def _scoped(condition: str, known: str) -> str:
    return f"WITH {USERS}, a AS (SELECT case_id, min(us) FILTER (act = 'signup') AS s1, min(us) FILTER (act = 'purchase') AS p1 FROM ev GROUP BY case_id) SELECT case_id, CASE WHEN {known} THEN count(*) FILTER (act = 'click' AND {condition}) END AS value FROM ev JOIN a USING (case_id) GROUP BY case_id, s1, p1"


@query("prim_count_scoped", _scoped("us > s1 AND us < p1", "s1 IS NOT NULL AND p1 IS NOT NULL"))
def _(spark, d):
    return users(spark, d).count_scoped("click", after="signup", before="purchase").withColumn("value", F.col("value").cast("long"))


@query("prim_count_before", _scoped("us < p1", "p1 IS NOT NULL"))
def _(spark, d):
    return users(spark, d).count_before("click", "purchase").withColumn("value", F.col("value").cast("long"))


@query("prim_count_after", _scoped("us > s1", "s1 IS NOT NULL"))
def _(spark, d):
    return users(spark, d).count_after("click", "signup").withColumn("value", F.col("value").cast("long"))


for _agg, _sql in {"sum": "sum(value)", "max": "max(value)", "min": "min(value)", "mean": "avg(value)", "first": "arg_min(value, us)", "last": "arg_max(value, us)"}.items():

    @query(f"prim_total_{_agg}", f"WITH {DAYS} SELECT case_id, {r(f'''coalesce({_sql} FILTER (act = 'click'), 0)''')} AS value FROM ev GROUP BY case_id")
    def _(spark, d, agg=_agg):
        return user_days(spark, d).total("value", "click", agg)


@query("prim_attribute", f"WITH {DAYS} SELECT case_id, CAST(any_value(segment) AS DOUBLE) AS value FROM ev GROUP BY case_id")
def _(spark, d):
    return user_days(spark, d).attribute("segment")


@query("prim_add_case_attribute", f"WITH {USERS} SELECT case_id, any_value(c_acctbal) AS balance FROM ev LEFT JOIN (SELECT CAST(c_custkey AS VARCHAR) AS case_id, {r('c_acctbal')} AS c_acctbal FROM customer) USING (case_id) GROUP BY case_id")
def _(spark, d):
    side = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_acctbal").cast("double"))
    return users(spark, d).add_case_attribute("balance", side).cases.select("case_id", "balance")


@query("prim_trace", f"WITH {USERS} SELECT event_id, act AS event_type, ts FROM ev WHERE case_id = '7'")
def _(spark, d):
    return users(spark, d).trace("7").select("event_id", "event_type", "ts")


@query("prim_case_ids", f"WITH {DAYS} SELECT DISTINCT case_id FROM ev")
def _(spark, d):
    return user_days(spark, d).case_ids()


_WINDOW = f"""{DAYS}, w AS (SELECT case_id, min(us) AS a, max(us) AS b FROM ev GROUP BY case_id), n AS (SELECT count(*) AS n FROM w),
  lo AS (SELECT a FROM (SELECT a, row_number() OVER (ORDER BY a) - 1 AS i FROM w) JOIN n ON i = CAST(ceil(0.01 * (n - 1)) AS BIGINT)),
  hi AS (SELECT b FROM (SELECT b, row_number() OVER (ORDER BY b) - 1 AS i FROM w) JOIN n ON i = CAST(floor(0.99 * (n - 1)) AS BIGINT))"""


@query("prim_observation_window", f"WITH {_WINDOW} SELECT make_timestamp(a) AS window_start, make_timestamp(b) AS window_end FROM lo, hi")
def _(spark, d):
    return user_days(spark, d).observation_window(0.01)


@query(
    "prim_quality_report",
    f"""WITH {_WINDOW}, t AS (SELECT case_id, us, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT (SELECT count(*) FROM ev) AS n_events, (SELECT count(*) FROM w) AS n_cases, (SELECT count(DISTINCT act) FROM ev) AS n_activities, (SELECT max(ts) FROM ev) AS raw_max,
  CAST(0 AS BIGINT) AS missing_timestamps, (SELECT count(*) FROM ev, lo, hi WHERE us < a OR us > b) AS outlying_timestamps, CAST(0 AS BIGINT) AS null_activities,
  (SELECT {r('sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n)')} FROM t) AS tied_event_share, (SELECT {r('avg(x)')} FROM (SELECT max(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END) AS x FROM t GROUP BY case_id)) AS tied_case_share""",
)
def _(spark, d):
    return user_days(spark, d, case_attributes=[], exposure_col=None).quality_report(0.01)


# constraints


def _one(constraint, applicability=None):
    return NormConstraint("x", "l", constraint, applicability=applicability)


def _constraint(name, log, constraint, sql, applicability=None, derived=()):
    @query(name, sql)
    def _(spark, d):
        nc = _one(constraint, applicability)
        return evaluate_constraint(log(spark, d), nc, Norm((nc,), derived_attributes=derived))


def _agg(base: str, violation: str, where: str = "") -> str:
    return f"WITH {base} SELECT case_id, {r(violation)} AS violation FROM ev {where} GROUP BY case_id"


def _anchored(base: str, violation: str, unit: float = 3600.0) -> str:
    """Violations over the first / last view and the purchases around them, in hours by default."""
    return f"""WITH {base}, a AS (SELECT case_id, min(us) FILTER (act = 'view') AS v1, max(us) FILTER (act = 'view') AS vn, min(us) FILTER (act = 'purchase') AS p1, max(us) AS last, (SELECT max(us) FROM ev) AS top FROM ev GROUP BY case_id),
k AS (SELECT case_id, v1, vn, p1, top, min(us) FILTER (act = 'purchase' AND us >= v1) AS pv, min(us) FILTER (act = 'purchase' AND us >= vn) AS pn, count(*) FILTER (act = 'error' AND us < p1) AS eb, count(*) FILTER (act = 'error') AS ne,
  count(*) FILTER (act = 'error' AND us > v1) AS ea FROM ev JOIN a USING (case_id) GROUP BY case_id, v1, vn, p1, top)
SELECT case_id, {r(violation.replace('HOURS', f'1e6 / {unit}'))} AS violation FROM k"""


_constraint("con_presence", user_days, Presence("view", 2), _agg(DAYS, "1 - least(count(*) FILTER (act = 'view') / 2.0, 1.0)"))
_constraint("con_exclusion", user_days, Exclusion(["error", "signup"]), _agg(DAYS, "CASE WHEN count(*) FILTER (act IN ('error', 'signup')) > 0 THEN 1 ELSE 0 END"))
_constraint("con_exclusion_after", user_days, Exclusion("error", after="view"), _anchored(DAYS, "CASE WHEN v1 IS NOT NULL THEN CASE WHEN ea > 0 THEN 1 ELSE 0 END END"))
_constraint("con_singularity", users, Singularity("click", 10, 20.0), _agg(USERS, sat("CAST(count(*) FILTER (act = 'click') AS DOUBLE)", 10.0, 20.0)))
_constraint("con_singularity_before", users, Singularity("error", 0, 3.0, before="purchase"), _anchored(USERS, f"CASE WHEN p1 IS NOT NULL THEN {sat('CAST(eb AS DOUBLE)', 0.0, 3.0)} END"))
_constraint("con_lag_first", user_days, Lag("view", "purchase", 1, 5, "h"), _anchored(DAYS, f"CASE WHEN v1 IS NULL THEN 1 WHEN pv IS NULL THEN 1 ELSE {sat('(pv - v1) / HOURS', 1.0, 5.0)} END"))
_constraint("con_lag_skip", user_days, Lag("view", "purchase", 1, 0, "h", missing="skip"), _anchored(DAYS, sat("(pv - v1) / HOURS", 1.0, 0.0)))
_constraint("con_lag_last", users, Lag("view", "purchase", 12, 48, "h", activation="last", missing_b="skip"), _anchored(USERS, f"CASE WHEN vn IS NULL THEN 1 ELSE {sat('(pn - vn) / HOURS', 12.0, 48.0)} END"))
_constraint("con_lag_overall", user_days, Lag("view", "purchase", 60, 300, "min", response="first_overall"), _anchored(DAYS, f"CASE WHEN v1 IS NULL OR p1 IS NULL OR p1 < v1 THEN 1 ELSE {sat('(p1 - v1) / HOURS', 60.0, 300.0)} END", 60.0))
_constraint("con_lag_unbounded", user_days, Lag("view", "purchase", None, 0, "h", missing_a="skip"), _anchored(DAYS, "CASE WHEN v1 IS NULL THEN NULL WHEN pv IS NULL THEN 1 ELSE 0 END"))


@query("con_lag_censor", _anchored(DAYS, f"CASE WHEN v1 IS NULL THEN NULL WHEN pv IS NULL THEN {sat('(epoch_us(TIMESTAMP ' + chr(39) + '2024-01-20 00:00:00' + chr(39) + ') - v1) / HOURS', 24.0, 240.0)} ELSE {sat('(pv - v1) / HOURS', 24.0, 240.0)} END"))
def _(spark, d):
    log = user_days(spark, d, window=("2024-01-01 00:00:00", "2024-01-20 00:00:00"))
    return evaluate_constraint(log, _one(Lag("view", "purchase", 24, 240, "h", missing_a="skip", missing_b="censor")))


_EACH = f"WITH {USERS}, p AS (SELECT a.case_id, a.event_id, (min(b.us) - any_value(a.us)) / 1e6 / 3600.0 AS lag FROM ev a LEFT JOIN ev b ON a.case_id = b.case_id AND b.act = 'purchase' AND b.us >= a.us WHERE a.act = 'view' GROUP BY a.case_id, a.event_id), c AS (SELECT DISTINCT case_id FROM ev), m AS (SELECT case_id, avg(%s) AS v, count(*) AS n FROM p GROUP BY case_id) SELECT case_id, {r('CASE WHEN n IS NULL THEN 1 ELSE v END')} AS violation FROM c LEFT JOIN m USING (case_id)"
_constraint("con_lag_each", users, Lag("view", "purchase", 6, 48, "h", activation="each"), _EACH.replace("%s", f"coalesce({sat('lag', 6.0, 48.0)}, 1)"))
_constraint("con_lag_each_skip", users, Lag("view", "purchase", 6, 48, "h", activation="each", missing_b="skip"), _EACH.replace("%s", sat("lag", 6.0, 48.0)))
_constraint("con_precedence", user_days, Precedence("purchase", "error"), _anchored(DAYS, f"CASE WHEN p1 IS NOT NULL THEN {sat('CAST(eb AS DOUBLE)', 0.0, 1.0)} END"))
_constraint("con_precedence_missing", user_days, Precedence("purchase", "error", 0, 2, "violate", "skip"), _anchored(DAYS, f"CASE WHEN ne = 0 THEN NULL WHEN p1 IS NULL THEN 1 ELSE {sat('CAST(eb AS DOUBLE)', 0.0, 2.0)} END"))
_BALANCE = "abs(x - y) / greatest(x, y, 1e-9)"
_constraint(
    "con_balance",
    order_log,
    Balance("amount", "place", "amount", ["ship_A", "ship_N", "ship_R"], 0.05, 0.5),
    f"WITH {ORDERS}, t AS (SELECT case_id, coalesce(sum(amount) FILTER (act = 'place'), 0) AS x, coalesce(sum(amount) FILTER (act <> 'place'), 0) AS y FROM ev GROUP BY case_id) SELECT case_id, {r(sat(_BALANCE, 0.05, 0.5))} AS violation FROM t",
)
_constraint(
    "con_balance_max",
    order_log,
    Balance("amount", "ship_A", "amount", "ship_R", 0.1, 0.3, agg="max"),
    f"WITH {ORDERS}, t AS (SELECT case_id, coalesce(max(amount) FILTER (act = 'ship_A'), 0) AS x, coalesce(max(amount) FILTER (act = 'ship_R'), 0) AS y FROM ev GROUP BY case_id) SELECT case_id, {r(sat(_BALANCE, 0.1, 0.3))} AS violation FROM t",
)
_constraint("con_metric_high", user_days, Metric("n_events", 2, 3), _agg(DAYS, sat("CAST(count(*) AS DOUBLE)", 2.0, 3.0)))
_constraint("con_metric_low", user_days, Metric("exposure", 400, 300, "low"), _agg(DAYS, sat("400.0 - sum(value)", 0.0, 300.0)))
_constraint("con_order_precedence", order_log, Precedence("place", ["ship_A", "ship_N", "ship_R"], 0, 2), f"WITH {ORDERS}, a AS (SELECT case_id, min(us) FILTER (act = 'place') AS p1 FROM ev GROUP BY case_id), k AS (SELECT case_id, p1, count(*) FILTER (act <> 'place' AND us < p1) AS b FROM ev JOIN a USING (case_id) GROUP BY case_id, p1) SELECT case_id, {r('CASE WHEN p1 IS NOT NULL THEN ' + sat('CAST(b AS DOUBLE)', 0.0, 2.0) + ' END')} AS violation FROM k")

# rules: a constraint that is always violated shows the scope

_seg = "any_value(segment)"


def _rule(name, rule, sql, base=DAYS, log=user_days):
    _constraint(name, log, Exclusion(["click", "view", "error", "signup", "purchase", "place"]), f"WITH {base} SELECT case_id, {r(f'CASE WHEN {sql} THEN 1 END')} AS violation FROM ev GROUP BY case_id", applicability=rule)


_rule("rule_short_form", {"segment": ["1", "2"], "weekday": "3"}, f"{_seg} IN ('1', '2') AND any_value(weekday) = '3'")
_rule("rule_all_any_not", {"all": [{"any": [{"attr": "segment", "eq": "1"}, {"attr": "weekday", "eq": "2"}]}, {"not": {"attr": "segment", "in": ["7"]}}]}, f"({_seg} = '1' OR any_value(weekday) = '2') AND NOT {_seg} = '7'")
_rule("rule_not_in", {"attr": "segment", "not_in": ["0", "3"]}, f"{_seg} NOT IN ('0', '3')")
_rule("rule_ne", {"attr": "segment", "ne": "5"}, f"{_seg} <> '5'")
_rule("rule_compare", {"all": [{"attr": "n_events", "gte": 2}, {"attr": "exposure", "lt": 600}]}, "count(*) >= 2 AND sum(value) < 600")
_rule("rule_has_lacks", {"all": [{"has": "view"}, {"lacks": ["error", "signup"]}]}, "count(*) FILTER (act = 'view') > 0 AND count(*) FILTER (act IN ('error', 'signup')) = 0")
_MISSING = f"{ORDERS}, q AS (SELECT *, CASE WHEN key % 5 = 0 THEN NULL ELSE c_mktsegment END AS seg FROM ev)"


def _null_rule(name, rule, sql):
    @query(name, f"WITH {_MISSING} SELECT case_id, {r(f'CASE WHEN {sql} THEN 1 END')} AS violation FROM q GROUP BY case_id")
    def _(spark, d):
        log = order_log(spark, d)
        log.events = log.events.withColumn("c_mktsegment", F.when(F.col("key") % 5 != 0, F.col("c_mktsegment")))
        return evaluate_constraint(log, _one(Exclusion("place"), rule))


_null_rule("rule_isna", {"attr": "c_mktsegment", "isna": True}, "any_value(seg) IS NULL")
_null_rule("rule_notna", {"attr": "c_mktsegment", "notna": True}, "any_value(seg) IS NOT NULL")
_null_rule("rule_null_eq", {"attr": "c_mktsegment", "eq": "BUILDING"}, "coalesce(any_value(seg) = 'BUILDING', false)")
_null_rule("rule_null_ne", {"attr": "c_mktsegment", "ne": "BUILDING"}, "NOT coalesce(any_value(seg) = 'BUILDING', false)")
_null_rule("rule_null_not", {"not": {"attr": "c_mktsegment", "in": ["BUILDING", "MACHINERY"]}}, "NOT coalesce(any_value(seg) IN ('BUILDING', 'MACHINERY'), false)")

# recipes


def _recipe(name, recipes, sql, base=DAYS, log=user_days):
    recipes = recipes if isinstance(recipes, list) else [recipes]

    @query(f"rec_{name}", sql if sql.startswith("WITH") else f"WITH {base} SELECT case_id, {r(sql)} AS x FROM ev GROUP BY case_id")
    def _(spark, d):
        return log(spark, d).derive(recipes).cases.select("case_id", F.col("x").cast("double").alias("x"))


_recipe("count", {"name": "x", "kind": "count", "activities": ["click", "view"]}, "count(*) FILTER (act IN ('click', 'view'))")
_recipe("count_events", {"name": "x", "kind": "count_events", "where": {"event_type": ["click"], "weekday": {"not_in": ["1"]}}}, "count(*) FILTER (act = 'click' AND weekday <> '1')")
_recipe("where_regex", {"name": "x", "kind": "count_events", "where": [{"column": "props", "regex": '"k": [0-9]+[13579]\\}'}]}, """count(*) FILTER (regexp_matches(props, '"k": [0-9]+[13579]\\}'))""")
_recipe("nunique", {"name": "x", "kind": "nunique", "column": "event_type"}, "count(DISTINCT act)")
_recipe("agg_sum", {"name": "x", "kind": "agg", "column": "value", "agg": "sum", "where": {"event_type": ["error"]}}, "sum(value) FILTER (act = 'error')")
_recipe("agg_std", {"name": "x", "kind": "agg", "column": "value", "agg": "std"}, "stddev_samp(value)")
_recipe("agg_first", {"name": "x", "kind": "agg", "column": "value", "agg": "first", "where": {"event_type": ["click"]}}, "arg_min(value, us) FILTER (act = 'click')")
_recipe("agg_last", {"name": "x", "kind": "agg", "column": "value", "agg": "last"}, "arg_max(value, us)")
_recipe("cv", {"name": "x", "kind": "cv", "column": "value"}, "coalesce(stddev_samp(value), 0) / greatest(abs(avg(value)), 1e-9)")
_recipe("lag", {"name": "x", "kind": "lag", "a": "view", "b": "purchase", "unit": "h"}, f"WITH {DAYS}, a AS (SELECT case_id, min(us) FILTER (act = 'view') AS v1 FROM ev GROUP BY case_id) SELECT case_id, {r('''(min(us) FILTER (act = 'purchase' AND us >= v1) - any_value(v1)) / 1e6 / 3600''')} AS x FROM ev JOIN a USING (case_id) GROUP BY case_id")
_recipe("ratio", [{"name": "n", "kind": "count", "activities": "click"}, {"name": "m", "kind": "count", "activities": "view"}, {"name": "x", "kind": "ratio", "numerator": "n", "denominator": "m"}], "CASE WHEN count(*) FILTER (act = 'view') > 0 THEN count(*) FILTER (act = 'click') / count(*) FILTER (act = 'view') END")
_recipe("quantile_scale", {"name": "x", "kind": "quantile_scale", "attribute": "exposure", "q": 0.9}, f"WITH {DAYS}, c AS (SELECT case_id, sum(value) AS e FROM ev GROUP BY case_id), q AS (SELECT quantile_cont(e, 0.9) AS q FROM c) SELECT case_id, {r('least(greatest(e / q, 0), 1)')} AS x FROM c, q")
_recipe("indicator_times", {"name": "x", "kind": "indicator_times", "activities": "purchase", "attribute": "exposure"}, "CASE WHEN count(*) FILTER (act = 'purchase') > 0 THEN sum(value) ELSE 0 END")
_recipe("eval", [{"name": "x", "kind": "eval", "expr": "(exposure + 10) / n_events - 2 * n_events"}], "(sum(value) + 10) / count(*) - 2 * count(*)")
_recipe("eval_division", [{"name": "n", "kind": "count", "activities": "click"}, {"name": "m", "kind": "count", "activities": "view"}, {"name": "x", "kind": "eval", "expr": "1 / (n - m) + (n >= m) * `exposure` ** 0.5"}], "1.0 / nullif(count(*) FILTER (act = 'click') - count(*) FILTER (act = 'view'), 0) + CASE WHEN count(*) FILTER (act = 'click') >= count(*) FILTER (act = 'view') THEN 1 ELSE 0 END * sqrt(sum(value))")
_recipe("quantile_default", {"name": "x", "kind": "quantile_scale", "attribute": "n_events"}, f"WITH {DAYS}, c AS (SELECT case_id, CAST(count(*) AS DOUBLE) AS e FROM ev GROUP BY case_id), q AS (SELECT quantile_cont(e, 0.95) AS q FROM c) SELECT case_id, {r('least(greatest(e / q, 0), 1)')} AS x FROM c, q")

# one case holds a third of all events

HOT = USERS.replace("CAST(user_id AS VARCHAR) AS case_id", "CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE CAST(user_id AS VARCHAR) END AS case_id")


def hot_log(spark, d):
    e = events(spark, d, by_day=False).withColumn("case", F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.col("case")))
    return EventLog(e, **ROLES, validate=False, long_traces=True)


_LONG = {
    "long_lag_each": (Lag("view", "purchase", 2, 24, "h", activation="each", missing_b="skip"), f"WITH {HOT}, b AS (SELECT *, min(us) FILTER (act = 'purchase') OVER (PARTITION BY case_id ORDER BY us RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pb FROM ev), l AS (SELECT case_id, {sat('(pb - us) / 1e6 / 3600.0', 2.0, 24.0)} AS v FROM b WHERE act = 'view') SELECT e.case_id, {r('CASE WHEN any_value(l.n) IS NULL THEN 1.0 ELSE any_value(l.v) END')} AS violation FROM ev e LEFT JOIN (SELECT case_id, avg(v) AS v, count(*) AS n FROM l GROUP BY case_id) l ON e.case_id = l.case_id GROUP BY e.case_id"),
    "long_lag_last": (Lag("view", "purchase", 2, 24, "h", activation="last"), f"WITH {HOT}, a AS (SELECT case_id, max(us) FILTER (act = 'view') AS v1 FROM ev GROUP BY case_id), k AS (SELECT case_id, any_value(v1) AS v1, min(us) FILTER (act = 'purchase' AND us >= v1) AS p FROM ev JOIN a USING (case_id) GROUP BY case_id) SELECT case_id, {r('CASE WHEN v1 IS NULL THEN 1.0 ELSE coalesce(' + sat('(p - v1) / 1e6 / 3600.0', 2.0, 24.0) + ', 1.0) END')} AS violation FROM k"),
    "long_band": (Singularity("click", 3, 20, after="signup", before="error"), f"WITH {HOT}, a AS (SELECT case_id, min(us) FILTER (act = 'signup') AS x, min(us) FILTER (act = 'error') AS y FROM ev GROUP BY case_id), k AS (SELECT case_id, any_value(x) AS x, any_value(y) AS y, count(*) FILTER (act = 'click' AND us > x AND us < y) AS n FROM ev JOIN a USING (case_id) GROUP BY case_id) SELECT case_id, {r('CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN ' + sat('CAST(n AS DOUBLE)', 3.0, 20.0) + ' END')} AS violation FROM k"),
}
for _name, (_body, _sql) in _LONG.items():

    @query(f"con_{_name}", _sql)
    def _(spark, d, body=_body):
        return evaluate_constraint(hot_log(spark, d), _one(body))
