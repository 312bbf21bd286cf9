"""Queries of scoring, slices, diagnostics, assessments, sequences and live scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from normslice.operators import assessments as A
from normslice.operators import backlog as B
from normslice.operators import diagnostics as D
from normslice.operators import sequences as S
from normslice.operators.scoring import q, score, violation_matrix
from normslice.plans.constraints import Balance, Exclusion, Lag, Presence, Singularity
from normslice.plans.norm import Norm, NormConstraint, View
from normslice.queries.logs import DAYS, LAYER_OF, LAYERS, ORDERS, USERS, VIOLATIONS, arriving, effective, events, fullest, norm, order_log, orders, query, r, scored_sql, table, user_days, users
from normslice.sources.eventlog import EventLog
from normslice.streaming.live import event_windows, live_scores

S_FLAT, S_LB = scored_sql("flat"), scored_sql()
CS = tuple(LAYER_OF)


def result(spark, d, mode=None, **roles):
    return score(user_days(spark, d, **roles), norm(), mode=mode)


# scores


@query("score_violation_matrix", f"WITH {VIOLATIONS} SELECT case_id, {', '.join(f'{r(c)} AS v__{c}, ' + ('s8' if c == 'c8' else 'true') + f' AS s__{c}' for c in CS)} FROM v")
def _(spark, d):
    return violation_matrix(user_days(spark, d), norm())


for _mode, _sql in (("flat", S_FLAT), ("layer_balanced", S_LB)):

    @query(f"score_{_mode}", f"WITH {_sql} SELECT case_id, {r('score_Ops')} AS score__Ops, {r('score_Finance')} AS score__Finance, {', '.join(f'{r(f'd_{v}_{x}')} AS contrib__{v}__{x}' for v in ('Ops', 'Finance') for x in LAYERS)} FROM s")
    def _(spark, d, mode=_mode):
        t = result(spark, d, mode).table
        return t.select("case_id", *(c for c in t.columns if c.startswith(("score__", "contrib__"))))


@query("score_summary", f"WITH {S_LB} " + " UNION ALL ".join(f"SELECT '{v}' AS view, count(score_{v}) AS n_scored, {r(f'avg(score_{v})')} AS mean_score, {', '.join(f'{r(f'avg(d_{v}_{x})')} AS mean_contrib__{x}' for x in LAYERS)} FROM s" for v in ("Ops", "Finance")))
def _(spark, d):
    return result(spark, d).summary()


_E = effective("Ops", "layer_balanced")


@query("score_effective_weights", f"WITH {VIOLATIONS} SELECT case_id, {', '.join(f'{r(_E[c])} AS {c}' for c in CS)} FROM v")
def _(spark, d):
    return result(spark, d).effective_weights("Ops")


@query("score_penalties", f"WITH {S_LB} SELECT case_id, {', '.join(f'{r(f'pen_Finance_{c}')} AS {c}' for c in CS)} FROM s")
def _(spark, d):
    return result(spark, d).penalties("Finance")


@query("score_density", f"WITH {VIOLATIONS} SELECT {r('avg((' + ' + '.join(f'(CASE WHEN {c} IS NULL THEN 0.0 ELSE 1.0 END)' for c in CS) + ') / 8)')} AS density FROM v")
def _(spark, d):
    return result(spark, d).applicability_density()


@query("score_density_scope", f"WITH {VIOLATIONS} SELECT {r('avg((7.0 + CASE WHEN s8 THEN 1.0 ELSE 0.0 END) / 8)')} AS density FROM v")
def _(spark, d):
    return result(spark, d).applicability_density(scope=True)


@query("score_worst_cases", f"WITH {S_LB} SELECT case_id, {r('score_Ops')} AS score FROM s WHERE segment = '3' AND score_Ops IS NOT NULL ORDER BY round(score_Ops, 9), case_id LIMIT 15")
def _(spark, d):
    t = result(spark, d)
    t.table = t.table.withColumn("score__Ops", F.round("score__Ops", 9))
    return t.worst_cases("Ops", 15, {"segment": "3"})


@query("score_where_list", f"WITH {S_LB} SELECT {r('avg(score_Ops)')} AS mean_score, count(*) AS n FROM s WHERE segment IN ('1', '4') AND weekday = '2'")
def _(spark, d):
    t = result(spark, d)
    return t.table.where(t.where({"segment": ["1", "4"], "weekday": "2"})).agg(F.avg("score__Ops").alias("mean_score"), F.count(F.lit(1)).alias("n"))


@query("score_decomposition", f"WITH {S_LB} SELECT {r('max(abs(' + ' + '.join(f'd_Ops_{x}' for x in LAYERS) + ' - (1 - score_Ops)))')} AS gap FROM s")
def _(spark, d):
    return spark.createDataFrame([(result(spark, d).check_decomposition(),)], "gap double")


@query("score_coverage", f"WITH {VIOLATIONS} SELECT case_id, {r('(' + ' + '.join(f'(CASE WHEN {c} IS NULL THEN 0 ELSE {w} END)' for c, w in {'c1': 0.2, 'c2': 0.1, 'c3': 0.05, 'c4': 0.3, 'c6': 0.2, 'c7': 0.15}.items()) + ') / 1.0')} AS coverage FROM v")
def _(spark, d):
    t = result(spark, d)
    return t.table.select("case_id", A.coverage_columns(t.norm.raw_weights("Finance"))["coverage"].alias("coverage"))


# slices


def backlog_sql(by, view="Ops", gamma=0.0, volume="count(*)", base=S_LB, where="", baseline=None, z=None):
    keys = ", ".join(by)
    mean = "(SELECT avg(score_%s) FROM s WHERE score_%s IS NOT NULL %s)" % (view, view, where) if baseline is None else str(baseline)
    n, m = "n_cases", "mean_score"
    stable = f"greatest(n_cases / (n_cases + {float(gamma)}) * (global_mean - mean_score), 0.0)"
    low = f", sd_score / sqrt(n_cases) AS se, greatest({stable} - {z} * coalesce(sd_score / sqrt(n_cases), 0.0) * n_cases / (n_cases + {float(gamma)}), 0.0) AS gap_lower" if z is not None else ""
    return f"""{base},
b0 AS (SELECT {keys}, count(*) AS n_cases, avg(score_{view}) AS mean_score, stddev_samp(score_{view}) AS sd_score, CAST({volume} AS DOUBLE) AS volume, {mean} AS global_mean FROM s WHERE score_{view} IS NOT NULL {where} GROUP BY {keys}),
b AS (SELECT {keys}, {n}, {m}, sd_score, volume, global_mean, greatest(global_mean - mean_score, 0.0) AS gap, volume * greatest(global_mean - mean_score, 0.0) AS PI, n_cases / (n_cases + {float(gamma)}) AS shrink,
  global_mean + n_cases / (n_cases + {float(gamma)}) * (mean_score - global_mean) AS stable_mean, {stable} AS stable_gap, volume * {stable} AS stable_PI{low} FROM b0)"""


_COLUMNS = ("mean_score", "sd_score", "volume", "global_mean", "gap", "PI", "shrink", "stable_mean", "stable_gap", "stable_PI")


def _tail(by, extra=()):
    return f"SELECT {', '.join(by)}, n_cases, {', '.join(f'{r(c)} AS {c}' for c in (*_COLUMNS, *extra))} FROM b"


@query("agg_prioritize", f"WITH {backlog_sql(['segment', 'weekday'])} {_tail(['segment', 'weekday'])}")
def _(spark, d):
    return B.prioritize(result(spark, d), ["segment", "weekday"])


@query("agg_prioritize_gamma_interval", f"WITH {backlog_sql(['segment', 'weekday'], gamma=20, z=1.96)} {_tail(['segment', 'weekday'], ('se', 'gap_lower', 'volume * gap_lower'))}".replace("AS volume * gap_lower", "AS PI_lower"))
def _(spark, d):
    return B.prioritize(result(spark, d), ["segment", "weekday"], gamma=20, z=1.96)


@query("agg_prioritize_exposure", f"WITH {backlog_sql(['segment'], view='Finance', gamma=5, volume='sum(exposure)')} {_tail(['segment'])}")
def _(spark, d):
    return B.prioritize(result(spark, d), "segment", view="Finance", gamma=5, volume="exposure")


@query("agg_prioritize_baseline_min", f"WITH {backlog_sql(['segment', 'weekday'], baseline=0.7)} {_tail(['segment', 'weekday'])} WHERE n_cases >= 60")
def _(spark, d):
    return B.prioritize(result(spark, d), ["segment", "weekday"], baseline=0.7, min_cases=60)


@query(
    "agg_prioritize_null_keys",
    f"WITH {ORDERS}, s AS (SELECT case_id, CASE WHEN any_value(o_custkey) % 3 = 0 THEN NULL ELSE any_value(c_mktsegment) END AS seg, CASE WHEN count(*) FILTER (act = 'ship_R') > 0 THEN 0.0 ELSE 1.0 END AS score_Ops FROM ev GROUP BY case_id) "
    "SELECT seg, count(*) AS n_cases, round(avg(score_Ops) + 1e-9, 6) + 0.0 AS mean_score FROM s GROUP BY seg",
)
def _(spark, d):
    e = orders(spark, d).withColumn("seg", F.when(F.col("o_custkey") % 3 != 0, F.col("c_mktsegment")))
    log = EventLog(e, case_col="case", activity_col="act", timestamp_col="ts", order_col="line", case_attributes=["seg"], validate=False)
    return B.prioritize(score(log, Norm((NormConstraint("x", "l", Exclusion("ship_R")),))), "seg").select("seg", "n_cases", "mean_score")


_MEANS = ", ".join(f"avg(d_Ops_{x}) AS m_{x}" for x in LAYERS)
_DELTA = {x: f"(m_{x} - a_{x})" for x in LAYERS}
_MAX = f"greatest({', '.join(_DELTA.values())})"
_DRIVERS = f"""{S_LB}, m AS (SELECT segment, count(*) AS n_cases, {_MEANS} FROM s WHERE score_Ops IS NOT NULL GROUP BY segment), a AS (SELECT {_MEANS.replace('AS m_', 'AS a_')} FROM s WHERE score_Ops IS NOT NULL),
dr AS (SELECT *, CASE WHEN {_MAX} <= 0 THEN NULL {' '.join(f"WHEN {_DELTA[x]} = {_MAX} THEN '{x}'" for x in LAYERS)} END AS dominant_layer FROM m, a)"""


@query("agg_layer_drivers", f"WITH {_DRIVERS} SELECT segment, n_cases, {', '.join(f'{r(f'm_{x}')} AS mean__{x}, {r(_DELTA[x])} AS delta__{x}' for x in LAYERS)}, dominant_layer FROM dr")
def _(spark, d):
    return B.layer_drivers(result(spark, d), "segment", view="Ops")


@query(
    "agg_constraint_drivers",
    f"WITH {S_LB} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"constraint\", '{LAYER_OF[c]}' AS layer, {r(f'avg(pen_Ops_{c}) FILTER (score_Ops IS NOT NULL)')} AS mean_penalty, {r(f'avg({c})')} AS mean_violation, {r(f'avg(CASE WHEN {c} > 0 THEN 1.0 WHEN {c} IS NOT NULL THEN 0.0 END)')} AS share_violated, "
        f"{r('avg(CASE WHEN s8 THEN 1.0 ELSE 0.0 END)' if c == 'c8' else '1')} AS share_in_scope, {r(f'avg(CASE WHEN {c} IS NULL THEN 0.0 ELSE 1.0 END)')} AS share_evaluated FROM s WHERE weekday = '4'"
        for c in CS
    ),
)
def _(spark, d):
    return B.constraint_drivers(result(spark, d), view="Ops", where={"weekday": "4"})


_SHARES = "row_number() OVER (ORDER BY round({m}, 9) DESC, {k}) AS rank, CASE WHEN sum({m}) OVER () > 0 THEN {m} / sum({m}) OVER () ELSE 0.0 END AS share, CASE WHEN sum({m}) OVER () > 0 THEN sum({m}) OVER (ORDER BY round({m}, 9) DESC, {k} ROWS UNBOUNDED PRECEDING) / sum({m}) OVER () ELSE 0.0 END AS cum_share"


@query("agg_penalty_mass", f"WITH {S_LB}, m AS (SELECT segment, weekday, count(*) AS n_cases, sum(1 - score_Ops) AS pm, avg(1 - score_Ops) AS mp FROM s WHERE score_Ops IS NOT NULL GROUP BY ALL), t AS (SELECT *, {_SHARES.format(m='pm', k='segment, weekday')} FROM m) SELECT segment, weekday, n_cases, {r('pm')} AS penalty_mass, {r('mp')} AS mean_penalty, CAST(rank AS INTEGER) AS rank, {r('share')} AS share, {r('cum_share')} AS cum_share FROM t")
def _(spark, d):
    return B.penalty_mass(result(spark, d), ["segment", "weekday"], view="Ops")


def _cut(df):
    """Ranks that an oracle shares must not hang on last bits: metrics are cut before ranking."""
    return df.withColumns({c: F.round(c, 9) for c in ("stable_PI", "stable_gap")})


_B = backlog_sql(["segment", "weekday"], gamma=20)
_B9 = _B + ", p AS (SELECT segment, weekday, n_cases, round(stable_gap, 9) AS stable_gap, round(stable_PI, 9) AS stable_PI FROM b)"


@query("agg_pareto", f"WITH {_B9}, t AS (SELECT *, {_SHARES.format(m='stable_PI', k='segment, weekday')} FROM p) SELECT segment, weekday, {r('stable_PI')} AS stable_PI, CAST(rank AS INTEGER) AS rank, {r('share')} AS share, {r('cum_share')} AS cum_share FROM t")
def _(spark, d):
    by = ["segment", "weekday"]
    return B.pareto(_cut(B.prioritize(result(spark, d), by, gamma=20)), by).select(*by, "stable_PI", "rank", "share", "cum_share")


@query("agg_concentration", f"WITH {_B9}, t AS (SELECT *, {_SHARES.format(m='stable_PI', k='segment, weekday')} FROM p), h AS (SELECT unnest([0.5, 0.8, 0.9]) AS threshold) SELECT CAST(threshold AS DOUBLE) AS threshold, least((SELECT count(*) FROM t WHERE cum_share < threshold) + 1, (SELECT count(*) FROM t)) AS n_slices, (SELECT count(*) FROM t) AS n_all, {r('least((SELECT count(*) FROM t WHERE cum_share < threshold) + 1, (SELECT count(*) FROM t)) / (SELECT count(*) FROM t)')} AS share_of_slices FROM h")
def _(spark, d):
    by = ["segment", "weekday"]
    return B.concentration(_cut(B.prioritize(result(spark, d), by, gamma=20)), by)


def _overlap(a, b, k):
    return f"(SELECT count(*) FROM (SELECT segment, weekday FROM {a} WHERE stable_PI > 0 ORDER BY stable_PI DESC, segment, weekday LIMIT {k}) x JOIN (SELECT segment, weekday FROM {b} WHERE stable_PI > 0 ORDER BY stable_PI DESC, segment, weekday LIMIT {k}) y USING (segment, weekday))"


_B9F = backlog_sql(["segment", "weekday"], view="Finance", gamma=20)[len(S_LB) :].replace("b0 AS", "f0 AS").replace("\nb AS", "\nf AS").replace("FROM b0", "FROM f0")
_TWO = f"{_B9}{_B9F}, pf AS (SELECT segment, weekday, round(stable_PI, 9) AS stable_PI FROM f), o AS (SELECT {_overlap('p', 'pf', 10)} AS i, least((SELECT count(*) FROM p WHERE stable_PI > 0), 10) AS na, least((SELECT count(*) FROM pf WHERE stable_PI > 0), 10) AS nb)"


@query("agg_top_k_overlap", f"WITH {_TWO} SELECT {r('i / (na + nb - i)')} AS overlap FROM o")
def _(spark, d):
    t, by = result(spark, d), ["segment", "weekday"]
    return B.top_k_overlap(_cut(B.prioritize(t, by, view="Ops", gamma=20)), _cut(B.prioritize(t, by, view="Finance", gamma=20)), by, k=10)


_PAIR = "xy AS (SELECT round(score_Ops, 9) AS x, round(score_Finance, 9) AS y FROM s WHERE score_Ops IS NOT NULL AND score_Finance IS NOT NULL)"
_RANKS = "rk AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS x, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS y FROM xy)"


def _agreement(method, sql):
    @query(f"agg_view_agreement_{method}", f"WITH {_TWO}, {_PAIR}, {_RANKS}, cr AS ({sql}) SELECT 'Ops' AS view_a, 'Finance' AS view_b, {r('i / (na + nb - i)')} AS overlap, {r('c')} AS correlation FROM o, cr")
    def _(spark, d):
        return B.view_agreement(result(spark, d), ["segment", "weekday"], k=10, gamma=20, method=method)


_agreement("pearson", "SELECT corr(x, y) AS c FROM xy")
_agreement("spearman", "SELECT corr(x, y) AS c FROM rk")


_agreement("kendall", "SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(abs(sign(a.x - b.x))) * sum(abs(sign(a.y - b.y)))) AS c FROM xy a, xy b")


@query("agg_kendall", f"WITH {S_LB}, t AS (SELECT segment, weekday, round(avg(score_Ops), 9) AS x, round(avg(score_Finance), 9) AS y FROM s WHERE score_Ops IS NOT NULL AND score_Finance IS NOT NULL GROUP BY ALL) SELECT {r('sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(abs(sign(a.x - b.x))) * sum(abs(sign(a.y - b.y))))')} AS correlation FROM t a, t b")
def _(spark, d):
    t = result(spark, d)
    t = t.table.where(t.is_scored("Ops") & t.is_scored("Finance"))
    means = t.groupBy("segment", "weekday").agg(F.round(F.avg("score__Ops"), 9).alias("x"), F.round(F.avg("score__Finance"), 9).alias("y"))
    return B.score_correlation(means, "kendall")


@query(
    "agg_hotspots",
    f"""WITH {_B9}, {_DRIVERS[len(S_LB) + 2 :]}, h AS (SELECT *, row_number() OVER (ORDER BY stable_PI DESC, segment, weekday) AS place FROM p WHERE stable_PI > 0 ORDER BY stable_PI DESC, segment, weekday LIMIT 8),
kk AS (SELECT *, (rank() OVER (ORDER BY n_cases) + (count(*) OVER (PARTITION BY n_cases) - 1) / 2.0) - (rank() OVER (ORDER BY stable_gap) + (count(*) OVER (PARTITION BY stable_gap) - 1) / 2.0) AS lead FROM h),
x AS (SELECT *, row_number() OVER (ORDER BY lead DESC, place) = 1 AND lead > 0 AS res FROM kk), y AS (SELECT *, row_number() OVER (ORDER BY res, lead, place) = 1 AND lead < 0 AS sev FROM x)
SELECT y.segment, y.weekday, y.n_cases, {r('stable_PI')} AS stable_PI, CASE WHEN res THEN 'reservoir' WHEN sev THEN 'severity' ELSE 'mechanism' END AS role, dominant_layer FROM y LEFT JOIN dr ON y.segment = dr.segment""",
)
def _(spark, d):
    t, by = result(spark, d), ["segment", "weekday"]
    hot = B.hotspot_table(_cut(B.prioritize(t, by, view="Ops", gamma=20)), by, top=8)
    side = B.layer_drivers(t, "segment", view="Ops").select(F.col("segment").alias("_s"), "dominant_layer")
    return hot.join(side, F.col("segment") == F.col("_s"), "left").select("segment", "weekday", "n_cases", "stable_PI", "role", "dominant_layer")


_HALF = "first_ts"


@query(
    "agg_compare_periods",
    f"""WITH {S_LB}, h AS (SELECT *, right(case_id, 10) < '2024-01-16' AS early FROM s WHERE score_Ops IS NOT NULL AND NOT (right(case_id, 10) >= '2024-01-16' AND segment = '2')),
c AS (SELECT segment, early, count(*) AS n_cases, greatest((SELECT avg(score_Ops) FROM h g WHERE g.early = h.early) - avg(score_Ops), 0.0) AS gap FROM h GROUP BY segment, early),
j AS (SELECT coalesce(a.segment, b.segment) AS segment, a.n_cases AS nn, b.n_cases AS nb, a.gap AS gn, b.gap AS gb FROM (SELECT * FROM c WHERE NOT early) a FULL JOIN (SELECT * FROM c WHERE early) b ON a.segment = b.segment)
SELECT segment, nb AS n_cases_before, nn AS n_cases_now, {r('gb')} AS stable_gap_before, {r('gn')} AS stable_gap_now, {r('coalesce(nn, 0) - coalesce(nb, 0)')} AS n_cases_change, {r('coalesce(gn, 0) - coalesce(gb, 0)')} AS stable_gap_change FROM j""",
)
def _(spark, d):
    frame = result(spark, d).frame("Ops").withColumn("early", F.right("case_id", F.lit(10)) < "2024-01-16")
    old = B.prioritize(frame.where("early"), "segment")
    new = B.prioritize(frame.where("not early and segment <> '2'"), "segment")
    return B.compare_periods(old, new, "segment", ("n_cases", "stable_gap"))


@query("agg_estimate_gamma", f"WITH {S_LB}, t AS (SELECT user, count(*) AS n, avg(score_Ops) AS m, var_samp(score_Ops) AS v FROM (SELECT *, split_part(case_id, '-', 1) AS user FROM s) WHERE score_Ops IS NOT NULL GROUP BY user HAVING count(*) >= 2), e AS (SELECT sum(v * (n - 1)) / sum(n - 1) AS w, var_samp(m) AS b, avg(1.0 / n) AS i FROM t) SELECT {r('CASE WHEN b - w * i > 0 THEN w / (b - w * i) ELSE -1 END')} AS gamma FROM e")
def _(spark, d):
    frame = result(spark, d).frame("Ops").withColumn("user", F.split_part("case_id", F.lit("-"), F.lit(1)))
    g = B.estimate_gamma(frame, "user")
    return spark.createDataFrame([(-1.0 if g == float("inf") else g,)], "gamma double")


# diagnostics


@query("diag_timestamp_outliers", "SELECT event_id, ts < TIMESTAMP '2024-01-03' OR ts > TIMESTAMP '2024-01-25' AS outlier FROM events")
def _(spark, d):
    return D.timestamp_outliers(user_days(spark, d), ("2024-01-03 00:00:00", "2024-01-25 00:00:00")).select("event_id", "outlier")


@query("diag_right_censored", f"WITH {USERS} SELECT case_id, count(*) FILTER (act = 'purchase') < 1 AND max(us) >= epoch_us(TIMESTAMP '2024-01-31') - 3 * 86400000000 AS censored FROM ev GROUP BY case_id")
def _(spark, d):
    return D.right_censored(users(spark, d, window=(None, "2024-01-31 00:00:00")), "purchase", 3)


_CENSORED = "SELECT case_id, count(*) FILTER (act = 'purchase') < 1 AND max(us) >= epoch_us(TIMESTAMP '2024-01-31') - 10 * 86400000000 AS censored FROM ev GROUP BY case_id"


@query("diag_right_censored_opened", f"WITH {DAYS} SELECT case_id, count(*) FILTER (act = 'purchase') < 1 AND count(*) FILTER (act = 'view') > 0 AND max(us) >= epoch_us(TIMESTAMP '2024-01-31') - 10 * 86400000000 AS censored FROM ev GROUP BY case_id")
def _(spark, d):
    return D.right_censored(user_days(spark, d, window=(None, "2024-01-31 00:00:00")), "purchase", 10, opened_by="view")


@query("diag_left_truncated", f"WITH {DAYS} SELECT case_id, count(*) FILTER (act = 'signup') < 1 AND min(us) <= epoch_us(TIMESTAMP '2024-01-01') + 5 * 86400000000 AS truncated FROM ev GROUP BY case_id")
def _(spark, d):
    return D.left_truncated(user_days(spark, d, window=("2024-01-01 00:00:00", None)), "signup", 5)


_REPL = "SELECT case_id, CAST(sum(n) AS BIGINT) AS n_events, count(*) AS n_distinct_ts, sum(n) / count(*) AS ratio, sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n) AS tied_share FROM (SELECT case_id, us, count(*) AS n FROM ev GROUP BY ALL) GROUP BY case_id"


@query("diag_event_replication", f"WITH {ORDERS}, x AS ({_REPL}) SELECT case_id, n_events, n_distinct_ts, {r('ratio')} AS ratio, {r('tied_share')} AS tied_share FROM x")
def _(spark, d):
    return D.event_replication(order_log(spark, d))


@query("diag_cross_case_replication", f"WITH {ORDERS}, g AS (SELECT o_custkey, act, date_trunc('month', ts) AS m, count(DISTINCT case_id) > 1 AS several FROM ev GROUP BY ALL) SELECT case_id, {r('avg(CASE WHEN several THEN 1.0 ELSE 0.0 END)')} AS shared FROM (SELECT case_id, o_custkey, act, date_trunc('month', ts) AS m FROM ev) JOIN g USING (o_custkey, act, m) GROUP BY case_id")
def _(spark, d):
    log = order_log(spark, d)
    log.events = log.events.withColumn("m", F.date_trunc("month", "ts"))
    return D.cross_case_replication(log, "o_custkey", ["__act", "m"])


_RET = f"""{S_LB}, ce AS ({_CENSORED}), fl AS (SELECT s.*, NOT censored AS keep FROM s JOIN ce USING (case_id) WHERE score_Ops IS NOT NULL),
gr AS (SELECT segment, count(*) AS n_cases, count(*) FILTER (keep) AS n_kept, avg(score_Ops) AS m, avg(score_Ops) FILTER (keep) AS mk, (SELECT avg(score_Ops) FROM fl) AS g, avg(CASE WHEN keep THEN 0.0 ELSE 1.0 END) AS share_censored FROM fl GROUP BY segment),
re AS (SELECT *, greatest(n_cases / (n_cases + 20.0) * (g - m), 0.0) AS stable_gap, CASE WHEN n_kept > 0 THEN greatest(n_kept / (n_kept + 20.0) * (g - mk), 0.0) END AS kept_gap FROM gr)"""


@query("diag_gap_retained", f"WITH {_RET} SELECT segment, n_cases, n_kept, {r('stable_gap')} AS stable_gap, {r('kept_gap')} AS kept_gap, {r('CASE WHEN stable_gap > 0 THEN coalesce(kept_gap, 0) / stable_gap END')} AS retained FROM re")
def _(spark, d):
    log = user_days(spark, d, window=(None, "2024-01-31 00:00:00"))
    return D.gap_retained(score(log, norm()), "segment", D.right_censored(log, "purchase", 10), view="Ops", gamma=20)


@query(
    "diag_validation_table",
    f"""WITH {_RET}, x AS ({_REPL}), rp AS (SELECT segment, avg(CASE WHEN ratio >= 1.5 THEN 1.0 ELSE 0.0 END) AS share_replicated FROM s JOIN x USING (case_id) WHERE score_Ops IS NOT NULL GROUP BY segment),
t AS (SELECT segment, n_cases, stable_gap, n_cases * stable_gap AS stable_PI, share_censored, CASE WHEN stable_gap > 0 THEN coalesce(kept_gap, 0) / stable_gap END AS retained, share_replicated FROM re JOIN rp USING (segment))
SELECT segment, n_cases, {r('stable_gap')} AS stable_gap, {r('stable_PI')} AS stable_PI, {r('share_censored')} AS share_censored, {r('retained')} AS retained, {r('share_replicated')} AS share_replicated,
  coalesce(nullif(concat_ws('; ', CASE WHEN share_censored >= 0.5 THEN 'mostly open cases' END, CASE WHEN retained < 0.5 THEN 'gap fades without open cases' END, CASE WHEN share_replicated >= 0.5 THEN 'mostly replicated events' END), ''), 'stable signal') AS reading FROM t""",
)
def _(spark, d):
    log = user_days(spark, d, window=(None, "2024-01-31 00:00:00"))
    return D.validation_table(score(log, norm()), "segment", view="Ops", censored=D.right_censored(log, "purchase", 10), replication=D.event_replication(log), gamma=20, top=20)


# prepared assessments: severities from the user-day log with holes

CRITERIA = ("a", "b", "c")
WEIGHTS = {"main": {"a": 0.5, "b": 0.25, "c": 0.25}}
_PREP = f"""{DAYS}, w AS (SELECT case_id, any_value(segment) AS segment, count(*) AS n, sum(value) AS e, min(event_id) AS i FROM ev GROUP BY case_id),
pr AS (SELECT case_id, segment, i % 7 <> 0 AS sa, true AS sb, i % 3 <> 0 AS sc, CASE WHEN i % 7 <> 0 AND i % 5 <> 0 THEN least(n / 10.0, 1.0) END AS a, CASE WHEN i % 4 <> 0 THEN least(e / 2000.0, 1.0) END AS b, CASE WHEN i % 3 <> 0 THEN (i % 11) / 10.0 END AS c FROM w),
pq AS (SELECT *, (CASE WHEN sa THEN 0.5 ELSE 0.0 END) + 0.25 + (CASE WHEN sc THEN 0.25 ELSE 0.0 END) AS scoped, (CASE WHEN a IS NOT NULL THEN 0.5 ELSE 0.0 END) + (CASE WHEN b IS NOT NULL THEN 0.25 ELSE 0.0 END) + (CASE WHEN c IS NOT NULL THEN 0.25 ELSE 0.0 END) AS av,
  0.5 * coalesce(a, 0) + 0.25 * coalesce(b, 0) + 0.25 * coalesce(c, 0) AS known FROM pr),
ps AS (SELECT *, CASE WHEN av > 0 THEN 1 - known / av END AS score, av / scoped AS coverage, known / scoped AS low, (known + scoped - av) / scoped AS high FROM pq)"""


def prepared(spark, d):
    e = events(spark, d).groupBy(F.col("case").alias("case_id")).agg(F.first("segment").alias("segment"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("e"), F.min("event_id").alias("i"))
    i = F.col("i")
    return e.select(
        "case_id", "segment", (i % 7 != 0).alias("scope__a"), F.lit(True).alias("scope__b"), (i % 3 != 0).alias("scope__c"), F.when((i % 7 != 0) & (i % 5 != 0), F.least(F.col("n") / 10.0, F.lit(1.0))).alias("sev__a"),
        F.when(i % 4 != 0, F.least(F.col("e") / 2000.0, F.lit(1.0))).alias("sev__b"), F.when(i % 3 != 0, (i % 11) / 10.0).alias("sev__c"),
    )


def assessment(spark, d, mode="flat"):
    return A.score_prepared(prepared(spark, d), CRITERIA, WEIGHTS, mode=mode)


@query("assess_scores", f"WITH {_PREP} SELECT case_id, segment, {r('score')} AS score, {r('1 - score')} AS penalty, {r('coverage')} AS coverage, CAST(sa AS BIGINT) + 1 + CAST(sc AS BIGINT) AS n_in_scope, CAST(a IS NOT NULL AS BIGINT) + CAST(b IS NOT NULL AS BIGINT) + CAST(c IS NOT NULL AS BIGINT) AS n_evaluated, CAST(a IS NOT NULL AS BIGINT) + CAST(b IS NOT NULL AS BIGINT) + CAST(c IS NOT NULL AS BIGINT) AS n_weighted, {r('low')} AS penalty_low, {r('high')} AS penalty_high FROM ps")
def _(spark, d):
    return A.assessed(assessment(spark, d))


@query("assess_group_priorities", f"WITH {_PREP}, g AS (SELECT segment, count(*) AS n_total, count(*) FILTER (score IS NULL) AS n_unscored, count(score) AS n_cases, avg(score) AS m, (SELECT avg(score) FROM ps) AS gm FROM ps GROUP BY segment), h AS (SELECT *, greatest(gm - m, 0) AS gap FROM g) SELECT segment, n_total, n_unscored, n_cases, {r('m')} AS mean_score, {r('1 - m')} AS mean_penalty, {r('n_cases * (1 - m)')} AS total_penalty, {r('n_cases')} AS volume, {r('gm')} AS global_mean, {r('gap')} AS gap, {r('n_cases * gap')} AS PI, {r('gap * n_cases / (n_cases + 10.0)')} AS stable_gap, {r('n_cases * gap * n_cases / (n_cases + 10.0)')} AS stable_PI FROM h")
def _(spark, d):
    return A.group_priorities(A.assessed(assessment(spark, d)), "segment", gamma=10)


_PEN = {"a": "0.5 * coalesce(a, 0) / av", "b": "0.25 * coalesce(b, 0) / av", "c": "0.25 * coalesce(c, 0) / av"}


@query("assess_signed_components", f"WITH {_PREP}, g AS (SELECT segment, count(*) AS n, {', '.join(f'avg({x}) AS m{c}, (SELECT avg({x}) FROM ps WHERE av > 0) AS a{c}' for c, x in _PEN.items())} FROM ps WHERE av > 0 GROUP BY segment) SELECT segment, n AS n_cases, {', '.join(f'{r(f'(m{c} - a{c}) * n * n / (n + 10.0)')} AS component__{c}' for c in CRITERIA)}, {r('greatest((ma - aa + mb - ab + mc - ac) * n * n / (n + 10.0), 0)')} AS stable_PI FROM g")
def _(spark, d):
    return A.signed_components(assessment(spark, d), "segment", gamma=10)


@query("assess_coco", f"WITH {_PREP}, z AS (SELECT segment, 1 - score AS p, (SELECT avg(1 - score) FROM ps) AS m FROM ps WHERE score IS NOT NULL) SELECT segment, count(*) AS n_cases, {r('sum(p - m)')} AS numerator, {r('sum(p - m) / (SELECT sum(greatest(p - m, 0)) FROM z)')} AS coco FROM z GROUP BY segment")
def _(spark, d):
    return A.coco_same_target(A.assessed(assessment(spark, d)), "segment")


_SIG = "concat_ws('|', CASE WHEN a IS NOT NULL THEN 'a' END, CASE WHEN b IS NOT NULL THEN 'b' END, CASE WHEN c IS NOT NULL THEN 'c' END)"


@query("assess_coverage", f"WITH {_PREP} SELECT segment, count(*) AS n_cases, count(score) AS n_scored, {r('avg(coverage)')} AS mean_coverage, {r('min(coverage)')} AS min_coverage, {r('quantile_cont(coverage, 0.1)')} AS q10_coverage, count(DISTINCT {_SIG}) AS n_signatures FROM ps GROUP BY segment")
def _(spark, d):
    return A.coverage_diagnostics(assessment(spark, d), "segment")


@query("assess_signatures", f"WITH {_PREP} SELECT {_SIG} AS signature, count(*) AS n_cases FROM ps GROUP BY ALL")
def _(spark, d):
    return A.signature_counts(assessment(spark, d))


@query("assess_profiles", f"WITH {_PREP} " + " UNION ALL ".join(f"SELECT segment, '{c}' AS criterion, count({c}) AS n_evaluated, count(*) FILTER (s{c} AND {c} IS NULL) AS n_not_evaluable, count(*) FILTER (NOT s{c}) AS n_out_of_scope, {r(f'avg({c})')} AS mean_severity FROM ps GROUP BY segment" for c in CRITERIA))
def _(spark, d):
    return A.criterion_profiles(assessment(spark, d), "segment")


@query("assess_pivot", f"WITH {_PREP} SELECT case_id, {', '.join(f'{r(c)} AS sev__{c}' for c in CRITERIA)} FROM ps")
def _(spark, d):
    return A.pivot_severities(A.states(assessment(spark, d)), CRITERIA)


@query("assess_witnesses", f"WITH {_PREP}, z AS (SELECT segment, case_id, round(score, 9) AS score FROM ps WHERE score IS NOT NULL), m AS (SELECT segment, quantile_cont(score, 0.5) AS md FROM z GROUP BY segment) SELECT segment, (SELECT case_id FROM z y WHERE y.segment = m.segment ORDER BY score, case_id LIMIT 1) AS worst_case, (SELECT {r('min(score)')} FROM z y WHERE y.segment = m.segment) AS worst_score, (SELECT case_id FROM z y WHERE y.segment = m.segment ORDER BY abs(score - md), case_id LIMIT 1) AS median_case FROM m")
def _(spark, d):
    t = assessment(spark, d)
    t.table = t.table.withColumn("score__main", F.round("score__main", 9))
    return A.witnesses(t, "segment")


@query("assess_leave_one_out", f"WITH {_PREP} SELECT case_id, {r('CASE WHEN b IS NOT NULL OR c IS NOT NULL THEN 1 - (0.25 * coalesce(b, 0) + 0.25 * coalesce(c, 0)) / ((CASE WHEN b IS NOT NULL THEN 0.25 ELSE 0 END) + (CASE WHEN c IS NOT NULL THEN 0.25 ELSE 0 END)) END')} AS score FROM ps")
def _(spark, d):
    return A.without_criterion(assessment(spark, d), "a").frame("main").select("case_id", "score")


@query("assess_balance_observed", f"WITH {DAYS}, t AS (SELECT case_id, sum(value) FILTER (act = 'click') AS x, sum(value) FILTER (act = 'view') AS y FROM ev GROUP BY case_id) SELECT case_id, {r('CASE WHEN x IS NULL OR y IS NULL THEN NULL ELSE least(greatest((abs(x - y) / greatest(x, y, 1e-9) - 0.1) / 0.5, 0), 1) END')} AS v FROM t")
def _(spark, d):
    e = events(spark, d).groupBy(F.col("case").alias("case_id")).agg(F.sum(F.when(F.col("event_type") == "click", F.col("value"))).alias("x"), F.sum(F.when(F.col("event_type") == "view", F.col("value"))).alias("y"))
    return e.select("case_id", A.observed_balance(F.col("x"), F.col("y"), 0.1, 0.5).alias("v"))


_OFF = "CASE WHEN segment = '6' THEN score_Finance + 0.25 WHEN segment = '5' THEN NULL ELSE score_Finance END"


@query("assess_parity", f"WITH {S_FLAT}, o AS (SELECT case_id, {_OFF} AS score FROM s WHERE segment <> '7'), j AS (SELECT s.case_id AS a, o.case_id AS b, s.score_Finance AS x, o.score AS y FROM s FULL JOIN o ON s.case_id = o.case_id) SELECT count(*) FILTER (a IS NULL OR b IS NULL) AS unmatched_keys, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND (x IS NULL) <> (y IS NULL)) AS null_mismatches, {r('max(abs(x - y))')} AS residual__score FROM j")
def _(spark, d):
    """The event path against the prepared path, of which some scores are moved, some unknown and some rows missing."""
    t = result(spark, d, "flat")
    ids = t.ids
    prep = t.table.select("case_id", *(q(f"v__{c}").alias(f"sev__{c}") for c in ids), *(q(f"s__{c}").alias(f"scope__{c}") for c in ids))
    again = A.score_prepared(prep, ids, {"Finance": {c: w for c, w in t.norm.raw_weights("Finance").items()}}, LAYER_OF, "flat", validate=False)
    segments = t.table.select(F.col("case_id").alias("_id"), "segment").where("segment <> '7'")
    moved = again.frame("Finance").join(segments, F.col("case_id") == F.col("_id"))
    off = F.when(F.col("segment") == "6", F.col("score") + 0.25).when(F.col("segment") != "5", F.col("score"))
    return A.parity_residual(t.frame("Finance").select("case_id", "score"), moved.select("case_id", off.alias("score")), ["case_id"], ["score"])


_SF = S_FLAT[len(VIOLATIONS) :].replace("\ns AS", "\nsf AS")
_PS = _B9[len(S_LB) :]
_PF = _PS.replace("FROM s WHERE", "FROM sf WHERE").replace("b0", "f0").replace("\nb AS", "\nfb AS").replace(" FROM b)", " FROM fb)").replace(", p AS", ", pf AS")
_ALIKE = f"o AS (SELECT {_overlap('p', 'pf', 10)} AS i, least((SELECT count(*) FROM p WHERE stable_PI > 0), 10) AS na, least((SELECT count(*) FROM pf WHERE stable_PI > 0), 10) AS nb), jn AS (SELECT p.stable_PI AS x, pf.stable_PI AS y FROM p JOIN pf USING (segment, weekday)), rj AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS x, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS y FROM jn)"


def _sensitivity(name, variant, sf, support=0):
    kept = f"SELECT count(*) AS n, avg(score_Ops) AS m FROM sf WHERE score_Ops IS NOT NULL" if not support else f"SELECT sum(n_cases) AS n, sum(mean_score * n_cases) / sum(n_cases) AS m FROM fb WHERE n_cases >= {support}"
    pf = _PF.replace(" FROM fb)", f" FROM fb WHERE n_cases >= {support})")

    @query(f"assess_sensitivity_{name}", f"WITH {S_LB}{sf}{_PS}{pf}, {_ALIKE}, t AS ({kept}) SELECT '{name}' AS variant, CAST(n AS BIGINT) AS n_scored, {r('m')} AS mean_score, {r('(SELECT corr(x, y) FROM rj)')} AS correlation, {r('i / (na + nb - i)')} AS overlap FROM o, t")
    def _(spark, d):
        base = result(spark, d)
        return A.sensitivity(base, {name: variant(base)}, ["segment", "weekday"], view="Ops", gamma=20, min_cases={name: support})


_sensitivity("mode", lambda t: score(t.log, t.norm, mode="flat"), _SF)
_sensitivity("cohort", lambda t: A.cohort(t, {"weekday": ["2", "3", "4", "5", "6"]}), ", sf AS (SELECT * FROM s WHERE weekday IN ('2', '3', '4', '5', '6'))")
_sensitivity("support", lambda t: t, ", sf AS (SELECT * FROM s)", support=60)
_C3 = "(CASE WHEN nc <= 2 THEN 0.0 WHEN nc >= 7 THEN 1.0 ELSE (nc - 2) / 5.0 END)"
_sensitivity("threshold", lambda t: score(t.log, A.rescaled(t.norm, "c3", k=2, K=5)), ", sf AS (SELECT *" + S_LB[len(VIOLATIONS) :].split("SELECT *", 1)[1].rsplit("FROM v)", 1)[0] + f"FROM (SELECT * REPLACE ({_C3} AS c3) FROM v))")


@query("assess_compare_tables", f"WITH {_TWO}, jn AS (SELECT p.stable_PI AS x, pf.stable_PI AS y FROM p JOIN pf USING (segment, weekday)), rj AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS x, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS y FROM jn) SELECT {r('i / (na + nb - i)')} AS overlap, {r('(SELECT corr(x, y) FROM rj)')} AS correlation FROM o")
def _(spark, d):
    t, by = result(spark, d), ["segment", "weekday"]
    return A.compare_tables(_cut(B.prioritize(t, by, view="Ops", gamma=20)), _cut(B.prioritize(t, by, view="Finance", gamma=20)), by)


_SQL_DRAW = " + ".join(f"CAST(u >= {x!r} AS INTEGER)" for x in A.POISSON)


@query(
    "assess_bootstrap",
    f"""WITH {S_LB}, cl AS (SELECT split_part(case_id, '-', 1) AS c, segment AS g, count(score_Ops) AS n, sum(score_Ops) AS s FROM s GROUP BY ALL HAVING count(score_Ops) > 0),
u AS (SELECT c, rep, CAST(CAST('0x' || substr(md5('7|' || rep || '|' || c), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM (SELECT DISTINCT c FROM cl), (SELECT unnest(range(0, 100)) AS rep)),
m AS (SELECT c, rep, {_SQL_DRAW} AS m FROM u), t AS (SELECT rep, g, sum(m * n) AS n, sum(m * s) AS s FROM cl JOIN m USING (c) WHERE m > 0 GROUP BY ALL),
me AS (SELECT rep, sum(s) / sum(n) AS mean FROM t GROUP BY rep), gr AS (SELECT DISTINCT g, rep FROM cl, (SELECT unnest(range(0, 100)) AS rep)),
pi AS (SELECT gr.g, gr.rep, coalesce(round(greatest(mean - s / n, 0.0) * n, 12), 0.0) AS pi FROM gr LEFT JOIN t ON gr.g = t.g AND gr.rep = t.rep LEFT JOIN me ON gr.rep = me.rep),
bk AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY pi DESC, g) AS i FROM pi)
SELECT g AS segment, {r('quantile_cont(pi, 0.025)')} AS low, {r('quantile_cont(pi, 0.5)')} AS median, {r('quantile_cont(pi, 0.975)')} AS high, {r('count(*) FILTER (i <= 5 AND pi > 0) / 100')} AS top_share FROM bk GROUP BY g""",
)
def _(spark, d):
    frame = result(spark, d).frame("Ops").withColumn("user", F.split_part("case_id", F.lit("-"), F.lit(1)))
    return A.cluster_bootstrap(frame, "user", "segment", replicates=100)


@query(
    "assess_bootstrap_multinomial",
    f"""WITH {S_LB}, cl AS (SELECT split_part(case_id, '-', 1) AS c, segment AS g, count(score_Ops) AS n, sum(score_Ops) AS s FROM s GROUP BY ALL HAVING count(score_Ops) > 0),
num AS (SELECT c, row_number() OVER (ORDER BY md5(c), c) - 1 AS k FROM (SELECT DISTINCT c FROM cl)), size AS (SELECT count(*) AS n FROM num),
u AS (SELECT rep, CAST(floor(CAST(CAST('0x' || substr(md5('7|' || rep || '|draw|' || i), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 * n) AS BIGINT) AS k FROM size, (SELECT unnest(range(0, n)) AS i FROM size), (SELECT unnest(range(0, 100)) AS rep)),
m AS (SELECT c, rep, count(*) AS m FROM u JOIN num USING (k) GROUP BY ALL), t AS (SELECT rep, g, sum(m * n) AS n, sum(m * s) AS s FROM cl JOIN m USING (c) WHERE m > 0 GROUP BY ALL),
me AS (SELECT rep, sum(s) / sum(n) AS mean FROM t GROUP BY rep), gr AS (SELECT DISTINCT g, rep FROM cl, (SELECT unnest(range(0, 100)) AS rep)),
pi AS (SELECT gr.g, gr.rep, coalesce(round(greatest(mean - s / n, 0.0) * n, 12), 0.0) AS pi FROM gr LEFT JOIN t ON gr.g = t.g AND gr.rep = t.rep LEFT JOIN me ON gr.rep = me.rep),
bk AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY pi DESC, g) AS i FROM pi)
SELECT g AS segment, {r('quantile_cont(pi, 0.025)')} AS low, {r('quantile_cont(pi, 0.5)')} AS median, {r('quantile_cont(pi, 0.975)')} AS high, {r('count(*) FILTER (i <= 5 AND pi > 0) / 100')} AS top_share FROM bk GROUP BY g""",
)
def _(spark, d):
    frame = result(spark, d).frame("Ops").withColumn("user", F.split_part("case_id", F.lit("-"), F.lit(1)))
    return A.cluster_bootstrap(frame, "user", "segment", replicates=100, method="multinomial")


# sequences

_LAGGED = f"{USERS}, l AS (SELECT *, lag(act) OVER w AS before, row_number() OVER w AS i FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_id))"


@query("seq_runs", f"WITH {_LAGGED}, k AS (SELECT *, sum(CASE WHEN i = 1 OR act <> before THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY ts, event_id) AS run FROM l) SELECT case_id AS \"case\", CAST(run AS BIGINT) AS run, act AS event_type, count(*) AS length FROM k GROUP BY ALL")
def _(spark, d):
    return S.runs(events(spark, d, by_day=False), "case", ["ts", "event_id"], "event_type")


@query("seq_returns", f"WITH {_LAGGED}, h AS (SELECT *, lag(act, 2) OVER (PARTITION BY case_id ORDER BY ts, event_id) AS two FROM l WHERE i = 1 OR act <> before) SELECT case_id AS \"case\", count(*) - 1 AS n_changes, count(*) FILTER (act = two) AS n_returns FROM h GROUP BY case_id")
def _(spark, d):
    return S.returns(events(spark, d, by_day=False), "case", ["ts"], "event_type")


@query("seq_returns_turns", "WITH l AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM conversations), t AS (SELECT conv_id, max(n) > 1 AS tied FROM l GROUP BY conv_id), h AS (SELECT conv_id, role, lag(role, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS two FROM l WHERE b IS DISTINCT FROM role) SELECT h.conv_id, CASE WHEN NOT any_value(tied) THEN count(*) - 1 END AS n_changes, CASE WHEN NOT any_value(tied) THEN count(*) FILTER (role = two) END AS n_returns FROM h JOIN t ON h.conv_id = t.conv_id GROUP BY h.conv_id")
def _(spark, d):
    return S.returns(table(spark, d, "conversations"), "conv_id", ["turn"], "role")


@query("seq_repeated_states", f"WITH {USERS} SELECT case_id AS \"case\", CAST(sum(n - 1) AS BIGINT) AS n_repeated FROM (SELECT case_id, act, count(*) AS n FROM ev GROUP BY ALL) GROUP BY case_id")
def _(spark, d):
    return S.repeated_states(events(spark, d, by_day=False), "case", "event_type")


@query("seq_active_after", f"WITH {DAYS} SELECT case_id AS \"case\", CASE WHEN max(us) FILTER (act = 'purchase') IS NOT NULL THEN max(us) > max(us) FILTER (act = 'purchase') END AS active_after FROM ev GROUP BY case_id")
def _(spark, d):
    return S.active_after(events(spark, d), "case", "ts", "event_type", "purchase")


@query("seq_constant", "SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) END AS l_returnflag FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    return S.constant_in_case(table(spark, d, "lineitem").withColumn("l_orderkey", F.col("l_orderkey").cast("long")), "l_orderkey", "l_returnflag")


@query("seq_counter", f"WITH {USERS} SELECT case_id AS \"case\", {r('CASE WHEN min(value) >= 5 THEN max(value - 5) END')} AS counter FROM ev GROUP BY case_id")
def _(spark, d):
    return S.counter_total(events(spark, d, by_day=False).withColumn("counter", F.col("value") - 5), "case", "counter")


@query("seq_span", f"WITH {DAYS}, t AS (SELECT case_id, min(us) FILTER (act = 'view') AS a, max(us) FILTER (act = 'purchase') AS b FROM ev GROUP BY case_id) SELECT case_id AS \"case\", {r('CASE WHEN b >= a THEN (b - a) / 1e6 / 3600 END')} AS span, CASE WHEN a IS NULL AND b IS NULL THEN 'no_evidence' WHEN a IS NULL THEN 'no_start' WHEN b IS NULL THEN 'no_end' WHEN b < a THEN 'reversed' ELSE 'measured' END AS state FROM t")
def _(spark, d):
    e = user_days(spark, d).events
    return S.span(e, "case", "event_type", "__us", ["view"], ["purchase"], "h")


@query("seq_bands", "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 200000 THEN 'middle' ELSE 'large' END AS band, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    labels = S.period_labels(F.col("o_orderdate"))
    return o.select("o_orderkey", S.band(F.col("o_totalprice").cast("double"), [50000.0, 200000.0], ["small", "middle", "large"]).alias("band"), *(c.alias(k) for k, c in labels.items()))


@query("seq_breadth", "WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) SELECT CAST(o_custkey AS BIGINT) AS o_custkey, CAST(sum(n - 1) AS BIGINT) AS n_repeats, (SELECT count(DISTINCT o_orderstatus) FROM orders o WHERE o.o_custkey = c.o_custkey) AS n_resources FROM c GROUP BY o_custkey")
def _(spark, d):
    out = S.breadth(table(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_orderstatus")
    return out.withColumns({"o_custkey": F.col("o_custkey").cast("long"), "n_resources": F.col("n_resources").cast("long")})


@query("seq_same_sets", "WITH a AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_returnflag)) AS s FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_returnflag)) AS s FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) SELECT CAST(coalesce(a.k, b.k) AS BIGINT) AS l_orderkey, coalesce(a.s = b.s, false) AS same FROM a FULL JOIN b ON a.k = b.k")
def _(spark, d):
    lines = table(spark, d, "lineitem").withColumn("l_orderkey", F.col("l_orderkey").cast("long"))
    return S.same_sets(lines, lines.where("l_linestatus = 'O'"), "l_orderkey", "l_returnflag")


_LINKS = "SELECT l_orderkey AS event_id, 'part' AS object_type, CAST(l_partkey AS VARCHAR) AS object_id FROM lineitem UNION ALL SELECT l_orderkey, 'supplier', CAST(l_suppkey AS VARCHAR) FROM lineitem"


@query("seq_project_objects", f"WITH k AS ({_LINKS}), a AS (SELECT event_id, object_id AS case_id FROM k WHERE object_type = 'supplier'), b AS (SELECT event_id, object_id AS o FROM k WHERE object_type = 'part'), p AS (SELECT case_id, o, count(DISTINCT a.event_id) AS n FROM a LEFT JOIN b USING (event_id) GROUP BY ALL) SELECT p.case_id, (SELECT count(DISTINCT event_id) FROM a WHERE a.case_id = p.case_id) AS n_events, count(o) AS n_linked, max(n) AS max_events_of_one FROM p GROUP BY p.case_id")
def _(spark, d):
    lines = table(spark, d, "lineitem")
    links = lines.select(F.col("l_orderkey").alias("event_id"), F.lit("part").alias("object_type"), F.col("l_partkey").cast("string").alias("object_id")).union(
        lines.select(F.col("l_orderkey").alias("event_id"), F.lit("supplier").alias("object_type"), F.col("l_suppkey").cast("string").alias("object_id"))
    )
    return S.project_objects(links, "supplier", "part")


@query("seq_case_universe", "SELECT CAST(coalesce(a.k, b.k) AS BIGINT) AS \"key\", a.k IS NOT NULL AS in_master, b.k IS NOT NULL AS in_activity FROM (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P') a FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) b ON a.k = b.k")
def _(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("long").alias("key"))
    return S.case_universe(o, table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("key")), "key")


@query("seq_referential_audit", "SELECT (SELECT count(DISTINCT o_orderkey) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS master_only, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS orphans, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) AS matched")
def _(spark, d):
    return S.referential_audit(table(spark, d, "orders").select(F.col("o_orderkey").alias("key")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")), "key")


@query("seq_label_sets", f"WITH {DAYS} SELECT case_id AS \"case\", string_agg(act, ' + ' ORDER BY act) AS label_set FROM (SELECT DISTINCT case_id, act FROM ev) GROUP BY case_id")
def _(spark, d):
    return S.label_sets(events(spark, d), "case", "event_type")


@query("seq_extra_observations", f"WITH {DAYS} SELECT case_id AS \"case\", CAST(sum(CASE WHEN act = 'view' THEN 0 ELSE n - 1 END) AS BIGINT) AS n_extra FROM (SELECT case_id, act, count(*) AS n FROM ev GROUP BY ALL) GROUP BY case_id")
def _(spark, d):
    return S.extra_observations(events(spark, d), "case", "event_type", ["view"])


@query("seq_disjoint_union", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_keys FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    parts = [o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")]
    return S.disjoint_union(parts, "o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("n_keys"))


@query("seq_subset", "SELECT count(*) AS n_missing FROM (SELECT o_orderkey, o_orderstatus FROM orders EXCEPT ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F')")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return S.is_subset(o, o.where("o_orderstatus <> 'F'"))


# live scores, on the finished log


def live_norm():
    return Norm(
        (
            NormConstraint("p", "l", Presence("purchase")),
            NormConstraint("e", "l", Exclusion("error")),
            NormConstraint("c", "l", Singularity("click", 1, 2)),
            NormConstraint("g", "m", Lag("view", "purchase", 2, 6, "h", missing_a="skip", response="first_overall")),
            NormConstraint("b", "m", Balance("value", "purchase", "value", "click", 0.1, 0.5)),
        ),
        views=(View("all", constraint_weights={"p": 1, "e": 1, "c": 1, "g": 2, "b": 1}),),
        scoring_mode="flat",
    )


@query("stream_live_scores", f"WITH {VIOLATIONS}, x AS (SELECT *, CASE WHEN v1 IS NULL THEN NULL WHEN p1 IS NULL OR p1 < v1 THEN 1.0 ELSE least(greatest(((p1 - v1) / 1e6 / 3600.0 - 2) / 6, 0), 1) END AS g FROM v) SELECT case_id, n_events, {r('1 - (c1 + c2 + c3 + 2 * coalesce(g, 0) + c6) / (CASE WHEN g IS NULL THEN 4 ELSE 6 END)')} AS score FROM x")
def _(spark, d):
    """The events arrive in no order of time; every trigger tells the cases that changed."""
    live = live_scores(arriving(spark, d), live_norm(), case_col="case", activity_col="event_type", timestamp_col="ts", watermark=None, keep_forever=True)
    return fullest(spark, live, ["case_id"]).select("case_id", "n_events", F.col("score__all").alias("score"))


@query("stream_event_windows", "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01') AS window_start, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01') + INTERVAL '6 hours' AS window_end, event_type AS activity, count(*) AS n_events FROM events GROUP BY ALL")
def _(spark, d):
    """Windows over events that arrive in no order of time, all within the watermark."""
    windows = event_windows(arriving(spark, d), "ts", "event_type", "6 hours", watermark="10000 days")
    return fullest(spark, windows, ["window_start", "window_end", "activity"]).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "activity", "n_events")
