"""The logs that the registered queries run on, in Spark and in SQL, and the suite that collects both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normslice.functions.shared import shared_path
from normslice.plans.constraints import Balance, Exclusion, Lag, Metric, Precedence, Presence, Singularity
from normslice.plans.norm import Layer, Norm, NormConstraint, View
from normslice.sources.eventlog import EventLog
from normslice.streaming.live import upsert

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query; floats are rounded at the very end, on both sides (moved off ties of the rounding by 1e-9)."""

    def add(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(build(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*((F.round(F.col(f"`{c}`") + F.lit(1e-9), 6) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))


def r(sql: str) -> str:
    """A rounded expression."""
    return f"round(CAST({sql} AS DOUBLE) + 1e-9, 6) + 0.0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(c: Column) -> Column:
    return c.cast("string")


def events(spark: SparkSession, sf_dir: str, by_day: bool = True) -> DataFrame:
    e = table(spark, sf_dir, "events")
    case = F.concat(text(F.col("user_id")), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")) if by_day else text(F.col("user_id"))
    return e.select(
        case.alias("case"), "event_type", "ts", "event_id", "value", text(F.col("user_id") % 8).alias("segment"), text(F.dayofweek("ts")).alias("weekday"), "user_id", "props"
    )


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a real stream: eight files in no order of time, two a trigger."""
    rows = events(spark, sf_dir).drop("props").withColumn("ts", F.col("ts").cast("timestamp"))
    source = shared_path(spark, "stream-in")
    rows.repartition(8, F.xxhash64("event_id")).write.parquet(source)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)


def fullest(spark: SparkSession, stream: DataFrame, keys: list[str]) -> DataFrame:
    """Runs a stream of growing groups to its end; the last row that was told of each, the one of most events."""
    told, state = shared_path(spark, "stream-told"), shared_path(spark, "stream-state")
    upsert(stream, lambda batch, number: batch.write.mode("append").parquet(told), state).awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    return spark.read.schema(stream.schema).parquet(told).groupBy(*keys).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in rest)), "n_events").alias("_x")).select(*keys, "_x.*")


ROLES = {"case_col": "case", "activity_col": "event_type", "timestamp_col": "ts", "order_col": "event_id"}


def user_days(spark: SparkSession, sf_dir: str, **roles) -> EventLog:
    """Short traces: a case is a user's day."""
    return EventLog(events(spark, sf_dir), **(ROLES | {"case_attributes": ["segment", "weekday"], "exposure_col": "value", "exposure_agg": "sum", "validate": False, "long_traces": False} | roles))


def users(spark: SparkSession, sf_dir: str, **roles) -> EventLog:
    """Long traces: a case is a user."""
    return EventLog(events(spark, sf_dir, by_day=False), **(ROLES | {"case_attributes": ["segment"], "validate": False, "long_traces": False} | roles))


def _ev(case: str) -> str:
    return f"""ev AS (SELECT {case} AS case_id, event_type AS act, ts, epoch_us(ts) AS us, event_id, value, user_id, props,
  CAST(user_id % 8 AS VARCHAR) AS segment, CAST(dayofweek(ts) + 1 AS VARCHAR) AS weekday FROM events)"""


DAYS = _ev("CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d')")
USERS = _ev("CAST(user_id AS VARCHAR)")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's placing and the shipping of its lines, with the customer's segment."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    head = o.select(F.col("o_orderkey").alias("key"), "o_custkey", "o_orderstatus", F.lit("place").alias("act"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").cast("double").alias("amount"), F.lit(0).cast("long").alias("line"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("ship_"), F.col("l_returnflag")).alias("act"), F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").cast("double").alias("amount"), F.col("l_linenumber").cast("long").alias("line")
    )
    rest = lines.join(o.select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey").select(F.col("o_orderkey").alias("key"), "o_custkey", "o_orderstatus", "act", "ts", "amount", "line")
    return head.union(rest).join(c, "o_custkey", "left").withColumn("case", text(F.col("key")))


def order_log(spark: SparkSession, sf_dir: str, **roles) -> EventLog:
    return EventLog(orders(spark, sf_dir), **({"case_col": "case", "activity_col": "act", "timestamp_col": "ts", "order_col": "line", "case_attributes": ["o_orderstatus", "c_mktsegment"], "validate": False, "long_traces": False} | roles))


ORDERS = """ev AS (SELECT CAST(o.key AS VARCHAR) AS case_id, o.*, epoch_us(o.ts) AS us, c.c_mktsegment FROM (
  SELECT o_orderkey AS key, o_custkey, o_orderstatus, 'place' AS act, CAST(o_orderdate AS TIMESTAMP) AS ts, CAST(o_totalprice AS DOUBLE) AS amount, CAST(0 AS BIGINT) AS line FROM orders
  UNION ALL SELECT l_orderkey, o_custkey, o_orderstatus, 'ship_' || l_returnflag, CAST(l_shipdate AS TIMESTAMP), CAST(l_extendedprice AS DOUBLE), CAST(l_linenumber AS BIGINT) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) o
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey)"""


def sat(z: str, threshold: float, width: float) -> str:
    if width <= 0:
        return f"(CASE WHEN ({z}) IS NULL THEN NULL WHEN ({z}) > {threshold} THEN 1.0 ELSE 0.0 END)"
    return f"(CASE WHEN ({z}) IS NULL THEN NULL WHEN ({z}) <= {threshold} THEN 0.0 WHEN ({z}) >= {threshold + width} THEN 1.0 ELSE (({z}) - {threshold}) / {width} END)"


LAYERS = ("outcome", "hygiene", "effort", "lead", "match")
LAYER_OF = {"c1": "outcome", "c2": "hygiene", "c3": "effort", "c4": "lead", "c5": "hygiene", "c6": "match", "c7": "match", "c8": "outcome"}
WITHIN = {"c1": 2.0, "c2": 1.0, "c3": 1.0, "c4": 1.0, "c5": 1.0, "c6": 1.0, "c7": 1.0, "c8": 1.0}
OPS = {"outcome": 3.0, "hygiene": 2.0, "effort": 1.0, "lead": 2.0, "match": 1.0}
FINANCE = {"c1": 0.2, "c2": 0.1, "c3": 0.05, "c4": 0.3, "c6": 0.2, "c7": 0.15}


def norm() -> Norm:
    """All kinds of constraints over the user-day log, two views, a derived attribute and a rule."""
    body = {
        "c1": Presence("purchase"),
        "c2": Exclusion("error"),
        "c3": Singularity("click", 1, 2),
        "c4": Lag("view", "purchase", 2, 6, "h", missing_a="skip"),
        "c5": Precedence("purchase", "error"),
        "c6": Balance("value", "purchase", "value", "click", 0.1, 0.5),
        "c7": Metric("mean_value", 200, 200),
        "c8": Presence("signup"),
    }
    rule = {"c8": {"segment": ["0", "1", "2"]}}
    constraints = tuple(NormConstraint(c, LAYER_OF[c], body[c], WITHIN[c], rule.get(c)) for c in body)
    derived = ({"name": "mean_value", "kind": "agg", "column": "value", "agg": "mean"},)
    return Norm(constraints, tuple(map(Layer, LAYERS)), (View("Ops", layer_weights=OPS), View("Finance", constraint_weights=FINANCE)), derived, name="user days")


#: Violations of the norm in SQL: table ``v`` with ``c1`` to ``c8``, case columns, and scope ``s8`` (the others always apply).
VIOLATIONS = f"""{DAYS},
g AS (SELECT case_id, any_value(segment) AS segment, any_value(weekday) AS weekday, count(*) AS n_events, sum(value) AS exposure, avg(value) AS mean_value,
  count(*) FILTER (act = 'purchase') AS np, count(*) FILTER (act = 'error') AS ne, count(*) FILTER (act = 'click') AS nc, count(*) FILTER (act = 'signup') AS ns,
  min(us) FILTER (act = 'view') AS v1, min(us) FILTER (act = 'purchase') AS p1,
  coalesce(sum(value) FILTER (act = 'purchase'), 0) AS xp, coalesce(sum(value) FILTER (act = 'click'), 0) AS xc FROM ev GROUP BY case_id),
k AS (SELECT case_id, min(us) FILTER (act = 'purchase' AND us >= v1) AS pv, count(*) FILTER (act = 'error' AND us < p1) AS eb FROM ev JOIN (SELECT case_id, v1, p1 FROM g) USING (case_id) GROUP BY case_id),
v AS (SELECT g.*, CASE WHEN np > 0 THEN 0.0 ELSE 1.0 END AS c1, CASE WHEN ne > 0 THEN 1.0 ELSE 0.0 END AS c2, {sat('CAST(nc AS DOUBLE)', 1.0, 2.0)} AS c3,
  CASE WHEN v1 IS NULL THEN NULL WHEN pv IS NULL THEN 1.0 ELSE {sat('(pv - v1) / 1e6 / 3600.0', 2.0, 6.0)} END AS c4,
  CASE WHEN p1 IS NULL THEN NULL ELSE {sat('CAST(eb AS DOUBLE)', 0.0, 1.0)} END AS c5, {sat('abs(xp - xc) / greatest(xp, xc, 1e-9)', 0.1, 0.5)} AS c6,
  {sat('mean_value', 200.0, 200.0)} AS c7, CASE WHEN segment IN ('0', '1', '2') THEN CASE WHEN ns > 0 THEN 0.0 ELSE 1.0 END END AS c8, segment IN ('0', '1', '2') AS s8
  FROM g JOIN k USING (case_id))"""


def weights(view: str) -> dict[str, float]:
    if view == "Finance":
        return FINANCE
    sums = {x: sum(w for c, w in WITHIN.items() if LAYER_OF[c] == x) for x in LAYERS}
    return {c: OPS[LAYER_OF[c]] * WITHIN[c] / sums[LAYER_OF[c]] for c in LAYER_OF}


def effective(view: str, mode: str) -> dict[str, str]:
    """SQL of the effective weight of each constraint."""
    w = {c: x for c, x in weights(view).items() if x > 0}
    live = {c: f"(CASE WHEN {c} IS NOT NULL THEN {x!r} ELSE 0.0 END)" for c, x in w.items()}
    if mode == "flat":
        base = "(" + " + ".join(live.values()) + ")"
        return {c: f"(CASE WHEN {base} > 0 THEN {e} / {base} ELSE 0.0 END)" for c, e in live.items()}
    groups = {x: [c for c in w if LAYER_OF[c] == x] for x in LAYERS if any(LAYER_OF[c] == x for c in w)}
    inner = {x: "(" + " + ".join(live[c] for c in cs) + ")" for x, cs in groups.items()}
    share = {x: sum(w[c] for c in cs) for x, cs in groups.items()}
    active = "(" + " + ".join(f"(CASE WHEN {inner[x]} > 0 THEN {share[x]!r} ELSE 0.0 END)" for x in groups) + ")"
    return {c: f"(CASE WHEN {inner[LAYER_OF[c]]} > 0 THEN {share[LAYER_OF[c]]!r} * {live[c]} / {inner[LAYER_OF[c]]} / {active} ELSE 0.0 END)" for c in w}


def scored_sql(mode: str = "layer_balanced") -> str:
    """``v`` and ``s``: case columns, violations, ``score_<view>``, ``d_<view>_<layer>`` and ``pen_<view>_<c>``."""
    columns = []
    for view in ("Ops", "Finance"):
        e = effective(view, mode)
        some = " OR ".join(f"{c} IS NOT NULL" for c in e)
        pen = {c: f"({x}) * coalesce({c}, 0.0)" for c, x in e.items()}
        columns.append(f"CASE WHEN {some} THEN 1 - ({' + '.join(pen.values())}) END AS score_{view}")
        for layer in LAYERS:
            parts = [p for c, p in pen.items() if LAYER_OF[c] == layer] or ["0.0"]
            columns.append(f"CASE WHEN {some} THEN {' + '.join(parts)} END AS d_{view}_{layer}")
        columns += [f"{pen.get(c, '0.0')} AS pen_{view}_{c}" for c in LAYER_OF]
    return f"{VIOLATIONS},\ns AS (SELECT *, {', '.join(columns)} FROM v)"
