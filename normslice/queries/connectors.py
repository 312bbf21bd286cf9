"""Queries over files in formats that are cut or streamed, comparisons of tables, and rules on a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from normslice.functions.shared import shared_path
from normslice.operators import assessments as A
from normslice.operators import compare
from normslice.operators import sequences as S
from normslice.operators.scoring import first_examples, reason_profile, reasons, score
from normslice.plans.constraints import Exclusion, Lag, Metric, Presence, Singularity
from normslice.plans.families import Families, expand
from normslice.plans.norm import Norm, NormConstraint, View
from normslice.queries.logs import LAYER_OF, ORDERS, ROLES, VIOLATIONS, events, norm, order_log, query, r, sat, table, user_days
from normslice.queries.reports import S_LB
from normslice.sources import formats, ocel
from normslice.sources.eventlog import EventLog
from normslice.streaming.cases import score_stream


@query("src_xes_ranges", "WITH ev AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'giant' ELSE CAST(user_id AS VARCHAR) END AS case_id, * FROM events) SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id) - 1 AS INTEGER) AS event_position, event_type, ts FROM ev")
def _(spark, d):
    """Every event of a log with a third of all events in one trace, by its place there."""
    path = shared_path(spark, "xes")
    case = F.when(F.col("user_id") % 3 == 0, "giant").otherwise(F.col("user_id").cast("string"))
    formats.write_xes(table(spark, d, "events").withColumn("case", case), path, case_col="case", activity_col="event_type", timestamp_col="ts", order=["event_id"])
    rows = formats.read_xes(spark, path, strict=True)
    return rows.select(F.col("`case:concept:name`").alias("case_id"), "event_position", F.col("`concept:name`").alias("event_type"), F.col("`time:timestamp`").alias("ts"))


def _elements(spark, d):
    """Orders and customers as objects, the placing of an order as an event; with JSON and XML forms."""
    o = table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("oid"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("cid"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), "o_orderpriority", F.col("o_totalprice").cast("string").alias("price"))
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("cid"), "c_mktsegment")
    link = lambda *ends: F.array(*(F.struct(F.col(x).alias("objectId"), F.lit(y).alias("qualifier")) for x, y in ends))
    note = lambda name, x: F.array(F.struct(F.lit(name).alias("name"), F.lit("1970-01-01T00:00:00Z").alias("time"), F.col(x).alias("value")))
    happened = o.select(F.concat(F.lit("e"), "oid").alias("id"), F.lit("place").alias("type"), "time", link(("oid", "places"), ("cid", "placed by")).alias("relationships"))
    things = o.select(F.col("oid").alias("id"), F.lit("order").alias("type"), note("price", "price").alias("attributes"), link(("cid", "of")).alias("relationships"))
    return happened, things.unionByName(c.select(F.col("cid").alias("id"), F.lit("customer").alias("type"), note("segment", "c_mktsegment").alias("attributes"), F.expr("array()").cast("array<struct<objectId:string,qualifier:string>>").alias("relationships")))


def _written_json(happened, things, path):
    """A document for each partition, its elements in one list."""
    import pyarrow as pa

    def run(batches):
        text = lambda x: pa.RecordBatch.from_arrays([pa.array([x])], ["value"])
        yield text('{"objectTypes": [{"name": "order", "attributes": []}], "events": [')
        between = ""
        for batch in batches:
            if batch.num_rows:
                yield text(between + ", ".join(batch.column(0).to_pylist()))
                between = ", "
        yield text("]}")

    rows = happened.select(F.to_json(F.struct("*")).alias("value")).union(things.select(F.to_json(F.struct("*"))))
    rows.mapInArrow(run, "value string").write.text(path)


def _written_xml(happened, things, path):
    related = F.when(F.size("relationships") > 0, F.struct(F.transform("relationships", lambda x: F.struct(x["objectId"].alias("_object-id"), x["qualifier"].alias("_qualifier"))).alias("relationship"))).alias("objects")
    own = [F.col(c).alias(f"_{c}") for c in ("id", "type")]
    attributes = F.struct(F.transform("attributes", lambda x: F.struct(x["name"].alias("_name"), x["time"].alias("_time"), x["value"].alias("_VALUE"))).alias("attribute")).alias("attributes")
    happened.select(*own, F.col("time").alias("_time"), related).write.format("xml").options(rootTag="events", rowTag="event").mode("append").save(path)
    things.select(*own, attributes, related).write.format("xml").options(rootTag="objects", rowTag="object").mode("append").save(path)


_OCEL_SIZES = {"events": "orders", "objects": "(SELECT o_orderkey FROM orders UNION ALL SELECT c_custkey FROM customer)", "links": "(SELECT * FROM orders UNION ALL SELECT * FROM orders)", "object_links": "orders", "object_attributes": "(SELECT o_orderkey FROM orders UNION ALL SELECT c_custkey FROM customer)"}


@query("src_ocel_formats", " UNION ALL ".join(f"SELECT '{t}' AS part, '{f}' AS format, count(*) AS n, true AS same FROM {x}" for t, x in _OCEL_SIZES.items() for f in ("json", "xml")))
def _(spark, d):
    """A log of orders written as JSON and as XML: the digests of all tables read back equal those of the tables written."""
    happened, things = _elements(spark, d)
    paths = {f: shared_path(spark, f"ocel-{f}") for f in ("json", "xml")}
    _written_json(happened, things, paths["json"])
    _written_xml(happened, things, paths["xml"])
    want = ocel.tables_of(happened, things)
    rows = None
    for name, read in (("json", ocel.read_ocel), ("xml", ocel.read_ocel_xml)):
        found = read(spark, paths[name])
        for part in ocel.TABLES:
            a, b = compare.digest(found[part]), compare.digest(want[part]).toDF("n_", "total_", "mixed_")
            row = a.crossJoin(b).select(F.lit(part).alias("part"), F.lit(name).alias("format"), "n", ((F.col("n") == F.col("n_")) & (F.col("total") == F.col("total_")) & (F.col("mixed") == F.col("mixed_"))).alias("same"))  # one row each
            rows = row if rows is None else rows.unionByName(row)
    return rows


@query("src_read_ocel", "SELECT 'c' || o_custkey AS case_id, count(*) AS n_events, min(CAST(o_orderdate AS TIMESTAMP)) AS first_ts, max(c_mktsegment) AS segment FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def _(spark, d):
    """Customers' orders out of many JSON files."""
    happened, things = _elements(spark, d)
    path = shared_path(spark, "ocel")
    _written_json(happened.repartition(6), things.repartition(6), path)
    t = ocel.read_ocel(spark, path)
    links = t["links"].where("object_type = 'customer'").join(t["events"], "event_id")
    segment = t["object_attributes"].where("name = 'segment'").select("object_id", F.col("value").alias("segment"))
    return links.join(segment, "object_id").groupBy(F.col("object_id").alias("case_id")).agg(F.count(F.lit(1)).alias("n_events"), F.min("time").alias("first_ts"), F.max("segment").alias("segment"))


_LEFT = "SELECT CAST(user_id AS VARCHAR) AS case_id, event_type AS act, ts FROM events"
_RIGHT = "SELECT CAST(user_id AS VARCHAR) AS case_id, CASE WHEN event_id % 499 = 3 THEN 'changed' ELSE event_type END AS act, ts FROM events WHERE event_id % 389 <> 7"


@query("cmp_encodings", f"WITH a AS ({_LEFT}), b AS ({_RIGHT}), u AS (SELECT *, 1 AS s FROM a UNION ALL SELECT *, -1 FROM b) SELECT case_id, act, ts, CAST(sum(s) AS BIGINT) AS surplus FROM u GROUP BY ALL HAVING sum(s) <> 0")
def _(spark, d):
    """One log as XES and as CSV, of which some rows were lost and some changed: exactly those are found."""
    e = table(spark, d, "events").withColumn("case", F.col("user_id").cast("string"))
    xes, csv = shared_path(spark, "cmp-xes"), shared_path(spark, "cmp-csv")
    formats.write_xes(e, xes, case_col="case", activity_col="event_type", timestamp_col="ts", order=["event_id"])
    when = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    changed = F.when(F.col("event_id") % 499 == 3, "changed").otherwise(F.col("event_type"))
    e.where("event_id % 389 <> 7").select("case", changed.alias("act"), F.date_format("ts", when).alias("ts")).write.option("header", True).csv(csv)
    left = formats.read_xes(spark, xes, strict=True).select(F.col("`case:concept:name`").alias("case_id"), F.col("`concept:name`").alias("act"), F.col("`time:timestamp`").alias("ts"))
    right = formats.read_table(spark, csv, "case_id string, act string, ts string").withColumn("ts", F.to_timestamp("ts", when).cast("timestamp_ntz"))
    return compare.differing_rows(left, right)


_GIANT = "e AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'giant' ELSE CAST(user_id AS VARCHAR) END AS c, event_type AS act, ts, event_id FROM events), l AS (SELECT *, row_number() OVER w AS i, lag(act) OVER w AS before FROM e WINDOW w AS (PARTITION BY c ORDER BY ts, event_id))"


def _giant(spark, d):
    return table(spark, d, "events").withColumn("case", F.when(F.col("user_id") % 3 == 0, "giant").otherwise(F.col("user_id").cast("string")))


@query("seq_returns_giant", f"WITH {_GIANT}, h AS (SELECT *, lag(act, 2) OVER (PARTITION BY c ORDER BY ts, event_id) AS two FROM l WHERE i = 1 OR act <> before) SELECT c AS \"case\", count(*) - 1 AS n_changes, count(*) FILTER (act = two) AS n_returns FROM h GROUP BY c")
def _(spark, d):
    """Changes and returns where one case has a third of all events: its stretches are many tasks' work."""
    return S.returns(_giant(spark, d), "case", ["ts", "event_id"], "event_type", stretches=24)


@query("seq_runs_giant", f"WITH {_GIANT}, k AS (SELECT *, sum(CASE WHEN i = 1 OR act <> before THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY ts, event_id) AS run FROM l) SELECT c AS \"case\", CAST(run AS BIGINT) AS run, act AS event_type, count(*) AS length FROM k GROUP BY ALL")
def _(spark, d):
    return S.runs(_giant(spark, d), "case", ["ts", "event_id"], "event_type", stretches=24)


# families of activities, reasons, patterns

_FAMILIES = Families({"shipping": ["ship_*"], "returned": ["ship_R"], "kept": ["ship_A", "ship_N"], "unknown": ["nothing*"]})


def family_norm():
    return Norm(
        (
            NormConstraint("repeated", "l", Singularity("@shipping", 2, 3)),
            NormConstraint("handled", "l", Lag("place", "@shipping", 20, 40, "D", missing_a="skip")),
            NormConstraint("kept", "m", Presence("@kept", 2), applicability={"has": ["@shipping"]}),
            NormConstraint("returned", "m", Exclusion("@returned")),
            NormConstraint("never", "m", Exclusion("@unknown")),
        ),
        views=(View("all", constraint_weights={"repeated": 1, "handled": 2, "kept": 1, "returned": 1, "never": 1}),),
        scoring_mode="flat",
    )


_FAMILY_SQL = f"""WITH {ORDERS}, g AS (SELECT case_id, count(*) FILTER (act LIKE 'ship_%') AS n, count(*) FILTER (act IN ('ship_A', 'ship_N')) AS k, count(*) FILTER (act = 'ship_R') AS b, min(us) FILTER (act = 'place') AS p FROM ev GROUP BY case_id),
f AS (SELECT case_id, min(us) FILTER (act LIKE 'ship_%' AND us >= p) AS s FROM ev JOIN (SELECT case_id, p FROM g) USING (case_id) GROUP BY case_id),
v AS (SELECT case_id, {sat('CAST(n AS DOUBLE)', 2.0, 3.0)} AS v1, CASE WHEN p IS NULL THEN NULL WHEN s IS NULL THEN 1.0 ELSE {sat('(s - p) / 1e6 / 86400.0', 20.0, 40.0)} END AS v2, CASE WHEN n > 0 THEN 1 - least(k / 2.0, 1) END AS v3, CASE WHEN b > 0 THEN 1.0 ELSE 0.0 END AS v4 FROM g JOIN f USING (case_id))
SELECT case_id, {r('1 - (v1 + 2 * coalesce(v2, 0) + coalesce(v3, 0) + v4) / (3 + CASE WHEN v2 IS NULL THEN 0 ELSE 2 END + CASE WHEN v3 IS NULL THEN 0 ELSE 1 END)')} AS score FROM v"""


@query("fam_scores", _FAMILY_SQL)
def _(spark, d):
    """A norm over families of activities."""
    log = order_log(spark, d)
    return score(log, expand(family_norm(), _FAMILIES, log.activity_labels())).frame("all").select("case_id", "score")


@query("fam_interval", f"WITH {ORDERS}, x AS (SELECT case_id, act, CASE WHEN line = 6 THEN NULL ELSE us END AS us FROM ev), g AS (SELECT case_id, min(us) FILTER (act = 'place') AS a, min(us) FILTER (act LIKE 'ship_%') AS b, count(*) FILTER (us IS NULL) AS bad FROM x GROUP BY case_id), s AS (SELECT *, CASE WHEN bad > 0 THEN 'invalid' WHEN b IS NULL THEN 'no_end' WHEN b < a THEN 'reversed' ELSE 'measured' END AS state FROM g) SELECT case_id AS \"case\", state, {r("CASE WHEN state = 'measured' THEN (b - a) / 1e6 / 86400.0 END")} AS span FROM s")
def _(spark, d):
    """Order to first shipment; an order with a shipment of unknown time has no duration."""
    log = order_log(spark, d)
    shipped = _FAMILIES.dictionary(log.activity_labels())["shipping"]
    broken = log.events.withColumn("__us", F.when(F.col("line") != 6, F.col("__us")))
    return S.first_interval(broken, "case", "act", "__us", ["place"], shipped)


@query("fam_events", "SELECT event_type, CASE WHEN event_type LIKE 'c%' THEN 'c' WHEN event_type IN ('view', 'purchase') THEN 'shop' END AS family, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    log = user_days(spark, d)
    found = Families({"c": ["c*"], "shop": ["view", "purchase"]}).labelled(log.events, "event_type", log.activity_labels())
    return found.groupBy("event_type", "family").agg(F.count(F.lit(1)).alias("n"))


_C_REASONS = {"c4": "CASE WHEN v1 IS NULL THEN 'no view' END", "c5": "CASE WHEN p1 IS NULL THEN 'no purchase' END"}
_REASONS = " UNION ALL ".join(
    f"SELECT segment, '{c}' AS \"constraint\", {'s8' if c == 'c8' else 'true'} AS s, {c} IS NOT NULL AS known, {_C_REASONS.get(c, 'NULL')} AS why FROM v" for c in LAYER_OF
)


@query("assess_reasons", f"WITH {VIOLATIONS}, x AS ({_REASONS}) SELECT segment, \"constraint\", CASE WHEN NOT s THEN 'out_of_scope' WHEN known THEN 'assessed' ELSE 'unavailable' END AS state, CASE WHEN NOT s THEN 'segment is not listed' WHEN NOT known THEN why END AS reason, count(*) AS n_cases FROM x GROUP BY ALL")
def _(spark, d):
    """Why criteria are out of scope or cannot be evaluated, by segment."""
    return reason_profile(reasons(user_days(spark, d), norm()), ["segment"])


@query("assess_examples", f"WITH {VIOLATIONS}, x AS ({_REASONS.replace('SELECT segment, ', 'SELECT case_id, ')}) SELECT \"constraint\", CASE WHEN NOT s THEN 'out_of_scope' WHEN known THEN 'assessed' ELSE 'unavailable' END AS state, CASE WHEN NOT s THEN 'segment is not listed' WHEN NOT known THEN why END AS reason, count(*) AS n_cases, min(case_id) AS example FROM x GROUP BY ALL")
def _(spark, d):
    """The first example of every evidence state."""
    return first_examples(reasons(user_days(spark, d), norm()))


@query("assess_sensitivity_collapse", f"WITH {S_LB} SELECT 'collapse' AS variant, count(score_Ops) AS n_scored, {r('avg(score_Ops)')} AS mean_score FROM s")
def _(spark, d):
    """A log in which each tenth event was recorded twice: repeated events collapsed, as a variant of the log as it is."""
    e = events(spark, d)
    twice = e.unionByName(e.where("event_id % 10 = 3").withColumn("event_id", F.col("event_id") + 10_000_000))
    roles = ROLES | {"case_attributes": ["segment", "weekday"], "exposure_col": "value", "exposure_agg": "sum", "validate": False, "long_traces": False}
    base, collapsed = (score(EventLog(twice, **roles, dedupe=x), norm()) for x in (False, True))
    return A.sensitivity(base, {"collapse": collapsed}, ["segment"], view="Ops").select("variant", "n_scored", "mean_score")


@query("rec_where_python", "WITH e AS (SELECT CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS case_id, event_type FROM events) SELECT case_id, CAST(count(*) FILTER (regexp_matches(event_type, '^(?:p|s).*[hnp]$')) AS DOUBLE) AS hits, CASE WHEN count(*) > 2 AND NOT count(*) > 4 OR count(*) = 1 THEN 1.0 ELSE 0.0 END AS few FROM e GROUP BY case_id")
def _(spark, d):
    """A pattern in Python's syntax, and an expression with ``&``, ``|`` and ``~``."""
    recipes = ({"name": "hits", "kind": "count_events", "where": {"column": "event_type", "regex": r"\A(?P<first_one>[ps]).*[hnp]\Z"}}, {"name": "few", "kind": "eval", "expr": "n_events > 2 & ~(n_events > 4) | abs(n_events) == 1"})
    small = Norm((NormConstraint("h", "l", Metric("hits", 1, 1)),), views=(View("all", constraint_weights={"h": 1}),), derived_attributes=recipes, scoring_mode="flat")
    return score(user_days(spark, d), small).frame("all").select("case_id", "hits", "few")


@query("stream_case_rules", f"WITH {S_LB} SELECT case_id, n_events, {r('score_Ops')} AS score__Ops, {r('score_Finance')} AS score__Finance FROM s")
def _(spark, d):
    """The norm with its as-of and scoped rules on a real stream: the events in files of eight, two a trigger; a case's row is its fullest."""
    source, told, state = (shared_path(spark, f"stream-{x}") for x in ("in", "told", "state"))
    rows = events(spark, d).drop("props").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(8, F.xxhash64("event_id")).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    roles = ROLES | {"case_attributes": ["segment", "weekday"]}
    query_ = score_stream(stream, norm(), lambda batch, number: batch.write.mode("append").parquet(told), state, roles=roles, idle_seconds=10**9, watermark="10000 days", columns=["value"])
    query_.awaitTermination()
    newest = F.max_by(F.struct("n_events", "score__Ops", "score__Finance"), "n_events").alias("x")
    return spark.read.parquet(told).groupBy("case_id").agg(newest).select("case_id", "x.*")
