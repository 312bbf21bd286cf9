"""Times the steps of a whole analysis on a made log of 250,000 cases and 1.6 million events, warm and apart; prints one JSON line.

The log: purchase-to-pay, 7 activities, 20 companies x 2,000 vendors; 10 constraints in 5 layers under 4 views, layer-balanced.
Each step but the first reads what the one before persisted. ``plan`` is the driver's time to build the plan, without a job.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


def events(spark, cases: int):
    """About 6.4 events a case, by arithmetic on the ids: any size, the same everywhere."""
    from pyspark.sql import functions as F

    h = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 20)) / float(1 << 20)
    c = spark.range(cases).withColumn("n", F.lit(4) + F.floor(h(F.col("id"), F.lit(1)) * 6).cast("int"))
    e = c.select("id", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    later = F.when(F.col("i") == 0, "order").when(F.col("i") == 1, "receipt").when(F.col("i") == 2, "invoice").when(h("id", "i") < 0.55, "clear").when(h("id", "i") < 0.75, "receipt").when(h("id", "i") < 0.9, "change").when(h("id", "i") < 0.96, "cancel").otherwise("memo")
    day = F.floor(h("id", F.lit(2)) * 300) + F.floor(F.col("i") * 6 + h("id", "i", F.lit(3)) * 12)
    return e.select(
        F.col("id").alias("case"), later.alias("activity"), F.timestamp_seconds(1_704_067_200 + day.cast("long") * 86_400 + F.col("i")).cast("timestamp_ntz").alias("time"), F.round(50 + 900 * h("id", F.lit(4)) + F.when(h("id", "i") < 0.1, 20).otherwise(0), 2).alias("amount"),
        F.concat(F.lit("c"), F.floor(20 * h("id", F.lit(5)) * h("id", F.lit(5))).cast("string")).alias("company"), F.concat(F.lit("v"), F.floor(2000 * h("id", F.lit(6))).cast("string")).alias("vendor"), F.when(h("id", F.lit(7)) < 0.6, "f1").otherwise("f2").alias("flow"), F.col("i").alias("seq"),
    )


def norm():
    from normslice.plans.constraints import Balance, Exclusion, Lag, Metric, Precedence, Presence, Singularity
    from normslice.plans.norm import Norm, NormConstraint, View

    body = [
        ("done", Presence("invoice")), ("done", Presence("clear")), ("time", Lag("receipt", "invoice", 10, 20)), ("time", Lag("invoice", "clear", 30, 60, missing="skip", response="first_overall")), ("match", Balance("amount", "invoice", "amount", "receipt", 0.05, 0.2)),
        ("match", Precedence("receipt", "invoice")), ("work", Singularity("receipt", 2, 3)), ("work", Singularity("change", 0, 2)), ("odd", Exclusion("cancel")), ("odd", Metric("changes", 1, 3)),
    ]
    layers = list(dict.fromkeys(x for x, _ in body))
    constraints = tuple(NormConstraint(f"c{i}", x, b, 1.0 + i % 3, {"flow": ["f1"]} if i == 5 else None) for i, (x, b) in enumerate(body))
    views = tuple(View(f"view{k}", layer_weights={x: 1.0 + (i + k) % 4 for i, x in enumerate(layers)}) for k in range(4))
    return Norm(constraints, views=views, derived_attributes=({"name": "changes", "kind": "count_events", "where": {"column": "activity", "eq": "change"}},))


def main() -> None:
    from pyspark.sql import SparkSession

    from normslice.operators import backlog as B
    from normslice.operators import diagnostics as D
    from normslice.operators.scoring import score
    from normslice.sources.eventlog import EventLog

    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    rows = events(spark, int(os.environ.get("BENCH_CASES", "250000"))).persist()
    n = rows.count()
    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    taken: dict[str, float] = {}

    def step(name: str, build) -> None:
        best = None
        for _ in range(2):  # the second is warm
            start = time.perf_counter()
            df = build()
            planned = time.perf_counter()
            noop(df)
            best = (round(planned - start, 3), round(time.perf_counter() - planned, 3))
        taken[f"{name}_plan"], taken[name] = best

    log = EventLog(rows, case_col="case", activity_col="activity", timestamp_col="time", case_attributes=["company", "vendor", "flow"], exposure_col="amount", order_col="seq", validate=False, long_traces=False)
    step("build", lambda: log.cases)
    step("score", lambda: score(log, norm()).table)
    result = score(log, norm()).persist()
    noop(result.table)
    by = ["company", "vendor"]
    step("prioritize", lambda: B.prioritize(result, by, gamma=20))
    step("layer_drivers", lambda: B.layer_drivers(result, by))
    step("constraint_drivers", lambda: B.constraint_drivers(result))
    step("view_agreement", lambda: B.view_agreement(result, by, k=20, gamma=20, method="spearman"))
    step("right_censored", lambda: D.right_censored(log, "clear", 60))
    step("event_replication", lambda: D.event_replication(log))
    censored, replication = D.right_censored(log, "clear", 60).persist(), D.event_replication(log).persist()
    noop(censored)
    noop(replication)
    step("validation_table", lambda: D.validation_table(result, by, censored=censored, replication=replication, gamma=20))
    print(json.dumps({"metric": "steps_seconds", "value": round(sum(v for k, v in taken.items() if not k.endswith("_plan")), 3), "unit": "sec", "events": n, "steps": taken}))
    spark.stop()


if __name__ == "__main__":
    main()
