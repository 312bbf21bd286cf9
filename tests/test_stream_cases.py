"""Scoped and as-of rules on a stream: equal to the batch in many triggers; state ends on a timer."""

import time

import pytest
from pyspark.sql import functions as F

from normslice.errors import NormError
from normslice.operators.scoring import score
from normslice.plans.constraints import Exclusion, Lag, Precedence, Singularity
from normslice.plans.norm import Norm, NormConstraint, View
from normslice.sources.eventlog import EventLog
from normslice.streaming.cases import changed_cases, score_stream

ROLES = {"case_col": "case", "activity_col": "event_type", "timestamp_col": "ts", "order_col": "event_id"}


def scoped_norm():
    kinds = {
        "each": Lag("view", "purchase", 1, 5, "h", activation="each"),
        "asof": Lag("view", "purchase", 2, 6, "h", missing_a="skip"),
        "last": Lag("click", "purchase", 2, 6, "h", activation="last"),
        "order": Precedence("purchase", "error"),
        "after": Exclusion("error", after="purchase"),
        "before": Singularity("click", 1, 2, before="purchase"),
    }
    return Norm(tuple(NormConstraint(k, "l", c) for k, c in kinds.items()), views=(View("all", constraint_weights=dict.fromkeys(kinds, 1)),), scoring_mode="flat")


def run(spark, stream, tmp_path, idle, watermark="1 day"):
    seen = {}
    triggers = []

    def keep(batch, number):
        triggers.append(number)
        for r in batch.collect():
            seen[r["case_id"], str(r["opened"]), r["closed"]] = (r["score"], r["n_events"])

    score_stream(stream, scoped_norm(), keep, str(tmp_path / "state"), roles=ROLES, idle_seconds=idle, watermark=watermark).awaitTermination()
    return seen, triggers


def test_a_stream_equals_the_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("case"), "event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    folder = str(tmp_path / "in")
    source.repartition(4).write.parquet(folder)
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    seen, triggers = run(spark, stream, tmp_path, 10**9, "1000 days")
    assert len(set(triggers)) >= 4
    want = {r["case_id"]: (r["score"], r["n_events"]) for r in score(EventLog(source, **ROLES), scoped_norm()).frame().collect()}
    assert len({k[0] for k in seen}) == len(want)
    newest = {}
    for (case, _, _), value in seen.items():
        if value[1] >= newest.get(case, (0, 0))[1]:
            newest[case] = value
    assert {k: v[1] for k, v in newest.items()} == {k: v[1] for k, v in want.items()}
    assert {k: v[0] for k, v in newest.items()} == pytest.approx({k: v[0] for k, v in want.items()})
    with pytest.raises(NormError):
        changed_cases(source, [], case_col="case", timestamp_col="ts", idle_seconds=1)


def test_state_ends_on_a_timer(spark, tmp_path):
    rows = [("a", "view", "2024-01-01"), ("a", "purchase", "2024-01-02"), ("b", "view", "2024-01-01"), ("a", "click", "2024-03-01"), ("z", "view", "2024-06-01"), ("late", "view", "2024-01-03"), ("z", "view", "2024-06-02")]
    folder = tmp_path / "in"
    for i, (c, e, t) in enumerate(rows):
        spark.createDataFrame([(c, e, t, i)], "case string, event_type string, ts string, event_id long").selectExpr("case", "event_type", "cast(ts as timestamp) ts", "event_id").coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)
    stream = spark.readStream.schema("case string, event_type string, ts timestamp, event_id long").option("maxFilesPerTrigger", 1).parquet(str(folder))
    seen, _ = run(spark, stream, tmp_path, 20 * 86_400)
    closed = {(c, o[:10]): n for (c, o, end), (_, n) in seen.items() if end}
    assert closed == {("a", "2024-01-01"): 2, ("b", "2024-01-01"): 1, ("a", "2024-03-01"): 1}
    assert not any(c == "late" for c, _, _ in seen)
    assert max(n for (c, _, _), (_, n) in seen.items() if c == "z") == 2


def _files(spark, folder, rows, first=0):
    """A file for each group of rows ``(case, event_type, ts)``, in their order."""
    for i, group in enumerate(rows, first):
        spark.createDataFrame([(*r, 100 * i + k) for k, r in enumerate(group)], "case string, event_type string, ts string, event_id long").selectExpr("case", "event_type", "cast(ts as timestamp) ts", "event_id").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    return spark.readStream.schema("case string, event_type string, ts timestamp, event_id long").option("maxFilesPerTrigger", 1).parquet(folder)


def test_many_cases_end_in_time(spark, tmp_path):
    """40,000 cases in two triggers: no Python and no call into the state store for each of them."""
    kinds = F.element_at(F.array(*map(F.lit, ("view", "click", "purchase"))), (F.col("id") % 3 + 1).cast("int"))
    source = spark.range(80_000).select((F.col("id") % 40_000).cast("string").alias("case"), kinds.alias("event_type"), F.timestamp_seconds(1_700_000_000 + 7 * F.col("id")).alias("ts"), F.col("id").alias("event_id"))
    source.repartition(2, "event_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    began = time.monotonic()
    seen, triggers = run(spark, stream, tmp_path, 10**9, "1000 days")
    assert time.monotonic() - began < 60 and len(triggers) == 2
    whole = {c: v for (c, _, _), v in seen.items() if v[1] == 2}
    want = {r["case_id"]: (r["score"], r["n_events"]) for r in score(EventLog(source, **ROLES), scoped_norm()).frame().collect()}
    assert len(whole) == 40_000 and whole == want


@pytest.mark.parametrize("few", [10**6, 0])
def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path, monkeypatch, few):
    """Joined stretches, a case without id, closed stretches and a trigger that is run again, with either join."""
    monkeypatch.setattr("normslice.streaming.cases.FEW", few)
    folder, day = str(tmp_path / "in"), 86_400
    stream = _files(spark, folder, [[("a", "view", "2024-01-01"), ("a", "purchase", "2024-02-05"), (None, "view", "2024-01-08"), ("b", "view", "2024-01-20")]])
    seen, _ = run(spark, stream, tmp_path, 20 * day, "30 days")
    assert {k: v[1] for k, v in seen.items()} == {("a", "2024-01-01 00:00:00", False): 1, ("a", "2024-02-05 00:00:00", False): 1, (None, "2024-01-08 00:00:00", False): 1, ("b", "2024-01-20 00:00:00", False): 1}

    def fails(batch, number):
        raise ValueError("no room")

    _files(spark, folder, [[("a", "click", "2024-01-18"), ("late", "view", "2024-01-05")]], 1)
    with pytest.raises(Exception, match="no room"):
        score_stream(stream, scoped_norm(), fails, str(tmp_path / "state"), roles=ROLES, idle_seconds=20 * day, watermark="30 days").awaitTermination()
    seen, triggers = run(spark, stream, tmp_path, 20 * day, "30 days")
    assert triggers == [1] and {k: v[1] for k, v in seen.items()} == {("a", "2024-01-01 00:00:00", False): 3}
    _files(spark, folder, [[("z", "view", "2024-03-15")], [("z", "view", "2024-06-01"), (None, "view", "2024-06-02")], []], 2)
    seen, triggers = run(spark, stream, tmp_path, 20 * day, "30 days")
    assert {k: v[1] for k, v in seen.items()} == {(None, "2024-01-08 00:00:00", True): 1, ("b", "2024-01-20 00:00:00", True): 1, ("z", "2024-03-15 00:00:00", False): 1, ("a", "2024-01-01 00:00:00", True): 3, ("z", "2024-03-15 00:00:00", True): 1, ("z", "2024-06-01 00:00:00", False): 1, (None, "2024-06-02 00:00:00", False): 1}
    assert sorted(p.name for p in (tmp_path / "state" / "cases").iterdir()) == [str(triggers[-1] - 1), str(triggers[-1])]
