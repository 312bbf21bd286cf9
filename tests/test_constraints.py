"""Known answers of constraints over small hand-made logs."""

import datetime

import pytest
from pyspark.sql import functions as F

from normslice.errors import LogSchemaError, NormError
from normslice.functions.core import saturate
from normslice.operators.scoring import evaluate_constraint
from normslice.plans.constraints import Balance, Exclusion, Lag, Metric, Precedence, Presence, Singularity, constraint_from_dict
from normslice.plans.norm import NormConstraint
from normslice.sources.eventlog import EventLog

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def make_log(spark):
    def make(rows, **roles):
        """``case, activity, day, amount`` rows."""
        full = [(c, a, None if d is None else START + datetime.timedelta(days=d), x, i) for i, (c, a, d, x) in enumerate((*r, None)[:4] for r in rows)]
        df = spark.createDataFrame(full, "case string, activity string, time timestamp_ntz, amount double, seq int")
        return EventLog(df, **({"case_col": "case", "activity_col": "activity", "timestamp_col": "time", "order_col": "seq"} | roles))

    return make


def violations(log, constraint, **more):
    rows = evaluate_constraint(log, NormConstraint("x", "l", constraint, **more)).collect()
    return {r["case_id"]: None if r["violation"] is None else round(r["violation"], 9) for r in rows}


def test_saturation(spark):
    df = spark.createDataFrame([(8.0,), (15.0,), (20.0,), (30.0,), (None,)], "z double")
    assert [r[0] for r in df.select(saturate(F.col("z"), 10, 20)).collect()] == [0, 0.25, 0.5, 1, None]
    step = spark.createDataFrame([(10.0,), (10.1,), (None,)], "z double").select(saturate(F.col("z"), 10, 0))
    assert [r[0] for r in step.collect()] == [0, 1, None]


def test_presence_exclusion_singularity(make_log):
    log = make_log([("c", "CP", 0), ("c", "GR", 1), ("c", "CP", 2), ("d", "CP", 0), ("d", "GR", 1), ("e", "CP", 0)])
    assert violations(log, Presence("GR", 2)) == {"c": 0.5, "d": 0.5, "e": 1}
    assert violations(log, Exclusion("CP", after="GR")) == {"c": 1, "d": 0, "e": None}
    assert violations(log, Exclusion(["CP", "GR"])) == {"c": 1, "d": 1, "e": 1}
    many = make_log([(f"n{n}", "GR", i) for n in range(2, 7) for i in range(n)])
    assert list(violations(many, Singularity("GR", 2, 3)).values()) == pytest.approx([0, 1 / 3, 2 / 3, 1, 1], abs=1e-8) or sorted(violations(many, Singularity("GR", 2, 3)).values()) == pytest.approx([0, 1 / 3, 2 / 3, 1, 1], abs=1e-8)


def test_lag(make_log):
    log = make_log(
        [("l20", "GR", 0), ("l20", "INV", 20), ("pre", "INV", -3), ("pre", "GR", 0), ("pre", "INV", 5), ("only_pre", "INV", -3), ("only_pre", "GR", 0), ("no_a", "INV", 1), ("no_b", "GR", 1)]
    )
    assert violations(log, Lag("GR", "INV", 10, 20)) == {"l20": 0.5, "pre": 0, "only_pre": 1, "no_a": 1, "no_b": 1}
    assert violations(log, Lag("GR", "INV", 10, 20, missing="skip")) == {"l20": 0.5, "pre": 0, "only_pre": None, "no_a": None, "no_b": None}
    overall = make_log([("pre", "INV", -3), ("pre", "GR", 0), ("pre", "INV", 5), ("late", "GR", 0), ("late", "INV", 25), ("open", "GR", 0)], window=("2024-01-01", "2024-01-26"))
    assert violations(overall, Lag("GR", "INV", 10, 20, response="first_overall", missing_b="censor")) == {"pre": 0.75, "late": 0.75, "open": 0.75}
    assert violations(overall, Lag("GR", "INV", 10, 20, response="first_overall")) == {"pre": 1, "late": 0.75, "open": 1}


def test_lag_each_and_ties(make_log):
    log = make_log([("x", "GR", 0), ("x", "GR", 10), ("x", "INV", 12), ("y", "GR", 0), ("y", "INV", 2), ("y", "GR", 20), ("z", "INV", 1), ("z", "GR", 1)])
    assert violations(log, Lag("GR", "INV", 10, 20, activation="each")) == {"x": 0.05, "y": 0.5, "z": 0}
    assert violations(log, Lag("GR", "INV", 10, 20, activation="each", missing_b="skip")) == {"x": 0.05, "y": 0, "z": 0}
    assert violations(log, Precedence("GR", "INV"))["z"] == 0
    lags = {(r["case_id"], str(r["t_a"])): r["lag"] for r in log.activation_lags("GR", "INV").collect()}
    assert lags["x", "2024-01-01 00:00:00"] == 12 and lags["y", "2024-01-21 00:00:00"] is None and lags["z", "2024-01-02 00:00:00"] == 0


def test_censoring_before_activation_is_no_violation(make_log):
    log = make_log([("a", "GR", 10)], window=("2024-01-01", "2024-01-05"))
    assert violations(log, Lag("GR", "INV", 1, 2, missing_b="censor")) == {"a": 0}


def test_precedence(make_log):
    log = make_log([("ok", "GR", 0), ("ok", "INV", 1), ("pre", "INV", 0), ("pre", "GR", 1), ("two", "INV", 0), ("two", "INV", 1), ("two", "GR", 2), ("no_a", "INV", 0), ("no_b", "GR", 0)])
    assert violations(log, Precedence("GR", "INV")) == {"ok": 0, "pre": 1, "two": 1, "no_a": None, "no_b": 0}
    assert violations(log, Precedence("GR", "INV", 0, 2, "violate", "skip")) == {"ok": 0, "pre": 0.5, "two": 1, "no_a": 1, "no_b": None}


def test_balance_and_metric(make_log):
    log = make_log([("exact", "INV", 1, 100.0), ("exact", "GR", 0, 100.0), ("less", "INV", 1, 82.0), ("less", "GR", 0, 100.0), ("none", "GR", 0, 100.0), ("split", "GR", 0, 100.0), ("split", "INV", 1, 40.0), ("split", "INV", 2, 60.0), ("empty", "X", 0)])
    assert violations(log, Balance("amount", "INV", "amount", "GR", 0.05, 0.2)) == {"exact": 0, "less": 0.65, "none": 1, "split": 0, "empty": 0}
    with pytest.raises(Exception, match="negative"):
        violations(make_log([("a", "INV", 0, -5.0)]), Balance("amount", "INV", "amount", "GR"))
    assert violations(log, Metric("n_events", 1, 4)) == {"exact": 0.25, "less": 0.25, "none": 0, "split": 0.5, "empty": 0}
    assert violations(log, Metric("n_events", 3, 4, "low")) == {"exact": 0.25, "less": 0.25, "none": 0.5, "split": 0, "empty": 0.5}


def test_missing_times(make_log):
    rows = [("a", "GR", 0), ("a", "INV", None), ("b", "INV", 3)]
    with pytest.raises(LogSchemaError):
        make_log(rows)
    kept = make_log(rows, missing_timestamps="keep")
    assert violations(kept, Presence("INV")) == {"a": 0, "b": 0}
    assert violations(kept, Lag("GR", "INV", 1, 1)) == {"a": 1, "b": 1}
    assert violations(make_log(rows, missing_timestamps="drop"), Presence("INV")) == {"a": 1, "b": 0}


def test_refusals(make_log):
    for bad in (dict(m="x"), dict(m=0), dict(m=True), dict(m=1.5), dict(m="2")):
        with pytest.raises(NormError):
            Presence("a", **bad)
    for kind, params in (("nope", {}), ("lag", {"a": "x"}), ("lag", {"a": "x", "b": "y", "what": 1}), ("balance", {"attr_x": "v", "activities_x": "a", "attr_y": "v", "activities_y": "b", "tau": 2}), ("presence", {"activity": []})):
        with pytest.raises(NormError):
            constraint_from_dict(kind, params)
    assert constraint_from_dict("sing", {"activity": "a", "k": "2"}) == Singularity("a", 2)
    assert constraint_from_dict("pres", {"activity": "a", "m": 1.5}) == Presence("a", 1)  # documents cut counts
    with pytest.raises(LogSchemaError):
        make_log([("a", "x", 0)], case_attributes=["nope"])
    with pytest.raises(LogSchemaError):
        make_log([(None, "x", 0)])
    with pytest.raises(NormError):
        violations(make_log([("a", "x", 0)]), Metric("nope"))
