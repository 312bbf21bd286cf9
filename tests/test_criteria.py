"""Criteria over measures: ramps, scopes and reasons of single cases, and the plans of the domain queries."""

import pytest
from pyspark.sql import functions as F

from normslice.errors import NormError
from normslice.operators import criteria as C
from normslice.operators import sequences as S
from normslice.operators.scoring import first_examples, reason_profile
from normslice.queries import domains

ROWS = [("a", "x", "3", 2.0, "measured"), ("b", "x", "nan", 4.0, "measured"), ("c", None, None, None, "no_end"), ("d", "y", "many", 9.0, "measured"), ("e", "x", "7", None, None)]


@pytest.fixture(scope="module")
def prepared(spark):
    measured = spark.createDataFrame(ROWS, "k string, kind string, n string, span double, state string")
    rules = {
        "n": C.Criterion("n", 2, 2, missing="not counted"),
        "span": C.Criterion("span", 4, 0, scope=F.col("kind") == "x", outside="other kind", missing=F.col("state")),
    }
    return C.prepare(measured, rules, "k", ["kind"])


def test_severities_scopes_and_reasons(prepared):
    """NaN and text are missing; a step is strict; a NULL scope is outside; a reason column that is NULL has a general text."""
    found = {r["case_id"]: (r["sev__n"], r["reason__n"], r["sev__span"], r["scope__span"], r["reason__span"]) for r in prepared.collect()}
    assert found == {
        "a": (0.5, None, 0.0, True, None),
        "b": (None, "not counted", 0.0, True, None),
        "c": (None, "not counted", None, False, "other kind"),
        "d": (None, "not counted", None, False, "other kind"),
        "e": (1.0, None, None, True, "no measure"),
    }


def test_scores_and_evidence(prepared):
    result = C.assess(prepared, ["n", "span"], {"one": {"n": 1, "span": 3}, "other": {"n": 0, "span": 1}}, validate=True)
    found = {r["case_id"]: (r["score__one"], r["score__other"]) for r in result.table.collect()}
    assert found == {"a": (0.875, 1.0), "b": (1.0, 1.0), "c": (None, None), "d": (None, None), "e": (0.0, None)}
    long = C.evidence(prepared, ["n", "span"])
    counts = {(r["constraint"], r["state"], r["reason"]): r["n_cases"] for r in reason_profile(long).collect()}
    assert counts == {("n", "assessed", None): 2, ("n", "unavailable", "not counted"): 3, ("span", "assessed", None): 2, ("span", "out_of_scope", "other kind"): 2, ("span", "unavailable", "no measure"): 1}
    assert {r["example"] for r in first_examples(long, ["kind"]).where("state = 'unavailable'").collect()} == {"b", "c", "d", "e"}


def test_attach(spark):
    """Cases without a measure stay; a measure of an unknown case brings none in; an empty measure gives NULL."""
    cases = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int")
    some = spark.createDataFrame([("a", 5), ("z", 6)], "k string, n int")
    none = spark.createDataFrame([], "k string, m int")
    assert sorted(map(tuple, C.attach(cases, [some, none], "k").collect())) == [("a", 1, 5, None), ("b", 2, None, None)]
    for wrong in (some.withColumnRenamed("n", "X"), some.withColumnRenamed("k", "key")):
        with pytest.raises(NormError):
            C.attach(cases, [wrong], "k")


def test_refusals():
    for threshold, width in ((None, 1), (1, None), (float("nan"), 1), (1, -1)):
        with pytest.raises(NormError):
            C.Criterion("n", threshold, width)


def test_measures_of_one_log(spark):
    """Returns, repeated states and work after the end, attached to the cases of one log."""
    rows = [("a", 1, "p"), ("a", 2, "q"), ("a", 3, "p"), ("b", 1, "p")]
    e = spark.createDataFrame(rows, "k string, t int, v string").repartition(4, "k")
    measured = C.attach(e.groupBy("k").agg(F.count(F.lit(1)).alias("n")), [S.returns(e, "k", ["t"], "v"), S.repeated_states(e, "k", "v"), S.active_after(e, "k", "t", "v", "q")], "k")
    assert sorted(map(tuple, measured.collect())) == [("a", 3, 2, 1, 1, True), ("b", 1, 0, 0, 0, None)]


def test_domains_on_the_small_tables(spark):
    for build, rules in ((domains.incidents, domains.INCIDENTS), (domains.loans, domains.LOANS), (domains.items, domains.ITEMS)):
        prepared = build(spark, "/root/testdata/sf0.001")
        row = prepared.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("case_id").alias("ids"), *(F.count_if(F.col(f"sev__{k}").isNull() != F.col(f"reason__{k}").isNotNull()).alias(k) for k in rules)).first()
        assert row["n"] == row["ids"] > 0 and all(row[k] == 0 for k in rules)
