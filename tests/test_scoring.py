"""The example's published scores, invariants over random logs, plan shape, norms and reports."""

import datetime
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from normslice import cli
from normslice.errors import NormError, NotScoredError
from normslice.functions import ranks
from normslice.operators import assessments as A
from normslice.operators import backlog as B
from normslice.operators import diagnostics as D
from normslice.operators.scoring import score
from normslice.plans.constraints import Exclusion, Lag, Metric, Precedence, Presence, Singularity
from normslice.plans.norm import Layer, Norm, NormConstraint, View
from normslice.queries import documents
from normslice.sources import eventlog
from normslice.sources.eventlog import EventLog
from normslice.sources.example import example_log, example_norm

#: The published scores of the example.
WANT = {"A": (0.6625, 0.8875), "B": (0.9667, 0.7), "C": (0.87, 0.9675), "D": (0.9, 0.9), "E": (0.15, 0.55)}


@pytest.fixture(scope="module")
def example(spark):
    return score(example_log(spark), example_norm())


def test_example_scores(example):
    rows = {r["case_id"]: (r["score__Finance"], r["score__Logistics"]) for r in example.table.collect()}
    assert rows.keys() == WANT.keys()
    for case, want in WANT.items():
        assert rows[case] == pytest.approx(want, abs=5e-5)
    assert not any(r["c4"] for r in example.in_scope().collect())
    assert example.check_decomposition() < 1e-9


def test_example_layer_balanced(spark):
    t = score(example_log(spark), example_norm(), mode="layer_balanced")
    rows = {r["case_id"]: r["score"] for r in t.frame("Finance").collect()}
    assert rows["A"] == pytest.approx(1 - 0.45 / 1.05 * 0.75) and rows["C"] == pytest.approx(1 - 0.25 / 1.05 * 0.65)


def random_parts(seed, n_cases=60):
    r = random.Random(seed)
    acts = ["ask", "pack", "send", "bill", "undo"]
    rows = [(f"k{c}", r.choice(acts), datetime.datetime(2024, 1, 1) + datetime.timedelta(days=r.randrange(120) / 2), r.randrange(1, 80) / 4, r.choice("XYZ"), i) for c in range(n_cases) for i in range(r.randint(1, 8))]
    one = lambda: r.choice(acts)
    kinds = [
        lambda: Presence(one(), r.randint(1, 3)), lambda: Exclusion(one()), lambda: Exclusion(one(), after=one()), lambda: Singularity(one(), r.randint(0, 2), r.randint(1, 3)), lambda: Precedence(one(), one(), missing_a=r.choice(["skip", "violate"])),
        lambda: Lag(one(), one(), r.randint(0, 10), r.randint(0, 20), missing_a=r.choice(["skip", "violate"]), missing_b=r.choice(["skip", "violate"]), activation=r.choice(["first", "last", "each"])), lambda: Metric("n_events", r.randint(0, 3), r.randint(0, 3)),
    ]
    layers = [f"L{i}" for i in range(r.randint(2, 3))]
    constraints = tuple(NormConstraint(f"c{i}", r.choice(layers), r.choice(kinds)(), r.randint(1, 4), {"region": [r.choice("XYZ"), "X"]} if r.random() < 0.3 else None) for i in range(r.randint(3, 7)))
    views = (View("v", layer_weights={x: 1 for x in {c.layer for c in constraints}}), View("w", constraint_weights={c.id: r.randint(0, 3) + (i == 0) for i, c in enumerate(constraints)}))
    return rows, Norm(constraints, tuple(map(Layer, layers)), views)


def log_of(spark, rows):
    df = spark.createDataFrame(rows, "case string, act string, ts timestamp_ntz, amount double, region string, seq int")
    return EventLog(df, case_col="case", activity_col="act", timestamp_col="ts", case_attributes=["region"], order_col="seq", validate=False)


@pytest.mark.parametrize("seed", range(4))
def test_invariants(spark, seed):
    rows, norm = random_parts(seed)
    result = score(log_of(spark, rows), norm)
    table = result.table.collect()
    for row in table:
        for c in norm.constraint_ids:
            assert row[f"v__{c}"] is None or 0 <= row[f"v__{c}"] <= 1
        for v in norm.view_names:
            s = row[f"score__{v}"]
            weighed = [c for c, w in norm.raw_weights(v).items() if w > 0 and row[f"v__{c}"] is not None]
            assert (s is None) == (not weighed) and (s is None or -1e-9 <= s <= 1 + 1e-9)
            if s is not None:
                assert sum(row[f"contrib__{v}__{x}"] for x in norm.layer_ids) == pytest.approx(1 - s)
    long = log_of(spark, rows)
    long._long_traces = True
    assert {r["case_id"]: r["score__v"] for r in score(long, norm).table.collect()} == pytest.approx({r["case_id"]: r["score__v"] for r in table})
    shuffled = rows[:]
    random.Random(seed).shuffle(shuffled)
    again = {r["case_id"]: r["score__v"] for r in score(log_of(spark, shuffled), norm).table.collect()}
    assert again == pytest.approx({r["case_id"]: r["score__v"] for r in table})
    doubled = norm.replace(views=tuple(View(v.name, **({"layer_weights": {k: 2 * w for k, w in v.weights.items()}} if v.by_layer else {"constraint_weights": {k: 2 * w for k, w in v.weights.items()}})) for v in norm.views))
    twice = {r["case_id"]: r["score__w"] for r in score(log_of(spark, rows), doubled).table.collect()}
    assert twice == pytest.approx({r["case_id"]: r["score__w"] for r in table})
    weights = [sum(r[c] for c in norm.constraint_ids) for r in result.effective_weights("v").collect()]
    assert all(w == pytest.approx(1) or w == 0 for w in weights)
    assert Norm.loads(norm.dumps()) == norm and Norm.loads(norm.dumps()).fingerprint == norm.fingerprint
    backlog = B.prioritize(result, "region", view="v", gamma=3).collect()
    plain = {r["region"]: r for r in B.prioritize(result, "region", view="v").collect()}
    assert all(0 <= r["stable_PI"] <= plain[r["region"]]["stable_PI"] + 1e-9 for r in backlog)


def test_trace_length_is_counted_when_it_matters(spark, monkeypatch):
    monkeypatch.setattr(eventlog, "LONG_TRACE", 3)
    rows, _ = random_parts(2)
    plain, paired = Norm((NormConstraint("a", "l", Presence("ask")),)), Norm((NormConstraint("a", "l", Lag("ask", "send", 1, 9)),))
    log = log_of(spark, rows)
    score(log, plain)
    assert log._long_traces is None
    names = score(log, paired).table.columns
    assert log._long_traces is True and not [c for c in names if c.startswith("q")]


def test_one_event_shuffle(spark):
    rows, norm = random_parts(1)
    plan = score(log_of(spark, rows), norm).table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def frame(spark, groups):
    return spark.createDataFrame([(g, s) for g, n, s in groups for _ in range(n)], "g string, score double")


def test_known_priority(spark):
    df = frame(spark, [("s", 240, 0.8), ("t", 1000, 0.9736)])
    top = B.prioritize(df, "g", baseline=0.94).first()
    assert top["g"] == "s" and top["PI"] == pytest.approx(33.6)
    assert [r["g"] for r in B.prioritize(frame(spark, [("a", 30, 0.5), ("b", 240, 0.5), ("c", 5, 0.5)]), "g").collect()] == ["b", "a", "c"]


def test_gamma_and_small_slices(spark):
    df = frame(spark, [("a", 3, 0.2), ("a", 3, 0.4), ("b", 4, 0.9), ("b", 2, 0.7), ("c", 1, 0.1)])
    assert 0 < B.estimate_gamma(df, "g") < 10
    kept = B.prioritize(df, "g", min_cases=2).collect()
    assert {r["g"] for r in kept} == {"a", "b"} and kept[0]["global_mean"] == pytest.approx(df.agg(F.avg("score")).first()[0])
    with pytest.raises(NotScoredError):
        B.estimate_gamma(df.where("g = 'c'"), "g")
    for bad in (dict(gamma=-1), dict(min_cases=-1), dict(baseline=float("nan"))):
        with pytest.raises(NormError):
            B.prioritize(df, "g", **bad)


def test_norm_documents_are_strict():
    d = example_norm().to_dict()
    assert Norm.from_dict(d) == example_norm()
    for change in ({"extra": 1}, {"schema_version": 3}, {"scoring_mode": "x"}, {"layers": [{"id": "completeness"}]}):
        with pytest.raises(NormError):
            Norm.from_dict(d | change)
    with pytest.raises(NormError):
        Norm.loads("{")
    mapped = d | {"layers": {x["id"]: x["name"] for x in d["layers"]}, "views": {v["name"]: {"constraint_weights": v["constraint_weights"]} for v in d["views"]}}
    assert Norm.from_dict(mapped).weight_table() == example_norm().weight_table()
    assert example_norm().replace_constraint("c1", weight=2.0).get_constraint("c1").weight == 2.0


def test_norm_check(spark):
    norm = example_norm()
    assert norm.check(example_log(spark)) == []
    missing = norm.replace_constraint("c1", constraint=Presence("Nowhere"), applicability={"nope": ["x"]})
    assert len(missing.check(example_log(spark))) == 2


def test_prepared_assessments(spark):
    rows = [("1", 0.0, 0.5, 1.0, True, True, True), ("2", 1.0, 0.0, None, True, True, True), ("3", None, None, None, True, True, False)]
    df = spark.createDataFrame(rows, "case_id string, sev__a double, sev__b double, sev__c double, scope__a boolean, scope__b boolean, scope__c boolean")
    t = A.score_prepared(df, "abc", {"m": {"a": 1, "b": 1, "c": 1}})
    got = {r["case_id"]: r for r in A.assessed(t).collect()}
    assert got["1"]["score"] == pytest.approx(0.5) and got["1"]["coverage"] == 1
    assert got["2"]["score"] == pytest.approx(0.5) and got["2"]["coverage"] == pytest.approx(2 / 3)
    assert (got["2"]["penalty_low"], got["2"]["penalty_high"]) == pytest.approx((1 / 3, 2 / 3))
    assert got["3"]["score"] is None and got["3"]["penalty_high"] == 1
    with pytest.raises(NormError):
        A.score_prepared(df.withColumn("sev__a", F.lit(2.0)), "abc", {"m": {"a": 1}})
    again = A.without_criterion(t, "c").frame("m")
    assert {r["case_id"]: r["score"] for r in again.collect()}["1"] == pytest.approx(0.75)


def test_bootstrap_is_repeatable(spark):
    df = spark.createDataFrame([(f"d{i % 20}", "gh"[i % 2], (i % 7) / 7) for i in range(200)], "doc string, g string, score double")
    a = A.cluster_bootstrap(df, "doc", "g", replicates=50).collect()
    b = A.cluster_bootstrap(df.repartition(7), "doc", "g", replicates=50).collect()
    key = lambda rows: {r["g"]: tuple(round(x, 9) for x in r[1:]) for r in rows}
    assert key(a) == key(b) and all(r["low"] <= r["median"] <= r["high"] for r in a)


def test_diagnostics(spark):
    rows = [("A", "x", 0), ("A", "y", 1), ("B", "x", 2), ("B", "x", 2), ("B", "y", 3), ("B", "y", 3), ("C", "x", 0)]
    t0 = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(c, a, t0 + datetime.timedelta(days=d), i) for i, (c, a, d) in enumerate(rows)], "case string, act string, ts timestamp_ntz, seq int").withColumn("po", F.lit("po"))
    log = EventLog(df, case_col="case", activity_col="act", timestamp_col="ts", order_col="seq")
    replication = {r["case_id"]: r for r in D.event_replication(log).collect()}
    assert replication["B"]["ratio"] == 2 and replication["B"]["tied_share"] == 1 and replication["A"]["ratio"] == 1
    assert {r["case_id"]: r["shared"] for r in D.cross_case_replication(log, "po").collect()} == {"A": 0.5, "B": 0, "C": 1}
    report = log.quality_report().first()
    assert (report["n_events"], report["n_cases"], report["tied_event_share"]) == (7, 3, pytest.approx(4 / 7))


def test_command_line(spark, tmp_path, capsys):
    norm = tmp_path / "norm.json"
    example_norm().dump(str(norm))
    log = str(tmp_path / "log.parquet")
    example_log(spark).events.drop("__case", "__act", "__us", "__tie").write.parquet(log)
    roles = ["--case", "case", "--activity", "activity", "--timestamp", "time", "--attr", "flow", "--attr", "company"]
    assert cli.main(["validate", str(norm)]) == 0 and cli.main(["describe", str(norm)]) == 0
    assert "weights" in capsys.readouterr().out
    assert cli.main(["check", str(norm), log, *roles]) == 0
    out = capsys.readouterr().out
    assert "n_events: 21" in out and "no issues found" in out
    assert cli.main(["check", str(norm), log, *roles[:-4]]) == 1 and "'flow'" in capsys.readouterr().out
    assert cli.main(["score", str(norm), log, *roles, "--by", "company", "--view", "Finance", "--volume", "cases", "--out", "-"]) == 0
    assert "stable_PI" in capsys.readouterr().out
    one = tmp_path / "backlog.csv"
    assert cli.main(["score", str(norm), log, *roles, "--exposure", "amount", "--volume", "exposure", "--by", "company", "--out", str(one), "--cases-out", str(tmp_path / "cases")]) == 0
    assert one.read_text().startswith("company,n_cases") and spark.read.option("header", True).csv(str(tmp_path / "cases")).count() == 5
    with pytest.raises(SystemExit) as stop:
        cli.main(["--version"])
    assert stop.value.code == 0
    norm.write_text("{}")
    assert cli.main(["validate", str(norm)]) == 1


def test_check_names_who_is_at_fault(spark):
    norm = example_norm().replace(derived_attributes=({"name": "x", "kind": "count", "activities": ["Nowhere"]}, {"name": "y", "kind": "agg", "column": "nope", "agg": "max"}))
    norm = norm.replace_constraint("c6", constraint=Metric("touches", 1, 1)).replace_constraint("c1", applicability={"has": ["Never"]})
    assert norm.check(example_log(spark)) == [
        "derived attribute 'x': activity 'Nowhere' never occurs",
        "derived attribute 'y': 'nope' is no event column",
        "constraint 'c1': activity 'Never' never occurs",
        "constraint 'c6': metric attribute 'touches' is neither a case attribute nor derived",
    ]


def test_documents_as_users_write_them():
    """View descriptions, text numbers, mappings for layers, empty rules, nulls, recipes by lists of activities."""
    norm = Norm.loads(json.dumps(documents.DOCUMENT))
    assert norm.get_view("Finance").description and norm.get_constraint("shipped_twice").constraint == Presence("ship_N", 2)
    assert Norm.loads(norm.dumps()) == norm and Norm.loads(norm.dumps()).fingerprint == norm.fingerprint
    assert norm.to_dict()["constraints"][0]["applicability"] == {"o_orderstatus": ["F", "P"]}
    for change in (
        {"derived_attributes": [*documents.DOCUMENT["derived_attributes"], documents.DOCUMENT["derived_attributes"][0]]},
        {"derived_attributes": [{"name": "x", "kind": "count", "activity": "a"}]},
        {"derived_attributes": [{"name": "x", "kind": "count_events"}]},
        {"derived_attributes": [{"name": "x", "kind": "eval", "expr": "__import__('os')"}]},
        {"views": [{"name": "v", "layer_weights": {"closure": 1}, "weights": {}}]},
        {"views": [{"name": "v", "layer_weights": {"closure": 0}}]},
    ):
        with pytest.raises(NormError):
            Norm.from_dict(documents.DOCUMENT | change)


def test_bootstrap_counts_absent_groups_as_zero(spark):
    """A group of one cluster is absent from some 37 % of the replicates: its lower quantile is 0."""
    df = spark.createDataFrame([("only", "g", 0.1)] * 4 + [(f"c{i}", "h", 0.9) for i in range(40)], "c string, g string, score double")
    row = {r["g"]: r for r in A.cluster_bootstrap(df, "c", "g", replicates=120).collect()}["g"]
    assert row["low"] == 0 < row["median"] and 0.5 < row["top_share"] < 0.75


def test_rank_correlations_equal_all_pairs(spark):
    r = random.Random(4)
    for n, kinds in ((300, 12), (300, 3), (40, 1000)):
        points = [(float(x := r.randrange(kinds)), float(x * 3 + r.randrange(kinds * 9))) for _ in range(n)] + [(None, 1.0)]
        df = spark.createDataFrame(points, "x double, y double")
        sign = lambda v: (v > 0) - (v < 0)
        pairs = [(sign(a - c), sign(b - d)) for i, (a, b) in enumerate(points[:-1]) for c, d in points[:i]]
        want = sum(a * b for a, b in pairs) / (sum(abs(a) for a, _ in pairs) * sum(abs(b) for _, b in pairs)) ** 0.5
        for size in (40, 10_000):
            assert ranks.kendall(df, size).first()[0] == pytest.approx(want)
        known = pd.DataFrame(points[:-1])
        assert ranks.spearman(df).first()[0] == pytest.approx(known.rank().corr().iloc[0, 1])
        got = {x["g"]: (x["q0"], x["q1"]) for x in ranks.quantiles(df.where("x is not null").withColumn("g", F.col("x") % 2), "y", [0.1, 0.95], ["g"]).collect()}
        assert got == {g: pytest.approx(tuple(known[known[0] % 2 == g][1].quantile([0.1, 0.95]))) for g in got}
    assert ranks.kendall(df.limit(0)).first()[0] is None and ranks.spearman(df.limit(0)).first()[0] is None
    assert ranks.quantile(df.limit(0), F.col("x"), 0.5) is None


def test_ranks_are_not_made_in_one_task(spark):
    """No window over all cases in the plan of ranks: those without a key run on the ranges' sums only."""
    counts = spark.range(1000).select(F.col("id").alias("x"), F.lit(1).alias("n"))
    plan = ranks.before(counts, "x")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1 and "__range" in plan
