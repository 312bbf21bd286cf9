"""Rank correlations of all pairs in one pass, with NULLs that fall together and NULLs that do not."""

import random

import pandas as pd
import pytest

from normslice.functions import ranks


def test_spearman_of_all_pairs(spark):
    r = random.Random(4)
    rows = []
    for k in range(400):
        a = r.choice([0.0, 0.25, 0.5, r.random()])
        row = [a, a + r.choice([0.0, 0.3]), r.random(), None if k % 5 == 0 else r.random(), 1.0]
        rows.append([None] * 5 if k % 17 == 0 else row)
    names = list("abcde")
    frame = pd.DataFrame(rows, columns=names, dtype=float)
    found = {(x["i"], x["j"]): x["correlation"] for x in ranks.spearman_all(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)), names).collect()}
    for i in range(5):
        for j in range(i + 1, 5):
            both = frame[[names[i], names[j]]].dropna()
            if j == 4:
                assert found[i, j] is None
            else:
                assert found[i, j] == pytest.approx(both.corr("spearman").iloc[0, 1])


def test_multinomial_draws(spark):
    from normslice.operators import assessments as A

    n, reps = 50, 20
    drawn = A.multinomial(spark, n, reps, 3).collect()
    for rep in range(reps):
        assert sum(x["m"] for x in drawn if x["rep"] == rep) == n
    assert {x["number"] for x in drawn} == set(range(n)) and len({tuple(sorted((x["number"], x["m"]) for x in drawn if x["rep"] == r)) for r in range(reps)}) == reps
    clusters = spark.createDataFrame([(f"c{i}",) for i in range(300)] + [(None,)], "_cluster string")
    numbers = sorted(x["number"] for x in A.numbered(clusters).collect())
    assert numbers == list(range(301))


def test_runs_and_returns_in_stretches(spark):
    """NULL values, ties, one-event stretches and a giant case: as by plain windows."""
    from normslice.operators import sequences as S

    r = random.Random(2)
    rows = [(r.choice(["giant", "giant", "a", "b"]), i, r.choice(["x", "x", "y", "z", None])) for i in range(260)] + [("t", 5, "x"), ("t", 5, "x"), ("one", 1, None)]
    df = spark.createDataFrame(rows, "case string, i int, v string")
    for stretches in (1, 7, 60):
        for f in (S.runs, S.returns):
            plain, cut = (sorted(map(str, f(df, "case", ["i"], "v", **options).collect())) for options in ({}, {"stretches": stretches}))
            assert plain == cut, (f, stretches)
