"""Families of activities, reasons, first intervals, and catalogues of large files."""

import hashlib

import pytest

from normslice.errors import NormError
from normslice.operators import sequences as S
from normslice.operators.scoring import reasons
from normslice.plans.constraints import Balance, Exclusion, Lag, Metric, Precedence, Presence
from normslice.plans.families import Families, expand
from normslice.plans.norm import Norm, NormConstraint, View
from normslice.sources import formats
from normslice.sources.eventlog import EventLog


def test_families_by_prefix_and_name():
    f = Families({"all": ["*"], "ship": ["ship", "ship_*"], "x": ["ship_A", "sh"]})
    assert f.of("ship_A") == ("all", "ship", "x") and f.of("ship") == ("all", "ship") and f.of("shipx") == ("all",) and f.of("sh") == ("all", "x") and f.of("") == ("all",)
    assert f.dictionary(["ship_A", "b", "ship"]) == {"all": ("b", "ship", "ship_A"), "ship": ("ship", "ship_A"), "x": ("ship_A",)}
    norm = Norm((NormConstraint("c", "l", Lag(("a", "@ship"), "@x"), applicability={"all": [{"has": ["@x"]}, {"not": {"lacks": "@ship"}}]}),), views=(View("v", constraint_weights={"c": 1}),), derived_attributes=({"name": "n", "kind": "count", "activities": ["@ship"]},))
    made = expand(norm, f, ["ship_A", "ship", "a"])
    c = made.constraints[0]
    assert c.constraint.a == ("a", "ship", "ship_A") and c.constraint.b == ("ship_A",) and c.applicability == {"all": [{"has": ["ship_A"]}, {"not": {"lacks": ["ship", "ship_A"]}}]}
    assert made.derived_attributes[0]["activities"] == ["ship", "ship_A"]
    assert expand(norm, f, ["q"]).constraints[0].constraint.b == ("@x",)
    for bad in ({"a": "text"}, {"a": []}, {"a": [""]}):
        with pytest.raises(NormError):
            Families(bad)
    with pytest.raises(NormError):
        expand(norm, Families({"ship": ["s"]}), [])


def test_reasons_name_what_is_missing(spark):
    rows = [("1", "a", "2024-01-01", 1.0, "red", "5"), ("1", "b", "2024-01-02", None, "red", "5"), ("2", "b", "2024-01-01", 2.0, None, "x"), ("3", "a", "2024-01-03", 2.0, "blue", None), ("3", "b", "2024-01-01", 1.0, "blue", None)]
    df = spark.createDataFrame(rows, "case string, act string, ts string, value double, colour string, size string").selectExpr("case", "act", "cast(ts as timestamp) ts", "value", "colour", "size")
    log = EventLog(df, case_col="case", activity_col="act", timestamp_col="ts", case_attributes=["colour", "size"])
    rule = {"any": [{"attr": "colour", "eq": "red"}, {"has": ["c"]}]}
    kinds = {
        "lag": (Lag("a", "b", 1, 1, missing_a="skip", missing_b="skip"), None), "pre": (Precedence("a", "b"), {"colour": ["red", "blue"]}), "after": (Exclusion("b", after="c"), None), "m": (Metric("size", 1, 1), {"all": [{"attr": "colour", "notna": True}, {"attr": "size", "isna": False}]}),
        "any": (Presence("a"), rule), "not": (Presence("a"), {"not": {"has": ["b"]}}), "bal": (Balance("value", "a", "value", "b", 0.1, 1, agg="max"), None), "gt": (Presence("a"), {"attr": "size", "gt": 4}), "lacks": (Presence("a"), {"lacks": ["a"]}),
    }
    norm = Norm(tuple(NormConstraint(k, "l", c, applicability=rule) for k, (c, rule) in kinds.items()), views=(View("v", constraint_weights=dict.fromkeys(kinds, 1)),))
    found = {(r["case_id"], r["constraint"]): (r["state"], r["reason"]) for r in reasons(log, norm).collect()}
    ok = ("assessed", None)
    assert [found["1", k] for k in ("lag", "pre", "any", "gt")] == [ok] * 4
    assert found["2", "lag"] == ("unavailable", "no a") and found["3", "lag"] == ("unavailable", "no b after a")
    assert found["2", "pre"] == ("out_of_scope", "colour is unknown") and found["1", "after"] == ("unavailable", "no c")
    assert found["2", "m"] == ("out_of_scope", "colour is unknown") and found["3", "m"] == ("out_of_scope", "size is unknown")
    assert found["3", "any"] == ("out_of_scope", "none of 2 alternatives") and found["1", "not"] == ("out_of_scope", "excluded")
    assert found["1", "lacks"] == ("out_of_scope", "has a") and found["2", "lacks"] == ok and found["2", "gt"] == ("out_of_scope", "size: gt fails")
    assert found["3", "bal"] == ok


def test_first_intervals(spark):
    day = 86_400_000_000
    rows = [("ok", "a", 0), ("ok", "b", 2 * day), ("back", "a", day), ("back", "b", 0), ("back", "b", 3 * day), ("bad", "a", 0), ("bad", "b", None), ("bad", "b", day), ("open", "a", 0), ("out", "b", 1)]
    df = spark.createDataFrame(rows, "case string, act string, us long")
    got = {r["case"]: (r["state"], r["span"]) for r in S.first_interval(df, "case", "act", "us", ["a"], ["b"]).collect()}
    assert got == {"ok": ("measured", 2.0), "back": ("reversed", None), "bad": ("invalid", None), "open": ("no_end", None), "out": ("out_of_scope", None)}


def test_large_files_are_digested_as_streams(spark, tmp_path):
    """A sparse file of 2.2 GB, which Spark's own reader refuses to hold, and names with blanks and percent signs."""
    big, size = tmp_path / "big.bin", 2_200_000_000
    with big.open("wb") as f:
        f.truncate(size)
    (tmp_path / "a b%20c é.txt").write_bytes(b"x" * 10)
    want = hashlib.sha256()
    block = bytes(1 << 20)
    for _ in range(size >> 20):
        want.update(block)
    want.update(bytes(size & (1 << 20) - 1))
    found = {r["relative"]: (r["bytes"], r["sha256"]) for r in formats.catalogue(spark, str(tmp_path)).collect()}
    assert found.pop("big.bin") == (size, want.hexdigest())
    assert list(found.values()) == [(10, hashlib.sha256(b"x" * 10).hexdigest())]


def test_a_large_workbook_is_streamed(spark, tmp_path):
    import zipfile

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    path, n = tmp_path / "book.xlsx", 40_000
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f"<workbook {main}><workbookPr/></workbook>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>s{i}</t></si>" for i in range(20_000)) + "</sst>")
        head = '<row><c r="A1" t="inlineStr"><is><t>name</t></is></c><c r="C1" t="inlineStr"><is><t>day</t></is></c><c r="D1" t="inlineStr"><is><t>n</t></is></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{head}" + "".join(f'<row><c r="A{i + 2}" t="s"><v>{i % 20_000}</v></c>' + (f'<c r="C{i + 2}"><v>45000.25</v></c>' if i % 2 else "") + (f'<c r="D{i + 2}"><v>{i}</v></c>' if i % 3 else "") + "</row>" for i in range(n)) + "</sheetData></worksheet>")
    rows = formats.read_xlsx(spark, str(path), dates=["day"])
    assert rows.columns == ["name", "day", "n"]
    found = rows.selectExpr("count(*) as n", "count(distinct name) as names", "count(day) as days", "min(cast(day as string)) as day", "sum(cast(n as long)) as total").first()
    assert tuple(found) == (n, 20_000, n // 2, "2023-03-15 06:00:00", sum(i for i in range(n) if i % 3))
