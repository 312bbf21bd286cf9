"""Readers on small files, sequences, and live scores as a stream."""

import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from normslice.errors import LogSchemaError, NormError
from normslice.operators import sequences as S
from normslice.operators.scoring import score
from normslice.queries.logs import norm, user_days
from normslice.queries.reports import live_norm
from normslice.sources import formats
from normslice.streaming.live import event_windows, live_scores, upsert

XES = """<?xml version="1.0" encoding="UTF-8"?><log xmlns="http://www.xes-standard.org/">
<trace><string key="concept:name" value="t1"/><int key="amount" value="7"/>
<event><string key="concept:name" value="a"/><date key="time:timestamp" value="2024-01-01T10:00:00.000+00:00"/><string key="org:resource" value="u"/></event>
<event><string key="concept:name" value="b"/><date key="time:timestamp" value="nonsense"/></event></trace>
<trace><string key="concept:name" value="t2"/></trace></log>"""


def test_xes(spark, tmp_path):
    path = tmp_path / "log.xes"
    path.write_text(XES)
    rows = formats.read_xes(spark, str(path), ["amount"]).orderBy("event_position").collect()
    assert [(r["case:concept:name"], r["concept:name"], r["case:amount"], r["event_position"]) for r in rows] == [("t1", "a", "7", 0), ("t1", "b", "7", 1)]
    assert str(rows[0]["time:timestamp"]) == "2024-01-01 10:00:00" and rows[1]["time:timestamp"] is None and rows[0]["org:resource"] == "u"


def test_repeated_keys_are_refused_when_strict(spark, tmp_path):
    path = tmp_path / "log.xes"
    path.write_text(XES.replace('<string key="org:resource" value="u"/>', '<string key="org:resource" value="u"/><string key="org:resource" value="w"/>'))
    assert formats.read_xes(spark, str(path)).where("`org:resource` = 'w'").count() == 1
    with pytest.raises(Exception, match="more than once"):
        formats.read_xes(spark, str(path), strict=True).collect()


def test_ocel(spark, tmp_path):
    doc = {
        "events": [{"id": f"e{i}", "type": "pay", "time": "2024-01-01T00:00:00Z", "relationships": [{"objectId": "po1", "qualifier": "q"}, {"objectId": f"p{i % 2}", "qualifier": "q"}]} for i in range(3)],
        "objects": [{"id": "po1", "type": "po", "attributes": [{"name": "v", "time": "2024", "value": "5"}], "relationships": [{"objectId": "p0", "qualifier": "x"}]}, {"id": "p0", "type": "payment"}, {"id": "p1", "type": "payment"}],
    }
    path = tmp_path / "log.json"
    path.write_text(json.dumps(doc))
    tables = formats.read_ocel(spark, str(path))
    assert tables["events"].count() == 3 and tables["object_attributes"].first()["value"] == "5" and tables["object_links"].first()["other_id"] == "p0"
    row = S.project_objects(tables["links"], "po", "payment").first()
    assert (row["case_id"], row["n_events"], row["n_linked"], row["max_events_of_one"]) == ("po1", 3, 2, 2)
    lists = spark.createDataFrame([("['a', 'b']",), ("[]",), (None,)], "x string").select(formats.python_list(F.col("x")))
    assert [r[0] for r in lists.collect()] == [["a", "b"], [], None]


def test_tables_and_catalogues(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(" a , b\n 1 ,caf\xe9 \n2,z\n".encode("windows-1252"))
    rows = formats.read_strings(spark, str(tmp_path / "x.csv"), ["b"]).collect()
    assert [r["b"] for r in rows] == ["café", "z"] and rows[0]["source_file"].endswith("x.csv")
    assert formats.read_table(spark, str(tmp_path / "x.csv")).count() == 2
    found = formats.catalogue(spark, str(tmp_path / "x.csv"))
    good = found.select(F.lit("./x.csv").alias("path"), "sha256")
    below = formats.catalogue(spark, str(tmp_path))
    assert [r["relative"] for r in below.where("relative not like '%.crc'").collect()] == ["x.csv"] and formats.verify(below, good).count() == 0
    assert formats.verify(found, good).count() == 0
    assert formats.verify(found, good.union(spark.createDataFrame([("y.csv", "0")], "path string, sha256 string"))).count() == 1
    with pytest.raises(LogSchemaError):
        formats.verify(found, spark.createDataFrame([("../x.csv", "0")], "path string, sha256 string"))


def test_workbook(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    path = tmp_path / "book.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main}><workbookPr date1904="1"/></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>name</t></si><si><t>day</t></si><si><t>ann</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="B2"><v>1.5</v></c></row></sheetData></worksheet>')
    row = formats.read_xlsx(spark, str(path), dates=["day"]).first()
    assert row["name"] == "ann" and str(row["day"]) == "1904-01-02 12:00:00"


def test_live_scores_of_a_stream_equal_the_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{sf}/events.parquet").select(F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("case"), "event_type", "ts", "value")
    parts = str(tmp_path / "in")
    source.repartition(3).write.parquet(parts)
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(parts)
    seen = {}

    def keep(batch, _):
        for r in batch.select("case_id", "score__all").collect():
            seen[r["case_id"]] = r["score__all"]

    upsert(live_scores(stream, live_norm(), case_col="case", activity_col="event_type", timestamp_col="ts", watermark=None, keep_forever=True), keep, str(tmp_path / "state")).awaitTermination()
    batch = live_scores(source, live_norm(), case_col="case", activity_col="event_type", timestamp_col="ts")
    assert seen == pytest.approx({r["case_id"]: r["score__all"] for r in batch.collect()})
    assert event_windows(source, "ts", "event_type", "1 day").agg(F.sum("n_events")).first()[0] == source.count()
    for wrong in ({}, {"idle": "1 day", "keep_forever": True}):  # when does a case's state end?
        with pytest.raises(NormError, match="keep_forever"):
            live_scores(stream, live_norm(), case_col="case", activity_col="event_type", timestamp_col="ts", **wrong)
    with pytest.raises(NormError):
        live_scores(source, norm(), case_col="case", activity_col="event_type", timestamp_col="ts")


def test_idle_cases_leave_the_state(spark, tmp_path):
    """Sessions: a case is written once, when it is over, and one that wakes up later starts anew."""
    schema = "case string, event_type string, ts timestamp, value double"
    days = [("a", "click", "2024-01-01"), ("a", "purchase", "2024-01-02"), ("b", "view", "2024-01-01"), ("a", "click", "2024-03-01"), ("z", "view", "2024-06-01"), ("late", "view", "2024-01-03")]
    folder = tmp_path / "in"
    for i, (c, e, t) in enumerate(days):
        spark.createDataFrame([(c, e, t, 1.0)], "case string, event_type string, ts string, value double").selectExpr("case", "event_type", "cast(ts as timestamp) ts", "value").coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    scores = live_scores(stream, live_norm(), case_col="case", activity_col="event_type", timestamp_col="ts", watermark="1 day", idle="20 days")
    seen = []
    upsert(scores, lambda batch, _: seen.extend((r["case_id"], str(r["opened"])[:10], r["n_events"]) for r in batch.collect()), str(tmp_path / "state"), mode="append").awaitTermination()
    assert sorted(seen) == [("a", "2024-01-01", 2), ("a", "2024-03-01", 1), ("b", "2024-01-01", 1)]


def test_sequences(spark):
    df = spark.createDataFrame([("c", i, s) for i, s in enumerate("ABACCB")] + [("d", 0, "A"), ("d", 0, "B")], "case string, i int, s string")
    assert {r["case"]: (r["n_changes"], r["n_returns"]) for r in S.returns(df, "case", ["i"], "s").collect()} == {"c": (4, 1), "d": (None, None)}
    assert [r["length"] for r in S.runs(df.where("case = 'c'"), "case", ["i"], "s").orderBy("run").collect()] == [1, 1, 1, 2, 1]
    with pytest.raises(LogSchemaError):
        S.disjoint_union([df, df], "i")


def test_registered_queries_are_whole(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    result = score(user_days(spark, "/root/testdata/sf0.001"), norm())
    assert result.check_decomposition() < 1e-9
    assert entry.entry(spark).count() > 0
