"""OCEL in ranges and in three formats; comparisons of tables as multisets."""

import json
import random

import pytest
from pyspark.sql import functions as F

from normslice.errors import LogSchemaError
from normslice.operators import compare
from normslice.sources import ocel


def a_document(seed, n=24):
    r = random.Random(seed)
    tricky = ['{"id": "e1", "type": "x", "time": "t"}', "}{][,", 'a " b \\ c', "é漢\U0001f600", "{" * 50]
    objects = [{"id": f"o{i}", "type": r.choice(["po", "{item}"]), "attributes": [{"name": "note", "time": "2024", "value": r.choice(tricky)}] * r.randrange(3), "relationships": [{"objectId": f"o{r.randrange(n)}", "qualifier": r.choice(tricky)}] * r.randrange(2)} for i in range(n)]
    events = [{"id": f"e{i}", "type": "pay", "time": f"2024-01-01T00:{i % 60:02d}:00Z", "attributes": [], "relationships": [{"objectId": f"o{(i * k) % (n + 1)}", "qualifier": r.choice(tricky)} for k in range(r.randrange(4))]} for i in range(n)]
    objects[7]["attributes"] = [{"name": "long", "time": "2024", "value": "{" + "x" * 700 + "}"}]
    doc = {"objectTypes": [{"name": "po", "attributes": [{"name": "note", "type": "string"}]}], "events": events, "eventTypes": [{"name": "pay", "attributes": []}], "objects": objects}
    return doc


def plain(doc):
    return {
        "events": sorted((e["id"], e["type"]) for e in doc["events"]),
        "objects": sorted((o["id"], o["type"]) for o in doc["objects"]),
        "links": sorted((e["id"], x["objectId"], x["qualifier"]) for e in doc["events"] for x in e["relationships"]),
        "object_links": sorted((o["id"], x["objectId"], x["qualifier"]) for o in doc["objects"] for x in o["relationships"]),
        "object_attributes": sorted((o["id"], x["name"], x["time"], x["value"]) for o in doc["objects"] for x in o["attributes"]),
    }


COLUMNS = {"events": ["event_id", "activity"], "objects": ["object_id", "object_type"], "links": ["event_id", "object_id", "qualifier"], "object_links": ["object_id", "other_id", "qualifier"], "object_attributes": ["object_id", "name", "time", "value"]}


@pytest.mark.parametrize("size, indent, plain_text", [(211, None, True), (1_500, 1, False), (10**8, None, True)])
def test_json_in_ranges(spark, tmp_path, size, indent, plain_text):
    doc = a_document(size)
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=not plain_text), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"events": [], "objects": []}))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        tables = ocel.read_ocel(spark, str(tmp_path / "*.json"))
        want = plain(doc)
        for name, columns in COLUMNS.items():
            assert sorted(tuple(r) for r in tables[name].select(*columns).collect()) == want[name], name
        found = {r["check"]: r["n"] for r in ocel.audit(tables).collect()}
        assert found["events linked to unknown objects"] == sum(x[1] == "o24" for x in want["links"]) and found["events without a time"] == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_damaged_elements_are_named(spark, tmp_path):
    doc = json.dumps(a_document(3))
    for k, (text, says) in enumerate([(doc.replace('"e5", "type"', '"e5" "type"'), "e5"), (doc[: len(doc) // 2], "ends inside"), (doc.replace('"id": "e9"', '"id": "e9'), "damaged|delimiter"), (doc + "\n" + doc, "more than one document")]):
        path = tmp_path / f"{k}.json"
        path.write_text(text)
        with pytest.raises(Exception, match=says):
            ocel.read_ocel(spark, str(path))["events"].count()
            ocel.read_ocel(spark, str(path))["objects"].count()


def test_xml_and_flat_tables_agree_with_json(spark, tmp_path):
    from xml.sax.saxutils import quoteattr

    doc = a_document(11, 20)
    related = lambda x: "<objects>" + "".join(f'<relationship object-id={quoteattr(r["objectId"])} qualifier={quoteattr(r["qualifier"])}/>' for r in x["relationships"]) + "</objects>" if x["relationships"] else ""
    text = "<log><events>" + "".join(f'<event id="{e["id"]}" type="{e["type"]}" time="{e["time"]}">{related(e)}</event>' for e in doc["events"]) + "</events><objects>"
    text += "".join(f'<object id="{o["id"]}" type={quoteattr(o["type"])}><attributes>' + "".join(f'<attribute name="{a["name"]}" time="{a["time"]}"><![CDATA[{a["value"]}]]></attribute>' for a in o["attributes"]) + f"</attributes>{related(o)}</object>" for o in doc["objects"]) + "</objects></log>"
    (tmp_path / "a.xml").write_text(text, encoding="utf-8")
    (tmp_path / "a.json").write_text(json.dumps(doc))
    left, right = ocel.read_ocel(spark, str(tmp_path / "a.json")), ocel.read_ocel_xml(spark, str(tmp_path / "a.xml"))
    for name in ocel.TABLES:
        assert compare.digest(left[name]).first() == compare.digest(right[name]).first(), name
    known = {o["id"]: o["type"] for o in doc["objects"]}
    lines = ["ocel:eid,ocel:activity,ocel:timestamp,ocel:type:po,ocel:type:{item}"]
    for e in doc["events"]:
        of = lambda t, e=e: '"' + str([x["objectId"] for x in e["relationships"] if known.get(x["objectId"]) == t]) + '"'
        lines.append(f"{e['id']},{e['type']},{e['time']},{of('po')},{of('{item}')}")
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    flat = ocel.read_ocel_flat(spark, str(tmp_path / "a.csv"))
    assert compare.digest(flat["events"]).first() == compare.digest(left["events"]).first()
    assert sorted(map(tuple, flat["links"].collect())) == sorted(map(tuple, left["links"].where("object_type is not null").select("event_id", "object_id", "object_type").collect()))


@pytest.mark.parametrize("cells", [4, 64, 8192])
def test_rows_that_differ(spark, cells):
    """Planted differences, repeated rows, NULLs; few cells stall and all rows are counted."""
    r = random.Random(6)
    rows = [(r.randrange(400), r.choice(["a", None, ""])) for _ in range(900)]
    other = rows[3:] + [(1, "new"), (1, "new"), (None, None)]
    other[10] = (other[10][0], "changed")
    schema = "i int, s string"
    found = compare.differing_rows(spark.createDataFrame(rows, schema), spark.createDataFrame(other, "i int, s string").select("s", "i"), cells)
    from collections import Counter

    count = Counter(rows)
    count.subtract(Counter(other))
    assert {(x["i"], x["s"]): x["surplus"] for x in found.collect()} == {k: n for k, n in count.items() if n}
    same = compare.differing_rows(spark.createDataFrame(rows, schema), spark.createDataFrame(rows[::-1], schema), cells)
    assert same.count() == 0
    with pytest.raises(LogSchemaError):
        compare.differing_rows(spark.createDataFrame(rows, schema), spark.createDataFrame(rows, "i int, t string"))
    empty = spark.createDataFrame([], schema)
    assert compare.digest(empty).first()["n"] == 0 and compare.differing_rows(empty, empty).count() == 0
    assert compare.lookup_table(spark.createDataFrame(rows, schema), spark.createDataFrame(rows, schema)).agg(F.count("*")).first()[0] == 0
