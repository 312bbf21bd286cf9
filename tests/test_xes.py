"""XES in byte ranges: whatever the cuts, the same events; hostile and broken files are refused."""

import gzip
import random

import pytest

from normslice.sources.xes import read_xes, repeated_traces

HEAD = """<?xml version="1.0" encoding="UTF-8" ?>
<!-- written by hand -->
<log xes.version="1.0" xmlns="http://www.xes-standard.org/">
<extension name="Concept" prefix="concept" uri="http://www.xes-standard.org/concept.xesext"/>
<global scope="trace"><string key="concept:name" value="?"/></global><global scope="event"><string key="concept:name" value="?"/></global>
<classifier name="a" keys="concept:name"/>
"""


def a_log(seed, cases=12, giant=40):
    r = random.Random(seed)
    parts, want = [HEAD], []
    for t in range(cases):
        n = giant if t == 5 else r.randrange(5)
        name = f"case {t} é漢&amp;&lt;"
        parts.append(f'<trace>\n <string key="concept:name" value="{name}"/><int key="amount" value="{t * 3}"/>')
        for e in range(n):
            parts.append(f'\n  <event><string key="concept:name" value="a{e} &gt; x > y"/><date key="time:timestamp" value="2024-01-01T10:00:{e % 60:02d}.000+00:00"/></event>' + ("<!-- </trace> -->" if e % 7 == 3 else ""))
            want.append((f"case {t} é漢&<", str(t * 3), t + 1, e, f"a{e} > x > y"))
        parts.append("</trace>\n")
    return "".join(parts) + "</log>\n", want


def rows(spark, path, **options):
    found = read_xes(spark, str(path), ["amount"], **options).collect()
    return sorted((r["case:concept:name"], r["case:amount"], r["trace_position"], r["event_position"], r["concept:name"]) for r in found)


@pytest.mark.parametrize("size", [97, 300, 5_000, 10**8])
def test_cuts_do_not_matter(spark, tmp_path, size):
    """Ranges of fewer bytes than a record, ranges inside the giant trace, one range."""
    text, want = a_log(1)
    (tmp_path / "a.xes").write_text(text, encoding="utf-8")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    empty = sum(1 for k in range(12) if not any(w[2] == k + 1 for w in want))
    assert empty  # traces without events have no rows and are not counted
    numbers = {t: i + 1 for i, t in enumerate(sorted({w[2] for w in want}))}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        assert spark.read.text(str(tmp_path / "a.xes")).rdd.getNumPartitions() >= min(30, len(text) // size)
        assert rows(spark, tmp_path / "a.xes", strict=True) == sorted((a, b, numbers[t], e, n) for a, b, t, e, n in want)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_compressed_and_many_files(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    want = []
    for k in range(3):
        text, own = a_log(k, cases=6 + k, giant=3)
        numbers = {t: i + 1 for i, t in enumerate(sorted({w[2] for w in own}))}
        want += [(a, b, numbers[t], e, n) for a, b, t, e, n in own]
        (folder / f"{k}.xes.gz").write_bytes(gzip.compress(text.encode()))
    assert rows(spark, folder) == sorted(want)
    assert repeated_traces(read_xes(spark, str(folder))).count() > 0


BODY = '<trace><string key="concept:name" value="t"/>{}<event><string key="concept:name" value="a"/></event></trace>'


@pytest.mark.parametrize(
    "text, says",
    [
        ('<!DOCTYPE log [<!ENTITY x "y">]><log>' + BODY.format("") + "</log>", "declarations"),
        ("<log>" + BODY.format('<string key="k" value="&x;"/>') + "</log>", "undefined entity"),
        ("<log>" + BODY.format("<!-- </event> -->") + "</log>", "declarations"),
        ('<?xml version="1.0" encoding="ISO-8859-1"?><log>' + BODY.format("") + "</log>", "UTF-8"),
        ("<log>" + BODY.format("").replace("</trace>", '<string key="late" value="1"/></trace>') + BODY.format("") + "</log>", "behind its events"),
        ("<log>" + BODY.format('<string key="k"><string key="j" value="1"/></string>') + "</log>", "nested"),
        ("<log>" + BODY.format('<string key="k" value="1"/><int key="k" value="1"/>') + "</log>", "more than once"),
        ("<log>" + BODY.format(""), "no end"),
        ("<log>" + BODY.format("") + '<trace><string key="concept:name" value="u"/>', "no end"),
        ("<log>" + BODY.format("").replace('value="a"/>', 'value="a">') + "</log>", "mismatched"),
    ],
)
def test_what_is_refused(spark, tmp_path, text, says):
    path = tmp_path / "x.xes"
    path.write_text(text)
    with pytest.raises(Exception, match=says):
        read_xes(spark, str(path), strict=True).collect()


def test_prefixed_names(spark, tmp_path):
    path = tmp_path / "x.xes"
    path.write_text('<x:log xmlns:x="urn:x">' + BODY.format("").replace("<", "<x:").replace("<x:/", "</x:") + "</x:log>")
    assert [(r["case:concept:name"], r["concept:name"]) for r in read_xes(spark, str(path), strict=True, prefix="x:").collect()] == [("t", "a")]
