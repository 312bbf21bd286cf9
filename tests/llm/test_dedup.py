"""SimHash components and exact substrings against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from normslice.llm import near_copies, simhash, substring_dedup
from normslice.llm.common import components
from tests.llm.conftest import prose


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def test_fingerprints_equal_the_definition(awkward):
    for row in awkward.select("text").collect():
        assert simhash.fingerprint(row["text"]) == plain_fingerprint(row["text"])


def test_components_of_fingerprints_with_full_buckets(spark):
    """Families of near fingerprints overfill buckets; the links must be those of all pairs."""
    r = random.Random(5)
    prints = {}
    for family in range(6):
        base = r.getrandbits(64)
        for _ in range(60):
            x = base
            for _ in range(r.randint(0, 3)):
                x ^= 1 << r.randrange(64)
            prints[len(prints)] = x
    for _ in range(100):
        prints[len(prints)] = r.getrandbits(64)
    signed = [(i, int(np.uint64(x).astype(np.int64))) for i, x in prints.items()]
    distinct = spark.createDataFrame(signed, "doc_id long, fp long").groupBy("fp").agg({"doc_id": "min"}).toDF("fp", "node")
    want = plain_components(prints)
    for limit in (4, 1000):
        found = {x["node"]: x["component"] for x in components(simhash.links(distinct, bucket_limit=limit), "a", "b").collect()}
        for row in distinct.collect():
            assert found.get(row["node"], row["node"]) == want[row["node"]]


def test_near_duplicates_of_awkward_rows(awkward):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    by_id = {}
    for x in rows:
        by_id.setdefault(x["doc_id"], []).append(x)
    assert by_id[0][0]["component_id"] == by_id[1][0]["component_id"] == by_id[2][0]["component_id"] == 0
    assert by_id[0][0]["fingerprint"] == "0" * 16
    assert {x["component_id"] for x in by_id[4]} == {4} and by_id[5][0]["component_id"] == 4
    assert by_id[None][0]["component_id"] is None


def test_one_document_of_each_group_stays(awkward, empty):
    kept = simhash.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [0, 3, 4, 6, 7, 8, None]
    assert simhash.drop_near_duplicates(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0


def brute_substrings(rows, length=100):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        mark = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                mark[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, m in zip(raw, mark, strict=True) if not m)
        spans = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        out[doc] = (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def substring_rows():
    r = random.Random(9)
    shared, line = prose(70, 60), prose(71, 30)
    texts = []
    for i in range(60):
        body = prose(100 + i, 120)
        at = r.randrange(len(body))
        if i % 3 == 0:
            body = body[:at] + shared[r.randrange(40) :] + body[at:]
        if i % 4 == 0:
            body = f"{line} {body} {line}"
        texts.append(body)
    texts += [texts[0], texts[1][:300], "ab" * 400, "x" * 99, "x" * 100, "x" * 101, None, "", "é漢" * 120, "é漢" * 90]
    return list(enumerate(texts))


def check_substrings(make_docs):
    rows = substring_rows()
    found = substring_dedup.substring_dedup(make_docs([t for _, t in rows])).collect()
    assert {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in found} == brute_substrings(rows)


def test_substrings_against_brute_force(make_docs):
    check_substrings(make_docs)


def test_substrings_with_small_buffers_shards_and_spread_anchors(make_docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD", 1)  # every shard alone
    monkeypatch.setattr(substring_dedup, "SPREAD_BYTES", 300)
    monkeypatch.setattr(substring_dedup, "SAMPLE", 0.9)
    monkeypatch.setattr(substring_dedup, "RANGE_WINDOWS", 300)
    check_substrings(make_docs)
    found = substring_dedup.removed_windows(make_docs([t for _, t in substring_rows()])).groupBy("by").agg(F.sum("n").alias("n")).collect()
    assert all(r["n"] > 0 for r in found) and {r["by"] for r in found} == {"buffer", "bytes", "suffix", "merge"}


def test_equal_keys_of_different_bytes_remove_nothing(monkeypatch):
    """Every run gets the same key: only runs of equal bytes are covered, the others stay for the shards."""
    real = substring_dedup.runs

    def colliding(data, bounds):
        first, count, anchor, content = real(data, bounds)
        return first, count, np.zeros_like(anchor), np.zeros_like(content)

    monkeypatch.setattr(substring_dedup, "runs", colliding)
    texts = [prose(50, 90), prose(51, 90), prose(50, 90), prose(52, 90)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array(texts)], ["doc", "text"])
    rows = [r for out in substring_dedup._anchored(iter([batch])) for r in out.to_pylist()]
    piece = lambda r: texts[r["doc"]].encode()[r["start"] : r["start"] + r["n"] + 99]
    left = [piece(r) for r in rows if not r["done"]]
    assert any(r["done"] for r in rows) and all(piece(r) in left and r["doc"] == 2 for r in rows if r["done"])
    assert {r["doc"] for r in rows if not r["done"]} >= {0, 1, 3}


def shard_batches(rows, size):
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    for at in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[at : at + size]], t) for i, t in enumerate(types)], list("abcdef"))


def test_groups_of_one_content_need_no_suffix_array(monkeypatch):
    """Equal contents go by their bytes, also over batches; only groups of several contents, or spread ones, are sorted."""
    one, other, third = (prose(k, 60).encode()[:150] for k in (60, 61, 62))
    rows = [(1, -1, d, 0, 51, one) for d in range(5)] + [(2, -1, 1, 9, 51, other)] + [(3, -1, d, 20, 51, (one, third)[d % 2]) for d in range(4)] + [(4, 0, 7, 0, 51, other)]
    given = []
    real = substring_dedup.equal_windows
    monkeypatch.setattr(substring_dedup, "equal_windows", lambda contents: given.extend(contents) or real(contents))
    for size in (1, 2, 3, 100):
        given.clear()
        out = [r for b in substring_dedup._sharded(1)(shard_batches(rows, size)) for r in b.to_pylist()]
        assert given == [one, third, other]
        assert [(r["doc"], r["start"], r["n"]) for r in out if r["by"] == "bytes"] == [(d, 0, 51) for d in range(1, 5)] + [(d, 20, 51) for d in (2, 3)]
        assert [(r["doc"], r["n"], r["window"]) for r in out if r["window"]] == [(7, 51, other)]


def test_covered_runs_travel_as_ranges():
    """A copied text has some ten runs; what covers it is one row of all its windows."""
    text = prose(70, 90)
    batch = pa.RecordBatch.from_arrays([pa.array([3, 8], pa.int64()), pa.array([text, text])], ["doc", "text"])
    rows = [r for out in substring_dedup._anchored_ranges(iter([batch])) for r in out.to_pylist()]
    assert [(r["doc"], r["start"], r["n"]) for r in rows if r["done"]] == [(8, 0, len(text.encode()) - 99)]
    assert sum(r["n"] for r in rows if not r["done"]) == len(text.encode()) - 99


def test_removed_windows_leave_no_shuffle_to_the_cutting(make_docs):
    plan = substring_dedup.removed_windows(make_docs([t for _, t in substring_rows()]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" not in plan


def test_a_run_is_shuffled_as_three_numbers(spark):
    rows = [(7, 1, 3, start, n, done) for start, n, done in [(0, 1, False), (5, 69, False), (2**31 - 1, 128, True), (9, 1 << 21, True), (300, 0, False)]]
    keyed = spark.createDataFrame(rows, substring_dedup._RUN)
    met = substring_dedup._met(keyed, False)
    assert sorted((r["start"], r["n"], r["done"]) for r in met.collect()) == sorted(r[3:] for r in rows)
    assert {(r["anchor"], r["salt"], r["doc"]) for r in met.collect()} == {(7, -1, 3)}
    spread = substring_dedup._met(keyed.withColumn("salt", F.col("doc").cast("int")), True)
    assert {r["salt"] for r in spread.collect()} == {3}
    for frame, width in ((met, 3), (spread, 4)):
        node = frame._jdf.queryExecution().optimizedPlan()
        while node.nodeName() != "RepartitionByExpression":
            node = node.children().apply(0)
        assert node.output().size() == width


def test_windows_by_path(make_docs):
    """The steps together remove as many windows as brute force finds."""
    seen, want = set(), 0
    for _, text in substring_rows():
        raw = (text or "").encode()
        for i in range(len(raw) - 99):
            want += raw[i : i + 100] in seen
            seen.add(raw[i : i + 100])
    found = substring_dedup.windows_by_path(make_docs([t for _, t in substring_rows()])).collect()
    assert sum(r["windows"] for r in found) == want


def test_an_anchor_that_the_sample_misses_is_spread(make_docs, monkeypatch):
    """No document in the sample: the shards are laid out by the counts over all contents."""
    monkeypatch.setattr(substring_dedup, "SPREAD_BYTES", 300)
    monkeypatch.setattr(substring_dedup, "SAMPLE", 1e-9)
    check_substrings(make_docs)


def test_text_ids_are_refused_where_positions_are_computed(spark):
    with pytest.raises(TypeError, match="whole number"):
        substring_dedup.substring_dedup(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_rows_that_repeat_an_id_are_judged_by_their_text(spark, make_docs):
    """Id 4 has a copy of 2 and a text of its own: the copy goes, the other stays. Copies of one row become one."""
    own, other = prose(40, 80), prose(41, 80)
    docs = make_docs([prose(39, 80), own, own, other, other, prose(42, 80)], [1, 2, 4, 4, 4, None])
    for kept in (simhash.drop_near_duplicates(docs), simhash.keep_smallest(docs, near_copies.near_copies(docs))):
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, prose(39, 80)), (2, own), (4, other), (None, prose(42, 80))], key=str)


def test_text_ids(spark):
    texts = {"b": prose(1, 60), "a": prose(1, 60), "c": prose(2, 60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()} == {"a": "a", "b": "a", "c": "c"}
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == ["a", "c"]


def test_substrings_of_awkward_rows(awkward, empty):
    rows = substring_dedup.substring_dedup(awkward).collect()
    assert len(rows) == awkward.count()
    by_id = {}
    for x in rows:
        by_id.setdefault(x["doc_id"], []).append(x)
    assert by_id[None][0]["n_removed"] == 0
    assert all(x["n_removed"] == 0 for x in by_id[4]) and by_id[5][0]["n_removed"] == by_id[5][0]["n_bytes"]
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_suffix_array_and_common_prefixes():
    data = np.frombuffer(b"banana bandana banana split\xff0banana\xff1", np.uint8)
    raw = data.tobytes()
    sa = substring_dedup.suffix_array(data, 64)
    assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    lcp = substring_dedup.common_prefixes(data, sa, 10, stride=4)
    for i in range(1, len(sa)):
        a, b = raw[sa[i - 1] :], raw[sa[i] :]
        n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp[i] == min(n, 10)
