"""Matroska and WARC: round trips and hand-made bytes."""

import base64
import hashlib
import random
import zlib

import pytest

from normslice.llm import matroska as mk
from normslice.llm import warc
from tests.llm.conftest import prose


def test_mux_and_parse_round_trip():
    r = random.Random(1)
    for size in (64, 512, 576, 4096, 4160, 40_000, 100_032):
        payload = r.randbytes(size)
        data = mk.mux(payload)
        media = mk.parse(data)
        assert b"".join(data[a : a + n] for _, _, a, n, *_ in media.packets) == payload
        assert [t for _, t, *_ in media.packets] == [i * mk.FRAME * mk.TICK_NS for i in range(len(media.packets))] or size > mk.CLUSTER_BYTES
        assert [c[2] for c in media.cues] == media.clusters and media.tracks[1]["codec"] == "A_PCM/INT/LIT"


def block(lacing, lace, frames, time=5):
    return b"\x81" + time.to_bytes(2, "big", signed=True) + bytes([0x80 | lacing << 1]) + lace + b"".join(frames)


def file_of(*blocks, unknown=False, group=False):
    body = mk.number(mk.CLUSTER_TIME, 1000)
    for b in blocks:
        body += mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, b)) if group else mk.element(mk.SIMPLE_BLOCK, b)
    cluster = mk.element(mk.CLUSTER, body)
    if unknown:
        cluster = mk.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body
    segment = mk.element(mk.INFO, mk.number(mk.TIMESTAMP_SCALE, 1_000_000)) + cluster + cluster
    return mk.element(mk.EBML, b"") + mk.element(mk.SEGMENT, segment)


@pytest.mark.parametrize("unknown", [False, True])
@pytest.mark.parametrize("group", [False, True])
def test_all_lacings(unknown, group):
    frames = [b"a" * 300, b"b" * 7, b"c" * 1000]
    xiph = block(1, bytes([2, 255, 45, 7]), frames)
    ebml = block(3, bytes([2]) + mk.vint(300) + mk._signed_vint(7 - 300), frames)
    same = block(2, bytes([1]), [b"d" * 4, b"e" * 4], time=-3)
    data = file_of(xiph, ebml, same, block(0, b"", [b"f" * 9]), unknown=unknown, group=group)
    media = mk.parse(data)
    one = [*frames, *frames, b"d" * 4, b"e" * 4, b"f" * 9]
    assert [data[a : a + n] for _, _, a, n, *_ in media.packets] == one * 2
    assert [p[5] for p in media.packets[:9]] == ["xiph"] * 3 + ["ebml"] * 3 + ["fixed"] * 2 + ["none"]
    assert media.packets[0][1] == 1005 * 1_000_000 and media.packets[6][1] == 997 * 1_000_000 and len(media.clusters) == 2


def test_signed_vints_and_cut_files():
    for value in (0, 1, -1, 63, -63, 64, -64, 8191, -8191, 8192, 100_000, -100_000):
        raw = mk._signed_vint(value)
        got, after, _ = mk._vint_at(raw, 0, False)
        assert got - ((1 << 7 * after - 1) - 1) == value and after == len(raw)
    with pytest.raises(ValueError):
        mk.parse(mk.mux(b"x" * 64)[:-5])


def test_every_file_parses_or_raises_a_value_error():
    r = random.Random(2)
    whole = mk.mux(r.randbytes(4160))
    refused = 0
    for _ in range(3000):
        data = bytearray(whole)
        for _ in range(r.randint(1, 3)):
            data[r.randrange(min(400, len(data)))] = r.randrange(256)
        for read in (mk.parse, mk.seek):
            try:
                read(bytes(data[: r.randrange(len(data))] if r.random() < 0.3 else data))
            except ValueError:
                refused += 1
    assert refused > 500
    no_number = mk.element(mk.EBML, b"") + mk.element(mk.SEGMENT, mk.element(mk.TRACKS, mk.element(mk.TRACK, mk.element(mk.CODEC, b"x"))))
    short = file_of(b"\x81\x00")
    wrong_cue = bytearray(whole)
    wrong_cue[whole.rindex(bytes([mk.CUE_CLUSTER, 0x81])) + 2 if bytes([mk.CUE_CLUSTER, 0x81]) in whole else whole.rindex(bytes([mk.CUE_CLUSTER])) + 2] ^= 1
    for bad in (no_number, short, bytes(wrong_cue), b"", b"\x1a\x45"):
        for read in (mk.parse, mk.seek):
            with pytest.raises(ValueError):
                read(bad)


def walk(data, at, end, path=()):
    """An independent reader of known sizes: ``(path of ids in hex, content)`` of all elements."""
    masters = {"1a45dfa3", "18538067", "114d9b74", "4dbb", "1549a966", "1654ae6b", "ae", "e1", "1f43b675", "1c53bb6b", "bb", "b7"}
    while at < end:
        n = 8 - data[at].bit_length() + 1
        name, at = data[at : at + n].hex(), at + n
        n = 8 - data[at].bit_length() + 1
        size = int.from_bytes(data[at : at + n], "big") - (1 << 7 * n)
        at += n
        yield (*path, name), data[at : at + size], at
        if name in masters:
            yield from walk(data, at, at + size, (*path, name))
        at += size


def test_files_have_what_readers_ask_for():
    payload = random.Random(3).randbytes(40_000)
    data = mk.mux(payload)
    found = {}
    for path, content, at in walk(data, 0, len(data)):
        found.setdefault("/".join(path), []).append((content, at))
    one = lambda *names: found["/".join(names)][0][0]
    assert [one("1a45dfa3", x) for x in ("4286", "42f7", "42f2", "42f3", "4282", "4287", "4285")] == [b"\1", b"\1", b"\4", b"\x08", b"matroska", b"\4", b"\2"]
    track = ("18538067", "1654ae6b", "ae")
    assert [one(*track, x) for x in ("d7", "73c5", "83", "86")] == [b"\1", b"\1", b"\2", b"A_PCM/INT/LIT"] and one("18538067", "1549a966", "4d80")
    segment = found["18538067"][0][1]
    cues = segment + int.from_bytes(one("18538067", "114d9b74", "4dbb", "53ac"), "big")
    assert data[cues : cues + 4].hex() == "1c53bb6b"
    clusters = [at for _, at in found["18538067/1f43b675"]]
    starts = [segment + int.from_bytes(c, "big") for c, _ in found["18538067/1c53bb6b/bb/b7/f1"]]
    assert all(data[s : s + 4].hex() == "1f43b675" and s < c for s, c in zip(starts, clusters, strict=True)) and len(starts) == 2
    blocks = [c for c, _ in found["18538067/1f43b675/a3"]]
    frames = b"".join(b[5:] if b[3] >> 1 & 3 == 2 else b[4:] for b in blocks if b[3] >> 1 & 3 in (0, 2))
    laced = [b for b in blocks if b[3] >> 1 & 3 not in (0, 2)]
    assert len(frames) + sum(map(len, laced)) >= len(payload) and payload.startswith(frames[:4096])


@pytest.mark.parametrize("frame", [512, 100, 37])
def test_cues_lead_to_the_same_tables(frame):
    r = random.Random(4)
    for size in (64, 4160, 70_016):
        payload = r.randbytes(size)
        data = mk.mux(payload, frame)
        assert mk.seek(data) == mk.parse(data)
        assert b"".join(data[a : a + n] for _, _, a, n, *_ in mk.seek(data).packets) == payload
    assert "xiph" in {p[5] for p in mk.parse(mk.mux(b"x" * 1050, 100)).packets}


def test_features_are_those_of_the_payload(make_docs):
    for r in mk.media_columns(make_docs(["", "abc", prose(1, 400)])).collect():
        payload = mk.padded(["", "abc", prose(1, 400)][r["doc_id"]].encode())
        samples = [b - 128 for b in payload]
        assert r["feature"].endswith(f"sum={sum(samples)};energy={sum(s * s for s in samples)}") and f"ticks={len(payload)};" in r["feature"]
        assert r["n_packets"] == -(-len(payload) // mk.FRAME) and r["media_sha256"] == hashlib.sha256(mk.mux(payload)).hexdigest()


def test_media_columns(awkward, empty):
    rows = mk.media_columns(awkward).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in awkward.collect()}
    assert len(rows) == awkward.count()
    for r in rows:
        payload = mk.padded(texts[r["doc_id"]])
        assert len(payload) % 64 == 0 and payload
        assert (r["n_bytes"], r["payload_bytes"]) == (len(texts[r["doc_id"]]), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
    assert mk.packet_table(mk.mux_texts(awkward)).groupBy("doc_id").count().count() == 10
    assert mk.media_columns(empty).count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, first long")


def test_archives_round_trip(spark):
    html = "<p>\r\n\r\nWARC/1.1\r\n\r\né漢</p>"
    rows = [(i, f"http://www.Site{i % 3}.example.org:80/p/{i % 5}?q={i}#x", html if i % 3 == 0 else f"<b>{i}</b>", "z", 1) for i in range(60)]
    rows += [(60, None, None, None, None), (61, "not a url\r\nX: y", "", None, None), (7, "http://a", "<b>7</b>", None, None), (None, "http://b", html, None, None), (None, "http://b", "alone", None, None)]
    found = warc.archive_and_index(pages(spark, rows)).collect()
    want = []
    for page, _, text, *_ in rows:
        raw = (text or "").encode()
        first = min((p for p, _, t, *_ in rows if (t or "").encode() == raw and p is not None), default=None)
        revisit = first is not None and page != first
        want.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.archive_and_index(pages(spark, [])).count() == 0


def test_captures_know_their_place_and_the_one_before(spark, monkeypatch):
    """Ranges of a few entries, one URL with a third of all captures, large payloads in files of their own."""
    monkeypatch.setattr(warc, "RANGE_ENTRIES", 7)
    monkeypatch.setattr(warc, "LARGE", 2_000)
    urls = ["http://hot.example.com/"] + [f"http://h{i % 5}.example.com/{i % 4}" for i in range(20)]
    rows = [(i, urls[0] if i % 3 == 0 else urls[1 + i % 20], "y" * (5_000 if i % 40 == 0 else 10) + str(i // 2), None, None) for i in range(150)]
    found = warc.archive_and_index(pages(spark, rows).repartition(5)).collect()
    want, last = [], {}
    for page, url in sorted(((i, u) for i, u, *_ in rows), key=lambda x: (warc.url_key(x[1]), x[0])):
        want.append((len(want), page, last.get(url)))
        last[url] = page
    assert sorted((r["position"], r["page_id"], r["previous_page"]) for r in found) == want
    assert {r["payload_bytes"] for r in found} == {len(t) for _, _, t, *_ in rows}
    alone = [r["file"] for r in found if r["payload_bytes"] > 5_000]
    assert len(alone) == 4 and all(sum(r["file"] == f for r in found) == 1 for f in alone)


def test_the_index_is_in_global_order(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}.example.com/{i % 11}", f"<i>{i}</i>", None, None) for i in range(300)]
    path = str(tmp_path / "archives")
    warc.write_archives(pages(spark, rows).repartition(6), path)
    index = warc.capture_index(warc.read_archives(spark, path)).collect()
    keys = [(r["url_key"], r["timestamp"], r["page_id"]) for r in index]
    assert keys == sorted(keys) and len(keys) == 300


def test_ids_of_any_size_keep_their_order(spark):
    """Hashed 64-bit ids, and times beyond the year 9999."""
    ids = [9 * 10**17, -(10**18), 3 * 10**11, 7, 10**13, 2**63 - 1, -(2**63), 0]
    rows = [(i, "http://one.example.com/", f"<i>{k // 2}</i>", None, None) for k, i in enumerate(ids)]
    found = sorted(warc.archive_and_index(pages(spark, rows).repartition(3)).collect(), key=lambda r: r["position"])
    assert [r["page_id"] for r in found] == sorted(ids) and [r["previous_page"] for r in found] == [None, *sorted(ids)[:-1]]
    times = spark.createDataFrame([(1, "http://a/", "x", 4 * 10**15), (2, "http://a/", "y", 10**12), (3, "http://a/", "z", None), (4, "http://a/", "w", 1_720_000_000)], "page_id long, url string, html string, s long")
    timed = warc.archive_and_index(times.selectExpr("page_id", "url", "html", "timestamp_micros(s * 1000) as t"), time_col="t").collect()
    assert [r["page_id"] for r in sorted(timed, key=lambda r: r["position"])] == [4, 2, 3, 1] and all(len(r["timestamp"]) == 14 for r in timed)


def test_loser_tree():
    r = random.Random(8)
    for k in range(8):
        runs = [sorted((str(r.randrange(9)), str(r.randrange(9)), i, 0, 0, 0, 0, str(n), i) for i in range(r.randrange(12))) for n in range(k)]
        merged = list(warc.LoserTree(runs))
        assert [warc._order(x) for x in merged] == sorted(warc._order(x) for run in runs for x in run)


def test_url_keys():
    assert warc.url_key("HTTPS://www.B.a.org:443/X?y=1#z") == "org,a,b)/x?y=1"
    assert warc.url_key("http://[bad") == "http://[bad"
