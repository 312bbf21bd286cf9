"""The pipeline's near-duplicate stage against brute-force five-word similarity."""

import random
import re

import corpus_pipeline
import numpy as np
from normslice.llm import common, near_copies
from tests.llm.conftest import prose


def plain_groups(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    group = {i: i for i in texts}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    pairs = 0
    for a in texts:
        for b in texts:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                pairs += 1
                ra, rb = find(a), find(b)
                group[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in texts}, pairs


def edited(r, text, edits):
    words = text.split()
    for _ in range(edits):
        words[r.randrange(len(words))] = "edit" + str(r.randrange(10**6))
    return " ".join(words)


def corpus():
    """Edited copies about the threshold, a family that overfills COMMON, short texts, and a passage that many share."""
    r, texts = random.Random(3), []
    for k in range(30):
        base = prose(100 + k, r.choice([5, 6, 9, 12, 40, 150, 400]))
        texts += [base, *(edited(r, base, r.randint(1, 1 + len(base.split()) // 40)) for _ in range(3)), base + " one more", base.upper()]
    family = prose(7, 120)
    texts += [edited(r, family, r.randint(1, 4)) for _ in range(90)]
    passage = prose(8, 30)
    texts += [f"{prose(900 + k, 30)} {passage} {prose(2000 + k, 30)}" for k in range(80)]
    texts += [None, "", " "]
    r.shuffle(texts)
    return dict(enumerate(texts))


def test_groups_equal_brute_force(spark, make_docs, monkeypatch):
    texts = corpus()
    want, pairs = plain_groups(texts)
    assert pairs > 200
    docs = make_docs(list(texts.values()))
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()} == want
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def plain_fingerprint(hashes):
    words, mask = [], (1 << 64) - 1
    for salt in (0, 0xD6E8FEB86659FD93, 0xA5A3564E27F8861B, 0x2545F4914F6CDD1D):
        ones = [0] * 64
        for h in hashes:
            x = (int(h) & mask) ^ salt
            x = ((x ^ x >> 32) * 0xBF58476D1CE4E5B9) & mask
            x = ((x ^ x >> 29) * 0x94D049BB133111EB) & mask
            x ^= x >> 32
            for b in range(64):
                ones[b] += x >> b & 1
        words.append(sum(1 << b for b in range(64) if 2 * ones[b] > len(hashes)))
    return words


def test_simhash_finds_the_near_copies_in_reach_of_its_pieces(spark, make_docs):
    r, texts = random.Random(11), []
    for k in range(60):
        base = prose(4000 + k, 150)
        texts += [base, edited(r, base, r.randint(1, 4))]
    named, prints, nodes = near_copies.folded(make_docs(texts))
    own = [plain_fingerprint(near_copies.shingles(near_copies.words_of(t))) for t in texts]
    assert {x["doc_id"]: [x[w] & (1 << 64) - 1 for w in near_copies.PRINT] for x in prints.collect()} == dict(enumerate(own))
    apart = lambda x, y: [(u ^ v) for u, v in zip(x, y, strict=True)]
    near = [(a, a + 1) for a in range(0, 120, 2) if plain_groups({0: texts[a], 1: texts[a + 1]})[1]]
    reach = [(a, b) for a, b in near if any((d >> s & 0xFFFFFFFF).bit_count() <= 1 for d in apart(own[a], own[b]) for s in (0, 32))]
    found = {(x["a"], x["b"]) for x in near_copies.simhash_links(nodes, named).collect()}
    assert found == set(reach)
    assert len(reach) > len(near) // 2 > 20


def test_only_what_simhash_leaves_apart_meets_by_shingles(spark, make_docs, monkeypatch):
    base = prose(77, 200)
    texts = [base, base + " more", prose(78, 200), base[: len(base) // 2] + prose(79, 100)]
    passed = []
    verified = near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *rest: passed.append(pairs.count()) or verified(pairs, *rest))
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(make_docs(texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}
    assert passed == [1, 0, 0]


def test_texts_on_the_fringe_of_a_family_are_not_all_compared_with_it(spark, make_docs, monkeypatch):
    r, base = random.Random(21), prose(500, 400)
    texts = [base, *(edited(r, base, 4) for _ in range(80)), *(edited(r, base, 13) for _ in range(80))]
    want, _ = plain_groups(dict(enumerate(texts)))
    assert 60 < len(set(want.values())) < 90  # of the second eighty hardly one is near to any other text
    passed = []
    verified = near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *rest: passed.append(pairs.count()) or verified(pairs, *rest))
    assert {x["doc_id"]: x["component_id"] for x in near_copies.near_copies(make_docs(texts)).collect()} == want
    assert passed[2] < 160  # of 6,400 pairs


def test_the_order_of_shingles_is_bounded_and_changes_no_group(spark, make_docs, monkeypatch):
    docs = make_docs(list(corpus().values()))
    want, _ = plain_groups(corpus())
    named = near_copies.folded(docs)[0]
    monkeypatch.setattr(near_copies, "SAMPLED", 1)
    every = {x["token"]: x["held"] for x in near_copies.common_shingles(named).collect()}
    assert min(every.values()) == 2 and len(every) > 1000
    monkeypatch.setattr(near_copies, "COMMON", 1000)
    some = {x["token"]: x["held"] for x in near_copies.common_shingles(named).collect()}
    assert 0 < len(some) <= 1000 and min(some.values()) > max(held for token, held in every.items() if token not in some)
    assert {x["doc_id"]: x["component_id"] for x in near_copies.near_copies(docs).collect()} == want


def test_bucket_counts_never_exceed_the_difference():
    r = np.random.default_rng(5)
    pruned = 0
    for n, m in [(0, 0), (0, 7), (1, 1), (60, 70), (900, 1100), (5000, 5200), (40_000, 33_000)]:
        for shared in (0.0, 0.5, 0.9, 1.0):
            both = r.integers(-(2**63), 2**63, int(shared * min(n, m)))
            u, v = (np.unique(np.concatenate((both, r.integers(-(2**63), 2**63, k - len(both))))) for k in (n, m))
            apart = len(np.setxor1d(u, v, assume_unique=True))
            bound = near_copies.counted_apart(near_copies.bucket_counts(u), near_copies.bucket_counts(v))
            assert bound <= apart
            pruned += 9 * bound > len(u) + len(v)
    assert pruned >= 10
    crowded = np.arange(0, 1 << 20, 1 << 10)  # a thousand shingles in one bucket: the byte is full
    assert near_copies.counted_apart(near_copies.bucket_counts(crowded), near_copies.bucket_counts(crowded + 1)) <= 2 * len(crowded)


def test_a_worker_keeps_the_tables_of_one_operator():
    made = []
    for _ in range(2):
        common.held("codec", lambda: made.append("codec"))
    near_copies.shingles(near_copies.words_of("words of another operator"))
    assert made == ["codec"] and list(common._HELD) == ["word hashes"]
    assert len(common._HELD["word hashes"]) == 4


def test_empty_and_awkward_rows(spark, awkward, empty):
    assert corpus_pipeline.drop_near_duplicates(spark, empty, "").count() == 0
    kept = corpus_pipeline.drop_near_duplicates(spark, awkward, "").collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == [0, 3, 4, 6, 7, 8, None]


def test_joins_of_questions_and_shared_shingles_are_never_broadcast(spark, make_docs, monkeypatch):
    """Spark takes 132 questions of a text for one row: under its own threshold they would all come to the driver."""
    plans, verified = [], near_copies._verified

    def noted(pairs, *rest):
        plans.append(pairs._jdf.queryExecution().executedPlan().toString())
        return verified(pairs, *rest)

    monkeypatch.setattr(near_copies, "_verified", noted)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    near_copies.near_copies(make_docs([prose(k, 40) for k in range(6)]))
    assert len(plans) == 3
    for plan, key in zip(plans, ("piece", "token", "token"), strict=True):
        assert re.search(rf"SortMergeJoin \[{key}#", plan) and not re.search(rf"BroadcastHashJoin \[{key}#", plan)
