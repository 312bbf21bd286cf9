"""Near-duplicates by MinHash, spelling variants and source divergence against brute force."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from normslice.llm import bayes_minhash, common, divergence, spelling
from tests.llm.conftest import prose

SPACE = " \t\n\x0b\x0c\r"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def split_words(text):
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


# ---- MinHash ---------------------------------------------------------------------------------------------------------


def plain_components(rows, percent=85):
    sets = []
    for _, text in rows:
        w = split_words(lowered(text))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    links = 0
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            links += sets[a] != sets[b]
            ra, rb = find(a), find(b)
            group[max(ra, rb)] = min(ra, rb)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)], links


def edited(r, text, edits):
    words = text.split()
    for _ in range(edits):
        words[r.randrange(len(words))] = "edit" + str(r.randrange(10**6))
    return " ".join(words)


def test_minhash_components_equal_brute_force(spark, make_docs):
    r, texts = random.Random(5), []
    for k in range(25):
        base = prose(300 + k, r.choice([3, 5, 6, 9, 12, 40, 150, 400]))
        texts += [base, *(edited(r, base, r.randint(1, 1 + len(base.split()) // 50)) for _ in range(3)), base + " one more", base.upper()]
    family = prose(17, 150)
    texts += [edited(r, family, r.randint(1, 5)) for _ in range(80)] + [family]
    passage = prose(18, 40)
    texts += [f"{prose(700 + k, 20)} {passage} {prose(1700 + k, 20)}" for k in range(40)]
    texts += [None, "", " \n", "a", "a", "A\x0bb", "a b"]
    r.shuffle(texts)
    ids = [r.randrange(10**6) for _ in texts]
    want, links = plain_components(list(zip(ids, texts, strict=True)))
    assert links > 100
    got = bayes_minhash.near_duplicates(make_docs(texts, ids)).collect()
    assert sorted((g["doc_id"], g["n_shingles"], g["component_id"]) for g in got) == sorted(want)
    assert all(g["kept"] == (g["doc_id"] == g["component_id"]) for g in got)


def test_minhash_awkward(awkward, empty, make_docs):
    got = bayes_minhash.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    by = {(g["doc_id"], g["n_shingles"] == 0): (g["component_id"], g["kept"]) for g in got}
    assert by[0, True] == (0, True) and by[2, True] == (2, True)  # without words: linked with nothing
    assert by[5, False] == (4, False) and by[None, False] == (None, True)
    assert bayes_minhash.near_duplicates(empty).collect() == []
    texts = [prose(2, 80), prose(2, 80)]
    other = make_docs(texts, [1, 2]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {g["component_id"] for g in bayes_minhash.near_duplicates(other).collect()} == {"d1"}


def test_minhash_entries_are_lean_and_wide_tables_go(spark, make_docs, monkeypatch):
    """Band entries (32 a set) travel as bucket and key; sets that meet none end there; tables with all signatures are not kept."""
    kept = {}

    def stored(df, name):
        kept.setdefault(name, []).append((df._jdf.queryExecution().optimizedPlan().toString(), out := common.stored(df, name)))
        return out

    monkeypatch.setattr(bayes_minhash, "stored", stored)
    base = prose(31, 200)
    docs = make_docs([base, base.replace(base.split()[100], "other"), *(prose(40 + k, 60) for k in range(20))])
    assert len(bayes_minhash.near_duplicates(docs).collect()) == 22
    assert [frame.columns for frames in kept.values() for plan, frame in frames if "substring(signature" in plan] == [["bucket", "key", "held"]]
    signed = [frame.count() for frames in kept.values() for _, frame in frames if "signature" in frame.columns]
    assert signed == [2]


def test_posterior_bounds():
    from fractions import Fraction

    needed = bayes_minhash.least_matches(85, 1e-9)
    t = Fraction(85, 100)
    for k, m in enumerate(needed):
        n = 16 * (k + 1)
        # posterior of the similarity under a uniform prior: integrate x^m (1-x)^(n-m) from t to 1
        x = np.linspace(0, 1, 200_001)

        def chance(m, n=n, x=x):
            d = x**m * (1 - x) ** (n - m)
            return d[x >= float(t)].sum() / d.sum()

        assert chance(m) >= 0.9e-9 and (m == 0 or chance(m - 1) < 1.1e-9)
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 32, (1000, 128), dtype=np.uint32)
    b = np.where(rng.random((1000, 128)) < 0.85, a, a + np.uint32(1))
    assert bayes_minhash.may_be_near(a, b, 85, 1e-9).all()
    assert not bayes_minhash.may_be_near(a, np.where(rng.random((1000, 128)) < 0.3, a, a + np.uint32(1)), 85, 1e-9).any()


# ---- spelling --------------------------------------------------------------------------------------------------------


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows):
    counts = Counter()
    for i, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += lowered(c)
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % 97 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[run] += 1
                run = ""
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    form, n_near = {}, {}
    for w in n:
        others = sorted((o for o in n if near(w, o)), key=lambda o: (-n[o], o))
        n_near[w] = len(others)
        form[w] = others[0] if others and n[others[0]] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], n_near[w], n[form[w]] if form[w] else None)
    return out


def misspelt(seed, texts):
    r = random.Random(seed)
    stems = ["banana", "reference", "letter", "ananas", "aaaaaa", "aaaaa", "élèves", "straße", "modern", "moderne", "moderns", "÷×÷×÷", "reference" * 3]
    out = []
    for _ in range(texts):
        words = []
        for _ in range(60):
            w = r.choice(stems)
            for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("aber") + w[at:], w[:at] + r.choice("aber") + w[at + 1 :]]) or w
            words.append(w.upper() if r.random() < 0.1 else w)
        out.append(r.choice([" ", ", ", "1", "漢"]).join(words))
    return out


@pytest.mark.parametrize("limits", [{}, {"key_limit": 2, "shard_rows": 64}])
def test_spelling_equals_brute_force(spark, make_docs, limits):
    texts = [*misspelt(4, 60), None, "", "z" * 9000, " ".join(["z" * 900] * 3), " ".join(["z" * 899] * 9)]
    rows = list(enumerate(texts))
    want = plain_variants(rows)
    assert sum(v[0] is not None for v in want.values()) > 100 and any(v[1] != v[0] and v[0] for v in want.values())
    got = spelling.spelling_variants(make_docs(texts), **limits).collect()
    assert {g["word"]: (g["form"], g["root"], g["n"], g["n_near"], g["form_n"]) for g in got} == want
    assert len(got) == len(want)


def test_spelling_awkward(awkward, empty, make_docs):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = {g["word"]: (g["form"], g["root"], g["n"], g["n_near"], g["form_n"]) for g in spelling.spelling_variants(awkward).collect()}
    assert got == plain_variants(rows)
    assert spelling.spelling_variants(empty).collect() == []


def test_automaton():
    words = sorted({w.encode("latin-1") for t in misspelt(9, 20) for w in split_words(t.replace(",", " ")) if w.isascii()})
    automaton = spelling.Automaton(words)
    assert [automaton.number(w) for w in words] == list(range(len(words)))
    assert automaton.number(b"nothing") == automaton.number(b"") == -1
    # minimal: no two states lead to the same words
    def behind(s):
        return (automaton.final[s], tuple((b, to) for b, (to, _) in automaton.steps[s].items()))

    assert len({behind(s) for s in range(len(automaton.steps))}) == len(automaton.steps)
    for w in words[:80]:
        found = {words[n] for n, _, _ in automaton.one_error(w, 0)}
        assert found == {o for o in words if len(o) >= len(w) and near(w.decode(), o.decode())}


# ---- divergence ------------------------------------------------------------------------------------------------------


def plain_divergence(rows, least_docs, top):
    counts, docs, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        run, found = "", []
        for c in text + " ":
            if c.isascii() and not c.isalpha():
                if run:
                    found.append(lowered(run))
                run = ""
            else:
                run += c
        for w in found:
            counts[lang, source, w] += 1
        for w in set(found):
            docs[lang, w] += 1
    out = set()
    for lang in {g[0] for g in groups}:
        sources = sorted(s for x, s in groups if x == lang)
        kept = [w for (x, w), d in docs.items() if x == lang and d >= least_docs]

        def shares(count, kept=kept):
            total = sum(count(w) for w in kept)
            return {w: 1 + 1000000000 * (count(w) + 5) // (total + 5 * len(kept)) for w in kept}

        p = {s: shares(lambda w, s=s, lang=lang: counts[lang, s, w]) for s in sources}
        q = shares(lambda w, lang=lang: sum(counts[lang, s, w] for s in sources))
        for s in sources:
            pair = [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in sources if o != s]
            term = [(q[w] - p[s][w], w.encode()) for w in kept if counts[lang, s, w] and p[s][w] > q[w]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                out |= {(lang, s, part, w.decode(), -v, k + 1) for k, (v, w) in enumerate(sorted(items)[:most])}
    return out


@pytest.mark.parametrize("light_share, tile, block", [(12, 64, 2048), (1, 3, 16), (1000, 3, 16)])
def test_divergence_equals_brute_force(spark, light_share, tile, block):
    r = random.Random(8)
    common = ["the", "Été", "漢字", "a", "and", "x" * 300] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = []
    for k in range(260):
        lang, source = r.choice(["en", "de", None, "xx"]), r.choice([f"s{j}" for j in range(9)] + [None, ""])
        words = [r.choice(common[: 6 + 6 * (1 + (int(source[1:]) if source and source[1:] else 0))]) for _ in range(r.randint(0, 40))]
        rows.append((r.choice([" ", "-", "9"]).join(words) if k % 13 else None, lang, source))
    rows.append(("only", "lonely", "s1"))
    df = spark.createDataFrame([(None, *x, 1) for x in rows], "doc_id long, text string, lang string, source string, gid long")
    got = divergence.divergence(df, least_docs=4, top_terms=5, light_share=light_share, tile=tile, block=block)
    assert {tuple(g) for g in got.select("lang", "source", "part", "item", "value", "rank").collect()} == plain_divergence(rows, 4, 5)


def test_divergence_awkward(spark, awkward, empty):
    rows = [(r["text"], r["lang"], r["source"]) for r in awkward.collect()]
    for least in (1, 30):
        got = {tuple(g) for g in divergence.divergence(awkward, least_docs=least).collect()}
        assert got == plain_divergence(rows, least, 50)
    assert divergence.divergence(empty).collect() == []


def test_counting_tasks_send_on_when_full(make_docs):
    docs = make_docs([prose(k, 60) for k in range(40)])
    whole, cut = (sorted(map(tuple, divergence.term_counts(docs, held).collect())) for held in (10**6, 5))
    assert whole == cut
    whole, cut = (sorted(map(tuple, spelling.vocabulary(docs, held=held).collect())) for held in (10**6, 5))
    assert whole == cut


def test_counts_of_sources_and_languages_share_a_shuffle(make_docs):
    docs = make_docs([prose(k, 20) for k in range(5)])
    by_term = divergence.term_counts(docs).withColumn("df", F.sum("docs").over(Window.partitionBy("lang", "term")))
    plan = by_term._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert len(re.findall(r"\bExchange\b", plan)) == 1
    below = plan[plan.index("Exchange") :]
    assert "MapInArrow" in below and "HashAggregate" not in below  # a row a term and task, not one a source as well


def test_a_batch_of_long_texts_is_sent_in_parts():
    texts = [" ".join(f"x{chr(97 + k)}{chr(97 + j)}" for j in range(20)) for k in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*(("en", f"s{k % 2}", t) for k, t in enumerate(texts * 2)), strict=True)], ["lang", "source", "text"])
    sent = list(divergence.counted(iter([batch]), 30))  # more than a document, less than two
    assert [b.num_rows for b in sent] == [40] * 20
    whole = list(divergence.counted(iter([batch]), 10**6))
    assert [b.num_rows for b in whole] == [400]
    assert {(r["term"], e["source"], e["n"], e["docs"]) for b in whole for r in b.to_pylist() for e in r["entries"]} == {(w, f"s{k % 2}", 2, 2) for k, t in enumerate(texts) for w in t.split()}
