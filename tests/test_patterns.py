"""Python patterns against Spark's engine, and expressions against plain Python."""

import math
import re

import pytest
from pyspark.sql import functions as F

from normslice.errors import NormError
from normslice.plans import recipes
from normslice.plans.patterns import java

PATTERNS = [
    "abc", "^abc$", r"\Aabc\Z", r"(?P<year>\d{4})-(?P<m_m>\d\d)", r"(?P<q>['\"])x(?P=q)", r"a{,2}b", r"x{", r"{a}", "a{2}", r"[[a]", r"[a&&b]", r"[^\W\d_]+", r"\bcafé\b", r"\Bb", r"(?i)STRASSE|ÉTÉ", r"(?i:abc)D",
    r"(?m)^b$", r"(?s)a.b", "a.b", r"a$", r"\s", r"\S+", r"[\s-]x", r"(?a)\w+é", r"(?<=a)b", r"(?<!a)b", r"a(?=b)", r"a(?!b)", r"(a)(b)?\1", r"(a)\1", r"\x41|é|\101", r"a|", "", r"(?x) a  b # c",
    r"a++b", r"(?>a*)b", r".*?b", r"[\]\\^-]", r"\.", r"-", r"a\Z", r"(?:x|(?i:y))+$", r"[\d-]", r"[+--]", "\t", r"\d", r"(?a)\d", "\U0001f600", r"[\U0001f600-\U0001f602]",
]
TEXTS = ["abc", "xabc", "abc\n", "abc\r", "2024-05", "'x'", "'x\"", "aab", "x{", "{a}", "[", "&", "b", "b\nb", "a\nb", "a\rb", "a b", "café au", "CAFÉ", "ab", "aa", "strasse", "été", "abcD", "ABCD", "ABCd", "\x1c", " ", " ", "-x", "", " ", "٣", "ⅷ", "²", "_", "é", "Aé", "y", "Y", "xxY\n", "\U0001f601", "]", "^", "\\", "-", ",", "a\n", "漢字", "A", "\t"]


def test_patterns_find_what_python_finds(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    row = df.agg(*(F.collect_set(F.when(F.col("t").rlike(java(p)), F.col("i"))).alias(f"p{k}") for k, p in enumerate(PATTERNS))).first()
    for k, p in enumerate(PATTERNS):
        assert sorted(row[k]) == [i for i, t in enumerate(TEXTS) if re.search(p, t)], p


@pytest.mark.parametrize("pattern", ["(", "[", "a{2,1}", r"\q", "(?L)a", r"(a)?(?(1)b|c)", "(?P<a>x)(?P<a>y)", 5, "*"])
def test_refused_patterns(pattern):
    with pytest.raises(NormError):
        java(pattern)
    with pytest.raises(NormError):
        recipes.check({"name": "n", "kind": "count_events", "where": {"column": "c", "regex": pattern}})


def test_expressions(spark):
    df = spark.createDataFrame([(3.0, -4.0, None, 0.5)], "a double, b double, n double, `two words` double")
    cases = {
        "abs(b) + sqrt(a * a)": 7.0, "a > 1 & b < 0": 1.0, "a > 1 and b > 0": 0.0, "a > 5 | b < 0": 1.0, "~(a > 5)": 1.0, "not a > 5": 1.0, "0 < a < 4": 1.0, "0 < a < 3": 0.0, "n > 0 or a > 0": 1.0, "not n > 0": 1.0,
        "log1p(`two words`)": math.log1p(0.5), "floor(`two words`) + ceil(0.2)": 1.0, "(a > 1) * 2 + (b > 1)": 2.0, "a / 0": None, "log(b)": None, "n + 1": None, "-abs(-a) ** 2": -9.0,
    }
    row = df.select(*(recipes.expression(t, lambda name: F.col(f"`{name}`")).alias(f"x{k}") for k, t in enumerate(cases))).first()
    for k, (t, want) in enumerate(cases.items()):
        assert row[k] == (want if want is None else pytest.approx(want)), t
    for bad in ("a if b else c", "f(a)", "abs(a, b)", "a & b", "a.b", "[a]", "__import__('os')", "a > 'x'", "not a"):
        with pytest.raises(NormError):
            recipes.expression(bad, None)
