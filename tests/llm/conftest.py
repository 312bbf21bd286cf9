import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, _gone int, _blob string, component_id int"
#: Extra columns bear names that operators use inside.
EXTRA = ("x", 1, "y", 2)


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    syllables = ["ba", "ko", "ri", "ten", "lo", "sha", "mu", "ir", "ple", "nd"]
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, None if k % 3 else "xx", None if k % 2 else "src", None if t is None else len(t), *EXTRA) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def awkward(make_docs):
    """Null id, null and empty texts, repeated rows, ties, one very long text and one very long word."""
    long_text = prose(1, 60_000)
    texts = [None, "", "   \n", "a", prose(2, 80), prose(2, 80), prose(2, 80), long_text, "z" * 30_000, "é ß 漢字 \U0001f600 " * 10, prose(3, 50)]
    ids = [0, 1, 2, 3, 4, 4, 5, 6, 7, 8, None]
    return make_docs(texts, ids)


@pytest.fixture(scope="session")
def empty(make_docs):
    return make_docs([])
