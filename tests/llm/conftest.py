import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": "the and ing er on th ed at re".split(), "de": "der und ung keit sch ein ge ver ß".split(), "fr": "le et ment eux é tion ou que è".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, lang, src, len(t) if t is not None else None) for i, t, lang, src in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    rows = [(i, prose(rng, lang, 60 + i), lang, f"s{i % 3}") for i, lang in enumerate(["en", "de", "fr"] * 12)]
    long = prose(rng, "en", 30_000)
    return rows + [
        (100, None, "en", "s0"), (101, "", "de", "s1"), (102, " \n\t ", None, None), (103, long, "en", "s0"), (104, rows[0][1], "en", "s2"),
        (104, rows[0][1], "en", "s2"), (105, rows[1][1], None, "s0"), (None, rows[2][1], "fr", None), (None, None, None, None), (106, "12 34 ½ !!", "en", "s1"),
        (107, "x", "en", "s1"), (107, "y z", "en", "s1"),
    ]


@pytest.fixture(scope="session")
def odd_docs(make_docs, odd_rows):
    return make_docs(odd_rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
