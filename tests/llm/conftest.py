from __future__ import annotations

import pytest

#: Clashing names that operators use inside, as extra columns.
EXTRA = "kept string, n_words string, score string, label string, sid string, row string, id string, features string"
TEXTS = [
    (1, "one two three"),
    (2, None),
    (3, ""),
    (4, " \t\r\n\x0b\x0c "),
    (5, "the quick brown fox jumps over the lazy dog near the river bank today " * 3),
    (6, "the quick brown fox jumps over the lazy dog near the river bank today " * 3),
    (6, "the quick brown fox jumps over the lazy dog near the river bank today " * 3),
    (None, "a text without an id but with some words in it"),
    (None, None),
    (7, "Ünïcode wörds 😀😀 ÀÉÎ — naïve café\nsecond line\nsecond line\n\x1codd\x1dspace"),
    (8, "x" * 50_000),
    (9, "\n".join(f"line {i % 50} has words {i * i}" for i in range(4000))),
    (40, "write to a.b+c@mail.example.com or +1 (929) 555-1803, card 4468566586596931 at 10.0.0.255!"),
]


@pytest.fixture
def odd_docs(spark):
    rows = [(i, t, None if k % 3 == 0 else "en", None, *["clash"] * 8) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {EXTRA}").repartition(3)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], f"doc_id long, text string, lang string, source string, {EXTRA}")


@pytest.fixture
def labels(spark):
    rows = [(1, 1, 0), (1, 1, 0), (5, 1, 0), (6, 0, 0), (None, 1, 0), (7, None, None), (9, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
