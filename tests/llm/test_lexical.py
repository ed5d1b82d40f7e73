"""Ranked search against a plain version, with small blocks and long texts."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from trafficlens.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def cut(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items):
    parts = [(i, Counter(w), len(w)) for i, t in docs if (w := cut(t))]
    n_docs, total = len(parts), sum(p[2] for p in parts)
    df = Counter(t for _, c, _ in parts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, counts, n in parts:
            m = 100 - 75 + 75 * n * n_docs // total
            score = 0
            for t in cut(text):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * counts[t] // (1000 * counts[t] + 8 * m)) if counts[t] else 0
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found)[:10])]
    return sorted(out, key=repr)


def compare(spark, docs, items):
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sorted(map(tuple, lexical.rank(docs, items).collect()), key=repr) == want
    return want


ITEMS = [(1, "The quick brown FOX the"), (2, None), (3, " .,; "), (4, "wörds 😀😀 naïve"), (4, "line 7 has"), (None, "odd line"), (5, "unknown")]


def test_odd_texts(spark, odd_docs):
    items = spark.createDataFrame([(*r, "clash") for r in ITEMS], "item_id long, text string, doc_id string")
    assert compare(spark, odd_docs, items)


@pytest.fixture(scope="module")
def crowd(spark):
    random.seed(5)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(random.choices(words, weights=[1 / (j + 1) for j in range(60)], k=random.randint(1, 80)))) for k in range(700)]
    rows += [(1000 + k, rows[3][1]) for k in range(300)] + [(3, rows[3][1])]  # copies share a score, and an id repeats
    items = [(k, " ".join(random.choices(words, k=random.randint(1, 70)))) for k in range(25)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")


def test_many_documents_and_ties(spark, crowd):
    assert compare(spark, *crowd)


def test_small_blocks(spark, crowd, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 400)  # the driver makes several blocks of items
    assert compare(spark, *crowd)


def test_groups_and_grids_of_every_size():
    """The search itself, in this process, where its limits can be set."""
    random.seed(7)
    items = [{random.randrange(40): random.randint(1, 3) for _ in range(random.randint(1, 30))} for _ in range(12)]
    docs = [{random.randrange(40): random.randint(1, 9) for _ in range(random.randint(0, 25))} for _ in range(200)]
    weights = [random.randint(0, 5000) for _ in range(40)]
    lengths = [max(1, sum(d.values())) for d in docs]
    import numpy as np
    import pyarrow as pa

    def batches():
        for at in range(0, 200, 70):
            some = range(at, min(at + 70, 200))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None if k % 50 == 0 else k for k in some], pa.int64()),
                    pa.array([lengths[k] for k in some], pa.int64()),
                    pa.array([np.array(sorted(docs[k]), "<i4").tobytes() for k in some], pa.binary()),
                    pa.array([np.array([docs[k][t] for t in sorted(docs[k])], "<i8").tobytes() for k in some], pa.binary()),
                ],
                names=["doc_id", "n_terms", "numbers", "counts"],
            )

    results = []
    for terms, cells in ((4096, 1 << 23), (7, 50), (40, 300)):
        old = lexical.GROUP_TERMS, lexical.CELLS
        lexical.GROUP_TERMS, lexical.CELLS = terms, cells
        search = lexical._Search(items, weights, len(docs), sum(lengths))
        got = [list(zip(*(c.to_pylist() for c in b.columns), strict=True)) for b in search.run(batches())]
        lexical.GROUP_TERMS, lexical.CELLS = old
        results.append([r for b in got for r in b])
    want = []
    for k, item in enumerate(items):
        found = []
        for j, doc in enumerate(docs):
            m = 25 + 75 * lengths[j] * len(docs) // sum(lengths)
            score = sum(weights[t] * c * (10**9 * doc[t] // (1000 * doc[t] + 8 * m)) for t, c in item.items() if t in doc)
            if score:
                found.append((-score, j % 50 == 0, j))
        want += [(k, -s, None if missing else j) for s, missing, j in sorted(found)[:10]]
    assert results == [want] * 3


def test_a_text_of_many_pieces(monkeypatch):
    text = ("Alpha beta-gamma 😀ü " * 999).encode()
    whole = [t for piece in lexical.terms(text) for t in piece]
    monkeypatch.setattr(lexical, "PIECE", 17)
    assert [t for piece in lexical.terms(text) for t in piece] == whole == [w.encode() for w in cut(text.decode())]


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "needle " + "hay " * 1_500_000), (2, "needle and thread")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "Needle hay")], "item_id long, text string")
    assert [w[2] for w in compare(spark, docs, items)] == [1, 2]


def test_empty_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    for docs, some in ((no_docs, items), (odd_docs, none), (no_docs, none)):
        found = lexical.rank(docs, some)
        assert found.collect() == [] and found.columns == ["item_id", "rank", "doc_id", "score"]
