"""Each stage against a plain version on its own input."""

from __future__ import annotations

import pytest
from test_jaccard import brute_components
from test_packing import check_sequences, library_ids
from test_pii import brute as brute_spans
from test_quality_rules import brute as brute_stats

import corpus_pipeline
from trafficlens.llm import pii
from trafficlens.llm.tables import store


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(store(stage(spark, out[-1], small), name))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_rules(stages):
    """Too few labels here to certify a cutoff: only the base rules reject."""
    stats = {r.doc_id: brute_stats(r.text) for r in stages[0].collect()}
    assert ids(stages[1]) == sorted(i for i, (n, _, _, _, repeated) in stats.items() if n >= 20 and 100 * repeated <= 30 * n)


def test_classifier_keeps_the_good(spark, small, stages):
    kept = set(ids(stages[2]))
    known = [r for r in spark.read.parquet(f"{small}/labels.parquet").collect() if r.doc_id in set(ids(stages[1]))]
    assert all(r.doc_id in kept for r in known if r.quality == 1)
    assert not any(r.doc_id in kept for r in known if r.quality == 0)


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    assert ids(stages[3]) == sorted({c for _, _, c in brute_components(rows)})


def test_personal_data_is_gone(stages):
    before = {r.doc_id: r for r in stages[3].collect()}
    for r in stages[4].collect():
        old = before[r.doc_id]
        spans = sorted(brute_spans(old.text), key=lambda x: (x[1], pii.KINDS.index(x[0])))
        assert r.text == pii.redact_text(old.text, spans)
        assert (r.n_chars, r.lang, r.source) == (len(r.text), old.lang, old.source)


def test_packing(stages):
    docs, rows = stages[4].collect(), stages[5].collect()
    lengths = {r.doc_id: len(x) + 1 for r, x in zip(docs, library_ids([r.text for r in docs]))}
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == lengths
    check_sequences(rows)


def test_repeated_rows_and_missing_ids(spark, odd_docs, labels, no_docs):
    kept = corpus_pipeline.drop_near_copies(spark, odd_docs, "").collect()
    left = [r.doc_id for r in kept]
    assert left.count(5) == 1 and 6 not in left and left.count(None) == 2 and {1, 2, 3, 4, 7, 8, 9, 40} <= set(left)
    assert kept[0].asDict().keys() == set(odd_docs.columns)
    assert corpus_pipeline.drop_near_copies(spark, no_docs, "").count() == 0


def test_rows_are_linked_not_ids(spark):
    """Two texts under one id, a copy under the smaller id, copies without an id."""
    a, b, c = (" ".join(f"{p}{i}" for i in range(30)) for p in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b), (None, c), (None, c), (None, a), (9, "words"), (9, "others"), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    want = [(1, a), (2, b), (None, c), (9, "words"), (9, "others"), (None, None), (None, None)]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want))


def test_run(spark, small, stages):
    assert corpus_pipeline.run(spark, small).count() == stages[5].count()


def test_stored_rows_hold_each_text_once(spark, monkeypatch):
    import random

    rng = random.Random(1)
    rows = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(200))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    stored, plain = {}, corpus_pipeline.store
    monkeypatch.setattr(corpus_pipeline, "store", lambda df, name: stored.setdefault(name, plain(df, name)))
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    strings = [f for f in stored["numbered"].select("*", "row.*").schema.fields if f.dataType.simpleString() == "string"]
    assert [f.name for f in strings] == ["text"] and kept.count() == 200
    assert "SortMergeJoin" in kept._jdf.queryExecution().toString()
