from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from trafficlens.llm import classifier


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = classifier.classify(spark.read.parquet(f"{folder}/documents.parquet"), labels).collect()
    assert len(rows) == 1000
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    good, bad = ([r.score for r in held if truth[r.doc_id] == y] for y in (1, 0))
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert sum(g > b for g in good for b in bad) >= 0.97 * len(good) * len(bad)


def test_rules_compile_to_what_they_say(spark):
    rule = classifier.Rule((("marks", True, 0.5), ("symbols", False, 2.0)))
    model = classifier.Ensemble(-1.0, ((rule, 3.0),), (("digits", 0.0, 1.0, 0.5),))
    rows = [(0.6, 1.0, 0.0, 2.0), (0.6, 3.0, 5.0, -0.5), (0.5, 1.0, 0.0, -1.0), (0.4, 9.0, -2.0, -1.0)]
    df = spark.createDataFrame([(r[:3],) for r in rows], "f struct<marks: double, symbols: double, digits: double>")
    got = [r[0] for r in df.select(F.log(model.score(F.col("f")) / (1 - model.score(F.col("f"))))).collect()]
    assert all(abs(g - w[3]) < 1e-9 for g, w in zip(got, rows))


def test_odd_inputs(odd_docs, no_docs, labels):
    rows = classifier.classify(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert classifier.classify(no_docs, labels).count() == 0
    one_class = classifier.classify(odd_docs, labels.where("quality = 1")).collect()
    assert len({r.score for r in one_class}) == 1 and one_class[0].predicted == 1
    assert {r.score for r in classifier.classify(odd_docs, labels.limit(0)).collect()} == {0.5}
