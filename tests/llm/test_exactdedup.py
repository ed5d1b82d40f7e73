"""Exact duplicates against a plain version, over loads and after a broken load."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trafficlens.llm import exactdedup
from trafficlens.llm.exactdedup import DigestIndex, digest_rows, new_documents, report


def norm(text):
    return (text or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})


def brute(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, k, i))
    out = []
    for key, members in groups.items():
        digest = hashlib.sha256(key.encode()).hexdigest()
        members.sort()
        out += [(m[4], members[0][4], len(members), m is members[0], digest) for m in members]
    return sorted(out, key=repr)


def run(docs, tmp_path, loads=1):
    index = DigestIndex.create(docs.sparkSession, str(tmp_path / "index"), 4)
    rows = digest_rows(docs, F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)), F.lit(loads)))
    for load in range(loads):
        index.add(rows.where(F.col("load") == load), load)
    return index, rows


@pytest.mark.parametrize("loads", [1, 2, 3])
def test_equals_plain_version(spark, odd_docs, tmp_path, loads):
    more = [(50 + k, "the same  text " + " " * (k % 4), None, None, *["clash"] * 8) for k in range(300)]
    more += [(11, "the sametext   ", None, None, *["clash"] * 8), (10, "thesame text   ", None, None, *["clash"] * 8)]
    docs = odd_docs.unionByName(spark.createDataFrame(more, odd_docs.schema))
    index, rows = run(docs, tmp_path, loads)
    got = sorted((tuple(r) for r in report(rows, index).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_all_common_or_all_rare(spark, odd_docs, tmp_path, monkeypatch):
    index, rows = run(odd_docs, tmp_path)
    want = sorted(map(tuple, report(rows, index).collect()), key=repr)
    for share in (1, 1 << 30):
        monkeypatch.setattr(exactdedup, "HOT_SHARE", share)
        assert sorted(map(tuple, report(rows, index).collect()), key=repr) == want


def test_empty(spark, no_docs, tmp_path):
    index, rows = run(no_docs, tmp_path)
    assert report(rows, index).collect() == [] and new_documents(no_docs, index, 1).collect() == []


def test_later_loads_bring_only_new_texts(spark, tmp_path):
    schema = "doc_id long, text string, row string, best string"
    first = spark.createDataFrame([(1, "a b", "x", "y"), (2, "ab", "x", "y"), (3, None, "x", "y")], schema)
    second = spark.createDataFrame([(4, "a  b", "x", "y"), (5, "c", "x", "y"), (6, "", "x", "y"), (7, "c ", "p", "q")], schema)
    index = DigestIndex.create(spark, str(tmp_path / "index"), 4)
    assert sorted(r.doc_id for r in new_documents(first, index, 0).collect()) == [1, 3]
    again = DigestIndex.open(spark, str(tmp_path / "index"))
    assert again.buckets == 4
    assert [tuple(r) for r in new_documents(second, again, 1).collect()] == [(7, "c ", "p", "q")]
    state = {(r.best.doc_id, r.n_rows) for r in again.entries().collect()}
    assert state == {(4, 3), (3, 2), (7, 2)}


def test_a_load_added_again_changes_nothing(spark, odd_docs, tmp_path):
    index, rows = run(odd_docs, tmp_path, 2)
    before = sorted(map(repr, index.entries().collect()))
    for load in (0, 1):
        index.add(rows.where(F.col("load") == load), load)
    assert sorted(map(repr, index.entries().collect())) == before


def test_index_is_read_without_a_shuffle(spark, odd_docs, tmp_path):
    index, rows = run(odd_docs, tmp_path, 2)
    plan = index.entries()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    found = exactdedup.groups(rows)
    anti = found.join(spark.table(index.firsts).select("digest").hint("merge"), "digest", "left_anti")
    plan = anti._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and plan.count("Exchange") == 1
