from __future__ import annotations

import numpy as np
import pytest
import xxhash

from trafficlens.llm import sharding


def test_shares_differ_by_one_slot_and_few_slots_move():
    names = [f"s{i}" for i in range(20)]
    table = sharding.fill(names, 10_007)
    counts = np.bincount(table)
    assert counts.min() >= 10_007 // 20 and counts.max() <= 10_007 // 20 + 1
    kept = sorted(names)[:-1]
    after = sharding.fill(kept, 10_007)
    stayed = table < len(kept)
    assert (table[stayed] != after[stayed]).mean() < 0.1
    assert (sharding.fill(names[::-1] + names, 10_007) == table).all()


def test_every_slot_was_the_first_free_one():
    names = ["a", "b", "c"]
    owner, at, step = {}, [], []
    for n in names:
        at.append(xxhash.xxh64_intdigest(n, seed=1) % 101)
        step.append(xxhash.xxh64_intdigest(n, seed=2) % 100 + 1)
    order = [[(a + j * s) % 101 for j in range(101)] for a, s in zip(at, step)]
    for turn in range(101):
        k = turn % 3
        owner[next(x for x in order[k] if x not in owner)] = k
    assert sharding.fill(names, 101).tolist() == [owner[i] for i in range(101)]


def test_bad_tables():
    for names, slots in (([], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.fill(names, slots)


def test_placement(spark, odd_docs, no_docs, small):
    docs = odd_docs.withColumnRenamed("row", "shard")
    rows = sharding.place(docs, "doc_id", ["x", "y", "z"], 101).collect()
    table, names = sharding.fill(["x", "y", "z"], 101), ["x", "y", "z"]
    assert len(rows) == docs.count()
    for r in rows:
        key = "" if r.doc_id is None else str(r.doc_id)
        h = xxhash.xxh64_intdigest(key.encode(), seed=42)
        slot = (h - (1 << 64) if h >> 63 else h) % 101
        assert (r.slot, r.shard) == (slot, names[table[slot]])
    assert sharding.place(no_docs, "doc_id").count() == 0
    placed = sharding.place(spark.read.parquet(f"{small}/documents.parquet"), "doc_id")
    assert placed.count() == 200 and placed.columns[-2:] == ["slot", "shard"]
