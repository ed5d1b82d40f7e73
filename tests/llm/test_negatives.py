"""Hard negatives against a plain version, and exact scores at every size."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trafficlens.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, row_no string"


def brute(rows):
    kept = []
    for k, (i, x, label, _) in enumerate(rows):
        if label is not None and x and all(v is not None and math.isfinite(v) for v in x):
            kept.append((k, i, [math.floor(256 * v) for v in x], label))
    out = []
    order = lambda p: (-p[0], p[1] is None, p[1] or 0)
    for k, i, x, label in kept:
        if i is None or i % 50:
            continue
        partners = [(sum(a * b for a, b in zip(x, y)), j, other) for n, j, y, other in kept if n != k]
        for score, positive, _ in sorted((p for p in partners if p[2] == label), key=order)[:5]:
            fits = [p for p in partners if p[2] != label and 50 * score <= 100 * p[0] <= 95 * score]
            out += [(i, positive, r + 1, p[1], score, p[0]) for r, p in enumerate(sorted(fits, key=order)[:3])]
    return sorted(out, key=repr)


def compare(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 50 == 0).collect()), key=repr)
    assert got == brute(rows)
    return got


def crowd(n, dim, seed, copies=0):
    random.seed(seed)
    centre = [random.gauss(0, 1) for _ in range(dim)]
    rows = [(k, [c + random.gauss(0, 0.8) for c in centre], random.randrange(4), "x") for k in range(n)]
    return rows + [(n + k, rows[1][1], k % 3, "x") for k in range(copies)]


def test_equals_plain_version(spark):
    assert compare(spark, crowd(400, 20, 1))


def test_copies_and_repeated_rows(spark):
    rows = crowd(120, 8, 2, copies=150)
    assert compare(spark, rows + rows[:60])


def test_odd_rows(spark):
    rows = crowd(150, 5, 3)
    rows += [(200, None, 1, "x"), (250, [], 1, "x"), (300, [None, 1.0], 1, "x"), (350, [math.nan], 1, "x"), (400, [math.inf], 2, "x")]
    rows += [(450, [1.0, 2.0], 1, "x"), (451, rows[7][1] + [0.5] * 4, 1, "x"), (500, rows[9][1], None, "x"), (None, rows[0][1], 2, "x")]
    rows += [(None, rows[0][1], rows[0][2], "x"), (-50, rows[3][1], 3, "x"), (550, [0.0] * 5, 1, "x")]
    assert compare(spark, rows)


def test_empty_and_without_anchors(spark):
    for rows in ([], crowd(30, 3, 4)[1:]):
        df = spark.createDataFrame(rows, SCHEMA)
        found = negatives.mine(df, F.col("vec_id") % 50 == 0)
        assert found.collect() == [] and len(found.columns) == 6


def test_blocks_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_COMPONENTS", 30)
    assert compare(spark, crowd(330, 6, 5))


def test_large_components(spark):
    rows = [(i, [v * 40_000 for v in x], label, e) for i, x, label, e in crowd(200, 6, 6)]
    assert compare(spark, rows)
    with pytest.raises(ValueError):
        negatives.mine(spark.createDataFrame([(0, [1e12, 1e12], 1, "x"), (1, [1e12, 1e12], 1, "x")], SCHEMA), F.col("vec_id") == 0)


@pytest.mark.parametrize("bits", [2, 10, 20, 27])
@pytest.mark.parametrize("dim", [1, 64, 700])
def test_scores_are_exact(bits, dim):
    rng = np.random.default_rng(bits * dim)
    top = 1 << min(bits, 27 - dim.bit_length() // 2)
    left, right = rng.integers(-top, top + 1, (7, dim)), rng.integers(-top, top + 1, (9, dim))
    left[0], right[0], right[1] = top, top, -top
    bound = max(int((m.astype(object) ** 2).sum(axis=1).max()) for m in (left, right))
    moduli = negatives.primes(bound)
    got = negatives.scores(negatives.residues(left, moduli), negatives.residues(right, moduli), moduli)
    assert (got == left.astype(object) @ right.T.astype(object)).all()


def test_products_stay_exact_in_float32():
    for p in negatives.primes(1 << 60):
        width = negatives.EXACT // (p // 2) ** 2
        assert width >= 1 and width * (p // 2) ** 2 <= 1 << 24
