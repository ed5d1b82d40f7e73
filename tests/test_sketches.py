"""Merged summaries and counters against exact values, where counts are even, skewed, tied or missing."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from trafficlens.operators import sketches
from trafficlens.operators.tallies import top_values


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for k in range(6000):
        skewed = min(int(rng.paretovariate(0.8)), 5000)
        data.append((f"c{k % 3}", k % 7, f"v{skewed}", f"u{k}", f"t{k % 40}", None if k % 3 == 0 else "only"))
    return spark.createDataFrame(data, "capture_file string, day int, skewed string, single string, tied string, some string").repartition(6)


@pytest.mark.parametrize("counters", [3, 20, 5000])
def test_frequent_values_are_exact(rows, counters, monkeypatch):
    columns = ["skewed", "single", "tied", "some"]
    want = top_values(rows, ["capture_file"], columns, 4)
    got = sketches.frequent_values(rows, ["capture_file"], columns, 4, counters)
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_counters_handed_on_in_parts(rows, monkeypatch):
    monkeypatch.setattr(sketches, "MAX_COUNTERS", 1)
    monkeypatch.setattr(sketches, "SENT", 0)
    want = top_values(rows, ["capture_file"], ["skewed"], 5)
    got = sketches.frequent_values(rows, ["capture_file"], ["skewed"], 5, 30)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_no_rows(rows):
    assert sketches.frequent_values(rows.where("day < 0"), ["capture_file"], ["skewed"]).count() == 0
    empty = rows.where("day < 0").withColumn("x", F.lit(1))
    assert sketches.merged(sketches.summaries(empty, ["capture_file", "day"], ["x"], ["skewed"]), ["capture_file"]).count() == 0


def test_merged_summaries(rows):
    numbers = rows.withColumn("x", F.substring("single", 2, 9).cast("int")).withColumn("gone", F.lit(None).cast("int"))
    parts = sketches.summaries(numbers, ["capture_file", "day"], ["x", "gone"], ["single", "some"])
    whole = sketches.merged(parts, ["capture_file"]).select(
        "n", sketches.quantile("x", 0.5).alias("x"), sketches.quantile("gone", 0.5).alias("gone"), sketches.unique("single").alias("u"), sketches.unique("some").alias("s")
    )
    for r in whole.collect():
        assert r["n"] == 2000 and r["gone"] is None and r["s"] <= 1
        assert abs(r["x"] / 6000 - 0.5) <= sketches.RANK_ERROR + 0.001 and abs(r["u"] - 2000) <= sketches.COUNT_ERROR * 2000
