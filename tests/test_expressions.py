from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trafficlens.functions import expressions as X


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, bits",
    [("SA", 18), ("0x0012", 18), ("18", 18), ("18.0", 18), ("S", 2), ("", None), (None, None), ("FPU", 9), ("0x0", 0)],
)
def test_flag_bits(spark, text, bits):
    assert one(spark, X.flag_bits(F.lit(text).cast("string"))) == bits


@pytest.mark.parametrize(
    "text, want",
    [
        ("1704067200.5", dt.datetime(2024, 1, 1, 0, 0, 0, 500000)),
        ("2024-01-01 00:00:01", dt.datetime(2024, 1, 1, 0, 0, 1)),
        ("soon", None),
        (None, None),
    ],
)
def test_to_timestamp(spark, text, want):
    got = one(spark, F.date_format(X.to_timestamp(F.lit(text).cast("string")), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    assert got == (want and want.strftime("%Y-%m-%d %H:%M:%S.%f"))


def test_equal_width_bins(spark):
    values = [0.0, 1.0, 1.0001, 5.0, 9.0, 10.0]
    got = [one(spark, X.equal_width_bin(f"{v}D", "0D", "10D")) for v in values]
    assert got == [1, 1, 2, 5, 9, 10]
    assert one(spark, X.equal_width_bin("3D", "3D", "3D")) == 1


def test_equal_width_bins_of_integers_do_not_overflow(spark):
    values = [-(2**31) + 1, 0, 2**30, 2**31 - 1]
    assert [one(spark, X.equal_width_bin(f"({v})", f"({values[0]})", f"{values[-1]}")) for v in values] == [1, 5, 8, 10]


def test_histogram_bins(spark):
    import numpy as np

    values = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    counts, _ = np.histogram(values, 10)
    got = [one(spark, X.histogram_bin(F.lit(v), F.lit(0.0), F.lit(1.0))) for v in values]
    assert [got.count(b) for b in range(1, 11)] == list(counts)
    assert one(spark, X.histogram_bin(F.lit(3.0), F.lit(3.0), F.lit(3.0))) == 6


def test_names(spark):
    assert one(spark, X.base_name(F.lit("/a.b/c.tar.gz"))) == "c.tar"
    assert one(spark, X.base_name(F.lit("plain"))) == "plain"
    assert one(spark, X.extension(F.lit("X.PcapNG"))) == "pcapng"
    assert one(spark, X.label_from_name(F.lit("/d/Benign-Monday.parquet"))) == "normal"
    assert one(spark, X.label_from_name(F.lit("DDoS-x.parquet"))) == "ddos"
    assert one(spark, X.label_from_name(F.lit("other.parquet"))) is None


def test_verdict_and_ratio(spark):
    assert [one(spark, X.verdict_text(F.lit(v).cast("string"))) for v in ("1", "ddos", "0", "normal", None)] == [
        "ddos", "ddos", "normal", "normal", None,
    ]
    assert one(spark, X.ratio(F.lit(1), F.lit(4), 100.0)) == 25.0
    assert one(spark, X.ratio(F.lit(1), F.lit(0))) == 0.0


def test_pair_key(spark):
    assert one(spark, X.pair_key(F.lit("b"), F.lit("a"))) == "a|b"
    assert one(spark, X.pair_key(F.lit("b"), F.lit(None).cast("string"))) is None
