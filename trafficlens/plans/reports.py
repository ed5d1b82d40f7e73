"""Verdict tables and report aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.expressions import histogram_bin, ratio
from trafficlens.settings import DDOS, NORMAL


def distribution(df: DataFrame, column: str = "prediction") -> DataFrame:
    """How often each class or verdict occurs."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def report_summary(results: DataFrame) -> DataFrame:
    """One row: counts and percentages of normal, attack and failed captures."""
    def count(condition):
        return F.count(F.when(condition, F.lit(1)))

    counts = results.agg(
        F.count(F.lit(1)).alias("total_files"),
        count(F.col("prediction") == NORMAL).alias("normal_count"),
        count(F.col("prediction") == DDOS).alias("ddos_count"),
        count(F.col("error").isNotNull()).alias("error_count"),
    )
    total = F.col("total_files")
    return counts.select(
        "*",
        *[ratio(F.col(f"{kind}_count"), total, 100.0).alias(f"{kind}_percentage")
          for kind in (NORMAL, DDOS, "error")],
    )


def window_summary(windows: DataFrame, window_size: int) -> DataFrame:
    """One row per capture: windows, verdict counts and percentages."""
    return (
        windows.groupBy("capture_file")
        .agg(
            F.sum("packet_count").alias("total_packets"),
            F.lit(window_size).alias("window_size"),
            F.count(F.lit(1)).alias("window_count"),
            F.count(F.when(F.col("prediction") == NORMAL, 1)).alias("normal_windows"),
            F.count(F.when(F.col("prediction") == DDOS, 1)).alias("ddos_windows"),
        )
        .select(
            F.col("capture_file").alias("file_name"),
            "total_packets",
            "window_size",
            "window_count",
            "normal_windows",
            "ddos_windows",
            ratio(F.col("normal_windows"), F.col("window_count"), 100.0).alias("normal_percentage"),
            ratio(F.col("ddos_windows"), F.col("window_count"), 100.0).alias("ddos_percentage"),
        )
    )


def _limits(df: DataFrame, column: str):
    x = F.col(column)
    return df.agg(
        F.min(x).cast("double").alias("low"),
        F.max(x).cast("double").alias("high"),
        F.stddev_samp(x).alias("std"),
        F.count(x).alias("n"),
    ).first()


def histogram(df: DataFrame, column: str = "probability", bins: int = 10) -> DataFrame:
    """Equal bins over the observed range, empty bins included."""
    limits = _limits(df, column)
    low, high = limits["low"], limits["high"]
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, count bigint")
    first, last = (low, high) if high > low else (low - 0.5, high + 0.5)
    width = (last - first) / bins
    x = F.col(column)
    index = histogram_bin(x, F.lit(low), F.lit(high), bins)
    counts = [F.count(F.when(index == b, F.lit(1))).alias(f"b{b}") for b in range(1, bins + 1)]
    rows = [
        F.struct(F.lit(b).alias("bin"), F.lit(first + (b - 1) * width).alias("low"),
                 F.lit(first + b * width).alias("high"), F.col(f"b{b}").alias("count"))
        for b in range(1, bins + 1)
    ]
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def density(df: DataFrame, column: str = "probability", points: int = 200) -> DataFrame:
    """Gaussian kernel density on an even grid over the observed range, Scott's bandwidth.

    The grid points are sums in one aggregate: rows are neither paired nor copied.
    """
    schema = "point int, x double, density double"
    limits = _limits(df, column)
    n, std = limits["n"], limits["std"]
    if n < 2 or not std:
        return df.sparkSession.createDataFrame([], schema)
    low, high = limits["low"], limits["high"]
    bandwidth = std * n ** (-1 / 5)
    grid = [low + i * (high - low) / (points - 1) for i in range(points)]
    scale = 1 / (n * bandwidth * (2 * 3.141592653589793) ** 0.5)
    x = F.col(column)
    counted = df.where(x.isNotNull()).groupBy(x.cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    sums = [
        F.expr(f"sum(_n * exp(-0.5D * pow((_x - {g!r}D) / {bandwidth!r}D, 2))) as p{i}") for i, g in enumerate(grid)
    ]
    rows = ", ".join(f"struct({i} as point, {g!r}D as x, p{i} * {scale!r}D as density)" for i, g in enumerate(grid))
    return counted.agg(*sums).selectExpr(f"inline(array({rows}))")
