"""Tumbling windows of N packets in file order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.settings import DEFAULT_LIVE_WINDOW


def with_window_id(packets: DataFrame, window_size: int = DEFAULT_LIVE_WINDOW) -> DataFrame:
    """Add ``window_id``; it follows from the packet's own number, so nothing is shuffled."""
    if window_size < 1:
        raise ValueError("window_size must be positive")
    return packets.withColumn("window_id", F.floor(F.col("packet_no") / window_size).cast("bigint"))


def live_windows(
    packets: DataFrame, window_size: int = DEFAULT_LIVE_WINDOW, by: Sequence[str] = ("capture_file",)
) -> DataFrame:
    """``window_start``, ``window_end`` (exclusive) and ``packet_count`` of every window."""
    start = F.col("window_id") * window_size
    return (
        with_window_id(packets, window_size)
        .groupBy(*by, "window_id")
        .agg(F.count(F.lit(1)).alias("packet_count"))
        .select(
            *by,
            "window_id",
            start.alias("window_start"),
            (start + F.col("packet_count")).alias("window_end"),
            "packet_count",
        )
    )
