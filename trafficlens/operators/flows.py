"""Flow table and flow statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.operators.counted import MICROS, aggregates, four_stats
from trafficlens.operators.tallies import flow_key


def flow_table(packets: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per directional flow: packets, bytes, duration and rates.

    ``packets`` needs ``ts_us`` (time in microseconds) for durations. Rates are NULL for
    flows of one packet or of zero duration.
    """
    key = flow_key(packets.columns)
    n, size = F.col("n"), F.col("bytes")
    seconds = (F.col("t1") - F.col("t0")) / MICROS
    moving = (n > 1) & (F.col("t1") > F.col("t0"))
    return (
        packets.dropna(subset=key)
        .groupBy(*by, *key)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum(F.col("packet_length").cast("bigint")), F.lit(0)).alias("bytes"),
            F.min("ts_us").alias("t0"),
            F.max("ts_us").alias("t1"),
        )
        .select(
            *by,
            *key,
            "n",
            "bytes",
            seconds.alias("duration"),
            F.when(moving, n / seconds).alias("pps"),
            F.when(moving, size / seconds).alias("bps"),
            F.when(moving, seconds).alias("active_seconds"),
        )
    )


def flow_count(flows: DataFrame, by: Sequence[str]) -> DataFrame:
    return flows.groupBy(*by).agg(F.count(F.lit(1)).alias("flow_count"))


def _stats(flows: DataFrame, by: Sequence[str], name: str, column: str) -> DataFrame:
    return flows.groupBy(*by).agg(*aggregates(four_stats(name, column)))


def packets_per_flow(flows: DataFrame, by: Sequence[str]) -> DataFrame:
    return _stats(flows, by, "packets_per_flow", "n")


def flow_duration(flows: DataFrame, by: Sequence[str]) -> DataFrame:
    return _stats(flows, by, "flow_duration", "active_seconds")


def flow_pps(flows: DataFrame, by: Sequence[str]) -> DataFrame:
    return _stats(flows, by, "packets_per_second", "pps")


def bytes_per_flow(flows: DataFrame, by: Sequence[str]) -> DataFrame:
    return _stats(flows, by, "bytes_per_flow", "bytes")


def flow_bps(flows: DataFrame, by: Sequence[str]) -> DataFrame:
    return _stats(flows, by, "bytes_per_second", "bps")
