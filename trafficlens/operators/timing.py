"""Time features: span, rates, inter-arrival times and fixed-count windows.

Packets are put in time order per group, those without a time last. Positions come from the range route of ``ordering``
and the work is cut into chunks of consecutive positions, so that a single capture is
spread over many tasks. Groups known to be small may be sorted one by one (``strategy="window"``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.operators.counted import aggregates
from trafficlens.operators.ordering import in_order, with_position

MICROS = 1e6
WINDOWS_PER_CHUNK = 10_000


def _has_length(packets: DataFrame) -> bool:
    return "packet_length" in packets.columns


def time_windows(
    packets: DataFrame,
    by: Sequence[str],
    window_size: int = 100,
    tie: Sequence[str] = ("packet_no",),
    strategy: str = "range",
    windows_per_chunk: int = WINDOWS_PER_CHUNK,
) -> DataFrame:
    """Consecutive windows of ``window_size`` packets in time order, one row each.

    Columns: ``window_no``, ``n``, ``t0``, ``t1``, ``bytes`` and the gaps to the packet
    before (``gaps``, ``gap_sum``, ``gap_m2``, ``gap_max``, ``gap_min``, microseconds).
    """
    known_length = _has_length(packets)
    order = ["ts_us", *tie]
    narrow = packets.select(*by, *order, *(["packet_length"] if known_length else []))
    if strategy == "window":
        group = list(by)
        by_time = Window.partitionBy(*by).orderBy(*in_order(order))
        steps = narrow.withColumn("_pos", F.row_number().over(by_time) - 1).withColumn(
            "_gap", F.col("ts_us") - F.lag("ts_us").over(by_time)
        )
    else:
        group = [*by, "_chunk"]
        chunk_rows = window_size * windows_per_chunk
        chunk = F.floor(F.col("_pos") / chunk_rows).cast("bigint")
        # The last packet of a chunk is also handed to the next one, to give its first gap.
        carried = F.when(F.pmod(F.col("_pos") + 1, F.lit(chunk_rows)) == 0, F.array(chunk, chunk + 1))
        by_place = Window.partitionBy(*group).orderBy("_pos")
        steps = (
            with_position(narrow, by, order, "_pos", strategy)
            .withColumn("_chunk", F.explode(F.coalesce(carried, F.array(chunk))))
            .withColumn("_gap", F.col("ts_us") - F.lag("ts_us").over(by_place))
            .where(F.col("_chunk") == chunk)
        )
    size = "sum(cast(packet_length as bigint))" if known_length else "cast(null as bigint)"
    measures = {
        "n": "count(*)",
        "t0": "min(ts_us)",
        "t1": "max(ts_us)",
        "bytes": size,
        "gaps": "count(_gap)",
        "gap_sum": "sum(_gap)",
        "gap_m2": "var_pop(_gap) * count(_gap)",
        "gap_max": "max(_gap)",
        "gap_min": "min(_gap)",
    }
    numbered = steps.withColumn("window_no", F.floor(F.col("_pos") / window_size).cast("bigint"))
    return numbered.groupBy(*group, "window_no").agg(*aggregates(measures)).drop("_chunk")


def time_features_from_windows(
    windows: DataFrame, by: Sequence[str], window_size: int = 100, has_length: bool = True
) -> DataFrame:
    """All time features of each group from its window rows."""
    wide = "cast({} as decimal(38, 0))"
    gap_sum, total = wide.format("gap_sum"), wide.format("_gap_sum")
    measures = {
        "_n": "sum(n)",
        "_t0": "min(t0)",
        "_t1": "max(t1)",
        "_bytes": "sum(size)",
        "_gaps": "sum(gaps)",
        "_gap_sum": "sum(gap_sum)",
        "_m2": "sum(gap_m2)",
        # Squared deviations within windows (above) plus those between window means. The second
        # part is a difference of large numbers and is therefore computed in decimals.
        "_between": f"sum(if(gaps > 0, {gap_sum} * {gap_sum} / gaps, null))",
        "_gap_max": "max(gap_max)",
        "_gap_min": "min(gap_min)",
    }
    parts = (("mean", "avg"), ("std", "stddev_pop"), ("max", "max"))
    measures |= {f"_{rate}_{s}": f"{f}({rate})" for rate in ("pps", "bps") for s, f in parts}
    grouped = (
        windows.withColumn("size", F.expr("coalesce(bytes, 0)"))
        # A window of one packet does not count; one without duration has rate 0.
        .withColumn("pps", F.expr("if(n > 1, if(t1 > t0, n / ((t1 - t0) / 1e6D), 0D), null)"))
        .withColumn("bps", F.expr("if(n > 1, if(t1 > t0, size / ((t1 - t0) / 1e6D), 0D), null)"))
        .groupBy(*by)
        .agg(*aggregates(measures))
        .withColumn("_span", F.expr("(_t1 - _t0) / 1e6D"))
        .withColumn("_mean", F.expr("try_divide(_gap_sum, _gaps) / 1e6D"))
        .withColumn(
            "_std",
            F.expr(
                f"if(_gaps > 0, sqrt((_m2 + greatest(0D, cast(_between - {total} * {total} / _gaps as double))) / _gaps)"
                " / 1e6D, null)"
            ),
        )
    )
    moving = {
        "packets_per_second": "_n / _span",
        "bytes_per_second": "_bytes / _span",
        "inter_arrival_time_mean": "_mean",
        "inter_arrival_time_std": "_std",
        "inter_arrival_time_max": "_gap_max / 1e6D",
        "inter_arrival_time_min": "_gap_min / 1e6D",
        "inter_arrival_time_cv": "if(_mean > 0, _std / _mean, 0D)",
    }
    many = {f"window_{name}_per_second_{s}": f"_{rate}_{s}"
            for name, rate in (("packets", "pps"), ("bytes", "bps")) for s, _ in parts}
    exprs = {"time_span": "_span"}
    exprs |= {name: f"if(_t1 > _t0, {sql}, null)" for name, sql in moving.items()}
    exprs |= {name: f"if(_t1 > _t0 and _n > {window_size}, {sql}, null)" for name, sql in many.items()}
    return grouped.select(*by, *aggregates({k: v for k, v in exprs.items() if has_length or "bytes" not in k}))


def time_features(
    packets: DataFrame,
    by: Sequence[str],
    window_size: int = 100,
    tie: Sequence[str] = ("packet_no",),
    strategy: str = "range",
    **limits: int,
) -> DataFrame:
    windows = time_windows(packets, by, window_size, tie, strategy, **limits)
    return time_features_from_windows(windows, by, window_size, _has_length(packets))


def time_span(packets: DataFrame, by: Sequence[str]) -> DataFrame:
    return packets.groupBy(*by).agg(((F.max("ts_us") - F.min("ts_us")) / MICROS).alias("time_span"))


def overall_rates(packets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Packets and bytes per second over the whole span; no ordering is needed."""
    seconds = (F.col("_t1") - F.col("_t0")) / MICROS
    return (
        packets.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.coalesce(F.sum(F.col("packet_length").cast("bigint")), F.lit(0)).alias("_bytes"),
            F.min("ts_us").alias("_t0"),
            F.max("ts_us").alias("_t1"),
        )
        .select(
            *by,
            F.when(seconds > 0, F.col("_n") / seconds).alias("packets_per_second"),
            F.when(seconds > 0, F.col("_bytes") / seconds).alias("bytes_per_second"),
        )
    )
