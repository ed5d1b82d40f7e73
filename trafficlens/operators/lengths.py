"""Packet counts and packet length statistics from one frequency table of lengths.

Packets are first counted per (group, length) with map-side combining. A length is at
most a 16-bit IP length plus link headers, so what reaches the second, per-group step is
bounded by the number of possible lengths and not by the number of packets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.expressions import entropy_from_sums, equal_width_bin
from trafficlens.operators.counted import aggregates

PERCENTILES = (25, 75, 90, 95)
LENGTH_BINS = 10


def length_freq(
    packets: DataFrame, by: Sequence[str], keep: Sequence[str] = (), counts: Mapping[str, str] | None = None
) -> DataFrame:
    """(``by``, ``keep``, packet_length, n) including a row for missing lengths.

    Kept columns are grouped on: a text minimum could not be updated in a hash aggregate,
    and Spark would sort all packets before combining them.
    """
    return packets.groupBy(*by, *keep, "packet_length").agg(
        F.count(F.lit(1)).alias("n"), *aggregates(counts or {})
    )


def length_features(
    packets: DataFrame,
    by: Sequence[str],
    basic: bool = True,
    binned_entropy: bool = True,
    keep: Sequence[str] = (),
    counts: Mapping[str, str] | None = None,
) -> DataFrame:
    """``total_packets``, moments, exact percentiles and the entropy of ten equal bins.

    ``keep`` are columns that are constant in a group; ``counts`` are further packet
    counts (named SQL aggregates) that ride along.
    """
    counts = counts or {}
    if "packet_length" not in packets.columns:
        counted = packets.groupBy(*by, *keep).agg(F.count(F.lit(1)).alias("total_packets"), *aggregates(counts))
        sums = {c: f"sum({c})" for c in ("total_packets", *counts)} | {c: f"min({c})" for c in keep}
        return counted.groupBy(*by).agg(*aggregates(sums))
    over = f"over (partition by {', '.join(f'`{c}`' for c in by)})"
    freq = length_freq(packets, by, keep, counts).select(
        *by,
        *keep,
        *counts,
        "packet_length",
        "n",
        F.expr(f"min(packet_length) {over} as _low"),
        F.expr(f"max(packet_length) {over} as _high"),
        F.expr(f"sum(packet_length * n) {over} / sum(if(packet_length is null, null, n)) {over} as _mean"),
    )
    wanted = {"total_packets": "sum(n)"} | {c: f"min({c})" for c in keep} | {c: f"sum({c})" for c in counts}
    columns = [*by, *keep, *counts, "total_packets"]
    if basic:
        cuts = ", ".join(f"{p / 100}D" for p in (50, *PERCENTILES))
        known = "sum(n) filter (where packet_length is not null)"
        wanted |= {
            "packet_length_mean": "min(_mean)",
            "packet_length_std": f"if({known} > 1, sqrt(sum(n * pow(packet_length - _mean, 2)) / ({known} - 1)), null)",
            "packet_length_min": "min(_low)",
            "packet_length_max": "min(_high)",
            "_cuts": f"percentile(packet_length, array({cuts}), n)",
        }
        columns += [f"packet_length_{s}" for s in ("mean", "std", "min", "max")]
        columns += [F.expr("_cuts[0] as packet_length_median")]
        columns += [F.expr(f"_cuts[{i}] as packet_length_percentile_{p}") for i, p in enumerate(PERCENTILES, 1)]
    if binned_entropy:
        freq = freq.withColumn("_bin", equal_width_bin("packet_length", "_low", "_high", LENGTH_BINS))
        bins = range(1, LENGTH_BINS + 1)
        wanted |= {f"_bin{b}": f"coalesce(sum(n) filter (where _bin = {b}), 0)" for b in bins}
        total = "(" + " + ".join(f"_bin{b}" for b in bins) + ")"
        n_log_n = "(" + " + ".join(f"if(_bin{b} > 0, _bin{b} * log2(_bin{b}), 0D)" for b in bins) + ")"
        columns.append(entropy_from_sums(total, n_log_n).alias("entropy_packet_length"))
    return freq.groupBy(*by).agg(*aggregates(wanted)).select(*columns)


def basic_counts(packets: DataFrame, by: Sequence[str]) -> DataFrame:
    return packets.groupBy(*by).agg(F.count(F.lit(1)).alias("total_packets"))


def length_stats(packets: DataFrame, by: Sequence[str]) -> DataFrame:
    stats = ("mean", "std", "min", "max", "median")
    return length_features(packets, by, binned_entropy=False).select(*by, *[f"packet_length_{s}" for s in stats])


def length_percentiles(packets: DataFrame, by: Sequence[str]) -> DataFrame:
    return length_features(packets, by, binned_entropy=False).select(
        *by, *[f"packet_length_percentile_{p}" for p in PERCENTILES]
    )


def entropy_length_bins(packets: DataFrame, by: Sequence[str]) -> DataFrame:
    return length_features(packets, by, basic=False).select(*by, "entropy_packet_length")


def bin_counts(packets: DataFrame, by: Sequence[str], column: str, bins: int = LENGTH_BINS) -> DataFrame:
    """Rows in each of ``bins`` equal-width bins of a column (right-closed, minimum in bin 1).

    Rows are first counted by value, with map-side combining, and only different values meet the range of their group, which comes from
    its own small aggregate. So no group is gathered in one place, whatever the number of its values.
    """
    x = F.col(column)
    values = packets.where(x.isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    bounds = values.groupBy(*by).agg(F.min(x).alias("_low"), F.max(x).alias("_high"))
    return (
        values.join(bounds, list(by))
        .withColumn("bin", equal_width_bin(column, "_low", "_high", bins))
        .groupBy(*by, "bin")
        .agg(F.sum("_n").alias("n"))
    )
