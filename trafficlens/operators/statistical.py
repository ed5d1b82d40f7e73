"""Ratios named after the values seen, kept as maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.operators.tallies import value_freq

TOP_K = 5
TOP_COLUMNS = ("tcp_flags", "icmp_type", "http_method")


def map_columns(columns: Sequence[str], top: bool = True) -> list[str]:
    """Columns that give a map of value ratios."""
    return [c for c in ("protocol", *(TOP_COLUMNS if top else ())) if c in columns]


def count_maps(packets: DataFrame, by: Sequence[str], columns: Sequence[str], k: int = TOP_K) -> DataFrame:
    """``<column>_counts``: how often each protocol and the ``k`` most frequent other values occur.

    Protocols are not ranked, as all of them stay; the rank bound of the others lets Spark cut each
    group before the exchange of the ranking.
    """
    best = Window.partitionBy(*by, "col").orderBy(F.desc("n"), F.asc("val"))
    frequencies = value_freq(packets, by, columns)
    ranked = frequencies.where(F.col("col") != "protocol").withColumn("rank", F.row_number().over(best))
    kept = ranked.where(F.col("rank") <= k).drop("rank").unionByName(frequencies.where(F.col("col") == "protocol"))
    entries = [
        F.expr(f"map_from_entries(sort_array(collect_list(struct(val, n)) filter (where col = '{c}'))) as {c}_counts")
        for c in columns
    ]
    return kept.groupBy(*by).agg(*entries)


def known_counts(columns: Sequence[str]) -> dict[str, str]:
    """Aggregates that count the packets with a value, the whole of each ratio."""
    return {f"{c}_known": f"count({c})" for c in columns}


def as_ratios(counted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``<column>_ratio`` from ``<column>_counts`` and ``<column>_known``."""
    ratios = [F.expr(f"transform_values({c}_counts, (v, n) -> n / {c}_known) as {c}_ratio") for c in columns]
    return counted.select("*", *ratios).drop(*[f"{c}_counts" for c in columns], *[f"{c}_known" for c in columns])


def ratio_maps(packets: DataFrame, by: Sequence[str], top: bool = True, k: int = TOP_K) -> DataFrame:
    """``protocol_ratio`` and the top-``k`` maps of flags, ICMP types and HTTP methods."""
    columns = map_columns(packets.columns, top)
    totals = packets.groupBy(*by).agg(*[F.expr(f"{sql} as {name}") for name, sql in known_counts(columns).items()])
    return as_ratios(totals.join(count_maps(packets, by, columns, k), list(by)), columns)
