"""The full feature row: one row per capture, or per capture and window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.expressions import micros
from trafficlens.operators.counted import ENTROPY_COLUMNS, counted, counted_plan
from trafficlens.operators.lengths import length_features
from trafficlens.operators.statistical import as_ratios, count_maps, known_counts, map_columns
from trafficlens.operators.timing import time_features
from trafficlens.schema import ENTITY, FIXED_FEATURES, MAP_FEATURES
from trafficlens.settings import MIN_PACKETS, FeatureSettings

# What a group has that gives the tallies no value at all: no flow, and entropy 0.
EMPTY_VALUES = {"flow_count": 0} | {f"entropy_{c}": 0.0 for c in ENTROPY_COLUMNS}

STATUS_OK = "ok"
STATUS_FEW = "too_few_packets"


def with_ts_us(packets: DataFrame) -> DataFrame:
    """Add ``ts_us`` where only a timestamp is given."""
    if "ts_us" in packets.columns or "timestamp" not in packets.columns:
        return packets
    return packets.withColumn("ts_us", micros(F.col("timestamp")))


def enough_packets(features: DataFrame, minimum: int = MIN_PACKETS) -> DataFrame:
    """Groups that are large enough to be scored."""
    return features.where(F.col("total_packets") >= minimum)


def extract_features(
    packets: DataFrame,
    by: Sequence[str] = ENTITY,
    settings: FeatureSettings | None = None,
    tie: Sequence[str] = ("packet_no",),
    strategy: str = "range",
    minimum: int = MIN_PACKETS,
) -> DataFrame:
    """One feature row per group, for all groups at once.

    Parts (each reads only the columns it needs, and each ends in one row per group):
    length frequencies, tallies of values/flows/pairs, time windows, ratio maps. The
    parts are hash-partitioned on ``by`` when they are joined. Features of absent
    columns are left out; ``label`` is carried along when the packets have one. Groups
    below ``minimum`` packets stay, with status ``too_few_packets`` and no features.
    """
    settings = settings or FeatureSettings()
    packets = with_ts_us(packets)
    columns = packets.columns
    statistical = "statistical" in settings.groups and settings.use_statistics
    keep = ["label"] if "label" in columns and "label" not in by else []

    mapped = map_columns(columns, statistical)
    parts = [length_features(packets, by, binned_entropy=statistical, keep=keep, counts=known_counts(mapped))]
    kinds, exprs = counted_plan(columns, True, "flow" in settings.groups, statistical, settings.use_entropy)
    if kinds:
        parts.append(counted(packets, by, kinds, exprs))
    if "time" in settings.groups and "ts_us" in columns:
        order = [c for c in tie if c in columns]
        parts.append(time_features(packets, by, settings.window_size, order, strategy))
    if mapped:
        parts.append(count_maps(packets, by, mapped))

    row = parts[0]
    for part in parts[1:]:
        row = row.join(part, list(by), "left")
    row = as_ratios(row, mapped)
    row = row.fillna({c: v for c, v in EMPTY_VALUES.items() if c in row.columns})
    large = F.col("total_packets") >= minimum
    features = [c for c in (*FIXED_FEATURES, *MAP_FEATURES) if c in row.columns and c != "total_packets"]
    return row.select(
        *by,
        *keep,
        F.when(large, F.lit(STATUS_OK)).otherwise(F.lit(STATUS_FEW)).alias("status"),
        "total_packets",
        *[F.when(large, F.col(c)).alias(c) for c in features],
    )


def window_features(
    packets: DataFrame, window_size: int, settings: FeatureSettings | None = None, tie: Sequence[str] = ("packet_no",)
) -> DataFrame:
    """Feature rows of the tumbling windows of each capture.

    A window holds at most ``window_size`` packets, so the ordered part always fits a task.
    """
    from trafficlens.operators.livewindows import with_window_id
    from trafficlens.schema import WINDOW_ENTITY

    return extract_features(with_window_id(packets, window_size), WINDOW_ENTITY, settings, tie, strategy="window")
