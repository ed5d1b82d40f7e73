"""Exact consecutive positions within a group, also when one group holds most rows.

``row_number`` over a group sorts that whole group in one task, which cannot work for a group of billions of
rows. So positions come from ranges, whatever the sizes:

1. range-partition on (group, order) and sort inside the partitions. The keys are
   unique, so Spark's sampled bounds cut a hot group into equal parts;
2. store the rows with ``monotonically_increasing_id`` (partition number, row in the
   partition). Storing fixes the bounds: both later reads see the same partitions;
3. count rows per (partition, group): one row for each piece, from which the running
   offset of each piece follows;
4. position = row in the piece + offset of the piece.

A caller that knows its groups to be small (windows of packets, say) may ask for one sort per group instead
(``strategy="window"``). Missing values of the order come last in both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.session import store


def in_order(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order]


def with_position(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    out: str = "position",
    strategy: str = "range",
    parts: int | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in its group, in ``order``, missing values last.

    ``order`` must identify a row within its group, otherwise ties are broken at will.
    ``strategy``: ``range`` (balanced; stores the rows) or ``window`` (one sort per group, for groups known to be
    small). ``parts``: number of ranges, by default that of shuffle partitions.
    """
    if strategy == "window":
        window = Window.partitionBy(*by).orderBy(*in_order(order))
        return df.withColumn(out, (F.row_number().over(window) - 1).cast("bigint"))
    if strategy != "range":
        raise ValueError(f"unknown strategy: {strategy}")
    return _by_range(df, by, order, out, parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _by_range(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str, parts: int) -> DataFrame:
    keys = [*[F.col(c) for c in by], *in_order(order)]
    ordered = (
        df.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    stored = store(ordered, "ordered").withColumn("_piece", F.shiftright("_row", 33))
    ahead = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy(*by, "_piece")
        .agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .select(
            *[F.col(c).alias(f"_by_{c}") for c in by],
            F.col("_piece").alias("_by_piece"),
            (F.col("_first") - F.coalesce(F.sum("_n").over(ahead), F.lit(0))).alias("_base"),
        )
    )
    # One row per piece and group: AQE broadcasts it when its measured size allows,
    # and otherwise joins on (group, piece), where no key exceeds one partition.
    match = F.col("_piece") == F.col("_by_piece")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = stored.join(offsets, match)
    return joined.select(*df.columns, (F.col("_row") - F.col("_base")).alias(out))
