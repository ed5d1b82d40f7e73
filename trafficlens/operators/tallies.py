"""Value frequencies: the one table behind most counts, ratios and entropies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.functions.expressions import entropy_from_sums

FLOW_KEY = ("ip_src", "ip_dst", "src_port", "dst_port", "protocol")
VALUE_KINDS = ("protocol", "src_port", "dst_port", "ip_src", "ip_dst", "ttl", "tcp_flags")


def flow_key(columns: Sequence[str]) -> list[str]:
    """Members of the flow key among ``columns``; empty without both addresses."""
    if "ip_src" not in columns or "ip_dst" not in columns:
        return []
    return [c for c in FLOW_KEY if c in columns]


def value_freq(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(``by``, col, val, n): how often each non-null value occurs, all columns in one shuffle."""
    texts = df.select(*by, *[F.col(c).cast("string").alias(c) for c in columns])
    return (
        texts.unpivot(list(by), list(columns), "col", "val")
        .where(F.col("val").isNotNull())
        .groupBy(*by, "col", "val")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def entropy_by_column(freq: DataFrame, by: Sequence[str]) -> DataFrame:
    """Shannon entropy in bits of each column of a ``value_freq`` table."""
    return freq.groupBy(*by, "col").agg(entropy_from_sums("sum(n)", "sum(n * log2(n))").alias("entropy"))


def value_totals(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(``by``, col, total): rows with a value. One plain aggregate, unfolded only at the end."""
    counts = df.groupBy(*by).agg(*[F.count(c).alias(c) for c in columns])
    return counts.unpivot(list(by), list(columns), "col", "total")


def value_ratios(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Each value with its count and its share within (``by``, col).

    The totals are joined back, so no column with many distinct values has to fit into
    one window group.
    """
    joined = value_freq(df, by, columns).join(value_totals(df, by, columns), [*by, "col"])
    return joined.select(*by, "col", "val", "n", (F.col("n") / F.col("total")).alias("ratio"))


def top_values(df: DataFrame, by: Sequence[str], columns: Sequence[str], k: int = 5) -> DataFrame:
    """The ``k`` most frequent values of each column with their share; ties go to the lower value.

    The rank filter is applied before the exchange too, so at most ``k`` rows of each
    group and map task are shuffled for the ranking.
    """
    best = Window.partitionBy(*by, "col").orderBy(F.desc("n"), F.asc("val"))
    ranked = (
        value_freq(df, by, columns).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    )
    return ranked.join(value_totals(df, by, columns), [*by, "col"]).select(
        *by, "col", "val", "n", "rank", (F.col("n") / F.col("total")).alias("ratio")
    )


def tallies(df: DataFrame, by: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """Counts for several kinds of key at once: (``by``, kind, val, n, bytes, t0, t1, forward).

    Kinds are column names, ``pair`` (undirected address pair) and ``flow`` (the full
    directional key; packets with a missing member belong to no flow). Packets are first
    collapsed to one row per combination of the columns involved, with map-side
    combining; only the collapsed rows are fanned out to the kinds.
    """
    columns = df.columns
    flow = flow_key(columns) if "flow" in kinds else []
    pair = ["ip_src", "ip_dst"] if "pair" in kinds and flow_key(columns) else []
    values = [k for k in kinds if k in columns]
    needed = list(dict.fromkeys([*values, *pair, *flow]))

    measures = [F.count(F.lit(1)).alias("n")]
    has_length = bool(flow) and "packet_length" in columns
    has_time = bool(flow) and "ts_us" in columns
    if has_length:
        measures.append(F.sum(F.col("packet_length").cast("bigint")).alias("bytes"))
    if has_time:
        measures += [F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1")]
    collapsed = df.groupBy(*by, *needed).agg(*measures)
    if list(kinds) == values and len(values) == 1:
        # One plain column is already counted per value.
        parts = [f"'{values[0]}' as kind", f"cast({values[0]} as string) as val", "n"]
        blanks = [f"cast(null as bigint) as {c}" for c in ("bytes", "t0", "t1", "forward")]
        return collapsed.dropna(subset=values).select(*by, *[F.expr(x) for x in (*parts, *blanks)])

    def entry(kind: str, val: str, size: str = "null", t0: str = "null", t1: str = "null", forward: str = "null") -> str:
        numbers = (("bytes", size), ("t0", t0), ("t1", t1), ("forward", forward))
        fields = ", ".join(f"cast({x} as bigint) as {name}" for name, x in numbers)
        return f"struct('{kind}' as kind, {val} as val, {fields})"

    entries = [entry(k, f"cast({k} as string)") for k in values]
    if pair:
        key = "if(ip_src is null or ip_dst is null, null, least(ip_src, ip_dst) || '|' || greatest(ip_src, ip_dst))"
        entries.append(entry("pair", key, forward="if(ip_src < ip_dst, n, 0)"))
    if flow:
        times = ("t0", "t1") if has_time else ("null", "null")
        entries.append(entry("flow", " || '|' || ".join(flow), "bytes" if has_length else "null", *times))

    return (
        collapsed.select(*by, "n", F.expr(f"inline(array({', '.join(entries)}))"))
        .where(F.col("val").isNotNull())
        .groupBy(*by, "kind", "val")
        .agg(
            F.sum("n").alias("n"),
            F.sum("bytes").alias("bytes"),
            F.min("t0").alias("t0"),
            F.max("t1").alias("t1"),
            F.sum("forward").alias("forward"),
        )
    )
