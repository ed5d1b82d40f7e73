"""Registered queries for the feature operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.catalog.fixture import numbered_packets, packets, table
from trafficlens.catalog.shape import rounded
from trafficlens.functions import expressions as X
from trafficlens.operators import assemble, counted, flows, lengths, livewindows, sketches, statistical, tallies, timing
from trafficlens.schema import FIXED_FEATURES, MAP_FEATURES

E = ["capture_file"]
TIE = ["packet_id"]
Query = Callable[[SparkSession, str], DataFrame]


def on_packets(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(operator(packets(spark, sf_dir)))


def on_flows(operator: Callable[..., DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(operator(flows.flow_table(packets(spark, sf_dir), E), E))


def ts_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three spellings of one time: epoch seconds, text, and text that is no time."""
    p = packets(spark, sf_dir)
    text = (
        F.when(F.col("packet_id") % 3 == 0, (F.col("ts_us") / 1e6).cast("decimal(20,6)").cast("string"))
        .when(F.col("packet_id") % 3 == 1, F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .otherwise(F.concat(F.lit("n/a "), F.col("packet_id").cast("string")))
    )
    return p.select("packet_id", F.unix_micros(X.to_timestamp(text)).alias("ts_us"))


def tcp_flag_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters, hex text and plain numbers give the same bits."""
    flags = F.col("tcp_flags")
    bits = X.flag_bits(flags)
    spelled = (
        F.when(F.col("packet_id") % 3 == 0, F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(bits)), 4, "0")))
        .when(F.col("packet_id") % 3 == 1, bits.cast("string"))
        .otherwise(flags)
    )
    p = packets(spark, sf_dir).select("packet_id", X.flag_bits(spelled).alias("bits"))
    return p.select(
        "packet_id",
        "bits",
        *[F.when(X.has_bit(F.col("bits"), b), 1).when(F.col("bits").isNotNull(), 0).alias(f"is_{f}")
          for f, b in X.TCP_FLAG_BITS.items()],
    )


def base_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("s3://bucket/day.one/"), F.col("capture_file"))
    return packets(spark, sf_dir).select(
        "packet_id", X.base_name(path).alias("base_name"), X.file_name(path).alias("file_name")
    )


def verdict_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = F.when(F.col("packet_id") % 2 == 0, F.col("label")).otherwise(
        F.when(F.col("label") == "ddos", "1").otherwise("0")
    )
    return packets(spark, sf_dir).select("packet_id", X.verdict_text(spelled).alias("verdict"))


def admit_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = (
        F.when(F.col("packet_id") % 4 == 0, F.col("capture_file"))
        .when(F.col("packet_id") % 4 == 1, F.upper(F.col("capture_file")))
        .when(F.col("packet_id") % 4 == 2, F.concat(F.col("capture_file"), F.lit("ng")))
        .otherwise(F.concat(F.col("capture_file"), F.lit(".txt")))
    )
    named = packets(spark, sf_dir).select("packet_id", name.alias("name"))
    return named.where(X.admitted(F.col("name"), ("pcap", "pcapng")))


def label_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    name = F.when(F.col("label") == "ddos", F.concat(F.lit("DDoS-"), F.col("capture_file"))).otherwise(
        F.when(F.col("packet_id") % 5 != 0, F.concat(F.lit("Benign-"), F.col("capture_file"))).otherwise(
            F.col("capture_file")
        )
    )
    return p.select("packet_id", X.label_from_name(name).alias("label"))


def label_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trafficlens.sources.tables import resolve_label

    p = packets(spark, sf_dir).withColumn("label", F.when(F.col("packet_id") % 2 == 0, F.col("label")))
    return resolve_label(p, "normal").select("packet_id", "label")


def bin_equal_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins on a whole fact table: prices per supplier."""
    return lengths.bin_counts(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice")


def min_packets_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups below ten packets have no features (small groups: sources per capture and port)."""
    by = ["capture_file", "ip_src", "dst_port"]
    counts = lengths.basic_counts(packets(spark, sf_dir), by)
    return assemble.enough_packets(counts)


def value_freq_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.value_freq(
        table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_returnflag", "l_linestatus", "l_linenumber"]
    )


def entropy_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    freq = value_freq_lineitem(spark, sf_dir)
    return rounded(tallies.entropy_by_column(freq, ["l_suppkey"]))


def protocol_ratio(p: DataFrame) -> DataFrame:
    return tallies.value_ratios(p, E, ["protocol"]).select(*E, F.col("val").alias("protocol"), "n", "ratio")


def top5_ratios(p: DataFrame) -> DataFrame:
    return tallies.top_values(p, E, ["tcp_flags", "icmp_type", "http_method"], 5)


def frequent_values(p: DataFrame) -> DataFrame:
    """The first five values by counters of each task; lengths and times have too many even values for these."""
    return sketches.frequent_values(p, E, ["tcp_flags", "http_method", "dst_port", "packet_length", "ts_us"], 5, 16)


def sketch_quantiles(p: DataFrame) -> DataFrame:
    """Hourly summaries merged by capture: whether each estimate's rank is within the bound."""
    hourly = sketches.summaries(p.withColumn("hour", F.floor(F.col("ts_us") / 3_600_000_000)), [*E, "hour"], ["packet_length", "ts_us"])
    found = sketches.merged(hourly, E)
    shares = (0.05, 0.5, 0.95)
    out = [F.col("n")]
    for column in ("packet_length", "ts_us"):
        out += [sketches.quantile(column, s).alias(f"{column}_{round(100 * s)}") for s in shares]
    guesses = found.select(*E, *out)
    checks = [
        (
            (F.avg(F.when(F.col(column) < F.col(f"{column}_{at}"), 1.0).otherwise(0.0)) <= s + sketches.RANK_ERROR)
            & (F.avg(F.when(F.col(column) <= F.col(f"{column}_{at}"), 1.0).otherwise(0.0)) >= s - sketches.RANK_ERROR)
        ).alias(f"{column}_{at}_ok")
        for column in ("packet_length", "ts_us")
        for s, at in ((s, round(100 * s)) for s in shares)
    ]
    return p.join(guesses, E).groupBy(*E, "n").agg(*checks)


def sketch_uniques(p: DataFrame) -> DataFrame:
    """Hourly distinct sketches merged by capture, against the exact counts."""
    columns = ["ip_src", "dst_port", "packet_length", "ts_us"]
    hourly = sketches.summaries(p.withColumn("hour", F.floor(F.col("ts_us") / 3_600_000_000)), [*E, "hour"], uniques=columns)
    found = sketches.merged(hourly, E).select(*E, *[sketches.unique(c).alias(c) for c in columns])
    exact = tallies.value_freq(p, E, columns).groupBy(*E, "col").agg(F.count(F.lit(1)).alias("exact"))
    near = F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(F.lit(1.0), sketches.COUNT_ERROR * F.col("exact"))
    return found.unpivot(E, columns, "col", "estimate").join(exact, [*E, "col"]).select(*E, "col", "exact", near.alias("near"))


def count_windows(p: DataFrame) -> DataFrame:
    w = timing.time_windows(p, E, tie=TIE)
    return w.select(*E, "window_no", "n", "t0", "t1", "bytes")


def null_times(p: DataFrame) -> DataFrame:
    """Windows of packets some of which have no time: those come last."""
    partly = p.withColumn("ts_us", F.when(F.col("packet_id") % 7 != 0, F.col("ts_us")))
    return timing.time_windows(partly, E, 20, TIE).select(*E, "window_no", "n", "t0", "t1", "bytes", "gaps")


def protocol_ratio_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of protocols where a column has more values than there are protocol numbers."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_orderkey") % 1000).cast("int").alias("protocol"))
    maps = statistical.ratio_maps(lines, ["l_returnflag"])
    return rounded(maps.select("l_returnflag", F.explode("protocol_ratio").alias("protocol", "ratio")))


def time_part(prefix: str) -> Callable[[DataFrame], DataFrame]:
    def operator(p: DataFrame) -> DataFrame:
        all_features = timing.time_features(p, E, tie=TIE)
        return all_features.select(*E, *[c for c in all_features.columns if c.startswith(prefix)])

    return operator


def feature_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: all 72 fixed features of every capture, with label and status."""
    features = assemble.extract_features(packets(spark, sf_dir), E, tie=TIE)
    return rounded(features.select(*E, "label", "status", *FIXED_FEATURES))


def feature_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four value-named feature maps of the feature row, unfolded to one row per entry."""
    from trafficlens.operators.statistical import ratio_maps

    maps = ratio_maps(packets(spark, sf_dir), E)
    parts = [
        f"transform(map_entries({m}), e -> struct('{m}' as feature, e.key as val, e.value as ratio))"
        for m in MAP_FEATURES
    ]
    return rounded(maps.select(*E, F.expr(f"inline(concat({', '.join(parts)}))")))


LIVE = 50


def live_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return livewindows.live_windows(numbered_packets(spark, sf_dir), LIVE)


WINDOW_COLUMNS = (
    "total_packets",
    "syn_ratio",
    "packet_length_mean",
    "packet_length_std",
    "packet_length_median",
    "unique_src_ips",
    "entropy_dst_port",
    "flow_count",
    "packets_per_flow_mean",
    "time_span",
    "packets_per_second",
    "inter_arrival_time_std",
    "entropy_packet_length",
    "direction_ratio_mean",
)


def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = assemble.window_features(numbered_packets(spark, sf_dir), LIVE)
    return rounded(features.select("capture_file", "window_id", "status", *WINDOW_COLUMNS))


QUERIES: dict[str, Query] = {
    "ts_coerce": ts_coerce,
    "tcp_flag_bits": tcp_flag_bits,
    "base_name": base_name,
    "verdict_text": verdict_text,
    "admit_ext": admit_ext,
    "label_by_name": label_by_name,
    "label_resolve": label_resolve,
    "bin_equal_width": bin_equal_width,
    "min_packets_guard": min_packets_guard,
    "value_freq": value_freq_lineitem,
    "entropy": entropy_lineitem,
    "basic_counts": on_packets(lambda p: lengths.basic_counts(p, E)),
    "protocol_ratio": on_packets(protocol_ratio),
    "protocol_ratio_many": protocol_ratio_many,
    "null_times": on_packets(null_times),
    "flag_ratios": on_packets(lambda p: counted.flag_ratios(p, E)),
    "length_stats": on_packets(lambda p: lengths.length_stats(p, E)),
    "length_percentiles": on_packets(lambda p: lengths.length_percentiles(p, E)),
    "ttl_stats": on_packets(lambda p: counted.ttl_stats(p, E)),
    "port_stats": on_packets(lambda p: counted.port_stats(p, E)),
    "ip_unique": on_packets(lambda p: counted.ip_unique(p, E)),
    "ip_entropy": on_packets(lambda p: counted.ip_entropy(p, E)),
    "flow_table": on_packets(lambda p: flows.flow_table(p, E)),
    "flow_count": on_flows(flows.flow_count),
    "packets_per_flow": on_flows(flows.packets_per_flow),
    "flow_duration": on_flows(flows.flow_duration),
    "flow_pps": on_flows(flows.flow_pps),
    "bytes_per_flow": on_flows(flows.bytes_per_flow),
    "flow_bps": on_flows(flows.flow_bps),
    "time_span": on_packets(lambda p: timing.time_span(p, E)),
    "overall_rates": on_packets(lambda p: timing.overall_rates(p, E)),
    "inter_arrival": on_packets(time_part("inter_arrival_time")),
    "count_windows": on_packets(count_windows),
    "window_pps": on_packets(time_part("window_packets_per_second")),
    "window_bps": on_packets(time_part("window_bytes_per_second")),
    "live_windows": live_windows,
    "entropy_columns": on_packets(lambda p: counted.entropy_columns(p, E)),
    "entropy_length_bins": on_packets(lambda p: lengths.entropy_length_bins(p, E)),
    "direction_ratio": on_packets(lambda p: counted.direction_ratio(p, E)),
    "top5_ratios": on_packets(top5_ratios),
    "frequent_values": on_packets(frequent_values),
    "sketch_quantiles": on_packets(sketch_quantiles),
    "sketch_uniques": on_packets(sketch_uniques),
    "feature_maps": feature_maps,
    "feature_row": feature_row,
    "window_features": window_features,
}
