"""Registered queries that run a stream over the packet table to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.catalog.feature_oracles import on_packets
from trafficlens.catalog.fixture import numbered_packets
from trafficlens.catalog.learning_queries import FOREST, LIVE, VERDICT_ROWS, W, windows
from trafficlens.catalog.shape import digits_of, rounded
from trafficlens.learning import models
from trafficlens.session import fresh_path
from trafficlens.streaming import live

PARTS = 3
# The packets land ten days at a time, in files of any order: nothing is later than that.
DELAY = "10 days"
IDLE = 600


def landed(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """The packets of three times ten days, one part after the other, and a marker that closes what is open."""
    packets = numbered_packets(spark, sf_dir).drop("ts_us", "label")
    path = fresh_path(spark, "landed")
    third = F.floor((F.dayofmonth("timestamp") - 1) / 10)
    for i in range(PARTS):
        packets.where(third == i).coalesce(2).write.mode("append").parquet(path)
    table = spark.read.parquet(path)
    live.write_marker(spark, path, table.schema)
    return path, table


def stream_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packet stream itself, passed through a sink."""
    path, table = landed(spark, sf_dir)
    out = fresh_path(spark, "passed")
    live.run_to_parquet(live.packet_stream(spark, path, table.schema, files_per_trigger=1), out).awaitTermination()
    passed = spark.read.schema(table.schema).parquet(out)
    return passed.where("packet_no is not null").select("packet_id", "capture_file", "packet_no", "packet_length")


def stream_flow_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly rates of all windows."""
    path, table = landed(spark, sf_dir)
    stream = live.flow_rates(live.packet_stream(spark, path, table.schema, DELAY, 1), "1 hour")
    out = fresh_path(spark, "rates")
    live.run_to_parquet(stream, out).awaitTermination()
    done = spark.read.schema(stream.schema).parquet(out)
    columns = [c for c in done.columns if c not in ("window_start", "window_end")]
    return rounded(
        done.select(
            F.unix_micros("window_start").alias("window_us"),
            *columns,
        )
    )


def stream_count_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count windows, full or at the end of a capture, as the stream releases them, summed up per window."""
    return _summed(_closed(spark, *landed(spark, sf_dir)))


def _closed(spark: SparkSession, path: str, table: DataFrame, delay: str = DELAY, idle_seconds: int = IDLE) -> DataFrame:
    stream = live.closed_windows(live.packet_stream(spark, path, table.schema, delay, 1), LIVE, idle_seconds)
    out = fresh_path(spark, "closed")
    live.run_to_parquet(stream, out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _summed(done: DataFrame) -> DataFrame:
    return done.groupBy(*W).agg(
        F.count(F.lit(1)).alias("packet_count"),
        F.min("packet_no").alias("first_no"),
        F.max("packet_no").alias("last_no"),
        F.sum(F.col("packet_length").cast("bigint")).alias("bytes"),
    )


def stream_null_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows where every seventh packet, and every packet of the second and each fifth window after it, has no time; some packets land twice."""
    packets = numbered_packets(spark, sf_dir).drop("ts_us", "label")
    window = F.floor(F.col("packet_no") / LIVE)
    untimed = packets.withColumn("timestamp", F.when((F.col("packet_no") % 7 != 0) & (window % 5 != 1), F.col("timestamp")))
    path = fresh_path(spark, "landed")
    for part in (untimed.where("packet_no % 2 = 0"), untimed.where("packet_no % 2 = 1 or packet_no % 10 = 0")):
        part.coalesce(2).write.mode("append").parquet(path)
    table = spark.read.parquet(path)
    # Packets land in no order of time, and those without one must not be given up before the others have come.
    live.write_marker(spark, path, table.schema, "100 days")
    return _summed(_closed(spark, path, table, "40 days", 30 * 86_400)).drop("last_no")


def stream_window_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count windows as sums, without their packets."""
    path, table = landed(spark, sf_dir)
    stream = live.window_totals(live.packet_stream(spark, path, table.schema, DELAY, 1), LIVE, IDLE)
    out = fresh_path(spark, "totals")
    live.run_to_parquet(stream, out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly rates where a tenth of the packets of the first ten days lands after all others: arrived, given and late packets."""
    packets = numbered_packets(spark, sf_dir).drop("ts_us", "label")
    early, late = F.dayofmonth("timestamp") <= 10, F.col("packet_id") % 10 == 0
    path = fresh_path(spark, "landed")
    rest = ~early & F.dayofmonth("timestamp").between(11, 20)
    # Two files after the first ten days have gone by, so that the watermark is past them, then the late ones, then the end.
    for part in (early & ~late, rest, F.dayofmonth("timestamp") > 20, early & late):
        packets.where(part).coalesce(1).write.mode("append").parquet(path)
    table = spark.read.parquet(path)
    live.write_marker(spark, path, table.schema)
    stream = live.with_counts(live.packet_stream(spark, path, table.schema, "1 hour", 1).where("capture_file is not null or packet_no is null"), "1 hour")
    counts = live.batch_counts(live.run_to_parquet(stream, fresh_path(spark, "rates")))
    # The marker arrives as well and is never given.
    sums = counts.agg((F.sum("arrived") - 1).alias("arrived"), F.sum("given").alias("given"), (F.max("late_groups") > 0).alias("any_late"))
    return sums.withColumn("late", F.col("arrived") - F.col("given"))


def stream_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the closed windows of the stream."""
    model = models.train(windows(spark, sf_dir), FOREST, W, stored=True)
    path, table = landed(spark, sf_dir)
    out = fresh_path(spark, "verdicts")
    packets = live.packet_stream(spark, path, table.schema, DELAY, 1)
    live.live_verdicts(packets, model, out, LIVE).awaitTermination()
    return spark.read.parquet(out).drop("batch", "probability")


QUERIES = {
    "stream_packets": stream_packets,
    "stream_flow_rates": stream_flow_rates,
    "stream_count_windows": stream_count_windows,
    "stream_verdicts": stream_verdicts,
    "stream_null_times": stream_null_times,
    "stream_window_totals": stream_window_totals,
    "stream_late": stream_late,
}


def _stats(name: str, x: str, whole: bool) -> str:
    digits = digits_of(f"{name}_mean")
    cast = "cast({} as bigint)" if whole else f"round({{}}, {digits})"
    return (
        f"round(avg({x}), {digits}) as {name}_mean, round(stddev_pop({x}), {digits}) as {name}_std, "
        f"{cast.format(f'max({x})')} as {name}_max, {cast.format(f'min({x})')} as {name}_min"
    )


ORACLES = {
    "stream_packets": on_packets("select packet_id, capture_file, packet_no, packet_length from numbered"),
    "stream_flow_rates": on_packets(
        f"""select window_us, capture_file, cast(sum(n) as bigint) as total_packets, cast(sum(bytes) as bigint) as total_bytes,
              round(case when max(t1) > min(t0) then sum(n) / ((max(t1) - min(t0)) / 1e6) end, 6) as packets_per_second,
              round(case when max(t1) > min(t0) then sum(bytes) / ((max(t1) - min(t0)) / 1e6) end, 6) as bytes_per_second,
              count(*) filter (where is_flow) as flow_count,
              {_stats('packets_per_flow', 'case when is_flow then n end', True)},
              {_stats('bytes_per_flow', 'case when is_flow then bytes end', True)},
              {_stats('flow_duration', 'case when is_flow and n > 1 and t1 > t0 then (t1 - t0) / 1e6 end', False)}
            from hourly
            group by window_us, capture_file""",
        """hourly as (select ts_us // 3600000000 * 3600000000 as window_us, capture_file, count(*) as n,
             sum(packet_length) as bytes, min(ts_us) as t0, max(ts_us) as t1, src_port is not null as is_flow
           from packets group by ts_us // 3600000000, capture_file, ip_src, ip_dst, src_port, dst_port, protocol)""",
    ),
    "stream_verdicts": on_packets(VERDICT_ROWS),
    "stream_null_times": on_packets(
        """select capture_file, packet_no // 50 as window_id, count(*) as packet_count, min(packet_no) as first_no,
             cast(sum(packet_length) as bigint) as bytes
           from numbered group by capture_file, packet_no // 50"""
    ),
    "stream_window_totals": on_packets(
        """select capture_file, packet_no // 50 as window_id, count(*) as packet_count, min(packet_no) as first_no,
             max(packet_no) as last_no, cast(sum(packet_length) as bigint) as bytes, min(ts_us) as first_us, max(ts_us) as last_us
           from numbered group by capture_file, packet_no // 50"""
    ),
    "stream_late": on_packets(
        """select cast(count(*) as bigint) as arrived, cast(count(*) filter (not late) as bigint) as given, bool_or(late) as any_late,
             cast(count(*) filter (late) as bigint) as late
           from (select packet_id % 10 = 0 and cast(substr(capture_file, 5, 2) as int) <= 10 as late from packets)"""
    ),
    "stream_count_windows": on_packets(
        """select capture_file, packet_no // 50 as window_id, count(*) as packet_count, min(packet_no) as first_no,
             max(packet_no) as last_no, cast(sum(packet_length) as bigint) as bytes
           from numbered group by capture_file, packet_no // 50"""
    ),
}
