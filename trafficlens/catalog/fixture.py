"""The packet table used by the registered queries: a deterministic view over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.operators.ordering import with_position


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 captures, one per day; attack captures on days divisible by 3."""
    user, value = F.col("user_id"), F.col("value")
    day = F.dayofmonth("ts")
    kind, event = F.col("event_type"), F.col("event_id")
    # The stored times carry no zone; their microseconds must not depend on the session's.
    since_epoch = F.expr("timestampdiff(microsecond, timestamp_ntz '1970-01-01 00:00:00', ts)")
    prepared = table(spark, sf_dir, "events").select(
        event.alias("packet_id"),
        F.timestamp_micros(since_epoch).alias("timestamp"),
        since_epoch.alias("ts_us"),
        user,
        value,
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.concat(F.lit("cap_"), F.lpad(day.cast("string"), 2, "0"), F.lit(".pcap")).alias("capture_file"),
        F.when(day % 3 == 0, "ddos").otherwise("normal").alias("label"),
        F.when(kind == "signup", 1).when(kind == "purchase", 17).otherwise(6).alias("protocol"),
    )
    ddos = F.col("label") == "ddos"
    k, protocol, packet = F.col("k"), F.col("protocol"), F.col("packet_id")
    tcp, udp, icmp = protocol == 6, protocol == 17, protocol == 1
    size = F.floor(value * 3).cast("int")
    host = lambda n: F.concat(F.lit("10.0.0."), n.cast("string"))
    by_turn = F.when(packet % 6 == 0, "S").when(packet % 6 == 1, "SA").when(packet % 6 == 2, "A")
    by_turn = by_turn.when(packet % 6 == 3, "PA").when(packet % 6 == 4, "FA").otherwise("R")
    return prepared.select(
        "packet_id",
        "capture_file",
        "label",
        "timestamp",
        "ts_us",
        host(user % 5).alias("ip_src"),
        F.when(ddos, "10.0.0.1").otherwise(host(k % 3)).alias("ip_dst"),
        F.when(~icmp, (1000 + (user % 5) * 12).cast("int")).alias("src_port"),
        F.when(~icmp, F.when(k % 4 == 0, 80).when(k % 4 == 1, 443).when(k % 4 == 2, 53).otherwise(8080)).alias(
            "dst_port"
        ),
        "protocol",
        (40 + size).alias("packet_length"),
        (32 + (user % 4) * 32).cast("int").alias("ttl"),
        F.when(tcp, F.when(ddos, "S").otherwise(by_turn)).alias("tcp_flags"),
        F.when(tcp, (1024 * (1 + user % 8)).cast("int")).alias("tcp_window_size"),
        F.when(udp, 8 + size).alias("udp_length"),
        F.when(icmp, ((packet % 3) * 4).cast("int")).alias("icmp_type"),
        F.when(tcp & (k % 4 == 0), F.when(packet % 3 == 0, "POST").otherwise("GET")).alias("http_method"),
        F.when(udp & (k % 4 == 2), F.concat(F.lit("q"), (user % 10).cast("string"), F.lit(".example"))).alias(
            "dns_query"
        ),
    )


def numbered_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``packets`` with ``packet_no``, the 0-based position in the capture."""
    return with_position(packets(spark, sf_dir), ["capture_file"], ["ts_us", "packet_id"], "packet_no")


# The same view for DuckDB.
PACKETS_SQL = """
e as (select event_id, ts, user_id, event_type, value,
    cast(json_extract_string(props, '$.k') as int) as k, cast(extract(day from ts) as int) as dd from events),
b as (select e.*, case event_type when 'signup' then 1 when 'purchase' then 17 else 6 end as protocol,
    case when dd % 3 = 0 then 'ddos' else 'normal' end as label from e),
packets as (select event_id as packet_id,
    concat('cap_', lpad(cast(dd as varchar), 2, '0'), '.pcap') as capture_file, label,
    ts as timestamp, epoch_us(ts) as ts_us,
    concat('10.0.0.', cast(user_id % 5 as varchar)) as ip_src,
    case when label = 'ddos' then '10.0.0.1' else concat('10.0.0.', cast(k % 3 as varchar)) end as ip_dst,
    case when protocol = 1 then null else cast(1000 + (user_id % 5) * 12 as int) end as src_port,
    case when protocol = 1 then null else case k % 4 when 0 then 80 when 1 then 443 when 2 then 53 else 8080 end end as dst_port,
    protocol,
    40 + cast(floor(value * 3) as int) as packet_length,
    cast(32 + (user_id % 4) * 32 as int) as ttl,
    case when protocol <> 6 then null when label = 'ddos' then 'S' else
      case event_id % 6 when 0 then 'S' when 1 then 'SA' when 2 then 'A' when 3 then 'PA' when 4 then 'FA' else 'R' end end as tcp_flags,
    case when protocol = 6 then cast(1024 * (1 + user_id % 8) as int) end as tcp_window_size,
    case when protocol = 17 then 8 + cast(floor(value * 3) as int) end as udp_length,
    case when protocol = 1 then cast((event_id % 3) * 4 as int) end as icmp_type,
    case when protocol = 6 and k % 4 = 0 then case when event_id % 3 = 0 then 'POST' else 'GET' end end as http_method,
    case when protocol = 17 and k % 4 = 2 then concat('q', cast(user_id % 10 as varchar), '.example') end as dns_query
  from b),
numbered as (select *, row_number() over (partition by capture_file order by ts_us, packet_id) - 1 as packet_no from packets)
"""
