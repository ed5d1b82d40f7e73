"""Column layouts of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The packet fields in file order.
PACKET_FIELDS = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("ip_src", T.StringType()),
        T.StructField("ip_dst", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("protocol", T.IntegerType()),
        T.StructField("packet_length", T.IntegerType()),
        T.StructField("ttl", T.IntegerType()),
        T.StructField("tcp_flags", T.StringType()),
        T.StructField("tcp_window_size", T.IntegerType()),
        T.StructField("udp_length", T.IntegerType()),
        T.StructField("icmp_type", T.IntegerType()),
        T.StructField("http_method", T.StringType()),
        T.StructField("dns_query", T.StringType()),
    ]
)

PACKET_SCHEMA = T.StructType(
    [T.StructField("capture_file", T.StringType()), T.StructField("packet_no", T.LongType())]
    + PACKET_FIELDS.fields
)

ENTITY = ("capture_file",)
WINDOW_ENTITY = ("capture_file", "window_id")

STATS_SAMPLE = ("mean", "std", "min", "max")
STATS_FLOW = ("mean", "std", "max", "min")

BASIC_FEATURES = (
    ["total_packets"]
    + [f"{flag}_ratio" for flag in ("syn", "fin", "rst", "psh", "ack")]
    + [f"packet_length_{s}" for s in STATS_SAMPLE + ("median",)]
    + [f"packet_length_percentile_{p}" for p in (25, 75, 90, 95)]
    + [f"ttl_{s}" for s in STATS_SAMPLE]
    + ["unique_src_ports", "well_known_src_port_ratio", "unique_dst_ports", "well_known_dst_port_ratio"]
    + ["unique_src_ips", "unique_dst_ips", "entropy_src_ip", "entropy_dst_ip"]
)

FLOW_FEATURES = ["flow_count"] + [
    f"{measure}_{s}"
    for measure in (
        "packets_per_flow",
        "flow_duration",
        "packets_per_second",
        "bytes_per_flow",
        "bytes_per_second",
    )
    for s in STATS_FLOW
]

TIME_FEATURES = (
    ["time_span", "packets_per_second", "bytes_per_second"]
    + [f"inter_arrival_time_{s}" for s in STATS_FLOW + ("cv",)]
    + [f"window_packets_per_second_{s}" for s in ("mean", "std", "max")]
    + [f"window_bytes_per_second_{s}" for s in ("mean", "std", "max")]
)

STATISTICAL_FEATURES = (
    [f"entropy_{c}" for c in ("protocol", "src_port", "dst_port", "ip_src", "ip_dst", "ttl")]
    + ["entropy_packet_length"]
    + [f"direction_ratio_{s}" for s in ("mean", "min", "max")]
)

FIXED_FEATURES = BASIC_FEATURES + FLOW_FEATURES + TIME_FEATURES + STATISTICAL_FEATURES

# Features named after the values seen, kept as MAP<STRING, DOUBLE>.
MAP_FEATURES = ("protocol_ratio", "tcp_flags_ratio", "icmp_type_ratio", "http_method_ratio")
