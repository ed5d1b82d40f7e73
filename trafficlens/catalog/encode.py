"""Packet rows back to capture bytes, so that the decoder can be checked on whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.expressions import flag_bits

PACKETS_PER_FILE = 1000


def _hex(x: Column, width: int) -> Column:
    return F.lpad(F.hex(x.cast("bigint")), 2 * width, "0")


def _little(x: Column) -> Column:
    text = _hex(x, 4)
    return F.concat(*[F.substring(text, i, 2) for i in (7, 5, 3, 1)])


def _address(ip: Column) -> Column:
    return F.concat(*[_hex(F.split(ip, r"\.")[i], 1) for i in range(4)])


#: Records of a capture, as a payload might carry them: twenty headers, each followed by eight bytes.
DECOY = ("00F1536500000000" + "0800000008000000" + "AB" * 8) * 20


def frame_hex(decoys: bool = False) -> Column:
    """Ethernet, IPv4, and TCP, UDP or ICMP, with a request line or a DNS question where there is one.

    With ``decoys`` other payloads look like the records of a capture file.
    """
    method, query = F.col("http_method"), F.col("dns_query")
    labels = F.transform(F.split(query, r"\."), lambda x: F.concat(_hex(F.length(x), 1), F.hex(x)))
    dns = F.concat(F.lit("000001000001000000000000"), F.array_join(labels, ""), F.lit("0000010001"))
    tcp = F.concat(
        _hex(F.col("src_port"), 2), _hex(F.col("dst_port"), 2), F.lit("0000000000000000"),
        F.lit("50"), _hex(flag_bits(F.col("tcp_flags")), 1), _hex(F.col("tcp_window_size"), 2), F.lit("00000000"),
        F.coalesce(F.hex(F.concat(method, F.lit(" / HTTP/1.1\r\n\r\n"))), F.lit("")),
    )
    udp = F.concat(
        _hex(F.col("src_port"), 2), _hex(F.col("dst_port"), 2), _hex(F.col("udp_length"), 2), F.lit("0000"),
        F.coalesce(dns, F.lit(DECOY if decoys else "")),
    )
    icmp = F.concat(_hex(F.col("icmp_type"), 1), F.lit("00000000000000" + (DECOY if decoys else "")))
    protocol = F.col("protocol")
    ip = F.concat(
        F.lit("4500"), F.lit("0000"), F.lit("00000000"), _hex(F.col("ttl"), 1), _hex(protocol, 1), F.lit("0000"),
        _address(F.col("ip_src")), _address(F.col("ip_dst")),
    )
    transport = F.when(protocol == 6, tcp).when(protocol == 17, udp).otherwise(icmp)
    return F.concat(F.lit("00" * 12 + "0800"), ip, transport)


#: Ethernet without a network header, for packets that lack a field of theirs: no packet may be missing from its capture.
BARE = "00" * 14


def _parts(packets: DataFrame, decoys: bool = False) -> DataFrame:
    """capture_file, part and the records (hex) of each thousand packets of a capture."""
    body = F.coalesce(frame_hex(decoys), F.lit(BARE))
    size = F.length(body) / 2
    record = F.concat(
        _little(F.floor(F.col("ts_us") / 1_000_000)), _little(F.col("ts_us") % 1_000_000),
        _little(size), _little(F.coalesce(F.col("packet_length"), size)), body,
    )
    part = F.floor(F.col("packet_no") / PACKETS_PER_FILE).cast("bigint")
    return (
        packets.select("capture_file", part.alias("part"), F.struct("packet_no", record.alias("record")).alias("r"))
        .groupBy("capture_file", "part")
        .agg(F.sort_array(F.collect_list("r")).alias("records"))
        .select("capture_file", "part", F.array_join(F.col("records.record"), "").alias("records"))
    )


HEADER = "D4C3B2A1020004000000000000000000FFFF000001000000"


def capture_blobs(packets: DataFrame) -> DataFrame:
    """(path, content): classic capture files of at most 1000 packets each.

    ``packets`` needs ``packet_no``; file ``n`` of a capture holds its packets from 1000 n on.
    """
    return _parts(packets).select(
        F.concat(F.lit("/captures/"), F.lpad(F.col("part").cast("string"), 9, "0"), F.lit("_"), "capture_file").alias("path"),
        F.unhex(F.concat(F.lit(HEADER), F.col("records"))).alias("content"),
    )


def capture_parts(packets: DataFrame, decoys: bool = False) -> DataFrame:
    """(path, part, content): one capture file for each capture, in parts that are joined when they are written."""
    head = F.when(F.col("part") == 0, F.lit(HEADER)).otherwise(F.lit(""))
    return _parts(packets, decoys).select(
        F.col("capture_file").alias("path"), "part", F.unhex(F.concat(head, F.col("records"))).alias("content")
    )
