"""Registered queries for sources, sinks, stacking and per-file status."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trafficlens.catalog.encode import capture_blobs, capture_parts
from trafficlens.catalog.feature_oracles import on_packets
from trafficlens.catalog.fixture import numbered_packets, packets
from trafficlens.catalog.shape import rounded
from trafficlens.functions.expressions import file_name, path_below
from trafficlens.operators import counted
from trafficlens.plans import training
from trafficlens.schema import PACKET_FIELDS
from trafficlens.session import folder_depth, fresh_path, store
from trafficlens.sources import captures, sinks, tables

E = ["capture_file"]


def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file, all of it."""
    return tables.read_parquet(spark, f"{sf_dir}/lineitem.parquet")


def scan_parquet_pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file; the filter and the four columns reach the scan."""
    lines = tables.read_parquet(spark, f"{sf_dir}/lineitem.parquet")
    return lines.where(F.col("l_quantity") > 45).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


def scan_parquet_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of packet files written day by day, read back as one table."""
    folder = sinks.write_packets(packets(spark, sf_dir), fresh_path(spark, "packets"))
    landed = tables.read_parquet_dir(spark, folder)
    return landed.groupBy(*E, "protocol").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("packet_length").cast("bigint")).alias("bytes")
    )


def scan_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets to CSV and back: same fields, missing values and times."""
    fields = [f.name for f in PACKET_FIELDS.fields]
    folder = sinks.write_csv(packets(spark, sf_dir).select(*fields), fresh_path(spark, "csv"))
    back = tables.good_rows(tables.read_packets_csv(spark, folder))
    return back.select(F.unix_micros("timestamp").alias("ts_us"), *[f for f in fields if f != "timestamp"])


def label_by_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders, each with one label for all its files."""
    p = packets(spark, sf_dir).drop("label")
    attack = F.substring("capture_file", 5, 2).cast("int") % 3 == 0
    folders = {
        label: sinks.write_packets(p.where(rows), fresh_path(spark, label))
        for label, rows in (("ddos", attack), ("normal", ~attack))
    }
    parts = [tables.label_folder(spark, folder, label) for label, folder in folders.items()]
    return tables.stack(parts).select("packet_id", "label")


def merge_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    tcp = p.where(F.col("protocol") == 6).drop("icmp_type")
    rest = p.where(F.col("protocol") != 6).drop("tcp_flags", "http_method")
    return tables.merge_packets([tcp, rest]).select(
        "packet_id", "protocol", "tcp_flags", "icmp_type", "http_method", "packet_length"
    )


def combine_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature tables with different columns: flags for some captures, TTL for the others."""
    p = packets(spark, sf_dir)
    ddos = counted.flag_ratios(p.where(F.col("label") == "ddos"), E)
    normal = counted.ttl_stats(p.where(F.col("label") == "normal"), E)
    return rounded(tables.combine_features([ddos, normal]))


def capture_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets to capture bytes and back through framing and header decoding."""
    blobs = capture_blobs(numbered_packets(spark, sf_dir))
    return captures.packets_of_contents(blobs).drop("timestamp")


def _landed_captures(spark: SparkSession, sf_dir: str) -> str:
    """A folder of real files: attack captures as one file each, the others in files of a thousand packets in a folder of their own."""
    numbered = store(numbered_packets(spark, sf_dir), "numbered")
    small = capture_blobs(numbered.where(F.col("label") == "normal"))
    files = small.select(F.concat(F.lit("small/"), file_name(F.col("path"))).alias("path"), F.lit(0).alias("part"), "content")
    whole = capture_parts(numbered.where(F.col("label") == "ddos"))
    return sinks.write_captures(files.unionByName(whole), fresh_path(spark, "captures"))


def capture_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of capture files of several sizes through the data source; the larger ones are cut into pieces."""
    return captures.CaptureFolder(spark, _landed_captures(spark, sf_dir), segment_bytes=1 << 14).packets().drop("timestamp")


def capture_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same folder by the name of the format, whole files to a task; conditions reach the reader."""
    captures.register(spark)
    found = spark.read.format("captures").load(_landed_captures(spark, sf_dir))
    return found.where("capture_file like 'small/%' and packet_no >= 100").drop("timestamp")


def capture_split_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each capture, walked from many places at once; payloads look like capture records."""
    parts = capture_parts(numbered_packets(spark, sf_dir), decoys=True)
    folder = sinks.write_captures(parts, fresh_path(spark, "captures"))
    return captures.CaptureFolder(spark, folder, segment_bytes=1 << 13).packets().drop("timestamp")


def capture_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and size of the capture files of a folder."""
    folder = _landed_captures(spark, sf_dir)
    depth = folder_depth(spark, folder)
    return captures.list_captures(spark, folder).select(path_below(F.col("path"), depth).alias("capture_file"), "length")


def capture_folder_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status per file of a folder whose larger files are cut into pieces; every third capture is cut short, every fifth is none."""
    parts = capture_parts(numbered_packets(spark, sf_dir))
    day = F.regexp_extract("path", r"cap_(\d+)", 1).cast("int")
    last = F.max("part").over(Window.partitionBy("path")) == F.col("part")
    broken = parts.withColumn(
        "content",
        F.when(day % 5 == 0, F.encode(F.lit("no capture"), "utf-8"))
        .when((day % 3 == 0) & last, F.substring(F.col("content"), F.lit(1), F.length("content") - 7))
        .otherwise(F.col("content")),
    )
    folder = sinks.write_captures(broken, fresh_path(spark, "captures"))
    return captures.CaptureFolder(spark, folder, segment_bytes=1 << 14).status()


def capture_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status per capture file; every third file is cut short, every fifth is no capture."""
    blobs = capture_blobs(numbered_packets(spark, sf_dir))
    day = F.regexp_extract("path", r"cap_(\d+)", 1).cast("int")
    broken = blobs.select(
        "path",
        F.when(day % 5 == 0, F.encode(F.lit("no capture"), "utf-8"))
        .when(day % 3 == 0, F.substring(F.col("content"), F.lit(1), F.length("content") - 7))
        .otherwise(F.col("content"))
        .alias("content"),
    )
    return captures.status_of_pieces(captures.pieces_of_contents(broken))


def same_name_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of one name in many folders stay apart: packets and status of each."""
    blobs = store(
        capture_blobs(numbered_packets(spark, sf_dir)).withColumn("path", F.concat(F.lit("file:/landed/"), file_name(F.col("path")), F.lit("/x.pcap"))), "blobs"
    )
    counts = captures.packets_of_contents(blobs, 1).groupBy(*E).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(captures.status_of_pieces(captures.pieces_of_contents(blobs), captures.capture_name(1)), E).select(*E, "n", "packets", "status")


def _overwrite(path: str, at: int, content: bytes) -> None:
    """Put bytes into a file, or make it of them."""
    system, inner = captures.file_system(path)
    before = b""
    if system.get_file_info(inner).is_file:
        with system.open_input_file(inner) as stream:
            before = stream.readall()
    with system.open_output_stream(inner) as stream:
        stream.write(before[:at] + content + before[at + len(content) :])


def table_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of the files of a folder, one without a footer, one damaged inside, one of no rows."""
    folder = fresh_path(spark, "packets")
    p = packets(spark, sf_dir)
    p.write.parquet(folder)
    for name, rows in (("damaged", p), ("none", p.where("packet_id < 0"))):
        part = fresh_path(spark, name)
        rows.coalesce(1).write.parquet(part)
        system, inner = captures.file_system(part)
        source = next(f.path for f in system.get_file_info(pa.fs.FileSelector(inner)) if f.path.endswith(".parquet"))
        system.copy_file(source, f"{captures.file_system(folder)[1]}/{name}.parquet")
    _overwrite(f"{folder}/broken.parquet", 0, b"no table")
    _overwrite(f"{folder}/damaged.parquet", 4, b"\xff" * 200)  # the first page's header
    return tables.table_status(spark, folder).groupBy("status", "error").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows")).select(
        "status", "error", F.when(F.col("error").isNotNull(), F.col("files")).alias("files"), "rows"
    )


def training_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of the inputs of a training run: a Parquet folder, and a CSV folder one file of which has a line that does not fit."""
    p = packets(spark, sf_dir)
    fields = [f.name for f in PACKET_FIELDS.fields]
    normal = sinks.write_packets(p.where(F.col("label") == "normal").drop("label"), fresh_path(spark, "normal"))
    ddos = sinks.write_csv(p.where(F.col("label") == "ddos").select(*fields), fresh_path(spark, "ddos"))
    good = "1.5," + "," * (len(fields) - 2)
    _overwrite(f"{ddos}/misfit.csv", 0, "\n".join([",".join(fields), good, good.replace("1.5,,,", "1.5,,,no port"), good, ""]).encode())
    folders = [{"folder": normal, "label": "normal"}, {"folder": ddos, "label": "ddos", "kind": "csv"}]
    return training.input_status(spark, folders).groupBy("label", "status", "error").agg(F.sum("rows").alias("rows"))


def landed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of captures that lie in many files each, numbered as they are read: how many there are, and the numbers they take."""
    folder = fresh_path(spark, "packets")
    p = packets(spark, sf_dir).drop("label")
    p.repartition(64, "packet_id").write.parquet(folder)
    landed = tables.with_file(tables.read_parquet_dir(spark, folder), folder)
    return landed.groupBy(*E).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("packet_no").alias("numbers"), F.min("packet_no").alias("first_no"), F.max("packet_no").alias("last_no")
    )


FILE = "lpad(cast(packet_no // 1000 as varchar), 9, '0') || '_' || capture_file"
LANDED = f"case label when 'ddos' then capture_file else 'small/' || {FILE} end"
FIELDS = """ts_us, ip_src, ip_dst, src_port, dst_port, protocol, packet_length, ttl,
    case tcp_flags when 'S' then '0x0002' when 'SA' then '0x0012' when 'A' then '0x0010'
      when 'PA' then '0x0018' when 'FA' then '0x0011' when 'R' then '0x0004' end as tcp_flags,
    tcp_window_size, udp_length, icmp_type, http_method, dns_query"""

QUERIES = {
    "scan_parquet": scan_parquet,
    "scan_parquet_pushed": scan_parquet_pushed,
    "same_name_captures": same_name_captures,
    "table_status": table_status,
    "scan_parquet_dir": scan_parquet_dir,
    "scan_csv_roundtrip": scan_csv_roundtrip,
    "label_by_dir": label_by_dir,
    "merge_packets": merge_packets,
    "combine_features": combine_features,
    "capture_decode": capture_decode,
    "capture_status": capture_status,
    "landed_numbers": landed_numbers,
    "training_inputs": training_inputs,
    "capture_folder": capture_folder,
    "capture_source": capture_source,
    "capture_split_decode": capture_split_decode,
    "capture_list": capture_list,
    "capture_folder_status": capture_folder_status,
}

ORACLES = {
    "scan_parquet": "select * from lineitem",
    "same_name_captures": on_packets(
        f"""select {FILE} || '/x.pcap' as capture_file, count(*) as n, count(*) as packets, 'ok' as status
            from numbered group by 1"""
    ),
    "table_status": on_packets(
        """select 'ok' as status, cast(null as varchar) as error, cast(null as bigint) as files, count(*) as rows from packets
           union all select 'error', 'no readable rows', 1, 0
           union all select 'error', 'fewer rows than its footer tells', 1, 0"""
    ),
    "training_inputs": on_packets(
        """select label, 'ok' as status, cast(null as varchar) as error, count(*) as rows from packets group by label
           union all select 'ddos', 'error', '1 lines do not fit', 2"""
    ),
    "landed_numbers": on_packets(
        """select capture_file, count(*) as n, count(*) as numbers, cast(0 as bigint) as first_no, count(*) - 1 as last_no
           from packets group by capture_file"""
    ),
    "scan_parquet_pushed": "select l_orderkey, l_linenumber, l_quantity, l_returnflag from lineitem where l_quantity > 45",
    "scan_parquet_dir": on_packets(
        """select capture_file, protocol, count(*) as n, cast(sum(packet_length) as bigint) as bytes
           from packets group by all"""
    ),
    "scan_csv_roundtrip": on_packets(
        """select ts_us, ip_src, ip_dst, src_port, dst_port, protocol, packet_length, ttl, tcp_flags, tcp_window_size,
             udp_length, icmp_type, http_method, dns_query from packets"""
    ),
    "label_by_dir": on_packets("select packet_id, label from packets"),
    "merge_packets": on_packets(
        """select packet_id, protocol, tcp_flags, icmp_type, http_method, packet_length from packets where protocol = 6
           union all by name
           select packet_id, protocol, tcp_flags, icmp_type, http_method, packet_length from packets where protocol <> 6"""
    ),
    "combine_features": on_packets(
        """select capture_file, round(avg(case when contains(tcp_flags, 'S') then 1e0 when tcp_flags is not null then 0e0 end), 6) as syn_ratio,
             round(avg(case when contains(tcp_flags, 'F') then 1e0 when tcp_flags is not null then 0e0 end), 6) as fin_ratio,
             round(avg(case when contains(tcp_flags, 'R') then 1e0 when tcp_flags is not null then 0e0 end), 6) as rst_ratio,
             round(avg(case when contains(tcp_flags, 'P') then 1e0 when tcp_flags is not null then 0e0 end), 6) as psh_ratio,
             round(avg(case when contains(tcp_flags, 'A') then 1e0 when tcp_flags is not null then 0e0 end), 6) as ack_ratio
           from packets where label = 'ddos' group by capture_file
           union all by name
           select capture_file, round(avg(ttl), 6) as ttl_mean, round(stddev_samp(ttl), 6) as ttl_std,
             cast(min(ttl) as bigint) as ttl_min, cast(max(ttl) as bigint) as ttl_max
           from packets where label = 'normal' group by capture_file"""
    ),
    "capture_decode": on_packets(f"select {FILE} as capture_file, packet_no % 1000 as packet_no, {FIELDS} from numbered"),
    "capture_folder": on_packets(
        f"""select {LANDED} as capture_file, case label when 'ddos' then packet_no else packet_no % 1000 end as packet_no, {FIELDS}
            from numbered"""
    ),
    "capture_source": on_packets(
        f"""select {LANDED} as capture_file, packet_no % 1000 as packet_no, {FIELDS}
            from numbered where label = 'normal' and packet_no % 1000 >= 100"""
    ),
    "capture_split_decode": on_packets(f"select capture_file, packet_no, {FIELDS} from numbered"),
    "capture_list": on_packets(
        f"""select {LANDED} as capture_file, cast(24 + sum(16 + 14 + 20 + case protocol
                when 6 then 20 + coalesce(15 + length(http_method), 0)
                when 17 then 8 + coalesce(12 + 1 + length(dns_query) + 5, 0) else 8 end) as bigint) as length
            from numbered group by 1"""
    ),
    "capture_folder_status": on_packets(
        """select capture_file, case when day % 5 = 0 or day % 3 = 0 then 'error' else 'ok' end as status,
             cast(case when day % 5 = 0 then 0 when day % 3 = 0 then n - 1 else n end as bigint) as packets,
             case when day % 5 = 0 then 'not a capture file: unknown magic number'
               when day % 3 = 0 then 'the capture is cut short in the middle of a packet' end as error
           from (select capture_file, cast(substr(capture_file, 5, 2) as int) as day, count(*) as n from numbered group by all)"""
    ),
    "capture_status": on_packets(
        f"""select file as capture_file, case when day % 5 = 0 or day % 3 = 0 then 'error' else 'ok' end as status,
              cast(case when day % 5 = 0 then 0 when day % 3 = 0 then n - 1 else n end as bigint) as packets,
              case when day % 5 = 0 then 'not a capture file: unknown magic number'
                when day % 3 = 0 then 'the capture is cut short in the middle of a packet' end as error
            from (select {FILE} as file, cast(substr(capture_file, 5, 2) as int) as day, count(*) as n from numbered
                  group by all)"""
    ),
}
