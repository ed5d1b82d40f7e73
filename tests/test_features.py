from __future__ import annotations

import random

import pytest
from brute import features as brute_features
from pyspark.sql import functions as F

from trafficlens.operators import assemble, timing
from trafficlens.operators.lengths import length_features
from trafficlens.operators.ordering import with_position
from trafficlens.operators.tallies import tallies, value_freq
from trafficlens.schema import FIXED_FEATURES
from trafficlens.settings import FeatureSettings

E = ["capture_file"]
SCHEMA = (
    "capture_file string, packet_no bigint, ts_us bigint, ip_src string, ip_dst string, src_port int, dst_port int, "
    "protocol int, packet_length int, ttl int, tcp_flags string, icmp_type int, http_method string"
)
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
START = 1_700_000_000_000_000


def packet(capture, no, ts, **given):
    base = dict(ip_src="10.0.0.1", ip_dst="10.0.0.2", src_port=1000, dst_port=80, protocol=6, packet_length=60,
                ttl=64, tcp_flags="S", icmp_type=None, http_method=None)
    return {"capture_file": capture, "packet_no": no, "ts_us": START + ts, **base, **given}


def random_capture(capture, n, seed):
    r = random.Random(seed)
    out, ts = [], 0
    for no in range(n):
        ts += r.choice([0, 0, 1, 250, 10_000, 3_000_000])
        maybe = lambda v: None if r.random() < 0.1 else v
        out.append(packet(
            capture, no, ts + r.choice([0, 0, -500]), ip_src=maybe(f"10.0.0.{r.randint(1, 4)}"),
            ip_dst=maybe(f"10.0.0.{r.randint(1, 4)}"), src_port=maybe(r.randint(1020, 1030)),
            dst_port=maybe(r.choice([53, 80, 8080])), protocol=maybe(r.choice([1, 6, 17])),
            packet_length=maybe(r.randint(40, 1500)), ttl=maybe(r.choice([32, 64, 128])),
            tcp_flags=maybe(r.choice(["S", "SA", "A", "PA", "FA", "R"])),
        ))
    return out


def edge_captures():
    short = [packet("nine", i, i * 1000) for i in range(9)]
    ten = [packet("ten", i, i * 1000) for i in range(10)]
    same_time = [packet("same_time", i, 0, packet_length=40 + i) for i in range(150)]
    one_each = [packet("one_each", i, i * 1000, src_port=i) for i in range(20)]
    no_ports = [packet("no_ports", i, i * 777, src_port=None, dst_port=None, protocol=1, tcp_flags=None) for i in range(30)]
    bare = [packet("bare", i, i * 5, **{c: None for c in NAMES[3:]}) for i in range(12)]
    trailing = [packet("trailing", i, i * i * 13, packet_length=40 + i % 7) for i in range(101)]
    exact = [packet("exact", i, i * 1000) for i in range(100)]
    return short + ten + same_time + one_each + no_ports + bare + trailing + exact


def frame(spark, packets):
    return spark.createDataFrame([tuple(p[c] for c in NAMES) for p in packets], SCHEMA)


@pytest.fixture(scope="module")
def all_packets():
    return edge_captures() + random_capture("random_a", 457, 1) + random_capture("random_b", 1201, 2)


@pytest.mark.parametrize("strategy", ["window", "range"])
def test_feature_rows_equal_brute_force(spark, all_packets, strategy):
    shuffled = list(all_packets)
    random.Random(3).shuffle(shuffled)
    rows = {r["capture_file"]: r for r in assemble.extract_features(frame(spark, shuffled), strategy=strategy).collect()}
    for capture in {p["capture_file"] for p in all_packets}:
        want = brute_features([p for p in all_packets if p["capture_file"] == capture])
        got = rows[capture]
        assert got["status"] == ("ok" if want["total_packets"] >= 10 else "too_few_packets")
        for name in FIXED_FEATURES:
            if want.get(name) is None:
                assert got[name] is None, (capture, name)
            else:
                assert got[name] == pytest.approx(want[name], rel=1e-9, abs=1e-9), (capture, name)


def test_small_chunks_of_one_hot_capture(spark):
    """Chunks of two windows, partitions of 60 rows: the same windows and gaps as in one sort."""
    packets = frame(spark, random_capture("hot", 1503, 5) + random_capture("cold", 20, 6))
    whole = timing.time_features(packets, E, strategy="window").orderBy(*E).collect()
    cut = timing.time_features(packets, E, strategy="range", windows_per_chunk=2).orderBy(*E).collect()
    assert len(cut) == 2
    for a, b in zip(whole, cut):
        for x, y in zip(a, b):
            assert x == (pytest.approx(y, rel=1e-12) if isinstance(y, float) else y)


def test_positions_of_hot_group(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        F.xxhash64("id").alias("x"),
    )
    window = with_position(rows, ["g"], ["x"], strategy="window")
    ranged = with_position(rows, ["g"], ["x"], strategy="range", parts=30)
    assert window.exceptAll(ranged).count() == 0 and ranged.count() == 5000


def test_auto_takes_range_route_for_a_large_group(spark):
    rows = spark.range(2000).select(F.lit("g").alias("g"), F.col("id").alias("x"))
    got = with_position(rows, ["g"], ["x"], parts=20)
    assert "row_number" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.where("position = x").count() == 2000


def test_constant_values_give_exact_zeros(spark):
    packets = frame(spark, [packet("c", i, i * 60_000_000) for i in range(1000)])
    row = assemble.extract_features(packets).first()
    for name in ("packet_length_std", "ttl_std", "inter_arrival_time_std", "inter_arrival_time_cv",
                 "entropy_ttl", "entropy_packet_length"):
        assert row[name] == 0.0, name


def test_absent_columns_leave_out_features(spark, all_packets):
    packets = frame(spark, all_packets).drop("tcp_flags", "ttl", "dst_port", "http_method")
    columns = assemble.extract_features(packets).columns
    assert not {"syn_ratio", "ttl_mean", "entropy_ttl", "unique_dst_ports", "http_method_ratio"} & set(columns)
    assert {"flow_count", "unique_src_ports", "time_span"} <= set(columns)


def test_flat_table_without_packet_columns(spark, small):
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    rows = assemble.extract_features(lines, ["l_returnflag"])
    assert rows.columns == ["l_returnflag", "status", "total_packets"]


def test_feature_groups(spark, all_packets):
    packets = frame(spark, all_packets)
    only = assemble.extract_features(packets, settings=FeatureSettings(groups=("basic",), use_entropy=False)).columns
    assert "entropy_src_ip" not in only and "flow_count" not in only and "time_span" not in only
    assert "syn_ratio" in only
    flow = assemble.extract_features(packets, settings=FeatureSettings(groups=("basic", "flow"))).columns
    assert "flow_count" in flow and "entropy_ttl" not in flow
    none = assemble.extract_features(packets, settings=FeatureSettings(use_statistics=False)).columns
    assert "entropy_ttl" not in none and "time_span" in none


def test_flag_spellings(spark):
    packets = [packet("f", i, i * 10, tcp_flags=t) for i, t in enumerate(["SA", "0x0012", "18", "18.0"] * 5)]
    row = assemble.extract_features(frame(spark, packets)).first()
    assert (row["syn_ratio"], row["ack_ratio"], row["fin_ratio"]) == (1.0, 1.0, 0.0)


def test_top_values_break_ties_by_value(spark):
    packets = [packet("t", i, i, tcp_flags=f) for i, f in enumerate(["S", "SA", "A", "PA", "FA", "R"] * 4)]
    row = assemble.extract_features(frame(spark, packets)).first()
    assert sorted(row["tcp_flags_ratio"]) == ["A", "FA", "PA", "R", "S"]
    assert row["protocol_ratio"] == {"6": 1.0}


def test_ratios_and_flows_add_up(spark, all_packets):
    packets = frame(spark, all_packets)
    freq = value_freq(packets, E, ["protocol", "dst_port"])
    totals = {(r["capture_file"], r["col"]): r["n"] for r in freq.groupBy(*E, "col").agg(F.sum("n").alias("n")).collect()}
    known = packets.groupBy(*E).agg(F.count("protocol").alias("protocol"), F.count("dst_port").alias("dst_port"))
    for r in known.collect():
        for c in ("protocol", "dst_port"):
            assert totals.get((r["capture_file"], c), 0) == r[c]
    in_flows = tallies(packets, E, ["flow"]).agg(F.sum("n")).first()[0]
    assert in_flows == packets.dropna(subset=["ip_src", "ip_dst", "src_port", "dst_port", "protocol"]).count()


def test_lengths_alone(spark, all_packets):
    row = length_features(frame(spark, all_packets), E).where("capture_file = 'bare'").first()
    assert row["total_packets"] == 12 and row["packet_length_mean"] is None and row["entropy_packet_length"] == 0.0
