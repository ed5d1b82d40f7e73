"""DuckDB statements that state independently what the feature queries must return."""

from __future__ import annotations

from trafficlens.catalog.fixture import PACKETS_SQL
from trafficlens.catalog.shape import digits_of

CAP = "capture_file"


def on_packets(body: str, *more: str) -> str:
    """``body`` over the packet view; ``more`` are further named subqueries."""
    return "with " + ",\n".join([PACKETS_SQL.strip(), *more]) + "\n" + body


def four(name: str, x: str) -> str:
    digits = digits_of(f"{name}_mean")
    functions = (("mean", "avg"), ("std", "stddev_pop"), ("max", "max"), ("min", "min"))
    return ", ".join(f"round({f}({x}), {digits}) as {name}_{s}" for s, f in functions)


def four_int(name: str, x: str) -> str:
    return (
        f"round(avg({x}), 6) as {name}_mean, round(stddev_pop({x}), 6) as {name}_std, "
        f"cast(max({x}) as bigint) as {name}_max, cast(min({x}) as bigint) as {name}_min"
    )


def entropy_of(column: str, name: str, key: str = CAP, source: str = "packets") -> str:
    """Entropy by its definition, -sum(p log2 p), one row per group of ``key``."""
    return f"""{name} as (
      select {key}, round(greatest(0, -sum(p * log2(p))), 6) as h from (
        select {key}, {column}, count(*) * 1e0 / sum(count(*)) over (partition by {key}) as p
        from {source} where {column} is not null group by {key}, {column}) group by {key})"""


FLOWS = f"""flows as (
  select {CAP}, ip_src, ip_dst, src_port, dst_port, protocol, count(*) as n,
    cast(sum(packet_length) as bigint) as bytes, (max(ts_us) - min(ts_us)) / 1e6 as d
  from packets where ip_src is not null and ip_dst is not null and src_port is not null
    and dst_port is not null and protocol is not null group by all),
rated as (
  select *, case when n > 1 and d > 0 then n / d end as pps, case when n > 1 and d > 0 then bytes / d end as bps,
    case when n > 1 and d > 0 then d end as ad from flows)"""

LENGTH = f"""
  round(avg(packet_length), 6) as packet_length_mean, round(stddev_samp(packet_length), 6) as packet_length_std,
  min(packet_length) as packet_length_min, max(packet_length) as packet_length_max,
  round(median(packet_length), 6) as packet_length_median"""
PERCENTILES = ", ".join(
    f"round(quantile_cont(packet_length, {p / 100}), 6) as packet_length_percentile_{p}" for p in (25, 75, 90, 95)
)
FLAGS = ", ".join(
    f"round(avg(case when contains(tcp_flags, '{letter}') then 1e0 when tcp_flags is not null then 0e0 end), 6) as {flag}_ratio"
    for flag, letter in (("syn", "S"), ("fin", "F"), ("rst", "R"), ("psh", "P"), ("ack", "A"))
)
TTL = """round(avg(ttl), 6) as ttl_mean, round(stddev_samp(ttl), 6) as ttl_std,
  cast(min(ttl) as bigint) as ttl_min, cast(max(ttl) as bigint) as ttl_max"""
PORTS = ", ".join(
    f"count(distinct {s}_port) as unique_{s}_ports, "
    f"round(avg(case when {s}_port between 0 and 1023 then 1e0 when {s}_port is not null then 0e0 end), 6) "
    f"as well_known_{s}_port_ratio"
    for s in ("src", "dst")
)
IPS = "count(distinct ip_src) as unique_src_ips, count(distinct ip_dst) as unique_dst_ips"

GAPS = f"""gaps as (
  select *, (ts_us - lag(ts_us) over (partition by {CAP} order by ts_us, packet_id)) / 1e6 as g,
    (row_number() over (partition by {CAP} order by ts_us, packet_id) - 1) // 100 as window_no from packets)"""
GAP_STATS = four("inter_arrival_time", "g") + ", round(stddev_pop(g) / avg(g), 6) as inter_arrival_time_cv"
COUNTED = f"""wins as (
  select {CAP}, window_no, count(*) as n, min(ts_us) as t0, max(ts_us) as t1,
    cast(sum(packet_length) as bigint) as bytes from gaps group by {CAP}, window_no),
wrates as (
  select {CAP}, case when t1 > t0 then n / ((t1 - t0) / 1e6) else 0 end as pps,
    case when t1 > t0 then bytes / ((t1 - t0) / 1e6) else 0 end as bps,
    sum(n) over (partition by {CAP}) as total, n from wins),
wkept as (select * from wrates where n > 1)"""


def window_stats(column: str, name: str) -> str:
    parts = (("mean", "avg"), ("std", "stddev_pop"), ("max", "max"))
    return ", ".join(
        f"round({f}(case when total > 100 then {column} end), 6) as window_{name}_per_second_{s}" for s, f in parts
    )


BINNED = f"""limits as (select {CAP}, min(packet_length) as mn, max(packet_length) as mx from packets group by {CAP}),
binned as (
  select p.{CAP}, 1 + {' + '.join(f'(case when packet_length > mn + {i} * (mx - mn) / 10e0 then 1 else 0 end)' for i in range(1, 10))} as bin
  from packets p join limits using ({CAP}))"""
PAIRS = f"""pairs as (
  select {CAP}, least(ip_src, ip_dst) as a, greatest(ip_src, ip_dst) as b, count(*) as n,
    count(*) filter (where ip_src < ip_dst) as f from packets
  where ip_src is not null and ip_dst is not null group by all)"""
DIRECTION = ", ".join(
    f"round({f}(greatest(f, n - f) * 1e0 / n), 6) as direction_ratio_{s}"
    for s, f in (("mean", "avg"), ("min", "min"), ("max", "max"))
)
ENTROPY_COLUMNS = ("protocol", "src_port", "dst_port", "ip_src", "ip_dst", "ttl")
ENTROPIES = [entropy_of(c, f"h_{c}") for c in ENTROPY_COLUMNS]
RATES = f"""rates as (
  select {CAP}, (max(ts_us) - min(ts_us)) / 1e6 as span, count(*) as n, sum(packet_length) as bytes from packets group by {CAP})"""

TOP5 = f"""freq as (
  select {CAP}, 'tcp_flags' as col, tcp_flags as val, count(*) as n from packets where tcp_flags is not null group by all
  union all
  select {CAP}, 'icmp_type', cast(icmp_type as varchar), count(*) from packets where icmp_type is not null group by all
  union all
  select {CAP}, 'http_method', http_method, count(*) from packets where http_method is not null group by all),
ranked as (
  select *, row_number() over (partition by {CAP}, col order by n desc, val) as rank,
    sum(n) over (partition by {CAP}, col) as total from freq)"""

FEATURE_ROW = on_packets(
    f"""
select basic.*, flow.* exclude ({CAP}), span.* exclude ({CAP}), gap.* exclude ({CAP}), win.* exclude ({CAP}),
  {', '.join(f'coalesce(h_{c}.h, 0) as entropy_{c}' for c in ENTROPY_COLUMNS)},
  h_ip_src.h as entropy_src_ip, h_ip_dst.h as entropy_dst_ip,
  h_bin.h as entropy_packet_length, dir.* exclude ({CAP})
from basic left join flow using ({CAP}) left join span using ({CAP}) left join gap using ({CAP})
  left join win using ({CAP}) {' '.join(f'left join h_{c} on h_{c}.{CAP} = basic.{CAP}' for c in ENTROPY_COLUMNS)}
  left join h_bin on h_bin.{CAP} = basic.{CAP} left join dir on dir.{CAP} = basic.{CAP}""",
    FLOWS,
    GAPS,
    COUNTED,
    BINNED,
    entropy_of("bin", "h_bin", source="binned"),
    PAIRS,
    RATES,
    *ENTROPIES,
    f"""basic as (
      select {CAP}, min(label) as label, 'ok' as status, count(*) as total_packets, {FLAGS}, {LENGTH}, {PERCENTILES},
        {TTL}, {PORTS}, {IPS} from packets group by {CAP} having count(*) >= 10)""",
    f"""flow as (
      select {CAP}, count(*) as flow_count, {four_int('packets_per_flow', 'n')}, {four('flow_duration', 'ad')},
        {four('packets_per_second', 'pps')}, {four_int('bytes_per_flow', 'bytes')},
        {four('bytes_per_second', 'bps')} from rated group by {CAP})""",
    f"""span as (
      select {CAP}, round(span, 6) as time_span, round(n / span, 6) as packets_per_second,
        round(bytes / span, 6) as bytes_per_second from rates)""",
    f"gap as (select {CAP}, {GAP_STATS} from gaps group by {CAP})",
    f"win as (select {CAP}, {window_stats('pps', 'packets')}, {window_stats('bps', 'bytes')} from wkept group by {CAP})",
    f"dir as (select {CAP}, {DIRECTION} from pairs group by {CAP})",
)

WKEY = "capture_file, window_id"
WINDOW_FEATURES = on_packets(
    f"""
select b.*, f.* exclude ({WKEY}), h1.h as entropy_dst_port, h2.h as entropy_packet_length, d.* exclude ({WKEY})
from b2 b left join f using ({WKEY}) left join h1 using ({WKEY}) left join h2 using ({WKEY}) left join d using ({WKEY})""",
    "w as (select *, packet_no // 50 as window_id from numbered)",
    f"""lagged as (select *, (ts_us - lag(ts_us) over (partition by {WKEY} order by ts_us, packet_no)) / 1e6 as g from w)""",
    f"""b2 as (select {WKEY}, case when count(*) >= 10 then 'ok' else 'too_few_packets' end as status,
      count(*) as total_packets,
      {', '.join(f'case when count(*) >= 10 then {expr} end as {name}' for name, expr in (
        ('syn_ratio', "round(avg(case when contains(tcp_flags, 'S') then 1e0 when tcp_flags is not null then 0e0 end), 6)"),
        ('packet_length_mean', 'round(avg(packet_length), 6)'),
        ('packet_length_std', 'round(stddev_samp(packet_length), 6)'),
        ('packet_length_median', 'round(median(packet_length), 6)'),
        ('unique_src_ips', 'count(distinct ip_src)'),
        ('time_span', 'round((max(ts_us) - min(ts_us)) / 1e6, 6)'),
        ('packets_per_second', 'round(count(*) / ((max(ts_us) - min(ts_us)) / 1e6), 6)'),
        ('inter_arrival_time_std', 'round(stddev_pop(g), 3)')))}
      from lagged group by {WKEY})""",
    f"big as (select {WKEY} from w group by {WKEY} having count(*) >= 10)",
    f"wf as (select {WKEY}, count(*) as n from w join big using ({WKEY}) where src_port is not null and dst_port is not null group by {WKEY}, ip_src, ip_dst, src_port, dst_port, protocol)",
    f"f as (select {WKEY}, count(*) as flow_count, round(avg(n), 6) as packets_per_flow_mean from wf group by {WKEY})",
    "wb as (select w.* from w join big using (capture_file, window_id))",
    entropy_of("dst_port", "h1", WKEY, "wb"),
    f"lim as (select {WKEY}, min(packet_length) as mn, max(packet_length) as mx from wb group by {WKEY})",
    f"""wbin as (select {WKEY}, 1 + {' + '.join(f'(case when packet_length > mn + {i} * (mx - mn) / 10e0 then 1 else 0 end)' for i in range(1, 10))} as bin
      from wb join lim using ({WKEY}))""",
    entropy_of("bin", "h2", WKEY, "wbin"),
    f"wp as (select {WKEY}, count(*) as n, count(*) filter (where ip_src < ip_dst) as fw from wb group by {WKEY}, least(ip_src, ip_dst), greatest(ip_src, ip_dst))",
    f"d as (select {WKEY}, round(avg(greatest(fw, n - fw) * 1e0 / n), 6) as direction_ratio_mean from wp group by {WKEY})",
)

ORACLES: dict[str, str] = {
    "ts_coerce": on_packets("select packet_id, case when packet_id % 3 < 2 then ts_us end as ts_us from packets"),
    "tcp_flag_bits": on_packets(
        """select packet_id, bits, bits // 2 % 2 as is_syn, bits % 2 as is_fin, bits // 4 % 2 as is_rst,
             bits // 8 % 2 as is_psh, bits // 16 % 2 as is_ack from
           (select packet_id, cast(case tcp_flags when 'S' then 2 when 'SA' then 18 when 'A' then 16 when 'PA' then 24
              when 'FA' then 17 when 'R' then 4 end as int) as bits from packets)"""
    ),
    "base_name": on_packets(
        "select packet_id, replace(capture_file, '.pcap', '') as base_name, capture_file as file_name from packets"
    ),
    "verdict_text": on_packets("select packet_id, label as verdict from packets"),
    "admit_ext": on_packets(
        """select packet_id, case packet_id % 4 when 0 then capture_file when 1 then upper(capture_file)
             else capture_file || 'ng' end as name from packets where packet_id % 4 < 3"""
    ),
    "label_by_name": on_packets(
        """select packet_id, case when label = 'ddos' or packet_id % 5 <> 0 then label end as label from packets"""
    ),
    "label_resolve": on_packets(
        "select packet_id, case when packet_id % 2 = 0 then label else 'normal' end as label from packets"
    ),
    "bin_equal_width": f"""
      with lim as (select l_suppkey, min(l_extendedprice) as mn, max(l_extendedprice) as mx from lineitem group by 1)
      select l_suppkey, 1 + {' + '.join(f'(case when l_extendedprice > mn + {i} * (mx - mn) / 10 then 1 else 0 end)' for i in range(1, 10))} as bin,
        count(*) as n from lineitem join lim using (l_suppkey) group by all""",
    "min_packets_guard": on_packets(
        """select capture_file, ip_src, dst_port, count(*) as total_packets from packets
           group by all having count(*) >= 10"""
    ),
    "value_freq": """
      select l_suppkey, 'l_returnflag' as col, l_returnflag as val, count(*) as n from lineitem group by all
      union all select l_suppkey, 'l_linestatus', l_linestatus, count(*) from lineitem group by all
      union all select l_suppkey, 'l_linenumber', cast(l_linenumber as varchar), count(*) from lineitem group by all""",
    "entropy": "with "
    + ",\n".join(
        entropy_of(c, f"h_{c}", "l_suppkey", "lineitem") for c in ("l_returnflag", "l_linestatus", "l_linenumber")
    )
    + """
      select l_suppkey, 'l_returnflag' as col, h as entropy from h_l_returnflag
      union all select l_suppkey, 'l_linestatus', h from h_l_linestatus
      union all select l_suppkey, 'l_linenumber', h from h_l_linenumber""",
    "basic_counts": on_packets(f"select {CAP}, count(*) as total_packets from packets group by {CAP}"),
    "protocol_ratio": on_packets(
        f"""select {CAP}, cast(protocol as varchar) as protocol, count(*) as n,
              round(count(*) * 1e0 / sum(count(*)) over (partition by {CAP}), 6) as ratio
            from packets group by {CAP}, protocol"""
    ),
    "protocol_ratio_many": """select l_returnflag, cast(cast(l_orderkey % 1000 as int) as varchar) as protocol,
        round(count(*) * 1e0 / sum(count(*)) over (partition by l_returnflag), 6) as ratio
      from lineitem group by l_returnflag, l_orderkey % 1000""",
    "null_times": on_packets(
        f"""select {CAP}, pos // 20 as window_no, count(*) as n, min(t) as t0, max(t) as t1,
              cast(sum(packet_length) as bigint) as bytes, count(t - before) as gaps
            from (select *, row_number() over w - 1 as pos, lag(t) over w as before
                  from (select *, case when packet_id % 7 <> 0 then ts_us end as t from packets)
                  window w as (partition by {CAP} order by t nulls last, packet_id)) group by {CAP}, pos // 20"""
    ),
    "flag_ratios": on_packets(f"select {CAP}, {FLAGS} from packets group by {CAP}"),
    "length_stats": on_packets(f"select {CAP}, {LENGTH} from packets group by {CAP}"),
    "length_percentiles": on_packets(f"select {CAP}, {PERCENTILES} from packets group by {CAP}"),
    "ttl_stats": on_packets(f"select {CAP}, {TTL} from packets group by {CAP}"),
    "port_stats": on_packets(f"select {CAP}, {PORTS} from packets group by {CAP}"),
    "ip_unique": on_packets(f"select {CAP}, {IPS} from packets group by {CAP}"),
    "ip_entropy": on_packets(
        f"select {CAP}, s.h as entropy_src_ip, d.h as entropy_dst_ip from s join d using ({CAP})",
        entropy_of("ip_src", "s"),
        entropy_of("ip_dst", "d"),
    ),
    "flow_table": on_packets(
        f"""select {CAP}, ip_src, ip_dst, src_port, dst_port, protocol, n, bytes, round(d, 6) as duration,
              round(pps, 6) as pps, round(bps, 6) as bps, round(ad, 6) as active_seconds from rated""",
        FLOWS,
    ),
    "flow_count": on_packets(f"select {CAP}, count(*) as flow_count from rated group by {CAP}", FLOWS),
    "packets_per_flow": on_packets(f"select {CAP}, {four_int('packets_per_flow', 'n')} from rated group by {CAP}", FLOWS),
    "flow_duration": on_packets(f"select {CAP}, {four('flow_duration', 'ad')} from rated group by {CAP}", FLOWS),
    "flow_pps": on_packets(f"select {CAP}, {four('packets_per_second', 'pps')} from rated group by {CAP}", FLOWS),
    "bytes_per_flow": on_packets(f"select {CAP}, {four_int('bytes_per_flow', 'bytes')} from rated group by {CAP}", FLOWS),
    "flow_bps": on_packets(f"select {CAP}, {four('bytes_per_second', 'bps')} from rated group by {CAP}", FLOWS),
    "time_span": on_packets(f"select {CAP}, round(span, 6) as time_span from rates", RATES),
    "overall_rates": on_packets(
        f"""select {CAP}, round(n / span, 6) as packets_per_second, round(bytes / span, 6) as bytes_per_second
            from rates""",
        RATES,
    ),
    "inter_arrival": on_packets(f"select {CAP}, {GAP_STATS} from gaps group by {CAP}", GAPS),
    "count_windows": on_packets(f"select {CAP}, window_no, n, t0, t1, bytes from wins", GAPS, COUNTED),
    "window_pps": on_packets(f"select {CAP}, {window_stats('pps', 'packets')} from wkept group by {CAP}", GAPS, COUNTED),
    "window_bps": on_packets(f"select {CAP}, {window_stats('bps', 'bytes')} from wkept group by {CAP}", GAPS, COUNTED),
    "live_windows": on_packets(
        f"""select {CAP}, packet_no // 50 as window_id, packet_no // 50 * 50 as window_start,
              least(packet_no // 50 * 50 + 50, max(total)) as window_end, count(*) as packet_count
            from (select *, count(*) over (partition by {CAP}) as total from numbered) group by {CAP}, packet_no // 50"""
    ),
    "entropy_columns": on_packets(
        f"""select {CAP}, {', '.join(f'coalesce(h_{c}.h, 0) as entropy_{c}' for c in ENTROPY_COLUMNS)}
            from (select distinct {CAP} from packets) {' '.join(f'left join h_{c} using ({CAP})' for c in ENTROPY_COLUMNS)}""",
        *ENTROPIES,
    ),
    "entropy_length_bins": on_packets(
        f"select {CAP}, h as entropy_packet_length from h_bin", BINNED, entropy_of("bin", "h_bin", source="binned")
    ),
    "direction_ratio": on_packets(f"select {CAP}, {DIRECTION} from pairs group by {CAP}", PAIRS),
    "top5_ratios": on_packets(
        f"select {CAP}, col, val, n, cast(rank as int) as rank, round(n * 1e0 / total, 6) as ratio from ranked where rank <= 5",
        TOP5,
    ),
    "frequent_values": on_packets(
        f"""select {CAP}, col, val, n, cast(rank as int) as rank, round(n * 1e0 / total, 6) as ratio
            from (select *, row_number() over (partition by {CAP}, col order by n desc, val) as rank,
                sum(n) over (partition by {CAP}, col) as total
              from (select {CAP}, col, val, count(*) as n
                from (unpivot (select {CAP}, tcp_flags, http_method, cast(dst_port as varchar) as dst_port,
                    cast(packet_length as varchar) as packet_length, cast(ts_us as varchar) as ts_us from packets)
                  on tcp_flags, http_method, dst_port, packet_length, ts_us into name col value val)
                group by all))
            where rank <= 5"""
    ),
    "sketch_quantiles": on_packets(
        f"""select {CAP}, count(*) as n, true as packet_length_5_ok, true as packet_length_50_ok, true as packet_length_95_ok,
              true as ts_us_5_ok, true as ts_us_50_ok, true as ts_us_95_ok from packets group by {CAP}"""
    ),
    "sketch_uniques": on_packets(
        f"""unpivot (select {CAP}, count(distinct ip_src) as ip_src, count(distinct dst_port) as dst_port,
                count(distinct packet_length) as packet_length, count(distinct ts_us) as ts_us from packets group by {CAP})
              on ip_src, dst_port, packet_length, ts_us into name col value exact""",
    ).replace("unpivot (select", "select *, true as near from (unpivot (select", 1) + ")",
    "feature_maps": on_packets(
        f"""select {CAP}, col || '_ratio' as feature, val, round(n * 1e0 / total, 6) as ratio from ranked where rank <= 5
            union all select {CAP}, 'protocol_ratio', cast(protocol as varchar),
              round(count(*) * 1e0 / sum(count(*)) over (partition by {CAP}), 6) from packets group by {CAP}, protocol""",
        TOP5,
    ),
    "feature_row": FEATURE_ROW,
    "window_features": WINDOW_FEATURES,
}
