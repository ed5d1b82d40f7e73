"""Features that follow from the tallies table: flags, TTL, ports, addresses, flows, pairs.

Each function gives named SQL aggregates over the columns of ``prepared``; one ``groupBy``
evaluates all of them together with fixed-size state per group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.expressions import TCP_FLAG_BITS, flag_bits
from trafficlens.operators.tallies import flow_key, tallies

MICROS = 1e6
ENTROPY_COLUMNS = ("protocol", "src_port", "dst_port", "ip_src", "ip_dst", "ttl")


def prepared(table: DataFrame) -> DataFrame:
    """Tallies with the values that several aggregates share, each computed once per row."""
    return (
        table.withColumn("flags", F.when(F.col("kind") == "tcp_flags", flag_bits(F.col("val"))))
        .withColumn("number", F.expr("if(kind in ('ttl', 'src_port', 'dst_port'), try_cast(val as bigint), null)"))
        .withColumn("nlogn", F.expr("n * log2(n)"))
        .withColumn("share", F.expr("if(kind = 'pair', greatest(forward, n - forward) / n, null)"))
        # Lengths that are all missing add up to 0 bytes.
        .withColumn("size", F.expr("if(kind = 'flow', coalesce(bytes, 0), null)"))
        .withColumn("seconds", F.expr("if(kind = 'flow' and n > 1 and t1 > t0, (t1 - t0) / 1e6D, null)"))
        .withColumn("pps", F.expr("n / seconds"))
        .withColumn("bps", F.expr("size / seconds"))
    )


def _of(kind: str) -> str:
    return f"filter (where kind = '{kind}')"


def _packets(kind: str) -> str:
    """Packets with a value of this kind; NULL when there are none."""
    return f"sum(n) {_of(kind)}"


def _entropy(kind: str) -> str:
    total = _packets(kind)
    return f"coalesce(greatest(0D, log2({total}) - sum(nlogn) {_of(kind)} / {total}), 0D)"


def flag_exprs() -> dict[str, str]:
    return {
        f"{name}_ratio": f"sum(if(flags & {bit} <> 0, n, 0)) {_of('tcp_flags')} / {_packets('tcp_flags')}"
        for name, bit in TCP_FLAG_BITS.items()
    }


def ttl_exprs() -> dict[str, str]:
    ttl, count = _of("ttl"), _packets("ttl")
    wide = "decimal(38, 0)"
    total, squares = f"sum(n * number) {ttl}", f"sum(n * number * number) {ttl}"
    # n * sum(x^2) - sum(x)^2 in whole numbers: exact, so equal values give a deviation of 0.
    spread = (
        f"cast(cast({count} as {wide}) * cast({squares} as {wide}) "
        f"- cast({total} as {wide}) * cast({total} as {wide}) as double)"
    )
    return {
        "ttl_mean": f"{total} / {count}",
        "ttl_std": f"if({count} > 1, sqrt({spread} / {count} / ({count} - 1)), null)",
        "ttl_min": f"min(number) {ttl}",
        "ttl_max": f"max(number) {ttl}",
    }


def port_exprs(columns: Sequence[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for side in ("src", "dst"):
        kind = f"{side}_port"
        if kind in columns:
            out[f"unique_{side}_ports"] = f"nullif(count(n) {_of(kind)}, 0)"
            out[f"well_known_{side}_port_ratio"] = (
                f"sum(if(number between 0 and 1023, n, 0)) {_of(kind)} / {_packets(kind)}"
            )
    return out


def _both_ends(value: str) -> str:
    """Only where both sides have addresses."""
    seen = [f"count(n) {_of(kind)} > 0" for kind in ("ip_src", "ip_dst")]
    return f"if({' and '.join(seen)}, {value}, null)"


def ip_exprs() -> dict[str, str]:
    return {f"unique_{side}_ips": _both_ends(f"count(n) {_of(f'ip_{side}')}") for side in ("src", "dst")}


def ip_entropy_exprs() -> dict[str, str]:
    return {f"entropy_{side}_ip": _both_ends(_entropy(f"ip_{side}")) for side in ("src", "dst")}


def entropy_exprs(columns: Sequence[str]) -> dict[str, str]:
    return {f"entropy_{c}": _entropy(c) for c in ENTROPY_COLUMNS if c in columns}


def direction_exprs() -> dict[str, str]:
    return {f"direction_ratio_{s}": f"{f}(share)" for s, f in (("mean", "avg"), ("min", "min"), ("max", "max"))}


def four_stats(name: str, value: str, where: str = "") -> dict[str, str]:
    """Mean, population deviation, maximum and minimum of a SQL value."""
    functions = (("mean", "avg"), ("std", "stddev_pop"), ("max", "max"), ("min", "min"))
    return {f"{name}_{s}": f"{f}({value}) {where}".strip() for s, f in functions}


def flow_exprs(has_time: bool, has_length: bool) -> dict[str, str]:
    """Flow statistics; durations and rates only over flows of positive duration."""
    out = {"flow_count": f"count(n) {_of('flow')}"}
    out |= four_stats("packets_per_flow", "n", _of("flow"))
    if has_time:
        out |= four_stats("flow_duration", "seconds")
        out |= four_stats("packets_per_second", "pps")
    if has_length:
        out |= four_stats("bytes_per_flow", "size")
        if has_time:
            out |= four_stats("bytes_per_second", "bps")
    return out


def aggregates(exprs: Mapping[str, str]) -> list:
    return [F.expr(f"{sql} as `{name}`") for name, sql in exprs.items()]


def counted(packets: DataFrame, by: Sequence[str], kinds: Sequence[str], exprs: Mapping[str, str]) -> DataFrame:
    """Evaluate named aggregates over the tallies of ``kinds``, one row per group."""
    return prepared(tallies(packets, by, kinds)).groupBy(*by).agg(*aggregates(exprs))


def counted_plan(
    columns: Sequence[str], basic: bool, flow: bool, statistical: bool, use_entropy: bool
) -> tuple[list[str], dict[str, str]]:
    """Kinds and aggregates for the chosen feature groups, leaving out absent columns."""
    kinds: list[str] = []
    exprs: dict[str, str] = {}

    def add(new_kinds: Sequence[str], new_exprs: Mapping[str, str]) -> None:
        kinds.extend(k for k in new_kinds if k not in kinds)
        exprs.update(new_exprs)

    ends = "ip_src" in columns and "ip_dst" in columns
    if basic:
        if "tcp_flags" in columns:
            add(["tcp_flags"], flag_exprs())
        if "ttl" in columns:
            add(["ttl"], ttl_exprs())
        add([c for c in ("src_port", "dst_port") if c in columns], port_exprs(columns))
        if ends:
            add(["ip_src", "ip_dst"], ip_exprs())
            if use_entropy:
                add([], ip_entropy_exprs())
    if flow and flow_key(columns):
        add(["flow"], flow_exprs("ts_us" in columns, "packet_length" in columns))
    if statistical:
        add([c for c in ENTROPY_COLUMNS if c in columns], entropy_exprs(columns))
        if ends:
            add(["pair"], direction_exprs())
    return kinds, exprs


# Single operators, each with only the columns it needs.


def flag_ratios(packets: DataFrame, by: Sequence[str]) -> DataFrame:
    return counted(packets, by, ["tcp_flags"], flag_exprs())


def ttl_stats(packets: DataFrame, by: Sequence[str]) -> DataFrame:
    return counted(packets, by, ["ttl"], ttl_exprs())


def port_stats(packets: DataFrame, by: Sequence[str]) -> DataFrame:
    return counted(packets, by, ["src_port", "dst_port"], port_exprs(packets.columns))


def ip_unique(packets: DataFrame, by: Sequence[str]) -> DataFrame:
    return counted(packets, by, ["ip_src", "ip_dst"], ip_exprs())


def ip_entropy(packets: DataFrame, by: Sequence[str]) -> DataFrame:
    return counted(packets, by, ["ip_src", "ip_dst"], ip_entropy_exprs())


def entropy_columns(packets: DataFrame, by: Sequence[str]) -> DataFrame:
    present = [c for c in ENTROPY_COLUMNS if c in packets.columns]
    return counted(packets, by, present, entropy_exprs(present))


def direction_ratio(packets: DataFrame, by: Sequence[str]) -> DataFrame:
    return counted(packets, by, ["pair"], direction_exprs())
