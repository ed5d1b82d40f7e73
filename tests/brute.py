"""The feature definitions once more, in plain Python over lists of packets."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np


def entropy(values) -> float:
    counts = Counter(v for v in values if v is not None)
    total = sum(counts.values())
    return -sum(n / total * math.log2(n / total) for n in counts.values()) if total else 0.0


def four(name, values, out):
    if values:
        out |= {f"{name}_mean": np.mean(values), f"{name}_std": np.std(values), f"{name}_max": max(values),
                f"{name}_min": min(values)}


def features(packets: list[dict], window: int = 100) -> dict:
    """Fixed features of one capture; packets carry ts_us and come in file order."""
    out: dict = {"total_packets": len(packets)}
    if len(packets) < 10:
        return out
    column = lambda c: [p[c] for p in packets]
    present = lambda c: [v for v in column(c) if v is not None]

    flags = present("tcp_flags")
    for name, letter in zip(("syn", "fin", "rst", "psh", "ack"), "SFRPA"):
        if flags:
            out[f"{name}_ratio"] = sum(letter in f for f in flags) / len(flags)
    lengths = present("packet_length")
    if lengths:
        out |= {"packet_length_mean": np.mean(lengths), "packet_length_min": min(lengths),
                "packet_length_max": max(lengths), "packet_length_median": np.median(lengths)}
        if len(lengths) > 1:
            out["packet_length_std"] = np.std(lengths, ddof=1)
        for p in (25, 75, 90, 95):
            out[f"packet_length_percentile_{p}"] = np.percentile(lengths, p)
    ttl = present("ttl")
    if ttl:
        out |= {"ttl_mean": np.mean(ttl), "ttl_min": min(ttl), "ttl_max": max(ttl)}
        if len(ttl) > 1:
            out["ttl_std"] = np.std(ttl, ddof=1)
    for side in ("src", "dst"):
        ports = present(f"{side}_port")
        if ports:
            out[f"unique_{side}_ports"] = len(set(ports))
            out[f"well_known_{side}_port_ratio"] = sum(p <= 1023 for p in ports) / len(ports)
    if present("ip_src") and present("ip_dst"):
        for side in ("src", "dst"):
            out[f"unique_{side}_ips"] = len(set(present(f"ip_{side}")))
            out[f"entropy_{side}_ip"] = entropy(column(f"ip_{side}"))

    flows: dict = {}
    for p in packets:
        key = tuple(p[c] for c in ("ip_src", "ip_dst", "src_port", "dst_port", "protocol"))
        if None not in key:
            flows.setdefault(key, []).append(p)
    out["flow_count"] = len(flows)
    sizes = [sum(p["packet_length"] or 0 for p in f) for f in flows.values()]
    four("packets_per_flow", [len(f) for f in flows.values()], out)
    four("bytes_per_flow", sizes, out)
    moving = []
    for f, size in zip(flows.values(), sizes):
        seconds = (max(p["ts_us"] for p in f) - min(p["ts_us"] for p in f)) / 1e6
        if len(f) > 1 and seconds > 0:
            moving.append((seconds, len(f) / seconds, size / seconds))
    for i, name in enumerate(("flow_duration", "packets_per_second", "bytes_per_second")):
        four(name, [m[i] for m in moving], out)

    ordered = sorted(packets, key=lambda p: p["ts_us"])  # stable: ties keep file order
    span = (ordered[-1]["ts_us"] - ordered[0]["ts_us"]) / 1e6
    out["time_span"] = span
    if span > 0:
        out["packets_per_second"] = len(packets) / span
        out["bytes_per_second"] = sum(p["packet_length"] or 0 for p in packets) / span
        gaps = np.diff([p["ts_us"] for p in ordered]) / 1e6
        four("inter_arrival_time", list(gaps), out)
        out["inter_arrival_time_cv"] = gaps.std() / gaps.mean()
        if len(packets) > window:
            rates = []
            for i in range(0, len(ordered), window):
                part = ordered[i : i + window]
                if len(part) > 1:
                    d = (part[-1]["ts_us"] - part[0]["ts_us"]) / 1e6
                    size = sum(p["packet_length"] or 0 for p in part)
                    rates.append((len(part) / d, size / d) if part[-1]["ts_us"] > part[0]["ts_us"] else (0.0, 0.0))
            for i, name in enumerate(("packets", "bytes")):
                values = [r[i] for r in rates]
                out |= {f"window_{name}_per_second_mean": np.mean(values),
                        f"window_{name}_per_second_std": np.std(values),
                        f"window_{name}_per_second_max": max(values)}

    for c in ("protocol", "src_port", "dst_port", "ip_src", "ip_dst", "ttl"):
        out[f"entropy_{c}"] = entropy(column(c))
    low, high = min(lengths, default=0), max(lengths, default=0)
    out["entropy_packet_length"] = entropy(
        [1 + sum(x > low + i * (high - low) / 10 for i in range(1, 10)) for x in lengths]
    )
    pairs: dict = {}
    for p in packets:
        a, b = p["ip_src"], p["ip_dst"]
        if a is not None and b is not None:
            pairs.setdefault((min(a, b), max(a, b)), [0, 0])[0 if a < b else 1] += 1
    shares = [max(c) / sum(c) for c in pairs.values()]
    if shares:
        out |= {"direction_ratio_mean": np.mean(shares), "direction_ratio_min": min(shares),
                "direction_ratio_max": max(shares)}
    return out
