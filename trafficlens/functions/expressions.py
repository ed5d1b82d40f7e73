"""Column expressions shared by the operators. All of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trafficlens.settings import DDOS, NORMAL

# Bit and letter of each counted TCP flag.
TCP_FLAG_BITS = {"syn": 2, "fin": 1, "rst": 4, "psh": 8, "ack": 16}
TCP_FLAG_LETTERS = {"syn": "S", "fin": "F", "rst": "R", "psh": "P", "ack": "A"}


def to_timestamp(col: Column) -> Column:
    """Epoch seconds if the text is a number, else parsed text, else NULL."""
    text = col.cast("string")
    micros = F.round(text.try_cast("double") * 1e6).try_cast("bigint")
    return F.coalesce(F.timestamp_micros(micros), F.try_to_timestamp(text))


def micros(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp"))


def flag_bits(flags: Column) -> Column:
    """TCP flags as a bit mask, from ``0x12``, ``18`` or letters such as ``SA``."""
    text = F.trim(flags.cast("string"))
    digits = F.regexp_extract(text, r"^0[xX]([0-9a-fA-F]+)$", 1)
    letters = [
        F.when(text.contains(TCP_FLAG_LETTERS[name]), bit).otherwise(0) for name, bit in TCP_FLAG_BITS.items()
    ]
    return (
        F.when(text.isNull() | (text == ""), None)
        .when(digits != "", F.conv(digits, 16, 10).try_cast("int"))
        .when(text.rlike(r"^[0-9]+(\.0+)?$"), text.try_cast("double").try_cast("int"))
        .otherwise(sum(letters[1:], letters[0]))
    )


def has_bit(bits: Column, bit: int) -> Column:
    return bits.bitwiseAND(F.lit(bit)) != 0


def well_known(port: Column) -> Column:
    return port.between(0, 1023)


def ratio(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """``part / whole * scale``; 0 for an empty whole."""
    return F.when(whole > 0, part / whole * F.lit(scale)).otherwise(F.lit(0.0))


def equal_width_bin(x: str, low: str, high: str, bins: int = 10) -> Column:
    """1-based bin of the SQL value ``x``; bins are closed on the right, the minimum is in bin 1.

    Edges are doubles: multiples of a range of integers may not fit their type.
    """
    above = [f"if({x} > {low} + {i} * (cast({high} as double) - {low}) / {bins}, 1, 0)" for i in range(1, bins)]
    return F.expr(f"if({x} is null, null, 1 + {' + '.join(above)})")


def histogram_bin(x: Column, low: Column, high: Column, bins: int = 10) -> Column:
    """1-based bin of ``x``; bins are closed on the left, the last one on both sides.

    When all values are equal the range is widened by half a unit on each side, so they
    fall in the middle bin.
    """
    step = (high - low) / F.lit(bins)
    return (
        F.when(high <= low, F.lit(bins // 2 + 1))
        .when(x >= high, F.lit(bins))
        .otherwise(F.lit(1) + F.floor((x - low) / step))
        .cast("int")
    )


def pair_key(a: Column, b: Column, sep: str = "|") -> Column:
    """The two ends in text order, NULL unless both are known."""
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(F.least(a, b), F.lit(sep), F.greatest(a, b)))


def entropy_from_sums(total: str, n_log_n: str) -> Column:
    """Shannon entropy in bits from the SQL values ``sum(n)`` and ``sum(n * log2(n))``.

    ``-sum(p log2 p) = log2(N) - sum(n log2 n) / N``, so one pass over the counts
    is enough and nothing has to be joined back.
    """
    return F.expr(f"if({total} > 0, greatest(0D, log2({total}) - {n_log_n} / {total}), 0D)")


def base_name(path: Column) -> Column:
    """File name without folders and without the last extension."""
    return F.regexp_extract(path, r"([^/\\]+?)(\.[^./\\]*)?$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def path_below(path: Column, depth: int) -> Column:
    """The address below a folder of ``depth`` parts, which tells files of one name in several folders apart."""
    inner = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    parts = F.filter(F.split(inner, "/"), lambda p: p != "")
    below = F.array_join(F.slice(parts, F.lit(depth + 1), F.greatest(F.size(parts), F.lit(1))), "/")
    return F.when(below == "", file_name(path)).otherwise(below)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def admitted(path: Column, allowed: Sequence[str]) -> Column:
    return extension(path).isin([a.lower() for a in allowed])


def verdict_text(prediction: Column) -> Column:
    """``ddos`` for a prediction of 1 or ``ddos``, else ``normal``; no prediction, no verdict."""
    text = prediction.cast("string")
    return F.when(text.isin("1", "1.0", DDOS), F.lit(DDOS)).when(text.isNotNull(), F.lit(NORMAL))


def label_from_name(name: Column) -> Column:
    """Label from the naming rule of the data sets; NULL when no rule applies."""
    base = file_name(name)
    return (
        F.when(base.rlike("^Benign-"), F.lit(NORMAL))
        .when(base.rlike("^DDoS-"), F.lit(DDOS))
        .when(base.rlike(r"pcap_ISCX(\.csv)?$"), F.lit(DDOS))
    )


def hash_order(key: Column, seed: int) -> Column:
    """A repeatable shuffle order: hex digest of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
