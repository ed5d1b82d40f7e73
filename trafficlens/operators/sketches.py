"""Summaries of bounded size that merge: quantiles, distinct counts and frequent values without shuffling the packets.

The exact operators stay the default; these are for groups whose values are too many, and for keeping a day's summary and merging it into
weeks and captures later. ``summaries`` and ``merged`` hold KLL and HyperLogLog sketches, whose errors have known bounds.
``frequent_values`` is exact all the same: Misra-Gries counters of each task say which values can be among the first, only those are
counted, and where the counters' error does not separate them the exact way is taken for that group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trafficlens.operators.tallies import top_values, value_totals
from trafficlens.session import store

KLL_K = 1000
#: One-sided error of a rank, as a share of all values, at 99 % confidence (published for this kind of sketch).
RANK_ERROR = 2.296 / KLL_K**0.9723
HLL_LOG_K = 12
#: Three standard errors of a distinct count.
COUNT_ERROR = 3 * 1.04 / (1 << HLL_LOG_K) ** 0.5
#: Counters of one task for one column of a group; all counters of a task before it hands on what it has.
COUNTERS = 64
MAX_COUNTERS = 1_000_000
#: Candidates that are sent to all tasks.
SENT = 200_000


def summaries(packets: DataFrame, by: Sequence[str], quantiles: Sequence[str] = (), uniques: Sequence[str] = ()) -> DataFrame:
    """One row per group: n, a quantile sketch ``q_<column>`` of each numeric column, a distinct sketch ``u_<column>`` of each column."""
    found = [F.kll_sketch_agg_bigint(F.col(c).cast("bigint"), KLL_K).alias(f"q_{c}") for c in quantiles]
    found += [F.hll_sketch_agg(F.col(c).cast("string"), HLL_LOG_K).alias(f"u_{c}") for c in uniques]
    return packets.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *found)


def merged(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Summaries of coarser groups from those of finer ones."""
    found = [F.kll_merge_agg_bigint(c).alias(c) for c in parts.columns if c.startswith("q_")]
    found += [F.hll_union_agg(c).alias(c) for c in parts.columns if c.startswith("u_")]
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), *found)


def quantile(column: str, share: float) -> Column:
    """Estimate from the summary's sketch; NULL for a column without values."""
    sketch = F.col(f"q_{column}")
    return F.when(F.kll_sketch_get_n_bigint(sketch) > 0, F.kll_sketch_get_quantile_bigint(sketch, F.lit(share)))


def unique(column: str) -> Column:
    return F.hll_sketch_estimate(f"u_{column}")


class _Counters:
    """Misra-Gries counters of the values of one column in one group."""

    def __init__(self, size: int):
        self.size, self.counts, self.lost = size, {}, 0

    def add(self, value: str, n: int) -> None:
        self.counts[value] = self.counts.get(value, 0) + n
        if len(self.counts) > 2 * self.size:
            # The first value that has no counter left takes its count from all.
            cut = sorted(self.counts.values(), reverse=True)[self.size]
            self.counts = {v: c - cut for v, c in self.counts.items() if c > cut}
            self.lost += cut


def _counted(df: DataFrame, by: Sequence[str], columns: Sequence[str], counters: int) -> DataFrame:
    """(by, col, val, n): at least n rows have the value; a row without value: at most n more rows have any value. Stored."""
    keys = [df.schema[c] for c in by]
    schema = T.StructType([*keys, T.StructField("col", T.StringType()), T.StructField("val", T.StringType()), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(schema)
    n_keys = len(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, _Counters] = {}

        def rows() -> pa.RecordBatch:
            out = []
            for key, own in held.items():
                out += [(*key, v, n) for v, n in own.counts.items()] + [(*key, None, own.lost)]
            columns_ = zip(*out, strict=True) if out else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns_, arrow)], schema=arrow)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            for column in columns:
                part = table.select([*by, column]).filter(table[column].is_valid()).group_by([*by, column]).aggregate([([], "count_all")])
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    key = (*row[:n_keys], column)
                    if key not in held:
                        held[key] = _Counters(counters)
                    held[key].add(row[n_keys], row[-1])
            if len(held) * 2 * counters > MAX_COUNTERS:
                yield rows()
                held.clear()
        yield rows()

    texts = df.select(*by, *[F.col(c).cast("string").alias(c) for c in columns])
    return store(texts.mapInArrow(count, schema), "counters")


def frequent_values(df: DataFrame, by: Sequence[str], columns: Sequence[str], k: int = 5, counters: int = COUNTERS) -> DataFrame:
    """The same rows as ``top_values``: the ``k`` most frequent values of each column with count, rank and share.

    Only candidates are counted over all rows, so a column of millions of values is not shuffled unless its counts are too even for the
    counters. The names of ``by`` and ``columns`` must differ.
    """
    place = [*by, "col"]
    counted = _counted(df, by, columns, counters)
    errors = counted.where("val is null").groupBy(*place).agg(F.sum("n").alias("error"))
    least = counted.where("val is not null").groupBy(*place, "val").agg(F.sum("n").alias("least"))
    falling = Window.partitionBy(*place).orderBy(F.desc("least"))
    last = least.withColumn("r", F.row_number().over(falling)).where(F.col("r") == k).select(*place, F.col("least").alias("last"))
    possible = least.join(errors, place).join(last, place, "left").where("last is null or least + error >= last").select(*place, "val")
    possible = store(possible, "candidates")
    if possible.count() <= SENT:
        possible = F.broadcast(possible)
    texts = df.select(*by, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(list(by), list(columns), "col", "val")
    exact = texts.join(possible, [*place, "val"], "left_semi").groupBy(*place, "val").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy(*place).orderBy(F.desc("n"), F.asc("val"))
    ranked = exact.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    # What is no candidate has at most ``error`` rows: the last of the k must have more.
    worst = ranked.groupBy(*place).agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("found"))
    # Of even counts no counter may be left at all.
    sure_of = F.expr(f"error = 0 or (coalesce(found, 0) = {k} and n > error)")
    checked = store(errors.join(worst, place, "left").withColumn("sure", sure_of), "checked")
    totals = value_totals(df, by, columns)
    sure = ranked.join(checked.where("sure").select(*place), place, "left_semi").join(totals, place)
    out = [*place, "val", "n", "rank", "ratio"]
    result = sure.withColumn("ratio", F.col("n") / F.col("total")).select(out)
    unsure = checked.where("not sure").select(*place)
    if unsure.isEmpty():
        return result
    whole = df.join(unsure.select(*by).distinct(), list(by), "left_semi") if by else df
    return result.unionByName(top_values(whole, by, columns, k).join(unsure, place, "left_semi").select(out))


