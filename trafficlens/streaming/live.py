"""Packets as a stream: time-window rates and count windows with verdicts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trafficlens.learning.models import TrafficModel
from trafficlens.operators.counted import MICROS, aggregates, four_stats
from trafficlens.operators.livewindows import with_window_id
from trafficlens.operators.tallies import flow_key
from trafficlens.plans.scoring import score_windows
from trafficlens.session import fresh_path
from trafficlens.settings import DEFAULT_LIVE_WINDOW


def packet_stream(
    spark: SparkSession, folder: str, schema: T.StructType, delay: str = "10 minutes", files_per_trigger: int | None = None
) -> DataFrame:
    """Packets from Parquet files as they land, late ones dropped after ``delay``."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withWatermark("timestamp", delay)


def write_marker(spark: SparkSession, folder: str, schema: T.StructType, past: str = "60 days") -> None:
    """Land a last file with one empty packet, ``past`` after the newest one.

    It moves the watermark beyond all open windows, so that a stream over a finished folder gives all of them. Its own
    windows (of no capture) stay open and are never given.
    """
    newest = spark.read.schema(schema).parquet(folder).agg(F.max("timestamp").alias("timestamp"))
    fields = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name != "timestamp"]
    marker = newest.select((F.col("timestamp") + F.expr(f"interval {past}")).alias("timestamp"), *fields)
    marker.select(*schema.names).coalesce(1).write.mode("append").parquet(folder)


def flow_rates(packets: DataFrame, width: str = "1 minute", by: Sequence[str] = ("capture_file",)) -> DataFrame:
    """Packets, bytes, rates and flow statistics per event-time window and capture.

    Two chained aggregations: first per window and flow, with map-side combining, then
    per window. The same code serves batch and stream. Packets that belong to no flow
    (a missing member of the key) count in the totals only.
    """
    key = flow_key(packets.columns)
    per_flow = packets.groupBy(F.window("timestamp", width), *by, *key).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.col("packet_length").cast("bigint")), F.lit(0)).alias("bytes"),
        F.min(F.unix_micros("timestamp")).alias("t0"),
        F.max(F.unix_micros("timestamp")).alias("t1"),
    )
    is_flow = " and ".join(f"{c} is not null" for c in key) or "true"
    stats = (
        four_stats("packets_per_flow", "n", f"filter (where {is_flow})")
        | four_stats("bytes_per_flow", "bytes", f"filter (where {is_flow})")
        | four_stats("flow_duration", "(t1 - t0) / 1e6D", f"filter (where {is_flow} and n > 1 and t1 > t0)")
    )
    span = (F.col("_t1") - F.col("_t0")) / MICROS
    return (
        per_flow.groupBy(F.window("window", width).alias("window"), *by)
        .agg(
            F.sum("n").alias("total_packets"),
            F.sum("bytes").alias("total_bytes"),
            F.min("t0").alias("_t0"),
            F.max("t1").alias("_t1"),
            F.expr(f"count(*) filter (where {is_flow}) as flow_count"),
            *aggregates(stats),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            *by,
            "total_packets",
            "total_bytes",
            F.when(span > 0, F.col("total_packets") / span).alias("packets_per_second"),
            F.when(span > 0, F.col("total_bytes") / span).alias("bytes_per_second"),
            "flow_count",
            *stats,
        )
    )


def _pack(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(held).read_all().to_pandas()


class _Windows(StatefulProcessor):
    """What all processors of count windows share: one state per (capture, window), of fixed size.

    ``seen`` has a bit for each packet of the window, so a packet that comes twice counts once. A window is given when it is complete or
    when its timer goes off, and its state stays, marked as given, until the timer does.
    """

    FIELDS = "seen binary, given boolean, last_ms bigint, timer_ms bigint"

    def __init__(self, window_size: int, idle_seconds: int):
        self.size, self.idle_ms = window_size, idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", self.FIELDS)

    def fresh(self, seen: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Which of the packets are new; their bits are set."""
        place = numbers % self.size
        first = np.zeros(len(place), dtype=bool)
        first[np.unique(place, return_index=True)[1]] = True
        fresh = first & (seen[place] == 0)
        seen[place] = 1
        return fresh

    def wait(self, old: int | None, last_ms: int | None, timers) -> int:
        """The time at which the window is given up: ``idle_ms`` after its newest packet; where no packet has a time, after the watermark."""
        now = timers.getCurrentWatermarkInMs()
        timer = max((now if last_ms is None else last_ms) + self.idle_ms, now + 1)
        if old != timer:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timer)
        return timer

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.window.get()
        seen, given, last_ms, timer = held if held else (None, False, None, None)
        arrived = []
        bits = np.zeros(self.size, np.uint8) if seen is None else np.unpackbits(np.frombuffer(seen, np.uint8), count=self.size)
        for batch in rows:
            batch = batch[batch["packet_no"].notna()]  # a packet without a number belongs to no window
            times = batch[TIME_US].dropna()
            if len(times):
                last_ms = max(last_ms if last_ms is not None else -(1 << 62), int(times.max()) // 1000)
            fresh = self.fresh(bits, batch["packet_no"].to_numpy().astype(np.int64))
            if not given and fresh.any():
                arrived.append(batch[fresh])
        complete = bool(bits.all())
        timer = self.wait(timer, last_ms, timerValues)
        self.window.update((np.packbits(bits).tobytes(), given or complete, last_ms, timer))
        if complete and not given:
            # What completes a window is not kept first: a window that arrives at once is given without being stored.
            yield from self.give(key, arrived, bool(held))
        else:
            for rows in arrived:
                self.keep(rows)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen, given, last_ms, timer = self.window.get() or (None, True, None, None)
        if not given and last_ms is None and timer <= self.idle_ms + 1:
            # Set before the stream had a watermark, and without a time of its own: idle time begins now.
            self.window.update((seen, given, last_ms, self.wait(None, None, timerValues)))
            return
        if not given:
            yield from self.give(key)
        self.window.clear()

    def close(self) -> None:
        """Nothing to close."""

    def keep(self, rows: pd.DataFrame) -> None:
        raise NotImplementedError

    def give(self, key, arrived: Sequence[pd.DataFrame] = (), kept: bool = True) -> Iterator[pd.DataFrame]:
        """The window's rows, those that are kept and then those that arrived just now; what is kept of them is forgotten."""
        raise NotImplementedError


class _Packets(_Windows):
    """Packets as they came, each batch's as one element of a list that is only added to until the window is given."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.chunks = handle.getListState("packets", "chunk binary")

    def keep(self, rows: pd.DataFrame) -> None:
        self.chunks.appendValue((_pack(rows),))

    def give(self, key, arrived: Sequence[pd.DataFrame] = (), kept: bool = True) -> Iterator[pd.DataFrame]:
        # Parts are handed on one by one: a column without values in one of them has no type in common with the others.
        parts = []
        if kept:
            parts = [_unpack(chunk) for (chunk,) in self.chunks.get()]
            self.chunks.clear()
        yield from parts
        yield from arrived


class _Totals(_Windows):
    """Partial sums instead of packets."""

    SUMS = "packet_count bigint, first_no bigint, last_no bigint, bytes bigint, first_us bigint, last_us bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.sums = handle.getValueState("sums", self.SUMS)

    @staticmethod
    def added(sums: tuple | None, rows: pd.DataFrame) -> tuple:
        numbers, times = rows["packet_no"], rows[TIME_US].dropna()
        n, first, last, size, t0, t1 = sums or (0, None, None, 0, None, None)
        least = lambda a, b: b if a is None else a if b is None else min(a, b)
        most = lambda a, b: b if a is None else a if b is None else max(a, b)
        low, high = (int(times.min()), int(times.max())) if len(times) else (None, None)
        return (
            n + len(rows),
            least(first, int(numbers.min())),
            most(last, int(numbers.max())),
            size + int(rows["packet_length"].fillna(0).sum()),
            least(t0, low),
            most(t1, high),
        )

    def keep(self, rows: pd.DataFrame) -> None:
        self.sums.update(self.added(self.sums.get(), rows))

    def give(self, key, arrived: Sequence[pd.DataFrame] = (), kept: bool = True) -> Iterator[pd.DataFrame]:
        names = [field.split()[0] for field in self.SUMS.split(", ")]
        sums = self.sums.get() if kept else None
        for rows in arrived:
            sums = self.added(sums, rows)
        if not sums:
            return
        if kept:
            self.sums.clear()
        row = dict(zip(("capture_file", "window_id"), key, strict=True)) | dict(zip(names, sums, strict=True))
        yield pd.DataFrame([row]).astype({c: "Int64" for c in names})


#: Rows reach a processor as named tuples, which allow no leading underscore.
TIME_US = "time_us_"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _by_window(packets: DataFrame, window_size: int, processor: StatefulProcessor, schema: T.StructType | str) -> DataFrame:
    # Typed state needs the store on disk; it also keeps the state out of the executors' heap.
    packets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    numbered = with_window_id(packets, window_size).withColumn(TIME_US, F.unix_micros("timestamp"))
    return numbered.groupBy("capture_file", "window_id").transformWithStateInPandas(processor, schema, "append", "EventTime")


def closed_windows(packets: DataFrame, window_size: int = DEFAULT_LIVE_WINDOW, idle_seconds: int = 600) -> DataFrame:
    """The packets of each count window, let through once the window is complete.

    State is kept per (capture, window) and not per capture: the packet's own number tells
    its window, so a busy capture spreads over all tasks, arrival order does not matter,
    and a state never holds more than ``window_size`` packets. A window that stays
    incomplete (the end of a capture) is released ``idle_seconds`` of event time after its
    last packet; packets without a time count as of the watermark's. A packet that comes twice counts
    once; what comes after its window was released is dropped until the window's time is over.
    """
    schema = with_window_id(packets, window_size).schema
    return _by_window(packets, window_size, _Packets(window_size, idle_seconds), schema)


def window_totals(packets: DataFrame, window_size: int = DEFAULT_LIVE_WINDOW, idle_seconds: int = 600) -> DataFrame:
    """Packets, first and last number, bytes and times of each count window, released as by ``closed_windows``.

    State holds sums and one bit per packet, whatever the packets are.
    """
    schema = f"capture_file string, window_id bigint, {_Totals.SUMS}"
    return _by_window(packets, window_size, _Totals(window_size, idle_seconds), schema)


def with_counts(packets: DataFrame, width: str = "1 minute", by: Sequence[str] = ("capture_file",)) -> DataFrame:
    """``flow_rates`` of a stream, with the packets that arrive and those that are given counted batch by batch (see ``batch_counts``)."""
    arrived = packets.observe("arrived", F.count("timestamp").alias("packets"), F.count_if(F.col("timestamp").isNull()).alias("without_time"))
    return flow_rates(arrived, width, by).observe("given", F.sum("total_packets").alias("packets"))


def batch_counts(query: StreamingQuery, seconds: float = 5.0) -> DataFrame:
    """Wait for the end of a query over ``with_counts``; one row per batch: batch, watermark, arrived, given, late_groups.

    ``arrived`` less ``given`` is what is still open or came too late; once all windows are closed it is what the watermark dropped.
    ``late_groups`` counts the dropped rows after they were summed up per window and flow. (Spark keeps the last hundred batches for the
    driver; they are fetched every few seconds.)
    """
    rows: dict[int, tuple] = {}
    over = False
    while not over:
        over = query.awaitTermination(seconds) is not False
        for p in query.recentProgress:
            seen = {name: row.asDict() for name, row in p.observedMetrics.items()}
            late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators[-1:])
            arrived, given = (seen.get(name, {}).get("packets") or 0 for name in ("arrived", "given"))
            rows[p.batchId] = (p.batchId, p.eventTime.get("watermark"), arrived, given, late)
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(sorted(rows.values()), "batch bigint, watermark string, arrived bigint, given bigint, late_groups bigint")


def run_to_parquet(df: DataFrame, path: str, mode: str = "append") -> StreamingQuery:
    """Process all that has landed and stop; files are written exactly once."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", fresh_path(df.sparkSession, "progress"))
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )


def live_verdicts(
    packets: DataFrame,
    model: TrafficModel,
    path: str,
    window_size: int = DEFAULT_LIVE_WINDOW,
    idle_seconds: int = 600,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Verdict rows of closed count windows, written batch by batch.

    A batch goes to its own ``batch=<n>`` folder and replaces it when it is repeated after
    a failure, so every window appears once.
    """
    spark = packets.sparkSession

    def score(batch: DataFrame, number: int) -> None:
        # Features read the packets many times, and each time the stream's state would be worked through again. The stored rows are
        # read by the session from outside, as that of the stream runs without AQE.
        stored = fresh_path(spark, "closed")
        batch.drop("window_id").write.parquet(stored)
        rows = spark.read.schema(batch.drop("window_id").schema).parquet(stored)
        scored = score_windows(model, rows, window_size)
        if rows.isEmpty():
            scored = scored.limit(0)  # known to be empty, so nothing is computed
        scored.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        closed_windows(packets, window_size, idle_seconds)
        .writeStream.foreachBatch(score)
        .option("checkpointLocation", checkpoint or fresh_path(packets.sparkSession, "progress"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
