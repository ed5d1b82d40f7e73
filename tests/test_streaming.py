from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_features import frame
from test_learning import FOREST, traffic

from trafficlens.catalog.shape import rounded
from trafficlens.learning import models
from trafficlens.operators.assemble import extract_features
from trafficlens.plans import scoring
from trafficlens.streaming import live


@pytest.fixture(scope="module")
def packets(spark):
    return frame(spark, traffic(6)).withColumn("timestamp", F.timestamp_micros("ts_us")).drop("ts_us")


@pytest.fixture()
def landed(packets, tmp_path):
    """Files out of order within each capture: odd packets first."""
    path = str(tmp_path / "landed")
    for odd in (1, 0):
        packets.where(F.col("packet_no") % 2 == odd).write.mode("append").parquet(path)
    return path


def test_rates_equal_batch_on_closed_windows(spark, packets, landed, tmp_path):
    stream = live.flow_rates(live.packet_stream(spark, landed, packets.schema, "0 seconds"), "1 second")
    out = str(tmp_path / "out")
    live.run_to_parquet(stream, out).awaitTermination()
    got = rounded(spark.read.schema(stream.schema).parquet(out))
    newest = packets.agg(F.max("timestamp")).first()[0]
    want = rounded(live.flow_rates(packets, "1 second")).where(F.col("window_end") <= F.lit(newest))
    assert want.count() > 0 or got.count() == 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_count_windows_do_not_depend_on_arrival_order(spark, packets, landed, tmp_path):
    stream = live.closed_windows(live.packet_stream(spark, landed, packets.schema, "1 hour", 1), 10, 10**6)
    out = str(tmp_path / "out")
    live.run_to_parquet(stream, out).awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(out)
    assert rows.count() == packets.count()
    spans = rows.groupBy("capture_file", "window_id").agg(F.min("packet_no").alias("a"), F.max("packet_no").alias("b"))
    assert spans.where("a = window_id * 10 and b = a + 9").count() == spans.count() == 18


def test_incomplete_windows_are_released_when_idle(spark, packets, tmp_path):
    """30 packets in windows of 20: the ten left over come out once event time has moved on."""
    landed = str(tmp_path / "landed")
    packets.write.parquet(landed)
    later = packets.where("capture_file = 'cap_01.pcap'").limit(1)
    for day in (1, 2):
        later.withColumn("timestamp", F.col("timestamp") + F.expr(f"interval {day} day")).withColumn(
            "capture_file", F.lit(f"later_{day}")
        ).write.mode("append").parquet(landed)
    stream = live.closed_windows(live.packet_stream(spark, landed, packets.schema, "1 hour", 1), 20, 60)
    out = str(tmp_path / "out")
    live.run_to_parquet(stream, out).awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(out).where("capture_file like 'cap%'")
    assert rows.count() == packets.count()


def test_live_verdicts_equal_batch(spark, packets, landed, tmp_path):
    labelled = packets.withColumn("label", F.when(F.substring("capture_file", 5, 2).cast("int") % 3 == 0, "ddos").otherwise("normal"))
    model = models.train(extract_features(labelled), FOREST)
    out = str(tmp_path / "verdicts")
    live.live_verdicts(live.packet_stream(spark, landed, packets.schema, "1 hour", 1), model, out, 15).awaitTermination()
    got = spark.read.parquet(out).drop("batch")
    want = scoring.score_windows(model, packets, 15)
    assert got.count() == 12
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_batch_is_stored_before_it_is_scored(spark, packets, landed, tmp_path, monkeypatch):
    """Scoring reads its rows many times, which must not work through the stream's state each time; empty batches are not computed."""
    labelled = packets.withColumn("label", F.when(F.substring("capture_file", 5, 2).cast("int") % 3 == 0, "ddos").otherwise("normal"))
    model = models.train(extract_features(labelled), FOREST)
    plans = []

    def seen(model, rows, size):
        plans.append(rows._jdf.queryExecution().toString())
        return scoring.score_windows(model, rows, size)

    monkeypatch.setattr(live, "score_windows", seen)
    stream = live.packet_stream(spark, landed, packets.schema, "1 hour", 1)
    live.live_verdicts(stream, model, str(tmp_path / "verdicts"), 15).awaitTermination()
    # A batch that is not stored is a scan of the stream's own rows.
    assert plans and all("FileScan parquet" in plan and "ExistingRDD" not in plan for plan in plans)


class State:
    """A value or a list of a handle, and what is done to it."""

    def __init__(self):
        self.value, self.calls = None, []

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def appendValue(self, value):
        self.calls.append("append")
        self.value = [*(self.value or []), value]

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getValueState(self, name, schema):
        return self.states.setdefault(name, State())

    getListState = getValueState

    def registerTimer(self, timer):
        self.timers.append(timer)

    deleteTimer = registerTimer


class Times:
    def getCurrentWatermarkInMs(self):
        return 0


def window_rows(numbers):
    return pd.DataFrame({"packet_no": numbers, "packet_length": [10 * n for n in numbers], live.TIME_US: [1000 * n for n in numbers]})


@pytest.mark.parametrize("parts", [[[0, 1, 2, 3]], [[2, 0], [1, 2, 3]], [[3], [0], [1], [2, 2]]])
def test_what_completes_a_window_is_not_kept_first(parts):
    for kind, name in ((live._Packets, "packets"), (live._Totals, "sums")):
        processor, handle = kind(4, 60), Handle()
        processor.init(handle)
        out = []
        for numbers in parts:
            assert not out
            out += processor.handleInputRows(("a", 0), iter([window_rows(numbers)]), Times())
        writes = [c for c in handle.states[name].calls if c in ("append", "update")]
        assert len(writes) == len(parts) - 1 and handle.states[name].value is None
        if kind is live._Packets:
            assert sorted(pd.concat(out)["packet_no"]) == [0, 1, 2, 3]
        else:
            (row,) = pd.concat(out).to_dict("records")
            assert (row["packet_count"], row["first_no"], row["last_no"], row["bytes"], row["first_us"], row["last_us"]) == (4, 0, 3, 60, 0, 3000)
        # The window is given once; what comes again is dropped.
        assert not list(processor.handleInputRows(("a", 0), iter([window_rows([1, 2])]), Times()))
