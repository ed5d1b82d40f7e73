"""Packets to verdicts: per capture, per batch of captures, per window."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.learning.models import TrafficModel
from trafficlens.operators.assemble import extract_features, window_features
from trafficlens.plans.reports import report_summary, window_summary
from trafficlens.schema import ENTITY, FIXED_FEATURES
from trafficlens.session import store
from trafficlens.settings import DEFAULT_LIVE_WINDOW, FeatureSettings
from trafficlens.sources import sinks


def feature_map(features: DataFrame) -> DataFrame:
    """The features of each row also as one MAP, without the absent ones."""
    pairs = [
        F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in FIXED_FEATURES if c in features.columns
    ]
    known = F.filter(F.array(*pairs), lambda p: p["v"].isNotNull())
    return features.withColumn("features", F.map_from_entries(known))


def score_features(model: TrafficModel, features: DataFrame) -> DataFrame:
    """Verdict rows of feature rows, one per capture."""
    rows = feature_map(features)
    scored = model.predict(rows, ["capture_file", "status", "features"])
    return scored.withColumn("error", F.when(F.col("prediction").isNull(), F.col("status")))


def score_captures(
    model: TrafficModel,
    packets: DataFrame,
    status: DataFrame | None = None,
    settings: FeatureSettings | None = None,
    tie: Sequence[str] = ("packet_no",),
) -> DataFrame:
    """Score all captures of a packet table; captures listed in ``status`` as failed keep a row.

    ``status``: (capture_file, status, packets, error), as the capture reader gives it.
    """
    features = extract_features(packets.drop("label"), ENTITY, settings, tie)
    scored = score_features(model, features)
    if status is not None:
        failed = F.col("s.status") == "error"
        joined = status.alias("s").join(scored.alias("r"), "capture_file", "full")
        scored = joined.select(
            "capture_file",
            F.when(failed, F.lit("error")).otherwise(F.coalesce(F.col("r.status"), F.lit("no_packets"))).alias("status"),
            F.when(~F.coalesce(failed, F.lit(False)), F.col("r.features")).alias("features"),
            *[F.when(~F.coalesce(failed, F.lit(False)), F.col(f"r.{c}")).alias(c)
              for c in ("prediction", "probability", "p_ddos", "p_normal")],
            F.when(failed, F.col("s.error"))
            .when(F.col("r.capture_file").isNull(), F.lit("no_packets"))
            .otherwise(F.col("r.error"))
            .alias("error"),
        )
    return scored.withColumnRenamed("capture_file", "file_name")


def score_capture(model: TrafficModel, packets: DataFrame, capture_file: str, **options) -> DataFrame:
    """Score one capture; the condition prunes the packet table before anything is aggregated."""
    return score_captures(model, packets.where(F.col("capture_file") == capture_file), **options)


def timed(results: DataFrame) -> DataFrame:
    """Run the scoring job and store its rows with ``processing_time``, the seconds of that job."""
    start = time.time()
    stored = store(results, "results")
    return stored.withColumn("processing_time", F.lit(time.time() - start))


def score_windows(
    model: TrafficModel,
    packets: DataFrame,
    window_size: int = DEFAULT_LIVE_WINDOW,
    settings: FeatureSettings | None = None,
    tie: Sequence[str] = ("packet_no",),
) -> DataFrame:
    """A verdict for each tumbling window of ``window_size`` packets of each capture."""
    features = window_features(packets.drop("label"), window_size, settings, tie)
    scored = model.predict(features, ["capture_file", "window_id", "status", "total_packets"])
    start = F.col("window_id") * window_size
    return scored.select(
        "capture_file",
        "window_id",
        start.alias("window_start"),
        (start + F.col("total_packets")).alias("window_end"),
        F.col("total_packets").alias("packet_count"),
        "status",
        "prediction",
        "probability",
    )


def analyze_windows(model: TrafficModel, packets: DataFrame, window_size: int = DEFAULT_LIVE_WINDOW, **options):
    """(window rows, summary per capture); the window rows are stored, both come from them."""
    windows = store(score_windows(model, packets, window_size, **options), "windows")
    return windows, window_summary(windows, window_size)


def save_results(results: DataFrame, path: str) -> str:
    return sinks.write_json(results, path)


def save_report(results: DataFrame, path: str) -> str:
    """``summary`` and ``results`` as JSON lines under ``path``."""
    sinks.write_json(report_summary(results), f"{path.rstrip('/')}/summary")
    sinks.write_json(results, f"{path.rstrip('/')}/results")
    return path
