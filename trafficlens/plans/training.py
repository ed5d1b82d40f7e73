"""From raw folders to a saved model."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.learning.models import TrafficModel, cross_validate, cv_summary, train
from trafficlens.operators.assemble import extract_features
from trafficlens.plans.reports import distribution
from trafficlens.schema import ENTITY
from trafficlens.session import store
from trafficlens.settings import FeatureSettings, ModelSettings
from trafficlens.sources import tables
from trafficlens.sources.captures import CaptureFolder, read_captures


@dataclass
class TrainingResult:
    model: TrafficModel
    metrics: dict[str, dict[str, float]]
    model_path: str | None
    training_time: float
    classes: DataFrame
    importances: DataFrame
    cv: DataFrame | None = None
    #: Status of every input file (see ``input_status``); read when it is asked for.
    inputs: DataFrame | None = None


def input_status(spark: SparkSession, folders: Sequence[dict[str, Any]]) -> DataFrame:
    """capture_file, status, rows, error, folder and label of every file of the folders: what is broken or left out in part."""
    parts = []
    for f in folders:
        kind = f.get("kind", "parquet")
        if kind == "capture":
            found = CaptureFolder(spark, f["folder"]).status().withColumnRenamed("packets", "rows")
        else:
            found = tables.table_status(spark, f["folder"], kind)
        parts.append(found.select("capture_file", "status", "rows", "error", F.lit(f["folder"]).alias("folder"), F.lit(f.get("label")).cast("string").alias("label")))
    return tables.stack(parts)


def features_of_folder(
    spark: SparkSession,
    folder: str,
    label: str | None = None,
    kind: str = "parquet",
    settings: FeatureSettings | None = None,
) -> DataFrame:
    """Feature rows of every file of a folder.

    ``kind``: ``parquet``, ``csv`` or ``capture``. Without ``label`` the label follows
    from the file names, and files that match no rule are left out. Captures and CSV are
    decoded once and landed, as the parts of a feature row each read the packets.
    """
    if kind == "capture":
        packets = store(read_captures(spark, folder), "packets")
    elif kind == "parquet":
        packets = tables.with_file(tables.read_parquet_dir(spark, folder), folder)
    elif kind == "csv":
        packets = store(tables.good_rows(tables.read_packets_csv(spark, folder)), "packets")
    else:
        raise ValueError(f"unknown kind of folder: {kind}")
    if label is None:
        packets = tables.with_label_from_name(packets).where(F.col("label").isNotNull())
    else:
        packets = tables.with_label(packets, label)
    # CSV rows are ordered by split and line, everything else by packet number.
    return extract_features(packets, ENTITY, settings, tie=("packet_no", "file_order"))


def train_from_features(
    labelled: Sequence[tuple[DataFrame, str]],
    settings: ModelSettings | None = None,
    key: Sequence[str] = ENTITY,
    model_path: str | None = None,
    folds: int = 0,
) -> TrainingResult:
    """Stack labelled feature tables (own labels win), train, and save on request."""
    settings = settings or ModelSettings()
    stacked = tables.combine_features([tables.resolve_label(df, label) for df, label in labelled])
    features = store(stacked, "features")
    start = time.time()
    model = train(features, settings, key, stored=True)
    seconds = time.time() - start
    if model_path:
        model.save(model_path)
    cv = cv_summary(cross_validate(features, settings, key, folds)) if folds else None
    return TrainingResult(
        model=model,
        metrics=model.metrics,
        model_path=model_path,
        training_time=seconds,
        classes=distribution(features, "label"),
        importances=model.importances(features.sparkSession),
        cv=cv,
    )


def run_training(
    spark: SparkSession,
    folders: Sequence[dict[str, Any]],
    model_path: str | None = None,
    feature_settings: FeatureSettings | None = None,
    model_settings: ModelSettings | None = None,
    folds: int = 0,
) -> TrainingResult:
    """The full run: ``folders`` is a list of {folder, label, kind}."""
    tables_ = [
        (features_of_folder(spark, f["folder"], f.get("label"), f.get("kind", "parquet"), feature_settings),
         f.get("label") or "")
        for f in folders
    ]
    if not tables_:
        raise ValueError("no folders to train on")
    result = train_from_features(tables_, model_settings, ENTITY, model_path, folds)
    result.inputs = input_status(spark, folders)
    return result
