"""Training, tuning, saving and applying classifiers."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.learning.evaluate import metrics
from trafficlens.learning.prepare import (
    align,
    feature_names,
    make_scaler,
    with_folds,
    with_split,
    with_weights,
)
from trafficlens.operators.assemble import STATUS_OK
from trafficlens.session import store
from trafficlens.settings import DDOS, NORMAL, ModelSettings

WEIGHT = "weight"


def make_classifier(settings: ModelSettings, inputs: int, classes: int = 2) -> Estimator:
    """The classifier named in the settings, on ``scaled`` against ``label_index``.

    ``boosted_trees`` draws features per node, and ``neural_network`` is a sigmoid network
    fitted by L-BFGS; both play the part of the usual libraries' models without matching
    their weights.
    """
    common = {"featuresCol": "scaled", "labelCol": "label_index", "predictionCol": "prediction_index"}
    if settings.model_type == "random_forest":
        s = settings.random_forest
        weight = {"weightCol": WEIGHT} if s.class_weight == "balanced" else {}
        return RandomForestClassifier(
            numTrees=s.n_estimators, maxDepth=s.max_depth, minInstancesPerNode=s.min_samples_leaf,
            bootstrap=s.bootstrap, featureSubsetStrategy="sqrt", seed=s.random_state, **weight, **common,
        )
    if settings.model_type in ("boosted_trees", "xgboost"):
        s = settings.boosted_trees
        return GBTClassifier(
            maxIter=s.n_estimators, maxDepth=s.max_depth, stepSize=s.learning_rate, subsamplingRate=s.subsample,
            featureSubsetStrategy=str(s.colsample), seed=s.random_state, **common,
        )
    if settings.model_type == "neural_network":
        s = settings.neural_network
        return MultilayerPerceptronClassifier(
            layers=[inputs, *s.hidden_layers, classes], maxIter=s.max_iter, seed=s.random_state, **common
        )
    raise ValueError(f"no such kind of model: {settings.model_type}")


def make_pipeline(settings: ModelSettings, names: Sequence[str]) -> Pipeline:
    return Pipeline(
        stages=[
            StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc"),
            VectorAssembler(inputCols=list(names), outputCol="raw"),
            make_scaler(settings.scaling, "raw", "scaled"),
            make_classifier(settings, len(names)),
        ]
    )


def training_rows(features: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Labelled rows of groups that had enough packets, aligned to ``names``."""
    usable = features.where(F.col("label").isNotNull())
    if "status" in features.columns:
        usable = usable.where(F.col("status") == STATUS_OK)
    return align(usable, names, ["label", *keep])


@dataclass
class TrafficModel:
    """A fitted pipeline; names and classes are part of its stages."""

    pipeline: PipelineModel
    metrics: dict[str, dict[str, float]] = field(default_factory=dict)

    @property
    def feature_names(self) -> list[str]:
        return next(s for s in self.pipeline.stages if isinstance(s, VectorAssembler)).getInputCols()

    @property
    def labels(self) -> list[str]:
        return next(s for s in self.pipeline.stages if isinstance(s, StringIndexerModel)).labels

    def save(self, path: str) -> str:
        self.pipeline.write().overwrite().save(path)
        return path

    @staticmethod
    def load(path: str) -> TrafficModel:
        return TrafficModel(PipelineModel.load(path))

    def predict(self, features: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
        """Add ``prediction`` (class name), ``probability`` of it, ``p_ddos`` and ``p_normal``.

        Columns are brought into training order; missing ones are 0. Groups with too few
        packets keep their row and get no verdict.
        """
        names, labels = self.feature_names, self.labels
        kept = list(keep) if keep is not None else [c for c in features.columns if c not in names]
        rows = align(features, names, [c for c in kept if c not in names])
        if "label" in rows.columns:
            # The label is not an input; set aside so that unknown labels do not matter.
            rows = rows.withColumnRenamed("label", "_label")
        scored = self.pipeline.transform(rows)
        ready = F.col("status") == STATUS_OK if "status" in rows.columns else F.lit(True)
        shares = vector_to_array(F.col("probability"))
        index = F.col("prediction_index").cast("int")

        def of(label: str) -> Column:
            at = labels.index(label) if label in labels else None
            return F.lit(0.0) if at is None else F.when(ready, shares[at])

        kinds = {f.name: f.dataType for f in features.schema.fields}
        out = [
            F.col("_label").alias("label") if c == "label" else F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in kept
        ]
        return scored.select(
            *out,
            F.when(ready, F.element_at(F.array(*[F.lit(x) for x in labels]), index + 1)).alias("prediction"),
            F.when(ready, F.get(shares, index)).alias("_share"),
            of(DDOS).alias("p_ddos"),
            of(NORMAL).alias("p_normal"),
        ).withColumnRenamed("_share", "probability")

    def evaluate(self, features: DataFrame) -> dict[str, float]:
        scored = self.predict(features, ["label", *(["status"] if "status" in features.columns else [])])
        return score_metrics(scored, self.labels)

    def info(self, spark: SparkSession) -> dict[str, Any]:
        """Kind of model, its inputs and classes, and the five most important features."""
        last = self.pipeline.stages[-1]
        known = {p.name: last.getOrDefault(p) for p in last.params if last.hasDefault(p) or last.isSet(p)}
        shape = {name: known[name] for name in ("numTrees", "maxIter", "maxDepth", "layers") if name in known}
        top = {r["feature"]: r["importance"] for r in self.importances(spark, 5).collect()}
        return {
            "model_type": type(last).__name__, "num_features": len(self.feature_names),
            "features": self.feature_names, "labels": self.labels, "top_features": top, **shape,
        }

    def importances(self, spark: SparkSession, top_n: int = 20) -> DataFrame:
        """(rank, feature, importance), largest first; empty for models without importances."""
        schema = "rank int, feature string, importance double"
        values = getattr(self.pipeline.stages[-1], "featureImportances", None)
        if values is None:
            return spark.createDataFrame([], schema)
        ranked = sorted(zip(self.feature_names, values.toArray()), key=lambda x: (-x[1], x[0]))[:top_n]
        return spark.createDataFrame([(i, n, float(v)) for i, (n, v) in enumerate(ranked, 1)], schema)


def score_metrics(scored: DataFrame, labels: Sequence[str]) -> dict[str, float]:
    """Metrics of a scored table. Class 1 is the second name in order, as for 0/1 labels."""
    positive = labels[1] if len(labels) > 1 else labels[0]
    column = {DDOS: "p_ddos", NORMAL: "p_normal"}.get(positive)
    return metrics(scored, "label", "prediction", positive, column)


def _fit(rows: DataFrame, names: Sequence[str], settings: ModelSettings) -> TrafficModel:
    return TrafficModel(make_pipeline(settings, names).fit(with_weights(rows)))


def train(
    features: DataFrame,
    settings: ModelSettings | None = None,
    key: Sequence[str] = ("capture_file",),
    stored: bool = False,
) -> TrafficModel:
    """Split 80/20 within classes, fit scaler and model on the first part, score both.

    The feature table is stored first (one row per group): fitting reads it many times,
    and a lost executor must not cause packets to be aggregated again.
    """
    settings = settings or ModelSettings()
    features = features if stored else store(features, "features")
    names = feature_names(features)
    rows = training_rows(features, names, key)
    row_key = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    parts = store(with_split(rows, row_key, test_size=settings.eval_split, seed=settings.seed), "split")
    learn, check = parts.where(F.col("part") == "train"), parts.where(F.col("part") == "eval")
    model = _fit(learn, names, settings)
    model.metrics = {
        "train": score_metrics(model.predict(learn, ["label"]), model.labels),
        "eval": score_metrics(model.predict(check, ["label"]), model.labels),
    }
    return model


def _folded(features: DataFrame, settings: ModelSettings, key: Sequence[str], folds: int):
    features = store(features, "features")
    names = feature_names(features)
    row_key = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    rows = training_rows(features, names, key)
    return store(with_folds(rows, row_key, folds=folds, seed=settings.seed), "folds"), names


def cross_validate(
    features: DataFrame,
    settings: ModelSettings | None = None,
    key: Sequence[str] = ("capture_file",),
    folds: int | None = None,
) -> DataFrame:
    """(metric, fold, score): the scaler is fitted inside each fold."""
    settings = settings or ModelSettings()
    folds = folds or settings.cv_folds
    rows, names = _folded(features, settings, key, folds)
    out = []
    for fold in range(folds):
        model = _fit(rows.where(F.col("fold") != fold), names, settings)
        found = score_metrics(model.predict(rows.where(F.col("fold") == fold), ["label"]), model.labels)
        out += [(m, fold, float(found[m])) for m in settings.scoring if m in found]
    schema = T.StructType(
        [
            T.StructField("metric", T.StringType()),
            T.StructField("fold", T.IntegerType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    return features.sparkSession.createDataFrame(out, schema)


def cv_summary(scores: DataFrame) -> DataFrame:
    """Mean and (population) deviation of each metric over the folds."""
    return scores.groupBy("metric").agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count(F.lit(1)).alias("folds")
    )


# Setting name to parameter name of the Spark classifier, per model type.
GRID_NAMES = {
    "random_forest": {"n_estimators": "numTrees", "max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode"},
    "boosted_trees": {"n_estimators": "maxIter", "max_depth": "maxDepth", "learning_rate": "stepSize",
                      "subsample": "subsamplingRate"},
    "neural_network": {"max_iter": "maxIter"},
}


def grid_search(
    features: DataFrame,
    grid: Mapping[str, Sequence[Any]],
    settings: ModelSettings | None = None,
    key: Sequence[str] = ("capture_file",),
    folds: int | None = None,
) -> tuple[TrafficModel, dict[str, Any], float, DataFrame]:
    """Best model by weighted F1, refitted on all rows: (model, parameters, score, all scores)."""
    settings = settings or ModelSettings()
    folds = folds or settings.cv_folds
    rows, names = _folded(features, settings, key, folds)
    pipeline = make_pipeline(settings, names)
    classifier = pipeline.getStages()[-1]
    known = GRID_NAMES["boosted_trees" if settings.model_type == "xgboost" else settings.model_type]
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(classifier.getParam(known.get(name, name)), list(values))
    search = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=builder.build(),
        evaluator=MulticlassClassificationEvaluator(
            labelCol="label_index", predictionCol="prediction_index", metricName="f1"
        ),
        foldCol="fold",
        numFolds=folds,
        parallelism=2,
    )
    found = search.fit(with_weights(rows))
    combos = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    by_combo = []
    for params, score, std in zip(found.getEstimatorParamMaps(), found.avgMetrics, found.stdMetrics):
        named = {p.name: v for p, v in params.items()}
        combo = next(c for c in combos if all(named[known.get(k, k)] == v for k, v in c.items()))
        by_combo.append((combo, float(score), float(std)))
    best, score, _ = max(by_combo, key=lambda x: x[1])
    table = features.sparkSession.createDataFrame(
        [({k: str(v) for k, v in c.items()}, s, d) for c, s, d in by_combo],
        "params map<string,string>, mean_f1 double, std_f1 double",
    )
    return TrafficModel(found.bestModel), best, score, table


def with_params(settings: ModelSettings, **params: Any) -> ModelSettings:
    """Settings with changed parameters of the chosen model."""
    part = "boosted_trees" if settings.model_type == "xgboost" else settings.model_type
    return replace(settings, **{part: replace(getattr(settings, part), **params)})
