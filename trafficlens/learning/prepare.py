"""Feature rows to model input: vocabulary, alignment, weights, splits, scaling."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, MinMaxScaler, StandardScaler, VarianceThresholdSelector
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.functions.expressions import hash_order
from trafficlens.operators.ordering import with_position
from trafficlens.schema import FIXED_FEATURES, MAP_FEATURES

MAX_VOCABULARY = 10_000
MAX_CLASSES = 1_000


def vocabulary(features: DataFrame) -> list[str]:
    """Names of the value-named features seen, such as ``protocol_6_ratio``, in order.

    The values are protocol numbers, flag texts, ICMP types and HTTP methods: small
    domains. A table that breaks this is refused instead of being cut.
    """
    maps = [m for m in MAP_FEATURES if m in features.columns]
    if not maps:
        return []
    names = [
        features.select(F.explode(F.map_keys(m)).alias("val"))
        .select(F.concat(F.lit(m.removesuffix("ratio")), "val", F.lit("_ratio")).alias("name"))
        .distinct()
        for m in maps
    ]
    rows = reduce(DataFrame.unionByName, names).limit(MAX_VOCABULARY + 1).collect()
    if len(rows) > MAX_VOCABULARY:
        raise ValueError(f"more than {MAX_VOCABULARY} value-named features; check the flag and method columns")
    return sorted(r["name"] for r in rows)


def feature_names(features: DataFrame) -> list[str]:
    """Model input columns of a feature table: fixed ones present, then the vocabulary."""
    return [c for c in FIXED_FEATURES if c in features.columns] + vocabulary(features)


def _value_of(name: str, columns: Sequence[str]) -> str:
    """SQL value of a model input: the column, the entry of a map, or 0."""
    if name in columns:
        return f"coalesce(cast(`{name}` as double), 0D)"
    for m in MAP_FEATURES:
        prefix = m.removesuffix("ratio")
        if m in columns and name.startswith(prefix) and name.endswith("_ratio"):
            key = name[len(prefix) : -len("_ratio")].replace("\\", "\\\\").replace("'", "\\'")
            return f"coalesce(try_element_at({m}, '{key}'), 0D)"
    return "0D"


def align(features: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` and exactly ``names``, in that order: missing ones 0, extra ones dropped."""
    kept = [f"`{c}`" for c in keep if c in features.columns]
    return features.selectExpr(*kept, *[f"{_value_of(n, features.columns)} as `{n}`" for n in names])


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))


def _class_table(df: DataFrame, label: str) -> DataFrame:
    """Classes, their rows and balanced weights as a small local table.

    The number of classes is checked, so this table may be broadcast: a join with it
    leaves the rows where they are, although a class may hold most of them.
    """
    rows = class_counts(df, label).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes in column {label}")
    total = sum(r["count"] for r in rows)
    weighted = [(r[label], r["count"], total / (len(rows) * r["count"])) for r in rows]
    schema = T.StructType(
        [df.schema[label], T.StructField("count", T.LongType()), T.StructField("weight", T.DoubleType())]
    )
    return df.sparkSession.createDataFrame(weighted, schema)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights: rows / (classes * rows of the class)."""
    return _class_table(df, label)


def with_weights(df: DataFrame, label: str = "label") -> DataFrame:
    return df.join(F.broadcast(_class_table(df, label).select(label, "weight")), label)


def _in_hash_order(df: DataFrame, label: str, key: Column, seed: int) -> DataFrame:
    """0-based position of each row in its class, in a repeatable random order."""
    hashed = df.withColumn("_hash", hash_order(key, seed))
    return with_position(hashed, [label], ["_hash"], "_position")


def with_split(
    df: DataFrame, key: Column, label: str = "label", test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``part``: ``train`` or ``eval``, the same share of each class.

    A class may hold most rows, so positions come from ``with_position`` and class sizes
    from a broadcast table of classes instead of a window over the whole class.
    """
    sizes = _class_table(df, label).select(label, F.col("count").alias("_size"))
    rank = F.col("_position") / F.greatest(F.col("_size") - 1, F.lit(1))
    return (
        _in_hash_order(df, label, key, seed)
        .join(F.broadcast(sizes), label)
        .withColumn("part", F.when(rank < 1 - test_size, "train").otherwise("eval"))
        .select(*df.columns, "part")
    )


def with_folds(df: DataFrame, key: Column, label: str = "label", folds: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` in 0..folds-1, evenly within each class."""
    placed = _in_hash_order(df, label, key, seed)
    return placed.select(*df.columns, F.pmod("_position", F.lit(folds)).cast("int").alias("fold"))


class PopulationScaler(Estimator, HasInputCol, HasOutputCol):
    """z-scores with the population deviation; columns without spread become 0.

    Spark's scaler divides by the sample deviation; a constant factor turns one into the other.
    """

    def __init__(self, inputCol: str, outputCol: str):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        rows = dataset.count()
        middle = f"{self.getOutputCol()}_sample"
        scaler = StandardScaler(inputCol=self.getInputCol(), outputCol=middle, withMean=True, withStd=True)
        model = scaler.fit(dataset)
        factor = math.sqrt(rows / (rows - 1)) if rows > 1 else 1.0
        product = ElementwiseProduct(
            inputCol=middle, outputCol=self.getOutputCol(), scalingVec=Vectors.dense([factor] * len(model.mean))
        )
        return PipelineModel([model, product])


class RangeScaler(Estimator, HasInputCol, HasOutputCol):
    """Values to [0, 1]; constant columns become 0."""

    def __init__(self, inputCol: str, outputCol: str):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        middle = f"{self.getOutputCol()}_range"
        model = MinMaxScaler(inputCol=self.getInputCol(), outputCol=middle).fit(dataset)
        spread = [1.0 if high > low else 0.0 for low, high in zip(model.originalMin, model.originalMax)]
        product = ElementwiseProduct(inputCol=middle, outputCol=self.getOutputCol(), scalingVec=Vectors.dense(spread))
        return PipelineModel([model, product])


def make_scaler(method: str, input_col: str, output_col: str) -> Estimator:
    """``minmax_scaler``, or the standard scaler for every other name."""
    kind = RangeScaler if method == "minmax_scaler" else PopulationScaler
    return kind(inputCol=input_col, outputCol=output_col)


def variance_filter(df: DataFrame, columns: Sequence[str], threshold: float = 0.01) -> list[str]:
    """Columns whose variance exceeds the threshold."""
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(align(df, columns)).select("_v")
    model = VarianceThresholdSelector(featuresCol="_v", outputCol="_kept", varianceThreshold=threshold).fit(vectors)
    return [columns[i] for i in sorted(model.selectedFeatures)]
