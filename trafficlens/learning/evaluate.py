"""Classification metrics from confusion counts, and the exact area under the ROC curve."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion_matrix(df: DataFrame, truth: str = "label", prediction: str = "prediction") -> DataFrame:
    """(truth, prediction, count); everything else about classes follows from it."""
    return (
        df.where(F.col(truth).isNotNull() & F.col(prediction).isNotNull())
        .groupBy(F.col(truth).alias("truth"), F.col(prediction).alias("prediction"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def _safe(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def class_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class (classes seen as truth or as prediction)."""
    sides = (
        "struct(truth as class, count as support, 0L as predicted, if(truth = prediction, count, 0L) as hits)",
        "struct(prediction as class, 0L as support, count as predicted, 0L as hits)",
    )
    sums = (
        matrix.select(F.expr(f"inline(array({', '.join(sides)}))"))
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )
    precision, recall = _safe(F.col("hits"), F.col("predicted")), _safe(F.col("hits"), F.col("support"))
    return sums.select(
        "class",
        precision.alias("precision"),
        recall.alias("recall"),
        # 2PR / (P + R) in counts
        _safe(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
    )


def class_metrics(matrix: DataFrame) -> DataFrame:
    """One row: accuracy and the support-weighted precision, recall and F1."""
    n = F.col("support")
    weighted = [
        (F.sum(F.col(m) * n) / F.nullif(F.sum(n), F.lit(0))).alias(m) for m in ("precision", "recall", "f1")
    ]
    report = class_report(matrix)
    # Weighted recall is the share of correct rows, that is the accuracy.
    return report.agg(*weighted).select(F.col("recall").alias("accuracy"), "precision", "recall", "f1")


def roc_auc(df: DataFrame, positive: Column, score: Column) -> float | None:
    """Exact area under the ROC curve (ties count half); NULL unless both classes occur.

    Spark's evaluator sorts the distinct scores over the cluster; ``numBins=0`` keeps all of them.
    """
    scored = df.select(positive.cast("double").alias("y"), score.cast("double").alias("s")).dropna()
    if scored.select("y").distinct().count() != 2:
        return None
    evaluator = BinaryClassificationEvaluator(
        rawPredictionCol="s", labelCol="y", metricName="areaUnderROC", numBins=0
    )
    return float(evaluator.evaluate(scored))


def metrics(scored: DataFrame, truth: str, prediction: str, positive: str, score: str | None) -> dict[str, float]:
    """All metrics of a scored table; ``score`` is the probability of class ``positive``, if there is one."""
    row = class_metrics(confusion_matrix(scored, truth, prediction)).first()
    out = {m: row[m] for m in ("accuracy", "precision", "recall", "f1")}
    if score is None:
        return out
    known = scored.where(F.col(prediction).isNotNull())
    area = roc_auc(known, F.col(truth) == positive, F.col(score))
    return out if area is None else {**out, "roc_auc": area}
