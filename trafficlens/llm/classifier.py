"""A quality classifier made of sparse rules.

Statistics of the text are the only inputs. A boosted forest fitted on the training documents proposes rules: every path from a
root to a node is a conjunction of comparisons. A lasso logistic regression over the rules (and the statistics, squashed to their 1st
and 99th percentiles) keeps a few of them with weights. Rules and weights are then compiled into one Spark column, so that
scoring is a projection.

Training reads about MAX_TRAINING labelled documents at most (those with the smallest hashes of their id), a bound for the
fit only; documents with crc32(doc_id as text) mod 3 = 1 are held out.

Defined cases: a null or empty text has statistics of 0 and is scored like any text. Repeated label rows count once, as 0 if any is 0;
null labels are none. Repeated documents count each. Without labels of both classes there is nothing to learn: every
document scores the share of label 1 among the training labels, or 0.5 without any. A null doc_id is not held out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.tables import store
from trafficlens.llm.textstats import text_stats

FOLDS = 3
HELD_OUT = 1
MAX_TRAINING = 20_000
TREES = 8
DEPTH = 3
LASSO = 0.002
SEED = 11
FEATURES = ("log_words", "word_length", "symbols", "repeats", "dup_lines", "line_words", "uppers", "marks", "digits", "distinct", "stops")


def features(s: Column) -> Column:
    """A struct of FEATURES (double) from a ``text_stats`` struct."""

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    words = s["n_words"]
    values = (
        F.log1p(words.cast("double")), ratio(s["word_chars"], words), ratio(s["n_symbols"], words), ratio(s["n_repeat_words"], words),
        ratio(s["n_dup_lines"], s["n_lines"]), ratio(words, s["n_lines"]), ratio(s["n_upper"], s["word_chars"]), ratio(s["n_marks"], words),
        ratio(s["n_digits"], s["word_chars"]), ratio(s["n_distinct"], words), ratio(s["n_sentences"], words),
    )
    return F.struct(*[v.alias(f) for v, f in zip(values, FEATURES)])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


@dataclass(frozen=True)
class Rule:
    """All of (feature, is_above, threshold): the value is above the threshold, or not."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self, row: Column) -> Column:
        out = F.lit(True)
        for feature, above, threshold in self.tests:
            out = out & ((row[feature] > threshold) if above else (row[feature] <= threshold))
        return out


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]
    #: (feature, low, high, weight): the value held between low and high.
    linear: tuple[tuple[str, float, float, float], ...]

    def score(self, row: Column) -> Column:
        """Probability of label 1."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(row), F.lit(weight)).otherwise(F.lit(0.0))
        for feature, low, high, weight in self.linear:
            total = total + F.least(F.greatest(row[feature], F.lit(low)), F.lit(high)) * weight
        return 1 / (1 + F.exp(-total))


def tree_rules(model) -> list[Rule]:
    """Every path of every tree, each once; a feature tested twice in one direction keeps the narrower threshold."""
    found: dict[tuple, Rule] = {}

    def walk(node, tests: dict[tuple[str, bool], float]) -> None:
        if tests:
            key = tuple(sorted((f, above, t) for (f, above), t in tests.items()))
            found.setdefault(key, Rule(key))
        if node.subtreeDepth() == 0:
            return
        split = node.split()
        feature, threshold = FEATURES[split.featureIndex()], split.threshold()
        for child, above, narrower in ((node.leftChild(), False, min), (node.rightChild(), True, max)):
            old = tests.get((feature, above))
            walk(child, {**tests, (feature, above): threshold if old is None else narrower(old, threshold)})

    for tree in model.trees:
        walk(tree._call_java("rootNode"), {})
    return list(found.values())


def training_rows(scored: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING) -> DataFrame:
    """label and features of the labelled documents outside the held-out fold, ``max_rows`` of them on average at most."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    )
    rows = scored.where(~held_out(F.col("doc_id"))).join(known, "doc_id")
    # By hash of the id, not by order, so nothing is gathered to be sorted.
    share = min(1.0, max_rows / max(1, rows.count()))
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < round(share * (1 << 20))).select("label", "features")


def train(scored: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING) -> Ensemble:
    """``scored`` has doc_id and features. The fitted sample is small, so it is kept as one stored table."""
    rows = store(training_rows(scored, labels, max_rows).select("label", "features.*").coalesce(2), "rule-sample")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        share = counts.get(1.0, 0) / total if total else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Ensemble(math.log(share / (1 - share)), (), ())
    balanced = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(total / (2.0 * n)))])
    rows = rows.withColumn("weight", balanced[F.col("label")]).cache()
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows)
    trees = GBTClassifier(
        featuresCol="x", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, maxBins=64, stepSize=0.3, subsamplingRate=0.7, seed=SEED
    ).fit(vectors)
    rules = tree_rules(trees)
    low_high = rows.select(*[F.percentile(f, F.array(F.lit(0.01), F.lit(0.99))).alias(f) for f in FEATURES]).first()
    spans = [(f, *low_high[f]) for f in FEATURES]
    row = F.struct(*FEATURES)
    inputs = [r.column(row).cast("double") for r in rules] + [F.least(F.greatest(F.col(f), F.lit(lo)), F.lit(hi)) for f, lo, hi in spans]
    table = rows.select("label", "weight", array_to_vector(F.array(*inputs)).alias("x"))
    lasso = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", elasticNetParam=1.0, regParam=LASSO, maxIter=100).fit(table)
    weights, intercept = lasso.coefficients.toArray().tolist(), lasso.intercept
    rows.unpersist()
    chosen = tuple((r, w) for r, w in zip(rules, weights[: len(rules)]) if w)
    linear = tuple((f, lo, hi, w) for (f, lo, hi), w in zip(spans, weights[len(rules) :]) if w)
    return Ensemble(intercept, chosen, linear)


def score(docs: DataFrame) -> DataFrame:
    """doc_id and features of every row."""
    return docs.select("doc_id", features(text_stats(F.col("text"))).alias("features"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; the texts are read once."""
    scored = store(score(docs), "rule-features")
    value = train(scored, labels).score(F.col("features"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), value.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
