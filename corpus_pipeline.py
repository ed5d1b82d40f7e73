"""From raw documents to packed sequences: five stages, each a Spark job over all that the one before it kept.

Every stage takes and returns the columns of ``documents`` (the last one returns pieces), keeps other columns as they are, and works row by
row where it filters, so repeated rows and null ids go the way of their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm import classifier, jaccard, packing, pii, quality_rules, textstats
from trafficlens.llm.tables import fresh_path, store, table


def rule_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and all certified rules of their stratum."""
    row = F.struct(*docs.columns).alias("row")
    scored = quality_rules.score(docs, row)
    cutoffs = store(quality_rules.calibrate(store(scored.drop("row"), "rule-scores"), table(spark, sf_dir, "labels")), "cutoffs")
    return quality_rules.judge(scored, cutoffs).where("kept").select("row.*")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, trained on what is left, predicts to be of quality 1."""
    row = F.struct(*docs.columns).alias("row")
    scored = docs.select(row, "doc_id", classifier.features(textstats.text_stats(F.col("text"))).alias("features"))
    model = classifier.train(store(scored.drop("row"), "ensemble-features"), table(spark, sf_dir, "labels"))
    return scored.where(model.score(F.col("features")) >= 0.5).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that is linked, the one with the smallest doc_id (null comes last; of equal ids: the smallest hash of the text).

    Rows are linked, not ids: each has a number of its own, stored before use, so two different texts under one id both
    stay, and rows without an id are compared like all others. Rows without words are linked with nothing and stay.
    The stored rows hold each text once.
    """
    row = F.struct(*docs.columns).alias("row")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("hash")).alias("rank")
    numbered = store(docs.select(F.monotonically_increasing_id().alias("number"), rank, row), "numbered")
    linked = jaccard.link(numbered.select(F.col("number").alias("doc_id"), "row.text")).select(F.col("doc_id").alias("number"), "component_id")
    # A group's rows meet as one candidate per task, so a group of any size is one small aggregate.
    ranked = linked.join(numbered.select("number", "rank"), "number")
    first = ranked.groupBy("component_id").agg(F.min(F.struct("rank", "number")).alias("first")).select("first.number")
    # Merged at every size, as a list of this length may not be sent to all tasks: the texts are shuffled once.
    return numbered.select("number", "row").join(store(first, "firsts").hint("merge"), "number").select("row.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets; n_chars counts the new text."""
    redacted = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return redacted
    kind = docs.schema["n_chars"].dataType
    return redacted.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), "n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", rule_filter),
    ("quality_classifier", quality_filter),
    ("near_copies", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

#: SQL expresses neither the classifier nor the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
