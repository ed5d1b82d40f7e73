"""Registered queries of this subpackage and their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from trafficlens.llm import (
    bpe,
    classifier,
    exactdedup,
    fingerprints,
    jaccard,
    lexical,
    negatives,
    oracles,
    packing,
    pii,
    quality_rules,
    sharding,
    tokenfiles,
    warc,
)
from trafficlens.llm.tables import fresh_path, shuffle_width, store, table


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the quality rules on every document."""
    scored = store(quality_rules.score(table(spark, sf_dir, "documents")), "quality")
    cutoffs = store(quality_rules.calibrate(scored, table(spark, sf_dir, "labels")), "cutoffs")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality_rules.judge(scored, cutoffs).select(
        "doc_id", *[F.col(f"stats.{c}").alias(c) for c in counts], F.col("failed").alias("base_failed"), "kept", "rejected_by"
    )


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and the search of every twentieth id against all."""
    return fingerprints.search(fingerprints.report(table(spark, sf_dir, "documents")))


def simhash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of near fingerprints behind the counts of ``simhash``."""
    return fingerprints.near_pairs(fingerprints.report(table(spark, sf_dir, "documents")))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as seekable token files and read back."""
    return tokenfiles.round_trip(table(spark, sf_dir, "documents"))


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the component of those they are linked to."""
    return jaccard.link(table(spark, sf_dir, "documents"))


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back by byte ranges."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data found in every document."""
    return pii.find(table(spark, sf_dir, "documents"))


def bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents from shared chunks, decoded again."""
    return bpe.report(table(spark, sf_dir, "documents"))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier's score of every document."""
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; every seventh one counts as of the next label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as two loads, dealt by their ids; the second one is held against the index that the first one leaves."""
    later = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)), F.lit(0))
    rows = exactdedup.digest_rows(table(spark, sf_dir, "documents"), later)
    index = exactdedup.DigestIndex.create(spark, fresh_path(spark, "digest-index"), shuffle_width(spark))
    for load in (0, 1):
        index.add(rows.where(F.col("load") == load), load)
    return exactdedup.report(rows, index)


QUERIES = {
    "op1_quality_rules": quality,
    "op2_sharding": placed,
    "op3_fingerprints": simhash,
    "fingerprint_pairs": simhash_pairs,
    "op4_best_fit_packing": packed,
    "op5_token_files": token_output,
    "op6_jaccard_join": linked,
    "op7_warc": archives,
    "op8_personal_data": personal,
    "op9_bpe": bpe_digests,
    "op10_rule_classifier": classified,
    "op11_ranked_search": ranked,
    "op12_hard_negatives": mined,
    "op13_exact_dedup": deduplicated,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_quality_rules": oracles.QUALITY,
    "op6_jaccard_join": oracles.JACCARD,
    "op7_warc": oracles.WARC,
    "op11_ranked_search": oracles.RANKED,
    "op12_hard_negatives": oracles.NEGATIVES,
    "op13_exact_dedup": oracles.EXACT,
}
