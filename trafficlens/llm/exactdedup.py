"""Exact duplicates by a persistent index of digests, bucketed and sorted by digest.

Two texts are equal when they are identical without white space. The index holds one entry per digest, appended by the load that brought
the digest first, and beside it one entry for each later load that brought it again, so the best row and the number of rows of every text
are known over all loads. New data is reduced to one row per digest and load, held against the index by a sort-merge anti-join, and what is
new is appended. Both tables are bucketed by the digest, so neither the joins nor the sums over them shuffle the index.

A load can be added again after a failure: entries that it has already appended are left out by the same anti-join.

Hot texts: rows of one text are counted and compared within each task before anything is shuffled. Of the decisions, those for the texts
that hold a large share of the rows (at most ``1 / HOT_SHARE`` of them, so at most HOT_SHARE texts) are broadcast; all others meet their rows by
a sort-merge join, in which no key has more than that share.

Given results: a missing text counts as empty, so all texts without a visible character are one group. Of equal texts the row with the most
code points stays, then the one with the smallest id (rows without an id come last), then the first load, then any one of the rows that
are alike. Repeated rows count each. An empty table adds nothing and gives no rows. Columns of other names are carried by
``new_documents`` and not looked at by the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm.tables import store

#: A text is hot where its rows are more than one in so many.
HOT_SHARE = 4096
_KEY = "digest binary"
_BEST = "best struct<shorter: int, no_id: boolean, doc_id: bigint, load: bigint, row_no: bigint>"
_ENTRY = f"{_KEY}, {_BEST}, n_rows bigint, load bigint"


def normalised(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digest_rows(docs: DataFrame, load: Column | int = 0, row: Column | None = None) -> DataFrame:
    """What the index needs of each document, stored: digest, shorter, doc_id, load, row_no (and ``row``)."""
    digest = F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest")
    # The more code points, the smaller; structs are compared field by field.
    shorter = (-F.length(F.coalesce("text", F.lit("")))).alias("shorter")
    load = (F.lit(load) if isinstance(load, int) else load).cast("long").alias("load")
    more = [] if row is None else [row.alias("row")]
    names = (F.col("doc_id").cast("long"), load, F.monotonically_increasing_id().alias("row_no"))
    return store(docs.select(digest, shorter, *names, *more), "digests")


def groups(rows: DataFrame) -> DataFrame:
    """One row per digest: its best row and the number of rows."""
    best = F.struct("shorter", F.col("doc_id").isNull().alias("no_id"), "doc_id", "load", "row_no")
    return rows.groupBy("digest").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n_rows"))


class DigestIndex:
    """The index below ``path``, with a fixed number of buckets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        name = "".join(c if c.isalnum() else "_" for c in self.path)
        self.firsts, self.repeats = f"digests_first_{name}", f"digests_again_{name}"
        for table, folder in ((self.firsts, "first"), (self.repeats, "again")):
            spark.sql(
                f"create table if not exists `{table}` ({_ENTRY}) using parquet location '{self.path}/{folder}'"
                f" clustered by (digest) sorted by (digest) into {buckets} buckets"
            )

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int) -> DigestIndex:
        """A new, empty index. Buckets should hold some ten million digests each once the index has grown."""
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path.rstrip('/')}/settings")
        return cls(spark, path, buckets)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> DigestIndex:
        """An index that an earlier session has left."""
        return cls(spark, path, spark.read.parquet(f"{path.rstrip('/')}/settings").first()["buckets"])

    def _append(self, entries: DataFrame, table: str) -> None:
        """Each task writes one sorted file of its own bucket."""
        (
            entries.repartition(self.buckets, "digest")
            .write.format("parquet")
            .mode("append")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(table)
        )

    def add(self, rows: DataFrame, load: int = 0) -> DataFrame:
        """Add the rows of one load; the digests that are new to the index, with their best rows."""
        found = store(groups(rows).withColumn("load", F.lit(load).cast("long")), "load-groups")
        known = self.spark.table(self.firsts)
        earlier = known.where(F.col("load") != load).select("digest").hint("merge")
        fresh = found.join(earlier, "digest", "left_anti")
        again = found.join(earlier, "digest", "left_semi")
        # The entries of this load that a failed attempt has already appended are not appended twice.
        for entries, table in ((fresh, self.firsts), (again, self.repeats)):
            there = self.spark.table(table).where(F.col("load") == load).select("digest").hint("merge")
            self._append(entries.join(there, "digest", "left_anti").select("digest", "best", "n_rows", "load"), table)
        return fresh

    def entries(self) -> DataFrame:
        """digest, best, n_rows over all loads; read bucket by bucket, without a shuffle."""
        again = self.spark.table(self.repeats).groupBy("digest").agg(F.min("best").alias("later"), F.sum("n_rows").alias("more"))
        joined = self.spark.table(self.firsts).join(again.hint("merge"), "digest", "left")
        return joined.select("digest", F.least("best", "later").alias("best"), (F.col("n_rows") + F.coalesce("more", F.lit(0))).alias("n_rows"))

    def decide(self, rows: DataFrame) -> DataFrame:
        """All ``rows`` (which must have been added) with the row that stays of their text over all loads."""
        state = self.entries()
        total = state.agg(F.sum("n_rows")).first()[0] or 0
        hot = state.where(F.col("n_rows") * HOT_SHARE > total).withColumnRenamed("best", "hot_best").withColumnRenamed("n_rows", "hot_rows")
        dealt = rows.join(F.broadcast(hot), "digest", "left")
        common = dealt.where("hot_rows is not null").withColumns({"best": F.col("hot_best"), "n_rows": F.col("hot_rows")})
        rare = dealt.where("hot_rows is null").join(state.hint("merge"), "digest")
        columns = [*rows.columns, "best", "n_rows"]
        stays = (F.col("best.load") == F.col("load")) & (F.col("best.row_no") == F.col("row_no"))
        return common.select(columns).unionByName(rare.select(columns)).withColumn("kept", stays)


def new_documents(docs: DataFrame, index: DigestIndex, load: int) -> DataFrame:
    """The documents, with all their columns, whose text the index has not met before, one of each text; the index knows them afterwards."""
    rows = digest_rows(docs, load, F.struct(*docs.columns))
    fresh = index.add(rows.drop("row"), load).select(F.col("best.row_no").alias("row_no"))
    return rows.join(fresh, "row_no").select("row.*")


def report(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    decided = index.decide(rows)
    digest = F.lower(F.hex("digest")).alias("text_sha256")
    return decided.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n_rows").alias("group_size"), "kept", digest)
