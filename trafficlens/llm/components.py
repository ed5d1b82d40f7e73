"""Connected components by repeated joins; nothing is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.tables import store


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node reachable) for every node of ``edges`` (a, b; long).

    Each round takes the least label among the neighbours and then the label's own label, so long chains halve.
    Every round is a stored table. Self-loops and repeated edges do no harm; no edges give no rows.
    """
    both = store(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "links")
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        offered = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("offer"))
        lower = labels.join(offered, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        new = store(
            lower.join(jump, F.col("label") == F.col("via")).select("node", "old", F.least("label", "further").alias("label")), "labels"
        )
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
