"""Connected components by smallest labels, in rounds of joins; nothing of it is on the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) of undirected edges (a, b), which may repeat; label is the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours, then that label's own label, so that chains halve.
    Without edges the result is empty.
    """
    both = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near"))), f"{name}-edges")
    labels = stored(both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("label")), name)
    while True:
        near = both.join(labels.select(F.col("node").alias("near"), "label"), "near").groupBy("node").agg(F.min("label").alias("least"))
        lower = stored(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "least").alias("label")), name)
        over = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = stored(lower.join(over, "label").select("node", "old", F.least("label", "next").alias("label")), name)
        changed = after.where("old != label").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels
