"""Connected components of an edge table by least labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunlattice.llm.common import discard, saved


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) for each node of edges (a, b): label is the least node reachable.

    Every round takes the least label of the neighbours, then the label of that
    label, so long paths halve. Each round is a written table in the shared
    folder; the driver only sees how many labels changed.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), name)
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), name)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        step = saved(low.join(above, "label").select("node", F.least("label", "top").alias("label"), (F.least("label", "top") < F.col("old")).alias("moved")), name)
        discard(labels)
        labels = step.select("node", "label")
        if not step.filter("moved").limit(1).count():
            discard(both)
            return labels
