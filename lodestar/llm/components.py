"""Connected components of a stored edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component for every node of ``edges`` (a long, b long).

    Each round takes the smallest label among the neighbours and then the label's own label, so that
    labels travel along chains in doubling steps. Rounds are written to the shared folder.
    """
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b"), F.col("a"))).distinct()
    both = stored(both, "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = stored(labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")), "labels")
        own = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = stored(step.join(own, "root").select("node", "old", F.least("root", "next").alias("root")), "labels")
        labels = new.select("node", "root")
        if not new.where("root <> old").limit(1).count():
            return labels
