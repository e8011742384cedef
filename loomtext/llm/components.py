"""Connected components of a link table, by least labels and pointer jumping in written rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.scratch import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); the label is the component's least node.

    A round hands every node the least label among its neighbours and then the label of that label,
    so the number of rounds grows with the logarithm of the longest path. Nothing is collected.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialise(both.where("a <> b").distinct(), "links")
    labels = materialise(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")),
        "labels",
    )
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b")
        nearest = seen.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = materialise(
            labels.join(nearest, "node").select("node", "label", F.least("label", "near").alias("low")),
            "labels-near",
        )
        jump = lower.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        found = materialise(
            lower.join(jump, "low").select(
                "node", F.col("lower").alias("label"), (F.col("lower") < F.col("label")).alias("moved")
            ),
            "labels",
        )
        labels = found.select("node", "label")
        if found.where("moved").isEmpty():
            return labels
