"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stage


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every end of links (a, b): label is the smallest node that can be reached.

    Each round takes the least label among the neighbours and then the label's own label, until none changes; rounds grow
    with the logarithm of a component's width, and what is read again is a written table.
    """
    both = stage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        lower = stage(lower, "labels")
        jump = lower.select(F.col("node").alias("via"), F.col("label").alias("far"))
        labels = stage(lower.join(jump, lower.label == jump.via).select("node", "old", F.least("label", "far").alias("label")), "labels")
        if labels.filter("label <> old").isEmpty():
            return labels.select("node", "label")
