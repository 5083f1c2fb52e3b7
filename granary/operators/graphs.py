"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settled


def components(links: DataFrame) -> DataFrame:
    """(vertex, component) for every end of ``links`` (a, b): the smallest vertex that it reaches.

    Each round takes the smallest label of the neighbours and then the label of that
    label, so the number of rounds grows with the logarithm of the longest way. Labels
    are combined before they are shuffled; a hub is one row after that.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a is not null and b is not null").distinct()
    both = settled(both)
    labels = settled(both.groupBy(F.col("a").alias("vertex")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("vertex", "b"), "b").groupBy(F.col("a").alias("vertex")).agg(F.min("component").alias("_near"))
        lower = labels.join(near, "vertex").select("vertex", F.least("component", "_near").alias("_to"), F.col("component").alias("_old"))
        jump = labels.select(F.col("vertex").alias("_to"), F.col("component").alias("_far"))
        after = settled(lower.join(jump, "_to").select("vertex", F.least("_to", "_far").alias("component"), "_old"))
        labels = after.select("vertex", "component")
        if after.filter("component != _old").isEmpty():
            return labels
