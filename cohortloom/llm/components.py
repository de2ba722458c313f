"""Connected components of a table of links, by minimum labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.shared import store


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every id in ``links`` (columns ``a, b``): the smallest id it can reach.

    Each round takes the smallest label among the neighbours and then the label of that label. Labels
    are stored between rounds; a hub costs one aggregated row per task. Nothing but a flag reaches the driver.
    """
    both = store(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = store(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).select("id", F.least("id", "component").alias("component")), "labels")
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "component"), "b")
        least = seen.groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        merged = labels.join(least, "id").select("id", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("beyond"))
        after = merged.join(jump, "next", "left").select("id", F.least("next", "beyond").alias("now"), "component")
        after = store(after, "labels")
        labels = after.select("id", F.col("now").alias("component"))
        if after.where("now <> component").isEmpty():
            return labels
