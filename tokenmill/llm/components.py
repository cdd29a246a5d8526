"""Connected components of a table of links, by smallest labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for links (a, b). Nodes without links are not in the result.

    Every round takes the smallest label of the neighbours, and then the label's own label; a path of length
    n is done after about log n rounds. Rounds are written to the shared folder.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = stage(both.unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), "links")
    labels = both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component"))
    labels, last = stage(labels, "labels"), None
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other")
        near = near.groupBy("node").agg(F.min("component").alias("near"))
        least = labels.join(near, "node").select("node", F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        labels = stage(
            least.join(jump, "component", "left").select("node", F.least("component", F.coalesce("beyond", "component")).alias("component")),
            "labels",
        )
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]  # labels only fall
        if now == last:
            return labels
        last = now
