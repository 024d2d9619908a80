"""Connected components of links that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattika.llm.common import durable, release


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes in links(a, b).

    Each round a node takes the smallest label among its neighbours, then the label
    of that label, so that rounds grow with the logarithm of a chain's length. Hot
    nodes are pre-aggregated before the shuffle. No links give no rows.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = durable(both)
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        of_label = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped = durable(lower.join(of_label, "component", "left").select("node", "was", F.least("component", F.coalesce("next", "component")).alias("component")))
        changed = jumped.filter("was <> component").limit(1).count()
        labels = jumped.select("node", "component")
        release(links.sparkSession)
        if not changed:
            return labels
