"""Connected components of a link table, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.llm.storage import Scratch


def components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node that can be reached.

    Each round gives every node the smallest label around it and then the label of its label, so that
    chains halve; each round's table is written, and the loop ends when no label changes.
    """
    both = scratch.table(
        links.select("a", "b").union(links.select("b", "a")).filter("a is not null and b is not null and a <> b").distinct(),
        f"{label}-edges",
    )
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), f"{label}-0")
    round_ = 0
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lowered = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        up = labels.select(F.col("node").alias("up"), F.col("component").alias("upper"))
        jumped = lowered.join(up, lowered.component == up.up, "left").select("node", F.least("component", F.coalesce("upper", "component")).alias("component"), "before")
        round_ += 1
        after = scratch.table(jumped, f"{label}-{round_}")
        changed = after.filter("component <> before").limit(1).count()
        scratch.drop(f"{label}-{round_ - 1}")
        labels = after.select("node", "component")
        if not changed:
            return labels
