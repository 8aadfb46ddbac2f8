"""Connected components by joins, for link tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table


def connected_components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node reachable) for each node of links(a long, b long).

    Each round takes the smallest label among a node's neighbours and then the label of that
    label, so that long chains shorten by doubling. Tables are staged each round; rounds end when
    no label moves. Links to itself and repeated links are fine; no links give no rows.
    """
    both = stage_table(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stage_table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("other")).select("node", F.least("node", "other").alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("n")).agg(F.min("component").alias("seen"))
        moved = labels.join(near, F.col("node") == F.col("n"), "left").select("node", "component", F.least("component", "seen").alias("next"))
        moved = stage_table(moved, "labels-moved")
        jump = moved.select(F.col("node").alias("j"), F.col("next").alias("jumped"))
        new = stage_table(moved.join(jump, F.col("next") == F.col("j"), "left").select("node", F.least("next", "jumped").alias("component"), F.col("component").alias("was")), "labels")
        labels = new.select("node", "component")
        if new.filter("component <> was").isEmpty():
            return labels
