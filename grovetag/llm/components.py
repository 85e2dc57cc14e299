"""Connected components of a table of links, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(id, component) for each end of links (a, b); component is the smallest id of those connected.

    Each round takes the smallest label among a node's neighbours and then the label of that label,
    so chains halve. Rounds start from a written table.
    """
    edges = stored(links.select("a", "b").union(links.select("b", "a")).toDF("id", "other").distinct(), f"{label}-edges")
    labels = held = stored(edges.groupBy("id").agg(F.least("id", F.min("other")).alias("component")), label)
    while True:
        near = edges.join(labels.select(F.col("id").alias("other"), "component"), "other").groupBy("id").agg(F.min("component").alias("near"))
        nearer = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        jump = labels.select(F.col("id").alias("now"), F.col("component").alias("next"))
        new = stored(nearer.join(jump, "now", "left").select("id", "was", F.least("now", F.coalesce("next", "now")).alias("component")), label)
        discard(held)
        labels, held = new.select("id", "component"), new
        if not new.where("component <> was").limit(1).count():
            discard(edges)
            return labels
