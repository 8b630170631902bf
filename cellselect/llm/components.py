"""Connected components of an undirected edge table: smallest id reachable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellselect.session import shared_dir


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of ``edges`` (a, b).

    Each round takes the least label among neighbours, then the label's own label, so labels travel
    twice as far per round. Both are equi-joins with map-side minima; a hub's edges are spread by
    adaptive skew handling. Rounds are cut by checkpoints.
    """
    shared_dir(edges.sparkSession)
    both = (edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            .where("a <> b").distinct().checkpoint())
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select(
        "id", F.least("id", "least").alias("component")).checkpoint()
    while True:
        near = (both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("near")))
        step = labels.join(near, labels.id == near.a, "left").select(
            "id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("new"))
        up = labels.select(F.col("id").alias("new"), F.col("component").alias("top"))
        labels = step.join(up, "new", "left").select("id", "old", F.least("new", F.coalesce("top", "new")).alias("component")).checkpoint()
        moved = labels.where("old <> component").limit(1).count()
        labels = labels.drop("old")
        if not moved:
            return labels
