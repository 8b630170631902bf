"""Connected components of large edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellselect.session import shared_dir


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) for every id on an edge to another id: the least id reachable, edges read both ways.

    Alternates two steps until nothing moves. Large star: each id hands its larger neighbours the least id
    around it. Small star: it links its smaller neighbours and itself to the least of them. Both keep the
    components, shorten chains by doubling and never add edges, so a chain of n ids takes some log n rounds.
    Least ids are aggregated map-side; a hub's edges meet its one row in a join that adaptive execution
    splits. Rounds are cut by checkpoints. Null ids and self edges are left out.
    """
    shared_dir(edges.sparkSession)
    high, low = F.greatest(a, b), F.least(a, b)
    links = (edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
             .select(high.alias("v"), low.alias("u")).distinct().checkpoint())
    state = _state(links)
    while True:
        near = links.unionByName(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = near.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = near.join(least, "v").where(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        large = large.checkpoint()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").where(F.col("u") != F.col("m")).select(F.col("u").alias("v"), F.col("m").alias("u"))
        links = small.unionByName(least.select("v", F.col("m").alias("u"))).distinct().checkpoint()
        before, state = state, _state(links)
        if state == before:
            roots = links.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct()
            return links.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(roots)


def _state(links: DataFrame) -> tuple:
    """Tells two edge sets apart: number of edges and the sums of two hashes of theirs."""
    h = F.xxhash64("v", "u")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(20,0)")), F.sum(F.xxhash64(h, "v").cast("decimal(20,0)"))).first())
