"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round's edges are a table in the shared folder (a checkpoint would keep its plan's
estimated size, which the joins of each round multiply until planning stalls); what a round
no longer needs is deleted.  The number of rounds grows with the logarithm of the graph, and a node with very many edges is only ever grouped by
partial minima or joined by a join that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.operators.tables import discard

from .common import written


def _mins(edges: DataFrame) -> DataFrame:
    return written(edges.groupBy("u").agg(F.min("v").alias("m")), "mins")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u, v) but the roots; a root is its component's least node."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = written(e, "edges"), None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _mins(both)
        large = written(both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct(), "large")
        low = _mins(large)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v")
        new = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        for gone in (e, near, large, low):
            discard(gone)
        e = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40)), F.sum(F.xxhash64("v", "u") % (1 << 40))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError("components did not settle")
