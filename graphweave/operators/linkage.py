"""Average linkage in rounds of reciprocal nearest neighbours.

Average linkage is reducible: merging two clusters brings neither nearer to a third than the
nearer of them was.  Two clusters that are each other's nearest may therefore merge at once,
wherever else merges are still to come, and all such pairs of a round do.  The merges are those of
the sequential procedure in another order, and its result at a number of groups is that of
the merges of the largest similarities.

Clusters' similarity is the sum of their members' densities over the product of their sizes, so
only linked pairs are kept; unlinked ones have similarity 0 and merge last, by name.  Ties:
the least name.  Each round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordered
from .graph import components_of
from .tables import discard, written


def merges(density: DataFrame, names: DataFrame) -> DataFrame:
    """(a, b, similarity, round) of all merges of linked clusters, a the least name of the new one.

    density: g, h, density (each pair once); names: grp.  A merge's similarity is never above those
    of the merges that it builds on.
    """
    pairs = written(density.where("g <> h and density > 0").select(F.least("g", "h").alias("a"), F.greatest("g", "h").alias("b"), F.col("density").cast("double").alias("s")).groupBy("a", "b").agg(F.sum("s").alias("s")), "pairs")
    sizes = written(names.select(F.col("grp").alias("c"), F.lit(1).cast("long").alias("n"), F.lit(float("inf")).alias("low")).distinct(), "sizes")
    out, k = None, 0
    while not pairs.isEmpty():
        side = lambda c, x: sizes.select(F.col("c").alias(c), F.col("n").alias(f"n_{x}"), F.col("low").alias(f"low_{x}"))
        rated = pairs.join(side("a", "a"), "a").join(side("b", "b"), "b").withColumn("rate", F.col("s") / (F.col("n_a") * F.col("n_b")))
        ends = rated.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("other")), F.struct(F.col("b").alias("c"), F.col("a").alias("other")))).alias("e"), "rate")
        near = ends.groupBy("e.c").agg(F.min(F.struct((-F.col("rate")).alias("r"), F.col("e.other").alias("other"))).alias("best")).select("c", F.col("best.other").alias("other"))
        both = near.join(near.select(F.col("c").alias("other"), F.col("other").alias("back")), "other").where("back = c and c < other").select(F.col("c").alias("a"), F.col("other").alias("b"))
        new = written(rated.join(both, ["a", "b"]).select("a", "b", F.least("rate", "low_a", "low_b").alias("similarity"), F.lit(k).alias("round"), (F.col("n_a") + F.col("n_b")).alias("n")), "merges")
        out = new if out is None else out.union(new)
        to = lambda c, n: new.select(F.col("b").alias(c), F.col("a").alias(n))
        moved = pairs.join(to("a", "x"), "a", "left").join(to("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"), "s").where("x <> y")
        after = written(moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("s").alias("s")), "pairs")
        grown = new.select(F.col("a").alias("c"), F.col("n").alias("n_new"), F.col("similarity").alias("low_new"))
        kept = sizes.join(new.select(F.col("b").alias("c")), "c", "left_anti").join(grown, "c", "left")
        larger = written(kept.select("c", F.coalesce("n_new", "n").alias("n"), F.coalesce("low_new", "low").alias("low")), "sizes")
        discard(pairs)
        discard(sizes)
        pairs, sizes, k = after, larger, k + 1
    if out is None:
        return pairs.select("a", "b", F.lit(0.0).alias("similarity"), F.lit(0).alias("round"))
    return out.select("a", "b", "similarity", "round")


def merge_groups(density: DataFrame, names: DataFrame, groups: int) -> DataFrame:
    """(grp, merged): average-linkage merging of groups down to ``groups``; merged is the least name of its members.

    Needs a checkpoint folder.
    """
    names = names.select("grp").distinct()
    n = names.count()
    found = ordered.positions(merges(density, names), [F.desc("similarity"), F.col("round"), F.col("a"), F.col("b")], "at")
    kept = found.where(F.col("at") < max(0, n - groups)).select(F.col("a").alias("i"), F.col("b").alias("j"))
    part = components_of(kept).select(F.col("ctg").alias("grp"), F.col("component").alias("merged"))
    out = names.join(part, "grp", "left").select("grp", F.coalesce("merged", "grp").alias("merged"))
    # clusters without links between them merge by name, the first ones together
    left = ordered.positions(out.select("merged").distinct(), ["merged"], "at").checkpoint()
    extra = left.count() - groups
    if groups < 1 or extra <= 0:
        return out
    first = left.where("at = 0").select(F.col("merged").alias("first"))
    return out.join(left, "merged").crossJoin(F.broadcast(first)).select("grp", F.when(F.col("at") <= extra, F.col("first")).otherwise(F.col("merged")).alias("merged"))
