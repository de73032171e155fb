"""Contig-to-group links, a round of reassignment on one snapshot, and tables of groups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def contig_group_links(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(ctg, grp, links) in both directions; ungrouped neighbours don't count.  groups: ctg, grp."""
    both = edges.select(F.col("i").alias("ctg"), F.col("j").alias("other"), "links").union(edges.select(F.col("j"), F.col("i"), "links"))
    return both.join(groups.select(F.col("ctg").alias("other"), "grp"), "other").groupBy("ctg", "grp").agg(F.sum("links").alias("links"))


def group_sites(groups: DataFrame, contigs: DataFrame) -> DataFrame:
    """(grp, grp_sites): one plus the sites beyond the pseudo-count of each member."""
    return groups.join(contigs.select("ctg", "re_sites"), "ctg").groupBy("grp").agg((1 + F.sum(F.col("re_sites") - 1)).cast("long").alias("grp_sites"))


def group_densities(links: DataFrame, groups: DataFrame, contigs: DataFrame) -> DataFrame:
    """Adds ``density``: links over the group's sites, the contig's own added where it isn't a member."""
    rows = links.join(group_sites(groups, contigs), "grp").join(contigs.select("ctg", "re_sites"), "ctg").join(groups.select("ctg", F.col("grp").alias("own")), "ctg", "left")
    member = F.coalesce(F.col("own") == F.col("grp"), F.lit(False))
    return rows.withColumn("density", F.when(member, F.col("links") / F.col("grp_sites")).otherwise(F.col("links") / (F.col("grp_sites") + F.col("re_sites") - 1)))


def best_groups(dense: DataFrame, n_groups: int, alone: float = 1e6) -> DataFrame:
    """Per contig the group of most links, its density, the mean density of the others, their ratio and the runner-up's share."""
    w = W.partitionBy("ctg").orderBy(F.desc("links"), "grp")
    rows = dense.withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("links").over(w))
    total = rows.groupBy("ctg").agg(F.sum("density").alias("all_density"))
    top = rows.where("k = 1").join(total, "ctg")
    others = (F.col("all_density") - F.col("density")) / (n_groups - 1)
    return top.withColumn("others", others).select("ctg", "grp", "own", "links", "density", F.when(F.col("others") > 1e-12, F.col("density") / F.col("others")).otherwise(alone).alias("ratio"), F.coalesce(F.col("next") / F.col("links"), F.lit(0.0)).alias("ambiguity"))


def distribution(rows: DataFrame, value: str, weight: str) -> DataFrame:
    """Per value, the shares of rows and of weight at or below it, over a table of distinct values."""
    by = rows.groupBy(value).agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    run = W.orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy()
    return by.select(value, (F.sum("n").over(run) / F.sum("n").over(whole)).alias("share_rows"), (F.sum("w").over(run) / F.sum("w").over(whole)).alias("share_weight"))


@dataclass(frozen=True)
class Limits:
    sites: int = 0
    links: float = 0
    density: float = 0
    ratio: float = 1.5
    ambiguity: float = 0.9
    longest: float = float("inf")


def snapshot_round(edges: DataFrame, groups: DataFrame, contigs: DataFrame, limits: Limits, n_groups: int) -> DataFrame:
    """All contigs decide at once on the same state: (ctg, own, grp, action) with rescue, stay, move or keep."""
    best = best_groups(group_densities(contig_group_links(edges, groups), groups, contigs), n_groups).join(contigs.select("ctg", "len", "re_sites"), "ctg")
    fit = (F.col("re_sites") - 1 >= limits.sites) & (F.col("links") >= limits.links) & (F.col("density") >= limits.density) & (F.col("ambiguity") < limits.ambiguity)
    strong = F.col("ratio") >= limits.ratio
    action = F.when(~fit, "keep").when(F.col("own").isNull(), F.when(strong, "rescue").otherwise("keep")).when(F.col("own") == F.col("grp"), "stay").when(strong & (F.col("len") <= limits.longest), "move").otherwise("keep")
    return best.select("ctg", "own", "grp", action.alias("action"))


def group_statistics(groups: DataFrame, contigs: DataFrame, original: DataFrame) -> DataFrame:
    """Per group: contigs, total length, and sites of the contigs that were grouped at first."""
    rows = groups.join(contigs, "ctg").join(original.select("ctg", F.lit(True).alias("first")), "ctg", "left")
    return rows.groupBy("grp").agg(F.count("*").alias("n_ctg"), F.sum("len").cast("long").alias("len"), (1 + F.sum(F.when(F.col("first"), F.col("re_sites") - 1).otherwise(0))).cast("long").alias("sites"))


def between_groups(edges: DataFrame, groups: DataFrame, sites: DataFrame) -> DataFrame:
    """(g, h, links, density) of group pairs g < h; density over the product of their sites."""
    side = lambda c, n: groups.select(F.col("ctg").alias(c), F.col("grp").alias(n))
    rows = edges.join(side("i", "a"), "i").join(side("j", "b"), "j").where("a <> b")
    total = rows.groupBy(F.least("a", "b").alias("g"), F.greatest("a", "b").alias("h")).agg(F.sum("links").cast("long").alias("links"))
    own = lambda c, n: sites.select(F.col("grp").alias(c), F.col("grp_sites").alias(n))
    return total.join(own("g", "sg"), "g").join(own("h", "sh"), "h").select("g", "h", "links", (F.col("links") / (F.col("sg") * F.col("sh"))).alias("density"))


def rename_groups(groups: DataFrame, contigs: DataFrame) -> DataFrame:
    """(grp, name, n_ctg, len): groups ranked by length, named group<rank>_<length>bp."""
    total = groups.join(contigs.select("ctg", "len"), "ctg").groupBy("grp").agg(F.count("*").alias("n_ctg"), F.sum("len").cast("long").alias("len"))
    rank = F.row_number().over(W.orderBy(F.desc("len"), "grp"))
    return total.select("grp", F.concat(F.lit("group"), rank.cast("string"), F.lit("_"), F.col("len").cast("string"), F.lit("bp")).alias("name"), "n_ctg", "len")


def within_groups(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges whose ends share a group, with it."""
    a, b = groups.select(F.col("ctg").alias("i"), "grp"), groups.select(F.col("ctg").alias("j"), F.col("grp").alias("other"))
    return edges.join(a, "i").join(b, "j").where("grp = other").drop("other")


def mock_groups(contigs: DataFrame) -> DataFrame:
    """(grp, ctg, re_sites, len, rank): a group for each haplotype, the longest contig first."""
    rank = F.row_number().over(W.partitionBy("hap").orderBy(F.desc("len"), "ctg"))
    return contigs.select(F.concat(F.lit("hap"), F.col("hap").cast("string")).alias("grp"), "ctg", "re_sites", "len", rank.alias("rank"))
