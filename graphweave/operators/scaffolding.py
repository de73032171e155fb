"""From contacts to scaffolds: filter, cluster, reassign, order and build, each a stage of a store."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import build, clustering, contacts, filters, order, reassign, sequential
from .stages import Stage, StageStore


@dataclass(frozen=True)
class Settings:
    groups: int  # how many are expected
    inflations: tuple[float, ...] = (1.2, 1.4, 1.6, 1.8, 2.0, 3.0)
    share: float = 100  # of the length that the longest contigs make up
    sites: int = 0
    density: tuple[float, float] | None = None
    between: float = 0.0  # what links between haplotypes lose
    resolution: int = 1  # reassignment counts links in whole steps of 1 / resolution
    limits: reassign.Limits = field(default_factory=reassign.Limits)
    rounds: int = 5
    order: str = "links"  # or "length": the longest first, all forward
    gap: int = build.GAP


def chosen(best: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row: the recommended inflation; where none is, that of the most groups (the least on a tie)."""
    most = sizes.groupBy("inflation").agg(F.count("*").alias("n")).agg(F.max_by("inflation", F.struct("n", -F.col("inflation"))).alias("most"))
    return best.crossJoin(F.broadcast(most)).select(F.when(F.col("inflation") > 0, F.col("inflation")).otherwise(F.col("most")).alias("inflation"))


def tours(groups: DataFrame, halves: DataFrame, contigs: DataFrame, how: str) -> DataFrame:
    """(grp, pos, ctg, orient) of every group's members."""
    own = groups.join(contigs.select("ctg", "len"), "ctg")
    if how == "length":
        place = F.row_number().over(W.partitionBy("grp").orderBy(F.desc("len"), "ctg"))
        return own.select("grp", place.alias("pos"), "ctg", F.lit("+").alias("orient"))
    side = lambda c, g: groups.select(F.col("ctg").alias(c), F.col("grp").alias(g))
    return order.fast_order(halves.join(side("i", "grp"), "i").join(side("j", "other"), "j").where("grp = other"), own.select("grp", "ctg", "len"))


def scaffold(store: StageStore, links: Stage, contigs: Stage, settings: Settings, tasks: int | None = None) -> dict[str, Stage]:
    """All stages by name, ``agp`` the last.  links: i, x, j, y, li, lj (enriched contacts, read once); contigs: ctg, len, re_sites, hap.

    tasks: how many the contacts and their counts are dealt to.
    """
    s, rich, own = settings, links.table, contigs.table
    halves = store.stage("halves", lambda: contacts.half_edges(rich, tasks).sortWithinPartitions("i", "j"), [links])  # sorted columns take a fraction of the disk
    edges = store.stage("edges", lambda: contacts.whole_edges(halves.table, tasks).sortWithinPartitions("i", "j"), [halves])
    nodes = store.stage("nodes", lambda: filters.filter_nodes(filters.densities(own, contacts.node_degree(edges.table)), share=s.share, sites=s.sites, density=s.density), [edges, contigs], share=s.share, sites=s.sites, density=s.density)

    def weigh() -> DataFrame:
        kept = nodes.table.select("ctg")
        inside = edges.table.join(kept.withColumnRenamed("ctg", "i"), "i", "left_semi").join(kept.withColumnRenamed("ctg", "j"), "j", "left_semi")
        return filters.downweight_between(inside.select("i", "j", "links"), own.select("ctg", "hap"), s.between)

    weights = store.stage("weights", weigh, [edges, nodes, contigs], between=s.between)
    found: list[clustering.Run] = []

    def clustered() -> clustering.Run:
        if not found:
            whole = own.select(F.col("ctg").alias("frag"), "ctg", F.col("len").alias("frag_len"))
            found.append(clustering.run(weights.table, whole, own, list(s.inflations), s.groups))
        return found[0]

    grid = {"inflations": s.inflations, "groups": s.groups}
    members = store.stage("members", lambda: clustered().members, [weights, contigs], **grid)
    sizes = store.stage("sizes", lambda: clustered().sizes, [weights, contigs], **grid)
    best = store.stage("best", lambda: chosen(clustered().best, sizes.table), [weights, contigs], **grid)
    groups = store.stage("groups", lambda: members.table.join(F.broadcast(best.table), "inflation").select("ctg", F.col("cluster").alias("grp")), [members, best])

    def counted() -> DataFrame:
        whole = filters.downweight_between(edges.table.select("i", "j", "links"), own.select("ctg", "hap"), s.between)
        return whole.select("i", "j", F.round(F.col("w") * s.resolution).cast("long").alias("links")).where("links > 0")

    pairs = store.stage("pairs", counted, [edges, contigs], between=s.between, resolution=s.resolution)
    final = store.stage("reassigned", lambda: sequential.reassign(pairs.table, groups.table, own, s.limits, s.rounds), [pairs, groups, contigs], limits=asdict(s.limits), rounds=s.rounds)
    paths = store.stage("tours", lambda: tours(final.table, halves.table, own, s.order), [final, halves, contigs], order=s.order)
    agp = store.stage("agp", lambda: build.coordinates(paths.table, own, s.gap), [paths, contigs], gap=s.gap)
    return {x.name: x for x in (edges, halves, nodes, weights, members, sizes, best, groups, pairs, final, paths, agp)}
