"""Statistical filters on the nodes and edges of a contact graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import positions


def nx_select(nodes: DataFrame, percent: float, whitelist: Column | None = None) -> DataFrame:
    """Longest nodes until their lengths reach ``percent`` of the total, the one that crosses included.

    The running sum takes two levels: whole lengths first (a table of distinct
    lengths), then ranks inside one length, so no window sees all nodes.
    """
    by_len = nodes.groupBy("len").agg(F.count("*").alias("n"))
    run = W.orderBy(F.desc("len")).rowsBetween(W.unboundedPreceding, -1)
    sums = by_len.select("len", F.coalesce(F.sum(F.col("len") * F.col("n")).over(run), F.lit(0)).alias("before"), F.sum(F.col("len") * F.col("n")).over(W.partitionBy()).alias("total"))
    rank = F.row_number().over(W.partitionBy("len").orderBy("ctg")) - 1
    keep = (F.col("before") + rank * F.col("len")) * 100 < F.col("total") * percent
    return nodes.join(sums, "len").withColumn("kept", keep if whitelist is None else keep | whitelist).where("kept").drop("kept", "before", "total")


def iqr_limit(rows: DataFrame, value: str, k: float) -> DataFrame:
    q = F.percentile(F.col(value), [0.25, 0.5, 0.75])
    return rows.agg(q.alias("q")).select(F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), (F.col("q")[2] + k * (F.col("q")[2] - F.col("q")[0])).alias("high"))


def iqr_filter(rows: DataFrame, value: str, k: float) -> DataFrame:
    """Rows up to q3 + k times the interquartile range (one row of limits joins all)."""
    return rows.crossJoin(F.broadcast(iqr_limit(rows, value, k))).where(F.col(value) <= F.col("high")).drop("q1", "median", "q3", "high")


def densities(nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """Links per site; 0 where a node has none."""
    return nodes.join(degrees, "ctg", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("density", F.col("degree") / F.col("re_sites"))


def mean_density(nodes: DataFrame) -> DataFrame:
    """Links over sites of the linked nodes; sites carry a pseudo-count of one each, the sum one in all."""
    return nodes.where("degree > 0").agg((F.sum("degree") / (1 + F.sum(F.col("re_sites") - 1))).alias("mean_density"))


def density_filter(nodes: DataFrame, low: float, high: float, mode: str = "multiple") -> DataFrame:
    if mode == "multiple":
        return nodes.crossJoin(F.broadcast(mean_density(nodes))).where((F.col("density") >= low * F.col("mean_density")) & (F.col("density") <= high * F.col("mean_density"))).drop("mean_density")
    ranked = positions(nodes.select("ctg", "density"), ["density", "ctg"], "at").crossJoin(F.broadcast(nodes.agg(F.count("*").alias("n"))))
    kept = ranked.where((F.col("at") >= F.floor(F.col("n") * low)) & (F.col("at") < F.floor(F.col("n") * high))).select("ctg")
    return nodes.join(kept, "ctg", "left_semi")


def neighbour_ranks(both: DataFrame) -> DataFrame:
    """Rank from 0 of every neighbour v of u: by weight, then id.  both: u, v, w in both directions."""
    return both.withColumn("rank", F.row_number().over(W.partitionBy("u").orderBy(F.desc("w"), "v")) - 1)


def rank_sums(both: DataFrame, top: int = 10) -> DataFrame:
    """Per node, over pairs of its ``top`` neighbours, the sum of the better of the pair's mutual ranks.

    Pairs are only formed among a node's ``top`` neighbours; unlinked pairs count nothing.
    """
    ranked = neighbour_ranks(both)
    best = ranked.where(F.col("rank") < top)
    pairs = best.select("u", F.col("v").alias("a")).join(best.select("u", F.col("v").alias("b")), "u").where("a < b")
    mutual = ranked.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "rank").groupBy("a", "b").agg(F.min("rank").alias("rank"))
    return pairs.join(mutual, ["a", "b"]).groupBy("u").agg(F.sum("rank").cast("long").alias("rank_sum"))


def filter_nodes(nodes: DataFrame, both: DataFrame | None = None, share: float = 100, sites: int = 0, density: tuple[float, float] | None = None, density_mode: str = "multiple", depth: float | None = None, ranks: float | None = None, top: int = 10, whitelist: Column | None = None) -> DataFrame:
    """The five filters in a row; nodes of the whitelist come back at the end.

    nodes: ctg, len, re_sites, degree, density.  In turn: the longest up to ``share``
    per cent of the length; more than ``sites`` sites; density between bounds; degree
    up to q3 + ``depth`` times the interquartile range of those that have the sites;
    rank sum up to the like (``ranks``) over the neighbours in ``both``.
    """
    passing = nx_select(nodes, share).where(F.col("re_sites") > sites)
    kept = density_filter(passing, *density, density_mode) if density else passing
    if depth is not None:
        kept = kept.crossJoin(F.broadcast(iqr_limit(passing, "degree", depth).select("high"))).where(F.col("degree") <= F.col("high")).drop("high")
    if ranks is not None:
        sums = rank_sums(both, top)
        fine = iqr_filter(sums.join(passing.select(F.col("ctg").alias("u")), "u", "left_semi"), "rank_sum", ranks)
        kept = kept.join(fine.select(F.col("u").alias("ctg")), "ctg", "left_semi")
    columns = nodes.columns
    return kept.select(*columns) if whitelist is None else kept.select(*columns).union(nodes.where(whitelist).select(*columns)).distinct()


def sample_bins(fragments: DataFrame, share: float, seed: int) -> DataFrame:
    """A reproducible sample of each contig's bins: max(1, n * share) of those with at least 1 / share bins."""
    of = W.partitionBy("ctg")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("ctg").cast("string"), F.col("bin_no").cast("string")))
    rows = fragments.withColumn("n", F.count("*").over(of)).withColumn("rank", F.row_number().over(of.orderBy(key, "bin_no")))
    return rows.where((F.col("n") >= F.ceil(F.lit(1 / share))) & (F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") * share)))).drop("n", "rank")


def without_nodes(edges: DataFrame, masked: DataFrame, left: list[str], right: list[str], keys: list[str]) -> DataFrame:
    """Edges that touch no masked node: two anti-joins."""
    for own in (left, right):
        edges = edges.join(masked.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)]), own, "left_anti")
    return edges


def normalise_by_degree(edges: DataFrame, degrees: DataFrame) -> DataFrame:
    side = lambda c, n: degrees.select(F.col("ctg").alias(c), F.col("degree").alias(n))
    return edges.join(side("i", "di"), "i").join(side("j", "dj"), "j").select("i", "j", "links", (F.col("links") / F.sqrt(F.col("di") * F.col("dj"))).alias("w"))


def normalise_by_length(edges: DataFrame, contigs: DataFrame, flank: int, unit: float = 1e6) -> DataFrame:
    size = F.least(F.col("len"), F.lit(2 * flank)) / unit
    side = lambda c, n: contigs.select(F.col("ctg").alias(c), size.alias(n))
    return edges.join(side("i", "si"), "i").join(side("j", "sj"), "j").select("i", "j", "links", (F.col("links") / (F.col("si") * F.col("sj")) ** 2).alias("w"))


def downweight_between(edges: DataFrame, haplotypes: DataFrame, weight: float) -> DataFrame:
    """Edges between haplotypes keep 1 - weight of their links; edges that come to nothing leave."""
    side = lambda c, n: haplotypes.select(F.col("ctg").alias(c), F.col("hap").alias(n))
    w = F.when(F.col("hi") == F.col("hj"), F.col("links").cast("double")).otherwise(F.col("links") * (1 - weight))
    return edges.join(side("i", "hi"), "i").join(side("j", "hj"), "j").select("i", "j", w.alias("w")).where("w > 0")


def read_pairs_filter(reads: DataFrame, least_quality: float, most_mismatch: int = 0, either: bool = False, drop_duplicates: bool = False) -> DataFrame:
    """Adjacent rows of a name are the two ends of a pair, taken greedily; pairs by quality, mismatches and duplicate marks.

    reads: name, ord, quality, mismatch, duplicate.
    """
    w = W.partitionBy("name").orderBy("ord")
    rows = reads.withColumn("k", F.row_number().over(w)).withColumn("q2", F.lead("quality").over(w)).withColumn("m2", F.lead("mismatch").over(w)).withColumn("d2", F.lead("duplicate").over(w)).withColumn("ord2", F.lead("ord").over(w))
    pairs = rows.where("k % 2 = 1 and ord2 is not null")
    a, b = F.col("quality") >= least_quality, F.col("q2") >= least_quality
    keep = (a | b) if either else (a & b)
    if most_mismatch:
        keep = keep & (F.col("mismatch") < most_mismatch) & (F.col("m2") < most_mismatch)
    if drop_duplicates:
        keep = keep & ~F.col("duplicate") & ~F.col("d2")
    return pairs.where(keep).select("name", "ord", "ord2", "quality", "q2")
