"""Scores of groupings and scaffolds against known sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import heaviest_increasing


def source_lengths(members: DataFrame, least: int = 2) -> DataFrame:
    """(grp, chr, src, len, rank): length by source in each group of at least ``least`` members; rank 1 is dominant.

    members: grp, ctg, len, chr (base chromosome), src (chromosome and haplotype).
    """
    usable = members.withColumn("n", F.count("*").over(W.partitionBy("grp"))).where(F.col("n") >= least)
    rows = usable.groupBy("grp", "chr", "src").agg(F.sum("len").cast("long").alias("len"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("grp").orderBy(F.desc("len"), F.desc("src"))))


def homolog_errors(members: DataFrame, least: int = 2) -> DataFrame:
    """(grp, src, dominant, homolog_error, other_error, anchored): lengths that don't belong to the dominant source."""
    rows = source_lengths(members, least)
    top = rows.where("rank = 1").select("grp", F.col("chr").alias("top"), F.col("src").alias("dominant"))
    both = rows.join(top, "grp")
    off = F.col("rank") > 1
    return both.groupBy("grp", "dominant").agg(F.sum(F.when(off & (F.col("chr") == F.col("top")), F.col("len")).otherwise(0)).cast("long").alias("homolog_error"), F.sum(F.when(off & (F.col("chr") != F.col("top")), F.col("len")).otherwise(0)).cast("long").alias("other_error"), F.sum("len").cast("long").alias("anchored"))


def clustering_score(members: DataFrame, total_length: DataFrame, least: int = 2) -> DataFrame:
    """One row: contiguity, error, anchoring and adjusted contiguity.  total_length: one row, ``total``."""
    rows = source_lengths(members, least)
    per = rows.groupBy("src").agg(F.max("len").alias("longest"), F.sum("len").alias("anchored"))
    contiguity = per.agg(F.avg(F.col("longest") / F.col("anchored")).alias("contiguity"))
    errors = homolog_errors(members, least).agg(F.count("*").alias("n_groups"), F.sum("homolog_error").alias("h"), F.sum("other_error").alias("o"), F.sum("anchored").alias("a"))
    one = contiguity.crossJoin(errors).crossJoin(total_length)
    return one.select("n_groups", "contiguity", (100 * F.col("h") / F.col("a")).alias("homolog_error"), (100 * F.col("o") / F.col("a")).alias("other_error"), (100 * (F.col("h") + F.col("o")) / F.col("a")).alias("total_error"), (100 * F.col("a") / F.col("total")).alias("anchoring"), (F.col("contiguity") * F.col("a") / F.col("total")).alias("adjusted"))


def length_statistics(contigs: DataFrame) -> DataFrame:
    mean = contigs.agg(F.avg("len").alias("mean"))
    rows = contigs.crossJoin(F.broadcast(mean))
    return rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean_len"), F.stddev_samp("len").alias("stdev"), F.median("len").alias("median_len"), F.min("len").alias("min_len"), F.max("len").alias("max_len"), F.avg((F.col("len") < F.col("mean")).cast("double")).alias("below_mean"))


def length_histogram(contigs: DataFrame, least: int = 10, most: int = 50) -> DataFrame:
    """(bin, n): as many equal bins as the root of the number of contigs, between ``least`` and ``most``."""
    s = contigs.agg(F.min("len").alias("lo"), F.max("len").alias("hi"), F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.sqrt(F.count("*"))))).cast("int").alias("bins"))
    rows = contigs.crossJoin(F.broadcast(s))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("len") - F.col("lo")) * F.col("bins") / (F.col("hi") - F.col("lo"))), F.col("bins") - 1)).otherwise(0)
    return rows.groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def dominant_sources(placed: DataFrame) -> DataFrame:
    """(scaffold, src, len, share): the source of the largest share of itself in each scaffold, kept where no other scaffold whose
    first source it is has a larger share.  placed: scaffold, src, len; src null: unknown."""
    own = placed.where("src is not null").groupBy("scaffold", "src").agg(F.sum("len").cast("long").alias("len"))
    whole = own.groupBy("src").agg(F.sum("len").alias("whole"))
    rows = own.join(whole, "src").withColumn("share", F.col("len") / F.col("whole"))
    top = rows.withColumn("k", F.row_number().over(W.partitionBy("scaffold").orderBy(F.desc("share"), F.desc("len"), "src"))).where("k = 1")
    return top.withColumn("k", F.row_number().over(W.partitionBy("src").orderBy(F.desc("share"), "scaffold"))).where("k = 1").select("scaffold", "src", "len", "share")


def translocations(placed: DataFrame) -> DataFrame:
    """Placed rows of known source that isn't their scaffold's dominant one."""
    top = dominant_sources(placed).select("scaffold", "src")
    return placed.where("src is not null").join(top, ["scaffold", "src"], "left_anti")


CATEGORIES = ("syntenic", "unanchored", "newly_anchored", "translocation", "relocation", "inversion", "inversion_relocation")


def classify_run(rows: list[tuple]) -> dict:
    """Categories of one scaffold's members of its dominant source, in order: (ctg, signed index, len)."""
    ids, signs = [r[0] for r in rows], [r[1] for r in rows]
    weights = [r[2] for r in rows]

    def chain(own: list[int]) -> tuple[float, set]:
        w, at = heaviest_increasing([signs[k] for k in own], [weights[k] for k in own])
        return w, {own[x] for x in at}

    plus, minus = ([k for k, s in enumerate(signs) if (s > 0) == p] for p in (True, False))
    (wp, cp), (wm, cm) = chain(plus), chain(minus)
    winner, first = (True, cp) if wp >= wm else (False, cm)
    # maximal runs outside the chain whose signed indices follow each other
    moved: set[int] = set()
    turned = list(signs)
    rest = [k for k in range(len(rows)) if k not in first]
    run: list[int] = []
    runs = []
    for k in rest:
        if run and k == run[-1] + 1 and signs[k] == signs[run[-1]] + 1:
            run.append(k)
        else:
            if run:
                runs.append(run)
            run = [k]
    if run:
        runs.append(run)
    place = list(range(len(rows)))
    for r in runs:
        if (signs[r[0]] > 0) == winner:
            moved |= set(r)
        else:
            for a, b in zip(r, reversed(r), strict=True):
                turned[a] = -signs[b]
                place[a] = b
    own = [k for k in range(len(rows)) if (turned[k] > 0) == winner]
    w, at = heaviest_increasing([turned[k] for k in own], [weights[place[k]] for k in own])
    second = {place[own[x]] for x in at}
    out = {}
    for k in range(len(rows)):
        flipped = (signs[k] > 0) != winner
        if k in moved:
            out[ids[k]] = "relocation"
        elif k in first:
            out[ids[k]] = "syntenic" if k in second else "relocation"
        elif flipped:
            out[ids[k]] = "inversion" if k in second else "inversion_relocation"
        else:
            out[ids[k]] = "relocation"
    return out


def scaffold_categories(placed: DataFrame) -> DataFrame:
    """(scaffold, ctg, len, category): every placed contig in one of seven categories.

    placed: scaffold, pos, ctg, orient, len, src, idx, truth_orient, src_size (members of the source in truth).
    """
    n = placed.withColumn("n", F.count("*").over(W.partitionBy("scaffold")))
    alone = (F.col("n") == 1) & (F.coalesce("src_size", F.lit(0)) != 1)
    top = dominant_sources(placed).select("scaffold", "src", F.lit(True).alias("dominant"))
    rows = n.join(top, ["scaffold", "src"], "left").withColumn("early", F.when(alone, "unanchored").when(F.col("src").isNull(), "newly_anchored").when(F.col("dominant").isNull(), "translocation"))
    kind, skind = dict(placed.dtypes)["ctg"], dict(placed.dtypes)["scaffold"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        late = pdf[pdf["early"].isna()]
        sign = [int(i) if a == b else -int(i) for i, a, b in zip(late["idx"], late["orient"], late["truth_orient"], strict=True)]
        found = classify_run(list(zip(late["ctg"], sign, late["len"], strict=True)))
        pdf["category"] = [e if isinstance(e, str) else found[c] for c, e in zip(pdf["ctg"], pdf["early"], strict=True)]
        return pdf[["scaffold", "ctg", "len", "category"]]

    cols = rows.select("scaffold", "pos", "ctg", "orient", F.col("len").cast("long").alias("len"), "idx", "truth_orient", "early")
    return cols.groupBy("scaffold").applyInPandas(run, f"scaffold {skind}, ctg {kind}, len long, category string")


def truth_groups(contigs: DataFrame) -> DataFrame:
    """(src, ctg, idx, orient) from ids like chr1_1_183_..._-: source is the first two tokens, index the third, orientation the sixth."""
    t = F.split("ctg", "_")
    return contigs.select(F.substring_index("ctg", "_", 2).alias("src"), "ctg", t[2].try_cast("int").alias("idx"), t[5].alias("orient"))


# ------------------------------------------------------------ k-mers


def kmer_sources(kmers: DataFrame) -> DataFrame:
    """(kmer, source, cnt) of counted k-mers (kmer, source, cnt)."""
    return kmers.groupBy("kmer", "source").agg(F.sum("cnt").alias("cnt"))


def restricted_sources(reference: DataFrame, query: DataFrame) -> DataFrame:
    """Reference k-mers that the query has, by source: counted, then a semi-join.  reference: kmer, source, cnt; query: kmer."""
    return kmer_sources(reference).join(query.select("kmer").distinct(), "kmer", "left_semi")


def classify_bins(query: DataFrame, index: DataFrame) -> DataFrame:
    """(ctg, bin, unreliable, specific, shared, primary_source): k-mers of one source are specific to it.

    query: ctg, bin, kmer, cnt; index: kmer, source, cnt.  Query and index are read once.
    """
    kinds = index.groupBy("kmer").agg(F.countDistinct("source").alias("n"), F.min("source").alias("source"))
    rows = query.select("ctg", "bin", "kmer", "cnt").join(kinds, "kmer", "left")
    votes = rows.groupBy("ctg", "bin", F.when(F.col("n") > 1, 2).otherwise(F.col("n")).alias("n"), F.when(F.col("n") == 1, F.col("source")).alias("source")).agg(F.sum("cnt").alias("v"))
    of = lambda found: F.coalesce(F.sum(F.when(found, F.col("v"))), F.lit(0))
    best = F.min(F.when(F.col("n") == 1, F.struct((-F.col("v")).alias("v"), "source")))["source"]
    return votes.groupBy("ctg", "bin").agg(of(F.col("n").isNull()).alias("unreliable"), of(F.col("n") == 1).alias("specific"), of(F.col("n") > 1).alias("shared"), best.alias("primary_source"))


def dominant_chromosome(votes: DataFrame, least: float = 0.5) -> DataFrame:
    """(ctg, chr): the chromosome of most bins if it has at least ``least`` of them, else unreliable.  votes: ctg, chr."""
    rows = votes.groupBy("ctg", "chr").agg(F.count("*").alias("n"))
    total = rows.groupBy("ctg").agg(F.sum("n").alias("all"), F.max_by("chr", F.struct("n", "chr")).alias("top"), F.max("n").alias("best"))
    return total.select("ctg", F.when(F.col("best") >= least * F.col("all"), F.col("top").cast("string")).otherwise("unreliable").alias("chr"))


def names_chromosome(ctg: Column) -> Column:
    """Whether an id carries a chromosome's name; assemblers' own ids (scaffold, Contig, tig, numbers) don't."""
    return ~ctg.rlike(r"^(scaffold|Contig|tig|\d)")
