"""Comparisons of methods by metrics, and alignment layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import carried, positions, running_sum


def long_form(table: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return table.unpivot(keys, metrics, "metric", "value")


def signed(better_low: list[str]) -> Column:
    return F.when(F.col("metric").isin(better_low), -F.col("value")).otherwise(F.col("value"))


def ranking(rows: DataFrame, better_low: list[str], dataset: str = "dataset", method: str = "method") -> DataFrame:
    """Adds ``place`` per dataset and metric: 1 is best; equal values by method name."""
    w = W.partitionBy(dataset, "metric").orderBy(F.desc("s"), method)
    return rows.where("value is not null").withColumn("s", signed(better_low)).withColumn("place", F.row_number().over(w)).drop("s")


def best_per_group(rows: DataFrame, better_low: list[str], dataset: str = "dataset", method: str = "method") -> DataFrame:
    return ranking(rows, better_low, dataset, method).where("place = 1").drop("place")


def first_places(rows: DataFrame, better_low: list[str], dataset: str = "dataset", method: str = "method") -> DataFrame:
    return best_per_group(rows, better_low, dataset, method).groupBy(method).agg(F.count("*").alias("firsts"))


def rank_points(rows: DataFrame, better_low: list[str], points: tuple[int, ...] = (3, 2, 1), dataset: str = "dataset", method: str = "method") -> DataFrame:
    own = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, p in enumerate(points) for x in (k + 1, p)]), F.col("place")), F.lit(0))
    return ranking(rows, better_low, dataset, method).groupBy(method).agg(F.sum(own).cast("long").alias("points"))


def win_rate(rows: DataFrame, better_low: list[str], dataset: str = "dataset", method: str = "method") -> DataFrame:
    """Share of a method's comparisons (dataset and metric) that it wins."""
    ranked = ranking(rows, better_low, dataset, method)
    return ranked.groupBy(method).agg(F.avg((F.col("place") == 1).cast("double")).alias("win_rate"))


def group_means(rows: DataFrame, method: str = "method") -> DataFrame:
    return rows.groupBy(method, "metric").agg(F.avg("value").alias("mean_value"))


def fill_down(lines: DataFrame, order: str, value: str, is_head: Column, name: str) -> DataFrame:
    """Block text: each row takes the value of the last header row before it."""
    return carried(lines, order, F.when(is_head, F.col(value)), name)


# ------------------------------------------------------------ alignments


def paf_filter(paf: DataFrame, query_total: float = 400_000, least: float = 10_000, reference: float = 1_000_000) -> DataFrame:
    """Alignments of queries with enough aligned length, long enough, on long references."""
    total = F.sum("lenAln").over(W.partitionBy("queryID"))
    return paf.withColumn("t", total).where((F.col("t") > query_total) & (F.col("lenAln") > least) & (F.col("refLen") > reference)).drop("t")


def axis_offsets(lengths: DataFrame, key: str, order: list) -> DataFrame:
    """(key, len, shift): the summed lengths before each sequence."""
    return running_sum(lengths, order, F.col("len"), "shift")


def query_order(paf: DataFrame, reference_rank: DataFrame) -> DataFrame:
    """(queryID, refID, at, rank): by the rank of the reference with most aligned length, then where the longest hit starts."""
    by_ref = paf.groupBy("queryID", "refID").agg(F.sum("lenAln").alias("t"))
    top = by_ref.withColumn("k", F.row_number().over(W.partitionBy("queryID").orderBy(F.desc("t"), "refID"))).where("k = 1").select("queryID", "refID")
    longest = paf.join(top, ["queryID", "refID"]).groupBy("queryID", "refID").agg(F.max_by("refStart", F.struct("lenAln", -F.col("refStart"))).alias("at"))
    rows = positions(longest.join(reference_rank.select("refID", "ref_rank"), "refID"), ["ref_rank", "at", "queryID"], "before")
    return rows.select("queryID", "refID", "at", (F.col("before") + 1).alias("rank"))


def net_reversed(paf: DataFrame) -> DataFrame:
    """(queryID, flip): queries with more reversed than forward aligned length."""
    return paf.groupBy("queryID").agg((F.sum(F.when(F.col("strand") == "-", F.col("lenAln")).otherwise(-F.col("lenAln"))) > 0).alias("flip"))


def mask_summary(runs: DataFrame, by: str) -> DataFrame:
    """Per ``by``: how many masked runs there are, and their groups in all, on average, at least and at most.  runs: by, mask_id, n_groups."""
    n = "n_groups"
    return runs.groupBy(by).agg(F.count("*").alias("runs"), F.sum(n).alias("total_groups"), F.avg(n).alias("mean_groups"), F.min(n).alias("least_groups"), F.max(n).alias("most_groups"))
