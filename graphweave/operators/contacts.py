"""Contacts (pairs of positions) to keyed aggregates, from one enriched table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphweave.functions.sequence import bin_number, bin_offset, half, is_flank, orientation_distances


def canonical(contacts: DataFrame) -> DataFrame:
    """Ends in order of (name, position); positions become 1-based.  contacts: ref, mref, pos, mpos (0-based)."""
    a = F.struct(F.col("ref").alias("n"), (F.col("pos") + 1).alias("p"))
    b = F.struct(F.col("mref").alias("n"), (F.col("mpos") + 1).alias("p"))
    rest = [c for c in contacts.columns if c not in ("ref", "mref", "pos", "mpos")]
    lo, hi = F.least(a, b), F.greatest(a, b)
    return contacts.select(*rest, lo["n"].alias("i"), lo["p"].alias("x"), hi["n"].alias("j"), hi["p"].alias("y"))


def enrich(contacts: DataFrame, contigs: DataFrame) -> DataFrame:
    """Inner joins with both ends' lengths; contacts of unknown contigs leave.  Spark broadcasts contigs if they are small enough."""
    side = contigs.select("ctg", "len")
    return contacts.join(side.select(F.col("ctg").alias("i"), F.col("len").alias("li")), "i").join(side.select(F.col("ctg").alias("j"), F.col("len").alias("lj")), "j")


def dealt(rows: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """Rows dealt by keys to that many tasks before they are grouped; else Spark groups with the session's number of partitions.

    The contacts of a pair come from all over the table, so counts hardly combine before they move, and the
    maps of a fixed number of tasks grow with the table.
    """
    return rows.repartition(tasks, *keys) if tasks else rows


def edge_counts(contacts: DataFrame, tasks: int | None = None) -> DataFrame:
    return dealt(contacts.where("i <> j").select("i", "j"), tasks, "i", "j").groupBy("i", "j").agg(F.count("*").alias("links"))


def flank_edges(rich: DataFrame, flank: int, tasks: int | None = None) -> DataFrame:
    near = is_flank(F.col("x"), F.col("li"), flank) & is_flank(F.col("y"), F.col("lj"), flank)
    return edge_counts(rich.where(near), tasks)


def node_degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("i", "j")).alias("ctg"), "links")
    return ends.groupBy("ctg").agg(F.sum("links").cast("long").alias("degree"))


def half_edges(rich: DataFrame, tasks: int | None = None) -> DataFrame:
    """(i, i_end, j, j_end, links); both ends of a contact move as one small number."""
    tail = lambda x, n: (half(F.col(x), F.col(n)) == "T").cast("int")
    ends = rich.where("i <> j").select("i", "j", (2 * tail("x", "li") + tail("y", "lj")).cast("byte").alias("ends"))
    name = lambda bit: F.when(F.col("ends").bitwiseAND(bit) > 0, "T").otherwise("H")
    return dealt(ends, tasks, "i", "j").groupBy("i", "j", "ends").agg(F.count("*").alias("links")).select("i", name(2).alias("i_end"), "j", name(1).alias("j_end"), "links")


def whole_edges(halves: DataFrame, tasks: int | None = None) -> DataFrame:
    """(i, j, links) from ``half_edges``: the same as ``edge_counts`` of their contacts."""
    return dealt(halves.select("i", "j", "links"), tasks, "i", "j").groupBy("i", "j").agg(F.sum("links").alias("links"))


def distance_runs(rich: DataFrame, tasks: int | None = None) -> DataFrame:
    """(i, j, ori, dist, times): how often each distance occurs, per pair and orientation; counts combine before they move, or all of a pair go to one of ``tasks``."""
    own = dealt(rich.where("i <> j").select("i", "x", "j", "y", "li", "lj"), tasks, "i", "j")
    rows = own.select("i", "j", F.inline(orientation_distances(F.col("x") - 1, F.col("y") - 1, F.col("li"), F.col("lj"))))
    return rows.groupBy("i", "j", "ori", "dist").agg(F.count("*").alias("times"))


def distance_lines(runs: DataFrame, least: int = 2, whole: bool = False) -> DataFrame:
    """(i, j, ori, n, line): sorted distances, each twice, of pairs with ``least`` contacts.

    Runs are sorted inside partitions and read through once, so a pair is never gathered; only the
    text of its own line is held.  whole: no pair is in two partitions, as ``tasks`` of ``distance_runs`` deals them.
    """
    kinds = dict(runs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]):
        key, n, parts, out = None, 0, [], []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["i", "j", "ori", "n", "line"])

        for b in batches:
            types = [b.schema.field(c).type for c in ("i", "j", "ori")] + [pa.int64(), pa.string()]
            for i, j, ori, dist, times in zip(*[b[c].to_pylist() for c in ("i", "j", "ori", "dist", "times")], strict=True):
                if key != (i, j, ori):
                    if n >= least:
                        out.append((*key, 2 * n, "".join(parts)[:-1]))
                    key, n, parts = (i, j, ori), 0, []
                n += times
                parts.append(f"{dist} " * (2 * times))
            if out:
                yield batch()
        if n >= least:
            out.append((*key, 2 * n, "".join(parts)[:-1]))
            yield batch()

    rows = runs.select("i", "j", "ori", "dist", "times")
    rows = (rows if whole else rows.repartition("i", "j", "ori")).sortWithinPartitions("i", "j", "ori", "dist")
    return rows.mapInArrow(run, f"i {kinds['i']}, j {kinds['j']}, ori string, n long, line string")


def fragment_edges(rich: DataFrame, size: int, tasks: int | None = None) -> DataFrame:
    """Edges between fragments: (contig, bin) pairs; contacts inside one fragment leave."""
    rows = rich.select("i", "j", bin_number(F.col("x"), size).alias("bi"), bin_number(F.col("y"), size).alias("bj"), bin_offset(F.col("x"), size).alias("ox"), bin_offset(F.col("y"), size).alias("oy"))
    return dealt(rows.where("i <> j or bi <> bj").select("i", "bi", "j", "bj"), tasks, "i", "j").groupBy("i", "bi", "j", "bj").agg(F.count("*").alias("links"))


def cells(rich: DataFrame, flank: int, size: int, tasks: int | None = None) -> DataFrame:
    """(i, j, i_end, j_end, near, bi, bj, links): contacts by all that the aggregates tell apart, in one pass and one exchange."""
    near = is_flank(F.col("x"), F.col("li"), flank) & is_flank(F.col("y"), F.col("lj"), flank)
    rows = rich.select("i", "j", half(F.col("x"), F.col("li")).alias("i_end"), half(F.col("y"), F.col("lj")).alias("j_end"), near.alias("near"), bin_number(F.col("x"), size).alias("bi"), bin_number(F.col("y"), size).alias("bj"))
    return dealt(rows, tasks, "i", "j").groupBy(*rows.columns).agg(F.count("*").alias("links"))


def aggregates(found: DataFrame, tasks: int | None = None) -> dict[str, DataFrame]:
    """Edges, flank edges, degrees, half edges and fragment edges from ``cells`` (best written first: all five read it)."""
    total = lambda rows, *by: dealt(rows, tasks, "i", "j").groupBy(*by).agg(F.sum("links").alias("links"))
    between = found.where("i <> j")
    edges = total(between, "i", "j")
    return {
        "edges": edges, "flank": total(between.where("near"), "i", "j"), "degree": node_degree(edges),
        "halves": total(between, "i", "i_end", "j", "j_end"), "fragments": total(found.where("i <> j or bi <> bj"), "i", "bi", "j", "bj"),
    }


def first_per_pair(contacts: DataFrame, order: list[str], most: int = 200, tasks: int | None = None) -> DataFrame:
    """The first ``most`` contacts of each pair in arrival order."""
    return dealt(contacts, tasks, "i", "j").withColumn("rank", F.row_number().over(W.partitionBy("i", "j").orderBy(*order))).where(F.col("rank") <= most)


def concordance(contacts: DataFrame, shorter: str = "shorter", windows: int = 50, tasks: int | None = None) -> DataFrame:
    """Largest share of a pair's contacts in one window of y - x or of y + x; null where windows would be empty."""
    width = F.floor(F.col(shorter) / windows)
    rows = dealt(contacts, tasks, "i", "j").select("i", "j", F.explode(F.array(F.struct(F.lit("d").alias("axis"), (F.col("y") - F.col("x")).alias("v")), F.struct(F.lit("s").alias("axis"), (F.col("y") + F.col("x")).alias("v")))).alias("a"), width.alias("w"))
    binned = rows.groupBy("i", "j", F.col("a.axis").alias("axis"), F.when(F.col("w") > 0, F.floor(F.col("a.v") / F.col("w"))).alias("b")).agg(F.count("*").alias("c"), F.max("w").alias("w"))
    total = binned.groupBy("i", "j", "axis").agg(F.max("c").alias("top"), F.sum("c").alias("n"), F.max("w").alias("w"))
    return total.groupBy("i", "j").agg(F.max(F.when(F.col("w") > 0, F.col("top") / F.col("n"))).alias("concordance"))


def concentration(contacts: DataFrame, size: int, factor: int = 10, tasks: int | None = None) -> DataFrame:
    """(1 - cx)(1 - cy): c is the share of contacts in bins with at least ``factor`` times the median bin's number."""
    rows = dealt(contacts, tasks, "i", "j").select("i", "j", F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("x").alias("v")), F.struct(F.lit("y").alias("axis"), F.col("y").alias("v")))).alias("a"))
    counts = rows.groupBy("i", "j", F.col("a.axis").alias("axis"), F.floor(F.col("a.v") / size).alias("b")).agg(F.count("*").alias("c"))
    mid = counts.groupBy("i", "j", "axis").agg(F.collect_list("c").alias("cs"), F.median("c").alias("m"))
    heavy = F.aggregate(F.filter("cs", lambda c: c >= factor * F.col("m")), F.lit(0).cast("long"), lambda a, c: a + c)
    share = heavy / F.aggregate("cs", F.lit(0).cast("long"), lambda a, c: a + c)
    return mid.groupBy("i", "j").agg((F.max(F.when(F.col("axis") == "x", 1 - share)) * F.max(F.when(F.col("axis") == "y", 1 - share))).alias("adjustment"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, as (u, v, w)."""
    return edges.select(F.col("i").alias("u"), F.col("j").alias("v"), F.col("links").alias("w")).union(edges.select(F.col("j"), F.col("i"), F.col("links")))
