"""Scaffolds from tours: coordinates, sequences and contigs left over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import positions

from graphweave.functions.sequence import reverse_complement

GAP = 100


def check_tours(tours: DataFrame, contigs: DataFrame) -> DataFrame:
    """Members that are unknown or placed more than once, with the reason; none if all is well."""
    unknown = tours.join(contigs.select("ctg"), "ctg", "left_anti").select("ctg", F.lit("unknown").alias("reason")).distinct()
    twice = tours.groupBy("ctg").agg(F.count("*").alias("n")).where("n > 1").select("ctg", F.lit("repeated").alias("reason"))
    return unknown.union(twice)


def coordinates(tours: DataFrame, contigs: DataFrame, gap: int = GAP, shared_part_numbers: bool = False) -> DataFrame:
    """AGP rows: members (W) and gaps between them (U) in running coordinates.

    ``shared_part_numbers`` gives a gap the number of the member after it.
    """
    w = W.partitionBy("grp").orderBy("pos")
    rows = tours.join(contigs.select("ctg", "len"), "ctg").withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(W.partitionBy("grp")))
    rows = rows.withColumn("end", F.sum("len").over(w) + (F.col("k") - 1) * gap)
    member_no = F.col("k") if shared_part_numbers else 2 * F.col("k") - 1
    gap_no = F.col("k") + 1 if shared_part_numbers else 2 * F.col("k")
    own = rows.select("grp", (F.col("end") - F.col("len") + 1).alias("beg"), "end", member_no.cast("int").alias("part"), F.lit("W").alias("type"), F.col("ctg").cast("string").alias("comp"), F.lit(1).cast("long").alias("comp_beg"), F.col("len").cast("long").alias("comp_end"), "orient")
    gaps = rows.where("k < n").select("grp", (F.col("end") + 1).alias("beg"), (F.col("end") + gap).alias("end"), gap_no.cast("int").alias("part"), F.lit("U").alias("type"), F.lit(str(gap)).alias("comp"), F.lit(None).cast("long").alias("comp_beg"), F.lit(None).cast("long").alias("comp_end"), F.lit(None).cast("string").alias("orient"))
    return own.union(gaps)


def original_coordinates(agp: DataFrame) -> DataFrame:
    """Members named ``name:beg-end`` point to that stretch of ``name``."""
    cut = r"^(.*):(\d+)-(\d+)$"
    named = F.col("comp").rlike(cut) & (F.col("type") == "W")
    start = F.regexp_extract("comp", cut, 2).try_cast("long")
    return agp.select(*[c for c in agp.columns if c not in ("comp", "comp_beg", "comp_end")], F.when(named, F.regexp_extract("comp", cut, 1)).otherwise(F.col("comp")).alias("comp"), F.when(named, start).otherwise(F.col("comp_beg")).alias("comp_beg"), F.when(named, start + F.col("comp_end") - 1).otherwise(F.col("comp_end")).alias("comp_end"))


def sequences(tours: DataFrame, contigs: DataFrame, gap: int = GAP) -> DataFrame:
    """(grp, seq): members in order, reversed ones complemented, joined by gaps."""
    own = F.when(F.col("orient") == "-", reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    rows = tours.join(contigs.select("ctg", "seq"), "ctg").groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("pos", own.alias("s")))).alias("parts"))
    return rows.select("grp", F.array_join(F.transform("parts", lambda p: p["s"]), "N" * gap).alias("seq"))


def unplaced(tours: DataFrame, contigs: DataFrame) -> DataFrame:
    return contigs.join(tours.select("ctg"), "ctg", "left_anti")


def scaffold_order(tours: DataFrame, contigs: DataFrame, gap: int = GAP) -> DataFrame:
    """(rank, name, len): scaffolds by length, then unplaced contigs by length."""
    made = tours.join(contigs.select("ctg", "len"), "ctg").groupBy(F.col("grp").cast("string").alias("name")).agg((F.sum("len") + (F.count("*") - 1) * gap).cast("long").alias("len")).withColumn("kind", F.lit(0))
    rest = unplaced(tours, contigs).select(F.col("ctg").cast("string").alias("name"), F.col("len").cast("long").alias("len"), F.lit(1).alias("kind"))
    return positions(made.union(rest), ["kind", F.desc("len"), "name"], "before").select((F.col("before") + 1).alias("rank"), "name", "len")


def tour_rows(ends: DataFrame) -> DataFrame:
    """(grp, pos, ctg, orient) from half contigs in order: every other one, H first reads forward.  ends: grp, pos (from 0), ctg, end."""
    return ends.where("pos % 2 = 0").select("grp", (F.col("pos") / 2 + 1).cast("int").alias("pos"), "ctg", F.when(F.col("end") == "H", "+").otherwise("-").alias("orient"))


def tour_lines(tours: DataFrame) -> DataFrame:
    """(grp, line): a tour as text."""
    parts = F.array_sort(F.collect_list(F.struct("pos", F.concat(F.col("ctg").cast("string"), F.col("orient")).alias("s"))))
    return tours.groupBy("grp").agg(parts.alias("p")).select("grp", F.array_join(F.transform("p", lambda x: x["s"]), " ").alias("line"))
