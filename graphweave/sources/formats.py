"""Readers and writers of the text formats, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphweave.functions.sequence import count_motifs

WHITE = r"\s+"


def _lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("line"), F.col("_metadata.file_path").alias("file"))


def base_name(file: Column, ending: str = r"\.[^./]*$") -> Column:
    return F.regexp_replace(F.element_at(F.split(file, "/"), -1), ending, "")


# ------------------------------------------------------------ sequences


def read_fasta(spark: SparkSession, path, motifs: list[str] | None = None, keep_case: bool = False, strict: bool = False) -> DataFrame:
    """(ctg, header, seq, len[, re_sites]): records start at a line with ``>``; the last of a repeated id counts.

    ``strict``: empty ids, text before the first header and files without sequences are errors.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "\r", "").alias("v"), F.monotonically_increasing_id().alias("ord"), F.col("_metadata.file_path").alias("file"))
    # the first record of a file keeps its mark, as nothing stands before it; what has no mark and isn't cut off is headerless
    raw = raw.where(F.col("v").rlike(r"\S"))
    if strict:
        heads = raw.groupBy("file").agg(F.max(F.col("v").rlike(r"^\s*>")).alias("ok"))
        found = heads.agg(F.count("*").alias("n"), F.min("ok").alias("ok")).first()
        if not found["n"] or not found["ok"]:
            raise ValueError("there are no sequences, or text stands before the first header")
    rows = raw.withColumn("v", F.regexp_replace("v", r"^\s*>", ""))
    header = F.regexp_extract("v", r"^([^\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("v", r"^[^\n]*\n?", ""), r"\s", "")
    out = rows.select(F.regexp_extract(header, r"^\s*(\S+)", 1).alias("ctg"), F.trim(header).alias("header"), (body if keep_case else F.upper(body)).alias("seq"), "ord")
    if strict:
        bad = F.when(F.col("ctg") == "", F.raise_error(F.lit("a sequence has no id"))).otherwise(F.col("ctg"))
        out = out.withColumn("ctg", bad)
    last = F.max_by(F.struct("header", "seq"), "ord").alias("s")
    out = out.where("ctg <> ''").groupBy("ctg").agg(last).select("ctg", "s.header", "s.seq", F.length("s.seq").cast("long").alias("len"))
    return out if motifs is None else out.withColumn("re_sites", count_motifs(F.col("seq"), motifs) + 1)


def evaluation_lengths(fasta: DataFrame) -> DataFrame:
    """Lengths without records whose header names them collapsed or chimeric."""
    return fasta.where(~F.col("header").rlike("collapsed|chimeric")).select("ctg", "len")


def truth_sources(fasta: DataFrame, motif: str = "GATC") -> DataFrame:
    return fasta.select("ctg", F.substring_index("ctg", "_", 2).alias("src"), count_motifs(F.col("seq"), [motif]).alias("re_sites"), "len")


def write_fasta(rows: DataFrame, path: str, name: str = "grp") -> None:
    rows.select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), F.col("seq"))).write.text(path)


# ------------------------------------------------------------ contacts


def read_pairs(spark: SparkSession, path, inter_only: bool = False) -> DataFrame:
    """(ord, read, ref, pos, mref, mpos) from .pairs text (also gzipped); positions become 0-based."""
    lines = _lines(spark, path).where("trim(line) <> '' and not startswith(line, '#')")
    c = F.split(F.trim("line"), WHITE)
    rows = lines.select(F.monotonically_increasing_id().alias("ord"), c[0].alias("read"), c[1].alias("ref"), (c[2].cast("long") - 1).alias("pos"), c[3].alias("mref"), (c[4].cast("long") - 1).alias("mpos"))
    return rows.where("ref <> mref") if inter_only else rows


def read_sam(spark: SparkSession, path) -> DataFrame:
    """(ord, qname, flag, rname, pos, mapq, rnext, pnext, nm, duplicate); positions 0-based, ``=`` resolved."""
    c = F.split("line", "\t")
    rows = _lines(spark, path).where("line <> '' and not startswith(line, '@')")
    nm = F.regexp_extract("line", r"\tNM:i:(\d+)", 1)
    return rows.select(F.monotonically_increasing_id().alias("ord"), c[0].alias("qname"), c[1].cast("int").alias("flag"), c[2].alias("rname"), (c[3].cast("long") - 1).alias("pos"), c[4].cast("int").alias("mapq"), F.when(c[6] == "=", c[2]).otherwise(c[6]).alias("rnext"), (c[7].cast("long") - 1).alias("pnext"), F.when(nm != "", nm.try_cast("long")).otherwise(F.lit(0)).alias("nm"), (c[1].cast("int").bitwiseAND(1024) != 0).alias("duplicate"))


def sam_contacts(rows: DataFrame, inter_only: bool = False) -> DataFrame:
    """First reads of pairs as contacts."""
    out = rows.where(F.col("flag").bitwiseAND(64) != 0).select("ord", F.col("rname").alias("ref"), "pos", F.col("rnext").alias("mref"), F.col("pnext").alias("mpos")).where("ref <> '*' and mref <> '*'")
    return out.where("ref <> mref") if inter_only else out


def sorting_order(header: DataFrame) -> str:
    """``SO`` of a SAM header (rows with a ``line``): coordinate order is an error, as pairs must stand together."""
    found = header.where("startswith(line, '@HD')").select(F.regexp_extract("line", r"\tSO:(\S+)", 1)).first()
    order = (found and found[0]) or "unknown"
    if order == "coordinate":
        raise ValueError("the alignments are sorted by coordinate; sort them by name")
    return order


# ------------------------------------------------------------ graphs and groups


def read_gfa(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(hap, ctg, len, depth) of segment lines; hap is the file's place in the list, from 0."""
    out = None
    for k, p in enumerate(paths):
        c = F.split("line", "\t")
        part = _lines(spark, p).where("startswith(line, 'S\t')").select(F.lit(k).alias("hap"), c[1].alias("ctg"), F.regexp_extract("line", r"\tLN:i:(\d+)", 1).try_cast("long").alias("len"), F.regexp_extract(F.element_at(c, 5), r":(\d+)$", 1).try_cast("long").alias("depth"))
        out = part if out is None else out.union(part)
    return out


def check_gfa(segments: DataFrame, contigs: DataFrame) -> DataFrame:
    """(ctg, reason): contigs without a segment and segments of another length; segments without a contig only warn."""
    s, c = segments.select("ctg", F.col("len").alias("seg_len")), contigs.select("ctg", "len")
    rows = c.join(s, "ctg", "full")
    reason = F.when(F.col("seg_len").isNull(), "missing").when(F.col("len").isNull(), "extra").when(F.col("len") != F.col("seg_len"), "length")
    return rows.select("ctg", reason.alias("reason")).where("reason is not null")


def read_clusters(spark: SparkSession, path) -> DataFrame:
    """(grp, ctg) of a clusters file: name, number, contigs apart by spaces."""
    c = F.split("line", "\t")
    return _lines(spark, path).where("trim(line) <> '' and not startswith(line, '#')").select(c[0].alias("grp"), F.explode(F.split(F.trim(c[2]), WHITE)).alias("ctg"))


def long_groups(groups: DataFrame, contigs: DataFrame, least: float) -> DataFrame:
    """Members of groups of at least ``least`` length in all."""
    total = groups.join(contigs.select("ctg", "len"), "ctg").groupBy("grp").agg(F.sum("len").alias("t")).where(F.col("t") >= least)
    return groups.join(total, "grp", "left_semi")


def read_group_files(spark: SparkSession, path) -> DataFrame:
    """(grp, ctg, re_sites, len, rank): one file per group, longest contig first."""
    c = F.split("line", WHITE)
    rows = _lines(spark, path).where("trim(line) <> '' and not startswith(line, '#')").select(base_name(F.col("file")).alias("grp"), c[0].alias("ctg"), c[1].cast("long").alias("re_sites"), c[2].cast("long").alias("len"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("grp").orderBy(F.desc("len"), "ctg")))


def read_assembly(spark: SparkSession, path) -> DataFrame:
    """(grp, pos, ctg, orient): header lines number the contigs; each other line is a group of signed numbers."""
    lines = _lines(spark, path).where("trim(line) <> ''").withColumn("ord", F.monotonically_increasing_id())
    h = F.split(F.expr("substring(line, 2)"), WHITE)
    names = lines.where("startswith(line, '>')").select(h[0].alias("ctg"), h[1].cast("long").alias("num"))
    rows = lines.where("not startswith(line, '>')").select("ord", F.posexplode(F.split(F.trim("line"), WHITE)).alias("k", "n"))
    rank = F.dense_rank().over(W.orderBy("ord"))
    numbered = rows.select(rank.alias("grp"), (F.col("k") + 1).alias("pos"), F.abs(F.col("n").cast("long")).alias("num"), F.when(F.col("n").startswith("-"), "-").otherwise("+").alias("orient"))
    return numbered.join(names, "num").select("grp", "pos", "ctg", "orient")


def write_clusters(groups: DataFrame, contigs: DataFrame, path: str) -> None:
    """Groups by length, their contigs by length."""
    rows = groups.join(contigs.select("ctg", "len"), "ctg").groupBy("grp").agg(F.sum("len").alias("total"), F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("len")).alias("k"), "ctg"))), lambda x: x["ctg"]).alias("c"))
    rows.orderBy(F.desc("total"), "grp").select(F.concat_ws("\t", F.col("grp").cast("string"), F.col("n").cast("string"), F.array_join("c", " ")).alias("value")).coalesce(1).write.text(path)


def write_named(lines: DataFrame, folder: str, ending: str) -> None:
    """A file ``folder/<name><ending>`` for each name of (name, ord, value), its lines by ord.

    Each name's lines are written by one task; the files get their names after that,
    one rename a name.
    """
    spark = lines.sparkSession
    lines.repartition("name").sortWithinPartitions("name", "ord").select("name", "value").write.partitionBy("name").text(f"{folder}/parts")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for own in fs.listStatus(path(f"{folder}/parts")):
        if own.isDirectory():
            name = own.getPath().getName().split("=", 1)[1]
            for f in fs.listStatus(own.getPath()):
                if f.getPath().getName().startswith("part-"):
                    fs.rename(f.getPath(), path(f"{folder}/{name}{ending}"))
    fs.delete(path(f"{folder}/parts"), True)


def write_group_files(groups: DataFrame, contigs: DataFrame, folder: str) -> None:
    """A file per group (grp, ctg): contigs with sites and lengths, the longest first."""
    rows = groups.join(contigs.select("ctg", "re_sites", "len"), "ctg")
    body = rows.select(F.col("grp").alias("name"), F.struct(-F.col("len"), F.col("ctg").cast("string")).alias("ord"), F.concat_ws("\t", F.col("ctg").cast("string"), F.col("re_sites").cast("string"), F.col("len").cast("string")).alias("value"))
    head = groups.select(F.col("grp").alias("name")).distinct().select("name", F.struct(F.lit(None).cast(rows.schema["len"].dataType), F.lit(None).cast("string")).alias("ord"), F.lit("#Contig\tRECounts\tLength").alias("value"))
    write_named(body.union(head), folder, ".txt")


def write_tour_files(tours: DataFrame, folder: str) -> None:
    """A file per group of (grp, pos, ctg, orient): one line of oriented members."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.col("ctg").cast("string"), "orient").alias("m")))), lambda x: x["m"]), " ")
    write_named(tours.groupBy("grp").agg(line.alias("line")).select(F.concat(F.col("grp").cast("string"), F.lit("_1")).alias("name"), F.lit(0).alias("ord"), F.concat(F.lit(">INIT\n"), F.col("line")).alias("value")), folder, ".tour")


def write_annotation(rows: DataFrame, path: str) -> None:
    """(contig, start, end, primary_source, alpha, stats) as lines; stats as ``{'name': number, ...}``."""
    stats = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("stats"), lambda e: F.concat(F.lit("'"), e["key"], F.lit("': "), e["value"].cast("string"))), ", "), F.lit("}"))
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("contig", "start", "end", "primary_source", "alpha")]
    rows.select(F.concat_ws("\t", *cells, stats).alias("value")).write.text(path)


def write_csv(rows: DataFrame, path: str, sep: str = ",") -> None:
    """A table with a header in every file."""
    rows.write.option("header", True).option("sep", sep).csv(path)


def read_clm(spark: SparkSession, path) -> DataFrame:
    """(i, j, ori, n, d): distances per pair and orientation."""
    c = F.split("line", "\t")
    p = F.split(F.trim(c[0]), WHITE)
    name = lambda x: F.regexp_replace(x, r"[+-]$", "")
    sign = lambda x: F.regexp_extract(x, r"([+-])$", 1)
    return _lines(spark, path).where("trim(line) <> ''").select(name(p[0]).alias("i"), name(p[1]).alias("j"), F.concat(sign(p[0]), sign(p[1])).alias("ori"), c[1].cast("long").alias("n"), F.transform(F.split(F.trim(c[2]), WHITE), lambda v: v.cast("long")).alias("d"))


def write_clm(lines: DataFrame, path: str) -> None:
    """One line per pair and orientation.  lines: i, j, ori, n, line (the distances as text)."""
    left = F.concat(F.col("i").cast("string"), F.substring("ori", 1, 1), F.lit(" "), F.col("j").cast("string"), F.substring("ori", 2, 1))
    lines.select(F.concat_ws("\t", left, F.col("n").cast("string"), "line").alias("value")).write.text(path)


# ------------------------------------------------------------ tours and scaffolds


def read_tours(spark: SparkSession, path) -> DataFrame:
    """(grp, pos, ctg, orient): the last line of each file that isn't blank; the group is the name up to its last underscore."""
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    last = F.try_element_at(F.filter(F.split("value", r"\r?\n"), lambda x: x.rlike(r"\S")), F.lit(-1))
    name = F.element_at(F.split("file", "/"), -1)
    rows = whole.select(F.regexp_replace(F.regexp_replace(name, r"\.tour$", ""), r"_[^_]*$", "").alias("grp"), F.posexplode(F.split(F.trim(last), WHITE)).alias("k", "m"))
    return rows.select("grp", (F.col("k") + 1).alias("pos"), F.regexp_replace("m", r"[+-]$", "").alias("ctg"), F.regexp_extract("m", r"([+-])$", 1).alias("orient"))


def write_tours(lines: DataFrame, path: str) -> None:
    """lines: grp, line."""
    lines.select("grp", F.concat(F.lit(">INIT\n"), F.col("line")).alias("value")).write.partitionBy("grp").text(path)


AGP = ("scaffold", "beg", "end", "part", "type", "comp", "comp_beg", "comp_end", "orient")


def read_agp(spark: SparkSession, path) -> DataFrame:
    c = F.split("line", "\t")
    kinds = ("string", "long", "long", "int", "string", "string", "long", "long", "string")
    return _lines(spark, path).where("trim(line) <> '' and not startswith(line, '#')").select(*[c[k].try_cast(t).alias(n) for k, (n, t) in enumerate(zip(AGP, kinds, strict=True))])


def agp_members(agp: DataFrame, truth: DataFrame) -> DataFrame:
    """(scaffold, pos, ctg, len, orient, src, idx, truth_orient): members in order; src null where truth has none."""
    w = W.partitionBy("scaffold").orderBy("beg")
    rows = agp.where("type = 'W'").select("scaffold", F.row_number().over(w).alias("pos"), F.col("comp").alias("ctg"), (F.col("end") - F.col("beg") + 1).alias("len"), "orient")
    return rows.join(truth.select("ctg", "src", "idx", F.col("orient").alias("truth_orient")), "ctg", "left").select("scaffold", "pos", "ctg", "len", "orient", "src", "idx", "truth_orient")


def write_agp(agp: DataFrame, path: str) -> None:
    cells = [F.coalesce(F.col(c).cast("string"), F.lit({"comp_beg": "scaffold", "comp_end": "yes", "orient": "proximity_ligation"}.get(c, ""))) for c in agp.columns]
    agp.select(F.concat_ws("\t", *cells).alias("value")).write.text(path)


def read_truth(spark: SparkSession, path) -> DataFrame:
    """(src, ctg, idx, orient): group files whose contigs' ids carry index (third token) and orientation (sixth)."""
    rows = read_group_files(spark, path)
    t = F.split("ctg", "_")
    return rows.select(F.regexp_replace("grp", "^group_", "").alias("src"), "ctg", t[2].try_cast("int").alias("idx"), t[5].alias("orient"))


PAF = ("queryID", "queryLen", "queryStart", "queryEnd", "strand", "refID", "refLen", "refStart", "refEnd", "numResidueMatches", "lenAln", "mapQ")


def read_paf(spark: SparkSession, path) -> DataFrame:
    """The first twelve columns; missing ones are null, numbers are doubles."""
    c = F.split(F.trim("line"), WHITE)
    return _lines(spark, path).where("trim(line) <> ''").select(*[(F.get(c, F.lit(k)) if n in ("queryID", "strand", "refID") else F.get(c, F.lit(k)).try_cast("double")).alias(n) for k, n in enumerate(PAF)])


def filter_paf_lines(spark: SparkSession, path, names: list[str]) -> DataFrame:
    """Lines of the named groups: columns 1 to 12, matches from the divergence tag."""
    c = F.split("line", "\t")
    de = F.regexp_extract("line", r"\tde:f:([0-9.eE+-]+)", 1).try_cast("double")
    rows = _lines(spark, path).where(F.col("line").rlike("|".join(names)))
    return rows.select(*[F.get(c, F.lit(k)).alias(n) for k, n in enumerate(PAF) if n != "numResidueMatches"], F.round((1 - de) * F.get(c, F.lit(10)).try_cast("double")).cast("long").alias("numResidueMatches"))


def read_annotation(spark: SparkSession, path) -> DataFrame:
    """(contig, start, end, primary_source, alpha, stats) with the last column a map of numbers."""
    c = F.split("line", "\t")
    pairs = F.regexp_extract_all(c[5], F.lit(r"'([^']+)'\s*[:,]\s*(\d+)"), F.lit(1)), F.regexp_extract_all(c[5], F.lit(r"'([^']+)'\s*[:,]\s*(\d+)"), F.lit(2))
    stats = F.map_from_arrays(pairs[0], F.transform(pairs[1], lambda v: v.cast("long")))
    return _lines(spark, path).where("trim(line) <> '' and not startswith(line, 'contig\t')").select(c[0].alias("contig"), c[1].cast("long").alias("start"), c[2].cast("long").alias("end"), c[3].alias("primary_source"), c[4].try_cast("double").alias("alpha"), stats.alias("stats"))


def read_name_set(spark: SparkSession, path) -> DataFrame:
    return _lines(spark, path).where("trim(line) <> ''").select(F.trim("line").alias("ctg")).distinct()


def count_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(dir, n): files per directory, by names that match."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path")
    return files.groupBy(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("dir")).agg(F.count("*").alias("n"))
