"""Files: tables written in each format to the shared folder and read back by its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphweave.operators import build as B
from graphweave.operators import compare as M
from graphweave.operators import contacts as C
from graphweave.operators import evaluate as V
from graphweave.operators import reassign as R
from graphweave.sources import bam as BAM
from graphweave.sources import formats as X

from . import proxies as P
from .book import Book
from .proxies import sql

BOOK = Book()
query = BOOK.add


def folder(spark) -> str:
    return f"{P.checkpoints(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def lines(df, place: str):
    """Rows of a ``value`` as a text file."""
    df.select("value").write.text(place)
    return place


_BARE = r"regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g')"
_FASTA = f"s AS (SELECT doc_id, lang, source, {_BARE} AS seq FROM documents WHERE text IS NOT NULL)"
_sites = lambda x: f"((length({x}) - length(replace({x}, 'the', ''))) // 3)::BIGINT"


def _fasta(spark, d):
    docs = P.table(spark, d, "documents").where("text is not null")
    name = F.concat_ws("_", "lang", F.col("source"), F.col("doc_id").cast("string"))
    note = F.when(F.col("source") == "src1", " collapsed").when(F.col("source") == "src2", " chimeric 2").otherwise("")
    body = F.regexp_replace("text", r"[\s>]+", "\n")  # lines of a word each
    return docs, lines(docs.select(F.concat(F.lit(">"), name, note, F.lit("\n"), body).alias("value")), folder(spark))


@query(f"WITH {_FASTA.replace('[ ', '[> ')} SELECT lang || '_' || source || '_' || doc_id AS ctg, length(seq)::BIGINT AS len, (1 + {_sites('seq')})::BIGINT AS re_sites, md5(seq) AS digest FROM s")
def fasta_scan(spark, d):
    """All sequences with lengths and sites."""
    _, place = _fasta(spark, d)
    return X.read_fasta(spark, place, ["the"], keep_case=True).select("ctg", F.col("len").cast("long").alias("len"), F.col("re_sites").cast("long").alias("re_sites"), F.md5("seq").alias("digest"))


@query(f"WITH {_FASTA.replace('[ ', '[> ')} SELECT lang || '_' || source || '_' || doc_id AS ctg, length(seq)::BIGINT AS len FROM s WHERE source NOT IN ('src1', 'src2')")
def fasta_lengths(spark, d):
    """Lengths of an evaluation: records that are called collapsed or chimeric leave."""
    return X.evaluation_lengths(X.read_fasta(spark, _fasta(spark, d)[1], keep_case=True)).select("ctg", F.col("len").cast("long").alias("len"))


@query(f"WITH {_FASTA.replace('[ ', '[> ')} SELECT lang || '_' || source AS src, count(*) AS n, sum({_sites('seq')})::BIGINT AS re_sites, sum(length(seq))::BIGINT AS len FROM s GROUP BY 1")
def fasta_truth_sources(spark, d):
    """Sources by name, with sites and lengths; empty ids and headerless text would be errors."""
    rows = X.truth_sources(X.read_fasta(spark, _fasta(spark, d)[1], keep_case=True, strict=True), "the")
    return rows.groupBy("src").agg(F.count("*").alias("n"), F.sum("re_sites").cast("long").alias("re_sites"), F.sum("len").cast("long").alias("len"))


def _pairs(spark, d):
    c = P.contacts(spark, d)
    own = P.table(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), F.lit(3).cast("long").alias("x"), F.col("s_suppkey").alias("j"), F.lit(5).cast("long").alias("y"))
    rows = c.select("i", "x", "j", "y").union(own)
    return lines(rows.select(F.concat_ws("\t", F.concat(F.lit("r"), F.xxhash64("i", "x", "j", "y").cast("string")), *[F.col(k).cast("string") for k in ("i", "x", "j", "y")], F.lit("+"), F.lit("-")).alias("value")), folder(spark))


_OWN = ", p AS (SELECT i, x, j, y FROM contacts UNION ALL SELECT s_suppkey, 3, s_suppkey, 5 FROM supplier)"


@query(sql("contacts") + _OWN + " SELECT i::VARCHAR AS ref, j::VARCHAR AS mref, count(*) AS n, sum(x - 1)::BIGINT AS pos, sum(y - 1)::BIGINT AS mpos FROM p GROUP BY 1, 2")
def pairs_scan(spark, d):
    return X.read_pairs(spark, _pairs(spark, d)).groupBy("ref", "mref").agg(F.count("*").alias("n"), F.sum("pos").alias("pos"), F.sum("mpos").alias("mpos"))


@query(sql("contacts") + " SELECT least(i::VARCHAR, j::VARCHAR) AS i, greatest(i::VARCHAR, j::VARCHAR) AS j, count(*) AS links FROM contacts GROUP BY 1, 2")
def pairs_to_edges(spark, d):
    """From a file to edges: pairs inside a contig leave while reading."""
    return C.edge_counts(C.canonical(X.read_pairs(spark, _pairs(spark, d), inter_only=True).select("ref", "pos", "mref", "mpos")))


@query("SELECT user_id::VARCHAR AS ref, count(*) AS n, sum(event_id)::BIGINT AS pos, count(*) FILTER (event_id % 3 = 0) AS dup FROM events WHERE event_id % 2 = 0 AND event_type <> 'click' GROUP BY 1")
def sam_scan(spark, d):
    """First reads of pairs; mates that aren't mapped leave."""
    e = P.table(spark, d, "events")
    flag = 1 + F.when(F.col("event_id") % 2 == 0, 64).otherwise(128) + F.when(F.col("event_id") % 3 == 0, 1024).otherwise(0)
    cells = [F.concat(F.lit("q"), F.col("event_id").cast("string")), flag.cast("string"), F.col("user_id").cast("string"), (F.col("event_id") + 1).cast("string"), F.lit("60"), F.lit("5M"), F.when(F.col("event_type") == "click", "*").otherwise("="), F.lit("9"), F.lit("0"), F.lit("*"), F.lit("*"), F.lit("NM:i:2")]
    place = lines(e.select(F.concat_ws("\t", *cells).alias("value")), folder(spark))
    rows = X.read_sam(spark, place)
    first = X.sam_contacts(rows)
    dup = rows.select("ord", "duplicate")
    return first.join(dup, "ord").groupBy("ref").agg(F.count("*").alias("n"), F.sum("pos").alias("pos"), F.count_if("duplicate").alias("dup"))


_BAM = "WITH e AS (SELECT event_id, user_id::VARCHAR AS ref, ((user_id * 7 + event_id) % 1000)::VARCHAR AS mref, event_id + 1 AS pos, CAST(json_extract_string(props, '$.k') AS BIGINT) AS nm, 64 * (1 - event_id % 2) + 128 * (event_id % 2) + 1 AS flag, event_id % 61 AS mapq FROM events)"


def _bam(spark, d):
    """Events as alignments in BAM files; users are contigs."""
    e = P.table(spark, d, "events")
    odd = F.col("event_id") % 2
    reads = e.select(
        F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("qname"), (64 * (1 - odd) + 128 * odd + 1).cast("int").alias("flag"), F.col("user_id").cast("string").alias("rname"), (F.col("event_id") + 1).alias("pos"),
        (F.col("event_id") % 61).cast("int").alias("mapq"), ((F.col("user_id") * 7 + F.col("event_id")) % 1000).cast("string").alias("rnext"), F.lit(9).cast("long").alias("pnext"), F.get_json_object("props", "$.k").cast("long").alias("nm"),
    )
    users = e.agg(F.max("user_id")).first()[0]
    place = folder(spark)
    BAM.write_bam(reads, [(str(k), 1 << 30) for k in range(max(1000, (users or 0) + 1))], place).agg(F.sum("n_rows")).collect()
    BAM.register(spark)
    return spark.read.format("bam").option("split", 20_000).load(place)


@query(_BAM + " SELECT ref, count(*) AS n, sum(pos)::BIGINT AS pos, sum(nm)::BIGINT AS nm, count(DISTINCT mref) AS mates, sum(mapq)::BIGINT AS mapq, bit_xor(flag)::BIGINT AS flags FROM e GROUP BY 1")
def bam_scan(spark, d):
    """All alignments of BAM files, read in splits of 20,000 bytes."""
    return _bam(spark, d).groupBy(F.col("rname").alias("ref")).agg(F.count("*").alias("n"), F.sum("pos").alias("pos"), F.sum("nm").alias("nm"), F.countDistinct("rnext").alias("mates"), F.sum("mapq").alias("mapq"), F.bit_xor(F.col("flag").cast("long")).alias("flags"))


@query(_BAM + " SELECT least(ref, mref) AS i, greatest(ref, mref) AS j, count(*) AS links FROM e WHERE flag & 64 <> 0 AND ref <> mref AND mapq >= 20 GROUP BY 1, 2")
def bam_to_edges(spark, d):
    """Edges of first reads of good quality, whose mates lie elsewhere: the filters reach the decoder."""
    rows = _bam(spark, d).where("first_read = true and inter = true and mapq >= 20")
    return C.edge_counts(C.canonical(rows.select(F.col("rname").alias("ref"), "pos", F.col("rnext").alias("mref"), F.col("pnext").alias("mpos"))))


@query("WITH c AS (SELECT s_suppkey AS k, s_nationkey % 2 AS hap FROM supplier) SELECT k::VARCHAR AS ctg, CASE WHEN k % 11 = 0 THEN 'missing' ELSE 'length' END AS reason FROM c WHERE k % 11 = 0 OR k % 7 = 0 UNION ALL SELECT 'x' || n_nationkey, 'extra' FROM nation")
def gfa_check(spark, d):
    """Segments of two files against contigs: missing, extra and of another length."""
    s = P.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_nationkey") % 2).alias("hap"), F.abs(F.col("s_acctbal")).cast("long").alias("depth"))
    extra = P.table(spark, d, "nation").select(F.concat(F.lit("x"), F.col("n_nationkey").cast("string")).alias("name"), F.lit(0).alias("hap"), F.lit(P.SPAN).alias("len"), F.lit(0).cast("long").alias("depth"))
    rows = s.where("k % 11 <> 0").select(F.col("k").cast("string").alias("name"), "hap", F.when(F.col("k") % 7 == 0, P.SPAN + 1).otherwise(P.SPAN).alias("len"), "depth").union(extra)
    files = [lines(rows.where(F.col("hap") == h).select(F.concat_ws("\t", F.lit("S"), "name", F.lit("*"), F.concat(F.lit("LN:i:"), F.col("len").cast("string")), F.concat(F.lit("rd:i:"), F.col("depth").cast("string"))).alias("value")), folder(spark)) for h in (0, 1)]
    return X.check_gfa(X.read_gfa(spark, files), P.spans(spark, d).select(F.col("ctg").cast("string").alias("ctg"), "len"))


_NAMED = sql("contigs", "groups") + ", t AS (SELECT grp, count(*) AS n_ctg, sum(len)::BIGINT AS len FROM groups_ JOIN contigs USING (ctg) GROUP BY 1), r AS (SELECT grp, 'group' || row_number() OVER (ORDER BY len DESC, grp) || '_' || len || 'bp' AS name FROM t)"


@query(_NAMED + " SELECT r.name AS grp, g.ctg::VARCHAR AS ctg, c.re_sites, c.len, row_number() OVER (PARTITION BY r.name ORDER BY c.len DESC, g.ctg::VARCHAR) AS rank FROM groups_ g JOIN r USING (grp) JOIN contigs c USING (ctg)")
def group_files(spark, d):
    """One file per group, named by rank and length, and read back."""
    g, c = P.groups(spark, d), P.contigs(spark, d)
    names = R.rename_groups(g, c).select("grp", "name")
    place = folder(spark)
    X.write_group_files(g.join(F.broadcast(names), "grp").select(F.col("name").alias("grp"), "ctg"), c, place)
    return X.read_group_files(spark, f"{place}/*.txt").withColumn("rank", F.col("rank").cast("long"))


@query(sql("contigs", "groups") + ", t AS (SELECT grp, sum(len) AS t FROM groups_ JOIN contigs USING (ctg) GROUP BY 1) SELECT grp::VARCHAR AS grp, ctg::VARCHAR AS ctg FROM groups_ JOIN t USING (grp) WHERE t >= 50000")
def clusters_file(spark, d):
    """A clusters file written and read; short groups leave."""
    place = folder(spark)
    X.write_clusters(P.groups(spark, d), P.contigs(spark, d), place)
    return X.long_groups(X.read_clusters(spark, place), P.contigs(spark, d).select(F.col("ctg").cast("string").alias("ctg"), "len"), 50_000)


@query(sql("contigs") + " SELECT 'hap' || hap AS grp, ctg, re_sites, len, row_number() OVER (PARTITION BY hap ORDER BY len DESC, ctg) AS rank FROM contigs")
def mock_groups(spark, d):
    """A group for each haplotype."""
    return R.mock_groups(P.contigs(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query(sql("contacts") + ", o AS (SELECT i, j, unnest([{'o': '++', 'd': 50 - (x - 1) + (y - 1)}, {'o': '+-', 'd': 50 - (x - 1) + 50 - (y - 1)}, {'o': '-+', 'd': (x - 1) + (y - 1)}, {'o': '--', 'd': (x - 1) + 50 - (y - 1)}]) AS r FROM contacts) SELECT i::VARCHAR AS i, j::VARCHAR AS j, r.o AS ori, 2 * count(*) AS n, (2 * sum(r.d))::BIGINT AS total, max(r.d)::BIGINT AS longest FROM o GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def clm_file(spark, d):
    """Distances written and read."""
    place = folder(spark)
    X.write_clm(C.distance_lines(C.distance_runs(P.rich(spark, d), 2 * P.lines(spark, d)), whole=True), place)
    return X.read_clm(spark, place).select("i", "j", "ori", "n", F.aggregate("d", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max("d").alias("longest"))


_AGP = "o AS (SELECT source AS grp, doc_id AS ctg, length(text) AS len, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, lang FROM documents)"


@query(f"WITH {_AGP} SELECT grp AS scaffold, k AS pos, ctg::VARCHAR AS ctg, len::BIGINT AS len, CASE WHEN ctg % 2 = 0 THEN '+' ELSE '-' END AS orient, CASE WHEN ctg % 5 <> 0 THEN lang END AS src FROM o")
def agp_truth(spark, d):
    """Scaffolds to a file and back; what truth knows of their members."""
    s = P.sequences(spark, d)
    t = s.select(F.col("source").alias("grp"), F.row_number().over(W.partitionBy("source").orderBy("ctg")).alias("pos"), "ctg", F.when(F.col("ctg") % 2 == 0, "+").otherwise("-").alias("orient"))
    place = folder(spark)
    X.write_agp(B.coordinates(t, s).withColumnRenamed("grp", "scaffold").select(*[c for c in X.AGP]), place)
    truth = s.where("ctg % 5 <> 0").select(F.col("ctg").cast("string").alias("ctg"), F.col("lang").alias("src"), F.lit(1).alias("idx"), F.lit("+").alias("orient"))
    return X.agp_members(X.read_agp(spark, place), truth).select("scaffold", F.col("pos").cast("long").alias("pos"), "ctg", "len", "orient", "src")


@query(sql("contigs", "tours") + " SELECT 'g' || grp AS grp, pos, ctg::VARCHAR AS ctg, orient FROM tours WHERE tour = 't2'")
def tour_files(spark, d):
    """A tour file per group, and read back."""
    t = P.tours(spark, d).where("tour = 't2'")
    place = folder(spark)
    X.write_tour_files(t.select(F.concat(F.lit("g"), F.col("grp").cast("string")).alias("grp"), "pos", "ctg", "orient"), place)
    return X.read_tours(spark, f"{place}/*.tour").withColumn("pos", F.col("pos").cast("long"))


@query("SELECT l_suppkey::VARCHAR AS \"queryID\", count(*) AS n, sum(l_quantity) AS aligned, min(l_linenumber)::DOUBLE AS first_start FROM lineitem WHERE l_quantity >= 10 GROUP BY 1")
def paf_file(spark, d):
    """Alignments to a file and back, the short ones left out."""
    li = P.table(spark, d, "lineitem")
    n = lambda c: F.col(c).cast("long").cast("string")
    cells = [n("l_suppkey"), F.lit("50"), n("l_linenumber"), n("l_quantity"), F.lit("+"), n("l_partkey"), F.lit("99"), F.lit("0"), F.lit("9"), n("l_quantity"), n("l_quantity"), F.lit("60"), F.lit("tp:A:P")]
    rows = X.read_paf(spark, lines(li.select(F.concat_ws("\t", *cells).alias("value")), folder(spark)))
    return rows.where("lenAln >= 10").groupBy("queryID").agg(F.count("*").alias("n"), F.sum("lenAln").alias("aligned"), F.min("queryStart").alias("first_start"))


@query("SELECT doc_id::VARCHAR AS contig, 0::BIGINT AS start, length(text)::BIGINT AS \"end\", lang AS primary_source, 1.0 / (1 + doc_id) AS alpha, length(text)::BIGINT AS specific, (doc_id * 3)::BIGINT AS shared FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def annotation_file(spark, d):
    docs = P.table(spark, d, "documents").where("text is not null and lang is not null")
    rows = docs.select(F.col("doc_id").cast("string").alias("contig"), F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end"), F.col("lang").alias("primary_source"), (1 / (1 + F.col("doc_id"))).alias("alpha"), F.create_map(F.lit("specific"), F.length("text").cast("long"), F.lit("shared"), (F.col("doc_id") * 3).cast("long")).alias("stats"))
    place = folder(spark)
    X.write_annotation(rows, place)
    return X.read_annotation(spark, place).select("contig", "start", "end", "primary_source", "alpha", F.col("stats")["specific"].alias("specific"), F.col("stats")["shared"].alias("shared"))


@query("SELECT p_type AS \"type\", count(DISTINCT p_brand) AS brands FROM part GROUP BY 1")
def name_set(spark, d):
    """Names that stand in a file, each once, counted by what they belong to."""
    p = P.table(spark, d, "part")
    names = X.read_name_set(spark, lines(p.select(F.concat_ws("|", "p_type", "p_brand").alias("value")), folder(spark)))
    return names.groupBy(F.substring_index("ctg", "|", 1).alias("type")).agg(F.count("*").alias("brands"))


@query("WITH i AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'scaffold' WHEN 1 THEN 'Contig' WHEN 2 THEN 'tig' WHEN 3 THEN 'chr' ELSE '' END || doc_id AS id FROM documents) SELECT doc_id, id FROM i WHERE doc_id % 5 = 3")
def id_predicates(spark, d):
    """Contigs whose id names a chromosome; those with an assembler's ids leave."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("scaffold", "Contig", "tig", "chr", "")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return P.table(spark, d, "documents").select("doc_id", F.concat(kind, F.col("doc_id").cast("string")).alias("id")).where(V.names_chromosome(F.col("id")))


@query("WITH r AS (SELECT l_linenumber % 4 AS size, l_suppkey % 8 AS mask_id, count(*) AS n_groups, sum(l_quantity) AS covered FROM lineitem GROUP BY 1, 2) SELECT size::BIGINT AS size, count(*) AS runs, sum(n_groups)::BIGINT AS total_groups, round(avg(n_groups), 6) AS mean_groups, min(n_groups) AS least_groups, max(n_groups) AS most_groups FROM r GROUP BY 1")
def mask_run_summary(spark, d):
    """Groups of all masks of each bin size."""
    li = P.table(spark, d, "lineitem")
    runs = li.groupBy((F.col("l_linenumber") % 4).cast("long").alias("size"), (F.col("l_suppkey") % 8).alias("mask_id")).agg(F.count("*").alias("n_groups"))
    return M.mask_summary(runs, "size").withColumn("mean_groups", F.round("mean_groups", 6))


@query("WITH t AS (SELECT p_brand AS a, p_type AS b, CAST(p_size AS VARCHAR) AS c, p_partkey AS e FROM part) SELECT a, b, c, count(DISTINCT e) AS common FROM t GROUP BY 1, 2, 3")
def triple_overlaps(spark, d):
    """Elements that three groupings' classes have in common: the base of the consensus alternatives."""
    from graphweave.operators import consensus as K

    p = P.table(spark, d, "part")
    of = lambda c: p.select(F.col(c).cast("string").alias("class"), F.col("p_partkey").alias("element"))
    return K.triple_overlaps(of("p_brand"), of("p_type"), of("p_size"))


@query()
def consensus_triplets(spark, d):
    """Disjoint triplets of classes, the largest common sets first."""
    from graphweave.operators import consensus as K

    s = P.table(spark, d, "supplier")
    of = lambda m: s.select(((F.col("s_nationkey") + F.when(F.col("s_suppkey") % m == 0, 1).otherwise(0)) % 25).cast("string").alias("class"), F.col("s_suppkey").alias("element"))
    return K.greedy_triplets(K.triple_overlaps(of(7), of(11), of(13)))


@query()
def consensus_assignment(spark, d):
    """The triplets of the largest total over all nations' classes, and the bound that proves it."""
    from graphweave.operators import consensus as K

    s = P.table(spark, d, "supplier")
    of = lambda m: s.select(((F.col("s_nationkey") + F.when(F.col("s_suppkey") % m == 0, 1).otherwise(0)) % 25).cast("string").alias("class"), F.col("s_suppkey").alias("element"))
    return K.best_triplets(K.triple_overlaps(of(7), of(11), of(13)))
