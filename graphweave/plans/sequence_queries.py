"""Sequences: motifs, bins, k-mers, lengths.  Documents stand for contigs."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphweave.functions import sequence as S
from graphweave.operators import build as B
from graphweave.operators import evaluate as V

from . import proxies as P
from .book import Book
from .proxies import sql

BOOK = Book()
query = BOOK.add

MOTIFS = S.expand_motif("th,eN", letters="nrst", keep_case=True)
_n = lambda x, m: f"(length({x}) - length(replace({x}, '{m}', ''))) // {len(m)}"
_count = lambda x, ms=None: "(" + " + ".join(_n(x, m) for m in (ms or MOTIFS)) + ")::BIGINT"


@query(f"SELECT doc_id AS ctg, {_count('text')} AS sites FROM documents")
def motif_sites(spark, d):
    return P.sequences(spark, d).select("ctg", S.count_motifs(F.col("seq"), MOTIFS).alias("sites"))


@query(f"SELECT doc_id AS ctg, 1 + CASE WHEN length(text) <= 400 THEN {_count('text')} ELSE {_count('substr(text, 1, 200)')} + {_count('substr(text, length(text) - 199, 200)')} END AS sites FROM documents")
def motif_flank_sites(spark, d):
    return P.sequences(spark, d).select("ctg", S.flank_count(F.col("seq"), F.col("len"), 200, MOTIFS).alias("sites"))


#: Code points in reverse; DuckDB's own reverse() keeps combined characters together.
_reverse = lambda x: f"array_to_string(list_reverse(regexp_extract_all(translate({x}, 'ATCGNatcgn', 'TAGCNtagcn'), '(?s).')), '')"


@query(f"SELECT doc_id AS ctg, md5({_reverse('text')}) AS digest FROM documents")
def revcomp(spark, d):
    return P.sequences(spark, d).select("ctg", F.md5(S.reverse_complement(F.col("seq"))).alias("digest"))


@query("WITH b AS (SELECT doc_id AS ctg, length(text) AS len, CASE WHEN length(text) > 500 THEN CAST(ceil(length(text) / 500) AS INT) ELSE 1 END AS n FROM documents), e AS (SELECT ctg, len, n, unnest(range(1, n + 1)) AS k FROM b) SELECT ctg, k::BIGINT AS bin_no, CASE WHEN n = 1 THEN len ELSE least(500, len - (k - 1) * 500) END::BIGINT AS frag_len, CASE WHEN n = 1 THEN ctg::VARCHAR ELSE ctg || '_bin' || k END AS frag FROM e")
def bin_split(spark, d):
    out = S.split_sequence(P.sequences(spark, d).select("ctg", "len"), 500)
    return out.select("ctg", F.col("bin_no").cast("long").alias("bin_no"), "frag_len", "frag")


# characters in rows, each with the five that follow, so that places in texts beyond ASCII are found at once
_KMERS = "WITH t AS (SELECT doc_id AS ctg, lang AS source, regexp_extract_all(text, '(?s).') AS p FROM documents WHERE length(text) >= 6), h AS (SELECT ctg, source, unnest(p) AS a, unnest(range(len(p))) AS i FROM t), k AS (SELECT ctg, source, i, a, lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS c, lead(a, 3) OVER w AS d, lead(a, 4) OVER w AS e, lead(a, 5) OVER w AS f FROM h WINDOW w AS (PARTITION BY ctg, source ORDER BY i)), u AS (SELECT ctg, source, i, a || b || c || d || e || f AS m, translate(f || e || d || c || b || a, 'ATCGNatcgn', 'TAGCNtagcn') AS r FROM k WHERE f IS NOT NULL), c AS (SELECT ctg, source, i, least(m, r) AS kmer FROM u WHERE m NOT LIKE '%N%')"


DEALT = 8000  # documents of a task


def _kmers(spark, d, which: str = "true", by: list[str] = (), size: int | None = None):
    n = P.tasks(spark, P.table(spark, d, "documents"), DEALT)
    rows = P.sequences(spark, d).where(which).select("ctg", F.col("lang").alias("source"), "seq")
    return S.counted_kmers(rows.repartition(n, "ctg"), 6, by, size)


@query(_KMERS + " SELECT kmer, count(*) AS cnt FROM c GROUP BY 1")
def kmer_counts(spark, d):
    return _kmers(spark, d).groupBy("kmer").agg(F.sum("cnt").alias("cnt"))


@query(_KMERS + ", q AS (SELECT DISTINCT kmer FROM c WHERE ctg % 100 = 0) SELECT kmer, source, count(*) AS cnt FROM c WHERE ctg % 100 <> 0 AND kmer IN (SELECT kmer FROM q) GROUP BY 1, 2")
def kmer_source(spark, d):
    """Sources of the k-mers that the query sequences (every hundredth) have."""
    return V.restricted_sources(_kmers(spark, d, "ctg % 100 <> 0", ["source"]), _kmers(spark, d, "ctg % 100 = 0"))


@query(_KMERS + """, x AS (SELECT kmer, count(DISTINCT source) AS n, min(source) AS source FROM c WHERE ctg % 100 <> 0 GROUP BY 1),
r AS (SELECT c.ctg, i // 200 AS bin, x.n, x.source FROM c LEFT JOIN x USING (kmer) WHERE c.ctg % 100 = 0),
p AS (SELECT ctg, bin, count(*) FILTER (n IS NULL) AS unreliable, count(*) FILTER (n = 1) AS specific, count(*) FILTER (n > 1) AS shared FROM r GROUP BY 1, 2),
v AS (SELECT ctg, bin, source, row_number() OVER (PARTITION BY ctg, bin ORDER BY count(*) DESC, source) AS k FROM r WHERE n = 1 GROUP BY 1, 2, 3)
SELECT p.*, v.source AS primary_source FROM p LEFT JOIN (SELECT * FROM v WHERE k = 1) v USING (ctg, bin)""".replace("SELECT p.*, v.source AS primary_source", "SELECT p.ctg, p.bin, unreliable, specific, shared, v.source AS primary_source"))
def kmer_bin_class(spark, d):
    return V.classify_bins(_kmers(spark, d, "ctg % 100 = 0", ["ctg"], 200), V.kmer_sources(_kmers(spark, d, "ctg % 100 <> 0", ["source"])))


@query("WITH s AS (SELECT sum(length(text)) AS total, avg(length(text)) AS mean FROM documents) SELECT greatest(1000, least(20000, CAST(floor(total / 20 / 30) AS BIGINT)))::BIGINT AS auto_size, f AS factor, round(mean * f, 6) AS size FROM s, (SELECT unnest([1, 2, 1.5, 0.5, 0.25])::DOUBLE AS f)")
def auto_bin_size(spark, d):
    """The bin size from the total length, and a grid of sizes from the mean length."""
    s = P.sequences(spark, d).agg(F.sum("len").alias("total"), F.avg("len").alias("mean"))
    return s.select(S.auto_bin_size(F.col("total"), 20, 1000, 20000).alias("auto_size"), F.explode(F.array(*[F.lit(float(x)) for x in (1, 2, 1.5, 0.5, 0.25)])).alias("factor"), "mean").select("auto_size", "factor", F.round(F.col("mean") * F.col("factor"), 6).alias("size"))


@query("WITH s AS (SELECT avg(length(text)) AS m FROM documents) SELECT count(*) AS n, round(avg(length(text)), 6) AS mean_len, round(stddev_samp(length(text)), 6) AS stdev, median(length(text)) AS median_len, min(length(text)) AS min_len, max(length(text)) AS max_len, round(avg((length(text) < m)::INT), 9) AS below_mean FROM documents, s")
def contig_stats(spark, d):
    out = V.length_statistics(P.sequences(spark, d).select("ctg", "len"))
    return out.select("n", F.round("mean_len", 6).alias("mean_len"), F.round("stdev", 6).alias("stdev"), "median_len", "min_len", "max_len", F.round("below_mean", 9).alias("below_mean"))


@query("WITH s AS (SELECT min(length(text)) AS lo, max(length(text)) AS hi, greatest(10, least(50, CAST(floor(sqrt(count(*))) AS INT))) AS bins FROM documents) SELECT CAST(least(floor((length(text) - lo) * bins / (hi - lo)), bins - 1) AS BIGINT) AS bin, count(*) AS n FROM documents, s GROUP BY 1")
def length_histogram(spark, d):
    return V.length_histogram(P.sequences(spark, d).select("ctg", "len"))


@query("WITH o AS (SELECT source AS grp, doc_id AS ctg, length(text) AS len, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY source) AS n, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS run FROM documents), a AS (SELECT grp, run + (k - 1) * 100 AS e, len, k, n, ctg FROM o) SELECT grp, (e - len + 1)::BIGINT AS beg, e::BIGINT AS \"end\", (2 * k - 1)::BIGINT AS part, 'W' AS type, ctg::VARCHAR AS comp FROM a UNION ALL SELECT grp, (e + 1)::BIGINT, (e + 100)::BIGINT, (2 * k)::BIGINT, 'U', '100' FROM a WHERE k < n")
def agp_coordinates(spark, d):
    return B.coordinates(_doc_tours(spark, d), P.sequences(spark, d)).select("grp", "beg", F.col("end").cast("long").alias("end"), F.col("part").cast("long").alias("part"), "type", "comp")


def _doc_tours(spark, d):
    from pyspark.sql import Window as W

    s = P.sequences(spark, d)
    return s.select(F.col("source").alias("grp"), F.row_number().over(W.partitionBy("source").orderBy("ctg")).alias("pos"), "ctg", F.when(F.col("ctg") % 2 == 0, "+").otherwise("-").alias("orient"))


@query(f"SELECT source AS grp, md5(string_agg(CASE WHEN doc_id % 2 = 0 THEN text ELSE {_reverse('text')} END, repeat('N', 100) ORDER BY doc_id)) AS digest, (sum(length(text)) + 100 * (count(*) - 1))::BIGINT AS len FROM documents GROUP BY 1")
def scaffold_sequence(spark, d):
    out = B.sequences(_doc_tours(spark, d), P.sequences(spark, d))
    return out.select("grp", F.md5("seq").alias("digest"), F.length("seq").cast("long").alias("len"))


@query("WITH t AS (SELECT doc_id, source, length(text) AS len FROM documents), p AS (SELECT source AS name, (sum(len) + 100 * (count(*) - 1))::BIGINT AS len, 0 AS kind FROM t WHERE doc_id % 3 <> 0 GROUP BY 1), u AS (SELECT doc_id::VARCHAR AS name, len::BIGINT AS len, 1 AS kind FROM t WHERE doc_id % 3 = 0) SELECT row_number() OVER (ORDER BY kind, len DESC, name) AS rank, name, len FROM (SELECT * FROM p UNION ALL SELECT * FROM u)")
def unplaced(spark, d):
    """Scaffolds by length, then what no tour holds."""
    P.checkpoints(spark)
    return B.scaffold_order(_doc_tours(spark, d).where("ctg % 3 <> 0"), P.sequences(spark, d).select("ctg", "len"))


@query("SELECT source AS grp, 2 * count(*) AS halves, string_agg(doc_id || CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END, ' ' ORDER BY doc_id) AS line FROM documents GROUP BY 1")
def tour_rows(spark, d):
    """Half contigs in order to tours and their text."""
    t = _doc_tours(spark, d)
    ends = t.select("grp", "ctg", F.posexplode(F.when(F.col("orient") == "+", F.array(F.lit("H"), F.lit("T"))).otherwise(F.array(F.lit("T"), F.lit("H")))).alias("k", "end"), "pos").select("grp", (2 * (F.col("pos") - 1) + F.col("k")).alias("pos"), "ctg", "end")
    n = ends.groupBy("grp").agg(F.count("*").alias("halves"))
    return B.tour_lines(B.tour_rows(ends)).join(n, "grp").select("grp", "halves", "line")
