"""Ordering, tours and scores against truth."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphweave.operators import contacts as C
from graphweave.operators import evaluate as V
from graphweave.operators import order as O
from graphweave.operators.tables import written

from . import proxies as P
from .book import Book
from .proxies import sql

BOOK = Book()
query = BOOK.add

_HALF = sql("contacts", "contigs") + ", h AS (SELECT i, CASE WHEN 2 * x > 50 THEN 'T' ELSE 'H' END AS i_end, j, CASE WHEN 2 * y > 50 THEN 'T' ELSE 'H' END AS j_end, count(*) AS links FROM contacts GROUP BY 1, 2, 3, 4), hd AS (SELECT i, i_end, j, j_end, links / ((a.len / 2) * (b.len / 2)) AS density FROM h JOIN contigs a ON a.ctg = i JOIN contigs b ON b.ctg = j)"


def _halves(spark, d):
    return C.half_edges(P.rich(spark, d), P.lines(spark, d))


@query(_HALF + " SELECT i, i_end, j, j_end, round(density * 1e6, 6) AS density FROM hd")
def half_density(spark, d):
    out = O.half_densities(_halves(spark, d), P.contigs(spark, d))
    return out.withColumn("density", F.round(F.col("density") * 1e6, 6))


@query(_HALF + """, e AS (SELECT i || i_end AS a, j || j_end AS b, density FROM hd),
n AS (SELECT a AS n, density, a || '/' || b AS id FROM e UNION ALL SELECT b, density, a || '/' || b FROM e),
r AS (SELECT n, density, id, row_number() OVER (PARTITION BY n ORDER BY density DESC) AS k FROM n),
o AS (SELECT e.a, e.b, e.density AS d, r.density, row_number() OVER (PARTITION BY e.a, e.b ORDER BY r.density DESC) AS m FROM e JOIN r ON r.n IN (e.a, e.b) AND r.k <= 3 AND r.id <> e.a || '/' || e.b),
t AS (SELECT e.a, e.b, e.density, max(o.density) FILTER (m = 1) AS f, coalesce(max(o.density) FILTER (m = 2), 0) AS s FROM e LEFT JOIN o ON o.a = e.a AND o.b = e.b GROUP BY 1, 2, 3)
SELECT a, b, round(CASE WHEN f IS NULL OR f <= 0 THEN 2 WHEN f <= density THEN density / f ELSE density / greatest(s, density) END, 6) AS confidence FROM t""".replace("e JOIN r ON r.n IN (e.a, e.b) AND r.k <= 3 AND", "(SELECT a, b, density, unnest([a, b]) AS en FROM e) e JOIN r ON r.n = e.en AND r.k <= 3 AND"))
def edge_confidence(spark, d):
    P.checkpoints(spark)
    h = O.half_densities(_halves(spark, d), written(P.contigs(spark, d).select("ctg", "len"), "contigs"))
    e = h.select(F.concat(F.col("i").cast("string"), "i_end").alias("a"), F.concat(F.col("j").cast("string"), "j_end").alias("b"), "density")
    e = written(e.sortWithinPartitions("a", "b"), "edges")
    return O.edge_confidence(e, P.lines(spark, d)).select("a", "b", F.round("confidence", 6).alias("confidence"))


@query()
def fast_order(spark, d):
    """Every group's members ordered and oriented; each member once."""
    g = P.groups(spark, d)
    own = _halves(spark, d).join(g.select(F.col("ctg").alias("i"), "grp"), "i").join(g.select(F.col("ctg").alias("j"), F.col("grp").alias("other")), "j").where("grp = other")
    return O.fast_order(own, g.join(P.contigs(spark, d).select("ctg", "len"), "ctg"))


def _lines(spark, d):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    line = P.table(spark, d, "lineitem")
    return line.select("l_orderkey", F.row_number().over(w).alias("pos"), F.col("l_partkey").alias("val"), F.col("l_quantity").cast("double").alias("weight"))


@query("""WITH RECURSIVE l AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS pos, l_partkey AS val, l_quantity AS w FROM lineitem WHERE l_orderkey % 5 = 0),
c AS (SELECT o, pos, val, w AS total FROM l UNION ALL SELECT l.o, l.pos, l.val, c.total + l.w FROM c JOIN l ON l.o = c.o AND l.pos > c.pos AND l.val > c.val)
SELECT o AS l_orderkey, max(total) AS lis_weight FROM c GROUP BY 1""".replace(" WHERE l_orderkey % 5 = 0", ""))
def weighted_lis(spark, d):
    """Heaviest increasing run of parts in each order."""
    return O.increasing_weights(_lines(spark, d), "l_orderkey", "pos", "val", "weight")


def _tours(spark, d):
    return P.tours(spark, d)


@query()
def order_choice(spark, d):
    """Which of two orders of each group to keep."""
    import pandas as pd

    t = _tours(spark, d).where("tour in ('t1', 't2')").join(P.contigs(spark, d).select("ctg", "len"), "ctg")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = {k: x.sort_values("pos")["ctg"].tolist() for k, x in pdf.groupby("tour")}
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "choice": [O.choose_order(own["t1"], own["t2"], dict(zip(pdf["ctg"], pdf["len"], strict=True)))]})

    return t.groupBy("grp").applyInPandas(run, "grp long, choice string")


_SIM = sql("contigs", "tours") + ", b AS (SELECT grp, ctg, pos AS p0 FROM tours WHERE tour = 't1'), x AS (SELECT t.grp, t.tour, t.ctg, t.pos, b.p0 FROM tours t JOIN b USING (grp, ctg)), sim AS (SELECT p.grp, p.tour, avg((p.pos < q.pos)::INT) AS forward, avg((p.pos > q.pos)::INT) AS backward FROM x p JOIN x q ON p.grp = q.grp AND p.tour = q.tour AND p.p0 < q.p0 GROUP BY 1, 2)"


@query(_SIM + " SELECT grp, tour, round(forward, 9) AS forward, round(backward, 9) AS backward FROM sim")
def tour_similarity(spark, d):
    t = _tours(spark, d)
    return O.similarity_to_base(t, t.where("tour = 't1'")).select("grp", "tour", F.round("forward", 9).alias("forward"), F.round("backward", 9).alias("backward"))


@query(sql("contigs", "tours") + ", e AS (SELECT grp, tour, ctg || orient AS a, lead(ctg || orient) OVER (PARTITION BY grp, tour ORDER BY pos) AS b FROM tours) SELECT grp, a, b, count(DISTINCT tour) AS support FROM e WHERE b IS NOT NULL GROUP BY 1, 2, 3")
def edge_support(spark, d):
    return O.edge_support(_tours(spark, d))


@query(sql("contigs", "tours") + ", e AS (SELECT grp, tour, ctg || orient AS a, lead(ctg || orient) OVER (PARTITION BY grp, tour ORDER BY pos) AS b FROM tours), s AS (SELECT grp, a, b, count(DISTINCT tour) AS support FROM e WHERE b IS NOT NULL GROUP BY 1, 2, 3) SELECT grp, round(avg(support), 6) AS mean_support, min(support) AS least, max(support) AS most, round(stddev_pop(support), 6) AS deviation FROM s GROUP BY 1")
def support_stats(spark, d):
    return O.edge_support(_tours(spark, d)).groupBy("grp").agg(F.round(F.avg("support"), 6).alias("mean_support"), F.min("support").alias("least"), F.max("support").alias("most"), F.round(F.stddev_pop("support"), 6).alias("deviation"))


@query(_SIM + """, n AS (SELECT grp, count(*) AS n FROM b GROUP BY 1),
al AS (SELECT t.grp, t.tour, CASE WHEN coalesce(backward > forward, false) THEN n.n + 1 - t.pos ELSE t.pos END AS pos, t.ctg, CASE WHEN coalesce(backward > forward, false) THEN translate(orient, '+-', '-+') ELSE orient END AS orient, coalesce(greatest(forward, backward), 1) AS similarity FROM tours t JOIN n USING (grp) LEFT JOIN sim USING (grp, tour)),
e AS (SELECT grp, tour, ctg || orient AS a, lead(ctg || orient) OVER (PARTITION BY grp, tour ORDER BY pos) AS b FROM al),
s AS (SELECT grp, a, b, count(DISTINCT tour) AS support FROM e WHERE b IS NOT NULL GROUP BY 1, 2, 3),
m AS (SELECT e.grp, e.tour, avg(support) AS support FROM e JOIN s ON s.grp = e.grp AND s.a = e.a AND s.b = e.b GROUP BY 1, 2),
f AS (SELECT al.grp, al.tour, max(similarity) AS similarity, coalesce(max(m.support), 0) AS support FROM al LEFT JOIN m ON m.grp = al.grp AND m.tour = al.tour GROUP BY 1, 2)
SELECT grp, tour, round(support, 6) AS support FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(support, 9) DESC, round(similarity, 9) DESC, tour) AS k FROM f) WHERE k = 1""")
def tour_consensus(spark, d):
    """The tour whose edges other tours support best, once all are turned alike."""
    t = _tours(spark, d)
    return O.best_tours(t, t.where("tour = 't1'")).select("grp", "tour", F.round("support", 6).alias("support"))


# ------------------------------------------------------------ scores


def _members(spark, d):
    """Groups are blocks of suppliers; sources are region and haplotype."""
    c = P.contigs(spark, d)
    return c.select((F.col("ctg") % 12).alias("grp"), "ctg", "len", F.col("chr").cast("string").alias("chr"), F.concat_ws("_", F.col("chr").cast("string"), F.col("hap").cast("string")).alias("src"))


_MEMBERS = sql("contigs") + ", mem AS (SELECT ctg % 12 AS grp, ctg, len, chr::VARCHAR AS chr, chr || '_' || hap AS src FROM contigs), sl AS (SELECT grp, chr, src, sum(len)::BIGINT AS len, row_number() OVER (PARTITION BY grp ORDER BY sum(len) DESC, src DESC) AS rank FROM mem WHERE grp IN (SELECT grp FROM mem GROUP BY 1 HAVING count(*) >= 2) GROUP BY 1, 2, 3), top AS (SELECT grp, chr AS tchr, src AS dominant FROM sl WHERE rank = 1), he AS (SELECT grp, dominant, coalesce(sum(len) FILTER (rank > 1 AND chr = tchr), 0)::BIGINT AS homolog_error, coalesce(sum(len) FILTER (rank > 1 AND chr <> tchr), 0)::BIGINT AS other_error, sum(len)::BIGINT AS anchored FROM sl JOIN top USING (grp) GROUP BY 1, 2)"


@query(_MEMBERS + " SELECT * FROM he")
def eval_homolog_errors(spark, d):
    return V.homolog_errors(_members(spark, d))


@query(_MEMBERS + ", per AS (SELECT src, max(len) / sum(len) AS c FROM sl GROUP BY 1), x AS (SELECT avg(c) AS contiguity FROM per), e AS (SELECT count(*) AS n_groups, sum(homolog_error) AS h, sum(other_error) AS o, sum(anchored) AS a FROM he), t AS (SELECT sum(len) AS total FROM contigs) SELECT n_groups, round(contiguity, 6) AS contiguity, round(100 * h / a, 6) AS homolog_error, round(100 * o / a, 6) AS other_error, round(100 * (h + o) / a, 6) AS total_error, round(100 * a / total, 6) AS anchoring, round(contiguity * a / total, 6) AS adjusted FROM x, e, t")
def eval_clustering(spark, d):
    total = P.contigs(spark, d).agg(F.sum("len").alias("total"))
    out = V.clustering_score(_members(spark, d), total)
    return out.select("n_groups", *[F.round(c, 6).alias(c) for c in out.columns if c != "n_groups"])


_SCAFF = sql("contigs") + ", pl AS (SELECT ctg % 12 AS scaffold, CASE WHEN ctg % 17 = 0 THEN NULL ELSE 's' || nation END AS src, ctg, len FROM contigs), own AS (SELECT scaffold, src, sum(len)::BIGINT AS len FROM pl WHERE src IS NOT NULL GROUP BY 1, 2), sh AS (SELECT *, len / sum(len) OVER (PARTITION BY src) AS share FROM own), f AS (SELECT *, row_number() OVER (PARTITION BY scaffold ORDER BY share DESC, len DESC, src) AS k FROM sh), dom AS (SELECT scaffold, src, len, share FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY share DESC, scaffold) AS k2 FROM f WHERE k = 1) WHERE k2 = 1)"


def _placed(spark, d):
    c = P.contigs(spark, d)
    w, t = W.partitionBy("scaffold").orderBy("key", "ctg"), W.partitionBy("nation").orderBy("ctg")
    rows = c.select((F.col("ctg") % 12).alias("scaffold"), F.when(F.col("ctg") % 17 != 0, F.concat(F.lit("s"), F.col("nation").cast("string"))).alias("src"), "ctg", "len", "nation", (F.col("ctg") + F.when(F.col("ctg") % 5 == 0, 40).otherwise(0)).alias("key"))
    rows = rows.withColumn("idx", F.row_number().over(t)).withColumn("src_size", F.count("*").over(W.partitionBy("nation")))
    return rows.select("scaffold", F.row_number().over(w).alias("pos"), "ctg", F.when(F.col("ctg") % 7 == 0, "-").otherwise("+").alias("orient"), "len", "src", F.when(F.col("src").isNotNull(), F.col("idx")).alias("idx"), F.lit("+").alias("truth_orient"), F.when(F.col("src").isNotNull(), F.col("src_size")).alias("src_size"))


@query(_SCAFF + " SELECT scaffold, src, len, round(share, 9) AS share FROM dom")
def dominant_source(spark, d):
    return V.dominant_sources(_placed(spark, d)).withColumn("share", F.round("share", 9))


@query(_SCAFF + " SELECT scaffold, ctg, src FROM pl WHERE src IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dom WHERE dom.scaffold = pl.scaffold AND dom.src = pl.src)")
def translocations(spark, d):
    return V.translocations(_placed(spark, d)).select("scaffold", "ctg", "src")


@query()
def scaffold_categories(spark, d):
    """Every placed contig in exactly one category."""
    return V.scaffold_categories(_placed(spark, d))


@query(sql("contigs") + " SELECT 'chr' || chr || '_' || hap AS src, 'chr' || chr || '_' || hap || '_' || ctg || '_1_' || len || '_' || CASE WHEN ctg % 2 = 0 THEN '+' ELSE '-' END AS ctg, ctg::INT AS idx, CASE WHEN ctg % 2 = 0 THEN '+' ELSE '-' END AS orient FROM contigs")
def truth_groups(spark, d):
    name = F.concat_ws("_", F.concat(F.lit("chr"), F.col("chr").cast("string")), F.col("hap").cast("string"), F.col("ctg").cast("string"), F.lit("1"), F.col("len").cast("string"), F.when(F.col("ctg") % 2 == 0, "+").otherwise("-"))
    return V.truth_groups(P.contigs(spark, d).select(name.alias("ctg")))


@query(sql("contigs") + ", v AS (SELECT s_nationkey AS ctg, CAST(floor(s_acctbal / 2500) AS BIGINT) AS chr, count(*) AS n FROM supplier GROUP BY 1, 2), t AS (SELECT ctg, sum(n) AS total, max(n) AS best, max_by(chr, n * 1000 + chr) AS top FROM v GROUP BY 1) SELECT ctg, CASE WHEN best >= 0.5 * total THEN top::VARCHAR ELSE 'unreliable' END AS chr FROM t")
def dominant_chromosome(spark, d):
    s = P.table(spark, d, "supplier").select(F.col("s_nationkey").alias("ctg"), F.floor(F.col("s_acctbal") / 2500).alias("chr"))
    return V.dominant_chromosome(s)
