"""Contacts, node and edge filters."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphweave.operators import contacts as C
from graphweave.operators import filters as L
from graphweave.operators.tables import written

from . import proxies as P
from .book import Book
from .proxies import sql

BOOK = Book()
query = BOOK.add

_EDGES = ("contacts", "edges", "both", "degree")


def edges(spark, d):
    return C.edge_counts(P.contacts(spark, d), P.lines(spark, d))


def nodes(spark, d):
    return L.densities(P.contigs(spark, d), C.node_degree(edges(spark, d)))


@query(sql("contacts", "contigs", "edges") + " SELECT i, j, links, round(links / (a.re_sites * b.re_sites)::DOUBLE, 9) AS density FROM edges JOIN contigs a ON a.ctg = i JOIN contigs b ON b.ctg = j")
def contact_edges(spark, d):
    """Edges with their density over both ends' sites."""
    side = lambda c, n: P.contigs(spark, d).select(F.col("ctg").alias(c), F.col("re_sites").alias(n))
    return edges(spark, d).join(side("i", "ri"), "i").join(side("j", "rj"), "j").select("i", "j", "links", F.round(F.col("links") / (F.col("ri") * F.col("rj")), 9).alias("density"))


@query(sql("contacts") + " SELECT i, j, count(*) AS links FROM contacts WHERE (x <= 10 OR x > 40) AND (y <= 10 OR y > 40) GROUP BY 1, 2")
def flank_edges(spark, d):
    return C.flank_edges(P.rich(spark, d), 10, P.lines(spark, d))


@query(sql(*_EDGES) + " SELECT * FROM degree")
def node_degree(spark, d):
    return C.node_degree(edges(spark, d))


@query(sql("contacts") + " SELECT i, CASE WHEN 2 * x > 50 THEN 'T' ELSE 'H' END AS i_end, j, CASE WHEN 2 * y > 50 THEN 'T' ELSE 'H' END AS j_end, count(*) AS links FROM contacts GROUP BY 1, 2, 3, 4")
def ht_links(spark, d):
    return C.half_edges(P.rich(spark, d), P.lines(spark, d))


@query(sql("contacts") + """, o AS (SELECT i, j, unnest([{'o': '++', 'd': 50 - (x - 1) + (y - 1)}, {'o': '+-', 'd': 50 - (x - 1) + 50 - (y - 1)}, {'o': '-+', 'd': (x - 1) + (y - 1)}, {'o': '--', 'd': (x - 1) + 50 - (y - 1)}]) AS r FROM contacts)
SELECT i, j, r.o AS ori, 2 * count(*) AS n, string_agg(r.d || ' ' || r.d, ' ' ORDER BY r.d) AS line FROM o GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def clm_distances(spark, d):
    return C.distance_lines(C.distance_runs(P.rich(spark, d), 2 * P.lines(spark, d)), whole=True)


_TAGGED = sql("contacts") + """, t AS (SELECT i, j, CASE WHEN 2 * x > 50 THEN 'T' ELSE 'H' END || CASE WHEN 2 * y > 50 THEN 'T' ELSE 'H' END AS ends, (x <= 10 OR x > 40) AND (y <= 10 OR y > 40) AS near, CAST(ceil(x / 10) AS BIGINT) || '/' || CAST(ceil(y / 10) AS BIGINT) AS bins FROM contacts)
SELECT 'edges' AS kind, i, j, '' AS part, count(*) AS links FROM t GROUP BY 2, 3
UNION ALL SELECT 'flank', i, j, '', count(*) FROM t WHERE near GROUP BY 2, 3
UNION ALL SELECT 'degree', n, NULL, '', count(*) FROM (SELECT unnest([i, j]) AS n FROM t) GROUP BY 2
UNION ALL SELECT 'halves', i, j, ends, count(*) FROM t GROUP BY 2, 3, 4
UNION ALL SELECT 'fragments', i, j, bins, count(*) FROM t GROUP BY 2, 3, 4"""


@query(_TAGGED)
def contact_aggregates(spark, d):
    """Five aggregates from one pass over the contacts."""
    P.checkpoints(spark)
    found = C.aggregates(written(C.cells(P.rich(spark, d), 10, 10, P.lines(spark, d)), "cells"), P.lines(spark, d))
    text = lambda *c: F.concat(*[F.col(x).cast("string") if isinstance(x, str) else x for x in c])
    parts = {"halves": text("i_end", "j_end"), "fragments": text("bi", F.lit("/"), "bj")}
    out = None
    for kind, rows in found.items():
        ends = [F.col("ctg").alias("i"), F.lit(None).cast("long").alias("j"), F.lit("").alias("part"), F.col("degree").alias("links")] if kind == "degree" else ["i", "j", parts.get(kind, F.lit("")).alias("part"), "links"]
        part = rows.select(F.lit(kind).alias("kind"), *ends)
        out = part if out is None else out.union(part)
    return out


@query(sql("contacts") + " SELECT i, CAST(ceil(x / 10) AS BIGINT) AS bi, j, CAST(ceil(y / 10) AS BIGINT) AS bj, count(*) AS links FROM contacts GROUP BY 1, 2, 3, 4")
def fragment_edges(spark, d):
    return C.fragment_edges(P.rich(spark, d), 10, P.lines(spark, d))


@query(sql("contacts") + ", r AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY x, y) AS rank FROM contacts) SELECT i, j, count(*) AS n, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy FROM r WHERE rank <= 20 GROUP BY 1, 2")
def first_n_pairs(spark, d):
    return C.first_per_pair(P.contacts(spark, d), ["x", "y"], 20, P.lines(spark, d)).groupBy("i", "j").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


_CONC = sql("contacts") + ", a AS (SELECT i, j, 'd' AS axis, floor((y - x) / 5) AS b FROM contacts UNION ALL SELECT i, j, 's', floor((y + x) / 5) FROM contacts), c AS (SELECT i, j, axis, b, count(*) AS c FROM a GROUP BY 1, 2, 3, 4), t AS (SELECT i, j, axis, max(c) / sum(c) AS r FROM c GROUP BY 1, 2, 3), conc AS (SELECT i, j, max(r) AS concordance FROM t GROUP BY 1, 2)"


@query(_CONC + " SELECT i, j, round(concordance, 6) AS concordance FROM conc")
def concordance_ratio(spark, d):
    return C.concordance(P.contacts(spark, d).withColumn("shorter", F.lit(P.SPAN)), windows=10, tasks=P.lines(spark, d)).select("i", "j", F.round("concordance", 6).alias("concordance"))


@query(sql("contacts") + """, a AS (SELECT i, j, 'x' AS axis, floor(x / 10) AS b FROM contacts UNION ALL SELECT i, j, 'y', floor(y / 10) FROM contacts),
c AS (SELECT i, j, axis, b, count(*) AS c FROM a GROUP BY 1, 2, 3, 4), m AS (SELECT *, median(c) OVER (PARTITION BY i, j, axis) AS m FROM c),
s AS (SELECT i, j, axis, 1 - coalesce(sum(c) FILTER (c >= 2 * m), 0) / sum(c) AS s FROM m GROUP BY 1, 2, 3)
SELECT i, j, round(max(s) FILTER (axis = 'x') * max(s) FILTER (axis = 'y'), 6) AS adjustment FROM s GROUP BY 1, 2""")
def concentration_ratio(spark, d):
    return C.concentration(P.contacts(spark, d), 10, 2, P.lines(spark, d)).select("i", "j", F.round("adjustment", 6).alias("adjustment"))


@query(_CONC + ", n AS (SELECT i, j, count(*) AS links FROM contacts GROUP BY 1, 2) SELECT i, j, links FROM conc JOIN n USING (i, j) WHERE concordance > 0.3 AND links >= 8")
def allelic_pairs(spark, d):
    """Pairs of concordant contacts."""
    rows = C.concordance(P.contacts(spark, d).withColumn("shorter", F.lit(P.SPAN)), windows=10, tasks=P.lines(spark, d)).where("concordance > 0.3")
    return rows.join(edges(spark, d).where("links >= 8"), ["i", "j"]).select("i", "j", "links")


@query(sql("contigs") + ", r AS (SELECT ctg, len, coalesce(sum(len) OVER (ORDER BY len DESC, ctg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(len) OVER () AS total FROM contigs) SELECT ctg, len FROM r WHERE before * 100 < total * 80")
def n50_nx_select(spark, d):
    return L.nx_select(P.contigs(spark, d), 80).select("ctg", "len")


@query(sql("contigs") + " SELECT ctg, re_sites FROM contigs WHERE re_sites > 500")
def re_filter(spark, d):
    return P.contigs(spark, d).where("re_sites > 500").select("ctg", "re_sites")


_DENS = sql(*_EDGES, "contigs") + ", n AS (SELECT ctg, len, re_sites, hap, coalesce(degree, 0) AS degree, coalesce(degree, 0) / re_sites AS density FROM contigs LEFT JOIN degree USING (ctg)), m AS (SELECT sum(degree) / (1 + sum(re_sites - 1)) AS mean_density FROM n WHERE degree > 0)"


@query(_DENS + " SELECT ctg, degree, round(density, 6) AS density FROM n, m WHERE density >= 0.9 * mean_density AND density <= 1.1 * mean_density")
def density_filter(spark, d):
    return L.density_filter(nodes(spark, d), 0.9, 1.1).select("ctg", "degree", F.round("density", 6).alias("density"))


@query(_DENS + ", r AS (SELECT ctg, degree, density, row_number() OVER (ORDER BY density, ctg) - 1 AS k0, count(*) OVER () AS n FROM n) SELECT ctg, degree FROM r WHERE k0 >= floor(n * 0.1) AND k0 < floor(n * 0.9)")
def density_slice(spark, d):
    P.checkpoints(spark)
    return L.density_filter(nodes(spark, d), 0.1, 0.9, "fraction").select("ctg", "degree")


@query(_DENS + ", q AS (SELECT quantile_cont(degree, 0.25) AS a, quantile_cont(degree, 0.75) AS b FROM n) SELECT ctg, degree FROM n, q WHERE degree <= b + 0.5 * (b - a)")
def depth_iqr_filter(spark, d):
    return L.iqr_filter(nodes(spark, d), "degree", 0.5).select("ctg", "degree")


_RANK = sql(*_EDGES) + ", r AS (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY w DESC, v) - 1 AS rank FROM both_), b AS (SELECT * FROM r WHERE rank < 5), p AS (SELECT x.u, x.v AS a, y.v AS b FROM b x JOIN b y ON x.u = y.u AND x.v < y.v), m AS (SELECT least(u, v) AS a, greatest(u, v) AS b, min(rank) AS rank FROM r GROUP BY 1, 2), s AS (SELECT p.u, sum(rank)::BIGINT AS rank_sum FROM p JOIN m USING (a, b) GROUP BY 1)"


@query(_RANK + " SELECT u, rank_sum FROM s")
def rank_sum(spark, d):
    return L.rank_sums(C.symmetric(edges(spark, d)), 5)


@query(_RANK + ", q AS (SELECT quantile_cont(rank_sum, 0.25) AS a, quantile_cont(rank_sum, 0.75) AS b FROM s) SELECT u, rank_sum FROM s, q WHERE rank_sum <= b + 1.5 * (b - a)")
def rank_sum_filter(spark, d):
    return L.iqr_filter(L.rank_sums(C.symmetric(edges(spark, d)), 5), "rank_sum", 1.5)


@query(_DENS + """, x AS (SELECT ctg, coalesce(sum(len) OVER (ORDER BY len DESC, ctg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(len) OVER () AS total FROM contigs),
c AS (SELECT n.* FROM n JOIN x USING (ctg) WHERE before * 100 < total * 95 AND re_sites > 100), m2 AS (SELECT sum(degree) / (1 + sum(re_sites - 1)) AS m FROM c WHERE degree > 0),
e AS (SELECT c.* FROM c, m2 WHERE density >= 0.8 * m AND density <= 1.2 * m), q AS (SELECT quantile_cont(degree, 0.25) AS a, quantile_cont(degree, 0.75) AS b FROM c)
SELECT ctg, degree FROM (SELECT e.ctg, degree FROM e, q WHERE degree <= b + 1.5 * (b - a)) UNION SELECT ctg, degree FROM n WHERE ctg % 50 = 7""")
def filter_chain(spark, d):
    """Length share, sites, density, depth over all that pass the sites; the whitelist comes back at the end."""
    return L.filter_nodes(nodes(spark, d), share=95, sites=100, density=(0.8, 1.2), depth=1.5, whitelist=F.col("ctg") % 50 == 7).select("ctg", "degree")


_FRAG = "fragments AS (SELECT s_suppkey AS ctg, unnest(range(1, 6)) AS bin_no FROM supplier), picked AS (SELECT ctg, bin_no FROM (SELECT *, row_number() OVER (PARTITION BY ctg ORDER BY md5('42:' || ctg || ':' || bin_no), bin_no) AS k FROM fragments) WHERE k <= 1)"


def fragments(spark, d):
    return P.spans(spark, d).select("ctg", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("bin_no"))


@query("WITH " + _FRAG + " SELECT ctg, bin_no FROM picked")
def mask_sample(spark, d):
    return L.sample_bins(fragments(spark, d), 0.25, 42).select("ctg", "bin_no")


@query(sql("contacts") + ", " + _FRAG + ", f AS (SELECT i, CAST(ceil(x / 10) AS BIGINT) AS bi, j, CAST(ceil(y / 10) AS BIGINT) AS bj, count(*) AS links FROM contacts GROUP BY 1, 2, 3, 4) SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM picked p WHERE p.ctg = i AND p.bin_no = bi) AND NOT EXISTS (SELECT 1 FROM picked p WHERE p.ctg = j AND p.bin_no = bj)")
def masked_edges(spark, d):
    f = C.fragment_edges(P.rich(spark, d), 10, P.lines(spark, d))
    return L.without_nodes(f, L.sample_bins(fragments(spark, d), 0.25, 42), ["i", "bi"], ["j", "bj"], ["ctg", "bin_no"]).select("i", "bi", "j", "bj", "links")


@query("WITH " + ", ".join(f"f{s} AS (SELECT {s} AS mask_id, s_suppkey AS ctg, unnest(range(1, 6)) AS bin_no FROM supplier)" for s in range(3)) + ", a AS (" + " UNION ALL ".join(f"SELECT *, row_number() OVER (PARTITION BY ctg ORDER BY md5('{42 + s}:' || ctg || ':' || bin_no), bin_no) AS k FROM f{s}" for s in range(3)) + ") SELECT mask_id::BIGINT AS mask_id, ctg, bin_no FROM a WHERE k <= 1")
def mask_rounds(spark, d):
    """Several masks, by consecutive seeds."""
    out = None
    for k in range(3):
        part = L.sample_bins(fragments(spark, d), 0.25, 42 + k).select(F.lit(k).cast("long").alias("mask_id"), "ctg", "bin_no")
        out = part if out is None else out.union(part)
    return out


@query(sql(*_EDGES) + " SELECT i, j, links, round(links / sqrt(a.degree * b.degree), 9) AS w FROM edges JOIN degree a ON a.ctg = i JOIN degree b ON b.ctg = j")
def norm_by_links(spark, d):
    e = edges(spark, d)
    return L.normalise_by_degree(e, C.node_degree(e)).withColumn("w", F.round("w", 9))


@query(sql("contacts", "edges", "contigs") + " SELECT i, j, links, round(links / pow(least(a.len, 20000) / 1e4 * (least(b.len, 20000) / 1e4), 2), 6) AS w FROM edges JOIN contigs a ON a.ctg = i JOIN contigs b ON b.ctg = j")
def norm_by_length(spark, d):
    return L.normalise_by_length(edges(spark, d), P.contigs(spark, d), 10_000, 1e4).withColumn("w", F.round("w", 6))


@query(sql("contacts", "edges", "contigs") + " SELECT i, j, round(CASE WHEN a.hap = b.hap THEN links ELSE links * 0.25 END, 6) AS w FROM edges JOIN contigs a ON a.ctg = i JOIN contigs b ON b.ctg = j")
def phase_downweight(spark, d):
    return L.downweight_between(edges(spark, d), P.contigs(spark, d), 0.75).withColumn("w", F.round("w", 6))


_READS = "reads AS (SELECT user_id AS name, event_id AS ord, value AS quality, CAST(json_extract_string(props, '$.k') AS BIGINT) AS mismatch, event_type = 'error' AS duplicate, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)"


@query("WITH " + _READS + ", p AS (SELECT *, lead(quality) OVER w AS q2, lead(mismatch) OVER w AS m2, lead(duplicate) OVER w AS d2, lead(ord) OVER w AS ord2 FROM reads WINDOW w AS (PARTITION BY name ORDER BY ord)) SELECT name, ord, ord2 FROM p WHERE k % 2 = 1 AND ord2 IS NOT NULL AND quality >= 10 AND q2 >= 10 AND mismatch < 80 AND m2 < 80 AND NOT duplicate AND NOT d2")
def read_pair_filter(spark, d):
    e = P.table(spark, d, "events")
    reads = e.select(F.col("user_id").alias("name"), F.col("event_id").alias("ord"), F.col("value").alias("quality"), F.get_json_object("props", "$.k").cast("long").alias("mismatch"), (F.col("event_type") == "error").alias("duplicate"))
    return L.read_pairs_filter(reads, 10, 80, drop_duplicates=True).select("name", "ord", "ord2")


@query(sql("contigs") + ", a AS (SELECT len, row_number() OVER (ORDER BY len DESC, ctg) AS k FROM contigs) SELECT max(len) AS longest, sum(len)::BIGINT AS two_longest, max(len) > 2147483647 AS wide_coords, sum(len) > 2147483647 AS wide_distances FROM a WHERE k <= 2")
def int_width(spark, d):
    two = P.contigs(spark, d).orderBy(F.desc("len"), "ctg").limit(2)
    top, both = F.max("len"), F.sum("len")
    return two.agg(top.alias("longest"), both.alias("two_longest"), (top > 2147483647).alias("wide_coords"), (both > 2147483647).alias("wide_distances"))


@query(sql("contigs") + ", o AS (SELECT ctg, len, lag(len) OVER (PARTITION BY hap ORDER BY len DESC, ctg) AS longer FROM contigs) SELECT ctg, len, longer FROM o WHERE longer IS NULL OR len * 100 < longer * 99")
def length_drops(spark, d):
    w = W.partitionBy("hap").orderBy(F.desc("len"), "ctg")
    return P.contigs(spark, d).withColumn("longer", F.lag("len").over(w)).where("longer is null or len * 100 < longer * 99").select("ctg", "len", "longer")
