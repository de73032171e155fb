"""Clustering, reassignment and consensus."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphweave.operators import blocks as B
from graphweave.operators import clustering as M
from graphweave.operators import consensus as K
from graphweave.operators import contacts as C
from graphweave.operators import filters as L
from graphweave.operators import graph as G
from graphweave.operators import linkage as H
from graphweave.operators import parts as T
from graphweave.operators import reassign as R
from graphweave.operators import sequential as S

from . import proxies as P
from .book import Book
from .contact_queries import allelic_pairs
from .proxies import sql

BOOK = Book()
query = BOOK.add


def edges(spark, d):
    return C.edge_counts(P.contacts(spark, d), P.lines(spark, d))


def weighted(spark, d):
    """Edges of all suppliers; those between nations keep a fiftieth of their links."""
    return L.downweight_between(edges(spark, d), P.contigs(spark, d).select("ctg", F.col("nation").alias("hap")), 0.98)


def _checkpointed(spark):
    P.checkpoints(spark)
    return spark


_WEIGHTED = sql("contacts", "edges", "contigs").replace("WITH ", "WITH RECURSIVE ", 1) + ", dw AS (SELECT i, j, links * (CASE WHEN a.nation = b.nation THEN 1 ELSE 1 - 0.98::DOUBLE END) AS w FROM edges JOIN contigs a ON a.ctg = i JOIN contigs b ON b.ctg = j)"
_MATRIX = _WEIGHTED + ", m AS (SELECT i AS row, j AS col, w AS val FROM dw UNION ALL SELECT j, i, w FROM dw UNION ALL SELECT n, n, 1.0 FROM (SELECT i AS n FROM dw UNION SELECT j FROM dw))"
_NORM = _MATRIX + ", nm AS (SELECT row, col, val / sum(val) OVER (PARTITION BY col) AS val FROM m)"
_EXPAND = _NORM + ", e AS (SELECT a.row, b.col, sum(a.val * b.val) AS val FROM nm a JOIN nm b ON a.col = b.row GROUP BY 1, 2)"
_out = ' SELECT "row", col, round(val, 8) AS val FROM '


def rounded(m):
    return m.select("row", "col", F.round("val", 8).alias("val"))


@query(_MATRIX + _out + "m")
def adjacency(spark, d):
    return rounded(G.adjacency(weighted(spark, d)))


@query(_NORM + _out + "nm")
def column_normalise(spark, d):
    return rounded(G.normalise_columns(G.adjacency(weighted(spark, d))))


def _matrices(spark, d, work, further=None):
    """``work`` of the matrix of every connected part that fits a task, ``further`` of whole columns of the others' square."""
    parts = T.Parts(weighted(_checkpointed(spark), d))
    out = T.entries(parts, G.DENSE_NODES, work)
    if parts.largest() <= G.DENSE_NODES:
        return rounded(out)
    return rounded(out.union(B.expand(G.adjacency(parts.rows(G.DENSE_NODES, beyond=True)), normalise=True, work=further)))


@query(_EXPAND + _out + "e")
def mcl_expand(spark, d):
    """The square of the column-normalised matrix of all suppliers."""
    return _matrices(spark, d, lambda m: m @ m)


@query(_EXPAND + ", p AS (SELECT row, col, pow(val, 1.5) / sum(pow(val, 1.5)) OVER (PARTITION BY col) AS val FROM e), k AS (SELECT * FROM (SELECT *, max(val) OVER (PARTITION BY col) AS top FROM p) WHERE val >= 0.02 OR val = top), f AS (SELECT row, col, val / sum(val) OVER (PARTITION BY col) AS val FROM k)" + _out + "f")
def mcl_inflate_prune(spark, d):
    return _matrices(spark, d, lambda m: G.refined(m @ m, 1.5, 0.02), lambda m: G.refined(m, 1.5, 0.02))


def _mcl(inflations: list[float], rounds: int = 100) -> str:
    """SQL of whole runs over we(mask, i, j, w): it (all rounds), lim (the last of each run) and cl(mask, inflation, cluster, ctg) of valid runs."""
    def refine(source: str) -> str:
        part = "PARTITION BY mask, r, col"
        return f"(SELECT mask, r, row, col, val / sum(val) OVER ({part}) AS val FROM (SELECT * FROM (SELECT *, max(val) OVER ({part}) AS top FROM (SELECT mask, r, row, col, pow(val, r) / sum(pow(val, r)) OVER ({part}) AS val FROM {source})) WHERE val >= 1e-4 OR val = top))"

    return f"""
am AS (SELECT mask, i AS row, j AS col, w AS val FROM we UNION ALL SELECT mask, j, i, w FROM we UNION ALL SELECT mask, n, n, 1.0 FROM (SELECT mask, i AS n FROM we UNION SELECT mask, j FROM we)),
an AS (SELECT mask, row, col, val / sum(val) OVER (PARTITION BY mask, col) AS val FROM am),
ae AS MATERIALIZED (SELECT a.mask, a.row, b.col, sum(a.val * b.val) AS val FROM an a JOIN an b ON a.mask = b.mask AND a.col = b.row GROUP BY 1, 2, 3),
it AS (
  SELECT 0 AS k, mask, r, row, col, val, FALSE AS done FROM {refine(f"(SELECT mask, r, row, col, val FROM ae, (SELECT unnest({inflations}::DOUBLE[]) AS r))")}
  UNION ALL
  SELECT k, mask, r, row, col, val, done FROM (
    SELECT k, mask, r, row, col, a AS val, k > 1 AND NOT bool_or(abs(a - b) > 1e-8 + 1e-5 * abs(b)) OVER (PARTITION BY mask, r) AS done
    FROM (SELECT max(k) AS k, mask, r, row, col, sum(a) AS a, sum(b) AS b FROM (
      SELECT (SELECT max(k) + 1 FROM it) AS k, mask, r, row, col, val AS a, 0.0 AS b FROM {refine("(SELECT a.mask, a.r, a.row, b.col, sum(a.val * b.val) AS val FROM it a JOIN it b ON a.mask = b.mask AND a.r = b.r AND a.col = b.row WHERE NOT a.done GROUP BY 1, 2, 3, 4)")}
      UNION ALL SELECT NULL, mask, r, row, col, 0.0, val FROM it WHERE NOT done) GROUP BY 2, 3, 4, 5))
  WHERE k < {rounds}),
lim AS (SELECT * FROM (SELECT *, max(k) OVER (PARTITION BY mask, r) AS last FROM it) WHERE k = last AND val <> 0),
cs AS (SELECT DISTINCT mask, r, min(col) AS cluster, list(col ORDER BY col) AS cols FROM (SELECT l.* FROM lim l SEMI JOIN (SELECT mask, r, row FROM lim WHERE row = col) d USING (mask, r, row)) GROUP BY mask, r, row),
cm AS (SELECT mask, r, cluster, unnest(cols) AS ctg FROM cs),
cl AS (SELECT mask, r AS inflation, cluster, ctg FROM cm SEMI JOIN (
  SELECT mask, r FROM (SELECT n.mask, n.r, n.col, count(c.ctg) AS times FROM (SELECT DISTINCT mask, r, col FROM lim) n LEFT JOIN cm c ON c.mask = n.mask AND c.r = n.r AND c.ctg = n.col GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING bool_and(times = 1)) v USING (mask, r))"""


GRID = [1.2, 1.4, 1.6, 1.8, 2.0, 3.0]
_ONE = _WEIGHTED + ", we AS (SELECT 0 AS mask, * FROM dw), "


@query(_ONE + _mcl(GRID) + " SELECT inflation, cluster, ctg FROM cl")
def mcl_clusters(spark, d):
    """Clusters of suppliers over a grid of inflations; every valid run parts all nodes."""
    return M.clusters(weighted(_checkpointed(spark), d), GRID)


@query(_ONE + _mcl([1.6, 2.0]) + " SELECT inflation, cluster, ctg FROM cl")
def mcl_join_clusters(spark, d):
    """The same at two inflations; parts that no task takes go by joins of blocks."""
    return M.clusters(weighted(_checkpointed(spark), d), [1.6, 2.0])


_MASKS = "we AS (SELECT mask, dw.* FROM dw, (SELECT unnest([0, 1, 2])::BIGINT AS mask) WHERE i % 5 <> mask AND j % 5 <> mask), "
_TOTALS = ", t AS (SELECT mask, inflation, ctg // 2 AS ctg, cluster, sum(len) AS total FROM cl JOIN contigs USING (ctg) GROUP BY 1, 2, 3, 4), a AS (SELECT mask, inflation, ctg, cluster FROM (SELECT *, row_number() OVER (PARTITION BY mask, inflation, ctg ORDER BY total DESC, cluster) AS k FROM t) WHERE k = 1), z AS (SELECT mask, inflation, cluster, count(*) AS n_ctg, sum(len)::BIGINT AS len FROM a JOIN (SELECT ctg // 2 AS ctg, sum(len) AS len FROM contigs GROUP BY 1) USING (ctg) GROUP BY 1, 2, 3)"
_BESTS = ", g AS (SELECT {'m': mask, 'i': inflation} AS run, mask, inflation, cluster, len FROM z), q AS (" + " UNION ALL ".join(f"SELECT {k} AS k, {r} AS ratio, run.m AS mask, run.i AS inflation FROM (SELECT run, coalesce(min(k) FILTER (nx / len < {r}), count(*)) AS main FROM (SELECT *, row_number() OVER w AS k, lead(len) OVER w AS nx FROM g WINDOW w AS (PARTITION BY run ORDER BY len DESC, cluster)) GROUP BY 1) WHERE main >= 3" for k, r in enumerate(G.RATIOS)) + "), b AS (SELECT mask, arg_min(inflation, (k, inflation)) AS best FROM q GROUP BY 1)"


@query(_WEIGHTED + ", " + _MASKS + _mcl([1.4, 1.6, 2.0]) + _TOTALS + _BESTS + " SELECT z.mask, z.inflation, z.cluster, n_ctg, len, row_number() OVER (PARTITION BY z.mask, z.inflation ORDER BY len DESC, z.cluster) AS rank, coalesce(best, 0)::DOUBLE AS recommended FROM z LEFT JOIN b ON b.mask = z.mask")
def cluster_run(spark, d):
    """Masks by inflations: bins clustered, taken to contigs, totals and each mask's recommended inflation.

    Suppliers are bins, two neighbours a contig; a mask leaves a fifth of the bins out.
    """
    own = P.contigs(_checkpointed(spark), d)
    bins = own.select(F.col("ctg").alias("frag"), F.floor(F.col("ctg") / 2).alias("ctg"), F.col("len").alias("frag_len"))
    masks = spark.range(3).select(F.col("id").alias("mask"))
    links = weighted(spark, d).crossJoin(F.broadcast(masks)).where("i % 5 <> mask and j % 5 <> mask")
    out = M.run(links, bins, bins.groupBy("ctg").agg(F.sum("frag_len").alias("len")), [1.4, 1.6, 2.0], 3, ["mask"])
    return out.sizes.join(out.best.select("mask", F.col("inflation").alias("recommended")), "mask")


_FRAG = sql("contacts") + ", f AS (SELECT i AS ctg, CAST(ceil(x / 10) AS BIGINT) AS bin_no, j % 4 AS cluster, count(*) AS frag_len FROM contacts GROUP BY 1, 2, 3)"


@query(_FRAG + ", t AS (SELECT ctg, cluster, sum(frag_len) AS total FROM f GROUP BY 1, 2) SELECT 0::BIGINT AS run, ctg, cluster FROM (SELECT *, row_number() OVER (PARTITION BY ctg ORDER BY total DESC, cluster) AS k FROM t) WHERE k = 1")
def bin_majority(spark, d):
    f = P.contacts(spark, d).groupBy(F.col("i").alias("ctg"), F.ceil(F.col("x") / 10).alias("bin_no"), (F.col("j") % 4).alias("cluster")).agg(F.count("*").alias("frag_len"))
    return G.majority(f.withColumn("run", F.lit(0).cast("long")))


_GROUPS = sql("contigs") + ", g AS (SELECT hap AS run, nation AS cluster, sum(len)::BIGINT AS len FROM contigs GROUP BY 1, 2)"
_main = lambda r: f"(SELECT run, coalesce(min(k) FILTER (nx / len < {r}), count(*)) AS main, count(*) AS n_groups FROM (SELECT *, row_number() OVER w AS k, lead(len) OVER w AS nx FROM g WINDOW w AS (PARTITION BY run ORDER BY len DESC, cluster)) GROUP BY 1)"


def _groups(spark, d):
    return P.contigs(spark, d).groupBy(F.col("hap").alias("run"), F.col("nation").alias("cluster")).agg(F.sum("len").alias("len"))


@query(_GROUPS + f" SELECT * FROM {_main(0.75)}")
def main_groups(spark, d):
    return G.main_groups(_groups(spark, d), 0.75)


@query(_GROUPS + ", a AS (" + " UNION ALL ".join(f"SELECT {k} AS k, {r} AS ratio, run FROM {_main(r)} WHERE main >= 4" for k, r in enumerate(G.RATIOS)) + ") SELECT coalesce(max(run), 0)::DOUBLE AS run, coalesce(max(ratio), 0)::DOUBLE AS ratio FROM (SELECT * FROM a ORDER BY k, run LIMIT 1)")
def recommend_inflation(spark, d):
    return G.recommend(_groups(spark, d), 4)


@query("SELECT nation, val, n FROM (SELECT s_nationkey::BIGINT AS nation, CAST(floor(s_acctbal / 1000) AS BIGINT) AS val, count(*) AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY count(*) DESC, CAST(floor(s_acctbal / 1000) AS BIGINT)) AS k FROM supplier GROUP BY s_nationkey, CAST(floor(s_acctbal / 1000) AS BIGINT)) WHERE k = 1")
def mask_mode(spark, d):
    """The commonest value of each set of runs."""
    s = P.table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("nation"), F.floor(F.col("s_acctbal") / 1000).alias("val"))
    return G.most_frequent(s, ["nation"], "val")


def _allelic(spark, d):
    return allelic_pairs(spark, d).select("i", "j", F.col("links").cast("double").alias("w"))


@query()
def allelic_cliques(spark, d):
    """Allele groups of at most four among the pairs of concordant contacts."""
    return G.allelic_groups(_allelic(_checkpointed(spark), d), 4)


@query()
def allelic_matching(spark, d):
    """Edges between allele groups that maximum-weight assignments leave unmatched."""
    groups = P.contigs(spark, d).select(F.floor(F.col("ctg") / 4).cast("string").alias("group"), "ctg")
    return G.unmatched_edges(edges(spark, d).select("i", "j", F.col("links").cast("double").alias("w")), groups, P.lines(spark, d))


# ------------------------------------------------------------ reassignment

_CG = ("contacts", "contigs", "edges", "both", "groups", "sites", "cgl", "dens")


@query(sql("contacts", "edges", "both", "groups", "cgl") + " SELECT * FROM cgl")
def contig_group_links(spark, d):
    return R.contig_group_links(edges(spark, d), P.groups(spark, d))


def _dense(spark, d):
    g = P.groups(spark, d)
    return R.group_densities(R.contig_group_links(edges(spark, d), g), g, P.contigs(spark, d))


@query(sql(*_CG) + " SELECT ctg, grp, links, round(density, 9) AS density FROM dens")
def group_link_density(spark, d):
    return _dense(spark, d).select("ctg", "grp", "links", F.round("density", 9).alias("density"))


_BEST = sql(*_CG) + ", b0 AS (SELECT *, row_number() OVER w AS k, lead(links) OVER w AS nx, sum(density) OVER (PARTITION BY ctg) AS alld FROM dens WINDOW w AS (PARTITION BY ctg ORDER BY links DESC, grp)), best AS (SELECT ctg, grp, own, links, density, CASE WHEN (alld - density) / 24 > 1e-12 THEN density / ((alld - density) / 24) ELSE 1e6 END AS ratio, coalesce(nx / links, 0) AS ambiguity FROM b0 WHERE k = 1)"


@query(_BEST + ", v AS (SELECT round(ratio, 2) AS ratio, count(*) AS n, sum(len) AS w FROM best JOIN contigs USING (ctg) GROUP BY 1) SELECT ratio, round(sum(n) OVER o / sum(n) OVER (), 9) AS share_rows, round(sum(w) OVER o / sum(w) OVER (), 9) AS share_weight FROM v WINDOW o AS (ORDER BY ratio ROWS UNBOUNDED PRECEDING)")
def link_stats_cdf(spark, d):
    """Distribution of density ratios over contigs and over their lengths."""
    best = R.best_groups(_dense(spark, d), 25).withColumn("ratio", F.round("ratio", 2)).join(P.contigs(spark, d).select("ctg", "len"), "ctg")
    return R.distribution(best, "ratio", "len").select("ratio", F.round("share_rows", 9).alias("share_rows"), F.round("share_weight", 9).alias("share_weight"))


LIMITS = R.Limits(sites=100, links=5, density=0.0, ratio=1.2, ambiguity=0.98, longest=30_000)


@query(_BEST + " SELECT ctg, own, grp, CASE WHEN NOT (re_sites - 1 >= 100 AND links >= 5 AND density >= 0 AND ambiguity < 0.98) THEN 'keep' WHEN own IS NULL THEN CASE WHEN ratio >= 1.2 THEN 'rescue' ELSE 'keep' END WHEN own = grp THEN 'stay' WHEN ratio >= 1.2 AND len <= 30000 THEN 'move' ELSE 'keep' END AS action FROM best JOIN contigs USING (ctg)")
def reassign_snapshot(spark, d):
    return R.snapshot_round(edges(spark, d), P.groups(spark, d), P.contigs(spark, d), LIMITS, 25)


#: One contig a step: five rounds with moves, then one that only rescues.
_TURNS = """,
turns AS (SELECT ctg, len, re_sites, row_number() OVER (ORDER BY len DESC, ctg) - 1 AS turn, count(*) OVER () AS n FROM contigs),
near AS MATERIALIZED (SELECT t.turn, b.v AS other, sum(b.w)::BIGINT AS w FROM both_ b JOIN turns t ON t.ctg = b.u GROUP BY 1, 2),
st AS (
  SELECT 0::BIGINT AS step, t.ctg, t.turn, t.len, t.re_sites, t.n, g.grp, (SELECT count(DISTINCT grp) FROM groups_) AS n_groups FROM turns t LEFT JOIN groups_ g USING (ctg)
  UNION ALL
  SELECT s.step + 1, s.ctg, s.turn, s.len, s.re_sites, s.n, CASE WHEN s.turn = s.step % s.n AND d.top IS NOT NULL THEN d.top ELSE s.grp END,
    CASE WHEN (s.step + 1) % s.n = 0 THEN (SELECT count(DISTINCT CASE WHEN x.turn = x.step % x.n AND d.top IS NOT NULL THEN d.top ELSE x.grp END) FROM st x) ELSE s.n_groups END
  FROM st s, (
    SELECT max(CASE WHEN ok THEN top END) AS top FROM (
      SELECT top, own, re_sites - 1 >= 100 AND top_links >= 5 AND value >= 0 AND own IS DISTINCT FROM top
        AND (own IS NULL OR (step < 5 * n AND len <= 30000)) AND (step >= 5 * n OR second IS NULL OR second / top_links < 0.98)
        AND CASE WHEN rest > 1e-12 THEN value / rest ELSE 1e6 END >= 1.2 AS ok
      FROM (
        SELECT *, CASE WHEN home = top_links THEN own ELSE first END AS top, CASE WHEN home = top_links THEN home_value ELSE first_value END AS value,
          (total - CASE WHEN home = top_links THEN home_value ELSE first_value END) / greatest(1, n_groups - 1) AS rest
        FROM (
          SELECT any_value(own) AS own, any_value(step) AS step, any_value(n) AS n, any_value(n_groups) AS n_groups, any_value(len) AS len, any_value(re_sites) AS re_sites,
            max(links) AS top_links, arg_min(grp, (-links, grp)) AS first, arg_min(density, (-links, grp)) AS first_value,
            max(links) FILTER (grp = own) AS home, max(density) FILTER (grp = own) AS home_value, fsum(density) AS total, (max(links, 2))[2] AS second
          FROM (
            SELECT l.*, m.grp AS own, m.step, m.n, m.n_groups, m.len, m.re_sites, l.links / (z.sites + CASE WHEN l.grp = m.grp THEN 0 ELSE m.re_sites - 1 END) AS density
            FROM (SELECT o.grp, sum(e.w)::BIGINT AS links FROM near e JOIN st o ON o.ctg = e.other WHERE o.grp IS NOT NULL AND e.turn = o.step % o.n GROUP BY 1) l
            JOIN (SELECT grp, 1 + sum(re_sites - 1) AS sites FROM st WHERE grp IS NOT NULL GROUP BY 1) z USING (grp),
            (SELECT * FROM st WHERE turn = step % n) m))))) d
  WHERE s.step < 6 * s.n)
SELECT ctg, grp FROM st WHERE step = 6 * n AND grp IS NOT NULL"""
_SEQUENTIAL = sql("contacts", "contigs", "edges", "both", "groups").replace("WITH ", "WITH RECURSIVE ", 1) + _TURNS


@query(_SEQUENTIAL)
def reassign_sequential(spark, d):
    """Contigs in order of length, each seeing all earlier moves."""
    return S.reassign(edges(_checkpointed(spark), d), P.groups(spark, d), P.contigs(spark, d).select("ctg", "len", "re_sites"), LIMITS)


_BETWEEN = sql("contacts", "contigs", "edges", "groups", "sites") + ", bg AS (SELECT least(a.grp, b.grp) AS g, greatest(a.grp, b.grp) AS h, sum(links)::BIGINT AS links FROM edges JOIN groups_ a ON a.ctg = i JOIN groups_ b ON b.ctg = j WHERE a.grp <> b.grp GROUP BY 1, 2)"


def _between(spark, d):
    g = P.groups(spark, d)
    return R.between_groups(edges(spark, d), g, R.group_sites(g, P.contigs(spark, d)))


@query(_BETWEEN + " SELECT g, h, links, round(links / (s.grp_sites * t.grp_sites), 12) AS density FROM bg JOIN sites s ON s.grp = g JOIN sites t ON t.grp = h")
def group_pair_density(spark, d):
    return _between(spark, d).withColumn("density", F.round("density", 12))


_HAC = _BETWEEN.replace("WITH ", "WITH RECURSIVE ", 1) + """,
st AS (
  SELECT 0 AS step, 0 AS kind, g AS a, h AS b, links / (s.grp_sites * t.grp_sites) AS s, (SELECT count(DISTINCT grp) FROM groups_) AS n FROM bg JOIN sites s ON s.grp = g JOIN sites t ON t.grp = h
  UNION ALL SELECT DISTINCT 0, 1, grp, grp, 0.0, (SELECT count(DISTINCT grp) FROM groups_) FROM groups_
  UNION ALL
  SELECT step + 1, kind, CASE WHEN kind = 0 THEN least(x, y) ELSE a END, CASE WHEN kind = 0 THEN greatest(x, y) ELSE y END, sum(s), any_value(n)
  FROM (SELECT st.*, CASE WHEN a = p.other THEN p.own ELSE a END AS x, CASE WHEN b = p.other THEN p.own ELSE b END AS y FROM st, (
    SELECT a AS own, b AS other FROM st JOIN (SELECT b AS a, count(*) AS na FROM st WHERE kind = 1 GROUP BY 1) USING (a) JOIN (SELECT b, count(*) AS nb FROM st WHERE kind = 1 GROUP BY 1) USING (b)
    WHERE kind = 0 ORDER BY s / (na * nb) DESC, a, b LIMIT 1) p)
  WHERE step < n - 8 AND (kind = 1 OR x <> y) GROUP BY 1, 2, 3, 4)
SELECT a AS grp, b AS merged FROM st WHERE kind = 1 AND step = greatest(n - 8, 0)"""


@query(_HAC)
def hac_merge(spark, d):
    """Average-linkage merging of the groups down to eight."""
    return H.merge_groups(_between(_checkpointed(spark), d), P.groups(spark, d).select("grp"), 8)


@query(sql("contigs", "groups") + " SELECT grp, count(*) AS n_ctg, sum(len)::BIGINT AS len, (1 + sum(CASE WHEN ctg % 3 = 0 THEN re_sites - 1 ELSE 0 END))::BIGINT AS sites FROM groups_ JOIN contigs USING (ctg) GROUP BY 1")
def group_stats(spark, d):
    g = P.groups(spark, d)
    return R.group_statistics(g, P.contigs(spark, d), g.where("ctg % 3 = 0"))


@query(sql("contigs", "groups") + ", t AS (SELECT grp, count(*) AS n_ctg, sum(len)::BIGINT AS len FROM groups_ JOIN contigs USING (ctg) GROUP BY 1) SELECT grp, 'group' || row_number() OVER (ORDER BY len DESC, grp) || '_' || len || 'bp' AS name, n_ctg, len FROM t")
def rename_groups(spark, d):
    return R.rename_groups(P.groups(spark, d), P.contigs(spark, d))


@query(sql("contacts", "edges", "groups") + " SELECT i, j, links, a.grp FROM edges JOIN groups_ a ON a.ctg = i JOIN groups_ b ON b.ctg = j AND a.grp = b.grp")
def split_clm(spark, d):
    return R.within_groups(edges(spark, d), P.groups(spark, d)).select("i", "j", "links", "grp")


# ------------------------------------------------------------ consensus

_SETS = "WITH a AS (SELECT p_brand AS class, p_partkey AS element FROM part), b AS (SELECT p_type AS class, p_partkey AS element FROM part), c AS (SELECT a.class AS a_class, b.class AS b_class, count(*) AS common FROM a JOIN b USING (element) GROUP BY 1, 2), na AS (SELECT class, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT class, count(*) AS n FROM b GROUP BY 1), o AS (SELECT a_class, b_class, common, common / (na.n + nb.n - common) AS jaccard FROM c JOIN na ON na.class = a_class JOIN nb ON nb.class = b_class)"


def _sets(spark, d):
    p = P.table(spark, d, "part")
    return p.select(F.col("p_brand").alias("class"), F.col("p_partkey").alias("element")), p.select(F.col("p_type").alias("class"), F.col("p_partkey").alias("element"))


@query(_SETS + " SELECT a_class, b_class, common FROM o")
def class_overlap(spark, d):
    return K.overlaps(*_sets(spark, d)).select("a_class", "b_class", "common")


@query(_SETS + " SELECT a_class, b_class, round(jaccard, 9) AS jaccard FROM o")
def class_jaccard(spark, d):
    return K.overlaps(*_sets(spark, d)).select("a_class", "b_class", F.round("jaccard", 9).alias("jaccard"))


@query(_SETS + " SELECT a_class, b_class, common FROM (SELECT *, row_number() OVER (PARTITION BY a_class ORDER BY common DESC, b_class) AS k FROM o) WHERE k = 1")
def best_overlap(spark, d):
    """The class of largest overlap for each: one step of the greedy choice."""
    w = W.partitionBy("a_class").orderBy(F.desc("common"), "b_class")
    return K.overlaps(*_sets(spark, d)).withColumn("k", F.row_number().over(w)).where("k = 1").select("a_class", "b_class", "common")


def _methods(spark, d):
    s = P.table(spark, d, "supplier")
    rows = [s.select(F.lit(f"m{k}").alias("method"), ((F.col("s_nationkey") + F.when(F.col("s_suppkey") % m == 0, 1).otherwise(0)) % 25).cast("string").alias("class"), F.col("s_suppkey").alias("element")) for k, m in enumerate((7, 11, 13))]
    return rows[0].union(rows[1]).union(rows[2])


_METHODS = "WITH m AS (" + " UNION ALL ".join(f"SELECT 'm{k}' AS method, ((s_nationkey + CASE WHEN s_suppkey % {m} = 0 THEN 1 ELSE 0 END) % 25)::VARCHAR AS class, s_suppkey AS element FROM supplier" for k, m in enumerate((7, 11, 13))) + ")"


@query(_METHODS + " SELECT class, element, count(DISTINCT method) AS votes FROM m GROUP BY 1, 2 HAVING count(DISTINCT method) * 2 > 3")
def majority_set(spark, d):
    return K.majority_elements(_methods(spark, d), 3)


@query(_METHODS + ", s AS (SELECT class, element FROM m GROUP BY 1, 2 HAVING count(DISTINCT method) = 1) SELECT class, count(*) AS left_over FROM s GROUP BY 1")
def leftover_assign(spark, d):
    """Elements that one method alone puts in a class."""
    return _methods(spark, d).groupBy("class", "element").agg(F.countDistinct("method").alias("v")).where("v = 1").groupBy("class").agg(F.count("*").alias("left_over"))


@query()
def consensus_greedy(spark, d):
    return K.consensus(_methods(_checkpointed(spark), d))


@query(_METHODS + ", n AS (SELECT method, class, count(*) AS n FROM m GROUP BY 1, 2) SELECT a.method AS ma, b.method AS mb, a.class AS ca, b.class AS cb, count(*) AS common, round(count(*) / (max(na.n) + max(nb.n) - count(*)), 9) AS jaccard FROM m a JOIN m b ON a.element = b.element AND a.method < b.method JOIN n na ON na.method = a.method AND na.class = a.class JOIN n nb ON nb.method = b.method AND nb.class = b.class GROUP BY 1, 2, 3, 4")
def group_similarity_matrix(spark, d):
    m = _methods(spark, d)
    n = m.groupBy("method", "class").agg(F.count("*").alias("n"))
    a, b = m.select(F.col("method").alias("ma"), F.col("class").alias("ca"), "element"), m.select(F.col("method").alias("mb"), F.col("class").alias("cb"), "element")
    c = a.join(b, "element").where("ma < mb").groupBy("ma", "mb", "ca", "cb").agg(F.count("*").alias("common"))
    side = lambda x, y, z: n.select(F.col("method").alias(x), F.col("class").alias(y), F.col("n").alias(z))
    return c.join(side("ma", "ca", "na"), ["ma", "ca"]).join(side("mb", "cb", "nb"), ["mb", "cb"]).select("ma", "mb", "ca", "cb", "common", F.round(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")), 9).alias("jaccard"))
