"""The whole run from contacts to scaffolds, by stages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphweave.operators import stages
from graphweave.operators.scaffolding import Settings, scaffold
from graphweave.operators.tables import shared_folder

from . import graph_queries as Q
from . import proxies as P
from .book import Book
from .proxies import SQL

BOOK = Book()
query = BOOK.add

SETTINGS = Settings(groups=5, inflations=(1.4, 1.6, 2.0), share=95, sites=100, density=(0.5, 1.5), between=0.98, resolution=50, limits=Q.LIMITS, order="length")


def run(spark, d, settings: Settings = SETTINGS, root: str | None = None):
    """All stages over the driver's tables, and their store."""
    P.checkpoints(spark)
    store = stages.StageStore(spark, root or f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}")
    lines, suppliers, nations = (store.source(t, P.table(spark, d, t)) for t in ("lineitem", "supplier", "nation"))
    links = store.passing("contacts", P.rich(spark, d), [lines, suppliers])
    contigs = store.stage("contigs", lambda: P.contigs(spark, d).select("ctg", "len", "re_sites", F.col("nation").alias("hap")), [lines, suppliers, nations])
    return scaffold(store, links, contigs, settings, P.lines(spark, d)), store


_KEPT = """
x AS (SELECT ctg, coalesce(sum(len) OVER (ORDER BY len DESC, ctg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(len) OVER () AS total FROM contigs),
n AS (SELECT c.*, coalesce(degree, 0) AS degree, coalesce(degree, 0) / re_sites AS density FROM contigs c LEFT JOIN degree USING (ctg)),
c AS (SELECT n.* FROM n JOIN x USING (ctg) WHERE before * 100 < total * 95 AND re_sites > 100),
kept AS (SELECT ctg FROM c, (SELECT sum(degree) / (1 + sum(re_sites - 1)) AS m FROM c WHERE degree > 0) WHERE density >= 0.5 * m AND density <= 1.5 * m),
we AS (SELECT 0 AS mask, i, j, links * (CASE WHEN a.nation = b.nation THEN 1 ELSE 1 - 0.98::DOUBLE END) AS w FROM edges JOIN contigs a ON a.ctg = i JOIN contigs b ON b.ctg = j WHERE i IN (SELECT ctg FROM kept) AND j IN (SELECT ctg FROM kept)),"""
_CHOSEN = """,
z AS (SELECT mask, inflation, cluster, count(*) AS n_ctg, sum(len)::BIGINT AS len FROM cl JOIN contigs USING (ctg) GROUP BY 1, 2, 3)""" + Q._BESTS.replace("main >= 3", "main >= 5") + """,
pick AS (SELECT coalesce((SELECT best FROM b), (SELECT arg_max(inflation, (n, -inflation)) FROM (SELECT inflation, count(*) AS n FROM z GROUP BY 1))) AS inflation),
groups_ AS (SELECT ctg, cluster AS grp FROM cl JOIN pick USING (inflation)),
pairs AS (SELECT i, j, round(50 * links * (CASE WHEN a.nation = b.nation THEN 1 ELSE 1 - 0.98::DOUBLE END))::BIGINT AS w FROM edges JOIN contigs a ON a.ctg = i JOIN contigs b ON b.ctg = j),
both_ AS (SELECT i AS u, j AS v, w FROM pairs UNION ALL SELECT j, i, w FROM pairs)"""
_AGP = """,
o AS (SELECT f.grp, f.ctg, c.len, row_number() OVER w AS k, sum(c.len) OVER w AS run, count(*) OVER (PARTITION BY f.grp) AS n FROM fin f JOIN contigs c USING (ctg) WINDOW w AS (PARTITION BY f.grp ORDER BY c.len DESC, f.ctg)),
p AS (SELECT *, run + (k - 1) * 100 AS e FROM o)
SELECT grp, (e - len + 1)::BIGINT AS beg, e::BIGINT AS "end", (2 * k - 1)::INT AS part, 'W' AS type, ctg::VARCHAR AS comp, 1::BIGINT AS comp_beg, len AS comp_end, '+' AS orient FROM p
UNION ALL SELECT grp, (e + 1)::BIGINT, (e + 100)::BIGINT, (2 * k)::INT, 'U', '100', NULL, NULL, NULL FROM p WHERE k < n"""
_RUN = "WITH RECURSIVE " + ", ".join(SQL[k] for k in ("contacts", "contigs", "edges", "degree")).replace("FROM both_", "FROM (SELECT i AS u, links AS w FROM edges UNION ALL SELECT j, links FROM edges)") + "," + _KEPT + Q._mcl([1.4, 1.6, 2.0]) + _CHOSEN
_LAST = "SELECT ctg, grp FROM st WHERE step = 6 * n AND grp IS NOT NULL"
assert Q._TURNS.endswith(_LAST)


@query(_RUN + Q._TURNS[: -len(_LAST)].rstrip() + f", fin AS ({_LAST})" + _AGP)
def scaffold_run(spark, d):
    """Contacts, node filter, weights, clusters of a grid, reassignment and coordinates; members by length."""
    return run(spark, d)[0]["agp"].table


@query()
def scaffold_run_ordered(spark, d):
    """The same, members ordered and oriented by links between their halves."""
    return run(spark, d, Settings(**(vars(SETTINGS) | {"order": "links"})))[0]["agp"].table
