"""Comparison tables, alignment layouts and the streaming counter."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphweave.operators import compare as M
from graphweave.streaming.contacts import streaming_edges

from . import proxies as P
from .book import Book
from .proxies import sql

BOOK = Book()
query = BOOK.add

METRICS = ["price", "parts", "late"]
LOW = ["late"]


def _table(spark, d):
    """Methods are order priorities, datasets market segments; the third metric is better low."""
    o = P.table(spark, d, "orders").join(P.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return o.groupBy(F.col("c_mktsegment").alias("dataset"), F.col("o_orderpriority").alias("method")).agg(F.round(F.avg("o_totalprice"), 4).alias("price"), F.count("*").cast("double").alias("parts"), F.round(F.avg((F.col("o_orderstatus") == "O").cast("double")), 6).alias("late"))


def _long(spark, d):
    return M.long_form(_table(spark, d), ["dataset", "method"], METRICS)


_LONG = "WITH t AS (SELECT c_mktsegment AS dataset, o_orderpriority AS method, round(avg(o_totalprice), 4) AS price, count(*)::DOUBLE AS parts, round(avg((o_orderstatus = 'O')::INT), 6) AS late FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), l AS (SELECT dataset, method, 'price' AS metric, price AS value FROM t UNION ALL SELECT dataset, method, 'parts', parts FROM t UNION ALL SELECT dataset, method, 'late', late FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY dataset, metric ORDER BY CASE WHEN metric = 'late' THEN -value ELSE value END DESC, method) AS place FROM l)"


@query(_LONG + " SELECT * FROM r")
def metric_ranking(spark, d):
    return M.ranking(_long(spark, d), LOW).withColumn("place", F.col("place").cast("long"))


@query(_LONG + " SELECT dataset, method, metric, value FROM r WHERE place = 1")
def best_per_group(spark, d):
    return M.best_per_group(_long(spark, d), LOW)


@query(_LONG + " SELECT method, count(*) AS firsts FROM r WHERE place = 1 GROUP BY 1")
def first_place_counts(spark, d):
    return M.first_places(_long(spark, d), LOW)


@query(_LONG + " SELECT method, round(avg((place = 1)::INT), 9) AS win_rate FROM r GROUP BY 1")
def win_rate(spark, d):
    return M.win_rate(_long(spark, d), LOW).withColumn("win_rate", F.round("win_rate", 9))


@query(_LONG + " SELECT method, sum(CASE place WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END)::BIGINT AS points FROM r GROUP BY 1")
def rank_points(spark, d):
    return M.rank_points(_long(spark, d), LOW)


@query(_LONG + " SELECT method, metric, round(avg(value), 4) AS mean_value FROM l GROUP BY 1, 2")
def group_means(spark, d):
    return M.group_means(_long(spark, d)).withColumn("mean_value", F.round("mean_value", 4))


@query("WITH h AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN s_name END AS head FROM supplier) SELECT s_suppkey AS k, last_value(head IGNORE NULLS) OVER (ORDER BY s_suppkey ROWS UNBOUNDED PRECEDING) AS block FROM h")
def block_fill_down(spark, d):
    """Rows of a block text take the header above them."""
    s = P.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    P.checkpoints(spark)
    return M.fill_down(s, "k", "s_name", F.col("k") % 7 == 0, "block").select("k", "block")


def _paf(spark, d):
    """Lines as alignments: parts are queries, suppliers references."""
    line = P.table(spark, d, "lineitem")
    return line.select(F.concat(F.lit("q"), (F.col("l_partkey") % 300).cast("string")).alias("queryID"), F.concat(F.lit("r"), (F.col("l_suppkey") % 20).cast("string")).alias("refID"), (1000 + 50 * (F.col("l_suppkey") % 20)).cast("double").alias("refLen"), F.round(F.col("l_extendedprice") % 1000).alias("refStart"), F.col("l_quantity").alias("lenAln"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"))


_PAF = "WITH paf AS (SELECT 'q' || (l_partkey % 300) AS queryID, 'r' || (l_suppkey % 20) AS refID, (1000 + 50 * (l_suppkey % 20))::DOUBLE AS refLen, round(l_extendedprice % 1000) AS refStart, l_quantity AS lenAln, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand FROM lineitem), t AS (SELECT *, sum(lenAln) OVER (PARTITION BY queryID) AS total FROM paf)"


@query(_PAF + " SELECT queryID, refID, count(*) AS n, sum(lenAln) AS aligned FROM t WHERE total > 4500 AND lenAln > 10 AND refLen > 1200 GROUP BY 1, 2")
def paf_filter(spark, d):
    kept = M.paf_filter(_paf(spark, d), 4500, 10, 1200)
    return kept.groupBy("queryID", "refID").agg(F.count("*").alias("n"), F.sum("lenAln").alias("aligned"))


@query(_PAF + ", l AS (SELECT DISTINCT refID, refLen::BIGINT AS len FROM paf) SELECT refID, len, coalesce(sum(len) OVER (ORDER BY len, refID ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS shift FROM l")
def paf_offsets(spark, d):
    l = _paf(spark, d).select("refID", F.col("refLen").cast("long").alias("len")).distinct()  # noqa: E741
    P.checkpoints(spark)
    return M.axis_offsets(l, "refID", ["len", "refID"])


@query(_PAF + """, b AS (SELECT queryID, refID, row_number() OVER (PARTITION BY queryID ORDER BY sum(lenAln) DESC, refID) AS k FROM paf GROUP BY 1, 2),
h AS (SELECT p.queryID, p.refID, p.refStart, row_number() OVER (PARTITION BY p.queryID ORDER BY p.lenAln DESC, p.refStart) AS k2 FROM paf p JOIN b ON b.queryID = p.queryID AND b.refID = p.refID AND b.k = 1),
r AS (SELECT refID, row_number() OVER (ORDER BY refID) AS ref_rank FROM (SELECT DISTINCT refID FROM paf))
SELECT h.queryID, h.refID, h.refStart AS "at", row_number() OVER (ORDER BY ref_rank, h.refStart, h.queryID) AS rank FROM h JOIN r ON r.refID = h.refID WHERE k2 = 1""")
def paf_query_order(spark, d):
    from pyspark.sql import Window as W

    p = _paf(spark, d)
    ranks = p.select("refID").distinct().withColumn("ref_rank", F.row_number().over(W.orderBy("refID")))
    P.checkpoints(spark)
    return M.query_order(p, ranks)


@query(_PAF + " SELECT queryID, sum(CASE WHEN strand = '-' THEN lenAln ELSE -lenAln END) > 0 AS flip FROM paf GROUP BY 1")
def paf_flip(spark, d):
    return M.net_reversed(_paf(spark, d))


@query(sql("contacts") + " SELECT i, j, count(*) AS links FROM contacts GROUP BY 1, 2")
def streaming_contacts(spark, d):
    """The streaming aggregation over a batch of contacts; tests/ run it as a stream and compare."""
    c = P.contacts(spark, d)
    return streaming_edges(c.select(F.col("i").alias("ref"), (F.col("x") - 1).alias("pos"), F.col("j").alias("mref"), (F.col("y") - 1).alias("mpos")))


@query("SELECT user_id, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY 1")
def first_events(spark, d):
    """Arrival-order aggregate of a stream table."""
    return P.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))
