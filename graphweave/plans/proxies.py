"""The domain's entities, seen in the driver's tables.

Contacts are pairs of suppliers in one order, coordinates their quantities;
suppliers are contigs (span 50), their nation a group, their region a chromosome;
documents are sequences; events are read alignments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.operators.contacts import canonical, enrich

SPAN = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, rows: DataFrame, each: int) -> int:
    """How many tasks get ``each`` rows of a table on average; the session's number of shuffle partitions at least.

    Files may have few row groups and sessions a fixed number of partitions: work that is dealt to this many
    tasks takes no more of one task's memory and time on a larger table.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // each))


def checkpoints(spark: SparkSession) -> str:
    """The shared checkpoint folder; one is set only where the session has none."""
    import tempfile

    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        place = sc.getConf().get("spark.checkpoint.dir")
        if not place and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(place or "file://" + tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


LINES = 100_000  # order lines of a task


def lines(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for order lines, and for the contacts between them."""
    return tasks(spark, table(spark, sf_dir, "lineitem"), LINES)


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, x, j, y), canonical and 1-based."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q")).repartition(lines(spark, sf_dir), "l_orderkey")
    a = line.select("l_orderkey", F.col("l_suppkey").alias("ref"), (F.col("q") - 1).alias("pos"))
    b = line.select("l_orderkey", F.col("l_suppkey").alias("mref"), (F.col("q") - 1).alias("mpos"))
    return canonical(a.join(b, "l_orderkey").where("ref < mref").select("ref", "pos", "mref", "mpos"))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ctg"), "l_partkey", "l_quantity").repartition(lines(spark, sf_dir), "ctg", "l_partkey")
    line = line.groupBy("ctg", "l_partkey").agg(F.sum("l_quantity").alias("len")).groupBy("ctg").agg(F.sum("len").cast("long").alias("len"), F.count("l_partkey").alias("parts"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("chr"))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ctg"), "s_nationkey").join(line, "ctg", "left").join(nation, "s_nationkey")
    return rows.select("ctg", F.coalesce("len", F.lit(0)).cast("long").alias("len"), (1 + F.coalesce("parts", F.lit(0))).cast("long").alias("re_sites"), (F.col("s_nationkey") % 4).cast("long").alias("hap"), F.col("s_nationkey").cast("long").alias("nation"), F.col("chr").cast("long").alias("chr"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ctg"), F.lit(SPAN).cast("long").alias("len"))


def rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(contacts(spark, sf_dir), spans(spark, sf_dir))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ctg, grp): nine of ten suppliers, by nation."""
    return table(spark, sf_dir, "supplier").where("s_suppkey % 10 <> 0").select(F.col("s_suppkey").alias("ctg"), F.col("s_nationkey").cast("long").alias("grp"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("ctg"), F.col("text").alias("seq"), F.length("text").cast("long").alias("len"), "lang", "source")


def tours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, tour, pos, ctg, orient): each nation's suppliers in four orders."""
    from pyspark.sql import Window as W

    s = contigs(spark, sf_dir).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ctg"), "s_acctbal"), "ctg")
    orders = (("t1", [F.col("ctg")]), ("t2", [F.col("s_acctbal"), F.col("ctg")]), ("t3", [F.desc("ctg")]), ("t4", [F.col("len"), F.col("ctg")]))
    out = None
    for name, by in orders:
        part = s.select(F.col("nation").alias("grp"), F.lit(name).alias("tour"), F.row_number().over(W.partitionBy("nation").orderBy(*by)).cast("long").alias("pos"), "ctg", F.when(F.col("re_sites") % 2 == 0, "+").otherwise("-").alias("orient"))
        out = part if out is None else out.union(part)
    return out


#: The same entities in SQL, to stand before the queries' own.
SQL = {
    "contacts": "contacts AS (SELECT a.l_suppkey AS i, CAST(a.l_quantity AS BIGINT) AS x, b.l_suppkey AS j, CAST(b.l_quantity AS BIGINT) AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey)",
    "contigs": "contigs AS (SELECT s_suppkey AS ctg, coalesce(len, 0)::BIGINT AS len, (1 + coalesce(parts, 0))::BIGINT AS re_sites, (s_nationkey % 4)::BIGINT AS hap, s_nationkey::BIGINT AS nation, n_regionkey::BIGINT AS chr FROM supplier LEFT JOIN (SELECT l_suppkey, sum(l_quantity)::BIGINT AS len, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey JOIN nation ON n_nationkey = s_nationkey)",
    "edges": "edges AS (SELECT i, j, count(*) AS links FROM contacts GROUP BY 1, 2)",
    "both": "both_ AS (SELECT i AS u, j AS v, links AS w FROM edges UNION ALL SELECT j, i, links FROM edges)",
    "degree": "degree AS (SELECT u AS ctg, sum(w)::BIGINT AS degree FROM both_ GROUP BY 1)",
    "groups": "groups_ AS (SELECT s_suppkey AS ctg, s_nationkey::BIGINT AS grp FROM supplier WHERE s_suppkey % 10 <> 0)",
    "sites": "sites AS (SELECT grp, (1 + sum(re_sites - 1))::BIGINT AS grp_sites FROM groups_ JOIN contigs USING (ctg) GROUP BY 1)",
    "cgl": "cgl AS (SELECT b.u AS ctg, g.grp, sum(b.w)::BIGINT AS links FROM both_ b JOIN groups_ g ON g.ctg = b.v GROUP BY 1, 2)",
    "dens": "dens AS (SELECT c.ctg, c.grp, c.links, o.grp AS own, CASE WHEN o.grp = c.grp THEN c.links / s.grp_sites ELSE c.links / (s.grp_sites + k.re_sites - 1) END AS density FROM cgl c JOIN sites s USING (grp) JOIN contigs k USING (ctg) LEFT JOIN groups_ o ON o.ctg = c.ctg)",
    "tours": "tours AS (" + " UNION ALL ".join(f"SELECT nation AS grp, '{t}' AS tour, row_number() OVER (PARTITION BY nation ORDER BY {by}) AS pos, ctg, CASE WHEN re_sites % 2 = 0 THEN '+' ELSE '-' END AS orient FROM contigs JOIN supplier ON s_suppkey = ctg" for t, by in (("t1", "ctg"), ("t2", "s_acctbal, ctg"), ("t3", "ctg DESC"), ("t4", "len, ctg"))) + ")",
}


def sql(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names)
