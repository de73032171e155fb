"""The corpus pipeline: documents to tokens in five stages.

Every stage takes all documents that the one before it kept and, but for the
last, returns the columns of documents; other columns of its input are left out.
Between stages the rows are written and read again, which cuts lineage.

1. language_id: learns from the labelled documents; rows of no language go (null
   text, no letter, or no labelled row at all).
2. near_duplicates: one row of each group of similar texts (80 % of their five-word
   shingles) stays, that of the smallest doc_id.  Rows without a doc_id stay.
3. decontamination: documents that hold a benchmark item go.
4. secret_scan: findings are replaced by ``[SECRET]`` and n_chars follows.
5. byte_bpe: token ids, decoded again; per document their number and digests.

An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.llm import bpe, decontam, jaccard, langid, secret_scan
from graphweave.llm.common import join_listed, table, written
from graphweave.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None  # byte models and tokens aren't expressible; tests/llm compare with brute force


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    model = langid.train(docs.where(langid.fold(F.col("doc_id"), 3) != 1))
    return langid.predict(docs, model, [c for c in COLUMNS if c != "doc_id"]).where("lang_pred <> 'und'").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    groups = written(jaccard.similar_components(docs, k=5, percent=80), "groups")
    gone = written(groups.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    kept = join_listed(docs, gone, "doc_id", "left_anti")
    # rows that repeat a doc_id: of equal ones one stays
    twice = written(groups.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return kept
    repeated = join_listed(kept, twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return join_listed(kept, twice, "doc_id", "left_anti").union(repeated.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    # decisions come back by a key of id and text: ids may be null or stand for several texts
    docs = docs.withColumn("row_key", F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text")))
    rows = docs.select(F.col("row_key").alias("doc_id"), "text")
    leaks = decontam.find_leaks(rows, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("row_key")).distinct()
    return join_listed(docs, written(leaks, "leaks"), "row_key", "left_anti").select(*COLUMNS)


def secret_scanning(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS).withColumn("blob", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    _, ledger = secret_scan.scan_paths(secret_scan.blobs(docs))
    found = written(ledger.where(F.size("spans") > 0).select("blob", F.array_sort("spans").alias("spans")), "findings")
    clean = secret_scan.redact(F.col("text"), F.col("spans"))
    both = join_listed(docs, found, "blob", "left").withColumn("text", F.when(F.col("spans").isNotNull(), clean).otherwise(F.col("text")))
    return both.withColumn("n_chars", F.when(F.col("spans").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = vocabulary("byte_bpe_50k.tiktoken")
    return bpe.round_trip(docs, ranks)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scan", secret_scanning), ("byte_bpe", byte_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
