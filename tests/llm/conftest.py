import pytest
from pyspark.sql import functions as F
from tests_prose import prose

#: Columns that share names with what the operators use inside.
CLASHES = ("score", "bits", "bit", "key", "body", "slot", "a", "b", "n", "path", "blob", "spans", "rank", "held_out", "train", "component_id", "lang_pred", "item_id", "media", "ids")


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing columns."""
    rows = [(k, prose("en" if k % 2 else "de", 30 + k, k), "en" if k % 2 else "de", "s", 1) for k in range(40)]
    rows += [(100, None, "en", "s", None), (101, "", "de", None, 0), (102, "12 34 !!", None, "s", 8), (103, prose("en", 60, 3), None, None, None), (103, prose("en", 60, 3), None, None, None), (104, prose("en", 60, 3), "en", "s", 1), (105, "a" * 40000 + " " + prose("de", 30000, 9), "de", "s", 1), (106, "é ü 漢字 😀 \u0000x\ttab\r\n\x0b end  ", None, "s", 1), (None, prose("de", 20, 5), "de", "s", 1), (107, " \n\t ", "en", "s", 3), (108, "Von.", "de", "s", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHES:
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
