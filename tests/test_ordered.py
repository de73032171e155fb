"""Steps over ranges against windows over the whole table."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphweave.operators import clustering as M
from graphweave.operators import graph as G
from graphweave.operators import ordered as O


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def table(spark, n):
    rng = random.Random(n)
    rows = [(k, rng.choice([1, 1, 1, rng.randrange(50)]), rng.choice([None, f"v{k}"])) for k in range(n)]
    return spark.createDataFrame(rows, "k long, value long, last string").repartition(3)


def test_against_windows(spark):
    for n in (0, 1, 400):
        t = table(spark, n)
        w, order = W.orderBy(F.desc("value"), "k"), [F.desc("value"), "k"]
        same(O.positions(t, order, "at"), t.withColumn("at", (F.row_number().over(w) - 1).cast("long")))
        same(O.running_sum(t, order, F.col("value"), "before"), t.withColumn("before", F.coalesce(F.sum("value").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
        for value in (F.col("last"), F.when(F.col("k") == 5, F.col("k")), F.lit(None).cast("string")):
            same(O.carried(t, "k", value, "v"), t.withColumn("v", F.last(value, ignorenulls=True).over(W.orderBy("k").rowsBetween(W.unboundedPreceding, 0))))


def test_interpret_rejects_as_read_clusters(spark):
    """Overlapping clusters, ones of the same least member too, and unreached nodes give no rows in either form."""
    import numpy as np

    cases = [["100", "010", "001"], ["110", "000", "001"], ["110", "000", "011"], ["1110", "0000", "0000", "1001"], ["100", "000", "001"], ["11", "11"]]
    for case in cases:
        m = np.array([[float(x) for x in r] for r in case])
        long = spark.createDataFrame([(i, j, float(m[i, j])) for i, j in np.ndindex(m.shape) if m[i, j]] + [(99, j, 1.0) for j in range(len(m)) if not m[:, j].any()], "row long, col long, val double")
        found = G.read_clusters(m) or []
        assert sorted((r.cluster, r.ctg) for r in M.interpret(long, []).collect()) == sorted((c[0], x) for c in found for x in c), case
