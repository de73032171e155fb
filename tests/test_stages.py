"""The stage store: what is made again, what is read, what goes; and the whole run twice."""

import os

import pytest
from pyspark.sql import functions as F

from graphweave.operators import contacts as C
from graphweave.operators import stages
from graphweave.plans import run_queries as R

SF = "/root/testdata/sf0.001"


def test_stages_are_made_once(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    root = f"file://{tmp_path}/store"

    def run(factor, store):
        base = store.source("base", spark.read.parquet(str(tmp_path / "in")))
        a = store.stage("a", lambda: base.table.withColumn("x", F.col("id") * factor), [base], factor=factor)
        b = store.stage("b", lambda: base.table.where("id > 3"), [base])
        return store.stage("c", lambda: a.table.join(b.table, "id").agg(F.sum("x").alias("s")), [a, b]).table.first().s

    first = stages.StageStore(spark, root)
    assert run(2, first) == 2 * sum(range(4, 10)) and first.made == ["a", "b", "c"]
    second = stages.StageStore(spark, root)
    assert run(2, second) == 2 * sum(range(4, 10)) and second.made == [] and second.read == ["a", "b", "c"]
    third = stages.StageStore(spark, root)
    assert run(3, third) == 3 * sum(range(4, 10)) and third.made == ["a", "c"] and third.read == ["b"]
    known = third.manifest("c", next(iter(third.used["c"])))
    assert known["rows"] == 1 and known["bytes"] > 0 and set(known["inputs"]) == {"a", "b"} and known["parameters"] == {}
    # a stage that was cut off: data without a manifest
    key = next(iter(third.used["b"]))
    os.remove(tmp_path / "store" / "b" / key / "manifest.json")
    fourth = stages.StageStore(spark, root)
    assert run(3, fourth) == 3 * sum(range(4, 10)) and fourth.made == ["b"]
    gone = fourth.clean()
    assert len(gone) == 3 and {g.split("/")[0] for g in gone} == {"a", "b", "c"}
    fifth = stages.StageStore(spark, root)
    assert run(3, fifth) == 3 * sum(range(4, 10)) and fifth.made == []
    # another input
    spark.range(12).write.mode("overwrite").parquet(str(tmp_path / "in"))
    assert run(3, sixth := stages.StageStore(spark, root)) == 3 * sum(range(4, 12)) and sixth.made == ["a", "b", "c"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_the_run_and_a_second_one(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    found, store = R.run(spark, SF, root=root)
    rows = found["agp"].table.collect()
    members = [r for r in rows if r.type == "W"]
    contigs = {r.ctg for r in found["reassigned"].table.collect()}
    assert sorted(int(r.comp) for r in members) == sorted(contigs) and store.read == []
    again, second = R.run(spark, SF, root=root)
    assert second.made == [] and sorted(map(str, again["agp"].table.collect())) == sorted(map(str, rows))
    # another gap: coordinates alone are made again
    _, third = R.run(spark, SF, R.Settings(**(vars(R.SETTINGS) | {"gap": 7})), root)
    assert third.made == ["agp"]
    ordered, fourth = R.run(spark, SF, R.Settings(**(vars(R.SETTINGS) | {"order": "links"})), root)
    assert fourth.made == ["tours", "agp"] and sorted(int(r.comp) for r in ordered["agp"].table.where("type = 'W'").collect()) == sorted(contigs)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_contacts_are_dealt_once_and_not_stored(spark, tmp_path):
    found, store = R.run(spark, SF, root=f"file://{tmp_path}/store")
    assert not (tmp_path / "store" / "contacts").exists() and "contacts" not in store.made
    rich = R.P.rich(spark, SF)
    for tasks in (None, 3):
        halves = C.half_edges(rich, tasks)
        assert tasks is None or halves.rdd.getNumPartitions() == tasks
        assert sorted(halves.collect()) == sorted(found["halves"].table.collect())
        assert sorted(C.whole_edges(halves, tasks).collect()) == sorted(C.edge_counts(rich).collect()) == sorted(found["edges"].table.collect())
