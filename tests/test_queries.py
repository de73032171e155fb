"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from graphweave.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
SLOW: set[str] = set()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def normal(df: pd.DataFrame) -> list:
    cell = lambda v: "NULL" if v is None or v is pd.NA or v != v else f"{float(v):.9g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(catalogue.ORACLES) - SLOW))
def test_matches_sql(spark, db, name):
    assert normal(catalogue.QUERIES[name](spark, SF).toPandas()) == normal(db.execute(catalogue.ORACLES[name]).df())


def test_triplets_by_brute_force():
    import itertools
    import random

    from graphweave.operators.consensus import pick_best, pick_greedily

    rng = random.Random(2)
    for _ in range(60):
        n = rng.randrange(1, 5)
        rows = [(str(a), str(b), str(c), rng.randrange(1, 9)) for a in range(n) for b in range(n) for c in range(n) if rng.random() < 0.7]
        weight = {r[:3]: r[3] for r in rows}
        most = max(sum(weight.get((str(a), str(b[a]), str(c[a])), 0) for a in range(n)) for b in itertools.permutations(range(n)) for c in itertools.permutations(range(n)))
        best, greedy = pick_best(rows), pick_greedily(rows)
        for chosen in (best, greedy):
            assert all(len({r[k] for r in chosen}) == len(chosen) for k in range(3)) and set(chosen) <= set(rows)
        assert sum(r[3] for r in best) == most >= sum(r[3] for r in greedy)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def once(rows, *columns):
    keys = [tuple(r[c] for c in columns) for r in rows]
    return len(set(keys)) == len(keys)


def tiles(rows):
    """Members and gaps of each scaffold take turns and leave no base out."""
    for grp in {r.grp for r in rows}:
        own = sorted((r for r in rows if r.grp == grp), key=lambda r: r.beg)
        ends = [0, *(r.end for r in own)]
        if [r.beg for r in own] != [e + 1 for e in ends[:-1]] or [r.part for r in own] != list(range(1, len(own) + 1)) or [r.type for r in own] != ["WU"[k % 2] for k in range(len(own))]:
            return False
    return True


#: What must hold for the rows of queries without SQL.  suppliers: all ids.
INVARIANTS = {
    "consensus_greedy": lambda rows, suppliers: once(rows, "element") and {r.element for r in rows} == suppliers,
    "consensus_triplets": lambda rows, suppliers: once(rows, "a") and once(rows, "b") and once(rows, "c") and all(r.common > 0 for r in rows),
    "consensus_assignment": lambda rows, suppliers: once(rows, "a") and once(rows, "b") and once(rows, "c") and sum(r.common for r in rows) <= min(r.bound for r in rows) <= len(suppliers),
    "fast_order": lambda rows, suppliers: once(rows, "ctg") and {r.ctg for r in rows} == {s for s in suppliers if s % 10} and all(r.orient in "+-" for r in rows) and once(rows, "grp", "pos"),
    "order_choice": lambda rows, suppliers: once(rows, "grp") and all(r.choice in ("fast", "other") for r in rows),
    "allelic_cliques": lambda rows, suppliers: once(rows, "group", "ctg") and all(sum(x.group == r.group for x in rows) in (2, 3, 4) and str(r.ctg) in r.group.split("/") for r in rows),
    "allelic_matching": lambda rows, suppliers: once(rows, "i", "j") and all(r.i // 4 != r.j // 4 for r in rows),
    "scaffold_run_ordered": lambda rows, suppliers: tiles(rows) and once([r for r in rows if r.type == "W"], "comp") and all(r.orient in "+-" for r in rows if r.type == "W"),
}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_others_hold_what_they_must(spark, db, name):
    rows = catalogue.QUERIES[name](spark, SF).collect()
    suppliers = {r[0] for r in db.execute("SELECT s_suppkey FROM supplier").fetchall()}
    assert (rows or name == "allelic_cliques") and INVARIANTS.get(name, lambda rows, suppliers: all(any(v is not None for v in r) for r in rows))(rows, suppliers)


def test_partitions(spark):
    rows = catalogue.QUERIES["mcl_clusters"](spark, SF).toPandas()
    for _, own in rows.groupby("inflation"):
        assert own["ctg"].is_unique
    tours = catalogue.QUERIES["fast_order"](spark, SF).toPandas()
    assert tours["ctg"].is_unique
