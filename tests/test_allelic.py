"""Allele groups and their matching against plain Python on all edges."""

import os

import numpy as np
import pytest

from graphweave.operators import graph as G
from graphweave.plans import catalogue, graph_queries

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_cliques_of_concordant_pairs(spark):
    pairs = {(r.i, r.j): float(r.links) for r in catalogue.QUERIES["allelic_pairs"](spark, SF).collect()}
    got = {(r.group, r.ctg) for r in catalogue.QUERIES["allelic_cliques"](spark, SF).collect()}
    assert got == {("/".join(map(str, sorted(c))), x) for c in G.allele_groups(pairs, 4) for x in c}
    assert max(j - i for i, j in pairs) > 3


def test_matching_of_all_edges(spark):
    tables = {}
    for r in graph_queries.edges(spark, SF).collect():
        if r.i // 4 != r.j // 4:
            flip = str(r.i // 4) > str(r.j // 4)
            x, y = (r.j, r.i) if flip else (r.i, r.j)
            tables.setdefault((x // 4, y // 4), []).append((x, y, r.links, r.i, r.j))
    want = set()
    for rows in tables.values():
        p, q = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
        w = np.zeros((len(p), len(q)))
        for x, y, n, _, _ in rows:
            w[p.index(x), q.index(y)] = n
        kept = {(p[x], q[y]) for x, y in G.matching(w)}
        want |= {(i, j) for x, y, _, i, j in rows if (x, y) not in kept}
    assert {(r.i, r.j) for r in catalogue.QUERIES["allelic_matching"](spark, SF).collect()} == want


def test_small_matchings_are_those_of_arrays(spark, monkeypatch):
    """The same choice among equals on lists and on arrays, and no Python call for each pair of groups."""
    import random

    import numpy as np

    from graphweave.operators import graph as G

    rng = random.Random(5)
    for _ in range(300):
        w = np.array([[float(rng.randrange(4)) for _ in range(q)] for q in [rng.randrange(1, 6)] for _ in range(rng.randrange(1, 6))])
        small = G.matching(w)
        with monkeypatch.context() as m:
            m.setattr(G, "SMALL", 0)
            assert small == G.matching(w)
    edges = spark.createDataFrame([(i, j, float((i * j) % 5 + 1)) for i in range(40) for j in range(i + 1, 40)], "i long, j long, w double")
    groups = spark.range(40).selectExpr("cast(id div 4 as string) as group", "id as ctg")
    out = G.unmatched_edges(edges, groups, 8)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    # a full 4 by 4 pair of groups leaves 12 of its 16 edges
    assert out.count() == 45 * 12


def test_pairs_are_made_once(spark):
    """Components and groups read the written pairs; the work behind the pairs isn't done again for each of them."""
    import pyarrow as pa

    edges = [(1, 2), (1, 3), (2, 3), (3, 4), (8, 9)]
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield pa.RecordBatch.from_arrays([b["i"], b["j"], b["w"]], ["i", "j", "w"])

    pairs = spark.createDataFrame([(i, j, float(i + j)) for i, j in edges], "i long, j long, w double").mapInArrow(seen, "i long, j long, w double")
    got = {(r.group, r.ctg) for r in G.allelic_groups(pairs, 4).collect()}
    assert got == {("/".join(map(str, sorted(c))), x) for c in G.allele_groups({e: float(sum(e)) for e in edges}, 4) for x in c}
    assert made.value == len(edges)
