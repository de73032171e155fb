import random
import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphweave.operators import build as B
from graphweave.operators import consensus as K
from graphweave.operators import contacts as C
from graphweave.operators import evaluate as V
from graphweave.operators import filters as L
from graphweave.operators import graph as G
from graphweave.operators import order as O


def test_concordance_and_aggregates(spark):
    rows = spark.createDataFrame([(1, 2, 10, 70), (1, 2, 12, 73), (1, 2, 40, 95)], "i int, j int, x long, y long").withColumn("shorter", F.lit(80))
    assert C.concordance(rows, windows=8).first().concordance == pytest.approx(2 / 3)
    assert C.concordance(rows.withColumn("shorter", F.lit(5)), windows=8).first().concordance is None
    raw = spark.createDataFrame([("b", "a", 4, 9), ("a", "b", 0, 1), ("a", "a", 1, 2)], "ref string, mref string, pos long, mpos long")
    assert [tuple(r) for r in C.edge_counts(C.canonical(raw)).collect()] == [("a", "b", 2)]


def test_distances_of_hot_and_thin_pairs(spark):
    """A pair with most contacts, pairs below the least number, and one whose name follows another's."""
    rows = [("a", "b", 1 + k % 40, 1 + k % 7) for k in range(5000)] + [("a", "c", 3, 4), ("b", "c", 5, 5), ("b", "c", 6, 9)]
    rich = spark.createDataFrame(rows, "i string, j string, x long, y long").withColumn("li", F.lit(50).cast("long")).withColumn("lj", F.lit(60).cast("long"))
    got = {(r.i, r.j, r.ori): (r.n, r.line) for r in C.distance_lines(C.distance_runs(rich)).collect()}
    want: dict = {}
    for i, j, x, y in rows:
        for ori, d in (("++", 50 - (x - 1) + y - 1), ("+-", 50 - (x - 1) + 60 - (y - 1)), ("-+", x - 1 + y - 1), ("--", x - 1 + 60 - (y - 1))):
            want.setdefault((i, j, ori), []).append(d)
    assert got == {k: (2 * len(v), " ".join(f"{d} {d}" for d in sorted(v))) for k, v in want.items() if len(v) > 1}
    assert C.distance_lines(C.distance_runs(rich.limit(0))).count() == 0


def test_nx_select(spark):
    nodes = spark.createDataFrame([(k, n) for k, n in enumerate((50, 30, 15, 5))], "ctg int, len long")
    assert sorted(r.len for r in L.nx_select(nodes, 80).collect()) == [30, 50]


def test_quartiles_and_normalising(spark):
    rows = spark.createDataFrame([(x,) for x in (1.0, 2.0, 4.0, 10.0)], "v double")
    q = L.iqr_limit(rows, "v", 1.5).first()
    assert (q.q1, q.median, q.q3) == (1.75, 3.0, 5.5)
    e = spark.createDataFrame([("a", "b", 10)], "i string, j string, links int")
    d = spark.createDataFrame([("a", 20), ("b", 5)], "ctg string, degree int")
    assert L.normalise_by_degree(e, d).first().w == pytest.approx(1.0)


def test_read_pairs(spark):
    reads = spark.createDataFrame([("r", 0, 1.0, 0, False), ("r", 1, 0.0, 0, False), ("s", 2, 9.0, 0, False)], "name string, ord int, quality double, mismatch int, duplicate boolean")
    assert L.read_pairs_filter(reads, 1).count() == 0
    assert L.read_pairs_filter(reads, 1, either=True).count() == 1


def graph(edges, n):
    a = np.eye(n)
    for i, j, w in edges:
        a[i, j] = a[j, i] = w
    return a


TRIANGLES = [(0, 1, 5), (0, 2, 5), (1, 2, 5), (3, 4, 5), (3, 5, 5), (4, 5, 5), (2, 3, 1)]


def test_mcl_dense():
    cut = lambda e, n, r: G.read_clusters(G.mcl_dense(graph(e, n), r)[0])
    assert cut([(0, 1, 10)], 2, 1.2) == [[0, 1]] and cut([(0, 1, 10)], 2, 1.5) == [[0], [1]]
    assert cut(TRIANGLES, 6, 1.2) == [list(range(6))]
    assert cut(TRIANGLES, 6, 1.5) == cut(TRIANGLES, 6, 2.0) == [[0, 1, 2], [3, 4, 5]]
    assert len(cut(TRIANGLES, 6, 4.0)) == 6


def test_main_groups_and_recommendation(spark):
    rows = spark.createDataFrame([(1.0, k, n) for k, n in enumerate((100, 90, 80, 30, 5))], "run double, cluster int, len long")
    assert G.main_groups(rows, 0.75).first().main == 3
    grid = [(r, k, 100) for r, n in ((1.1, 2), (1.2, 3), (1.3, 5)) for k in range(n)]
    runs = spark.createDataFrame(grid, "run double, cluster int, len long")
    assert G.recommend(runs, 3).first().run == 1.2
    assert G.recommend(runs, 9).first().run == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.randoms())
def test_matching_is_optimal(n, m, rng):
    w = np.array([[rng.randint(0, 9) for _ in range(m)] for _ in range(n)], float)
    got = sum(w[i, j] for i, j in G.matching(w))
    small, big = (w, m) if n <= m else (w.T, n)
    best = max(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(big), len(small)))
    assert got == best


def test_allele_groups():
    assert G.allele_groups({(1, 2): 3.0, (2, 3): 1.0}, 2) == [frozenset({1, 2}), frozenset({2, 3})]
    clique = {p: float(sum(p)) for p in itertools.combinations(range(5), 2)}
    assert all(len(g) <= 3 for g in G.allele_groups(clique, 3)) and set().union(*G.allele_groups(clique, 3)) == set(range(5))


def test_consensus():
    m = {"a": {"A": frozenset({1, 2, 3}), "B": frozenset({4, 5})}, "x": {"X": frozenset({1, 2}), "Y": frozenset({3, 4, 5})}}
    tuples, left = K.greedy_tuples(m)
    assert [t["strict"] for t in tuples] == [{1, 2}, {4, 5}] and not left
    assert K.merge_similar([frozenset({1, 2, 3}), frozenset({1, 2, 3, 4}), frozenset({9})]) == [frozenset({9}), frozenset({1, 2, 3})]


def test_consensus_covers_all(spark):
    rows = [(m, str(x % k), x) for m, k in (("p", 3), ("q", 4)) for x in range(24)]
    out = K.consensus(spark.createDataFrame(rows, "method string, class string, element long")).collect()
    assert sorted(r.element for r in out) == list(range(24))


def test_edge_confidence(spark):
    e = spark.createDataFrame([("a", "b", 6.0), ("a", "c", 3.0), ("b", "c", 2.0)], "a string, b string, density double")
    got = {(r.a, r.b): r.confidence for r in O.edge_confidence(e).collect()}
    assert got == {("a", "b"): 2.0, ("a", "c"): 1.0, ("b", "c"): pytest.approx(2 / 3)}
    d = np.array([[0, 6, 3], [6, 0, 2], [3, 2, 0]], float)
    assert np.allclose(O._confidence(d), [[0, 2, 1], [2, 0, 2 / 3], [1, 2 / 3, 0]])
    assert O._confidence(np.array([[0, 5.0], [5.0, 0]])).max() == 2


def test_edge_confidence_in_tasks(spark, monkeypatch):
    from graphweave.operators import tables

    rng = random.Random(5)
    names = [f"n{k}" for k in range(12)]
    e = spark.createDataFrame([(a, b, float(rng.randrange(1, 6))) for k, a in enumerate(names) for b in names[k + 1 :] if rng.random() < 0.6], "a string, b string, density double")
    rows = e.collect()
    ends = {n: [(r.density, r) for r in rows if n in (r.a, r.b)] for n in names}

    def expected(r):
        rest = sorted((d for n in (r.a, r.b) for d, o in ends[n] if o is not r), reverse=True) + [None, None]
        if not rest[0]:
            return 2.0
        return r.density / rest[0] if rest[0] <= r.density else r.density / max(rest[1] or 0, r.density)

    want = {(r.a, r.b): expected(r) for r in rows}
    kept = tables.written(e, "edges")
    for limit in (tables.LISTED, -1):
        monkeypatch.setattr(tables, "LISTED", limit)
        out = O.edge_confidence(kept, 3)
        assert {(r.a, r.b): r.confidence for r in out.collect()} == want == {(r.a, r.b): r.confidence for r in O.edge_confidence(e).collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" if limit > 0 else "REPARTITION_BY_NUM") in plan and "Union" not in plan  # the densities of ends are read, not made again


def test_order_group():
    lengths = dict.fromkeys("abcd", 10)
    links = {(("a", "T"), ("b", "H")): 9, (("b", "T"), ("c", "T")): 8, (("c", "H"), ("d", "H")): 9, (("a", "T"), ("c", "T")): 1}
    tour = O.order_group(lengths, links)
    back = [(c, "+-"[o == "+"]) for c, o in reversed(tour)]
    assert [("a", "+"), ("b", "+"), ("c", "-"), ("d", "+")] in (tour, back)
    assert sorted(c for c, _ in O.order_group(lengths, {})) == list("abcd")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(1, 9)), max_size=8))
def test_heaviest_increasing(rows):
    total, at = O.heaviest_increasing([v for v, _ in rows], [w for _, w in rows])
    best = 0
    for k in range(len(rows) + 1):
        for c in itertools.combinations(range(len(rows)), k):
            if all(rows[a][0] < rows[b][0] for a, b in itertools.pairwise(c)):
                best = max(best, sum(rows[x][1] for x in c))
    assert total == best == sum(rows[x][1] for x in at)
    assert all(rows[a][0] < rows[b][0] for a, b in itertools.pairwise(at))


def test_lis_example():
    assert O.heaviest_increasing([1, 3, 2, 4], [10, 5, 20, 10])[0] == 40


def test_tours(spark):
    rows = [("g", "x", 1, "a", "+"), ("g", "x", 2, "b", "+"), ("g", "x", 3, "c", "-"), ("g", "y", 1, "c", "+"), ("g", "y", 2, "b", "-"), ("g", "y", 3, "a", "-")]
    t = spark.createDataFrame(rows, "grp string, tour string, pos int, ctg string, orient string")
    out = O.align_to_base(t, t.where("tour = 'x'")).where("tour = 'y'").orderBy("pos").collect()
    assert [(r.ctg, r.orient) for r in out] == [("a", "+"), ("b", "+"), ("c", "-")]
    assert {r.support for r in O.edge_support(O.align_to_base(t, t.where("tour = 'x'"))).collect()} == {2}


def test_scaffold_coordinates(spark):
    t = spark.createDataFrame([("s", 1, "x", "+"), ("s", 2, "y", "-")], "grp string, pos int, ctg string, orient string")
    c = spark.createDataFrame([("x", 100, "A" * 100), ("y", 80, "AAC" + "T" * 77), ("z", 5, "AAAAA")], "ctg string, len long, seq string")
    agp = [(r.beg, r.end, r.type, r.part) for r in B.coordinates(t, c).orderBy("beg").collect()]
    assert agp == [(1, 100, "W", 1), (101, 200, "U", 2), (201, 280, "W", 3)]
    assert B.sequences(t, c).first().seq == "A" * 100 + "N" * 100 + "A" * 77 + "GTT"
    assert [r.ctg for r in B.unplaced(t, c).collect()] == ["z"]
    bad = spark.createDataFrame([("s", 1, "x", "+"), ("s", 2, "x", "-"), ("s", 3, "q", "-")], t.schema)
    assert sorted((r.ctg, r.reason) for r in B.check_tours(bad, c).collect()) == [("q", "unknown"), ("x", "repeated")]


def test_clustering_score(spark):
    rows = [("g1", 1, 60, "c1", "c1_1"), ("g1", 2, 40, "c1", "c1_1"), ("g1", 3, 20, "c1", "c1_2"), ("g2", 4, 80, "c1", "c1_2"), ("g2", 5, 10, "c2", "c2_1"), ("g3", 6, 40, "c2", "c2_1")]
    m = spark.createDataFrame(rows, "grp string, ctg int, len long, chr string, src string")
    r = V.clustering_score(m, spark.createDataFrame([(250,)], "total long")).first()
    assert (round(r.contiguity, 4), round(r.homolog_error, 2), round(r.other_error, 2), round(r.anchoring, 2), round(r.adjusted, 3)) == (0.9333, 9.52, 4.76, 84.0, 0.784)


def test_scaffold_categories_part_everything(spark):
    rows = [("s", k, f"c{k}", "+" if k != 4 else "-", 10, "p", i, "+", 6) for k, i in enumerate((1, 2, 3, 4, 6, 5), 1)] + [("s", 7, "d", "+", 10, None, None, None, None), ("t", 1, "e", "+", 10, "q", 1, "+", 3)]
    placed = spark.createDataFrame(rows, "scaffold string, pos int, ctg string, orient string, len long, src string, idx int, truth_orient string, src_size long")
    got = {r.ctg: r.category for r in V.scaffold_categories(placed).collect()}
    assert set(got) == {r[2] for r in rows} and set(got.values()) <= set(V.CATEGORIES)
    assert got["d"] == "newly_anchored" and got["e"] == "unanchored" and got["c1"] == "syntenic" and got["c4"] == "inversion"


def test_inversions_and_similarity(spark):
    import random

    rng = random.Random(3)
    for n in (0, 1, 2, 3, 17, 64, 65):
        v = [rng.randrange(n) for _ in range(n)]
        assert O.inversions(np.array(v, np.int64)) == sum(v[i] > v[j] for i in range(n) for j in range(i + 1, n))
    large = np.array([rng.random() for _ in range(100_000)])
    assert O.inversions(large) + O.inversions(large[::-1]) == 100_000 * 99_999 // 2
    tours, base = [], []
    for g in range(4):
        names = [f"c{k}" for k in range(3 * g + 1)]
        base += [(g, c, k) for k, c in enumerate(rng.sample(names, len(names)))]
        for t in "ab":
            own = rng.sample(names, max(1, len(names) - g))
            tours += [(g, t, k, c, "+") for k, c in enumerate(own)]
    got = {(r.grp, r.tour): (r.forward, r.backward) for r in O.similarity_to_base(spark.createDataFrame(tours, "grp long, tour string, pos long, ctg string, orient string"), spark.createDataFrame(base, "grp long, ctg string, pos long")).collect()}
    for g in range(4):
        at = {c: k for h, c, k in base if h == g}
        for t in "ab":
            own = [(at[c], p) for h, u, p, c, _ in tours if (h, u) == (g, t)]
            pairs = [(p, q) for a, p in own for b, q in own if a < b]
            want = (sum(p < q for p, q in pairs) / len(pairs), sum(p > q for p, q in pairs) / len(pairs)) if pairs else None
            assert got.get((g, t)) == want


def test_contacts_are_dealt_by_size(spark, monkeypatch):
    """Aggregates of contacts and contigs get a task for so many order lines, whatever the session's number of partitions."""
    import re

    from graphweave.plans import catalogue
    from graphweave.plans import proxies as P

    monkeypatch.setattr(P, "LINES", 100)
    sf = "/root/testdata/sf0.001"
    n = P.lines(spark, sf)
    assert n > 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name in ("ht_links", "clm_distances", "concentration_ratio", "concordance_ratio", "first_n_pairs", "density_filter"):
        plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        dealt = [int(x) for x in re.findall(r"hashpartitioning\(.*, (\d+)\), REPARTITION_BY_NUM", plan)]
        assert len(dealt) >= 2 and min(dealt) >= n, name


def test_ordering_holds_links_not_matrices():
    """A large group with few links takes memory by its links."""
    import tracemalloc

    n = 3000
    links = {((k, "T"), (k + 1, "H")): 9.0 for k in range(n - 1)}
    tracemalloc.start()
    tour = O.order_group(dict.fromkeys(range(n), 10), links)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [c for c, _ in tour] in (list(range(n)), list(range(n))[::-1])
    assert peak < 8 * n * n
