"""Sequential reassignment against a loop over contigs."""

import math
import random

import pytest

from graphweave.operators import sequential as S
from graphweave.operators.reassign import Limits


@pytest.fixture(autouse=True)
def folder(spark, tmp_path_factory):
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir("file://" + str(tmp_path_factory.mktemp("checkpoints")))


def loop_round(contigs, edges, groups, limits, formal=True):
    """One contig after the other; each move changes what later contigs see."""
    size = {c: (n, s) for c, n, s in contigs}
    near = {}
    for i, j, w in edges:
        near.setdefault(i, []).append((j, w))
        near.setdefault(j, []).append((i, w))
    state, sites = dict(groups), {}
    for c, g in state.items():
        sites[g] = sites.get(g, 1) + size[c][1] - 1
    for c in sorted(size, key=lambda c: (-size[c][0], c)):
        links = {}
        for o, w in near.get(c, ()):
            if o in state:
                links[state[o]] = links.get(state[o], 0) + w
        own = state.get(c)
        if not links or size[c][1] - 1 < limits.sites:
            continue
        ranked = sorted(links, key=lambda g: (-links[g], g))
        top = own if own in links and links[own] == links[ranked[0]] else ranked[0]
        density = {g: links[g] / (sites[g] if g == own else sites[g] + size[c][1] - 1) for g in links}
        if links[top] < limits.links or density[top] < limits.density or own == top:
            continue
        if formal and len(ranked) > 1 and links[ranked[1]] / links[ranked[0]] >= limits.ambiguity:
            continue
        rest = (math.fsum(density.values()) - density[top]) / max(1, len(sites) - 1)
        ratio = density[top] / rest if rest > 1e-12 else 1e6
        if ratio >= limits.ratio and (own is None or (formal and size[c][0] <= limits.longest)):
            if own is not None:
                sites[own] -= size[c][1] - 1
            state[c] = top
            sites[top] += size[c][1] - 1
    return state


def loop_reassign(contigs, edges, groups, limits, rounds=5, least=0):
    state, lengths = dict(groups), {c: n for c, n, _ in contigs}
    for k in range(rounds):
        if k:
            total = {}
            for c, g in state.items():
                total[g] = total.get(g, 0) + lengths[c]
            state = {c: g for c, g in state.items() if total[g] >= least}
        new = loop_round(contigs, edges, state, limits)
        if new == state:
            break
        state = new
    return loop_round(contigs, edges, state, limits, formal=False)


def random_case(rng, n, names):
    contigs = [(f"c{k:03}" if names else k, rng.choice([5, 10, 20, 40, 80]), rng.randrange(1, 40)) for k in range(n)]
    groups = {c: rng.randrange(4) for c, _, _ in contigs if rng.random() < 0.7}
    edges = [(a[0], b[0], rng.randrange(1, 50)) for x, a in enumerate(contigs) for b in contigs[x + 1 :] if rng.random() < 0.4]
    return contigs, edges, groups


def test_many_random_graphs_in_one(spark, monkeypatch):
    """200 graphs side by side: the same turns, separate contigs and groups.

    The share of the others counts all groups, so the loop runs over the joined graph, too.
    """
    monkeypatch.setattr(S, "BLOCK", 16)  # many blocks of turns
    rng = random.Random(4)
    contigs, edges, groups = [], [], {}
    for g in range(200):
        own, links, state = random_case(rng, rng.randrange(2, 12), False)
        contigs += [(f"{g:03}.{c:02}", n, s) for c, n, s in own]
        edges += [(f"{g:03}.{a:02}", f"{g:03}.{b:02}", w) for a, b, w in links]
        groups |= {f"{g:03}.{c:02}": 10 * g + v for c, v in state.items()}
    limits = Limits(sites=2, links=3, density=0.01, ratio=1.37, ambiguity=0.93, longest=40)
    want = loop_reassign(contigs, edges, groups, limits)
    assert sum(want.get(c) != groups.get(c) for c, _, _ in contigs) > 50
    e = spark.createDataFrame(edges, "i string, j string, links long")
    c = spark.createDataFrame(contigs, "ctg string, len long, re_sites long")
    s = spark.createDataFrame(list(groups.items()), "ctg string, grp long")
    assert {r.ctg: r.grp for r in S.reassign(e, s, c, limits).collect()} == want


@pytest.mark.parametrize("seed", [1])
def test_dense_graphs_with_dissolving(spark, seed):
    rng = random.Random(seed)
    contigs, edges, groups = random_case(rng, 30, True)
    limits = Limits(sites=0, links=1, density=0, ratio=1.0 + 0.0313 * seed, ambiguity=0.999, longest=1e9)
    want = loop_reassign(contigs, edges, groups, limits, rounds=3, least=150)
    e = spark.createDataFrame(edges, "i string, j string, links long")
    c = spark.createDataFrame(contigs, "ctg string, len long, re_sites long")
    s = spark.createDataFrame(list(groups.items()), "ctg string, grp long")
    assert {r.ctg: r.grp for r in S.reassign(e, s, c, limits, rounds=3, least_length=150).collect()} == want


def test_a_chain_of_dependent_moves(spark):
    """Each contig follows the one before: the most passes, and still the sequential result."""
    n = 8
    contigs = [(k, 100 - k, 2) for k in range(n)]
    edges = [(k, k + 1, 10) for k in range(n - 1)]
    limits = Limits(ratio=1.5, ambiguity=0.9)
    order = S.turns(spark.createDataFrame(contigs, "ctg long, len long, re_sites long"))
    links = S.seen_links(spark.createDataFrame(edges, "i long, j long, links long"), order)
    after, moved, passes = S.one_round(order, links, spark.createDataFrame([(0, 1), (n - 1, 2)], "ctg long, grp long"), limits)
    got = {r.ctg: r.grp for r in after.where("grp is not null").collect()}
    assert got == loop_round(contigs, edges, {0: 1, n - 1: 2}, limits) and moved == n - 3 and passes <= n + 1


def test_known_case():
    contigs = [(0, 100, 11), (1, 90, 11), (2, 50, 6), (3, 40, 6)]
    edges = [(0, 2, 10), (1, 2, 1), (1, 3, 8), (0, 3, 1)]
    assert loop_round(contigs, edges, {0: "x", 1: "y"}, Limits(ratio=1.5, ambiguity=0.9)) == {0: "x", 1: "y", 2: "x", 3: "y"}


def test_no_edges_and_no_groups(spark):
    c = spark.createDataFrame([(1, 10, 3), (2, 5, 3)], "ctg long, len long, re_sites long")
    none = spark.createDataFrame([], "i long, j long, links long")
    s = spark.createDataFrame([(1, 7), (9, 7)], "ctg long, grp long")
    assert [tuple(r) for r in S.reassign(none, s, c, Limits()).collect()] == [(1, 7)]
    assert S.reassign(none, s.limit(0), c, Limits()).count() == 0


def test_links_are_kept_once(spark):
    """Each edge stands at its later end only, without columns that passes don't read."""
    order = S.turns(spark.createDataFrame([(1, 10, 3), (2, 30, 3), (3, 20, 3)], "ctg long, len long, re_sites long"))
    links = S.seen_links(spark.createDataFrame([(1, 2, 5), (1, 3, 6), (2, 3, 7)], "i long, j long, links long"), order)
    assert sorted(map(tuple, links.select("ctg", "turn", "other", "links").collect())) == [(1, 2, 2, 5), (1, 2, 3, 6), (3, 1, 2, 7)] and len(links.columns) == 4


def test_blocks_of_turns_see_each_other(spark, monkeypatch):
    """Few links a block: moves of earlier blocks reach later ones by the join, those inside a block by turns."""
    monkeypatch.setattr(S, "BLOCK", 4)
    monkeypatch.setattr(S, "WORK", 12)
    rng = random.Random(6)
    contigs, edges, groups = random_case(rng, 30, True)
    limits = Limits(sites=0, links=1, density=0, ratio=1.05, ambiguity=0.999, longest=1e9)
    want = loop_round(contigs, edges, groups, limits)
    assert sum(want.get(c) != groups.get(c) for c, _, _ in contigs) > 8
    order = S.turns(spark.createDataFrame(contigs, "ctg string, len long, re_sites long"))
    links = S.seen_links(spark.createDataFrame(edges, "i string, j string, links long"), order)
    bounds = S.cuts(order, links, 30)
    assert bounds[0] == 0 and bounds[-1] == 30 and 4 < len(bounds) < 9
    after, moved, passes = S.one_round(order, links, spark.createDataFrame(list(groups.items()), "ctg string, grp long"), limits)
    assert {r.ctg: r.grp for r in after.where("grp is not null").collect()} == want and passes == len(bounds) - 1


def test_passes_do_not_follow_a_chain(spark):
    """A long chain of moves is one block's work, not a pass a move."""
    n = 24
    contigs, edges = [(k, 100 - k, 2) for k in range(n)], [(k, k + 1, 10) for k in range(n - 1)]
    order = S.turns(spark.createDataFrame(contigs, "ctg long, len long, re_sites long"))
    links = S.seen_links(spark.createDataFrame(edges, "i long, j long, links long"), order)
    after, moved, passes = S.one_round(order, links, spark.createDataFrame([(0, 1), (n - 1, 2)], "ctg long, grp long"), Limits(ratio=1.5, ambiguity=0.9))
    assert moved == n - 3 and passes == 1
