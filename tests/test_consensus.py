"""Consensus on cells of elements against consensus on the elements."""

import random

import pytest

from graphweave.operators import consensus as K


@pytest.fixture(autouse=True)
def folder(spark, tmp_path_factory):
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir("file://" + str(tmp_path_factory.mktemp("checkpoints")))


def groups(rows):
    out: dict = {}
    for g, x in rows:
        out.setdefault(g, set()).add(x)
    return out


def test_cells_give_what_elements_give(spark):
    rng = random.Random(1)
    own, want = [], {}
    for case in range(3):
        methods: dict = {}
        for m, k in (("p", 4), ("q", 5), ("r", 4)):
            for x in range(120):
                if rng.random() < 0.95:  # some methods leave elements out
                    c = str((x // 7 + (rng.random() < 0.15)) % k)
                    methods.setdefault(m, {}).setdefault(c, set()).add(x)
        methods = {m: {c: frozenset(s) for c, s in of.items()} for m, of in methods.items()}
        own.append([(m, c, x) for m, of in methods.items() for c, s in of.items() for x in s])
        want[case] = groups(K.agreed(methods))
    for case, rows in enumerate(own):
        df = spark.createDataFrame(rows, "method string, class string, element long")
        got = groups((r.grp, r.element) for r in K.consensus(df).collect())
        named = lambda x: {g: s for g, s in x.items() if g[0] == "g"}
        assert named(got) == named(want[case])
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want[case].values()))


def test_an_element_in_two_classes_of_a_method(spark):
    rows = [("p", "a", 1), ("p", "b", 1), ("p", "a", 2), ("q", "a", 1), ("q", "a", 2), ("q", "b", 3), ("p", "b", 3)]
    df = spark.createDataFrame(rows * 2, "method string, class string, element long")
    assert sorted(r.element for r in K.consensus(df).collect()) == [1, 2, 3]
    assert K.consensus(df.limit(0)).count() == 0


def test_relaxed_choices_are_valid_and_bounded():
    import itertools

    rng = random.Random(6)
    proved = 0
    for _ in range(60):
        n = rng.randrange(1, 5)
        rows = [(str(a), str(b), str(c), rng.randrange(1, 30)) for a in range(n) for b in range(n) for c in range(n) if rng.random() < 0.6]
        weight = {r[:3]: r[3] for r in rows}
        most = max(sum(weight.get((str(a), str(b[a]), str(c[a])), 0) for a in range(n)) for b in itertools.permutations(range(n)) for c in itertools.permutations(range(n)))
        chosen, bound = K.relaxed(rows)
        total = sum(r[3] for r in chosen)
        assert all(len({r[k] for r in chosen}) == len(chosen) for k in range(3)) and set(chosen) <= set(rows)
        assert total <= most <= bound + 1e-6
        proved += total == int(bound + 1e-6)
    assert proved > 30


def test_many_classes_are_proved(spark):
    rows = [(str((x // 40 + (x % m == 0)) % 25), x) for m in (7,) for x in range(1000)]
    of = lambda m: spark.createDataFrame([(str((x // 40 + (x % m == 0)) % 25), x) for x in range(1000)], "class string, element long")
    out = K.best_triplets(K.triple_overlaps(of(7), of(11), of(13))).collect()
    assert len(out) == 25 and sum(r.common for r in out) == out[0].bound and len(rows) == 1000
