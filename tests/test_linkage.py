"""Average linkage in rounds against one merge at a time."""

import random

import numpy as np
import pytest

from graphweave.operators import linkage as H


@pytest.fixture(autouse=True)
def folder(spark, tmp_path_factory):
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir("file://" + str(tmp_path_factory.mktemp("checkpoints")))


def average_linkage(distance, groups):
    """Merges the nearest clusters (average distance, least indices on a tie) until ``groups`` are left."""
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, members, alive = np.ones(len(d)), [[k] for k in range(len(d))], np.ones(len(d), bool)
    while alive.sum() > groups:
        i, j = sorted(divmod(int(np.argmin(np.where(alive[:, None] & alive[None, :], d, np.inf))), len(d)))
        d[i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[:, i] = d[i]
        d[i, i] = np.inf
        size[i] += size[j]
        members[i] += members[j]
        alive[j] = False
    return sorted(sorted(members[k]) for k in np.flatnonzero(alive))


def found(spark, w, groups):
    n = len(w)
    rows = [(f"g{i:02}", f"g{j:02}", float(w[i, j])) for i in range(n) for j in range(i) if w[i, j]]
    density = spark.createDataFrame(rows, "g string, h string, density double")
    names = spark.createDataFrame([(f"g{k:02}",) for k in range(n)], "grp string")
    out: dict = {}
    for r in H.merge_groups(density, names, groups).collect():
        out.setdefault(r.merged, []).append(int(r.grp[1:]))
    assert all(int(k[1:]) == min(v) for k, v in out.items())
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("n,share,groups", [(12, 1.0, 3), (20, 0.4, 5), (15, 0.08, 2)])
def test_rounds_equal_single_merges(spark, n, share, groups):
    """Dense, sparse, and with more parts than groups."""
    rng = random.Random(n)
    w = np.zeros((n, n))
    for i in range(n):
        for j in range(i):
            if rng.random() < share:
                w[i, j] = w[j, i] = rng.random()
    assert found(spark, w, groups) == average_linkage(w.max() - w, groups)


def test_known_and_empty_cases(spark):
    d = np.array([[0, 1, 5, 6], [1, 0, 5, 7], [5, 5, 0, 2], [6, 7, 2, 0]], float)
    assert average_linkage(d, 2) == [[0, 1], [2, 3]] == found(spark, (8 - d) * (1 - np.eye(4)), 2)
    assert found(spark, np.zeros((3, 3)), 3) == [[0], [1], [2]]
