"""Periodic runs, fingerprints and whitening against brute force."""

import collections
import hashlib
import math
import os
import random
import re
import zlib
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
import regex
import xxhash

from graphweave.llm import periodic, queries, spotsigs, whitening

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


# ---------------------------------------------------------------- periodic runs


def slow_runs(w, least=6, ratio=4):
    """All runs by every period and every start."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, ratio * q) and j > i:
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e, q) for (s, e), q in out.items())


def word_hashes(docs):
    flat = np.array([x for w in docs for x in w], np.uint64)
    return flat * np.uint64(7919) + np.uint64(1), flat + np.uint64(5), np.array([len(w) for w in docs])


@pytest.mark.parametrize("least,ratio", [(6, 4), (2, 2), (3, 3)])
def test_runs_of_random_words(least, ratio):
    rng = random.Random(least)
    for _ in range(150):
        docs = []
        for _ in range(rng.randrange(1, 8)):
            k, w = rng.choice([1, 2, 2, 3, 5]), []
            while len(w) < rng.randrange(60):
                w += ([rng.randrange(k) for _ in range(rng.randrange(1, 5))] * rng.randrange(1, 8) + [rng.randrange(k)]) * rng.randrange(1, 5)
            docs.append(w)
        got = periodic.all_runs(*word_hashes(docs), least, ratio)
        assert [sorted(got.get(d, [])) for d in range(len(docs))] == [slow_runs(w, least, ratio) for w in docs]


def test_runs_deep_inside_blocks_and_long_texts():
    rng = random.Random(3)
    unit = [rng.randrange(5, 10**6) for _ in range(40)] + [1, 2] * 5 + [3] * 9 + [4]
    doc = unit + [rng.randrange(10**7, 10**8) for _ in range(50)] + unit * 3 + [0] * 30000
    got = sorted(periodic.all_runs(*word_hashes([doc, unit, []]))[0])
    assert got == sorted(slow_runs(doc[:400])[:-1] + [(len(doc) - 30000, len(doc), 1)])


def test_clashing_hashes_fall_back_on_the_second():
    a = np.zeros(12, np.uint64)
    b = np.array([1, 2] * 6, np.uint64)
    assert periodic.all_runs(a, b, np.array([12])) == {0: [(0, 12, 2)]}
    assert periodic.all_runs(a, np.ones(12, np.uint64), np.array([6, 6])) == {0: [(0, 6, 1)], 1: [(0, 6, 1)]}


def expected_row(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = sorted((s, e - s, q) for s, e, q in slow_runs(w))
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *shown, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


RUN_COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_op11_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op11_periodic_runs(spark, SF).collect()
    assert len(rows) == len(docs) and sum(r.n_runs > 0 for r in rows) > 10
    for r in rows:
        assert tuple(r[c] for c in RUN_COLUMNS) == expected_row(r.doc_id, docs[r.doc_id])


def test_op11_edges(spark, edge_docs, no_docs):
    plain = [(r.doc_id, r.text) for r in edge_docs.collect() if r.text is None or len(r.text) < 20000]
    rows = periodic.digest(periodic.find_runs(periodic.looped(edge_docs))).collect()
    assert len(rows) == edge_docs.count()
    got = collections.Counter((r.doc_id, *(r[c] for c in RUN_COLUMNS)) for r in rows)
    assert not collections.Counter((d, *expected_row(d, t)) for d, t in plain) - got
    assert periodic.digest(periodic.find_runs(periodic.looped(no_docs))).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(edge_docs, ratio=1)


# ---------------------------------------------------------------- fingerprints


def slow_signatures(text, chain=3, reach=9, gap=8):
    listed = set(spotsigs.ANCHORS)
    w = [x for x in regex.split(r"[^\p{L}\p{M}\p{N}]+", (text or "").lower()) if x]
    out = set()
    for i, x in enumerate(w):
        if x in listed or not any(y in listed for y in w[max(0, i - gap) : i]):
            own = [y for y in w[i + 1 : i + 1 + reach] if y not in listed][:chain]
            out.add(xxhash.xxh64(" ".join([x, *own]).encode(), seed=42).intdigest())
    return out or ({xxhash.xxh64(text.encode(), seed=42).intdigest()} if text else set())


def slow_jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def check_prints(rows, docs):
    """rows of the query, docs (doc_id, text) in the order that the query defines."""
    assert len(rows) == len(docs)
    text = [t or "" for _, t in docs]
    got = collections.Counter((r.doc_id, r.n_chars, r.edited_sha256, frozenset(r.fingerprint.split()), frozenset(r.edited_fingerprint.split()), r.near_edited, r.near_next) for r in rows)
    want = collections.Counter()
    for k, (d, _) in enumerate(docs):
        t, after = text[k], text[(k + 1) % len(docs)]
        q = len(t) // 4
        e = t[: len(t) - q] + after[:q]
        a, b, c = slow_signatures(t), slow_signatures(e), slow_signatures(after)
        show = lambda s: frozenset(f"{v:x}" for v in s)
        want[(d, len(t), sha(e), show(a), show(b), slow_jaccard(a, b), slow_jaccard(a, c))] += 1
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_op12_against_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    rows = queries.op12_spotsigs(spark, SF).collect()
    check_prints(rows, docs)
    assert len({r.fingerprint for r in rows}) <= len({t for _, t in docs})
    assert np.median([r.near_edited for r in rows]) > 0.5 and np.median([r.near_next for r in rows]) == 0


def slow_order(rows):
    signed = lambda t: (v := xxhash.xxh64(t.encode(), seed=42).intdigest()) - (v >> 63 << 64)
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, signed(r[1] or ""), r[1] or ""))


def test_op12_edges(spark, edge_docs, no_docs):
    short = edge_docs.where("text is null or length(text) < 20000")
    check_prints(spotsigs.digest(spotsigs.compare_edits(short)).collect(), slow_order([(r.doc_id, r.text) for r in short.collect()]))
    assert spotsigs.digest(spotsigs.compare_edits(edge_docs)).count() == edge_docs.count()
    assert spotsigs.digest(spotsigs.compare_edits(no_docs)).count() == 0
    many = spark.createDataFrame([(None if k % 3 else k, f"The text {k} of this table was it {k * k}") for k in range(300)], "doc_id long, text string")
    for n in (1, 2, 40):
        found = spotsigs.with_next(spotsigs.texts(many), n).collect()
        order = slow_order([(r.doc_id, r.text) for r in many.collect()])
        after = {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}
        assert len(found) == 300 and all(after[r.text] == r.next_text for r in found)
    one = spark.createDataFrame([(5, "abcdefgh the end of it")], "doc_id long, text string")
    assert [r.next_text for r in spotsigs.with_next(spotsigs.texts(one)).collect()] == ["abcdefgh the end of it"]


def test_anchors_fill_stretches_without_common_words():
    assert len(slow_signatures(" ".join(f"w{k}" for k in range(30)))) == 30
    assert len(slow_signatures("the " + " ".join(f"w{k}" for k in range(30)))) == 1 + 22
    assert slow_signatures("") == set() and len(slow_signatures("$$ %%")) == 1


# ---------------------------------------------------------------- whitening


def slow_whitening(vectors):
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    deviation = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]
    v = np.array([[float(Fraction(n * sum(r[i] * r[j] for r in x) - s[i] * s[j], n * n)) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    centred = np.array([[float(Fraction(n * r[j] - s[j], n)) for j in range(d)] for r in x])
    return n, deviation, centred @ u / np.sqrt(np.maximum(e, 1e-300)), e / np.trace(v)


def check_whitening(rows, ids, vectors):
    n, deviation, white, share = slow_whitening(vectors)
    k = white.shape[1]
    assert len(rows) == len(ids) * k
    own = {(r.vec_id, r.component): r for r in rows}
    at = {i: p for p, i in enumerate(ids)}
    for c in range(k):
        got = np.array([own[i, c + 1].whitened for i in ids])
        assert min(np.abs(got - white[:, c]).max(), np.abs(got + white[:, c]).max()) < 1e-7
    for r in rows:
        assert r.n == n and int(r.deviation_wide) == deviation[at[r.vec_id]] and abs(r.explained / share[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
        assert r.deviation == (deviation[at[r.vec_id]] if deviation[at[r.vec_id]] < 2**63 else None)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_op13_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check_whitening(queries.op13_whitening(spark, SF).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_residues_are_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(-(1 << 40), 1 << 40, (500, 3))
    moduli = whitening.primes(2 * 500 * (1 << 80) + 1)
    exact = x.astype(object).T @ x.astype(object)
    split = [whitening.residue_products(x[a:b], moduli) for a, b in ((0, 100), (100, 101), (101, 500))]
    got = whitening.remaindered([sum(s[k] for s in split) for k in range(len(moduli))], moduli)
    assert (got[:3, :3] == exact).all() and (got[3, :3] == x.astype(object).sum(0)).all() and got[3, 3] == 500
    assert all(p % d for p in moduli for d in range(2, 1025)) and math.prod(moduli) > 2 * 500 * (1 << 80)


def test_op13_edges(spark):
    kinds = "vec_id long, embedding array<float>, label int, n string, component string"
    rng = random.Random(2)
    good = [(k, [rng.gauss(0, 1) for _ in range(5)]) for k in range(60)]
    bad = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (104, []), (105, [1.0, 2.0])]
    df = spark.createDataFrame([(k, v, None, "x", "y") for k, v in good + bad], kinds).repartition(3)
    stored = {r.vec_id: r.embedding for r in df.where("vec_id < 100").collect()}
    check_whitening(whitening.whiten(df).collect(), list(stored), list(stored.values()))
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id >= 100 and vec_id < 105")).count() == 0
    # one vector, no variance; null and repeated ids; fewer components than dimensions
    same = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert len(same) == 6 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error == 0 for r in same)
    # one direction only
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0]) for k in range(10)], "vec_id long, embedding array<double>")).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in line) and all(abs(r.explained - 1) < 1e-12 for r in line if r.component == 1)


def test_op13_large_entries(spark):
    rows = [(k, [1e14 * (k % 7), float(k), -3.0 * k * k]) for k in range(40)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=1).collect()
    _, deviation, white, _ = slow_whitening([v for _, v in rows])
    assert all(r.deviation is None and int(r.deviation_wide or 0) == (deviation[r.vec_id] if deviation[r.vec_id] < 10**38 else 0) for r in out)
    assert min(max(abs(r.whitened - s * white[r.vec_id, 0]) for r in out) for s in (1, -1)) < 1e-6
    far = whitening.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>")).collect()
    assert len(far) == 6 and all(r.n == 3 for r in far)
    assert Decimal(0) not in {r.deviation_wide for r in far}
