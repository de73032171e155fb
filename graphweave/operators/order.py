"""Order and orientation of a group's members, consensus of orders, and subsequences."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .contacts import dealt
from .tables import join_written, written


def combined_length(a: Column, b: Column, how: str = "multiplication") -> Column:
    return {"multiplication": a * b, "sum": a + b, "geometric_mean": F.sqrt(a * b)}[how]


def half_densities(half_edges: DataFrame, contigs: DataFrame, how: str = "multiplication") -> DataFrame:
    """(i, i_end, j, j_end, density): links over the combined lengths of the two halves."""
    side = lambda c, n: contigs.select(F.col("ctg").alias(c), (F.col("len") / 2).alias(n))
    rows = half_edges.join(side("i", "hi"), "i").join(side("j", "hj"), "j")
    return rows.select("i", "i_end", "j", "j_end", (F.col("links") / combined_length(F.col("hi"), F.col("hj"), how)).alias("density"))


def top_densities(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """(n, t): the three largest densities of every end.  edges: a, b, density."""
    ends = dealt(edges.select(F.col("a").alias("n"), "density").union(edges.select("b", "density")), tasks, "n")
    rank = F.row_number().over(W.partitionBy("n").orderBy(F.desc("density")))
    return ends.withColumn("k", rank).where("k <= 3").groupBy("n").agg(F.sort_array(F.collect_list("density"), asc=False).alias("t"))


def edge_confidence(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """Density over the second largest density at either end, itself counted once; 2 where nothing else is there.

    So it is above 1 only for an edge that beats all others at both ends.  Three
    densities per end decide.  edges: a, b, density > 0, of unique pairs.  tasks: how many the edges
    are dealt to; they should be a written table then, as they are read three times.
    """
    top = top_densities(edges, tasks)
    if tasks:
        top = written(top, "top")
    d = F.col("density")

    def others(rows: DataFrame, end: str) -> DataFrame:  # adds the two largest densities there without this edge's own entry
        at = F.array_position("t", d).cast("int")
        rest = F.when(at == 0, F.col("t")).otherwise(F.concat(F.slice("t", 1, at - 1), F.slice("t", at + 1, 3)))
        own = top.select(F.col("n").alias(end), "t")
        found = join_written(rows, own, end, tasks) if tasks else rows.join(own, end)
        return found.select(*rows.columns, F.get(rest, F.lit(0)).alias(f"{end}1"), F.get(rest, F.lit(1)).alias(f"{end}2"))

    rows = others(others(edges, "a"), "b")
    rest = F.sort_array(F.array_compact(F.array("a1", "a2", "b1", "b2")), asc=False)
    first, second = F.get(rest, F.lit(0)), F.coalesce(F.get(rest, F.lit(1)), F.lit(0.0))
    return rows.select("a", "b", "density", F.when(first.isNull() | (first <= 0), 2.0).when(first <= d, d / first).otherwise(d / F.greatest(second, d)).alias("confidence"))


# ------------------------------------------------------------ one group in a task


def _pair_confidence(a: np.ndarray, b: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """The same for pairs of n ends with their densities, each pair once; all others have none."""
    end, own = np.concatenate([a, b]), np.concatenate([d, d])
    by = np.lexsort((-own, end))
    end, own = end[by], own[by]
    start = np.searchsorted(end, np.arange(n))
    rank = np.arange(len(end)) - start[end]
    top = np.zeros((n, 3))
    top[end[rank < 3], rank[rank < 3]] = own[rank < 3]

    def drop(t: np.ndarray) -> np.ndarray:  # without one entry of the pair itself
        return np.where(t[:, :1] == d[:, None], t[:, 1:], np.where(t[:, 1:2] == d[:, None], t[:, [0, 2]], t[:, :2]))

    rest = -np.sort(-np.concatenate([drop(top[a]), drop(top[b])], axis=1), axis=1)
    first, second = rest[:, 0], rest[:, 1]
    return np.where(first <= 0, 2.0, d / np.where(first <= d, np.where(first > 0, first, 1), np.maximum(np.maximum(second, d), 1e-300)))


def _confidence(d: np.ndarray) -> np.ndarray:
    """The same for all pairs of a symmetric density matrix."""
    a, b = np.nonzero(np.triu(d, 1))
    out = np.zeros(d.shape)
    out[a, b] = out[b, a] = _pair_confidence(a, b, d[a, b], len(d))
    return out


def _spanning_paths(n: int, edges: list[tuple[float, int, int]]) -> list[list[int]]:
    """Kruskal over ends 2k and 2k + 1 of path k, the two ends of a path joined first; ends are used once, so trees are paths."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    near: dict[int, int] = {}
    for _, a, b in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        x, y = find(a // 2), find(b // 2)
        if x != y and a not in near and b not in near:
            root[x] = y
            near[a], near[b] = b, a
    out, seen = [], set()
    for start in sorted(e for e in range(2 * n) if e not in near):
        if start // 2 in seen:
            continue
        walk, at = [], start
        while True:
            seen.add(at // 2)
            walk += [at, at ^ 1]
            nxt = near.get(at ^ 1)
            if nxt is None:
                break
            at = nxt
        out.append(walk)
    return out


def order_group(lengths: dict, links: dict[tuple, float], cutoff: float = 1.0, how: str = "multiplication", flank: float = 0) -> list[tuple]:
    """[(contig, + or -)]: paths of contigs grow by edges of the best mutual confidence until one is left.

    links: ((contig, H or T), (contig, H or T)) -> number.  Paths that no edge joins are set
    aside, the shortest first, and appended at the end in reverse.
    """
    names = sorted(lengths)
    at = {(c, e): 2 * k + (e == "T") for k, c in enumerate(names) for e in "HT"}
    pairs = {(min(at[a], at[b]), max(at[a], at[b])): n for (a, b), n in links.items() if a in at and b in at and a[0] != b[0]}
    u, v = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))  # linked pairs alone: most of a large group's have none
    w = np.array(list(pairs.values()), float)
    half = np.repeat([lengths[c] / 2 for c in names], 2)
    paths = [[2 * k, 2 * k + 1] for k in range(len(names))]  # halves in order
    aside: list[list[int]] = []
    while len(paths) > 1:
        ends = []
        for p in paths:  # two endpoints per path: its halves by length
            cum = np.cumsum(half[p])
            cut = 1 + int(np.argmin(np.abs(cum[:-1] - cum[-1] / 2))) if len(p) > 1 else 1
            ends += [p[:cut], p[cut:][::-1]]
        if flank:
            for k, e in enumerate(ends):  # only the outer part counts
                keep, total = [], 0.0
                for x in e:
                    keep.append(x)
                    total += half[x]
                    if total >= flank:
                        break
                ends[k] = keep
        end, size = np.full(len(half), -1), np.zeros(len(ends))
        for k, e in enumerate(ends):
            end[e], size[k] = k, half[e].sum()
        eu, ev = end[u], end[v]
        apart = (eu >= 0) & (ev >= 0) & (eu // 2 != ev // 2)
        key, where = np.unique(np.minimum(eu, ev)[apart] * len(ends) + np.maximum(eu, ev)[apart], return_inverse=True)
        total, a, b = np.bincount(where, w[apart], len(key)), key // len(ends), key % len(ends)
        pair = {"multiplication": size[a] * size[b], "sum": size[a] + size[b], "geometric_mean": np.sqrt(size[a] * size[b])}[how]
        linked = total > 0
        a, b = a[linked], b[linked]
        conf = _pair_confidence(a, b, total[linked] / pair[linked], len(ends))
        if conf.max(initial=0) <= cutoff:
            if len(paths) <= 2:
                break
            paths.sort(key=lambda p: (-half[p].sum(), p))
            aside.append(paths.pop())
            continue
        sure = conf > cutoff
        found = _spanning_paths(len(paths), list(zip(conf[sure], a[sure].tolist(), b[sure].tolist(), strict=True)))
        paths = [[x for e in walk[::2] for x in (paths[e // 2] if e % 2 == 0 else paths[e // 2][::-1])] for walk in found]
        paths.sort(key=lambda p: (-half[p].sum(), p))
    whole = [x for p in [*paths, *reversed(aside)] for x in p]
    return [(names[x // 2], "+" if x % 2 == 0 else "-") for x in whole[::2]]


def fast_order(half_edges: DataFrame, members: DataFrame, cutoff: float = 1.0, how: str = "multiplication", flank: float = 0) -> DataFrame:
    """(grp, pos, ctg, orient): every group ordered in a task of its own.  half_edges: grp, i, i_end, j, j_end, links; members: grp, ctg, len."""
    kind, gkind = dict(members.dtypes)["ctg"], dict(members.dtypes)["grp"]
    rows = members.select("grp", F.col("ctg").alias("i"), F.lit(None).cast("string").alias("i_end"), F.lit(None).cast(kind).alias("j"), F.lit(None).cast("string").alias("j_end"), F.col("len").cast("double").alias("x"))
    rows = rows.union(half_edges.select("grp", "i", "i_end", "j", "j_end", F.col("links").cast("double")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, links = pdf[pdf["i_end"].isna()], pdf[pdf["i_end"].notna()]
        lengths = dict(zip(own["i"], own["x"], strict=True))
        cast = type(next(iter(lengths), 0))
        w = {((cast(a), p), (cast(b), q)): x for a, p, b, q, x in zip(links["i"], links["i_end"], links["j"], links["j_end"], links["x"], strict=True)}
        tour = order_group(lengths, w, cutoff, how, flank) if lengths else []
        return pd.DataFrame([(pdf["grp"].iloc[0], k + 1, c, o) for k, (c, o) in enumerate(tour)], columns=["grp", "pos", "ctg", "orient"])

    return rows.groupBy("grp").applyInPandas(run, f"grp {gkind}, pos int, ctg {kind}, orient string")


# ------------------------------------------------------------ subsequences


def heaviest_increasing(values: list, weights: list) -> tuple[float, list[int]]:
    """Weight and members of the heaviest strictly increasing subsequence (Fenwick tree of prefix maxima: n log n)."""
    rank = sorted(set(values))
    tree: list[tuple[float, int]] = [(0.0, -1)] * (len(rank) + 1)
    best, last = [], []
    for k, (v, w) in enumerate(zip(values, weights, strict=True)):
        r = bisect_left(rank, v)
        top, q = (0.0, -1), r
        while q > 0:
            top = max(top, tree[q], key=lambda t: t[0])
            q &= q - 1
        best.append(top[0] + w)
        last.append(top[1])
        q = r + 1
        while q <= len(rank):
            if best[k] > tree[q][0]:
                tree[q] = (best[k], k)
            q += q & -q
    if not best:
        return 0.0, []
    at = max(range(len(best)), key=lambda k: (best[k], -k))
    total, out = best[at], []
    while at >= 0:
        out.append(at)
        at = last[at]
    return total, out[::-1]


def heaviest_share(order: list, weights: dict) -> float:
    """Largest share of weight in order or in reverse, over all rotations."""
    total = sum(weights[x] for x in order) or 1.0
    place = {x: k for k, x in enumerate(sorted(order))}
    best = 0.0
    for r in range(len(order)):
        turned = order[r:] + order[:r]
        for own in (turned, turned[::-1]):
            best = max(best, heaviest_increasing([place[x] for x in own], [weights[x] for x in own])[0] / total)
        if best >= 0.9:
            break
    return best


def increasing_weights(rows: DataFrame, key: str, position: str, value: str, weight: str) -> DataFrame:
    """(key, weight): the heaviest increasing subsequence of each group, by position.

    Groups stand one after another in sorted partitions, so one Python call serves many.
    """
    kind = dict(rows.dtypes)[key]
    one, schema = [key, position, value, weight], f"{key} {kind}, lis_weight double"

    def run(batches):
        held: list = []  # the last group, which may go on in the next batch
        for pdf in batches:
            keys, own = pdf[key].tolist(), list(zip(pdf[value].tolist(), pdf[weight].tolist(), strict=True))
            out, start = [], 0
            for k in range(1, len(keys) + 1):
                if k < len(keys) and keys[k] == keys[start]:
                    continue
                if held and held[0] != keys[start]:
                    out.append(close(held))
                    held = []
                held = [keys[start], (held[1] if held else []) + own[start:k]]
                start = k
            if out:
                yield pd.DataFrame(out, columns=[key, "lis_weight"])
        if held:
            yield pd.DataFrame([close(held)], columns=[key, "lis_weight"])

    def close(held):
        return held[0], float(heaviest_increasing([v for v, _ in held[1]], [w for _, w in held[1]])[0])

    return rows.select(*one).repartition(key).sortWithinPartitions(key, position).mapInPandas(run, schema)


def choose_order(fast: list, other: list, lengths: dict, skew: float = 50, agree: float = 0.9) -> str:
    """``other`` where lengths are very uneven or both orders agree; else ``fast``."""
    total, longest = sum(lengths.values()), max(lengths.values())
    if longest and total / longest > skew:
        return "other"
    place = {c: k for k, c in enumerate(other)}
    order = [place[c] for c in fast if c in place]
    weight = {place[c]: lengths[c] for c in fast if c in place}
    return "other" if heaviest_share(order, weight) >= agree else "fast"


def tour_edges(tours: DataFrame) -> DataFrame:
    """(grp, tour, a, b): signed neighbours in order.  tours: grp, tour, pos, ctg, orient."""
    w = W.partitionBy("grp", "tour").orderBy("pos")
    sign = F.concat(F.col("ctg").cast("string"), F.col("orient"))
    return tours.select("grp", "tour", sign.alias("a"), F.lead(sign).over(w).alias("b")).where("b is not null")


def edge_support(tours: DataFrame) -> DataFrame:
    """(grp, a, b, support): in how many tours two signed members follow each other."""
    return tour_edges(tours).groupBy("grp", "a", "b").agg(F.countDistinct("tour").alias("support"))


def inversions(values: np.ndarray) -> int:
    """Pairs whose earlier value is the larger one, bit by bit of the ranks: n log n."""
    n = len(values)
    rank = np.empty(n, np.int64)
    rank[np.argsort(values, kind="stable")] = np.arange(n)
    total = 0
    for bit in range(max(n - 1, 0).bit_length() - 1, -1, -1):
        # ranks that agree in all higher bits stand together, in their first order
        one = (rank >> bit & 1).astype(np.int64)
        head = np.flatnonzero(np.diff(rank >> (bit + 1), prepend=-1))
        ones = np.cumsum(one) - one
        before = ones - np.repeat(ones[head], np.diff(np.append(head, n)))
        total += int(before[one == 0].sum())
        rank = rank[np.argsort(rank >> bit, kind="stable")]
    return total


def similarity_to_base(tours: DataFrame, base: DataFrame) -> DataFrame:
    """(grp, tour, forward, backward): shares of common pairs in the base's order and against it.

    Each tour is read in the base's order from a sorted partition and its inversions are counted;
    pairs are never listed.
    """
    both = tours.select("grp", "tour", "ctg", "pos").join(base.select("grp", "ctg", F.col("pos").alias("at")), ["grp", "ctg"])
    kinds = dict(both.dtypes)

    def shares(at: np.ndarray, pos: np.ndarray) -> tuple[float, float] | None:
        tied = lambda *x: sum(int(c) * (int(c) - 1) // 2 for c in np.unique(np.stack(x), axis=1, return_counts=True)[1])
        total = len(at) * (len(at) - 1) // 2 - tied(at)
        back = inversions(pos)
        return ((total - back - tied(pos) + tied(at, pos)) / total, back / total) if total else None

    def run(batches: Iterator[pa.RecordBatch]):
        key, held = None, []
        for batch in batches:
            grp, tour = batch["grp"].to_pylist(), batch["tour"].to_pylist()
            at, pos = (batch[c].to_numpy(zero_copy_only=False) for c in ("at", "pos"))
            cut = [k for k in range(1, len(grp)) if grp[k] != grp[k - 1] or tour[k] != tour[k - 1]]
            out = []
            for a, b in zip([0, *cut], [*cut, len(grp)], strict=True):
                if a == b:
                    continue
                if key is not None and key != (grp[a], tour[a]):
                    out.append((key, shares(*map(np.concatenate, zip(*held, strict=True)))))
                    held = []
                key = (grp[a], tour[a])
                held.append((at[a:b], pos[a:b]))
            types = [batch.schema.field(c).type for c in ("grp", "tour")]
            if rows := [(*k, *v) for k, v in out if v]:
                yield as_batch(rows, types)
        if key is not None and (v := shares(*map(np.concatenate, zip(*held, strict=True)))):
            yield as_batch([(*key, *v)], types)

    def as_batch(rows: list, types: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*types, pa.float64(), pa.float64()], strict=True)], ["grp", "tour", "forward", "backward"])

    dealt = both.select("grp", "tour", "at", "pos").repartition("grp", "tour").sortWithinPartitions("grp", "tour", "at", "pos")
    return dealt.mapInArrow(run, f"grp {kinds['grp']}, tour {kinds['tour']}, forward double, backward double")


def align_to_base(tours: DataFrame, base: DataFrame) -> DataFrame:
    """Tours that agree better backwards are turned round, signs flipped; adds ``similarity``."""
    sim = similarity_to_base(tours, base)
    n = tours.groupBy("grp", "tour").agg(F.max("pos").alias("n"))
    nb = base.groupBy("grp").agg(F.count("*").alias("nb"))
    common = tours.join(base.select("grp", "ctg"), ["grp", "ctg"], "left_semi").groupBy("grp", "tour").agg(F.count("*").alias("common"))
    rows = tours.join(n, ["grp", "tour"]).join(nb, "grp").join(common, ["grp", "tour"], "left").join(sim, ["grp", "tour"], "left")
    turn = F.coalesce(F.col("backward") > F.col("forward"), F.lit(False))
    alone = F.coalesce("common", F.lit(0)) / F.greatest("n", "nb")
    return rows.select("grp", "tour", F.when(turn, F.col("n") + 1 - F.col("pos")).otherwise(F.col("pos")).alias("pos"), "ctg", F.when(turn, F.translate("orient", "+-", "-+")).otherwise(F.col("orient")).alias("orient"), F.coalesce(F.greatest("forward", "backward"), alone).alias("similarity"), (F.coalesce("common", F.lit(0)) / F.col("nb")).alias("coverage"))


def tour_scores(aligned: DataFrame) -> DataFrame:
    """(grp, tour, support, coverage, similarity): mean support of a tour's edges over all tours."""
    support = edge_support(aligned)
    mean = tour_edges(aligned).join(support, ["grp", "a", "b"]).groupBy("grp", "tour").agg(F.avg("support").alias("support"))
    own = aligned.groupBy("grp", "tour").agg(F.max("coverage").alias("coverage"), F.max("similarity").alias("similarity"))
    return own.join(mean, ["grp", "tour"], "left").withColumn("support", F.coalesce("support", F.lit(0.0)))


def best_tours(tours: DataFrame, base: DataFrame) -> DataFrame:
    """(grp, tour, ...): the tour of the best mean support, then coverage, then similarity, then the least name."""
    w = W.partitionBy("grp").orderBy(F.desc(F.round("support", 9)), F.desc(F.round("coverage", 9)), F.desc(F.round("similarity", 9)), "tour")
    return tour_scores(align_to_base(tours, base)).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
