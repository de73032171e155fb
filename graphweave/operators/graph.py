"""Contact graphs as matrices, Markov clustering of small ones, and allele groups.

Matrices are tables (row, col, val).  Small graphs cluster dense in numpy, one task per
grid point; ``blocks`` has the form for large ones and ``clustering`` the whole run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import discard, written

DENSE_NODES = 4000  # a task holds some six such matrices, of 128 MB each


def adjacency(edges: DataFrame, nodes: DataFrame | None = None, loops: float = 1.0) -> DataFrame:
    """Symmetric (row, col, val); a loop on every node, isolated ones included."""
    both = edges.select(F.col("i").alias("row"), F.col("j").alias("col"), F.col("w").cast("double").alias("val"))
    both = both.union(both.select(F.col("col"), F.col("row"), "val"))
    if not loops:
        return both
    own = nodes.select(F.col("ctg").alias("n")) if nodes is not None else both.select(F.col("row").alias("n")).distinct()
    return both.union(own.select(F.col("n"), F.col("n"), F.lit(float(loops))))


def normalise_columns(m: DataFrame) -> DataFrame:
    total = m.groupBy("col").agg(F.sum("val").alias("total"))
    return m.join(total, "col").select("row", "col", (F.col("val") / F.col("total")).alias("val"))


def inflate(m: DataFrame, r: float) -> DataFrame:
    return normalise_columns(m.select("row", "col", F.pow("val", F.lit(float(r))).alias("val")))


def prune(m: DataFrame, threshold: float) -> DataFrame:
    """Small entries leave but for each column's largest."""
    top = m.groupBy("col").agg(F.max("val").alias("top"))
    kept = m.join(top, "col").where((F.col("val") >= threshold) | (F.col("val") == F.col("top"))).select("row", "col", "val")
    return normalise_columns(kept)


def mcl_rounds(a: np.ndarray, inflation: float, expansion: int = 2, rounds: int = 100, threshold: float = 1e-4) -> Iterator[np.ndarray]:
    """The matrix after each round.  a: symmetric weights with loops."""
    m = _normalised(a.astype(float))
    for _ in range(rounds):
        m = refined(_power(m, expansion), inflation, threshold)
        yield m


def refined(m: np.ndarray, inflation: float, threshold: float) -> np.ndarray:
    """Inflated, normalised, pruned but for each column's largest, and normalised again."""
    m = _normalised(m**inflation)
    return _normalised(np.where((m >= threshold) | (m == m.max(0, keepdims=True)), m, 0.0))


def _normalised(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(m.sum(0, keepdims=True), 1e-300)


def _power(m: np.ndarray, exponent: int) -> np.ndarray:
    """Pruned matrices soon have few rows that aren't empty; a product takes only those."""
    rows = np.flatnonzero(m.any(1))
    if 2 * len(rows) > len(m):
        return np.linalg.matrix_power(m, exponent)
    out = np.zeros_like(m)
    out[rows] = np.linalg.matrix_power(m[np.ix_(rows, rows)], exponent - 1) @ m[rows]
    return out


def mcl_dense(a: np.ndarray, inflation: float, expansion: int = 2, rounds: int = 100, threshold: float = 1e-4) -> tuple[np.ndarray, bool]:
    """The limit matrix and whether it settled.  a: symmetric weights with loops."""
    last = None
    for k, m in enumerate(mcl_rounds(a, inflation, expansion, rounds, threshold)):
        if k > 1 and (np.abs(m - last) <= 1e-8 + 1e-5 * np.abs(last)).all():
            return m, True
        last = m
    return last, False


def read_clusters(m: np.ndarray) -> list[list[int]] | None:
    """Columns reached from each attractor; none unless these sets part all nodes."""
    found = {tuple(np.flatnonzero(m[k])) for k in np.flatnonzero(np.diag(m))}
    members = sorted(x for c in found for x in c)
    return sorted(map(list, found)) if members == list(range(len(m))) else None


def majority(fragments: DataFrame) -> DataFrame:
    """(run, ctg, cluster): the cluster that holds most of a contig's fragment length, the least on a tie.

    fragments: run, ctg, cluster, frag_len.
    """
    total = fragments.groupBy("run", "ctg", "cluster").agg(F.sum("frag_len").alias("total"))
    return total.groupBy("run", "ctg").agg(F.max_by("cluster", F.struct("total", -F.col("cluster"))).alias("cluster"))


def main_groups(groups: DataFrame, ratio: float) -> DataFrame:
    """Per run, how many groups stand before the first drop below ``ratio``.  groups: run, cluster, len."""
    w = W.partitionBy("run").orderBy(F.desc("len"), "cluster")
    rows = groups.withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("len").over(w))
    return rows.groupBy("run").agg(F.coalesce(F.min(F.when(F.col("next") / F.col("len") < ratio, F.col("k"))), F.count("*")).cast("long").alias("main"), F.count("*").alias("n_groups"))


#: The drops that are tried in turn.
RATIOS = (0.75, 0.70, 0.65, 0.60, 0.55, 0.50)


def recommend(groups: DataFrame, n_groups: int, ratios: tuple[float, ...] = RATIOS) -> DataFrame:
    """One row: the first ratio at which some run has enough main groups, and the least such run; 0 if none has."""
    found = None
    for k, r in enumerate(ratios):
        part = main_groups(groups, r).where(F.col("main") >= n_groups).select(F.lit(k).alias("k"), F.lit(r).alias("ratio"), "run")
        found = part if found is None else found.union(part)
    best = found.agg(F.min(F.struct("k", "run", "ratio")).alias("b"))
    return best.select(F.coalesce(F.col("b.run").cast("double"), F.lit(0.0)).alias("run"), F.coalesce("b.ratio", F.lit(0.0)).alias("ratio"))


def most_frequent(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The commonest value, the least on a tie."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = W.partitionBy(*keys).orderBy(F.desc("n"), value)
    return counts.withColumn("k", F.row_number().over(w)).where("k = 1").select(*keys, value, "n")


# ------------------------------------------------------------ allelic pairs


SMALL = 16  # groups of up to so many members are matched on lists


def matching(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a maximum-weight assignment (rectangular, padded with zeros; shortest augmenting paths)."""
    n = max(weights.shape)
    if n <= SMALL:
        return _small_matching(weights.tolist(), n)
    cost = np.zeros((n, n))
    cost[: weights.shape[0], : weights.shape[1]] = -weights
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    owner = np.zeros(n + 1, int)
    for r in range(1, n + 1):
        owner[0], free = r, 0
        least, way, done = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while owner[free]:
            done[free] = True
            now = cost[owner[free] - 1] - u[owner[free]] - v[1:]
            better = ~done[1:] & (now < least[1:])
            least[1:][better], way[1:][better] = now[better], free
            k = int(np.argmin(np.where(done[1:], np.inf, least[1:]))) + 1
            step = least[k]
            u[owner[done]] += step
            v[done] -= step
            least[~done] -= step
            free = k
        while free:
            owner[free], free = owner[way[free]], way[free]
    return [(owner[c] - 1, c - 1) for c in range(1, n + 1) if owner[c] <= weights.shape[0] and c <= weights.shape[1]]


def _small_matching(weights: list[list[float]], n: int) -> list[tuple[int, int]]:
    """The same steps on lists, which take a fraction of the time where arrays are a few numbers long."""
    rows, columns = len(weights), len(weights[0])
    cost = [[-x for x in row] + [0.0] * (n - columns) for row in weights] + [[0.0] * n for _ in range(n - rows)]
    u, v, owner = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for r in range(1, n + 1):
        owner[0], free = r, 0
        least, way, done = [float("inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while owner[free]:
            done[free] = True
            line, base, k = cost[owner[free] - 1], u[owner[free]], 0
            for c in range(1, n + 1):
                if not done[c]:
                    now = line[c - 1] - base - v[c]
                    if now < least[c]:
                        least[c], way[c] = now, free
                    if not k or least[c] < least[k]:
                        k = c
            step = least[k]
            for c in range(n + 1):
                if done[c]:
                    u[owner[c]] += step
                    v[c] -= step
                else:
                    least[c] -= step
            free = k
        while free:
            owner[free], free = owner[way[free]], way[free]
    return [(owner[c] - 1, c - 1) for c in range(1, n + 1) if owner[c] <= rows and c <= columns]


def maximal_cliques(links: dict[object, set]) -> list[frozenset]:
    """Bron-Kerbosch with pivots, without recursion."""
    out, stack = [], [(frozenset(), set(links), set())]
    while stack:
        r, p, x = stack.pop()
        if not p and not x:
            out.append(r)
            continue
        pivot = max(sorted(p | x), key=lambda n: len(links[n] & p))
        for n in sorted(p - links[pivot]):
            stack.append((r | {n}, p & links[n], x & links[n]))
            p = p - {n}
            x = x | {n}
    return sorted(out, key=sorted)


def allele_groups(weights: dict[tuple, float], ploidy: int) -> list[frozenset]:
    """Groups of at most ``ploidy`` members: pairs for two; else maximal cliques, the weakest edge of larger ones cut again and again."""
    if ploidy <= 2:
        return sorted({frozenset(p) for p in weights}, key=sorted)
    done, seen, todo = set(), set(), [frozenset(map(frozenset, weights))]
    strength = {frozenset(p): w for p, w in weights.items()}
    while todo:
        edges = todo.pop()
        if edges in seen:
            continue
        seen.add(edges)
        links: dict = {}
        for e in edges:
            a, b = sorted(e)
            links.setdefault(a, set()).add(b)
            links.setdefault(b, set()).add(a)
        for c in maximal_cliques(links):
            if len(c) <= ploidy:
                done.add(c)
            else:
                own = [e for e in edges if e <= c]
                weakest = min(own, key=lambda e: (strength[e], sorted(e)))
                todo.append(frozenset(e for e in own if e != weakest))
    return sorted((c for c in done if not any(c < d for d in done)), key=sorted)


def components_of(pairs: DataFrame) -> DataFrame:
    """(ctg, component) of an edge table (i, j): least-label rounds with pointer jumps, a table each."""
    both = pairs.select(F.col("i").alias("u"), F.col("j").alias("v")).union(pairs.select("j", "i")).distinct().checkpoint()
    label = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    while True:
        near = both.join(label.select(F.col("u").alias("v"), F.col("label").alias("other")), "v").groupBy("u").agg(F.min("other").alias("other"))
        new = label.join(near, "u").select("u", F.least("label", "other").alias("label"))
        new = written(new.join(new.select(F.col("u").alias("label"), F.col("label").alias("up")), "label").select("u", F.col("up").alias("label")), "labels")
        settled = new.join(label, ["u", "label"], "left_anti").isEmpty()
        discard(label)
        label = new
        if settled:
            return label.select(F.col("u").alias("ctg"), F.col("label").alias("component"))


def allelic_groups(pairs: DataFrame, ploidy: int) -> DataFrame:
    """(group, ctg): allele groups of allelic pairs (i, j, w), one task per connected component.

    The pairs are written first: both directions of them, then the groups read them, and they may be much work.
    """
    pairs = written(pairs, "pairs")
    part = components_of(pairs)
    kind = dict(pairs.dtypes)["i"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = allele_groups({(a, b): w for a, b, w in zip(pdf["i"], pdf["j"], pdf["w"], strict=True)}, ploidy)
        return pd.DataFrame([("/".join(map(str, sorted(c))), x) for c in found for x in sorted(c)], columns=["group", "ctg"])

    return pairs.join(part, F.col("i") == F.col("ctg")).select("component", "i", "j", F.col("w").cast("double").alias("w")).groupBy("component").applyInPandas(run, f"group string, ctg {kind}")


def unmatched_edges(edges: DataFrame, groups: DataFrame, tasks: int | None = None) -> DataFrame:
    """(i, j): edges that some pair of allele groups leaves unmatched in its maximum-weight assignment."""
    a = groups.select(F.col("group").alias("ga"), F.col("ctg").alias("i"))
    b = groups.select(F.col("group").alias("gb"), F.col("ctg").alias("j"))
    rows = edges.select("i", "j", F.col("w").cast("double").alias("w")).join(a, "i").join(b, "j").where("ga <> gb")
    swap = F.col("ga") > F.col("gb")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    rows = rows.select(pick("ga", "gb").alias("g"), pick("gb", "ga").alias("h"), pick("i", "j").alias("p"), pick("j", "i").alias("q"), "i", "j", "w")
    kind = dict(edges.dtypes)["i"]

    def close(own: list[tuple]) -> list[tuple]:
        at_p, at_q = ({x: k for k, x in enumerate(sorted({r[side] for r in own}))} for side in (2, 3))
        w = np.zeros((len(at_p), len(at_q)))
        for _, _, x, y, _, _, v in own:
            w[at_p[x], at_q[y]] = v
        kept = set(matching(w))
        return [(i, j) for _, _, x, y, i, j, _ in own if (at_p[x], at_q[y]) not in kept]

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[tuple] = []  # rows of the last pair of groups, which may go on in the next batch
        for batch in batches:
            types = batch.schema.field("i").type, batch.schema.field("j").type
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and row[:2] != held[0][:2]:
                    out += close(held)
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], types[k]) for k in (0, 1)], ["i", "j"])
        if held:
            out = close(held)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], types[k]) for k in (0, 1)], ["i", "j"])

    # pairs of groups stand one after another in sorted partitions, so one Python call serves many
    rows = rows.select("g", "h", "p", "q", "i", "j", "w")
    rows = (rows.repartition(tasks, "g", "h") if tasks else rows.repartition("g", "h")).sortWithinPartitions("g", "h")
    return rows.mapInArrow(run, f"i {kind}, j {kind}").distinct()
