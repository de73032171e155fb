"""Consensus of many groupings: overlaps, greedy tuples, leftovers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import matching


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_class, b_class, common, jaccard) of classes that share elements: an equi-join on the element.  Inputs: class, element."""
    common = a.select("element", F.col("class").alias("a_class")).join(b.select("element", F.col("class").alias("b_class")), "element").groupBy("a_class", "b_class").agg(F.count("*").alias("common"))
    na = a.groupBy(F.col("class").alias("a_class")).agg(F.count("*").alias("na"))
    nb = b.groupBy(F.col("class").alias("b_class")).agg(F.count("*").alias("nb"))
    return common.join(na, "a_class").join(nb, "b_class").select("a_class", "b_class", "common", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("jaccard"))


def greedy_tuples(methods: dict[str, dict[str, frozenset]], size=len) -> tuple[list[dict], list[tuple]]:
    """Tuples of one class per method, each time that of the largest common set; what is left over, keyed by method and class.

    size: of a set of members.
    """
    names = list(methods)
    free = {m: dict(sorted(methods[m].items())) for m in names}
    out = []
    for _ in range(min(map(len, methods.values()), default=0)):
        best = None
        for first, own in free[names[0]].items():
            chain, common = [first], own
            for m in names[1:]:
                pick = max(free[m], key=lambda c: size(common & free[m][c]), default=None) if free[m] else None
                if pick is None:
                    break
                chain.append(pick)
                common = common & free[m][pick]
            if len(chain) == len(names) and (best is None or size(common) > best[2]):
                best = (chain, common, size(common))
        if best is None:
            break
        sets = [free[m].pop(c) for m, c in zip(names, best[0], strict=True)]
        votes: dict = {}
        for s in sets:
            for x in s:
                votes[x] = votes.get(x, 0) + 1
        out.append({"classes": dict(zip(names, best[0], strict=True)), "strict": set(best[1]), "majority": {x for x, n in votes.items() if 2 * n > len(names)}})
    return out, [(m, c, s) for m in names for c, s in free[m].items()]


def merge_similar(sets: list[frozenset], threshold: float = 0.5, size=len) -> list[frozenset]:
    """The most similar pair becomes its intersection while its Jaccard index reaches the threshold."""
    sets = [s for s in sets if s]
    while len(sets) > 1:
        pairs = [(size(a & b) / size(a | b), -i, -j) for i, a in enumerate(sets) for j, b in enumerate(sets[i + 1 :], i + 1) if a & b]
        if not pairs or max(pairs)[0] < threshold:
            break
        _, i, j = max(pairs)
        both = sets[-i] & sets[-j]
        sets = [s for k, s in enumerate(sets) if k not in (-i, -j)] + [both]
    return sets


def cover(sets: list[frozenset], taken: set, size=len) -> list[frozenset]:
    """By size, what each set has beyond those before it."""
    out, seen = [], set(taken)
    for s in sorted(sets, key=lambda s: (-size(s), sorted(s))):
        if rest := s - seen:
            out.append(frozenset(rest))
            seen |= rest
    return out


def agreed(methods: dict[str, dict[str, frozenset]], threshold: float = 0.5, size=len) -> list[tuple]:
    """(group, member): majority sets of the greedy tuples, then groups of what is left until every member is covered."""
    tuples, left = greedy_tuples(methods, size)
    rows, taken, pool = [], set(), [s for _, _, s in left]
    for k, t in enumerate(tuples):
        own = t["majority"] - taken
        if not own:
            pool += [methods[m][c] for m, c in t["classes"].items()]
        taken |= own
        rows += [(f"g{k:04d}", x) for x in own]
    for k, s in enumerate(cover([*merge_similar(pool, threshold, size), *pool, *[s for m in methods.values() for s in m.values()]], taken, size)):
        rows += [(f"r{k:04d}", x) for x in s]
    return sorted(rows)


def cells(groupings: DataFrame) -> DataFrame:
    """(element, cell): elements that all methods put into the same classes share a cell, named by its least element.

    groupings: method, class, element.
    """
    own = groupings.groupBy("element").agg(F.array_sort(F.collect_set(F.struct("method", "class"))).alias("key"))
    names = own.groupBy("key").agg(F.min("element").alias("cell"))
    return own.join(names, "key").select("element", "cell")


def consensus(groupings: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(grp, element): majority sets of the greedy tuples, then groups of what is left until every element is covered.

    groupings: method, class, element.  Only cells reach the task that decides: one row for each combination of
    classes that occurs, with the number of its elements; the elements are joined back to its result.
    """
    kind = dict(groupings.dtypes)["element"]
    of = cells(groupings).checkpoint()
    size = of.groupBy("cell").agg(F.count("*").alias("n"))
    named = groupings.join(size.select(F.col("cell").alias("element"), "n"), "element").select("method", "class", F.col("element").alias("cell"), "n").distinct()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        methods: dict = {}
        for m, c, x in zip(pdf["method"], pdf["class"], pdf["cell"], strict=True):
            methods.setdefault(m, {}).setdefault(c, set()).add(x)
        methods = {m: {c: frozenset(s) for c, s in methods[m].items()} for m in sorted(methods)}
        weight = dict(zip(pdf["cell"], pdf["n"], strict=True))
        return pd.DataFrame(agreed(methods, threshold, lambda s: sum(weight[x] for x in s)), columns=["grp", "cell"])

    chosen = named.groupBy(F.lit(0).alias("all")).applyInPandas(run, f"grp string, cell {kind}")
    return of.join(chosen, "cell").select("grp", "element")


def majority_elements(groupings: DataFrame, n_methods: int) -> DataFrame:
    """(class, element) where more than half of the methods agree; classes are named alike by all methods."""
    return groupings.groupBy("class", "element").agg(F.countDistinct("method").alias("votes")).where(F.col("votes") * 2 > n_methods)


def triple_overlaps(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    """(a, b, c, common) of classes of three groupings that share elements: equi-joins on the element.  Inputs: class, element."""
    of = lambda x, name: x.select(F.col("class").alias(name), "element").distinct()
    return of(a, "a").join(of(b, "b"), "element").join(of(c, "c"), "element").groupBy("a", "b", "c").agg(F.count("*").alias("common"))


def pick_greedily(rows: list[tuple]) -> list[tuple]:
    """Of (a, b, c, common): the largest first, each class once; ties by name."""
    out, used = [], (set(), set(), set())
    for r in sorted(rows, key=lambda r: (-r[3], r[:3])):
        if not any(x in u for x, u in zip(r, used, strict=False)):
            out.append(r)
            for x, u in zip(r, used, strict=False):
                u.add(x)
    return out


def pick_best(rows: list[tuple]) -> list[tuple]:
    """Of (a, b, c, common): disjoint triplets of the largest total, by branch and bound; ties: the greedy order's first."""
    by: dict = {}
    for r in sorted(rows, key=lambda r: (-r[3], r[:3])):
        by.setdefault(r[0], []).append(r)
    order = sorted(by, key=lambda x: (-by[x][0][3], x))
    rest = [0] * (len(order) + 1)
    for k in range(len(order) - 1, -1, -1):
        rest[k] = rest[k + 1] + by[order[k]][0][3]
    best: list = [sum(r[3] for r in pick_greedily(rows)), pick_greedily(rows)]

    def go(k: int, total: int, chosen: list, b: frozenset, c: frozenset) -> None:
        if total > best[0]:
            best[:] = [total, list(chosen)]
        if k == len(order) or total + rest[k] <= best[0]:
            return
        for r in by[order[k]]:
            if r[1] not in b and r[2] not in c:
                go(k + 1, total + r[3], [*chosen, r], b | {r[1]}, c | {r[2]})
        go(k + 1, total, chosen, b, c)

    go(0, 0, [], frozenset(), frozenset())
    return best[1]


def relaxed(rows: list[tuple], rounds: int = 300) -> tuple[list[tuple], float]:
    """Disjoint triplets of (a, b, c, common), and an upper bound of what any choice can total.

    The rule that each c is used once is priced instead of enforced; what is left is an assignment
    of a to b.  Prices follow the subgradient; each assignment's pairs are then assigned to the
    classes c, which gives a valid choice.  The choice is optimal where it comes within 1 of the bound.
    """
    if not rows:
        return [], 0.0
    names = [sorted({r[k] for r in rows}) for k in range(3)]
    at = [{x: n for n, x in enumerate(own)} for own in names]
    i, j, k = (np.array([at[p][r[p]] for r in rows]) for p in range(3))
    w = np.array([float(r[3]) for r in rows])
    whole = np.zeros([len(own) for own in names])
    whole[i, j, k] = w
    chosen = pick_greedily(rows)
    best, bound, price, pace = float(sum(r[3] for r in chosen)), np.inf, np.zeros(len(names[2])), 1.0
    for n in range(rounds):
        value = np.zeros(whole.shape[:2])
        np.maximum.at(value, (i, j), w - price[k])
        pairs = [(x, y) for x, y in matching(value) if value[x, y] > 0]
        now = sum(value[x, y] for x, y in pairs) + price.sum()
        pace *= 0.9 if now >= bound - 1e-9 and n % 5 == 4 else 1.0
        bound = min(bound, now)
        if pairs:
            own = np.array([whole[x, y] for x, y in pairs])
            kept = [(pairs[p], z) for p, z in matching(own) if own[p, z] > 0]
            total = sum(whole[x, y, z] for (x, y), z in kept)
            if total > best:
                best, chosen = total, [(names[0][x], names[1][y], names[2][z], int(whole[x, y, z])) for (x, y), z in kept]
        if bound < best + 1 - 1e-9:
            break
        used = np.bincount([int(np.argmax(whole[x, y] - price - 1e9 * (whole[x, y] == 0))) for x, y in pairs], minlength=len(price)) if pairs else np.zeros(len(price))
        slope = 1 - used
        slope[(price == 0) & (slope > 0)] = 0
        if not slope.any():
            break
        price = np.maximum(0, price - pace * max(now - best, 1.0) / (slope @ slope) * slope)
    return sorted(chosen), bound


def _picked(triples: DataFrame, pick) -> DataFrame:
    schema = triples.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(*(pdf[x].tolist() for x in ("a", "b", "c", "common")), strict=True))
        return pd.DataFrame(sorted(pick(rows)), columns=["a", "b", "c", "common"])

    return triples.select("a", "b", "c", "common").groupBy(F.lit(0).alias("all")).applyInPandas(run, schema)


def greedy_triplets(triples: DataFrame) -> DataFrame:
    """The greedy choice; the table of triples (of classes, not elements) goes to one task."""
    return _picked(triples, pick_greedily)


def best_triplets(triples: DataFrame, searched: int = 6) -> DataFrame:
    """(a, b, c, common, bound): disjoint triplets of the largest total, and a bound that no choice exceeds.

    The relaxed problem mostly proves its own choice (the whole part of the bound is the total); where it
    doesn't and a grouping has ``searched`` classes at most, branch and bound decides.
    The table of triples of classes goes to one task.
    """
    kinds = ", ".join(f"{c} {k}" for c, k in triples.select("a", "b", "c", "common").dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(*(pdf[x].tolist() for x in ("a", "b", "c", "common")), strict=True))
        chosen, bound = relaxed(rows)
        total = sum(r[3] for r in chosen)
        if bound >= total + 1 and min(len({r[k] for r in rows}) for k in range(3)) <= searched:
            chosen = pick_best(rows)
            bound = sum(r[3] for r in chosen)
        return pd.DataFrame([(*r, int(np.floor(bound + 1e-6))) for r in sorted(chosen)], columns=["a", "b", "c", "common", "bound"])

    return triples.select("a", "b", "c", "common").groupBy(F.lit(0).alias("all")).applyInPandas(run, f"{kinds}, bound long")
