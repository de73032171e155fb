"""Periodic runs of words: repetitions found from previous factors, and texts with them collapsed.

A run is a stretch of words with smallest period q and a length of at least
``max(least, ratio * q)`` that no neighbouring word extends.  Documents are packed
into one array of word numbers that differ between documents, so no match leaves
its document, and numpy takes the steps of many documents at once:

1. Suffix array by prefix doubling; only suffixes that are still tied are sorted
   again.  The ranks of every round stay: equal ranks of round k mean equal stretches
   of 2 ** k words, so common extensions in both directions take one lookup a round.
2. Longest previous factors: the nearest entries of the suffix array that start
   earlier, on both sides, and the longer of the two common prefixes.
3. Blocks: each is the longest previous factor at its start, or one new word.
4. Main's extensions around each block boundary for every period that a run can have
   there.  A run with ``ratio`` periods that reaches over the boundary of blocks i - 1 and
   i, but not into i + 1, starts less than one period before block i - 1 (else that block
   were longer), so (ratio - 1) * q is less than both sizes together.
5. What lies strictly inside a block repeats what lies inside its earlier occurrence:
   those runs are copied by start, from left to right.

Null text: no words.  Texts without runs come out with single spaces.  Very long texts are
taken whole, alone in their chunk.  Equal texts of equal ids give equal rows; repeated
rows stay; null ids stay null; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, hashes2, mix, prepare, ragged, release, spans

LEAST, RATIO = 6, 4
KIND = "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def numbers(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorting positions and first ranks of words: equal ranks are equal words of one document.

    a, b: two independent hashes of each word.
    """
    with np.errstate(over="ignore"):
        key = mix(a ^ (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if (same & ((b[order[1:]] != b[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]]))).any():  # two words under one hash
        order = np.lexsort((b, a, doc))
        same = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    head = np.concatenate([[True], ~same])
    rank = np.empty(len(a) + 1, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(len(a)), 0))
    rank[-1] = -1
    return order, rank


def doubled(order: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """The ranks of all rounds; those of the last round are the places in the suffix array."""
    levels, n = [rank], len(order)
    at = rank[order]
    size = np.diff(np.append(np.flatnonzero(np.diff(at, prepend=-1)), n))
    left = order[np.repeat(size, size) > 1]
    step = 1
    while len(left):
        own, then = rank[left].astype(np.int64), rank[np.minimum(left + step, n)]
        sort = np.argsort((own << 32) | (then + 1), kind="stable")
        left, own, then = left[sort], own[sort], then[sort]
        place = np.arange(len(left))
        group = np.concatenate([[True], own[1:] != own[:-1]])
        head = group.copy()
        head[1:] |= then[1:] != then[:-1]
        rank = rank.copy()
        rank[left] = own + np.maximum.accumulate(np.where(head, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        levels.append(rank)
        size = np.diff(np.append(np.flatnonzero(head), len(left)))
        left = left[np.repeat(size, size) > 1]
        step *= 2
    return levels


def ahead(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the common stretches that start at i and j (different positions)."""
    out = np.zeros(len(i), np.int64)
    some = np.flatnonzero(levels[0][i] == levels[0][j])
    i, j, got = i[some], j[some], np.zeros(len(some), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        got += (levels[k][i + got] == levels[k][j + got]).astype(np.int64) << k
    out[some] = got
    return out


def behind(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the common stretches that end before i and j."""
    out = np.zeros(len(i), np.int64)
    some = np.flatnonzero((i > 0) & (j > 0) & (levels[0][i - 1] == levels[0][j - 1]))
    i, j, got = i[some], j[some], np.zeros(len(some), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = i - got - (1 << k), j - got - (1 << k)
        got += ((x >= 0) & (y >= 0) & (levels[k][np.maximum(x, 0)] == levels[k][np.maximum(y, 0)])).astype(np.int64) << k
    out[some] = got
    return out


def smaller_before(value: np.ndarray) -> np.ndarray:
    """The nearest earlier place with a smaller value, or -1; chains of places are halved a round."""
    padded = np.append(value, -1)
    at = np.arange(len(value)) - 1
    bad = np.flatnonzero(padded[at] > value)
    while len(bad):
        at[bad] = at[at[bad]]
        bad = bad[padded[at[bad]] > value[bad]]
    return at


def previous_factors(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The longest stretch from each position that also starts earlier, and where."""
    place = levels[-1][:-1]
    n = len(place)
    suffix = np.empty(n, np.int64)
    suffix[place] = np.arange(n)
    up, down = smaller_before(suffix), n - 1 - smaller_before(suffix[::-1])[::-1]
    best, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for near in (up, down):
        found = np.flatnonzero((near >= 0) & (near < n))
        i, j = suffix[found], suffix[near[found]]
        size = ahead(levels, i, j)
        more = size > best[i]
        best[i[more]], source[i[more]] = size[more], j[more]
    return best, source


def block_starts(best: np.ndarray) -> np.ndarray:
    out, i, n, step = [], 0, len(best), np.maximum(best, 1).tolist()
    while i < n:
        out.append(i)
        i += step[i]
    return np.array(out, np.int64)


def boundary_runs(levels: list[np.ndarray], middle: np.ndarray, most: np.ndarray, least: int, ratio: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and smallest periods of the runs that touch a boundary, by periods up to ``most``."""
    n = len(levels[0]) - 1
    m, q = np.repeat(middle, most), ragged(np.ones(len(most), np.int64), most)
    found = []
    for x in (m, m - q):  # a period after the boundary, or before it
        inside = np.flatnonzero((x >= 0) & (x + q <= n))
        x, p = x[inside], q[inside]
        touch = (levels[0][x] == levels[0][x + p]) | ((x > 0) & (levels[0][x - 1] == levels[0][x + p - 1]))
        x, p = x[touch], p[touch]
        start, end = x - behind(levels, x, x + p), x + p + ahead(levels, x, x + p)
        keep = end - start >= np.maximum(least, ratio * p)
        found.append(np.stack([start[keep], end[keep], p[keep]]))
    start, end, p = np.concatenate(found, 1)
    order = np.lexsort((p, end, start))
    start, end, p = start[order], end[order], p[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[first], end[first], p[first]


def copy_runs(own: list[tuple[int, int, int]], blocks: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) of a document, given those at boundaries and its long blocks (start, size, source) in order."""
    own.sort()
    for start, size, source in blocks:
        k = bisect_right(own, (source + 1, 0, 0))
        while k < len(own) and own[k][0] < source + size:
            a, b, q = own[k]
            if b < source + size:
                insort(own, (a + start - source, b + start - source, q))
            k += 1
    return own


def all_runs(a: np.ndarray, b: np.ndarray, counts: np.ndarray, least: int = LEAST, ratio: int = RATIO) -> dict[int, list[tuple[int, int, int]]]:
    """Runs (start, end, period) by document, where there are any; word hashes of ``counts`` words a document."""
    n = len(a)
    if n < least:
        return {}
    doc = np.repeat(np.arange(len(counts)), counts)
    levels = doubled(*numbers(a, b, doc))
    best, source = previous_factors(levels)
    start = block_starts(best)
    size = np.diff(np.append(start, n))
    owner = doc[start]
    inner = np.flatnonzero(owner[1:] == owner[:-1]) + 1  # boundaries between blocks, then the ends of documents
    last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
    middle = np.concatenate([start[inner], start[last] + size[last]])
    most = (np.concatenate([size[inner - 1] + size[inner], size[last]]) - 1) // (ratio - 1)
    x, y, q = boundary_runs(levels, middle, most, least, ratio)
    if not len(x):
        return {}
    out: dict[int, list[tuple[int, int, int]]] = {}
    for d, *run in zip(doc[x].tolist(), x.tolist(), y.tolist(), q.tolist(), strict=True):
        out.setdefault(d, []).append(tuple(run))
    long = np.flatnonzero(size >= least + 2)
    blocks: dict[int, list[tuple[int, int, int]]] = {}
    for k, d in zip(long.tolist(), owner[long].tolist(), strict=True):
        if d in out:
            blocks.setdefault(d, []).append((int(start[k]), int(size[k]), int(source[start[k]])))
    first = np.cumsum(counts) - counts
    for d in out:
        shift = int(first[d])
        out[d] = [(s - shift, e - shift, p) for s, e, p in copy_runs(out[d], blocks.get(d, []))]
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside of what follows the first period of each run."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, end, period in runs:
        change[start + period] += 1
        change[end] -= 1
    return [w for w, gone in zip(words, np.cumsum(change).tolist(), strict=False) if not gone]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, ratio: int = RATIO) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs of every text by start, then period, and the text without their repeats."""
    if ratio < 2 or least < 2:
        raise ValueError("a run has two periods at least")
    prepare(docs.sparkSession)

    def run(batches):
        release()
        for rows, data, offsets in chunks(batches):
            starts, ends, counts = spans(data, offsets)
            found = all_runs(*hashes2(data, starts, ends), counts, least, ratio) if len(starts) else {}
            raw, at, text, own = data.tobytes(), offsets.tolist(), [], []
            for d in range(len(counts)):
                words, mine = raw[at[d] : at[d + 1]].split(), found.get(d, [])
                text.append(b" ".join(collapse(words, mine) if mine else words).decode())
                own.append([{"start": s, "length": e - s, "period": p} for s, e, p in sorted(mine, key=lambda r: (r[0], r[2]))])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(counts, pa.int64()), pa.array(own, pa.list_(_RUN)), pa.array(text)], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, KIND)


def looped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with a repeated tail in the texts whose ids' checksum h is divisible by 10.

    There each word i >= a becomes word a + (i - a) % p of n, with g = floor(h / 10), a = g % n
    and p = 1 + floor((n - a) / (3 + g % 8)).  Null ids count as not divisible.
    """
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    h = F.crc32(F.col(id_col).cast("string"))
    words = F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g = F.floor(h / 10)

    def tail(w):
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n == 0, F.lit("")).otherwise(F.array_join(F.concat(F.slice(w, 1, a), F.slice(again, 1, n - a)), " "))

    edited = F.transform(F.array(words), tail)[0]  # the words are named once by the lambda
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(h % 10 == 0, edited).otherwise(body).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the run of most periods (ties: smallest start, then period) and digests."""
    runs = F.col("runs")
    more = lambda x, y: y["length"] * x["period"] > x["length"] * y["period"]  # noqa: E731 - exact, of two fractions
    best = F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.try_element_at(runs, F.lit(1)), lambda x, y: F.when(more(x, y), y).otherwise(x))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.select("doc_id", "collapsed", F.size(runs).cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), "n_words").select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
