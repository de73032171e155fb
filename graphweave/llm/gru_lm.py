"""Language-model scoring with a gated recurrent network in numpy.

Tokens are lower-cased words and one end per document.  Counts of all training
tokens come first, added up in every task before they are shuffled, and stay in a
table of the shared folder.  The words above a count that at most ``KNOWN`` words
reach are broadcast; all others, in whatever number, meet their counts in a join.
The most frequent words get their own outputs; every other word shares the output
RARE and is told apart by its smoothed count among the rare ones, so the model
gives a proper probability to any text.

The network is a GRU.  Its output softmax is factored into classes of about equal
frequency: class, then word inside the class.  Training is truncated
backpropagation over windows of ``WINDOW`` tokens with the state carried from
window to window; documents stand in lanes one after another.  Tasks train from
common weights on their own documents, and the changes are averaged (rows of a
word by how often each task saw it) in every round.  Each training document gives
its gradients in one of the rounds, by hash, at every size; counts use all of them.
Scoring carries the state through whole documents of any length.

Words are told apart by 64-bit hashes; rows by a number given when they are written.

Null text: empty, the end alone.  Very long texts: hashed piece by piece and scored
whole, with a few bytes a token.  Repeated rows stay and have equal values.  No
training rows: the score is the base score.  Null doc_ids count as training rows
(their remainder is null).  Empty table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, chunks, hashes, parts, prepare, ragged, release, shared_dir, spans, written
from .langid import fold

VOCABULARY, CLASSES, HIDDEN = 2046, 40, 24
KNOWN = 1 << 18
END_HASH = np.uint64(0x5EED0E4D0000_0001)
WINDOW, LANES, SEGMENT = 16, 512, 1024
FLUSH = 1 << 20
LEARN = 1 << 22  # tokens that a task learns from at a time
PIECE = 1 << 20  # bytes of a long text that are hashed at a time


# ---------------------------------------------------------------- counts


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and ends, and the number of tokens per document."""
    if len(offsets) == 2 and len(data) > 2 * PIECE:
        out, at = [], 0
        while at < len(data):  # cut at white space
            to = min(len(data), at + PIECE)
            while to < len(data) and not (gap := SPACE[data[to : to + PIECE]]).any():
                to = min(len(data), to + PIECE)
            to = min(len(data), to + int(gap.argmax())) if to < len(data) else to
            out.append(tokens(data[at:to], np.array([0, to - at]))[0][:-1])
            at = to
        out.append(np.array([END_HASH]))
        h = np.concatenate(out)
        return h, np.array([len(h)])
    data = LOWER[data]
    starts, ends, words = spans(data, offsets)
    return np.insert(hashes(data, starts, ends), np.cumsum(words), END_HASH), words + 1


def added_up(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens and the sums of their numbers."""
    if not held:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    token, back = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
    n = np.zeros(len(token), np.int64)
    np.add.at(n, back, np.concatenate([x[1] for x in held]))
    return token, n


PAIR = np.dtype([("word", "<u8"), ("n", "<i8")])


def count_tokens(docs: DataFrame, slots: int) -> DataFrame:
    """(word, n) of all tokens of ``text``: packed sums by slot of the word, then sums of those."""

    def count(batches):
        release()
        held: list = []
        size = 0

        def flush():
            pair = np.empty(len(held[0][0]), PAIR)
            pair["word"], pair["n"] = held[0]
            slot = (pair["word"] % np.uint64(slots)).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            cut = np.searchsorted(slot[order], np.arange(slots + 1))
            pair, full = pair[order], np.flatnonzero(np.diff(cut))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(full), pa.array([pair[cut[k] : cut[k + 1]].tobytes() for k in full.tolist()], pa.binary())], ["slot", "body"])

        for _, data, offsets in chunks(batches):
            h, _ = tokens(data, offsets)
            held.append(np.unique(h, return_counts=True))
            size += len(held[-1][0])
            if size >= FLUSH:
                held = [added_up(held)]
                size = len(held[0][0])
                if size >= FLUSH // 2:
                    yield flush()
                    size = 0
        if held:
            held = [added_up(held)]
            yield flush()

    def total(batches):
        held: list = []
        size = 0
        for b in batches:
            for body in b.column("body").to_pylist():
                pair = np.frombuffer(body, PAIR)
                held.append((pair["word"], pair["n"]))
                size += len(pair)
                if size >= FLUSH:
                    held = [added_up(held)]
                    size = len(held[0][0]) // 2  # so that few large sums are redone for little
        word, n = added_up(held)
        for k in range(0, len(word), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(word[k : k + (1 << 16)].view(np.int64)), pa.array(n[k : k + (1 << 16)])], ["word", "n"])

    return docs.select("text").mapInArrow(count, "slot long, body binary").repartition(slots, "slot").mapInArrow(total, "word long, n long")


def frequent(counts: DataFrame, most: int) -> list[tuple[int, int]]:
    """The words above the least count that ``most`` words at most reach, found by a histogram of counts."""
    step = F.floor(F.log2(F.col("n")) * 8).cast("int")
    above, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        above += r["count"]
        if above > most:
            break
        least = r["step"]
    return [] if least is None else [(r["word"], r["n"]) for r in counts.where(step >= least).toLocalIterator()]


# ---------------------------------------------------------------- network


class Vocabulary:
    """Own words (END among them) ordered by class; RARE is one more of them."""

    def __init__(self, words: list[tuple[int, int]], total: int, distinct: int):
        top = sorted(words, key=lambda x: (-x[1], x[0]))[:VOCABULARY]
        end = int(np.array(END_HASH).astype(np.uint64).view(np.int64))
        if end not in {w for w, _ in top}:
            top[-1:] = [(end, next((c for w, c in words if w == end), 1))] if len(top) == VOCABULARY else [*top[-1:], (end, 1)]
        self.rare_total = max(0, total - sum(c for _, c in top))
        self.rare_distinct = max(0, distinct - len(top))
        entries = sorted([(c, w) for w, c in top] + [(max(1, self.rare_total), None)], key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        root = np.cumsum(np.sqrt([c for c, _ in entries]))
        self.cls = np.minimum((root * CLASSES / root[-1]).astype(int), CLASSES - 1)
        _, self.cls = np.unique(self.cls, return_inverse=True)
        self.count = np.array([c for c, _ in entries], np.float64)
        self.size = len(entries)
        self.start = np.searchsorted(self.cls, np.arange(self.cls[-1] + 2))
        self.rare = next(k for k, x in enumerate(entries) if x[1] is None)
        self.end = next(k for k, x in enumerate(entries) if x[1] == end)
        self.id_of = {w: k for k, (_, w) in enumerate(entries) if w is not None}


class Table:
    """The broadcast words: output and log10 of count + 0.5 of each, by the top bits of their hashes."""

    def __init__(self, words: list[tuple[int, int]], v: Vocabulary | None):
        keys = np.array([w for w, _ in words], np.int64).view(np.uint64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.uint64(0))
        count = np.array([c for _, c in words], np.float64)[order]
        self.log = np.append(np.log10(count + 0.5), 0.0)
        self.id = np.array([v.id_of.get(words[k][0], v.rare) for k in order.tolist()] + [v.rare], np.int16) if v else np.zeros(1, np.int16)
        self.rare, self.end = (v.rare, v.end) if v else (0, 0)
        self.start = np.searchsorted(self.keys[:-1], np.arange((1 << 20) + 1, dtype=np.uint64) << np.uint64(44)).astype(np.int32)
        self.start[-1] = len(keys)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places in the table; -1 for words outside it."""
        top = (h >> np.uint64(44)).astype(np.int32)
        at, last = self.start[top], self.start[top + 1]
        out = np.where((at < last) & (self.keys[at] == h), at, np.int32(-1))
        left = np.flatnonzero((out < 0) & (at + 1 < last))
        while len(left):
            at[left] += 1
            hit = self.keys[at[left]] == h[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit & (at[left] + 1 < last[left])]
        return out

    def outputs(self, h: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Output numbers; the end has its own even where it isn't among the words."""
        out = np.where(place >= 0, self.id[place], np.int16(self.rare))
        out[h == END_HASH] = self.end
        return out


def first_weights(v: Vocabulary) -> dict[str, np.ndarray]:
    """Small random weights; output biases that give the unigram model."""
    rng = np.random.default_rng(7)
    classes = int(v.cls[-1]) + 1
    f = lambda *s: (rng.standard_normal(s) * 0.15).astype(np.float32)
    mass = np.add.reduceat(v.count, v.start[:-1])
    return {"x": f(v.size, 3 * HIDDEN), "u": f(HIDDEN, 3 * HIDDEN), "c": f(HIDDEN, classes) * 0.3, "cb": np.log(mass / mass.sum()).astype(np.float32), "o": f(v.size, HIDDEN) * 0.3, "ob": np.log(v.count / mass[v.cls]).astype(np.float32)}


def inputs(w: dict, x: np.ndarray) -> np.ndarray:
    """What the inputs x (steps x lanes) add to the gates: (steps, 3 * HIDDEN, lanes)."""
    a = w["x"].take(x.ravel(), axis=0).reshape(*x.shape, 3 * HIDDEN)
    return np.ascontiguousarray(a.transpose(0, 2, 1))


def cell(a: np.ndarray, ut: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step: the new state (HIDDEN x lanes), the gates r and z, the proposal n and what it takes from the state.

    exp may overflow, which gives the limits 0 and 1 of the gates.
    """
    k = HIDDEN
    u = ut @ h
    g = np.exp(-(a[: 2 * k] + u[: 2 * k]))
    g += 1
    np.divide(1, g, out=g)
    r, z = g[:k], g[k:]
    n = np.exp(2 * (a[2 * k :] + r * u[2 * k :]))
    n += 1
    n = 1 - 2 / n
    return n + z * (h - n), r, z, n, u[2 * k :]


def softmax(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x less a constant a row, its exp, the sums of that)."""
    y = x - x.max()
    e = np.exp(y)
    s = e @ np.ones(x.shape[1], x.dtype)
    if not s.min() > 1e-25:  # rows far below the largest value
        y = x - x.max(1, keepdims=True)
        e = np.exp(y)
        s = e.sum(1)
    return y, e, s


def by_class(v: Vocabulary, c: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """The order of tokens by class c, and (first, end) of the tokens and of the words of each class that has several words."""
    order = np.argsort(c.astype(np.uint8 if len(v.start) <= 256 else np.int32), kind="stable")
    cut = np.searchsorted(c[order], np.arange(len(v.start)))
    return order, [(int(cut[k]), int(cut[k + 1]), int(v.start[k]), int(v.start[k + 1])) for k in np.flatnonzero(np.diff(cut)).tolist() if v.start[k + 1] - v.start[k] > 1]


def output_log(w: dict, v: Vocabulary, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log probabilities of tokens y after states h (tokens x HIDDEN): class, then word in its class."""
    c = v.cls[y]
    x, _, s = softmax(h @ w["c"] + w["cb"])
    out = x[np.arange(len(y)), c] - np.log(s)
    order, groups = by_class(v, c)
    h, y, more = h[order], y[order], np.zeros(len(y), out.dtype)
    for i, j, a, b in groups:
        x, _, s = softmax(h[i:j] @ w["o"][a:b].T + w["ob"][a:b])
        more[i:j] = x[np.arange(j - i), y[i:j] - a] - np.log(s)
    out[order] += more
    return out


def lanes(length: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents laid in lanes: (lane, first step) of each and the lanes' lengths, longest first."""
    n = int(min(most, max(1, len(length))))
    heap = [(0, k) for k in range(n)]
    lane, at = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for d in np.argsort(-length, kind="stable").tolist():
        t, k = heapq.heappop(heap)
        lane[d], at[d] = k, t
        heapq.heappush(heap, (t + int(length[d]), k))
    total = np.zeros(n, np.int64)
    for t, k in heap:
        total[k] = t
    order = np.argsort(-total, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return place[lane], at, total[order]


class Grid:
    """Documents in lanes, as slices of steps: what it holds grows with the tokens, not with the longest lane."""

    def __init__(self, y: np.ndarray, length: np.ndarray, most: int, end: int):
        lane, at, self.total = lanes(length, most)
        order = np.lexsort((at, lane))
        first = np.cumsum(length) - length
        self.target = y[ragged(first[order], length[order])]
        self.doc = np.repeat(order.astype(np.int32), length[order])
        self.source = np.empty_like(self.target)
        self.source[1:] = self.target[:-1]
        self.source[(np.cumsum(length[order]) - length[order])[length[order] > 0]] = end
        self.start = np.cumsum(self.total) - self.total
        self.steps = int(self.total[0])

    def slices(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(sources, targets, documents, live) of each ``size`` steps, a column a lane; lanes that have ended are left out."""
        for t in range(0, self.steps, size):
            n = int(np.searchsorted(-self.total, -t, "left"))
            step = np.arange(t, min(self.steps, t + size))[:, None]
            live = step < self.total[None, :n]
            at = np.minimum(self.start[None, :n] + step, len(self.target) - 1)
            yield self.source[at], self.target[at], self.doc[at], live


def score(w: dict, v: Vocabulary, y: np.ndarray, length: np.ndarray, hold: int = 1 << 15) -> np.ndarray:
    """Natural log probability of each document under the network (RARE as one token)."""
    out = np.zeros(len(length))
    if not len(y):
        return out
    most = int(np.clip(len(y) // max(1, int(length.max())) + 1, 64, 1024))
    h = np.zeros((HIDDEN, min(most, len(length))), np.float32)
    ut = np.ascontiguousarray(w["u"].T)
    hs, ys, ds, held = [], [], [], 0

    def close():
        out[:] += np.bincount(np.concatenate(ds), weights=output_log(w, v, np.concatenate([x.T for x in hs]), np.concatenate(ys)), minlength=len(length))
        for x in (hs, ys, ds):
            x.clear()

    with np.errstate(over="ignore"):
        for source, target, doc, live in Grid(y, length, most, v.end).slices(WINDOW):
            a, keep = inputs(w, source), (source != v.end).astype(np.float32)
            for t, n in enumerate(live.sum(1).tolist()):
                h = cell(a[t, :, :n], ut, h[:, :n] * keep[t, :n])[0]
                hs.append(h)
                ys.append(target[t, :n])
                ds.append(doc[t, :n])
                held += n
                if held >= hold:
                    close()
                    held = 0
    if held:
        close()
    return out


def gradients(w: dict, v: Vocabulary, x: np.ndarray, y: np.ndarray, live: np.ndarray, h: np.ndarray, full: int) -> tuple[dict, np.ndarray, float]:
    """Gradients of one window (steps x lanes) by backpropagation, its last state (HIDDEN x lanes) and its loss a token of ``full`` lanes."""
    steps, b = x.shape
    k, kind = HIDDEN, w["u"].dtype
    ut, a, keep = np.ascontiguousarray(w["u"].T), inputs(w, x), (x != v.end).astype(kind)
    past, r, z, n, u, states = (np.empty((steps, k, b), kind) for _ in range(6))
    for t in range(steps):
        past[t] = h * keep[t]
        states[t], r[t], z[t], n[t], u[t] = cell(a[t], ut, past[t])
        h = states[t]
    # class, then word in its class
    flat = np.ascontiguousarray(states.transpose(0, 2, 1)).reshape(-1, k)
    yy, on = y.ravel().astype(np.int64), live.ravel().astype(kind)
    every, c = np.arange(len(yy)), v.cls[yy]
    on_scale = on * kind.type(1 / (steps * full))
    e, d, s = softmax(flat @ w["c"] + w["cb"])
    loss = (e[every, c] - np.log(s)) @ on
    d /= s[:, None]
    d[every, c] -= 1
    d *= on_scale[:, None]
    g = {"c": flat.T @ d, "cb": d.sum(0), "o": np.zeros_like(w["o"]), "ob": np.zeros_like(w["ob"])}
    dh = d @ w["c"].T
    order, groups = by_class(v, c)
    flat, yy, on, on_scale, more = flat[order], yy[order], on[order], on_scale[order], np.zeros_like(flat)
    for i, j, a, e in groups:
        own = flat[i:j]
        lw, dw, s = softmax(own @ w["o"][a:e].T + w["ob"][a:e])
        at = np.arange(j - i), yy[i:j] - a
        loss += (lw[at] - np.log(s)) @ on[i:j]
        dw /= s[:, None]
        dw[at] -= 1
        dw *= on_scale[i:j, None]
        g["o"][a:e] = dw.T @ own
        g["ob"][a:e] = dw.sum(0)
        more[i:j] = dw @ w["o"][a:e]
    dh[order] += more
    dh = np.ascontiguousarray(dh.reshape(steps, b, k).transpose(0, 2, 1))
    # back through the steps
    to_n, to_r, to_z = (1 - z) * (1 - n * n), u * r * (1 - r), (past - n) * z * (1 - z)
    da, du = np.empty((steps, 3 * k, b), kind), np.empty((steps, 3 * k, b), kind)
    back = np.zeros((k, b), kind)
    for t in range(steps - 1, -1, -1):
        e = dh[t] + back
        dn = np.multiply(e, to_n[t], out=da[t, 2 * k :])
        np.multiply(dn, to_r[t], out=da[t, :k])
        np.multiply(e, to_z[t], out=da[t, k : 2 * k])
        du[t, : 2 * k] = da[t, : 2 * k]
        np.multiply(dn, r[t], out=du[t, 2 * k :])
        back = w["u"] @ du[t]
        back += e * z[t]
        back *= keep[t]
    g["u"] = np.matmul(past, du.transpose(0, 2, 1)).sum(0)
    ids = x.ravel()
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) != 0]))
    g["x"] = (ids[order][first], np.add.reduceat(np.ascontiguousarray(da.transpose(0, 2, 1)).reshape(-1, 3 * k)[order], first, axis=0))
    return g, h, float(-loss / (steps * full))


def train(w: dict, v: Vocabulary, y: np.ndarray, length: np.ndarray, rate: float = 0.15, past: dict | None = None) -> dict:
    """Weights after one pass of truncated backpropagation (Adagrad) over documents; ``past`` carries on from earlier ones."""
    w = {k: x.copy() for k, x in w.items()}
    past = {} if past is None else past
    for k, x in w.items():
        past.setdefault(k, np.full_like(x, 1e-3))
    # long documents are cut for training only, so that lanes end together; few lanes for few tokens: enough windows to learn from
    cuts = -(-length // SEGMENT)
    length = np.where(ragged(np.zeros(len(cuts), np.int64), cuts) + 1 < np.repeat(cuts, cuts), SEGMENT, np.repeat(length - (cuts - 1) * SEGMENT, cuts))
    grid = Grid(y, length, int(np.clip(len(y) // (WINDOW * 200), 4, LANES)), v.end)
    lanes_n = len(grid.total)
    h = np.zeros((HIDDEN, lanes_n), np.float32)
    for source, target, _, live in grid.slices(WINDOW):
        with np.errstate(over="ignore"):
            g, h, _ = gradients(w, v, source, target, live, h[:, : source.shape[1]], lanes_n)
        for k, x in g.items():
            if k == "x":
                rows, x = x
                x = np.clip(x, -1, 1)
                past[k][rows] += x * x
                w[k][rows] -= rate * x / np.sqrt(past[k][rows])
            else:
                x = np.clip(x, -1, 1)
                past[k] += x * x
                w[k] -= rate * x / np.sqrt(past[k])
    return w


BLOCK = 64  # rows of a weight matrix that are averaged together


def _rounds(docs: DataFrame, v: Vocabulary, table: Table, rounds: int) -> tuple[dict[str, np.ndarray], int]:
    """The weights, and how many tokens they learned from."""
    spark = docs.sparkSession
    w = first_weights(v)
    names = sorted(w)
    scale, learned = 1 << 20, 0
    for k in range(rounds):
        lo, hi = scale * k // rounds, scale * (k + 1) // rounds
        shared = spark.sparkContext.broadcast((v, w, table))
        place = F.pmod(F.xxhash64(F.lit("gru"), "doc_id", F.octet_length("text")), F.lit(scale))
        picked = docs.where("train").where((place >= lo) & (place < hi))

        def learn(batches, shared=shared):
            release()
            v, w, table = shared.value
            new, past, seen, number = w, {}, np.zeros(v.size), 0
            ys, ns, held = [], [], 0

            def step():
                nonlocal new, number
                y = np.concatenate(ys)
                new = train(new, v, y, np.concatenate(ns), past=past)
                seen[:] += np.bincount(y, minlength=v.size)
                number += len(y)

            for _, data, offsets in chunks(batches):
                h, n = tokens(data, offsets)
                ys.append(table.outputs(h, table.find(h)))
                ns.append(n)
                held += len(h)
                if held >= LEARN:
                    step()
                    ys, ns, held = [], [], 0
            if ys:
                step()
            if not number:
                return
            yield pa.RecordBatch.from_pydict({"name": ["tokens"], "at": [0], "body": [np.array([number], "<f8").tobytes()]})
            seen = seen.astype(np.float32)
            inside = np.add.reduceat(seen, v.start[:-1])[v.cls]
            weight = {"x": seen, "o": inside, "ob": inside}
            for name in names:
                change = (new[name] - w[name]).reshape(len(w[name]), -1)
                own = weight.get(name, np.full(len(change), number, np.float32))
                for a in range(0, len(change), BLOCK):
                    part = np.column_stack([own[a : a + BLOCK], change[a : a + BLOCK] * own[a : a + BLOCK, None]])
                    if own[a : a + BLOCK].any():
                        yield pa.RecordBatch.from_pydict({"name": [name], "at": [a], "body": [part.astype("<f4").tobytes()]})

        def fold_in(batches):
            total: dict = {}
            for b in batches:
                for name, at, body in zip(*(b.column(c).to_pylist() for c in ("name", "at", "body")), strict=True):
                    x = np.frombuffer(body, "<f8" if name == "tokens" else "<f4").astype(np.float64)
                    total[name, at] = total[name, at] + x if (name, at) in total else x
            for (name, at), x in total.items():
                yield pa.RecordBatch.from_pydict({"name": [name], "at": [at], "body": [x.astype("<f8" if name == "tokens" else "<f4").tobytes()]})

        schema = "name string, at long, body binary"
        summed = picked.select("text").mapInArrow(learn, schema).repartition(parts(spark), "name", "at").mapInArrow(fold_in, schema).collect()
        w = {k2: x.copy() for k2, x in w.items()}
        for r in summed:
            if r["name"] == "tokens":
                learned += int(np.frombuffer(r["body"], "<f8")[0])
                continue
            x = w[r["name"]].reshape(len(w[r["name"]]), -1)
            body = np.frombuffer(r["body"], "<f4").reshape(-1, x.shape[1] + 1)
            x[r["at"] : r["at"] + len(body)] += body[:, 1:] / np.maximum(body[:, :1], 1e-9)
        shared.unpersist()
    return w, learned


def _scored(docs: DataFrame, v: Vocabulary | None, w: dict | None, table: Table) -> DataFrame:
    """Per row: its number, tokens, the network's log10; sums of the broadcast words; hashes of the others."""
    shared = docs.sparkSession.sparkContext.broadcast((v, w, table))
    names = ["row", "doc_id", "held_out", "n_tokens", "net", "rare", "own", "seen", "log", "others"]

    def run(batches):
        from pyspark import TaskContext

        release()
        v, w, table = shared.value
        row = TaskContext.get().partitionId() << 36
        own_log = np.zeros(0) if v is None else np.log10(v.count + 0.5)
        held, size = [], 0

        def flush():
            nonlocal row
            ids, ho, n, y, log, seen, number, others = ([x[k] for x in held] for k in range(8))
            n = np.concatenate(n)
            net, rare, own = np.zeros(len(n)), np.zeros(len(n), np.int64), np.zeros(len(n))
            if v is not None:
                y = np.concatenate(y)
                at = np.cumsum(n) - n
                is_rare = y == v.rare
                rare = np.add.reduceat(is_rare.astype(np.int64), at)
                own = np.add.reduceat(np.where(is_rare, 0, own_log[y]), at)
                net = score(w, v, y, n) / np.log(10)
            edge = np.concatenate([[0], np.cumsum(np.concatenate(number))])
            lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(np.concatenate(others).view(np.int64)))
            rows = np.arange(row, row + len(n))
            row += len(n)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows), pa.concat_arrays(ids), pa.concat_arrays(ho), pa.array(n), pa.array(net), pa.array(rare), pa.array(own), pa.array(np.concatenate(seen)), pa.array(np.concatenate(log)), lists], names)

        for rows, data, offsets in chunks(batches):
            h, n = tokens(data, offsets)
            place = table.find(h)
            at = np.cumsum(n) - n
            known = place >= 0
            seen = np.add.reduceat(known.astype(np.int64), at)
            log = np.add.reduceat(np.where(known, table.log[place], 0.0), at)
            held.append((rows.column("doc_id"), rows.column("held_out"), n, table.outputs(h, place), log, seen, n - seen, h[~known]))
            size += len(h)
            if size >= 1 << 21:
                yield flush()
                size = 0
        if held:
            yield flush()

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, net double, rare long, own double, seen long, log double, others array<long>")


def score_documents(docs: DataFrame, folds: int = 5, held: int = 1, rounds: int = 3) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    spark = prepare(docs.sparkSession)
    n = parts(spark)
    held_out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", "text", held_out.alias("held_out"), (~held_out).alias("train"))
    counts = written(count_tokens(docs.where("train"), n), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    words = frequent(counts, KNOWN)
    v = Vocabulary(words, total["n"], total["v"]) if total["n"] else None
    table = Table(words, v)
    w = _rounds(docs, v, table, rounds)[0] if v else None
    rows = written(_scored(docs, v, w, table), "scored")
    # words outside the table: their counts by a join, summed per row
    others = rows.select("row", F.explode("others").alias("word")).groupBy("row", "word").agg(F.count("*").alias("m"))
    c = F.coalesce("n", F.lit(0))
    sums = others.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("m") * F.log10(c + 0.5)).alias("more"), F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("known"))
    both = rows.drop("others").join(sums, "row", "left")
    logs, big = F.col("log") + F.coalesce("more", F.lit(0.0)), math.log10(total["n"] + 0.5 * (total["v"] + 1))
    base = logs - F.col("n_tokens") * big
    rare_big = math.log10(v.rare_total + 0.5 * (v.rare_distinct + 1)) if v else 0.0
    model = F.col("net") + (logs - F.col("own")) - F.col("rare") * rare_big if v else base
    known = F.col("seen") + F.coalesce("known", F.lit(0))
    return both.select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(int(total["n"])).cast("long").alias("train_tokens"), base.alias("base_score"), model.alias("score"))
