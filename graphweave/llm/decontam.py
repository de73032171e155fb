"""Benchmark decontamination by latent semantic retrieval.

Texts are lower-cased; words are runs of ASCII letters, digits and non-ASCII bytes, so marks
between them don't matter.  A passage is a window of 32 words; windows start every
16 words and cover every document whole.

1. One pass turns every document into numbers of benchmark words (all other words
   are one number) and writes them to the shared folder.  With it each task counts
   in how many blocks of 16 words a benchmark word occurs (inverse document
   frequency) and adds up T'(T W) for the passages' term counts T and a random W.
   As the TF-IDF matrix is T times the diagonal of the frequencies, this sum is all
   that a distributed randomised SVD of TF-IDF passages needs: the Nystrom formula
   turns it into leading right singular vectors and values, without another pass.
2. The second pass projects passages and items into that space, components divided
   by the squares of their singular values, so that what all texts of a language
   share counts least.  Pairs whose cosine reaches ``cosine`` are candidates.
3. Of these, pairs whose shared words carry too little weight for the thresholds
   leave; for the rest the longest common subsequence (bit-parallel) of the item and
   stretches of the document about as long as the item decides: a leak keeps
   ``lcs_share`` of the item's words in order, or ``lcs_answer`` of them and
   ``answer`` of its answer (the last sentence).

The benchmark is the query set.  It is taken in slices of ``SLICE`` items, so what
is broadcast is bounded; more items mean more passes.

Null or wordless text: no leak.  Very long texts: searched whole.  Repeated rows: each
reported.  Repeated items: each reported.  Of equally good stretches the first counts.
Items without words match nothing.  Empty tables give no rows.  Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Slots, chunks, hashes, parts, prepare, ragged, release, shared_dir

WINDOW, STRIDE = 32, 16
RANK, OVERSAMPLE = 48, 8
SLICE = 4096
CHUNK = 1 << 20

#: Bytes inside words: ASCII letters and digits and everything that isn't ASCII.
INSIDE = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
SENTENCE = re.compile(rb"[.!?\n]+")


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    word = INSIDE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last[:-1] &= ~word[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.diff(np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[data]
    starts, ends, number = word_spans(data, offsets)
    return hashes(data, starts, ends), number


class Items:
    """Benchmark items as word numbers; word number ``size`` stands for all other words."""

    def __init__(self, rows: list[tuple[int, str]]):
        texts = [(i, (t or "").encode()) for i, t in rows]
        raw = b"".join(t for _, t in texts)
        offsets = np.cumsum([0, *[len(t) for _, t in texts]])
        h, number = word_hashes(np.frombuffer(raw, np.uint8), offsets)
        self.keys, back = np.unique(h, return_inverse=True)
        cut = np.cumsum([0, *number])
        keep = [k for k in range(len(texts)) if number[k]]
        self.ids = [texts[k][0] for k in keep]
        self.words = [back[cut[k] : cut[k + 1]] for k in keep]
        self.size = len(self.keys)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.masks, self.answer_masks, self.answers = [], [], []
        for k, own in zip(keep, self.words, strict=True):
            last = [s for s in SENTENCE.split(texts[k][1]) if INSIDE[np.frombuffer(s, np.uint8)].any()][-1:]
            n = min(len(own), int(word_spans(np.frombuffer(last[0], np.uint8), np.array([0, len(last[0])]))[2][0])) if last else len(own)
            if n == len(own) and len(own) > 2:  # one sentence: its last third
                n = -(-len(own) // 3)
            self.answers.append(n)
            self.masks.append(bits(own))
            self.answer_masks.append(bits(own[len(own) - n :]))

    def look(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.size, np.int32)
        if self.size:
            maybe = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.keys, h[maybe]), self.size - 1)
            hit = self.keys[k] == h[maybe]
            out[maybe[hit]] = k[hit]
        return out


def bits(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << k
    return out


def lcs(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence, one bit a word of the item."""
    full = (1 << n) - 1
    s = full
    for w in words:
        m = masks.get(w)
        if m:
            u = s & m
            s = (s + u | s - u) & full
    return n - s.bit_count()


def blocks(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of each block of STRIDE words; a document's blocks follow each other."""
    count = -(-number // STRIDE)
    first = np.cumsum(number) - number
    own = np.repeat(np.arange(len(number)), count)
    k = ragged(np.zeros(len(count), np.int64), count)
    start = first[own] + k * STRIDE
    return start, np.minimum(STRIDE, first[own] + number[own] - start), own


def paired(x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Sums of each block and the next one of the same document: the windows."""
    out = x.copy()
    same = own[1:] == own[:-1]
    out[:-1][same] += x[1:][same]
    return out


def block_sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, start, axis=0) if len(start) else np.zeros((0, *values.shape[1:]), values.dtype)


def hits_of(word: np.ndarray, length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    hit = np.flatnonzero(word < size)
    return hit, np.repeat(np.arange(len(length)), length)[hit]


def sparse_rows(word: np.ndarray, length: np.ndarray, size: int, table: np.ndarray) -> np.ndarray:
    """Per block, the sum of the table's rows of its benchmark words."""
    hit, block = hits_of(word, length, size)
    out = np.zeros((len(length), table.shape[1]), np.float32)
    if len(hit):
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        out[block[first]] = np.add.reduceat(table[word[hit]], first, axis=0)
    return out


PART = 8192


def survey(docs: DataFrame, items: Items, place: str, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """Write the documents as word numbers; (idf, basis): the last idf is that of a word seen nowhere,
    the basis has the leading right singular vectors over the squares of their values."""
    spark = docs.sparkSession
    size = items.size
    k = min(rank + OVERSAMPLE, size)
    random = np.random.default_rng(11).standard_normal((size, k)).astype(np.float32)
    shared = spark.sparkContext.broadcast((items, random))

    def run(batches):
        release()
        items, random = shared.value
        size = items.size
        kind = np.uint16 if size < 1 << 16 else np.uint32
        df, total, n = np.zeros(size), np.zeros(random.shape), 0
        for rows, data, offsets in chunks(batches, CHUNK):
            h, number = word_hashes(data, offsets)
            word = items.look(h)
            start, length, own = blocks(number)
            n += len(start)
            hit, block = hits_of(word, length, size)
            if len(hit):
                order = np.argsort(word[hit].astype(kind), kind="stable")
                by, at = word[hit][order], block[order]
                first = np.concatenate([[True], by[1:] != by[:-1]])
                df += np.bincount(by[first | np.concatenate([[True], at[1:] != at[:-1]])], minlength=size)
                z = paired(sparse_rows(word, length, size, random), own)
                # a block's words stand in its own window and in the one before
                spread = z.copy()
                same = own[1:] == own[:-1]
                spread[1:][same] += z[:-1][same]
                first = np.flatnonzero(first)
                total[by[first]] += np.add.reduceat(spread[at], first, axis=0)
            body = word.astype(kind)
            cut = np.concatenate([[0], np.cumsum(number)]).tolist()
            full = np.flatnonzero(number)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(full), pa.int64()), rows.column("doc_id").take(pa.array(full)), pa.array([body[cut[d] : cut[d + 1]].tobytes() for d in full.tolist()], pa.binary())], ["part", "doc_id", "body"])
        if n:
            flat = np.concatenate([[n], df, total.ravel()])
            for k in range(0, len(flat), PART):
                yield pa.RecordBatch.from_arrays([pa.array([k // PART]), pa.nulls(1, pa.int64()), pa.array([flat[k : k + PART].tobytes()], pa.binary())], ["part", "doc_id", "body"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, body in zip(b.column("part").to_pylist(), b.column("body").to_pylist(), strict=True):
                x = np.frombuffer(body, np.float64)
                total[k] = total[k] + x if k in total else x
        for k, x in total.items():
            yield pa.RecordBatch.from_pydict({"part": [k], "body": [x.tobytes()]})

    docs.select("doc_id", "text").mapInArrow(run, "part long, doc_id long, body binary").write.parquet(place)
    sums = spark.read.parquet(place).where("part is not null").select("part", "body").repartition(parts(spark), "part").mapInArrow(add, "part long, body binary").collect()
    if not sums:
        return np.zeros(size + 1, np.float32), np.zeros((size, 0), np.float32)
    flat = np.concatenate([np.frombuffer(r["body"], np.float64) for r in sorted(sums, key=lambda r: r["part"])])
    n, df, y = flat[0], flat[1 : size + 1], flat[size + 1 :].reshape(size, k)
    idf = np.log((n + 1) / (np.append(df, 0) + 1)) + 1e-3
    # A = T D: A'A W' with W' = W / D is D times the sum
    y, w = y * idf[:-1, None], random / idf[:-1, None]
    y = y + 1e-7 * max(1e-12, float(np.linalg.norm(y))) * w
    core = w.T @ y
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > 1e-10 * max(1e-12, value[-1])
    basis, sizes, _ = np.linalg.svd((y @ vector[:, good]) / np.sqrt(value[good]), full_matrices=False)
    keep = min(rank, int((sizes > 1e-6 * sizes[:1]).sum()))
    return idf.astype(np.float32), (basis[:, :keep] / (sizes[:keep] / sizes[0]) ** 2).astype(np.float32)


def _verify(items: Items, j: int, words: np.ndarray, at: int, bound: tuple[int, int], need: dict) -> tuple[float, float, int, int] | None:
    """Best stretch around word ``at`` of a document (words from bound): shares of item and answer in order."""
    n = len(items.words[j])
    size = n + n // 4 + 1
    lo, hi = max(bound[0], at - size), min(bound[1], at + WINDOW + size)
    if lcs(items.masks[j], n, words[lo:hi].tolist()) < need["lcs_answer"] * n:
        return None
    best = None
    for s in range(lo, max(lo + 1, hi - size + max(1, n // 4) + 1), max(1, n // 4)):
        own = words[s : min(hi, s + size)].tolist()
        share = lcs(items.masks[j], n, own) / n
        if share < need["lcs_answer"]:
            continue
        m = items.answers[j]
        answer = lcs(items.answer_masks[j], m, own) / m
        if share >= need["lcs"] or answer >= need["answer"]:
            found = (share, answer, s - bound[0], s - bound[0] + len(own))
            if best is None or found[:2] > best[:2]:
                best = found
    return best


def _search(spark, place: str, items: Items, idf: np.ndarray, basis: np.ndarray, cosine: float, need: dict) -> DataFrame:
    n = len(items.ids)
    size = items.size
    vector = np.zeros((n, basis.shape[1]), np.float32)
    least = np.zeros(n, np.float32)
    for j, own in enumerate(items.words):
        vector[j] = (basis[own] * idf[own][:, None]).sum(0)
        # the least weight that a window inside a leak must share: the item's part in a window, kept to the lower threshold
        part = np.sort(idf[own])
        inside = min(len(own), WINDOW)
        least[j] = 0.6 * need["lcs_answer"] * part.sum() * inside / len(own)
    vector /= np.maximum(1e-9, np.linalg.norm(vector, axis=1, keepdims=True))
    # the (item, word) pairs that there are
    pairs = Slots(np.unique(np.concatenate([j * (size + 1) + own.astype(np.int64) for j, own in enumerate(items.words)])))
    shared = spark.sparkContext.broadcast((items, basis * idf[:-1, None], vector, idf, pairs, least))

    def run(batches):
        release()
        items, table, vector, idf, pairs, least = shared.value
        kind = np.uint16 if items.size < 1 << 16 else np.uint32
        for rows, data, offsets in chunks(batches, CHUNK // 2, "body"):
            word = np.frombuffer(data.tobytes(), kind).astype(np.int32)
            number = np.diff(offsets) // np.dtype(kind).itemsize
            start, length, own = blocks(number)
            z = paired(sparse_rows(word, length, items.size, table), own)
            z /= np.maximum(1e-9, np.linalg.norm(z, axis=1, keepdims=True))
            first = np.cumsum(number) - number
            padded = np.append(word, np.full(WINDOW, items.size, word.dtype))
            found: dict[tuple[int, int], tuple] = {}
            tried: dict[tuple[int, int], int] = {}
            for a in range(0, len(start), 4096):
                b, j = np.divmod(np.flatnonzero(z[a : a + 4096] @ vector.T >= cosine), len(vector))
                b += a
                for c in range(0, len(b), 1 << 15):
                    bb, jj = b[c : c + (1 << 15)], j[c : c + (1 << 15)]
                    index = start[bb][:, None] + np.arange(WINDOW)
                    inside = index < (first[own[bb]] + number[own[bb]])[:, None]
                    near = padded[index]
                    own_word = np.flatnonzero((inside & (near < items.size)).ravel())
                    near = near.ravel()[own_word]
                    there = pairs.find(jj[own_word // WINDOW] * np.int64(items.size + 1) + near) < pairs.n
                    share = np.bincount(own_word[there] // WINDOW, weights=idf[near[there]], minlength=len(jj))
                    ok = share >= least[jj]
                    for x, y in zip(bb[ok].tolist(), jj[ok].tolist(), strict=True):
                        d = int(own[x])
                        at = int(start[x])
                        if at < tried.get((d, y), -1):
                            continue  # inside a stretch that has been compared
                        got = _verify(items, y, word, at, (int(first[d]), int(first[d] + number[d])), need)
                        if got:
                            tried[d, y] = at + WINDOW
                            if (d, y) not in found or got[:2] > found[d, y][:2]:
                                found[d, y] = got
            if found:
                ids = rows.column("doc_id").to_pylist()
                keys = sorted(found)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[d] for d, _ in keys], pa.int64()), "item_id": pa.array([items.ids[y] for _, y in keys], pa.int64()), "lcs": [float(found[k][0]) for k in keys], "answer": [float(found[k][1]) for k in keys], "first_word": pa.array([found[k][2] for k in keys], pa.int64()), "end_word": pa.array([found[k][3] for k in keys], pa.int64())})

    words = spark.read.parquet(place).where("part is null").select("doc_id", "body")
    return words.mapInArrow(run, "doc_id long, item_id long, lcs double, answer double, first_word long, end_word long")


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.35, lcs_share: float = 0.75, lcs_answer: float = 0.6, answer: float = 0.75) -> DataFrame:
    """(doc_id, item_id, lcs, answer, first_word, end_word) of every leak."""
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    need = {"lcs": lcs_share, "lcs_answer": lcs_answer, "answer": answer}
    out, held = None, []
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text")).orderBy("item_id", "text").toLocalIterator()

    def search(rows):
        it = Items(rows)
        if not it.size:
            return None
        place = f"{shared_dir(spark)}/passages-{uuid.uuid4().hex}"
        return _search(spark, place, it, *survey(docs, it, place), cosine, need)

    for r in items:
        held.append((r["item_id"], r["text"]))
        if len(held) == SLICE:
            part, held = search(held), []
            out = part if out is None else out if part is None else out.union(part)
    if held:
        part = search(held)
        out = part if out is None else out if part is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, lcs double, answer double, first_word long, end_word long")
