"""Byte-level BPE: boundaries by a transition-function scan, cached pair merging.

Pre-tokenisation works on arrays of code points.  A table gives each code point
its class (letter, number, space, white space, other); a character's symbol also
tells what follows it (a contraction, or the last white space before text).  A
symbol acts on the eight states of a small automaton as a function; the functions
that arise by composition are finitely many (the transition monoid), so a text
becomes an array of monoid elements and the states before all characters come
from a prefix scan with the associative product of the monoid: in blocks side by
side, then over the blocks' totals.  No regular expression is run.

The slices between boundaries go, by two hashes of their bytes, through a cache; new
slices are merged together, one lowest-ranked pair a slice and round, in numpy.
Token starts are kept as byte offsets; decoding joins the tokens' bytes.

Null text counts as empty: no tokens.  Very long texts are encoded whole, alone in
their chunk.  Repeated rows stay, null ids too; empty tables give no rows; columns
other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, chunks, kept, mix, prepare, ragged

# symbols
LETTER, NUMBER, OTHER, GAP, LAST_SPACE, LAST_WHITE, MARK2, MARK3, END = range(9)
# states: after a boundary-making end, inside white space, after a space that joins what follows,
# in letters, in numbers, in others, with one and with two characters of a contraction to come
FRESH, WHITE, JOIN, LETTERS, NUMBERS, OTHERS, ONE, TWO = range(8)
SEPARATOR = 0x110000
_LETTER, _NUMBER, _OTHER, _WHITE, _SPACE, _END = range(6)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point by its general category; white space by the White_Space property."""
    table = np.full(SEPARATOR + 1, _OTHER, np.uint8)
    kind = {"L": _LETTER, "N": _NUMBER}
    for c in range(SEPARATOR):
        k = kind.get(unicodedata.category(chr(c))[0])
        if k is not None:
            table[c] = k
        elif chr(c).isspace() and not 0x1C <= c <= 0x1F:
            table[c] = _WHITE
    table[32], table[SEPARATOR] = _SPACE, _END
    return table


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a character and whether a token starts at it."""
    if symbol == END:
        return FRESH, False
    if symbol == GAP:
        return WHITE, state != WHITE
    if symbol in (LAST_SPACE, LAST_WHITE):
        return (JOIN if symbol == LAST_SPACE else FRESH), True
    if symbol == LETTER:
        if state in (ONE, TWO):
            return (FRESH if state == ONE else ONE), False
        return LETTERS, state not in (LETTERS, JOIN)
    if symbol == NUMBER:
        return NUMBERS, state not in (NUMBERS, JOIN)
    if symbol in (MARK2, MARK3) and state not in (OTHERS, JOIN):
        return (ONE if symbol == MARK2 else TWO), True
    return OTHERS, state not in (OTHERS, JOIN)


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each symbol, product table, action on states, boundary by state and symbol)."""
    gens = [tuple(step(s, x)[0] for s in range(8)) for x in range(9)]
    found = {tuple(range(8)): 0}
    queue = list(found)
    for f in queue:
        for g in gens:
            h = tuple(g[y] for y in f)
            if h not in found:
                found[h] = len(found)
                queue.append(h)
    act = np.array(queue, np.uint8)
    product = np.array([[found[tuple(b[y] for y in a)] for b in queue] for a in queue], np.uint16)
    starts = np.array([[step(s, x)[1] for x in range(9)] for s in range(8)])
    return np.array([found[g] for g in gens], np.uint16), product, act, starts


def prefix(x: np.ndarray, product: np.ndarray) -> np.ndarray:
    """Products of all elements up to each one, itself included."""
    n = len(x)
    if n <= 64:
        out, acc = np.empty(n, x.dtype), 0
        for k in range(n):
            out[k] = acc = product[acc, x[k]]
        return out
    side = 256 if n > 1 << 14 else 16
    lanes = -(-n // side)
    padded = np.zeros(lanes * side, x.dtype)  # element 0 is the identity
    padded[:n] = x
    grid = np.ascontiguousarray(padded.reshape(lanes, side).T)
    flat, m = product.ravel(), np.int32(product.shape[0])
    acc = grid[0].astype(np.int32)
    for k in range(1, side):
        acc = flat[acc * m + grid[k]].astype(np.int32)
        grid[k] = acc
    before = np.zeros(lanes, np.int32)
    before[1:] = prefix(grid[-1].copy(), product)[:-1]
    return flat[before * m + grid].T.reshape(-1)[:n]


def boundaries(codes: np.ndarray) -> np.ndarray:
    """Where tokens start in texts of code points, each text followed by SEPARATOR."""
    kind = classes()[codes]
    symbol = np.array([LETTER, NUMBER, OTHER, GAP, GAP, END], np.uint8)[kind]
    white = (kind == _WHITE) | (kind == _SPACE)
    last = np.zeros(len(codes), bool)
    last[:-1] = white[:-1] & ~white[1:] & (kind[1:] != _END)
    symbol[last] = np.where(kind[last] == _SPACE, LAST_SPACE, LAST_WHITE)
    mark = np.flatnonzero(codes == 39)
    if len(mark):
        after = np.concatenate([codes, [SEPARATOR, SEPARATOR]])
        one, two = after[mark + 1], after[mark + 2]
        symbol[mark[np.isin(one, [ord(c) for c in "stmd"])]] = MARK2
        pair = np.zeros(len(mark), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        symbol[mark[pair]] = MARK3
    element, product, act, starts = monoid()
    total = prefix(element[symbol], product)
    state = np.empty(len(codes), np.uint8)
    state[:1] = FRESH
    state[1:] = act[:, FRESH][total[:-1]]
    return starts[state, symbol]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merger:
    """Pair merging by ranks."""

    LONG = 192  # bytes; longer slices are merged one by one with a heap

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for k, v in self.ranks.items():
            self.bytes[v] = k
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for word, rank in self.ranks.items():
            for k in range(1, len(word)):
                a, b = self.ranks.get(word[:k]), self.ranks.get(word[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        # open addressing, four slots in a row
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, size = np.uint64(64 - bits), (1 << bits) + 64
        self.key, self.rank = np.full(size, -1, np.int64), np.full(size, 1 << 30, np.int32)
        self.reach = 1
        keys = np.fromiter(pairs, np.int64, len(pairs))
        for key, at in zip(keys.tolist(), (mix(keys.view(np.uint64)) >> self.shift).tolist(), strict=True):
            k = at
            while self.key[k] != -1:
                k += 1
            self.key[k], self.rank[k] = key, pairs[key]
            self.reach = max(self.reach, k - at + 1)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = (mix(key.view(np.uint64)) >> self.shift).astype(np.int64)
        out = np.full(len(key), 1 << 30, np.int32)
        left = np.arange(len(key))
        for _ in range(self.reach):
            here = self.key[at[left]]
            hit = here == key[left]
            out[left[hit]] = self.rank[at[left[hit]]]
            left = left[~hit & (here != -1)]
            if not len(left):
                break
            at[left] += 1
        return out

    def merge_one(self, piece: bytes) -> list[int]:
        """A heap of pairs over a linked list: n log n for slices of any length."""
        ids = self.first[np.frombuffer(piece, np.uint8)].tolist()
        n, get = len(ids), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := get(ids[k] << 32 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = after[k] if ids[k] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = r, -1
            after[k] = m = after[j]
            if m < n:
                before[m] = k
                if (x := get(r << 32 | ids[m])) is not None:
                    heapq.heappush(heap, (x, k, r, ids[m]))
            if (p := before[k]) >= 0 and (x := get(ids[p] << 32 | r)) is not None:
                heapq.heappush(heap, (x, p, ids[p], r))
        return [x for x in ids if x >= 0]

    def fill(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found: list = [None] * len(pieces)
        rest = []
        for k, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                found[k] = (r,)
            elif len(p) > self.LONG:
                found[k] = self.merge_one(p)
            else:
                rest.append(k)
        length = np.array([0 if x is None else len(x) for x in found], np.int64)
        if rest:
            flat, own = self.merge_many([pieces[k] for k in rest])
            length[rest] = own
        out = np.empty(int(length.sum()), np.int64)
        at = np.cumsum(length) - length
        if rest:
            out[ragged(at[rest], own)] = flat
        for k, x in enumerate(found):
            if x is not None:
                out[at[k] : at[k] + len(x)] = x
        return out, length

    def merge_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Rounds over all slices: each merges its leftmost lowest-ranked pair; finished ones leave."""
        size = np.array([len(p) for p in pieces])
        ids = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        own = np.repeat(np.arange(len(pieces)), size)
        none = np.int32(1 << 30)
        rank = np.full(len(ids), none, np.int32)
        same = own[1:] == own[:-1]
        rank[:-1][same] = self.pair_ranks(ids[:-1][same], ids[1:][same])
        done_ids, done_own = [], []
        while len(ids):
            start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            least = np.minimum.reduceat(rank, start)
            count = np.diff(np.concatenate([start, [len(ids)]]))
            over = least == none
            if over.any():
                gone = np.repeat(over, count)
                done_ids.append(ids[gone])
                done_own.append(own[gone])
                stay = ~gone
                ids, own, rank = ids[stay], own[stay], rank[stay]
                least, count = least[~over], count[~over]
                if not len(ids):
                    break
                start = np.cumsum(count) - count
            hit = np.flatnonzero(rank == np.repeat(least, count))
            _, first = np.unique(own[hit], return_index=True)
            at = hit[first]
            ids[at] = rank[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at = np.cumsum(keep)[at] - 1
            ids, own, rank = ids[keep], own[keep], rank[keep]
            n = len(ids)
            for k in (at, at[at > 0] - 1):  # new pairs: with the next token and with the one before
                k = k[own[k] == own[np.minimum(k + 1, n - 1)]]
                k = k[k + 1 < n]
                rank[k] = self.pair_ranks(ids[k], ids[k + 1])
            tail = at[(at + 1 >= n) | (own[np.minimum(at + 1, n - 1)] != own[at])]
            rank[tail] = none
        flat, who = np.concatenate(done_ids), np.concatenate(done_own)
        order = np.argsort(who, kind="stable")
        return flat[order], np.bincount(who, minlength=len(pieces))


def merger(path: str) -> tuple[Merger, Cache]:
    def make():
        m = Merger(path)
        return m, Cache(m.fill, dtype=np.uint16 if len(m.bytes) <= 1 << 16 else np.uint32)

    return kept(("bpe", path), make)


def slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends in bytes of the slices of each text, and their number per text."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    raw, at = data.tobytes(), offsets.tolist()
    end = np.array([SEPARATOR], "<u4").tobytes()
    codes = np.frombuffer(b"".join([raw[a:b].decode("utf-8").encode("utf-32-le") + end for a, b in zip(at, at[1:], strict=False)]), "<u4")
    start = np.flatnonzero(boundaries(codes))
    width = 1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF)
    width[codes == SEPARATOR] = 0
    place = np.cumsum(width, dtype=np.int64) - width
    starts = place[start]
    number = np.diff(np.searchsorted(starts, offsets))
    ends = np.concatenate([starts[1:], [len(data)]])
    return starts, ends, number


def encoded(data: np.ndarray, offsets: np.ndarray, cache: Cache) -> tuple[np.ndarray, np.ndarray]:
    """All token ids and, per text and at the end, the number of ids before."""
    starts, ends, number = slices(data, offsets)
    ids, length = cache.look(data, starts, ends)
    return ids, np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(number)])].astype(np.int32)


def token_starts(ids: np.ndarray, edge: np.ndarray, size: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each token's first byte in its text."""
    width = size[ids]
    place = np.cumsum(width) - width
    return place - np.repeat(offsets[:-1], np.diff(edge))


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, starts): token ids and each token's first byte in the text."""
    prepare(docs.sparkSession)

    def run(batches):
        m, cache = merger(ranks)
        size = np.array([len(b) for b in m.bytes])
        for rows, data, offsets in chunks(batches):
            ids, edge = encoded(data, offsets, cache)
            place = token_starts(ids, edge, size, offsets)
            lists = [pa.ListArray.from_arrays(pa.array(edge), pa.array(x.astype(np.int32))) for x in (ids, place)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *lists], ["doc_id", "ids", "starts"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, starts array<int>")


def decode_bytes(ids: np.ndarray, m: Merger) -> bytes:
    return b"".join([m.bytes[i] for i in ids.tolist()])


SHA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, starts_crc32 long"


def _digests(doc_id: pa.Array, ids: np.ndarray, edge: np.ndarray, starts: np.ndarray, m: Merger, names: list[str]) -> pa.RecordBatch:
    id_sha, text_sha, crc = [], [], []
    for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        own = ids[x:y].tolist()
        id_sha.append(hashlib.sha256(" ".join([names[i] for i in own]).encode()).hexdigest())
        text_sha.append(hashlib.sha256(b"".join([m.bytes[i] for i in own])).hexdigest())
        crc.append(zlib.crc32(starts[x:y].astype("<u4").tobytes()))
    return pa.RecordBatch.from_arrays([doc_id, pa.array(np.diff(edge).astype(np.int64)), pa.array(id_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(crc, pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "starts_crc32"])


def digest(tokens: DataFrame, ranks: str) -> DataFrame:
    """Decode the ids of ``encode``; digests of ids, decoded bytes and the tokens' places (unsigned 32-bit, little-endian)."""

    def run(batches):
        m, _ = merger(ranks)
        names = [str(i) for i in range(len(m.bytes))]
        for b in batches:
            lists, places = b.column("ids"), b.column("starts")
            flat, at = (x.values.to_numpy(zero_copy_only=False) for x in (lists, places))
            yield _digests(b.column("doc_id"), flat, lists.offsets.to_numpy(), at, m, names)

    return tokens.select("doc_id", "ids", "starts").mapInArrow(run, SHA)


def round_trip(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``digest`` of ``encode`` in one worker a task: ids and places don't leave it."""
    prepare(docs.sparkSession)

    def run(batches):
        m, cache = merger(ranks)
        size = np.array([len(b) for b in m.bytes])
        names = [str(i) for i in range(len(m.bytes))]
        for rows, data, offsets in chunks(batches):
            ids, edge = encoded(data, offsets, cache)
            yield _digests(rows.column("doc_id"), ids, edge, token_starts(ids, edge, size, offsets), m, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SHA)
