"""Helpers shared by the text operators: tables, checkpoints and vectorised words.

Texts cross into Python as Arrow batches.  ``chunks`` cuts a batch into runs of
whole documents of a few megabytes, so the numpy arrays that a step needs stay
small whatever the batch size; only one very long document can exceed that.
The byte order is taken as little-endian.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
CHUNK = 1 << 19

#: The bytes that separate words: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: What keeps of eight bytes the first k.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG = 64  # bytes; longer slices are hashed one by one


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, bound their memory, and set a checkpoint folder where the session has none."""
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (path, ROOT) if x)
    # workers reuse arrays of a few megabytes, give larger ones back, and batches of long texts stay small
    env |= {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(16 << 20), "MALLOC_TRIM_THRESHOLD_": str(32 << 20)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``)."""
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir")
    if conf:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(conf)
        return conf.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def written(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder: computed once, of a size that is known."""
    spark = df.sparkSession
    place = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that a table is read from."""
    spark = df.sparkSession
    total = 0
    for f in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total


def join_listed(rows: DataFrame, listed: DataFrame, key: str, how: str, limit: int = 16 << 20) -> DataFrame:
    """Join with a written table, which is broadcast if its files have ``limit`` bytes at most; else both sides are shuffled."""
    return rows.join(F.broadcast(listed) if stored_bytes(listed) <= limit else listed, key, how)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of whole documents of about ``size`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = strings(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            to = min(to, batch.num_rows, at + 4096)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of every document, and how many words each has."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    word = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hashes2(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each slice of ``data``; equal slices have equal hashes wherever they stand.

    Slices go eight bytes at a time through two mixing chains, so equal sums or
    rearranged parts don't clash as in a polynomial; slices of one length up to eight
    bytes never do.  Slices beyond ``LONG`` bytes are taken from a cryptographic digest.
    """
    size = ends - starts
    # the last bytes are followed by zeros; slices are masked to their own length
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).data, strides=(1,))
    n = size.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = lanes[starts] & FIRST[np.minimum(size, 8)]
        a = mix(x ^ n * np.uint64(0x9E3779B97F4A7C15))
        b = mix((x + n * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(77))
        k, left = 8, np.flatnonzero((size > 8) & (size <= LONG))
        while len(left):
            rest = size[left] - k
            x = lanes[starts[left] + k] & FIRST[np.minimum(rest, 8)]
            a[left] = mix(a[left] ^ x)
            b[left] = mix((b[left] + x) * np.uint64(0xD6E8FEB86659FD93))
            k, left = k + 8, left[rest > 8]
    for j in np.flatnonzero(size > LONG).tolist():
        a[j], b[j] = np.frombuffer(hashlib.blake2b(data[starts[j] : ends[j]].tobytes(), digest_size=16).digest(), np.uint64)
    return a, b


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first of the two hashes, for counts and sets, where clashes of chance (2 ** -64 a pair) are accepted."""
    return hashes2(data, starts, ends)[0]


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words and their number per document; a shorter document is one run of all its words."""
    n = len(words)
    first = np.cumsum(counts) - counts
    with np.errstate(over="ignore"):
        mul = [np.uint64(pow(0xD6E8FEB86659FD93, j, 1 << 64)) for j in range(k)]
        whole = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            whole += words[j : j + len(whole)] * mul[j]
        number = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
        out = np.zeros(int(number.sum()), np.uint64)
        at = np.cumsum(number) - number
        long = counts >= k
        index = ragged(first[long], number[long])
        out[ragged(at[long], number[long])] = whole[index]
        for d in np.flatnonzero(~long & (counts > 0)):
            x = np.uint64(int(counts[d]) + 1)
            for j in range(int(counts[d])):
                x += words[first[d] + j] * mul[j]
            out[at[d]] = x
    return mix(out), number


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of range(start, start + length)."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)



class Cache:
    """Token ids of distinct slices over the batches of a task.

    ``fill`` gets the new slices as bytes and returns their ids in one array and
    the number of each.  Slices are found by one hash and confirmed by a second,
    independent one; where two slices clash in the first, the batch is looked up by
    its bytes.  It holds ``limit`` slices at most and starts anew beyond that.
    """

    def __init__(self, fill, limit: int = 200_000, dtype=np.uint16):
        self.fill, self.limit, self.dtype = fill, limit, dtype
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.proof = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int32)
        self.len = np.zeros(0, np.int32)
        self.ids = np.zeros(0, self.dtype)

    def look(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slices in order, and the number of each slice."""
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        a, b = hashes2(data, starts, ends)
        key, first, back = np.unique(a, return_index=True, return_inverse=True)
        proof = b[first]
        if (proof[back] != b).any():
            return self.by_bytes(data, starts, ends)
        if len(self.keys) > self.limit:
            self.clear()
        place = np.searchsorted(self.keys, key)
        known = np.zeros(len(key), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == key[inside]
        if (self.proof[place[known]] != proof[known]).any():
            return self.by_bytes(data, starts, ends)
        if not known.all():
            new = np.flatnonzero(~known)
            flat, length = self.fill([data[x:y].tobytes() for x, y in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            at = (len(self.ids) + np.cumsum(length) - length).astype(np.int32)
            self.ids = np.concatenate([self.ids, flat.astype(self.dtype)])
            self.at = np.insert(self.at, place[new], at)
            self.len = np.insert(self.len, place[new], length)
            self.keys = np.insert(self.keys, place[new], key[new])
            self.proof = np.insert(self.proof, place[new], proof[new])
            place = np.searchsorted(self.keys, key)
        place = place[back]
        lengths = self.len[place].astype(np.int64)
        return self.ids[ragged(self.at[place], lengths)], lengths

    def by_bytes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own: dict[bytes, int] = {}
        back = np.array([own.setdefault(data[x:y].tobytes(), len(own)) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)])
        flat, length = self.fill(list(own))
        at = np.cumsum(length) - length
        return flat.astype(self.dtype)[ragged(at[back], length[back])], length[back]


class Slots:
    """Where keys stand in a sorted array, by hashing; len(keys) for keys that aren't in it."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.n = np.uint64(64 - bits), len(keys)
        home = self._home(keys)
        order = np.argsort(home, kind="stable")
        # each key takes the first free slot from its home on
        slot = np.maximum.accumulate(home[order] - np.arange(len(keys))) + np.arange(len(keys))
        size = max(1 << bits, int(slot.max(initial=0)) + 1) + 1  # the last slot stays free
        self.key, self.at = np.full(size, -1, np.int64), np.full(size, len(keys), np.int32)
        self.key[slot], self.at[slot] = keys[order], order

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._home(keys)
        here = self.key[slot]
        out = np.where(here == keys, self.at[slot], np.int32(self.n))
        left = np.flatnonzero((here != keys) & (here != -1))
        while len(left):
            slot[left] += 1
            here = self.key[slot[left]]
            hit = here == keys[left]
            out[left[hit]] = self.at[slot[left[hit]]]
            left = left[~hit & (here != -1)]
        return out


_kept: dict = {}


def kept(key, make):
    """What a Python worker keeps from task to task, such as caches and tables: that of the last ``key`` only.

    Operators that keep nothing let it go (``release``).
    """
    if key not in _kept:
        release()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Let go of what an earlier operator kept in this worker, and of the allocator's free memory (glibc only)."""
    if _kept:
        _kept.clear()
        trim()


def trim() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass
