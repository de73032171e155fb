"""A splittable BAM source and a sink, with Arrow batches.

``spark.read.format("bam").load(path)`` takes a file, a folder or a pattern in the last part of
the path, on any file system that pyarrow opens.  Files are cut by bytes (option ``split``); where that makes more than ``TASKS``
splits, as many neighbours go to a task together as keep to that number.  A worker reads a file's header once.  A split
owns the compressed blocks that start inside it and the records that start in those blocks.
It finds its first block by the block header, whose size must lead to a next header, and its
first record by a chain of records whose fields are possible, so splits need no index;
its last record may run on into blocks of the next split.

``ord`` is a record's virtual offset (block offset * 65,536 + place in the block), which grows
along the file.  Filters on ``first_read``, ``inter`` (``= true``) and ``mapq`` (``>=``) are pushed
into the decoder where Spark hands them over (``spark.sql.python.filterPushdown.enabled``); options
``first_only`` and ``inter_only`` do the same everywhere.  Sorting by coordinate is an error, as are
cut-off files.
"""

from __future__ import annotations

import fnmatch
import functools
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, InputPartition

SCHEMA = "ord long, qname string, flag int, rname string, pos long, mapq int, rnext string, pnext long, nm long, duplicate boolean, first_read boolean, inter boolean"
#: Bytes of a tag's value by its type letter, and how integers are read.
TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
INTEGERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
#: Fixed value: the empty block that ends a file.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
LARGEST = 1 << 16  # bytes of a block
SPLIT = 64 << 20
STEP = 4 << 20
TASKS = 1024  # beyond so many splits, neighbours in a file are read as one
CHAIN = 8  # records that must follow each other
_FIXED = np.dtype([("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("mref", "<i4"), ("mpos", "<i4"), ("tlen", "<i4")])


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a URI or a local path."""
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the file, of all .bam files of a folder, or of those that match the last part."""
    fs, own = opened(path)
    head = path[: len(path) - len(own)] if path.endswith(own) else ""
    base, _, last = own.rpartition("/")
    if any(c in last for c in "*?["):
        found = [f for f in fs.get_file_info(pa.fs.FileSelector(base or "/")) if f.is_file and fnmatch.fnmatch(f.base_name, last)]
    else:
        info = fs.get_file_info(own)
        found = [info] if info.is_file else [f for f in fs.get_file_info(pa.fs.FileSelector(own)) if f.is_file and f.base_name.endswith(".bam")]
    return sorted((head + f.path, f.size) for f in found)


# ------------------------------------------------------------ blocks


def block_size(data: bytes, at: int) -> int:
    """Size of the block whose header is at a place, 0 if there is none, -1 if the header is cut off."""
    if len(data) - at < 18:
        return -1
    if data[at : at + 4] != b"\x1f\x8b\x08\x04":
        return 0
    extra = struct.unpack_from("<H", data, at + 10)[0]
    k, end = at + 12, at + 12 + extra
    if len(data) < end:
        return -1
    while k + 4 <= end:
        name, n = data[k : k + 2], struct.unpack_from("<H", data, k + 2)[0]
        if name == b"BC" and n == 2:
            return struct.unpack_from("<H", data, k + 4)[0] + 1
        k += 4 + n
    return 0


def first_block(f, start: int, size: int) -> int:
    """Offset of the first block at or after ``start``: its header's size leads to another header or to the end."""
    f.seek(start)
    data = f.read(3 * LARGEST)
    at = data.find(b"\x1f\x8b\x08\x04")
    while at >= 0:
        n = block_size(data, at)
        if n > 0 and (start + at + n == size or (start + at + n < size and block_size(data, at + n) > 0)):
            return start + at
        at = data.find(b"\x1f\x8b\x08\x04", at + 1)
    return size


def blocks(f, start: int, size: int, path: str) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of every block from ``start`` on."""
    f.seek(start)
    held, at = b"", start
    while True:
        k = 0
        while True:
            n = block_size(held, k)
            if n == 0:
                raise ValueError(f"{path}: no block at {at}")
            if n < 0 or k + n > len(held):
                break
            skip = 12 + struct.unpack_from("<H", held, k + 10)[0]
            yield at, zlib.decompress(held[k + skip : k + n - 8], -15)
            k, at = k + n, at + n
        more = f.read(STEP)
        held = held[k:] + more
        if not more:
            if held or at < size:
                raise ValueError(f"{path}: the file is cut off")
            return


# ------------------------------------------------------------ records


@dataclass(frozen=True)
class Header:
    text: str
    names: tuple[str, ...]
    block: int  # offset of the block in which records start
    skip: int  # bytes before the first record in it

    @functools.cached_property
    def listed(self) -> pa.Array:
        """The names as a column, and that of none at the end."""
        return pa.array([*self.names, "*"], pa.string())


@functools.lru_cache(maxsize=4)
def known_header(path: str, scan: str) -> Header:
    """The header of a file, parsed once a worker and scan: it has a name for each contig, however small a split is."""
    return read_header(path)


def read_header(path: str) -> Header:
    fs, own = opened(path)
    held, bounds = b"", []
    with fs.open_input_file(own) as f:
        source = blocks(f, 0, f.size(), path)

        def need(n: int) -> None:
            nonlocal held
            while len(held) < n:
                at, data = next(source, (None, b""))
                if at is None:
                    raise ValueError(f"{path}: the file is cut off")
                bounds.append((len(held), at))
                held += data

        need(8)
        if held[:4] != b"BAM\1":
            raise ValueError(f"{path}: no BAM file")
        n = struct.unpack_from("<i", held, 4)[0]
        need(12 + n)
        text = held[8 : 8 + n].decode().rstrip("\0")
        at, names = 12 + n, []
        for _ in range(struct.unpack_from("<i", held, 8 + n)[0]):
            need(at + 4)
            size = struct.unpack_from("<i", held, at)[0]
            need(at + 8 + size)
            names.append(held[at + 4 : at + 3 + size].decode())
            at += 8 + size
        if any(line.startswith("@HD") and "SO:coordinate" in line for line in text.split("\n")):
            raise ValueError(f"{path}: sorted by coordinate; sort by name")
    place, block = max((b for b in bounds if b[0] <= at), key=lambda b: b[0])
    return Header(text, tuple(names), block, at - place)


def possible(data: bytes, at: int, n_refs: int) -> int:
    """Where the next record would start if one is here; 0 if none can be, -1 if the data end before that is known."""
    if at + 36 > len(data):
        return -1
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, mref, mpos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not (-1 <= ref < n_refs and -1 <= mref < n_refs and pos >= -1 and mpos >= -1 and l_name > 0 and l_seq >= 0 and size >= 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq):
        return 0
    name = data[at + 36 : at + 36 + l_name]
    if len(name) == l_name and (name[-1] or any(c < 33 or c > 126 for c in name[:-1])):
        return 0
    return at + 4 + size


def first_record(data: bytes, n_refs: int, whole: bool) -> int:
    """The first place from which ``CHAIN`` records follow each other, or records up to the end of the data; -1 if there is none.

    whole: nothing comes after the data.
    """
    for at in range(len(data)):
        k, n = at, 0
        while n < CHAIN:
            if k == len(data) and whole and n:
                return at
            then = possible(data, k, n_refs)
            if then == 0 or (then < 0 and whole) or (whole and then > len(data)):
                break
            if then < 0 or then > len(data):
                return at if n else -1
            k, n = then, n + 1
        else:
            return at
    return -1


def number_of_mismatches(tags: bytes) -> int:
    at = 0
    while at + 3 <= len(tags):
        name, kind = tags[at : at + 2], chr(tags[at + 2])
        at += 3
        if kind in "ZH":
            at = tags.index(b"\0", at) + 1
        elif kind == "B":
            sub, n = chr(tags[at]), struct.unpack_from("<i", tags, at + 1)[0]
            at += 5 + n * TAG_SIZES[sub]
        else:
            if name == b"NM" and kind in INTEGERS:
                return struct.unpack_from(INTEGERS[kind], tags, at)[0]
            at += TAG_SIZES[kind]
    return 0


@dataclass(frozen=True)
class Wanted:
    first: bool = False
    inter: bool = False
    mapq: int = 0


def decode(data: bytes, at: np.ndarray, offsets: np.ndarray, names: pa.Array, wanted: Wanted) -> pa.RecordBatch:
    """Rows of the records that start at ``at`` and are wanted; others are dropped before their names and tags are read."""
    raw = np.frombuffer(data, np.uint8)
    fixed = raw[at[:, None] + np.arange(4, 36)].reshape(-1).view(_FIXED)
    keep = np.ones(len(at), bool)
    if wanted.first:
        keep &= fixed["flag"] & 64 != 0
    if wanted.inter:
        keep &= fixed["ref"] != fixed["mref"]
    keep &= fixed["mapq"] >= wanted.mapq
    at, fixed, offsets = at[keep], fixed[keep], offsets[keep]
    size = raw[at[:, None] + np.arange(4)].reshape(-1).view("<i4")
    start = at + 36 + fixed["l_name"] + 4 * fixed["n_cigar"].astype(np.int64) + (fixed["l_seq"] + 1) // 2 + fixed["l_seq"]
    text = [data[a + 36 : a + 35 + n].decode() for a, n in zip(at.tolist(), fixed["l_name"].tolist(), strict=True)]
    nm = [number_of_mismatches(data[a:b]) for a, b in zip(start.tolist(), (at + 4 + size).tolist(), strict=True)]
    ref = lambda c: names.take(pa.array(np.where(fixed[c] < 0, len(names) - 1, fixed[c])))
    flag = fixed["flag"].astype(np.int32)
    columns = [pa.array(offsets), pa.array(text, pa.string()), pa.array(flag), ref("ref"), pa.array(fixed["pos"].astype(np.int64)), pa.array(fixed["mapq"].astype(np.int32)), ref("mref"), pa.array(fixed["mpos"].astype(np.int64)), pa.array(nm, pa.int64()), pa.array(flag & 1024 != 0), pa.array(flag & 64 != 0), pa.array(fixed["ref"] != fixed["mref"])]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])


def read_split(path: str, start: int, end: int, header: Header, wanted: Wanted = Wanted(), step: int = STEP) -> Iterator[pa.RecordBatch]:
    """The records that start in blocks whose offset is in [start, end)."""
    fs, own = opened(path)
    names = header.listed
    with fs.open_input_file(own) as f:
        size = f.size()
        begin = header.block if start <= header.block else first_block(f, start, size)
        if begin >= min(end, size) or end <= header.block:
            return
        source = blocks(f, begin, size, path)
        held, place, block = b"", [], []  # where each held block's data start, and its offset in the file
        skip = header.skip if begin == header.block else None
        last = False  # the file is read
        while True:
            owned = True
            while not last and owned and len(held) < step or not held:
                at, data = next(source, (None, b""))
                if at is None:
                    last = True
                    break
                owned = at < end
                place.append(len(held))
                block.append(at)
                held += data
            if skip is None:
                # blocks without a whole record are joined until one is found or the split is over
                skip = first_record(held, len(header.names), last)
                if skip < 0:
                    if last:
                        return
                    skip, step = None, step + LARGEST
                    if not owned:
                        at, data = next(source, (None, b""))
                        last = at is None
                        if not last:
                            place.append(len(held))
                            block.append(at)
                            held += data
                    continue
            limit = next((p for p, b in zip(place, block, strict=True) if b >= end), len(held))
            at, k = [], skip
            while k < limit and k + 4 <= len(held):
                n = k + 4 + struct.unpack_from("<i", held, k)[0]
                if n > len(held):
                    break
                at.append(k)
                k = n
            if at:
                where = np.array(at)
                of = np.searchsorted(place, where, "right") - 1
                yield decode(held, where, (np.array(block)[of] << 16) | (where - np.array(place)[of]), names, wanted)
            if k >= limit and (not owned or last):
                return
            if last:
                raise ValueError(f"{path}: the file is cut off")
            # what is left of a record goes on with the next blocks
            first = int(np.searchsorted(place, k, "right")) - 1
            cut = place[first] if k < len(held) else len(held)
            place, block = ([p - cut for p in place[first:]], block[first:]) if k < len(held) else ([], [])
            held, skip, step = held[cut:], k - cut, max(step, len(held) - cut + LARGEST)
            if not owned:
                at, data = next(source, (None, b""))
                last = at is None
                if not last:
                    place.append(len(held))
                    block.append(at)
                    held += data


@dataclass
class Piece(InputPartition):
    path: str
    start: int
    end: int
    scan: str

    def __post_init__(self):
        super().__init__((self.path, self.start))


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        on = lambda k: str(options.get(k, "false")).lower() == "true"
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.wanted = Wanted(on("first_only"), on("inter_only"))

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.value is True and f.attribute in (("first_read",), ("inter",)):
                self.wanted = Wanted(self.wanted.first or f.attribute == ("first_read",), self.wanted.inter or f.attribute == ("inter",), self.wanted.mapq)
            elif isinstance(f, GreaterThanOrEqual) and f.attribute == ("mapq",):
                self.wanted = Wanted(self.wanted.first, self.wanted.inter, max(self.wanted.mapq, int(f.value)))
            else:
                yield f

    def partitions(self):
        found = files(self.path)
        scan = uuid.uuid4().hex
        step = self.split * max(1, -(-sum(-(-n // self.split) for _, n in found) // TASKS))
        return [Piece(p, a, min(a + step, n), scan) for p, n in found for a in range(0, n, step)]

    def read(self, partition):
        yield from read_split(partition.path, partition.start, partition.end, known_header(partition.path, partition.scan), self.wanted)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# ------------------------------------------------------------ writing


def squeezed(data: bytes) -> bytes:
    """One compressed block."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04" + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def encode_header(names: list[str], lengths: list[int], order: str = "queryname") -> bytes:
    text = f"@HD\tVN:1.6\tSO:{order}\n".encode()
    refs = b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in zip(names, lengths, strict=True))
    return b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(names)) + refs


def encode_record(qname: str, flag: int, ref: int, pos: int, mapq: int, mref: int, mpos: int, nm: int) -> bytes:
    """A record without sequence; refs by number, -1 for none."""
    name = qname.encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name), mapq, 0, 0, flag, 0, mref, mpos, 0) + name + b"NMi" + struct.pack("<i", nm)
    return struct.pack("<i", len(body)) + body


def write_bam(rows: DataFrame, references: list[tuple[str, int]], path: str, block: int = 60_000) -> DataFrame:
    """One file a partition, (file, n_rows) of each; rows: the columns of the source from qname to nm.

    references: (name, length) of all contigs, as the header holds them.  A file appears under its
    name when it is whole, so that a task that is run again replaces it.
    """
    at = {name: k for k, (name, _) in enumerate(references)} | {"*": -1}
    head = encode_header([n for n, _ in references], [n for _, n in references])

    def flush(out, held: bytearray, n: int) -> None:
        """Write blocks of what starts in the first ``n`` bytes."""
        ends = range(0, n, block)
        for k in ends:
            out.write(squeezed(bytes(held[k : k + block])))
        del held[: len(ends) * block]

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        fs, own = opened(path)
        fs.create_dir(own)
        task = TaskContext.get()
        name = f"{own.rstrip('/')}/part-{task.partitionId():05}.bam"
        held, n = bytearray(head), 0
        with fs.open_output_stream(f"{name}.{task.taskAttemptId()}.part") as out:
            for batch in batches:
                for q, flag, ref, pos, mapq, mref, mpos, nm in zip(*[batch[c].to_pylist() for c in ("qname", "flag", "rname", "pos", "mapq", "rnext", "pnext", "nm")], strict=True):
                    held += encode_record(q, flag, at[ref], pos, mapq, at[mref], mpos, nm)
                    n += 1
                    if len(held) >= block:
                        flush(out, held, len(held) - block + 1)
            flush(out, held, len(held))
            out.write(END)
        fs.move(f"{name}.{task.taskAttemptId()}.part", name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["file", "n_rows"])

    return rows.mapInArrow(run, "file string, n_rows long")
