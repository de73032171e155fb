"""Token-ID files: flat unsigned integers plus 64-bit document offsets.

Documents are dealt into ranges of doc_id; each task writes one shard of its
range: ``<shard>.bin`` (uint16 where every id fits, else uint32, little-endian),
``<shard>.idx`` (n + 1 int64 offsets) and ``<shard>.doc`` (n int64 doc ids).
The manifest has a row per shard; its bases are prefix sums of token counts, so
the shards in order are one token stream.  A task writes under a name of its own
attempt and only what it reports is read, so retries and lost executors leave at
most unused files.  Readers map the files into memory where they are local.

Texts are encoded as the tokenizers library does, strings of its added tokens
included: such a string, spelt exactly, is that one token.

Null text: no tokens but the end id.  Very long texts: encoded whole, alone in their
chunk.  Repeated doc_ids: each row stays, ordered by text.  Null doc_id: comes first.
Empty table: no shards and an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACE, Cache, chunks, kept, parts, prepare, shared_dir, spans

NONE = np.iinfo(np.int64).min  # stands for a null doc_id in .doc files


#: Classes of bytes: ASCII letters, digits and other signs; 0 for the apostrophe, white space and all that isn't ASCII.
KIND = np.array([0 if b > 127 or b == 39 or SPACE[b] else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)


def added(data: np.ndarray, offsets: np.ndarray, pattern: re.Pattern | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokenizer's added tokens: leftmost, inside one document, as they are spelt."""
    if pattern is None or not pattern.search(raw := data.tobytes()):
        z = np.zeros(0, np.int64)
        return z, z
    at = offsets.tolist()
    found = [m.span() for a, b in zip(at, at[1:], strict=False) for m in pattern.finditer(raw, a, b)]
    x = np.array(found, np.int64).reshape(-1, 2)
    return x[:, 0], x[:, 1]


def pieces(data: np.ndarray, offsets: np.ndarray, pattern: re.Pattern | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words cut further where the tokenizer cuts in any case: between ASCII letters, digits and signs, after each digit, and around added tokens."""
    first, last = added(data, offsets, pattern)
    bounds = np.unique(np.concatenate([offsets, first, last])) if len(first) else offsets
    starts, ends, words = spans(data, bounds)
    kind = KIND[LOWER[data]]
    a, b = kind[:-1], kind[1:]
    cut = np.flatnonzero((a > 0) & (b > 0) & ((a != b) | (a == 2))) + 1
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    cut = cut[~edge[cut]]
    starts = np.sort(np.concatenate([starts, cut]))
    ends = np.sort(np.concatenate([ends, cut]))
    if len(first):  # an added token is one piece
        k = np.searchsorted(first, starts, "right") - 1
        outside = (k < 0) | (starts >= last[np.maximum(k, 0)])
        starts = np.sort(np.concatenate([starts[outside], first]))
        ends = np.sort(np.concatenate([ends[outside], last]))
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_encoder(path: str):
    """(ids of pieces, number of ids, pattern of added tokens) by a tokenizers file whose pre-tokenizer drops white space and splits letters, digits and signs.

    Added tokens are found in the text as it is, before lower-casing, as the library does.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    special = {}
    for i, t in tok.get_added_tokens_decoder().items():
        body = t.content.encode()
        if t.normalized or t.single_word or t.lstrip or t.rstrip or len(pieces(np.frombuffer(body, np.uint8), np.array([0, len(body)]))[0]) < 2:
            raise ValueError(f"added token {t.content!r}: only tokens of more than one piece that are matched as they are spelt")
        special[body] = i
    pattern = re.compile(b"|".join(re.escape(x) for x in sorted(special, key=len, reverse=True))) if special else None
    batch = getattr(tok, "encode_batch_fast", tok.encode_batch)
    tokenize = tok.model.tokenize

    def fill(words: list[bytes]):
        ids: list = [None] * len(words)
        rest = []
        for k, w in enumerate(words):
            if w.isalpha():  # ASCII letters in lower case: one piece that no step before the model changes
                ids[k] = [t.id for t in tokenize(w.decode())]
            elif w in special:
                ids[k] = [special[w]]
            else:
                rest.append(k)
        for k, x in zip(rest, batch([words[k].decode("utf-8", "replace") for k in rest], add_special_tokens=False), strict=True):
            ids[k] = x.ids
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.int64, int(length.sum())), length

    return fill, tok.get_vocab_size(with_added_tokens=True), pattern


def encoder(path: str) -> tuple[Cache, int, re.Pattern | None]:
    """What a worker keeps for a tokenizer: the cache of pieces, the number of ids and the pattern of added tokens."""

    def make():
        fill, size, pattern = word_encoder(path)
        return Cache(fill, dtype=np.uint16 if size <= 1 << 16 else np.uint32), size, pattern

    return kept(("words", path), make)


def lowered(data: np.ndarray, offsets: np.ndarray, pattern: re.Pattern | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes in lower case (the tokenizer does that too; so more words are alike), added tokens as they are, and their pieces."""
    starts, ends, words = pieces(data, offsets, pattern)
    out = LOWER[data]
    for a, b in zip(*added(data, offsets, pattern), strict=True):
        out[a:b] = data[a:b]
    return out, starts, ends, words


def _put(where, path: str, data: bytes) -> None:
    with where.open_output_stream(path) as f:
        f.write(data)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, n: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Write all documents in ascending order of id; the manifest, with each shard's base."""
    spark = prepare(docs.sparkSession)
    n = n or parts(spark)

    def write(batches):
        from pyspark import TaskContext

        cache, size, pattern = encoder(tokenizer)
        kind = "<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4"
        where, root = fs.FileSystem.from_uri(folder)
        shard = TaskContext.get().partitionId()
        name = f"{root}/{shard:06d}-{uuid.uuid4().hex}"
        ids_n, docs_id, out = [], [], None
        for rows, data, offsets in chunks(batches, 1 << 20):
            if out is None:
                where.create_dir(root, recursive=True)
                out = where.open_output_stream(name + ".bin")
            data, starts, ends, words = lowered(data, offsets, pattern)
            ids, length = cache.look(data, starts, ends)
            edge = np.concatenate([[0], np.cumsum(length)])[np.cumsum(words)]
            stream = np.insert(ids.astype(kind, copy=False), edge, end_id)
            out.write(stream.tobytes())
            ids_n.append(np.diff(np.concatenate([[0], edge])) + 1)
            docs_id.append(rows.column("doc_id").fill_null(int(NONE)).to_numpy(zero_copy_only=False).astype("<i8"))
        if out is not None:
            out.close()
            number = np.concatenate(ids_n)
            _put(where, name + ".idx", np.concatenate([[0], np.cumsum(number)]).astype("<i8").tobytes())
            _put(where, name + ".doc", np.concatenate(docs_id).tobytes())
            yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [os.path.basename(name)], "kind": [kind], "n_docs": [len(number)], "n_tokens": [int(number.sum())]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    shards = sorted((r.asDict() for r in dealt.mapInArrow(write, "shard long, name string, kind string, n_docs long, n_tokens long").collect()), key=lambda r: r["shard"])
    base = 0
    for r in shards:
        r["base"], base = base, base + r["n_tokens"]
    return shards


def _open(where, path: str, kind: str) -> np.ndarray:
    if isinstance(where, fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with where.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read_shards(spark: SparkSession, folder: str, shards: list[dict]) -> DataFrame:
    """Per document, read from the files: its place in the stream, its ids' number and checksum."""

    def read(batches):
        where, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for r in b.to_pylist():
                name = f"{root}/{r['name']}"
                ids, at, doc = (_open(where, name + x, k) for x, k in ((".bin", r["kind"]), (".idx", "<i8"), (".doc", "<i8")))
                for k in range(0, len(doc), 8192):
                    cut = at[k : k + 8193].tolist()
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cut, cut[1:], strict=False)]
                    own = doc[k : k + 8192]
                    yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == NONE), pa.array(np.array(cut[:-1]) + r["base"]), pa.array(np.diff(cut)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "shard long, name string, kind string, n_docs long, n_tokens long, base long"
    keys = [x.split()[0] for x in schema.split(", ")]
    listed = spark.createDataFrame([tuple(r[k] for k in keys) for r in shards], schema)
    return listed.repartition(max(1, len(shards))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    folder = folder or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_shards(docs.sparkSession, folder, write_shards(docs, folder, tokenizer, end_id))
