"""Language identification by prediction by partial matching (PPM) with frozen statistics.

For every language a byte context tree of orders 0 to 3 is counted on a bounded
sample of its labelled documents; texts are lower-cased first, by the same function in
training and in scoring.  The statistics
are then frozen: a symbol seen n times in a context of total t with d distinct
symbols costs -log2(n / (t + d)) bits, any other costs the escape
-log2(d / (t + d)) and then its price in the next shorter context; an unseen
context costs nothing to leave; below order 0 all 256 bytes are alike.  A text's
code length per language is the exact sum over its bytes, whole text, and the
shortest code names the language.  Its score is the posterior of that language
under equal priors.

Scoring looks up every four-byte string in a hash table whose rows hold its price
in all languages; strings unseen everywhere pay the escapes of their context and
the price one order below.  The tables have a row for each string of the sample, so
they grow with the sample and not with the alphabet.

The sample bound: ``bytes_per_language`` (384 KiB) in expectation for each
language, from whole documents picked by a hash of their id; only this sample
reaches the driver.  Of more than ``languages`` (256) label values those with the most
labelled bytes are learned (ties: by name), so sample and tables stay bounded.  Labels of
held-out rows, sources and ids never reach a prediction.

Null or letterless text (no character of a letter category): ``und`` with score 0.
No labelled rows: all ``und``.  Empty table: no rows.  Very long texts: whole, alone in
their chunk.  Ties: the alphabetically first language.  Repeated rows and null ids
stay.  Columns other than doc_id, text, lang and those asked for are ignored.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Slots, chunks, kept, prepare, strings

ORDER = 3
PAD = 10  # the byte that stands before a text
LANGUAGES = 256


def fold(doc_id: Column, m: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def sample(docs: DataFrame, bytes_per_language: int, languages: int = LANGUAGES) -> dict[str, list[str]]:
    """Whole labelled texts per language, about the stated number of bytes, of the ``languages`` with the most labelled bytes."""
    rows = docs.where("text is not null and lang is not null")
    by = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n"))
    total = {r["lang"]: r["n"] for r in by.orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not total:
        return {}
    scale = 1 << 30
    share = F.create_map(*[F.lit(x) for k, n in total.items() for x in (k, min(scale, math.ceil(scale * bytes_per_language / max(1, n))))])
    picked = rows.where(F.pmod(F.xxhash64(F.lit("ppm"), "doc_id"), F.lit(scale)) < F.coalesce(share[F.col("lang")], F.lit(0)))
    out: dict[str, list[str]] = {k: [] for k in sorted(total)}
    for r in picked.select("lang", "text").orderBy("lang", "text").toLocalIterator():
        out[r["lang"]].append(r["text"])
    return {k: v for k, v in out.items() if v}


def count(texts: dict[str, list[str]]) -> dict:
    """Counts of all strings of up to ORDER + 1 bytes per language, as sorted (string, number); strings are numbers of base 256."""
    grams = {}
    for lang, docs in texts.items():
        pad = bytes([PAD]) * ORDER
        data = [pad + t.encode() for t in pc.utf8_lower(pa.array(docs, pa.string())).to_pylist()]
        x = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
        own = np.concatenate([np.r_[np.zeros(ORDER, bool), np.ones(len(d) - ORDER, bool)] for d in data])
        at = np.flatnonzero(own)
        key, out = np.zeros(len(at), np.int64), []
        for k in range(ORDER + 1):
            key = key + (x[at - k] << 8 * k)
            out.append(np.unique(key, return_counts=True))
        grams[lang] = out
    return {"id": uuid.uuid4().hex, "langs": list(texts), "grams": grams}


class Node:
    """The contexts of one order in all languages: an open-addressed table of strings and their prices."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]], shorter: np.ndarray | None, k: int):
        """grams: (string, number) of a language each; shorter: prices of the strings' last k bytes in the shorter contexts."""
        self.keys = np.unique(np.concatenate([g for g, _ in grams]))
        context = np.unique(self.keys >> 8)
        self.context = context
        self.escape = np.zeros((len(context) + 1, len(grams)), np.float32)  # the last row: an unseen context
        self.price = shorter.astype(np.float32).copy()
        at = np.searchsorted(context, self.keys >> 8)
        for j, (g, n) in enumerate(grams):
            c, first = np.unique(g >> 8, return_index=True)
            total, distinct = np.add.reduceat(n, first), np.diff(np.r_[first, len(g)])
            place = np.searchsorted(context, c)
            self.escape[place, j] = -np.log2(distinct / (total + distinct))
            self.price[:, j] += self.escape[at, j]
            own = np.searchsorted(c, g >> 8)
            self.price[np.searchsorted(self.keys, g), j] = -np.log2(n / (total + distinct)[own])
        self.slots = Slots(self.keys)
        self.contexts = Slots(context)


class Prices:
    """Bits of every byte after every context in every language."""

    def __init__(self, model: dict):
        langs = model["langs"]
        self.langs = len(langs)
        self.nodes: list[Node] = []
        for k in range(ORDER + 1):
            grams = [model["grams"][x][k] for x in langs]
            keys = np.unique(np.concatenate([g for g, _ in grams]))
            shorter = np.full((len(keys), len(langs)), 8.0, np.float32) if k == 0 else self._price(keys & ((1 << 8 * k) - 1), k - 1)
            self.nodes.append(Node(grams, shorter, k))

    def _price(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Prices of strings of k + 1 bytes: those of the table, else the escape and the price one order below."""
        node = self.nodes[k]
        at = node.slots.find(keys)
        miss = np.flatnonzero(at == len(node.keys))
        at[miss] = 0
        out = node.price[at]
        if len(miss):
            low = np.full((len(miss), self.langs), 8.0, np.float32) if k == 0 else self._price(keys[miss] & ((1 << 8 * k) - 1), k - 1)
            out[miss] = node.escape[node.contexts.find(keys[miss] >> 8)] + low
        return out

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code lengths of texts: one row per text, one column per language."""
        n, docs = len(data), len(offsets) - 1
        out = np.zeros((docs, self.langs))
        if not n:
            return out
        # ORDER pads stand before each text
        x = np.full(n + ORDER * docs, PAD, np.uint32)
        at = np.arange(n) + np.repeat(ORDER * (1 + np.arange(docs)), np.diff(offsets))
        x[at] = data
        key = np.zeros(len(x), np.uint32)
        for k in range(ORDER + 1):
            key[ORDER:] |= x[ORDER - k : len(x) - k] << np.uint32(8 * k)
        price = self._price(key[at].astype(np.int64), ORDER)
        full = np.flatnonzero(np.diff(offsets))
        out[full] = np.add.reduceat(price, offsets[full], axis=0, dtype=np.float64)
        return out


def prices(model: dict) -> Prices:
    return kept(("ppm", model["id"]), lambda: Prices(model))


def train(docs: DataFrame, bytes_per_language: int = 384 << 10) -> dict | None:
    """docs: doc_id, text, lang of the rows to learn from."""
    texts = sample(docs.select("doc_id", "text", "lang"), bytes_per_language)
    return count(texts) if texts else None


def has_letter(texts: list[str | None]) -> np.ndarray:
    return np.fromiter((t is not None and any(map(str.isalpha, t)) for t in texts), bool, len(texts))


def predict(docs: DataFrame, model: dict | None, keep: list[str] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, bits) and the columns of ``keep``, which must have other names; bits: the code length in the named language."""
    if clash := {"doc_id", "lang_pred", "score", "bits"} & set(keep):
        raise ValueError(f"columns to keep that have names of the result: {sorted(clash)}")
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text", *[c for c in keep if c != "text"])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches):
        m = shared.value
        p = m and prices(m)
        for batch, _, _ in chunks(batches):
            text = batch.column("text")
            ok = has_letter(text.to_pylist())
            name, score, best = np.full(len(ok), "und", object), np.zeros(len(ok)), np.full(len(ok), np.nan)
            if p is not None:
                bits = p.bits(*strings(pc.utf8_lower(text)))
                k = bits.argmin(1)
                least = bits[np.arange(len(k)), k]
                share = 1 / np.exp2(np.minimum(0, least[:, None] - bits)).sum(1)
                name[ok], score[ok], best[ok] = np.array(m["langs"], object)[k[ok]], share[ok], least[ok]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(name, pa.string()), pa.array(score), pa.array(best, from_pandas=True), *[batch.column(c) for c in keep]], ["doc_id", "lang_pred", "score", "bits", *keep])

    extra = "".join(f", `{c}` {kinds[c]}" for c in keep)
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, lang_pred string, score double, bits double{extra}")


def identify(docs: DataFrame, folds: int = 3, held: int = 1, bytes_per_language: int = 384 << 10) -> DataFrame:
    """Learn from rows outside the held-out fold and name the language of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    model = train(rows.where(fold(F.col("doc_id"), folds) != held), bytes_per_language)
    out = predict(rows, model)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits")
