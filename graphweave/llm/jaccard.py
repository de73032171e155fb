"""N-gram Jaccard join: an exact similarity join by blocked sparse matrix products.

1. Every document becomes the set of its distinct 4-word shingles (64-bit
   hashes).  Equal sets form a class with the smallest doc_id as representative, if any
   of its rows has one.
2. Candidates.  If two sets reach the threshold, their overlap is at least o and
   at most d shingles differ.  In hash order each differing shingle breaks one
   run of common ones, so among the first (w - 1)(d + 1) + 1 common shingles
   some w stand side by side in both sets.  Each class therefore emits the runs
   of w = 4 consecutive hashes inside a prefix of a length derived from its size
   (the bound holds for every size a partner may have).  Small sets may have too
   few common shingles for that; they emit shorter runs in addition, as short as
   some partner's size asks for.  Classes that share a run are joined,
   transitively, into candidate clusters; no pairs are listed.
3. In a cluster, classes are cut into blocks by size and hash.  Only blocks whose
   sizes allow the threshold meet; there the document-by-shingle incidence
   matrices are multiplied, column block by column block, which accumulates the
   overlap of every pair, and pairs below the size-derived bound are discarded.
   A block pair returns a spanning forest of its links.
4. Components of the links give the smallest doc_id that links reach.

The join is exact: candidate runs lose no pair, and the products decide.  Words and
shingles are told apart by 64-bit hashes, sets by their size and 112 bits.

Very long texts: whole, alone in their chunk.  Ties: the smallest doc_id names a
component, and rows of equal doc_id keep their own sets.  Null text or no words: empty set, linked with nothing, its own component.  Fewer
than 4 words: one shingle.  Repeated rows are linked copies.  Null doc_ids keep
their row and link others; a component of such rows alone has a null component_id.
An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, hashes, mix, parts, prepare, ragged, release, shared_dir, shingles, spans
from .components import components

RUN = 4
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1 << 18
FLUSH = 1 << 19
CODE = float(np.log(1.001))
BITS = 1 << 26  # of the filter that is broadcast: 8 MB


def prefix_lengths(most: int, percent: int, run: int = RUN) -> np.ndarray:
    """By set size: in how many of its smallest hashes a shared run must lie, whatever the partner's size."""
    s = np.arange(most + 1, dtype=np.int64)
    out = np.zeros(most + 1, np.int64)
    # the bound is largest at the ends of the partner's size range; one more on either side for rounding
    lo, hi = -(-percent * s // 100), 100 * s // percent
    for t in (lo, lo + 1, hi - 1, hi, s, s - 1, s + 1):
        t = np.clip(t, lo, hi)
        o = -(-percent * (s + t) // (100 + percent))
        out = np.maximum(out, (run - 1) * (s + t - 2 * o + 1) + 1 + (s - o))
    return np.minimum(out + 2, s)


@lru_cache
def short_prefixes(percent: int, run: int = RUN) -> dict[int, np.ndarray]:
    """By length of run below ``run``: the prefixes, by set size, of the sets with a partner that may share no longer run.

    With overlap o and d differing shingles a run of w is sure where o >= (w - 1)(d + 1) + 1;
    for w = ``run`` that holds for all sizes s + t from the limit on.
    """
    gain = run * percent - 100 * (run - 1)
    if gain <= 0:
        raise ValueError(f"{percent} %: runs of {run} need a similarity above {100 * (run - 1) / run} %")
    limit = run * (100 + percent) // gain + 1
    out: dict[int, np.ndarray] = {}
    for s in range(1, limit):
        for t in range(s, limit - s):
            o = -(-percent * (s + t) // (100 + percent))
            if o > s:
                break
            d = s + t - 2 * o
            w = min(run, (o - 1) // (d + 1) + 1)
            if w < run and d:
                prefix = out.setdefault(w, np.zeros(limit, np.int64))
                for n in (s, t):
                    prefix[n] = max(prefix[n], (w - 1) * (d + 1) + 1 + (n - o))
    return out


def run_keys(h: np.ndarray, number: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the runs that sets emit, and the set of each."""
    first = np.cumsum(number) - number
    keys, owners = [], []
    for run, prefix in ((RUN, prefix_lengths(int(number.max(initial=0)), percent)), *short_prefixes(percent).items()):
        inside = np.where(number < len(prefix), prefix[np.minimum(number, len(prefix) - 1)], 0)
        windows = np.maximum(0, inside - run + 1)
        at = ragged(first, windows)
        with np.errstate(over="ignore"):
            key = h[at] * np.uint64(3)
            for j in range(1, run):
                key += mix(h[at + j] + np.uint64(j))
        keys.append(mix(key))
        owners.append(np.repeat(np.arange(len(number)), windows))
    return np.concatenate(keys), np.concatenate(owners)


def document_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, and their number."""
    data = LOWER[data]
    starts, ends, words = spans(data, offsets)
    h, number = shingles(hashes(data, starts, ends), words, k)
    doc = np.repeat(np.arange(len(number)), number)
    order = np.lexsort((h, doc)) if len(h) else np.zeros(0, np.int64)
    h = h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.bincount(doc[keep], minlength=len(number))


def size_codes(number: np.ndarray) -> np.ndarray:
    """16 bits that grow with the size, in steps of a thousandth."""
    return np.floor(np.log(np.maximum(1, number)) / CODE).astype(np.uint64)


def signatures(h: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit values per set; the first one's low 16 bits are the size's code."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(salt)), dtype=np.uint64)])
        end = np.cumsum(number)
        with np.errstate(over="ignore"):
            out.append(mix(total[end] - total[end - number] + number.astype(np.uint64)))
    return (out[0] & ~np.uint64(0xFFFF) | size_codes(number)).view(np.int64), out[1].view(np.int64)


def _classes(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for rows, data, offsets in chunks(batches):
            h, number = document_sets(data, offsets, k)
            a, b = signatures(h, number)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(number.astype(np.int64)), pa.array(a), pa.array(b)], ["doc_id", "n", "a", "b"])

    return docs.mapInArrow(run, "doc_id long, n long, a long, b long")


def _runs(docs: DataFrame, k: int, percent: int, slots: int) -> DataFrame:
    """(slot, body): packed pairs of run hash and class; a slot holds a share of all runs.

    Of the classes of one size code that share a run, one goes on with the run; the
    others are linked to it here.  Such links (pairs of classes) have slots below 0.
    """

    def run(batches):
        release()
        seen: set[tuple[int, int]] = set()
        keys, owners, held = [], [], 0

        def flush():
            key, owner = np.concatenate(keys), np.concatenate(owners)
            order = np.lexsort((owner.view(np.uint64) & np.uint64(0xFFFF), key))
            key, owner = key[order], owner[order]
            code = owner.view(np.uint64) & np.uint64(0xFFFF)
            twice = np.zeros(len(key), bool)
            twice[1:] = (key[1:] == key[:-1]) & (code[1:] == code[:-1])
            link = np.flatnonzero(twice[1:] & (owner[1:] != owner[:-1]))
            if len(link):
                u, v = forest(owner[link], owner[link + 1])
                yield packed(-1 - (v % slots), np.column_stack([u, v]).view(np.uint64)[u != v], u != v)
            key, owner = key[~twice], owner[~twice].view(np.uint64)
            yield packed((key % np.uint64(slots)).astype(np.int64), np.column_stack([key, owner]))

        def packed(slot, pair, of=slice(None)):
            slot = slot[of]
            order = np.argsort(slot, kind="stable")
            slot, pair = slot[order], pair[order]
            first = np.flatnonzero(np.diff(slot, prepend=slots))
            cut = np.append(first, len(slot)).tolist()
            return pa.RecordBatch.from_arrays([pa.array(slot[first]), pa.array([pair[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())], ["slot", "body"])

        for _, data, offsets in chunks(batches):
            h, number = document_sets(data, offsets, k)
            a, b = signatures(h, number)
            new = np.zeros(len(a), bool)
            for j, x in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                if number[j] and x not in seen:
                    seen.add(x)
                    new[j] = True
            if not new.any():
                continue
            key, own = run_keys(h[np.repeat(new, number)], number[new], percent)
            keys.append(key)
            owners.append(a[new][own])
            held += len(key)
            if held >= FLUSH:
                yield from flush()
                keys, owners, held = [], [], 0
            if len(seen) > 1 << 19:
                seen.clear()
        if held:
            yield from flush()

    return docs.mapInArrow(run, "slot long, body binary")


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and roots (the least node of each component) of a graph."""
    nodes, back = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = back[: len(u)], back[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def shared_edges(key: np.ndarray, owner: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the owners of each key, cut where sizes next to each other are too far apart.

    In order of size, a gap wider than the threshold allows lets no pair across.
    """
    gap = np.log(100 / percent) / CODE + 1
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    many = np.zeros(len(key), bool)
    equal = key[1:] == key[:-1]
    many[1:] |= equal
    many[:-1] |= equal
    key, owner = key[many], owner[many]
    order = np.lexsort((owner, owner.view(np.uint64) & np.uint64(0xFFFF), key))
    key, owner = key[order], owner[order]
    code = (owner.view(np.uint64) & np.uint64(0xFFFF)).astype(np.int64)
    link = (key[1:] == key[:-1]) & (owner[1:] != owner[:-1]) & (np.diff(code) <= gap)
    return owner[:-1][link], owner[1:][link]


def _shared_runs(packed: DataFrame, percent: int) -> DataFrame:
    """packed: sorted by slot inside partitions.  One slot is in memory at a time; a task's links are merged before they leave."""

    def run(batches):
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        held, now, body = 0, None, []

        def close():
            pair = np.frombuffer(b"".join(body), np.uint64).reshape(-1, 2)
            if now < 0:
                us.append(pair[:, 0].view(np.int64))
                vs.append(pair[:, 1].view(np.int64))
                return len(us[-1])
            u, v = shared_edges(pair[:, 0].copy(), pair[:, 1].copy().view(np.int64), percent)
            if len(u):
                u, v = forest(u, v)
                us.append(u[u != v])
                vs.append(v[u != v])
            return len(us[-1])

        for b in batches:
            for slot, x in zip(b.column("slot").to_pylist(), b.column("body").to_pylist(), strict=True):
                if slot != now and body:
                    held += close()
                    body.clear()
                    if held > 1 << 19:
                        u, v = forest(np.concatenate(us), np.concatenate(vs))
                        us, vs, held = [u[u != v]], [v[u != v]], 0
                now = slot
                body.append(x)
        if body:
            close()
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], ["u", "v"])

    return packed.mapInArrow(run, "u long, v long")


def block_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (of ``left`` x ``right``) of sets that reach the threshold: a product of incidence matrices in column blocks."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), size)
    _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[col] > 1
    rank = np.cumsum(count > 1) - 1
    row, col = row[shared], rank[col[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    overlap = np.zeros((len(left), len(right)), np.float32)
    same = left is right
    total = int(col[-1]) + 1 if len(col) else 0
    for c in range(0, total, columns):
        x, y = np.searchsorted(col, [c, c + columns])
        m = np.zeros((len(sets), min(columns, total - c)), np.float32)
        m[row[x:y], col[x:y] - c] = 1
        part = m[left]
        overlap += part @ (part.T if same else m[right].T)
    n, k = size[left][:, None], size[right][None, :]
    o = overlap.astype(np.int64)
    ok = (100 * np.minimum(n, k) >= percent * np.maximum(n, k)) & (100 * o >= percent * (n + k - o))
    i, j = np.nonzero(ok)
    i, j = left[i], right[j]
    keep = i != j
    return i[keep], j[keep]


def _verify(blocks: DataFrame, percent: int) -> DataFrame:
    """blocks: key, side (0: both, 1, 2), id, body, sorted by key inside partitions."""

    def links(rows):
        reps = np.array([r[1] for r in rows], np.int64)
        _, first = np.unique(reps, return_index=True)
        rows, reps = [rows[k] for k in first], reps[first]
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        side = np.array([r[0] for r in rows])
        left = np.flatnonzero(side != 2)
        right = left if (side == 0).any() else np.flatnonzero(side == 2)
        if len(sets) > 1 and len(left) and len(right):
            i, j = block_links(sets, left, right, percent)
            if len(i):
                node, root = forest(reps[i], reps[j])
                out = node != root
                return node[out], root[out]
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def run(batches):
        now, rows, us, vs = None, [], [], []
        for b in batches:
            for key, *row in zip(*(b.column(c).to_pylist() for c in ("key", "side", "id", "body")), strict=True):
                if key != now:
                    if len(rows) > 1:
                        u, v = links(rows)
                        us.append(u)
                        vs.append(v)
                    now, rows = key, []
                rows.append(row)
        if len(rows) > 1:
            u, v = links(rows)
            us.append(u)
            vs.append(v)
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return blocks.mapInArrow(run, "u long, v long")


def _filter(ids: DataFrame, n: int) -> np.ndarray:
    """BITS bits, set where some id's hash falls: a filter of fixed size that lets every id pass."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            bit = b.column("bit").to_numpy(zero_copy_only=False)
            block = bit >> 16
            for k in np.unique(block).tolist():
                held.setdefault(k, np.zeros(1 << 16, bool))[bit[block == k] & 0xFFFF] = True
        for k, x in held.items():
            yield pa.RecordBatch.from_pydict({"block": [k], "body": [np.packbits(x).tobytes()]})

    bit = F.pmod(F.xxhash64("rep"), F.lit(BITS))
    rows = ids.select(bit.alias("bit"), F.shiftright(bit, 16).alias("block")).repartition(n, "block")
    out = np.zeros(BITS // 8, np.uint8).reshape(-1, 1 << 13)
    for r in rows.mapInArrow(run, "block long, body binary").toLocalIterator():
        out[r["block"]] |= np.frombuffer(r["body"], np.uint8)
    return out.ravel()


def _bodies(docs: DataFrame, k: int, wanted: np.ndarray) -> DataFrame:
    """(a, b, body): the sets of the documents whose id passes the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def passing(batches):
        bits = shared.value
        for b in batches:
            at = b.column("bit").to_numpy(zero_copy_only=False)
            yield b.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))

    def run(batches):
        for batch, data, offsets in chunks(passing(batches)):
            h, number = document_sets(data, offsets, k)
            a, b = signatures(h, number)
            cut = np.concatenate([[0], np.cumsum(number)]).tolist()
            body = pa.array([h[x:y].tobytes() for x, y in zip(cut, cut[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), body], ["a", "b", "body"])

    return docs.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).alias("bit")).mapInArrow(run, "a long, b long, body binary")


def _block_keys(members: DataFrame, percent: int) -> DataFrame:
    """(a, b, named, id, keys): the block pairs that each class meets others in."""
    step = float(np.log(100 / percent))
    members = members.withColumn("bin", F.floor(F.log(F.col("n")) / step).cast("int"))
    per_bin = members.groupBy("cluster", "bin").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("n") / BLOCK_SHINGLES)).cast("int")
    info = per_bin.withColumn("blocks", blocks).groupBy("cluster").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n"), F.map_from_entries(F.collect_list(F.struct("bin", "blocks"))).alias("of")).checkpoint()
    rows = members.select("a", "b", "named", "id", "bin", "cluster").join(info, "cluster")
    row = F.struct
    mine = F.pmod(F.xxhash64("b"), F.col("of")[F.col("bin")]).cast("int")
    span = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    name = lambda *x: F.concat_ws("/", F.col("cluster").cast("string"), *[y.cast("string") for y in x])
    b = F.col("bin")  # classes of one bin may meet those of the next
    same = F.transform(span(F.col("of")[b]), lambda r: row(name(b, F.least(r, F.col("r")), b, F.greatest(r, F.col("r"))).alias("key"), F.when(r == F.col("r"), 0).when(F.col("r") < r, 1).otherwise(2).alias("side")))
    up = F.transform(span(F.col("of")[b + 1]), lambda r: row(name(b, F.col("r"), b + 1, r).alias("key"), F.lit(1).alias("side")))
    down = F.transform(span(F.col("of")[b - 1]), lambda r: row(name(b - 1, r, b, F.col("r")).alias("key"), F.lit(2).alias("side")))
    whole = F.array(row(name(F.lit("all")).alias("key"), F.lit(0).alias("side")))
    kind = "array<struct<key:string,side:int>>"
    keys = F.when((F.col("docs") <= BLOCK_DOCS) & (F.col("all_n") <= BLOCK_SHINGLES), whole.cast(kind)).otherwise(F.concat(same.cast(kind), up.cast(kind), down.cast(kind)))
    return rows.withColumn("r", mine).select("a", "b", "named", "id", keys.alias("keys"))


def similar_components(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    spark = prepare(docs.sparkSession)
    n = parts(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = _classes(docs, k).checkpoint()
    classes = sets.where("n > 0").groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep")).checkpoint()

    # many slots, so that each is small; a task merges the links of its slots
    packed = _runs(docs, k, percent, 8 * n).repartition(n, "slot").sortWithinPartitions("slot")
    edges = _shared_runs(packed, percent)
    cluster = components(edges.checkpoint())
    roots = cluster.select(F.col("root").alias("a")).distinct().select("a", F.col("a").alias("cluster"))
    member = cluster.select(F.col("node").alias("a"), F.col("root").alias("cluster")).union(roots)
    # candidates go by the first signature; from here on a class is told apart by both, under a number of its own
    members = member.join(classes, "a").select("a", "b", "n", "rep", "cluster", F.col("rep").isNotNull().alias("named"), F.monotonically_increasing_id().alias("id")).checkpoint()

    place = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    wanted = _filter(members, n)
    # a class's set comes from its representative; of a class whose rows all lack an id any row's does
    named = _bodies(docs.where("doc_id is not null"), k, wanted).withColumn("named", F.lit(True))
    nameless = _bodies(docs.where("doc_id is null"), k, wanted).dropDuplicates(["a", "b"]).withColumn("named", F.lit(False))
    named.union(nameless).join(_block_keys(members, percent), ["a", "b", "named"]).write.parquet(place)
    blocks = spark.read.parquet(place).select("id", "body", F.explode("keys").alias("x")).select(F.col("x.key").alias("key"), F.col("x.side").alias("side"), "id", "body")
    links = _verify(blocks.repartition(n, "key").sortWithinPartitions("key"), percent)
    joined = components(links.checkpoint()).select(F.col("node").alias("id"), "root")

    rooted = members.join(joined, "id", "left").select("a", "b", "n", "rep", F.coalesce("root", "id").alias("root")).checkpoint()
    least = rooted.groupBy("root").agg(F.min("rep").alias("component")).checkpoint()
    found = rooted.join(least, "root").select("a", "b", "n", "component")
    found = classes.join(found, ["a", "b", "n"], "left").select("a", "b", "n", F.coalesce("component", "rep").alias("component")).checkpoint()
    return sets.join(found, ["a", "b", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
