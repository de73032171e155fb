"""Column functions on sequences and coordinates.  Motif expansion happens once, when a plan is built."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The letters a wildcard stands for, and the complements.
WILDCARD, LETTERS = "N", "ATCG"
FROM, TO = "ATCGNatcgn", "TAGCNtagcn"


def expand_motif(motifs: str, wildcard: str = WILDCARD, letters: str = LETTERS, keep_case: bool = False) -> list[str]:
    """Concrete motifs of a comma list in which each wildcard stands for every letter."""
    out: list[str] = []
    for motif in (m.strip() for m in motifs.split(",")):
        motif = motif if keep_case else motif.upper()
        found = [""]
        for c in motif:
            found = [p + x for p in found for x in (letters if c == wildcard else c)]
        out += found if motif else []
    return out


def count_motifs(seq: Column, motifs: list[str]) -> Column:
    """Non-overlapping occurrences of each motif, added up; overlapping motifs are counted independently."""
    return reduce(lambda a, b: a + b, [F.regexp_count(seq, F.lit(re.escape(m))) for m in motifs], F.lit(0)).cast("long")


def flank_count(seq: Column, length: Column, flank: int, motifs: list[str]) -> Column:
    """Motifs of both ends (of the whole sequence where the ends meet), plus one."""
    ends = count_motifs(F.substring(seq, 1, flank), motifs) + count_motifs(F.substring(seq, length - flank + 1, F.lit(flank)), motifs)
    return F.when(length <= 2 * flank, count_motifs(seq, motifs)).otherwise(ends) + 1


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, FROM, TO))


def kmers(rows: DataFrame, k: int, seq: str = "seq", skip: str = WILDCARD, canonical: bool = True) -> DataFrame:
    """One row per k-mer (start from 0, kmer) and the other columns; those with the skipped letter are left out."""
    # two levels, as taking a piece from a string costs its distance from the start
    block = 256
    long = rows.where(F.length(seq) >= k).withColumn("_n", F.length(seq) - k + 1)
    long = long.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / block).cast("int"))).alias("_b"))
    long = long.withColumn("_part", F.substring(F.col(seq), F.col("_b") * block + 1, F.lit(block + k - 1))).drop(seq)
    out = long.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(block - 1), F.col("_n") - 1 - F.col("_b") * block))).alias("_i"))
    out = out.withColumn("start", F.col("_b") * block + F.col("_i")).withColumn("kmer", F.substring(F.col("_part"), F.col("_i") + 1, F.lit(k))).drop("_n", "_b", "_part", "_i")
    if skip:
        out = out.where(~F.col("kmer").contains(skip))
    return out.withColumn("kmer", F.least("kmer", reverse_complement(F.col("kmer")))) if canonical else out


PIECE = 1 << 21  # k-mers that a task holds at once


def _pieces(batch: pa.RecordBatch, seq: str, k: int) -> Iterator[list[tuple[int, int, str]]]:
    """Lists of (row, start, piece), about ``PIECE`` characters in all; pieces of a long text overlap by k - 1."""
    held, size = [], 0
    for row, text in enumerate(batch.column(seq).to_pylist()):
        for start in range(0, len(text or "") - k + 1, PIECE):
            piece = text[start : start + PIECE + k - 1]
            if held and size + len(piece) > PIECE:
                yield held
                held, size = [], 0
            held.append((row, start, piece))
            size += len(piece)
    if held:
        yield held


def _codes(letters: np.ndarray, k: int, n: int, turned: bool = False) -> np.ndarray:
    """Numbers of all k-mers in the order of their letters (numbers below n); turned: from the last letter to the first."""
    m = len(letters) - k + 1
    code = np.zeros(m, np.int64)
    for t in reversed(range(k)) if turned else range(k):
        code *= n
        code += letters[t : t + m]
    return code


def _ranks(letters: np.ndarray, flipped: np.ndarray | None, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The same where a number would be too large: ranks of the k-mers or their reverse complements, and the letters of each rank."""
    at = np.arange(len(letters) - k + 1)[:, None]
    sides = letters[at + np.arange(k)]
    if flipped is not None:
        sides = np.concatenate([sides, flipped[at + np.arange(k)[::-1]]])
    code = np.zeros(len(sides), np.int64)
    for t in range(k):
        code = np.unique(code * n + sides[:, t], return_inverse=True)[1]
    _, first = np.unique(code, return_index=True)
    return (np.minimum(code[: len(at)], code[len(at) :]) if flipped is not None else code), sides[first]


def counted_kmers(rows: DataFrame, k: int, by: list[str] = (), size: int | None = None, seq: str = "seq", skip: str = WILDCARD, canonical: bool = True) -> DataFrame:
    """(by, kmer, cnt) of the rows of ``kmers``; with ``size`` also ``bin``, the start over it.

    A task counts the k-mers of some megabytes of text at once and passes on a row for each different one,
    so a k-mer and its group come in several rows that add up.
    """
    by = list(by)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]):
        number, other = np.zeros(0x110000, np.int32), np.arange(0x110000, dtype=np.int32)
        other[[ord(c) for c in FROM]] = [ord(c) for c in TO]
        for batch in batches:
            found: dict[tuple, int] = {}
            group = np.array([found.setdefault(v, len(found)) for v in zip(*[batch.column(c).to_pylist() for c in by], strict=True)] if by else [0] * batch.num_rows, np.int64)
            one = {g: row for row, g in enumerate(group.tolist())}  # a row of each group
            for held in _pieces(batch, seq, k):
                points = np.frombuffer("".join(p for _, _, p in held).encode("utf-32-le"), np.uint32)
                lengths = np.array([len(p) for _, _, p in held])
                own = lengths - k + 1  # k-mers of each piece
                at = np.arange(own.sum()) + np.repeat(np.cumsum(lengths) - lengths - np.cumsum(own) + own, own)
                place = np.repeat(group[np.array([r for r, _, _ in held])], own)
                if size:
                    begin = np.arange(len(at)) - np.repeat(np.cumsum(own) - own - np.array([s for _, s, _ in held]), own)
                    wide = int(begin.max()) // size + 1
                    place = place * wide + begin // size
                if skip:
                    seen = np.concatenate([[0], np.cumsum(points == ord(skip))])
                    kept = seen[at + k] == seen[at]
                    at, place = at[kept], place[kept]
                if not len(at):
                    continue
                alphabet = np.unique(np.concatenate([np.flatnonzero(np.bincount(points)), [ord(c) for c in TO]]))
                n = len(alphabet)
                number[alphabet] = np.arange(n)
                letters, flipped = number[points], number[other[points]] if canonical else None
                if n**k * (int(place.max()) + 1) < 1 << 62:
                    code, shown, most = _codes(letters, k, n), None, n**k
                    code = np.minimum(code, _codes(flipped, k, n, True)) if canonical else code
                else:
                    code, shown = _ranks(letters, flipped, k, n)
                    most = len(shown)
                cells, cnt = np.unique(place * most + code[at], return_counts=True)
                names, where = np.unique(cells % most, return_inverse=True)
                shown = shown[names] if shown is not None else names[:, None] // n ** np.arange(k)[::-1] % n
                text = alphabet[shown].astype("<u4").tobytes().decode("utf-32-le")
                kmer = pa.array([text[i : i + k] for i in range(0, len(text), k)], pa.string()).take(pa.array(where))
                place = cells // most
                row = pa.array(np.array([one[g] for g in range(len(one))])[place // wide if size else place])
                columns = [batch.column(c).take(row) for c in by] + ([pa.array(place % wide)] if size else []) + [kmer, pa.array(cnt.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, [*by, *(["bin"] if size else []), "kmer", "cnt"])

    head = "".join(f"{c} {kinds[c]}, " for c in by) + ("bin long, " if size else "")
    return rows.select(*by, seq).mapInArrow(run, f"{head}kmer string, cnt long")


def bin_number(position: Column, size: int) -> Column:
    """1-based bin of a 1-based position."""
    return F.ceil(position / size).cast("long")


def bin_offset(position: Column, size: int) -> Column:
    return position - (bin_number(position, size) - 1) * size


def half(position: Column, length: Column) -> Column:
    """``H`` or ``T``: the half of its contig that a 1-based position is in."""
    return F.when(position * 2 > length, "T").otherwise("H")


def is_flank(position: Column, length: Column, flank: int) -> Column:
    return F.lit(True) if not flank else (position <= flank) | (position > length - flank)


def orientation_distances(x: Column, y: Column, li: Column, lj: Column) -> Column:
    """The four (orientation, distance) of a contact at 0-based x of i and y of j."""
    rows = (("++", li - x + y), ("+-", li - x + lj - y), ("-+", x + y), ("--", x + lj - y))
    return F.array(*[F.struct(F.lit(o).alias("ori"), d.cast("long").alias("dist")) for o, d in rows])


def split_sequence(contigs: DataFrame, size: int) -> DataFrame:
    """Bins of contigs longer than ``size`` (the last is the remainder); shorter ones are their own fragment."""
    n = F.when(F.col("len") > size, F.ceil(F.col("len") / size)).otherwise(1).cast("int")
    rows = contigs.withColumn("n_bins", n).select("*", F.explode(F.sequence(F.lit(1), F.col("n_bins"))).alias("bin_no"))
    split = F.col("n_bins") > 1
    return rows.withColumn("frag_len", F.when(split, F.least(F.lit(size), F.col("len") - (F.col("bin_no") - 1) * size)).otherwise(F.col("len")).cast("long")).withColumn("frag", F.when(split, F.concat_ws("_bin", F.col("ctg").cast("string"), F.col("bin_no").cast("string"))).otherwise(F.col("ctg").cast("string")))


def auto_bin_size(total: Column, groups: int, least: int = 100_000, most: int = 2_000_000, per_group: int = 30) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), F.floor(total / groups / per_group))).cast("long")


def parse_threshold(name: str, value: str, suffix: str = "X") -> tuple[float, str]:
    """``1.5X`` is a multiple of a mean, a plain number a fraction in [0, 1]."""
    text = value.strip()
    many = text[-1:].upper() == suffix
    try:
        number = float(text[:-1] if many else text)
    except ValueError as e:
        raise ValueError(f"{name}: {value!r} is no number or multiple") from e
    if number < 0 or (not many and number > 1):
        raise ValueError(f"{name}: {value!r} is out of range")
    return number, "multiple" if many else "fraction"


def detect_format(path: str) -> str:
    for end, kind in ((".bam", "bam"), (".sam", "sam"), (".pairs.gz", "bgzipped_pairs"), (".pairs", "pairs")):
        if path.lower().endswith(end):
            return kind
    raise ValueError(f"{path}: the format can't be told from the name")
