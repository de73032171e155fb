"""Embedding whitening over an exact scatter, kept in residues.

Entries become integers x.  Every partition multiplies its rows, with a column of
ones beside them, modulo several primes: residues lie within half a prime around zero
and at most ``BLOCK`` rows are multiplied at a time, so a float64 product stays below
2 ** 53 and is exact.  Residues of a partition are kept modulo the prime; Spark adds them
up by matrix entry.  As many primes are taken as the bound n * max|x| ** 2 asks for,
so Chinese remaindering gives back the exact sums, counts and products of all rows,
whatever their order and partitions.  The covariance is that of exact integers,
rounded once, and a symmetric eigendecomposition in doubles gives the components.

What passes through the driver grows with the square of the dimension, not with rows.

Rows whose vector is null or empty, or has null or non-finite entries, are left out, as are
vectors of another length than the commonest one (of equally common ones the
longest).  Entries whose x lies beyond 2 ** 62 count as 2 ** 62.  Components without variance
(up to rounding) have null ``whitened`` and don't enter ``identity_error``; without any variance
``explained`` is null.  ``deviation`` is null where its exact value exceeds a long;
``deviation_wide`` holds it up to 38 digits.  Null and repeated ids, repeated rows and ties of
eigenvalues are kept (the vectors of equal eigenvalues are any base); an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, release, written

SCALE, SHIFT, TOP = 1024.0, 100_000, 1 << 62
COMPONENTS = 8
LARGEST = 1 << 20  # primes lie below
BLOCK = 1 << 14  # rows of one product: BLOCK * (LARGEST / 2) ** 2 < 2 ** 53


def primes(product: int, below: int = LARGEST) -> list[int]:
    """The largest primes under ``below`` whose product exceeds ``product``."""
    out, left, p = [], product, below - 1
    while left > 0:
        if all(p % d for d in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
            left //= p
        p -= 2
    return out


def vectors(column: pa.Array, size: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose entries are all finite numbers (of ``size`` entries, where given), their lengths and all their entries."""
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
    first = np.cumsum(lengths) - lengths
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (lengths > 0) & (bad[first + lengths] == bad[first])
    if size is not None:
        good &= lengths == size
    return np.flatnonzero(good), lengths[good], values[np.repeat(good, lengths)]


def integers(values: np.ndarray) -> np.ndarray:
    """floor(1024 * c) + 100000, held within 2 ** 62."""
    with np.errstate(over="ignore"):
        whole = np.floor(values * SCALE)
    out = np.full(len(values), TOP, np.int64)
    near = np.abs(whole) < TOP - 2 * SHIFT
    out[near] = whole[near].astype(np.int64) + SHIFT
    out[~near & (whole < 0)] = -TOP
    return out


def residue_products(x: np.ndarray, moduli: list[int]) -> list[np.ndarray]:
    """x' x modulo each prime, with a column of ones after the columns of x."""
    out = []
    for p in moduli:
        total = np.zeros((x.shape[1] + 1,) * 2, np.int64)
        for at in range(0, len(x), BLOCK):
            part = x[at : at + BLOCK] % p
            part = np.hstack([np.where(part > p // 2, part - p, part), np.ones((len(part), 1), np.int64)]).astype(np.float64)
            total = (total + (part.T @ part).astype(np.int64)) % p
        out.append(total)
    return out


def remaindered(residues: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The integers of least size with these residues (Chinese remaindering), as Python integers."""
    whole = 1
    for p in moduli:
        whole *= p
    total = 0
    for r, p in zip(residues, moduli, strict=True):
        rest = whole // p
        total = total + (r % p).astype(object) * (rest * pow(rest, -1, p))
    total = total % whole
    return np.where(total > whole // 2, total - whole, total)


@dataclass(frozen=True)
class Whitener:
    """Exact sums of n vectors and their leading components."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray  # dimension x components, unit columns
    values: np.ndarray  # eigenvalues, falling
    trace: float
    top: int  # no |x| exceeds it

    @property
    def live(self) -> np.ndarray:
        return self.values > (self.values.max(initial=0.0)) * len(self.sums) * 2.0**-50

    def _widest(self) -> int:
        return self.n * self.top + max(abs(s) for s in self.sums)

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """(n * x - S) / n in doubles, and the exact sums of squares of n * x - S."""
        if self._widest() < 1 << 62:
            d = x * self.n - np.array(self.sums, np.int64)
            most = int(np.abs(d).max(initial=0))
            square = (d * d).sum(1).tolist() if len(self.sums) * most * most < 1 << 63 else [sum(v * v for v in row) for row in d.tolist()]
            return d / self.n, square
        d = x.astype(object) * self.n - np.array(self.sums, object)
        return (d / self.n).astype(np.float64), [sum(v * v for v in row) for row in d.tolist()]


def sizes(rows: DataFrame) -> tuple[int, int, int] | None:
    """Dimension, number of vectors and largest |x| of what is fitted."""

    def run(batches):
        release()
        seen: dict[int, list[int]] = {}
        for batch in batches:
            _, lengths, values = vectors(batch.column("embedding"))
            x = np.abs(integers(values))
            first = np.cumsum(lengths) - lengths
            tops = np.maximum.reduceat(x, first) if len(lengths) else x
            for d in np.unique(lengths).tolist():
                own = lengths == d
                was = seen.setdefault(d, [0, 0])
                was[0] += int(own.sum())
                was[1] = max(was[1], int(tops[own].max()))
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([seen[k][0] for k in keys], pa.int64()), pa.array([seen[k][1] for k in keys], pa.int64())], ["size", "n", "top"])

    by_size = rows.select("embedding").mapInArrow(run, "size long, n long, top long").groupBy("size").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    row = by_size.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    return (row[0]["size"], row[0]["n"], row[0]["top"]) if row else None


def scatter(rows: DataFrame, size: int, moduli: list[int]) -> np.ndarray:
    """The exact matrix of products of all vectors of ``size`` entries and a one, as Python integers."""
    names = [f"r{k}" for k in range(len(moduli))]
    a, b = np.triu_indices(size + 1)

    def run(batches):
        release()
        total, held, waiting = None, [], 0

        def add():
            own = residue_products(np.concatenate(held), moduli)
            return own if total is None else [(t + o) % p for t, o, p in zip(total, own, moduli, strict=True)]

        for batch in batches:
            _, lengths, values = vectors(batch.column("embedding"), size)
            if len(lengths):
                held.append(integers(values).reshape(-1, size))
                waiting += len(lengths)
            if waiting >= BLOCK:
                total, held, waiting = add(), [], 0
        if held:
            total = add()
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *[pa.array(t[a, b]) for t in total]], ["i", "j", *names])

    kinds = "i long, j long, " + ", ".join(f"{c} long" for c in names)
    added = rows.select("embedding").mapInArrow(run, kinds).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names]).orderBy("i", "j").toPandas()
    exact = remaindered([added[c].to_numpy() for c in names], moduli)
    out = np.zeros((size + 1, size + 1), object)
    out[a, b] = exact
    out[b, a] = exact
    return out


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """The whitener of all vectors; rows: embedding array<double>."""
    found = sizes(rows)
    if found is None:
        return None
    size, n, top = found
    exact = scatter(rows, size, primes(2 * n * max(top, 1) ** 2 + 1))
    sums = exact[-1, :-1]
    if exact[-1, -1] != n:
        raise RuntimeError("the table changed while it was read")
    wide = n * exact[:-1, :-1] - np.multiply.outer(sums, sums)
    covariance = (wide / (n * n)).astype(np.float64)  # quotients of integers, rounded once
    values, axes = np.linalg.eigh(covariance)
    best = np.argsort(-values, kind="stable")[: min(components, size)]
    axes = axes[:, best]
    sign = np.sign(axes[np.abs(axes).argmax(0), np.arange(len(best))])
    return Whitener(n, tuple(int(s) for s in sums), axes * sign, values[best], int(np.trace(wide)) / (n * n), top)


def project(rows: DataFrame, model: Whitener) -> DataFrame:
    """(vec_id, deviation, deviation_wide, whitened array) of every vector of the model's length."""
    live = model.live
    turn = model.axes[:, live] / np.sqrt(model.values[live])
    size = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]):
        release()
        for batch in batches:
            at, _, values = vectors(batch.column("embedding"), size)
            away, square = model.deviations(integers(values).reshape(-1, size))
            out = np.full((len(at), len(live)), np.nan)
            out[:, live] = away @ turn
            flat = pa.array(out.ravel(), from_pandas=True)
            white = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * len(live), pa.int32()), flat)
            short = pa.array([v if v < 1 << 63 else None for v in square], pa.int64())
            wide = short.cast(pa.decimal128(38, 0)) if not short.null_count else pa.array([Decimal(v) if v < 10**38 else None for v in square], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), short, wide, white], ["vec_id", "deviation", "deviation_wide", "whitened"])

    return rows.mapInArrow(run, "vec_id long, deviation long, deviation_wide decimal(38,0), whitened array<double>")


def identity_error(white: DataFrame, live: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    w = lambda k: F.col("whitened")[k]
    if not live:
        return 0.0
    mean = white.agg(*[F.avg(w(k)) for k in range(live)]).first()
    pairs = [(i, j) for i in range(live) for j in range(i + 1)]
    got = white.agg(*[F.avg((w(i) - mean[i]) * (w(j) - mean[j])) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(got, pairs, strict=True))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error, deviation_wide.

    Projections are written once to the shared folder, so that the reported error is that of the returned values.
    """
    spark = prepare(rows.sparkSession)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    model = fit(rows, components)
    if model is None:
        kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_wide decimal(38,0)"
        return spark.createDataFrame([], kinds)
    white = written(project(rows, model), "whitened")
    error = identity_error(white, int(model.live.sum()))
    share = F.array(*[F.lit(float(v / model.trace) if model.trace else None).cast("double") for v in np.maximum(model.values, 0.0)])
    return white.select("vec_id", "deviation", "deviation_wide", F.posexplode("whitened").alias("k", "white")).select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("white").alias("whitened"),
        share[F.col("k")].alias("explained"), F.lit(error).alias("identity_error"), "deviation_wide",
    )
