"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The fit list, each distinct vector once, is written as a table and read by every
pass; no pass moves a vector. A pass multiplies the covariance by a block of `b`
columns, V Q = X'(X Q) / n over centred rows: each task gives one row for each
dimension, SUMMERS tasks add these up, and the driver adds what they give, d x b numbers each.

* A few Lanczos steps bound the spectrum from below. A cycle filters the block by a Chebyshev
  polynomial of V, a pass for each degree. Between that bound and the least Ritz value of the
  block it is small, above it grows as fast as any polynomial can, so the unwanted spectrum is damped.
* QR makes the block orthonormal, and Rayleigh-Ritz rotates it to approximate eigenvectors. Where eigenvalues
  differ by large factors, leading pairs that are done stay in the block but out of the filter.
* It ends once certified: the residual |V q - e q| of every wanted pair is at most
  `TOLERANCE` of the largest eigenvalue, or no longer falls because rounding is all that is
  left (below `FLOOR`). Then the largest Ritz value of fresh random columns, orthogonal to
  all that was found and filtered in the same way, must not exceed the wanted ones, or the
  iteration goes on with them in the block.

Where the block would hold all dimensions, one Rayleigh-Ritz pass is exact and
nothing is filtered.

Entries become whole numbers x = floor(scale * c) + shift. Sums, counts, the trace and the
deviations are exact whole numbers; rows are centred by them before they are multiplied.

Defined results: rows whose vector is NULL, empty, or holds NULL or non-finite entries are
left out, as are rows of another length than the commonest (the longer of equally common ones).
Repeated rows stay and get equal values, but count once in the fit. Entries beyond
2 ** 52 after scaling stand at that bound. Components whose eigenvalue is no more than
rounding (a constant table, fewer distinct rows than components) are not returned, so a table
may have none. A deviation beyond the range of a long is NULL. Extra columns are kept, taken result
names are refused. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.llm import vectors as V
from statloom.llm.common import Scratch, fresh, quoted

#: Degree of a cycle's polynomial, and the cycles after which a result that is not certified is refused.
DEGREE, MOST_CYCLES = 10, 200
#: Lanczos steps that bound the spectrum from below.
LANCZOS = 6
#: Residuals of certified pairs, in shares of the largest eigenvalue, and those that may stall.
TOLERANCE, FLOOR = 2e-15, 1e-12
#: Logarithm of the filter's growth beyond which pairs that are done stay out of it.
MOST_GROWTH = 30.0
#: Tasks that add up the products of all others.
SUMMERS = 8
#: Numbers that are multiplied at a time.
PIECE = 1 << 20
#: Entries are bounded by this after scaling.
BOUND = 2.0**52


@dataclass
class Whitening:
    """Mean, components (one a column) and eigenvalues of a fit list, largest first."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    components: np.ndarray
    identity_error: float
    scale: float
    shift: int
    passes: int = 0

    def transform(self, df: DataFrame, vector: str = "embedding", whitened: str = "whitened", deviation: str = "deviation") -> DataFrame:
        """Rows that can be whitened, with their `whitened` components and exact `deviation`."""
        for name in (whitened, deviation):
            if name.lower() in {c.lower() for c in df.columns}:
                raise ValueError(f"column {name!r} is there already; choose another result name")
        d = len(self.sums)
        (held,) = fresh(df, "_x")
        rows = df.where(V.usable(vector)).where(F.size(quoted(vector)) == d).withColumn(held, whole(vector, self.scale, self.shift))
        added = [T.StructField(whitened, T.ArrayType(T.DoubleType())), T.StructField(deviation, T.LongType())]
        n, sums, mean = self.n, self.sums, _mean(self.n, self.sums)
        to = self.components / np.sqrt(self.values)
        names = [*df.columns, whitened, deviation]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(batch.num_columns - 1).flatten().to_numpy().reshape(-1, max(1, d))
                z = _centred(x, mean) @ to
                offsets = pa.array(np.arange(len(x) + 1) * z.shape[1], pa.int32())
                columns = [pa.ListArray.from_arrays(offsets, pa.array(z.ravel())), pa.array(deviations(x, n, sums), pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=names)

        return rows.mapInArrow(add, T.StructType([*df.schema.fields, *added]))


def whole(vector: str, scale: float, shift: int) -> Column:
    """The entries as whole numbers."""

    def entry(c: Column) -> Column:
        return F.floor(F.greatest(F.least(c.cast("double") * F.lit(scale), F.lit(BOUND)), F.lit(-BOUND))).cast("long") + F.lit(shift).cast("long")

    return F.transform(F.col(quoted(vector)), entry)


def _mean(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Means as whole numbers and what is left of them, each exact or rounded once."""
    parts = [divmod(s, max(1, n)) for s in sums]
    return np.array([q for q, _ in parts], np.int64), np.array([float(Fraction(r, max(1, n))) for _, r in parts])


def _centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (x - mean[0]).astype(np.float64) - mean[1]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """For each row the exact sum of (n * x - S) ** 2; None beyond the range of a long."""
    mean = [s // max(1, n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, mean)]
    near = x - np.array(mean, np.int64)
    if (n * (int(np.abs(near).max(initial=0)) + 1)) ** 2 * max(1, x.shape[1]) < 1 << 63:
        gap = n * near - np.array(rest, np.int64)
        return (gap * gap).sum(axis=1).tolist()
    out = [sum((n * a - r) ** 2 for a, r in zip(row, rest)) for row in near.tolist()]
    return [v if v < 1 << 63 else None for v in out]


def _pieces(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        x = batch.column(0).flatten().to_numpy().reshape(-1, d)
        step = max(1, PIECE // d)
        for i in range(0, len(x), step):
            yield x[i : i + step]


def _added(rows: DataFrame, d: int, width: int, product: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of `product` (piece -> height x width), height by the length of what it gives."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _pieces(batches, d):
            total = product(x) if total is None else total + product(x)
        if total is not None:
            yield _row_batch(np.arange(len(total), dtype=np.int32), total)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).flatten().to_numpy().reshape(-1, width)):
                held[i] = held[i] + v if i in held else v.copy()
        if held:
            yield _row_batch(np.array(list(held), np.int32), np.array(list(held.values())))

    schema = "i int, v array<double>"
    found: dict[int, np.ndarray] = {}
    for r in rows.mapInArrow(partial, schema).repartition(SUMMERS).mapInArrow(sums, schema).collect():
        found[r["i"]] = found.get(r["i"], 0) + np.array(r["v"])
    return np.array([found[i] for i in sorted(found)]).reshape(-1, width)


def _row_batch(place: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(place), pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows, np.float64).ravel()))], names=["i", "v"])


class Covariance:
    """V of a table of distinct whole-number vectors, known only by what it does to a block."""

    def __init__(self, rows: DataFrame, d: int, n: int, sums: list[int]) -> None:
        self.rows, self.d, self.n, self.mean, self.passes = rows, d, n, _mean(n, sums), 0

    def times(self, block: np.ndarray) -> np.ndarray:
        self.passes += 1
        mean = self.mean

        def product(x: np.ndarray) -> np.ndarray:
            y = _centred(x, mean)
            return y.T @ (y @ block)

        return _added(self.rows, self.d, block.shape[1], product) / self.n

    def of(self, to: np.ndarray) -> np.ndarray:
        """The covariance of the rows' projections."""
        mean, k = self.mean, to.shape[1]

        def product(x: np.ndarray) -> np.ndarray:
            z = np.hstack([_centred(x, mean) @ to, np.ones((len(x), 1))])
            return z.T @ z

        whole_ = _added(self.rows, self.d, k + 1, product) / self.n
        return whole_[:k, :k] - np.outer(whole_[:k, k], whole_[k, :k])


def filtered(times: Callable[[np.ndarray], np.ndarray], block: np.ndarray, low: float, cut: float, top: float, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of V times the block: small on [low, cut], one at `top`."""
    middle, half = (cut + low) / 2, (cut - low) / 2
    sigma = half / (top - middle)
    first = sigma
    before, now = block, (times(block) - middle * block) * (sigma / half)
    for _ in range(degree - 1):
        sigma_next = 1 / (2 / first - sigma)
        before, now = now, (times(now) - middle * now) * (2 * sigma_next / half) - sigma * sigma_next * before
        sigma = sigma_next
    return now


def growth(low: float, cut: float, top: float, degree: int) -> float:
    """The logarithm of how much more the filter makes of `top` than of `cut`."""
    return float(degree * np.arccosh(max(1.0, (2 * top - cut - low) / (cut - low))))


def least_bound(times: Callable[[np.ndarray], np.ndarray], d: int, draw: np.random.Generator) -> float:
    """A bound below the spectrum by Lanczos steps: the least Ritz value less the last residual, 0 at least.

    What lay below it would be filtered less, which costs passes but no certainty.
    """
    q = draw.normal(size=(d, 1))
    q, base, diagonal, beside = q / np.linalg.norm(q), [], [], []
    for _ in range(min(LANCZOS, d)):
        base.append(q)
        r = times(q)
        diagonal.append(float((q.T @ r).item()))
        held = np.hstack(base)
        for _ in range(2):
            r = r - held @ (held.T @ r)
        beside.append(float(np.linalg.norm(r)))
        if beside[-1] <= 1e-12 * max(map(abs, diagonal)):
            return max(0.0, 0.5 * float(np.linalg.eigvalsh(np.diag(diagonal) + np.diag(beside[:-1], 1) + np.diag(beside[:-1], -1))[0]))
        q = r / beside[-1]
    ritz = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(beside[:-1], 1) + np.diag(beside[:-1], -1))
    return max(0.0, float(ritz[0]) - beside[-1])


def largest_pairs(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The `k` largest eigenvalues and their eigenvectors of the matrix behind `times`."""
    draw = np.random.default_rng(seed)
    b = min(d, 3 * k)
    low = 0.0 if b == d else least_bound(times, d, draw)
    values, block, residuals = _ritz(times, draw.normal(size=(d, b)))
    best, probed = np.inf, b == d
    done, least = 0, np.full(k, np.inf)
    for _ in range(MOST_CYCLES):
        top = max(values[0], 0.0)
        worst = residuals[:k].max(initial=0)
        settled = (residuals[:k] <= TOLERANCE * top) | ((residuals[:k] <= FLOOR * top) & (residuals[:k] > 0.5 * least))
        done, least = max(done, int(np.append(settled, False).argmin())), np.minimum(least, residuals[:k])
        if b == d or top == 0 or worst <= TOLERANCE * top or (worst <= FLOOR * top and worst > 0.5 * best):
            if probed or top == 0:
                return values[:k], block[:, :k]
            fresh_block, exceeds = _probe(times, block, values, k, draw, low, max(worst, 10 * TOLERANCE * top))
            if not exceeds:
                return values[:k], block[:, :k]
            # Something larger had been missed: it takes the place of the least columns.
            block = np.hstack([block[:, : b - fresh_block.shape[1]], fresh_block])
            values, block, residuals = _ritz(times, block)
            best, done, least = np.inf, 0, np.full(k, np.inf)
            continue
        best = min(best, worst)
        cut = max(values[-1], top * 1e-12)
        # What a far larger pair leaves in other columns by rounding would outgrow them, so it stays out of the filter when done.
        out = done if growth(min(low, 0.9 * cut), cut, top, DEGREE) > MOST_GROWTH else 0
        if values[out] > cut:
            held = block[:, :out]
            rest = outside(times, held) if out else times
            block = np.hstack([held, filtered(rest, block[:, out:], min(low, 0.9 * cut), cut, values[out], DEGREE)])
        values, block, residuals = _ritz(times, block)
    raise RuntimeError(f"{k} eigenpairs were not certified in {MOST_CYCLES} cycles")


def _ritz(times: Callable, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values, largest first, their vectors and residuals, of an orthonormal base of the block."""
    q, _ = np.linalg.qr(block)
    vq = times(q)
    inner = q.T @ vq
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors, images = q @ turn, vq @ turn
    return values, vectors, np.linalg.norm(images - vectors * values, axis=0)


def without(held: np.ndarray, x: np.ndarray) -> np.ndarray:
    """What is left of `x` beside the orthonormal columns `held`."""
    return x - held @ (held.T @ x)


def outside(times: Callable[[np.ndarray], np.ndarray], held: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The matrix behind `times` in the space orthogonal to `held`."""
    return lambda x: without(held, times(without(held, x)))


def _probe(
    times: Callable, block: np.ndarray, values: np.ndarray, k: int, draw: np.random.Generator, low: float = 0.0, slack: float = 0.0
) -> tuple[np.ndarray, bool]:
    """Random columns outside the block, filtered there, and whether one of them reaches into the wanted spectrum by more than `slack`."""
    start = without(block, draw.normal(size=(len(block), min(2, len(block) - block.shape[1]))))
    cut = max(values[-1], values[0] * 1e-12)
    rest = outside(times, block)
    found = filtered(rest, start, min(low, 0.9 * cut), cut, values[0], DEGREE) if values[0] > cut else start
    theta, vectors, _ = _ritz(rest, without(block, found))
    return vectors, bool(theta[0] > values[k - 1] * (1 + 1e-9) + slack)


def fit(df: DataFrame, vector: str = "embedding", components: int = 16, scale: float = 64.0, shift: int = 1_000_000) -> Whitening:
    """Whitening by the largest `components` eigenpairs of the covariance of distinct whole-number vectors."""
    spark = df.sparkSession
    usable = df.where(V.usable(vector))
    lengths = usable.groupBy(F.size(quoted(vector)).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return Whitening(0, [], 0.0, np.zeros(0), np.zeros((0, 0)), 0.0, scale, shift)
    d = lengths[0]["d"]
    store = Scratch(spark)
    x = usable.where(F.size(quoted(vector)) == d).select(whole(vector, scale, shift).alias("x"))
    rows = store.settle(x.distinct())
    n, sums = _exact_sums(rows, d)
    v = Covariance(rows, d, n, sums)
    trace = _exact_trace(rows, n, sums)
    k = min(components, d)
    values, vectors = largest_pairs(v.times, d, k) if trace > 0 else (np.zeros(k), np.eye(d)[:, :k])
    known = values > max(1e-12 * trace, 0.0)
    values, vectors = values[known], vectors[:, known]
    error = float(np.abs(v.of(vectors / np.sqrt(values)) - np.eye(len(values))).max(initial=0)) if len(values) else 0.0
    store.clear()
    return Whitening(n, sums, trace, values, vectors, error, scale, shift, v.passes)


def _exact_sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows and sums of each dimension, without rounding."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * d, 0
        for x in _pieces(batches, d):
            n += len(x)
            # Entries have 53 bits at most, so two halves of them add up within 63 bits.
            high, low = x >> 26, x & ((1 << 26) - 1)
            total = [t + (int(h) << 26) + int(lo) for t, h, lo in zip(total, high.sum(axis=0), low.sum(axis=0))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([*range(d), d], pa.int32()), pa.array([str(t) for t in [*total, n]])], names=["i", "s"])

    found = dict(rows.mapInArrow(partial, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    return int(found.get(d, 0)), [int(found.get(i, 0)) for i in range(d)]


def _exact_trace(rows: DataFrame, n: int, sums: list[int]) -> float:
    """The sum of all variances: squares of distances from whole-number means are added up exactly."""
    d, mean = len(sums), np.array([s // max(1, n) for s in sums], np.int64)
    rest = [s % max(1, n) for s in sums]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for x in _pieces(batches, d):
            x = x - mean
            most = int(np.abs(x).max(initial=0))
            total += int((x * x).sum()) if most**2 * x.size < 1 << 63 else sum(a * a for row in x.tolist() for a in row)
        yield pa.RecordBatch.from_arrays([pa.array([str(total)])], names=["s"])

    squares = int(rows.mapInArrow(partial, "s string").agg(F.sum(F.col("s").cast("decimal(38,0)"))).first()[0] or 0)
    return float(Fraction(n * squares - sum(r * r for r in rest), n * n)) if n else 0.0


def whiten(df: DataFrame, vector: str = "embedding", components: int = 16, scale: float = 64.0, shift: int = 1_000_000) -> tuple[DataFrame, Whitening]:
    """Fit on all rows and whiten them."""
    model = fit(df, vector, components, scale, shift)
    return model.transform(df, vector), model
