"""Embedding whitening: principal components by Chebyshev-filtered subspace iteration over distributed passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxspark.llm.shared import written

#: Components returned, and vectors of the subspace beyond them, whose eigenvalues bound the unwanted spectrum.
COMPONENTS, GUARD = 32, 8
#: Degree of one filter, Lanczos steps that find the spectrum's ends, and rounds at most before an error.
DEGREE, STEPS, ROUNDS = 12, 12, 60
#: A component is certified when ||Vq - eq|| is within this share of the largest eigenvalue, or within RELAXED of it and no longer falling.
RESIDUAL, RELAXED = 1e-15, 1e-11
#: Entries of this size and more take no part: their sums would leave the integers that a double holds.
LARGEST = 2.0**50
#: Partial results that one task adds up.
FAN = 64
_UNUSED = 2**62


def whole_numbers(df: DataFrame, vector: str = "embedding", scale: int = 64, shift: int = 1_000_000, out: str = "x") -> DataFrame:
    """Rows whose vector is not null and holds no null or non-finite entry, with ``out``: floor(scale * entry) + shift, as longs.

    Entries whose result reaches 2^50 count as non-finite. An empty vector stays, empty.
    """
    value = lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * scale < LARGEST - abs(shift))
    sound = df.filter(F.col(vector).isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False)))
    return sound.withColumn(out, F.transform(vector, lambda c: value(c).cast("bigint") + F.lit(shift)))


def added(parts: DataFrame, size: int, partitions: int) -> np.ndarray:
    """The sum of (part, packed doubles) rows, always in the order of the parts. Beyond FAN parts, tasks add up FAN at a time first."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch["part"].to_pylist(), batch["sums"].to_pylist(), strict=True):
                total[part // FAN] = total.get(part // FAN, 0) + np.frombuffer(raw)
        if total:
            yield pa.RecordBatch.from_pylist([{"part": k, "sums": v.tobytes()} for k, v in total.items()], schema=_PARTS)

    while partitions > FAN:
        partitions = -(-partitions // FAN)
        near = parts.repartition(partitions, F.floor(F.col("part") / FAN)).sortWithinPartitions("part")
        parts = near.mapInArrow(sums, "part int, sums binary")
    rows = sorted(parts.collect(), key=lambda r: r["part"])
    return sum((np.frombuffer(r["sums"]) for r in rows), np.zeros(size))


_PARTS = pa.schema([("part", pa.int32()), ("sums", pa.binary())])


def matrices(batches: Iterator[pa.RecordBatch], column: str, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch with its integer vectors as the rows of a matrix."""
    for batch in batches:
        if batch.num_rows:
            yield batch, batch[column].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


@dataclass
class Moments:
    """Exact count and sums; a vector is centred as (x - base) - rest, where base is the whole part of the mean."""

    n: int
    sums: list[int]

    @property
    def base(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([(s - (s // self.n) * self.n) / self.n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.rest

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2 of each row, exact; null where a long can't hold it."""
        whole, left = x - self.base, np.array([s - (s // self.n) * self.n for s in self.sums], dtype=object)
        reach = self.n * (float(np.abs(whole).max(initial=0)) + 1)
        if reach * reach * max(x.shape[1], 1) < _UNUSED:
            d = self.n * whole - left.astype(np.int64)
            return (d * d).sum(axis=1).tolist()
        d = self.n * whole.astype(object) - left
        return [int(v) if v < 2**63 else None for v in (d * d).sum(axis=1)]


def moments(df: DataFrame, column: str, width: int) -> Moments:
    """Count and exact sums in one pass. A task adds up longs batch by batch in integers without a bound."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for _, x in matrices(batches, column, width):
            for at in range(0, len(x), 4096):
                n += len(x[at : at + 4096])
                total = [t + s for t, s in zip(total, x[at : at + 4096].sum(axis=0).tolist(), strict=True)]
        if n:
            yield pa.RecordBatch.from_pylist([{"n": n, "i": i, "s": str(t)} for i, t in enumerate(total)])

    per = df.select(column).mapInArrow(sums, "n bigint, i bigint, s string")
    rows = per.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    found = {r["i"]: int(r["s"]) for r in rows}
    return Moments(max((r["n"] for r in rows), default=0), [found[i] for i in range(width)] if found else [])


@dataclass
class Spectrum:
    """Certified components: eigenvalues falling, unit vectors as columns, residual norms, the trace, and the passes it took."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    trace: float
    passes: int


def chebyshev(apply: Callable[[np.ndarray], np.ndarray], q: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of the operator on q that is small on [low, high], scaled to stay near one at ``top``."""
    centre, half = (high + low) / 2, max((high - low) / 2, np.finfo(float).tiny)
    scale = half / (top - centre)
    first = scale
    before, now = q, (apply(q) - centre * q) * (scale / half)
    for _ in range(2, degree + 1):
        after = 1 / (2 / first - scale)
        before, now = now, (apply(now) - centre * now) * (2 * after / half) - before * (scale * after)
        scale = after
    return now


def lowest(apply: Callable[[np.ndarray], np.ndarray], width: int, steps: int, rng: np.random.Generator) -> float:
    """A bound below the spectrum, or near it: the least Ritz value of a few Lanczos steps less its residual, and never below 0."""
    q = rng.standard_normal((width, 1))
    basis, a, b = [q / np.linalg.norm(q)], [], []
    for _ in range(min(steps, width)):
        w = apply(basis[-1])
        a.append(float((basis[-1].T @ w)[0, 0]))
        held = np.hstack(basis)
        for _ in range(2):
            w = w - held @ (held.T @ w)
        b.append(float(np.linalg.norm(w)))
        if b[-1] <= 1e-12 * max(map(abs, a)):
            break
        basis.append(w / b[-1])
    t = np.diag(a) + np.diag(b[: len(a) - 1], 1) + np.diag(b[: len(a) - 1], -1)
    values, vectors = np.linalg.eigh(t)
    return max(0.0, float(values[0] - b[len(a) - 1] * abs(vectors[-1, 0])))


def leading(apply: Callable[[np.ndarray], np.ndarray], width: int, trace: float, components: int = COMPONENTS, guard: int = GUARD, seed: int = 7) -> Spectrum:
    """The largest eigenvalues of a positive operator and their vectors.

    Each round filters a block with a Chebyshev polynomial that damps what lies below the block's least Ritz value,
    orthonormalises it (QR) and solves the small problem (Rayleigh-Ritz), until all residuals are certified.
    """
    rng, passes = np.random.default_rng(seed), 0

    def counted(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return apply(q)

    wanted, block = min(components, width), min(components + guard, width)
    q = np.linalg.qr(rng.standard_normal((width, block)))[0]
    low = lowest(counted, width, STEPS, rng) if block < width else 0.0
    worst = np.inf
    for _ in range(ROUNDS):
        image = counted(q)
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        residuals = np.linalg.norm(image - q * values, axis=0)[:wanted]
        share = residuals.max(initial=0) / max(values[0], np.finfo(float).tiny)
        if share <= RESIDUAL or share <= RELAXED and share > worst / 2 or values[0] <= 0:
            return Spectrum(np.maximum(values[:wanted], 0), q[:, :wanted], residuals, trace, passes)
        worst = share
        high = max(float(values[-1]), low)
        # A block that spans the space, or a spectrum that is flat below it, has nothing to damp.
        if block < width and high > low:
            q = chebyshev(counted, q, low, high, float(values[0]), DEGREE)
        q = np.linalg.qr(q)[0]
    raise ArithmeticError(f"no certified components after {ROUNDS} rounds; residual {worst}")


@dataclass
class Whitening:
    """The fitted transform: moments, certified components, and the largest deviation of the whitened covariance from the identity."""

    moments: Moments
    spectrum: Spectrum
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Centred rows on the components over the roots of their eigenvalues; NaN for a component without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.useful, (self.moments.centred(x) @ self.spectrum.vectors) / np.sqrt(self.spectrum.values), np.nan)

    @property
    def useful(self) -> np.ndarray:
        """Components whose eigenvalue stands clear of rounding."""
        top = self.spectrum.values.max(initial=0)
        return self.spectrum.values > max(len(self.moments.sums), 1) * np.finfo(float).eps * top


def fit(df: DataFrame, column: str = "x", components: int = COMPONENTS) -> Whitening | None:
    """Fit on the integer vectors of a column (one length for all; see ``same_length``). None for an empty table or empty vectors.

    Every product with the covariance is a pass over the rows: a task sums centred rows times (centred rows times the block), so no
    matrix larger than width x block travels. Sums are added in a fixed order, so reruns over the same files agree.
    """
    head = df.select(F.size(column).alias("w")).first()
    if head is None or head["w"] == 0:
        return None
    width = head["w"]
    found = moments(df, column, width)
    rows, parts = df.select(column), df.rdd.getNumPartitions()

    def pass_over(make: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for _, x in matrices(batches, column, width):
                for at in range(0, len(x), 4096):
                    total += make(x[at : at + 4096]).ravel()
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "sums": total.tobytes()}], schema=_PARTS)

        return added(rows.mapInArrow(sums, "part int, sums binary"), size, parts)

    def apply(q: np.ndarray) -> np.ndarray:
        def product(x: np.ndarray) -> np.ndarray:
            c = found.centred(x)
            return c.T @ (c @ q)

        return pass_over(product, q.size).reshape(q.shape) / found.n

    trace = float(pass_over(lambda x: np.square(found.centred(x)).sum(), 1)[0]) / found.n
    fitted = Whitening(found, leading(apply, width, trace, components))
    k = int(fitted.useful.sum())
    if k:

        def second(x: np.ndarray) -> np.ndarray:
            w = fitted.whitened(x)[:, :k]
            return np.vstack([w.T @ w, w.sum(axis=0)])

        both = pass_over(second, (k + 1) * k).reshape(k + 1, k) / found.n
        fitted.identity_error = float(np.abs(both[:k] - np.outer(both[k], both[k]) - np.eye(k)).max())
    return fitted


def same_length(df: DataFrame, column: str = "x") -> DataFrame:
    """Rows whose vector has the most frequent length (the longest of those that tie)."""
    sizes = df.groupBy(F.size(column).alias("w")).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max_by("w", F.struct("n", "w")).alias("w")).first()["w"]
    return df.filter(F.size(column) == (-1 if most is None else most))


def whiten(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, whitened: str = "whitened", deviation: str = "deviation", keep: Sequence[str] | None = None) -> tuple[DataFrame, Whitening | None]:
    """Rows with a usable vector, with ``deviation`` (long) and ``whitened`` (array of doubles, one a component), and the fit.

    Left out: null vectors, those with null, non-finite or huge entries (``whole_numbers``), and those of another length than most. Repeated rows
    and rows without an id count as any other. Fewer dimensions than ``components`` give fewer. A component without variance has null entries;
    equal eigenvalues may come in any rotation. ``keep`` names the
    columns that come along (all); one named as a result is replaced. An empty table gives no rows and no fit.
    """
    names = {whitened.lower(), deviation.lower()}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    sound = written(whole_numbers(df.select(F.struct(*kept).alias("row"), F.col(vector).alias("v")), "v"), "whitening")
    rows = same_length(sound).select("row", "x")
    fitted = fit(rows, "x", components)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                piece = batch.slice(at, 2048)
                x = piece["x"].flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, -1)
                flat = fitted.whitened(x)
                values = pa.array(flat.ravel(), mask=np.isnan(flat).ravel())
                ends = pa.array(np.arange(piece.num_rows + 1, dtype=np.int32) * flat.shape[1])
                made = [pa.array(fitted.moments.deviation(x), pa.int64()), pa.ListArray.from_arrays(ends, values)]
                yield pa.RecordBatch.from_arrays([piece["row"], *made], ["row", "d", "w"])

    schema = f"row {sound.schema['row'].dataType.simpleString()}, d bigint, w array<double>"
    done = rows.mapInArrow(project, schema) if fitted else rows.limit(0).selectExpr("row", "0L as d", "array(0D) as w")
    return done.select(*[F.col("row")[c].alias(c) for c in kept], F.col("d").alias(deviation), F.col("w").alias(whitened)), fitted
