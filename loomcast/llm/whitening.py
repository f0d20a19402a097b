"""Whitening of embeddings along their leading principal components.

The components come from a matrix-free block subspace iteration.  The
covariance is never formed: a Spark pass over the stored fit list computes
X'(XQ) for a block Q of directions, on centred rows, as a partial sum for each
task and then a sum for each dimension.  The driver orthonormalises the block
(QR), solves the small projected problem (Rayleigh-Ritz) and measures the
residuals |Vq - eq| of the leading directions.  The block goes on with the
residual directions, and the blocks before it are kept in the projected problem
as far as ``basis`` allows, then folded into their leading half; so that also a
flat spectrum, where the plain iteration needs hundreds of passes, ends after
few.  It ends when the residuals of all k components are at most ``tolerance``
of the largest eigenvalue, or when the basis spans the whole space; after
``most`` passes without that it raises ArithmeticError.

Entries are quantised to whole numbers, floor(256 * c), so counts, sums and the
deviation of a row are exact.  The fit list holds each distinct vector once;
equal vectors are folded before they are shuffled.  What reaches the driver is
d x block numbers a pass, and d sums.

Defined cases: rows with a null vector or null or non-finite entries are
dropped, as are empty vectors, vectors with an entry beyond 2^52 once scaled and
vectors that have not the most frequent length (the smaller at a tie); null ids
stay null; repeated rows and vectors are each returned; equal eigenvalues give
any basis of their space; fewer than k dimensions give that many components; a
component without variance gets a null ``whitened`` and ``explained`` 0, and is
left out of ``identity_error`` (null where there is none at all); a deviation
beyond a long is null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.llm import _shared

#: Rows handled by one matrix product.
ROWS = 8192
#: Largest magnitude of a quantised entry: whole numbers up to here are exact as doubles.
LARGEST = 1 << 52


@dataclass
class Components:
    """k directions with their eigenvalues, and what they were fitted on."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray  # (k,) falling
    vectors: np.ndarray  # (d, k)
    residuals: np.ndarray  # (k,) relative to the largest eigenvalue
    passes: int
    identity_error: float | None = None


def quantised(df: DataFrame, vector: str, scale: int = 256) -> DataFrame:
    """``df`` with a column ``x`` of whole numbers; rows that have no such vector are dropped."""
    c = F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda v: F.floor(v * F.lit(float(scale))))
    finite = F.forall(F.col(f"`{vector}`").cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * scale <= float(LARGEST)))
    return df.where(F.col(f"`{vector}`").isNotNull() & (F.size(F.col(f"`{vector}`")) > 0) & finite).withColumn("x", c.cast("array<bigint>"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield _matrix(batch.slice(at, ROWS).column(0), width)


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sums of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for x in _chunks(batches, width):
            n += len(x)
            # halves of 32 bits add up exactly; their sums join as whole numbers of any size
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            total = [t + (int(h) << 32) + int(v) for t, h, v in zip(total, high, low, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n] * width, pa.int64()), pa.array(range(width), pa.int32()), pa.array([str(t) for t in total])], names=["n", "dim", "total"])

    each = fit.mapInArrow(run, "n bigint, dim int, total string")
    rows = each.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    sums = [0] * width
    for r in rows:
        sums[r.dim] = int(r.total)
    return (rows[0].n if rows else 0), sums


def _apply(fit: DataFrame, mean: np.ndarray, q: np.ndarray, weigh: np.ndarray | None = None) -> np.ndarray:
    """X'(XQ) over the centred rows of the fit list, one pass."""
    spark, width, b = fit.sparkSession, *q.shape
    sent = spark.sparkContext.broadcast((mean, np.ascontiguousarray(q)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, block = sent.value
        total, seen = np.zeros((width, b)), False
        for x in _chunks(batches, width):
            c, seen = x - center, True
            total += c.T @ (c @ block)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), *(pa.array(total[:, k]) for k in range(b))], names=["dim", *(f"c{k}" for k in range(b))])

    names = [f"c{k}" for k in range(b)]
    each = fit.mapInArrow(run, "dim int, " + ", ".join(f"{c} double" for c in names))
    out = np.zeros((width, b))
    for r in each.groupBy("dim").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[r.dim] = [r[c] for c in names]
    sent.unpersist()
    return out


def _trace(fit: DataFrame, mean: np.ndarray) -> float:
    """Sum of squares of the centred rows."""
    width = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([float(sum(((x - mean) ** 2).sum() for x in _chunks(batches, width)))])], names=["s"])

    return fit.mapInArrow(run, "s double").agg(F.sum("s")).head()[0] or 0.0


def _orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """QR of the block's part outside the basis; directions that vanish give way to random ones."""
    for _ in range(3):  # once more for the digits lost in the first
        block = block - basis @ (basis.T @ block)
        size = np.linalg.norm(block, axis=0)
        weak = size < 1e-14 * max(size.max(), 1.0)
        block[:, weak] = rng.standard_normal((len(block), int(weak.sum())))
        block[:, ~weak] /= size[~weak]
        block[:, weak] -= basis @ (basis.T @ block[:, weak])
        block = np.linalg.qr(block)[0]
    return block


def leading(fit: DataFrame, width: int, k: int = 4, block: int = 32, basis: int = 256, tolerance: float = 1e-12, most: int = 500, seed: int = 7) -> Components:
    """The k leading components of the covariance of the rows of ``fit`` (one array column of ``width`` whole numbers)."""
    n, sums = _sums(fit, width)
    k = min(k, width)
    if not n:
        return Components(0, sums, 0.0, np.zeros(0), np.zeros((width, 0)), np.zeros(0), 0)
    mean = np.array([s / n for s in sums])
    trace = _trace(fit, mean) / n
    rng = np.random.default_rng(seed)
    block = min(max(block, k), width)
    basis = min(max(basis, 2 * block + k), width)
    kept, image = np.zeros((width, 0)), np.zeros((width, 0))
    fresh = rng.standard_normal((width, block))
    passes = 0
    while True:
        fresh = _orthonormal(fresh[:, : width - kept.shape[1]], kept, rng)
        kept, image = np.hstack([kept, fresh]), np.hstack([image, _apply(fit, mean, fresh) / n])
        passes += 1
        small = kept.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)
        values, turn = values[order], turn[:, order]
        lead = min(block, kept.shape[1])
        ritz, mapped = kept @ turn[:, :lead], image @ turn[:, :lead]
        off = mapped - ritz * values[:lead]
        residuals = np.linalg.norm(off[:, :k], axis=0) / max(values[0], np.finfo(float).tiny)
        if passes >= most and residuals.max() > tolerance and kept.shape[1] < width:
            raise ArithmeticError(f"after {passes} passes the residuals are {residuals.tolist()}, not {tolerance}")
        if residuals.max() <= tolerance or kept.shape[1] == width:
            return Components(n, sums, trace, np.maximum(values[:k], 0.0), ritz[:, :k], residuals, passes)
        if kept.shape[1] + block > basis and basis < width:  # fold the basis into its leading half
            half = max(k, basis - block - (basis - block) // 2)
            kept, image = np.linalg.qr(kept @ turn[:, :half])[0], None
            image = _apply(fit, mean, kept) / n  # anew, so that rounding does not gather
            passes += 1
        fresh = off


def _positive(found: Components) -> np.ndarray:
    """Which components have variance beyond rounding."""
    return found.values > 1e-13 * max(found.trace, np.finfo(float).tiny)


def identity_error(fit: DataFrame, found: Components) -> float | None:
    """Largest entry by which the covariance of the whitened fit list differs from the identity."""
    good = _positive(found)
    if not good.any():
        return None
    to = found.vectors[:, good] / np.sqrt(found.values[good])
    mean, width, m = np.array([s / found.n for s in found.sums]), len(found.sums), int(good.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((m, m)), np.zeros(m)
        for x in _chunks(batches, width):
            w = (x - mean) @ to
            total += w.T @ w
            first += w.sum(axis=0)
        flat = np.append(total.ravel(), first)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["at", "v"])

    rows = fit.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    flat = np.array([r.v for r in rows]) / found.n
    cov = flat[: m * m].reshape(m, m) - np.outer(flat[m * m :], flat[m * m :])
    return float(np.abs(cov - np.eye(m)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n x - S)^2, exact; None where it does not fit a long."""
    top = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums)) if x.size else 0
    if x.shape[1] * top * top < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def fit_components(rows: DataFrame, k: int = 4, **settings) -> tuple[DataFrame, Components | None]:
    """(fit list, components) of the column ``x``; the rows' usual length decides which are taken."""
    common = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), "width").head()
    if common is None:
        return rows.select("x"), None
    distinct = rows.where(F.size("x") == common.width).select("x").distinct()
    fit, _ = _shared.materialize(distinct, "fit")
    found = leading(fit, common.width, k, **settings)
    found.identity_error = identity_error(fit, found)
    return fit, found


def whiten(df: DataFrame, k: int = 4, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256, **settings) -> DataFrame:
    """A row for each vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    spark = df.sparkSession
    _shared.ship(spark)
    rows = quantised(df.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").alias("_v")), "_v", scale).select("vec_id", "x")
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    _, found = fit_components(rows, k, **settings)
    if found is None:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(found)
    width = len(found.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        good, m = _positive(f), len(f.values)
        mean = np.array([s / f.n for s in f.sums])
        to = f.vectors[:, good] / np.sqrt(f.values[good])
        explained = [float(v / f.trace) if ok else 0.0 for v, ok in zip(f.values, good, strict=True)]
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = _matrix(batch.column(1), width)
                w = np.full((len(x), m), np.nan)
                w[:, good] = (x - mean) @ to
                count = len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.arange(count), m)).cast(pa.int64()) if not m else batch.column(0).take(pa.array(np.repeat(np.arange(count), m))),
                        pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), count)), pa.array(np.full(count * m, f.n, np.int64)),
                        pa.array([d for d in deviations(x, f.n, f.sums) for _ in range(m)], pa.int64()), pa.array(w.ravel(), from_pandas=True),
                        pa.array(explained * count, pa.float64()), pa.array([f.identity_error] * (count * m), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("x") == width).mapInArrow(run, schema)


def query(spark, sf_dir):
    return whiten(_shared.table(spark, sf_dir, "embeddings"))
