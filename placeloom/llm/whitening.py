"""Embedding whitening by QDWH spectral divide and conquer.

Vectors are put on a grid of whole numbers, ``x = floor(scale * c) + shift``; each distinct vector counts once. Sums are
exact; the covariance is that of the centred vectors, divisor n, summed task by task in Spark, so that only dims x dims
numbers reach the driver. There the polar factor of the shifted covariance, found by the dynamically weighted Halley
iteration with QR factors (QDWH), gives the projector on the subspace above the shift; its two invariant subspaces are
split in the same way until one dimension is left. Sixteen rows of the result are all that is sent to the workers.

Rows: a vector that is null, or holds null, NaN or infinite entries, is dropped. All vectors that stay must have one
length; where they differ, the commonest length (of equally common ones the longest) stays and others are dropped
likewise. Repeated vectors count once in the fit and are whitened row by row; a null id passes through. A component
without variance (fewer vectors than dimensions, constant entries: eigenvalue not above 1e-12 of the trace) has
``whitened`` 0 and does not count in ``identity_error``; ``explained`` is 0 where nothing varies. An empty table gives an
empty table. ``deviation`` beyond a long raises an error instead of wrapping. Entries outside +-1e15 / scale are an error too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom.session import write_once

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
EPS = np.finfo(float).eps
TINY = 1e-12
LARGEST = 1e15


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix (its sign function) by QDWH with QR."""
    n = len(a)
    x = a / np.linalg.norm(a)
    # a lower bound on the least singular value; too small a bound only costs a round
    try:
        low = min(max(0.9 / (np.linalg.norm(np.linalg.inv(x), 1) * np.sqrt(n)), EPS), 1.0)
    except np.linalg.LinAlgError:
        low = EPS
    eye = np.eye(n)
    for _ in range(40):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        weight_a = np.sqrt(1 + d) + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d)), 0))
        weight_b = (weight_a - 1) ** 2 / 4
        weight_c = weight_a + weight_b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(weight_c) * x, eye]))
        new = (weight_b / weight_c) * x + (weight_a - weight_b / weight_c) / np.sqrt(weight_c) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        low = min(low * (weight_a + weight_b * low**2) / (1 + weight_c * low**2), 1.0)
        done = np.linalg.norm(new - x) < 10 * EPS * n
        x = new
        if done:
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None where no shift parts them."""
    n = len(a)
    size = np.linalg.norm(a - np.eye(n) * np.trace(a) / n)
    if size <= 4 * EPS * n * max(np.linalg.norm(a), np.finfo(float).tiny):
        return None
    diagonal = np.sort(np.diag(a))
    middle = np.trace(a) / n
    shifts = [np.median(diagonal), middle, *(middle + size * s / np.sqrt(n) for s in (0.37, -0.37, 0.11, -0.11, 0.71, -0.71, 0.03, -0.03))]
    best = None
    for shift in shifts:
        projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < n:
            continue
        # the greatest columns span the range; a second pass through the projector cleans the basis
        above = _basis(projector, rank)
        below = _basis(np.eye(n) - projector, n - rank)
        residual = np.linalg.norm(below.T @ a @ above)
        if best is None or residual < best[0]:
            best = residual, above, below
        if residual <= 8 * EPS * n * np.linalg.norm(a):
            break
    return best and best[1:]


def _basis(projector: np.ndarray, rank: int) -> np.ndarray:
    """Orthonormal basis of the range, by QR with pivoted columns."""
    rest, chosen = projector.copy(), []
    for _ in range(rank):
        column = rest[:, np.argmax((rest**2).sum(0))]
        q = column / np.linalg.norm(column)
        for _ in range(2):
            for other in chosen:
                q = q - other * (other @ q)
            q /= np.linalg.norm(q)
        chosen.append(q)
        rest = rest - np.outer(q, q @ rest)
    q, _ = np.linalg.qr(projector @ np.array(chosen).T)
    return q


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors (columns) of a symmetric matrix."""
    n = len(a)
    parts: list[tuple[np.ndarray, np.ndarray]] = [(np.eye(n), a)] if n else []
    done: list[np.ndarray] = []
    while parts:
        basis, inner = parts.pop()
        halves = _split(inner) if len(inner) > 1 else None
        if halves is None:
            done.extend(basis.T)
            continue
        for half in halves:
            new = half.T @ inner @ half
            parts.append((basis @ half, (new + new.T) / 2))
    vectors, _ = np.linalg.qr(np.array(done).T.reshape(n, len(done)))
    vectors, values = _polish(a, vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _polish(a: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One first-order correction of eigenvectors that the splits have left with rounding errors."""
    inner = q.T @ a @ q
    values = np.diag(inner).copy()
    gaps = values[None, :] - values[:, None]
    safe = np.abs(gaps) > 1e3 * EPS * max(np.abs(values).max(initial=0), np.finfo(float).tiny)
    turn = np.where(safe, inner / np.where(safe, gaps, 1), 0)
    np.fill_diagonal(turn, 0)
    if np.abs(turn).max(initial=0) > 1e-4:
        return q, values
    better, r = np.linalg.qr(q @ (np.eye(len(a)) + turn))
    better = better * np.sign(np.diag(r))
    return better, np.diag(better.T @ a @ better).copy()


def on_grid(vector: str | Column, scale: int, shift: int) -> Column:
    """The whole numbers of a vector, null for a vector that is dropped."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    vector = vector.cast("array<double>")
    whole = lambda c: F.when(F.abs(c * scale) <= LARGEST, F.floor(c * scale) + shift).otherwise(
        F.raise_error(F.lit("vector entry too large for the grid")))
    return F.when(vector.isNotNull() & ~F.exists(vector, bad), F.transform(vector, whole))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as one array."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _totals(rows: DataFrame, dims: int, work) -> np.ndarray:
    """Sum over the table of the dims x k arrays that ``work`` makes of blocks of grid vectors; one array a task, added by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = work(_matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = rows.select("_x").mapInArrow(run, "i int, row array<double>")
    sums = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((max(s.i for s in sums) + 1, max(s.j for s in sums) + 1))
    for s in sums:
        out[s.i, s.j] = s.v
    return out


def whitened(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT,
    components: int = COMPONENTS,
) -> DataFrame:
    """Per vector and component: ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``."""
    kept = write_once(
        vectors.select(F.col(id_col).alias("_id"), on_grid(vector_col, scale, shift).alias("_x")).filter("_x is not null"), "grid")
    sizes = kept.groupBy(F.size("_x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    schema = T.StructType([
        T.StructField(id_col, vectors.schema[id_col].dataType), T.StructField("component", T.IntegerType()),
        T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    if sizes is None or sizes.dims == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    dims = sizes.dims
    kept = kept.filter(F.size("_x") == dims)
    fit = write_once(kept.select("_x").distinct(), "distinct")
    entry = F.col("_x")
    first = fit.agg(F.count("*").alias("n"), *(F.sum(entry[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(dims))).first()
    n, sums = first.n, [int(first[f"s{i}"]) for i in range(dims)]
    whole = np.array([s // n for s in sums], dtype=np.int64)
    part = np.array([(s % n) / n for s in sums])

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - whole).astype(float) - part

    covariance = _totals(fit, dims, lambda x: (lambda c: c.T @ c)(centred(x))) / n
    values, axes = spectrum((covariance + covariance.T) / 2)
    k = min(components, dims)
    trace = float(np.trace(covariance))
    varies = values[:k] > TINY * trace
    weights = axes[:, :k] * np.where(varies, 1 / np.sqrt(np.where(varies, values[:k], 1)), 0)

    def again(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ weights
        return np.vstack([w.T @ w, w.sum(0)])

    check = _totals(fit, k + 1, again) / n
    second = check[:k] - np.outer(check[k], check[k])
    error = float(np.abs((second - np.eye(k))[np.ix_(varies, varies)]).max(initial=0))
    explained = [float(v / trace) if trace > 0 else 0.0 for v in values[:k]]

    rests = np.array([s % n for s in sums], dtype=np.int64)

    def deviations(x: np.ndarray) -> np.ndarray:
        """Exact sums of (n * x - S)^2, where n * x - S = n * (x - whole) - (S mod n)."""
        if float(n) * float(np.abs(x - whole).max(initial=0)) > 2.0**62:
            raise OverflowError("deviation does not fit into a long")
        gap = n * (x - whole) - rests
        if (gap.astype(float) ** 2).sum(1).max(initial=0) > 2.0**63 * (1 - 1e-9):
            raise OverflowError("deviation does not fit into a long")
        return (gap * gap).sum(1)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1)).reshape(batch.num_rows, dims)
            w = centred(x) @ weights
            lists = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * k, pa.array(w.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(deviations(x), pa.int64()), lists], names=["_id", "deviation", "_w"])

    projected = kept.select("_id", "_x").mapInArrow(project, T.StructType([
        T.StructField("_id", schema[id_col].dataType), T.StructField("deviation", T.LongType()),
        T.StructField("_w", T.ArrayType(T.DoubleType()))]))
    shares = F.array(*(F.lit(e) for e in explained))
    return projected.select("_id", "deviation", F.posexplode("_w").alias("_j", "whitened")).select(
        F.col("_id").alias(id_col), (F.col("_j") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        "whitened", shares[F.col("_j")].alias("explained"), F.lit(error).alias("identity_error"))
