"""Linear models from sums: one scan gives the cross products of every fold, and each fold is fitted from the total
minus its own.

The table that reaches the driver has folds x columns x columns numbers, whatever the number of rows. Values are
taken relative to a shift near their mean, so that centring them loses no digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHIFT_ROWS = 1000


@dataclass(frozen=True)
class Moments:
    """Count, means and centred cross products (divisor n) of feature columns and label (last)."""

    n: float
    mean: np.ndarray
    cross: np.ndarray

    def part(self, used: list[int]) -> Moments:
        at = [*used, len(self.mean) - 1]
        return Moments(self.n, self.mean[at], self.cross[np.ix_(at, at)])

    def scaled(self, mean: float, std: float) -> Moments:
        """Moments of ``(x - mean) / std``, the same for all features; the label stays."""
        by = np.r_[np.full(len(self.mean) - 1, std), 1.0]
        return Moments(self.n, np.r_[(self.mean[:-1] - mean) / std, self.mean[-1]], self.cross / np.outer(by, by))


@dataclass(frozen=True)
class Linear:
    """Least squares with a penalty: ``l2`` on the squared coefficients of the summed squared error, ``l1`` on their
    absolute values with the halved mean squared error. Called with training rows, an unfitted Spark ML estimator."""

    l1: float = 0.0
    l2: float = 0.0

    def __call__(self, train: DataFrame) -> LinearRegression:
        if self.l2:
            # the solver scales the label to unit deviation and averages the loss; the penalty is scaled to match
            row = train.agg(F.count("y").alias("n"), F.stddev_pop("y").alias("s")).first()
            return LinearRegression(
                labelCol="y", regParam=self.l2 / row["n"] * row["s"], elasticNetParam=0.0, standardization=False)
        return LinearRegression(labelCol="y", regParam=self.l1, elasticNetParam=1.0, standardization=False)

    def solve(self, moments: Moments) -> tuple[np.ndarray, float]:
        """Coefficients and intercept."""
        q, c = moments.cross[:-1, :-1], moments.cross[:-1, -1]
        if self.l1:
            beta = lasso_path(q, c, moments.cross[-1, -1], self.l1, self.l2 / moments.n)
        elif self.l2:
            beta = np.linalg.solve(q + np.eye(len(q)) * self.l2 / moments.n, c)
        else:
            beta = np.linalg.lstsq(q, c, rcond=1e-13)[0]
        return beta, float(moments.mean[-1] - moments.mean[:-1] @ beta)


def lasso_path(q: np.ndarray, c: np.ndarray, label: float, l1: float, l2: float = 0.0, gap: float = 1e-10, rounds: int = 100_000) -> np.ndarray:
    """Minimum of ``(label - 2 c.b + b.Q.b + l2 b.b) / 2 + l1 |b|`` by coordinate descent; stops when the duality gap is
    below ``gap`` times the label's variance."""
    q = q + np.eye(len(q)) * l2
    beta, fitted = np.zeros(len(c)), np.zeros(len(c))  # fitted = Q beta
    for _ in range(rounds):
        for j in range(len(c)):
            if q[j, j] <= 0:
                continue
            rest = c[j] - fitted[j] + q[j, j] * beta[j]
            new = np.sign(rest) * max(abs(rest) - l1, 0) / q[j, j]
            if new != beta[j]:
                fitted += q[:, j] * (new - beta[j])
                beta[j] = new
        # residual r: r.r = label - 2 c.b + b.Q.b; its scaled copy is a feasible dual point
        loss = max(label - 2 * c @ beta + beta @ fitted, 0.0)
        steepest = np.abs(c - fitted).max(initial=0)
        shrink = min(1.0, l1 / steepest) if steepest > 0 else 1.0
        primal = loss / 2 + l1 * np.abs(beta).sum()
        dual = shrink * (label - c @ beta) - shrink**2 * loss / 2
        if primal - dual <= gap * max(label, np.finfo(float).tiny):
            return beta
    raise ArithmeticError("coordinate descent has not converged")


def moments_by_fold(
    df: DataFrame, folds: list[str], columns: list[str], exact: list[str] | None = None, wide: dict[str, int] | None = None,
    repeated: bool = False,
) -> tuple[dict[str, Moments], dict[str, np.ndarray]]:
    """For each of ``folds``: moments of all rows outside it, and for each column of ``exact`` the sums of its values and of
    their squares outside it (2 x columns).

    ``df`` has ``fold``, ``y`` and the feature ``columns``. Rows of other folds train every fold; rows without a fold
    take no part. ``wide`` names the columns that hold arrays and their lengths; each entry is a feature, in place.
    ``repeated`` (without ``wide``): rows of a fold with equal features are first summed up to one, which pays where the
    features take few different values together.
    """
    exact, wide = exact or [], wide or {}
    names = [*columns, "y"]
    doubles = [F.col(f"`{c}`").cast("array<double>" if c in wide else "double").alias(f"c{i}") for i, c in enumerate(names)]
    # 1 .. for the folds asked for, 0 for others
    place = F.array_position(F.array(*map(F.lit, folds)), F.col("fold").cast("string")).cast("int")
    rows = df.select(place.alias("fold"), *doubles)
    lengths = [wide.get(c) for c in names]

    def columns_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for column, length in zip(batch.columns[1:], lengths, strict=True):
            values = column.to_numpy(zero_copy_only=False) if length is None else column.flatten().to_numpy(zero_copy_only=False)
            yield values if length is None else values.reshape(batch.num_rows, length)

    if wide:
        some = [np.column_stack([*columns_of(b)]) for b in rows.limit(SHIFT_ROWS // 10).toArrow().to_batches() if b.num_rows]
        near = np.concatenate(some).mean(axis=0) if some else np.zeros(sum(n or 1 for n in lengths))
        flat = [c in exact for c, n in zip(names, lengths) for _ in range(n or 1)]
        shift = np.where(np.isfinite(near) & ~np.array(flat), near, 0.0)
    else:
        near = rows.limit(SHIFT_ROWS).agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(len(names))]).first()
        shift = np.array([0.0 if c in exact or v is None or not np.isfinite(v) else v for c, v in zip(names, near, strict=True)])
    width = len(shift) + 1
    first, at = {}, 1
    for c in names:
        first[c] = at
        at += wide.get(c, 1)
    if wide:
        # each task hands over its sums, as large as the square of the width: no more of them than tasks at once
        rows = rows.coalesce(df.sparkSession.sparkContext.defaultParallelism)

    if repeated:
        label = f"c{len(names) - 1}"
        off = F.col(label) - float(shift[-1])
        known = F.count(label) == F.count("*")  # a row without label stays an error
        rows = rows.groupBy("fold", *[f"c{i}" for i in range(len(names) - 1)]).agg(
            F.when(known, F.sum(off)).alias(label), F.when(known, F.sum(off * off)).alias("_yy"), F.count("*").cast("double").alias("_n"))

    def sums_of(batch: pa.RecordBatch, rows_of: np.ndarray) -> np.ndarray:
        """Cross products of rows that stand for several: count, features, sum and squares of the label."""
        *features, y, yy, n = (c.to_numpy(zero_copy_only=False)[rows_of] for c in batch.columns[1:])
        x = np.column_stack([np.ones(len(n)), *features])
        x[:, 1:] -= shift[:-1]
        side = (x.T @ y)[:, None]
        return np.block([[x.T @ (x * n[:, None]), side], [side.T, yy.sum()]])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            if repeated:
                for fold in np.unique(at[at >= 0]):
                    sums[fold] = sums.get(fold, 0) + sums_of(batch, at == fold)
                continue
            values = np.column_stack([np.ones(batch.num_rows), *columns_of(batch)])
            values[:, 1:] -= shift
            for fold in np.unique(at[at >= 0]):
                part = values[at == fold]
                sums[fold] = sums.get(fold, 0) + part.T @ part
        for fold, total in sums.items():
            yield pa.RecordBatch.from_pydict({
                "fold": pa.array([fold] * width, pa.int32()), "i": pa.array(range(width), pa.int32()),
                "row": pa.array(list(total), pa.list_(pa.float64()))})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy().reshape(-1, width)
            for fold, i, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), flat, strict=True):
                sums[fold, i] = sums.get((fold, i), 0) + row
        if sums:
            yield pa.RecordBatch.from_pydict({
                "fold": pa.array([k[0] for k in sums], pa.int32()), "i": pa.array([k[1] for k in sums], pa.int32()),
                "row": pa.array(list(sums.values()), pa.list_(pa.float64()))})

    shape = "fold int, i int, row array<double>"
    parts = np.zeros((len(folds) + 1, width, width))
    found = rows.mapInArrow(products, shape).repartition("fold", "i").mapInArrow(added, shape).toArrow()
    for batch in found.to_batches():
        parts[batch.column(0).to_numpy(), batch.column(1).to_numpy()] = batch.column(2).flatten().to_numpy().reshape(-1, width)
    if not np.isfinite(parts).all():
        raise ValueError("a feature or the label is NULL, NaN or infinite")
    total = parts.sum(0)
    picked = [first[c] for c in exact]
    moments, sums = {}, {}
    for at, fold in enumerate(folds, 1):
        left = total - parts[at]
        n = left[0, 0]
        if n <= 0:
            raise ValueError(f"no training rows outside fold {fold}")
        off = left[0, 1:] / n
        moments[fold] = Moments(n, off + shift, left[1:, 1:] / n - np.outer(off, off))
        sums[fold] = np.array([left[0, picked], np.diag(left)[picked]])
    return moments, sums


def overall_scale(moments: Moments) -> tuple[float, float]:
    """Mean and population deviation over all values of all features together."""
    means, spread = moments.mean[:-1], np.diag(moments.cross)[:-1]
    mean = means.mean()
    return float(mean), float(np.sqrt((spread + (means - mean) ** 2).mean()))


def linear_prediction(
    columns: list[str], weights: str = "_weights", intercept: str = "_intercept", wide: dict[str, int] | None = None,
) -> Column:
    """Prediction of a row that carries its fold's coefficients as an array; ``wide`` as in :func:`moments_by_fold`."""
    total, at, wide = F.col(intercept), 0, wide or {}
    for c in columns:
        if c in wide:
            products = F.zip_with(F.col(f"`{c}`"), F.slice(weights, at + 1, wide[c]), lambda x, w: x * w)
            total = total + F.aggregate(products, F.lit(0.0), lambda t, x: t + x)
        else:
            total = total + F.col(f"`{c}`").cast("double") * F.col(weights)[at]
        at += wide.get(c, 1)
    return total
