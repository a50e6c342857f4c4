"""Fold statistics against the fits of Spark ML and numpy on the rows themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeloom.operators import evaluation, gram

COLUMNS = ["area", "rooms", "kind_A", "kind_B", "kind_none", "copy"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(400):
        area, rooms = float(1e7 + rng.normal() * 30), float(rng.integers(1, 9))
        a, b = int(i % 3 == 0), int(i % 40 == 0 and i % 4 == 0)
        fold = ["x", "y", "z", "other", None][i % 5]
        if fold != "x":
            b = 0
        y = 3 * (area - 1e7) + 20 * rooms + 50 * a + float(rng.normal()) * 5 + 1000
        rows.append((i, fold, y, area, rooms, a, b, 0, 2 * rooms))
    return spark.createDataFrame(rows, "_id int, fold string, y double, area double, rooms double, kind_A int, kind_B int, kind_none int, copy double").repartition(6).cache()


def rows_of(table, fold, columns):
    rows = [r for r in table.collect() if r["fold"] is not None]
    train = [r for r in rows if r["fold"] != fold]
    pick = lambda part: (np.array([[float(r[c]) for c in columns] for r in part]), np.array([r["y"] for r in part]))
    return pick(train), [r for r in rows if r["fold"] == fold]


@pytest.mark.parametrize("standardize", [False, True])
@pytest.mark.parametrize("model", [gram.Linear(), gram.Linear(l2=30.0), gram.Linear(l1=0.5)])
def test_folds_against_the_rows(table, model, standardize):
    folds = ["x", "y", "z"]
    pred, importance = evaluation.linear_folds(table, folds, model, COLUMNS, ["_id"], standardize)
    got = {(r["fold"], r["_id"]): r["prediction"] for r in pred.collect()}
    weights = {(r["fold"], r["feature"]): r["importance"] for r in importance.collect()}
    assert {f for f, _ in got} == set(folds)
    for fold in folds:
        used = [c for c in COLUMNS if c != "kind_none" and not (c == "kind_B" and fold == "x")]
        assert {c for f, c in weights if f == fold} == set(used)
        (x, y), held = rows_of(table, fold, used)
        mean, std = (x.mean(), x.std()) if standardize else (0.0, 1.0)
        z = (x - mean) / std
        at = z.mean(0)
        beta = np.array([weights[fold, c] for c in used])
        # optimality of the fit, checked on the rows
        slope = (z - at).T @ (y - y.mean() - (z - at) @ beta) / len(y)
        if model.l1:
            assert np.all(np.abs(slope) <= model.l1 * (1 + 1e-4) + 1e-4)
            assert np.all(np.abs(slope[beta != 0] - model.l1 * np.sign(beta[beta != 0])) < 1e-3 * max(1, np.abs(z).max() ** 0.5))
        else:
            assert np.abs(slope - model.l2 * beta / len(y)).max() < 1e-4 * max(1.0, np.abs(z - at).max())
        b = y.mean() - at @ beta
        for r in held:
            want = b + ((np.array([float(r[c]) for c in used]) - mean) / std) @ beta
            assert got[fold, r["_id"]] == pytest.approx(want, rel=1e-5)


def test_lasso_as_spark_ml(table):
    columns = ["rooms", "kind_A"]
    train = evaluation.assembled(table.filter("fold = 'y'"), columns)
    model = gram.Linear(l1=2.0)(train).setTol(1e-12).setMaxIter(1000).fit(train)
    moments, _ = gram.moments_by_fold(
        table.filter("fold = 'y'").unionByName(table.filter("fold = 'x'").limit(1)), ["x"], columns)
    beta, intercept = gram.Linear(l1=2.0).solve(moments["x"])
    assert beta == pytest.approx(model.coefficients.toArray(), rel=1e-4)
    assert intercept == pytest.approx(model.intercept, rel=1e-4)


def test_missing_values_and_folds_are_named(table):
    with pytest.raises(ValueError, match="NULL"):
        gram.moments_by_fold(table.withColumn("area", F.when(F.col("_id") != 3, F.col("area"))), ["x"], ["area"])
    with pytest.raises(ValueError, match="no training rows"):
        gram.moments_by_fold(table.filter("fold = 'x'"), ["x"], ["area"])


def test_sums_of_flags_cancel_only_when_all_are_zero(table):
    signed = table.withColumn("kind_A", F.when(F.col("_id") % 10 == 1, 1).when(F.col("_id") % 10 == 6, -1).otherwise(0))
    _, importance = evaluation.linear_folds(signed, ["x"], gram.Linear(), ["rooms", "kind_A", "kind_none"], ["_id"])
    assert {r["feature"] for r in importance.collect()} == {"rooms", "kind_A"}
