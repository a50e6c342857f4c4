"""Fitting and validating Spark ML regressors on feature tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate
from multiprocessing.pool import ThreadPool

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.operators import cleaning, gram, metrics
from placeloom.operators.folds import k_folds
from placeloom.operators.profiling import absent_levels
from placeloom.session import write_once

# Columns of the house table that are never features.
ZONE_COLUMNS = ["PROPERTYZIP", "MUNICODE", "SCHOOLCODE", "NEIGHCODE"]
NOT_FEATURES = ["_id", *ZONE_COLUMNS, "SALEDATE", "SALEPRICE", "FAIRMARKETTOTAL", "latitude", "longitude",
                "SALEYEAR", "DISTRICT"]

FOLDS_AT_ONCE = 4
GROUP_ROWS = 1_000_000

Maker = Callable[[DataFrame], object]


def feature_columns(df: DataFrame, dummies: list[str] | None = None, drops: list[str] | None = None) -> list[str]:
    """Feature columns of a house table: everything but keys, label, zones and ``drops``."""
    out = [c for c in NOT_FEATURES if c not in (dummies or [])] + (drops or [])
    return [c for c in df.columns if c not in out]


# A maker takes the training rows and returns an unfitted estimator on columns ``features`` and ``y``.


def linear() -> Maker:
    return gram.Linear()


def lasso(alpha: float = 1.0) -> Maker:
    return gram.Linear(l1=alpha)


def ridge(alpha: float = 1.0) -> Maker:
    """Penalty ``alpha`` on the squared coefficients of the summed squared error."""
    return gram.Linear(l2=alpha)


@dataclass(frozen=True)
class Trees:
    """Gradient-boosted trees. Called with training rows, an unfitted Spark ML estimator."""

    rounds: int
    depth: int
    seed: int

    def __call__(self, train: DataFrame) -> GBTRegressor:
        weight = {"weightCol": "_weight"} if "_weight" in train.columns else {}
        return GBTRegressor(labelCol="y", maxIter=self.rounds, maxDepth=self.depth, seed=self.seed, **weight)

    def merged(self, train: DataFrame) -> DataFrame:
        """The training rows of a large table, ready for the many scans of a fit.

        Rows with equal features are one row with their mean label and their number as weight: squared error differs
        between splits only by sums over such rows, so they make the same trees. Where hardly any are equal, the rows
        are dealt to tasks of ``GROUP_ROWS``."""
        found = train.agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64(vector_to_array("features"))).alias("kinds")).first()
        if found["n"] <= GROUP_ROWS:
            return train
        if found["kinds"] * 2 > found["n"]:
            return train.select("y", "features").repartition(-(-found["n"] // GROUP_ROWS))
        # a row without label stays an error
        label = F.when(F.count("y") == F.count("*"), F.avg("y"))
        return train.groupBy("features").agg(label.alias("y"), F.count("*").cast("double").alias("_weight"))


def boosted_trees(rounds: int = 20, depth: int = 5, seed: int = 42) -> Maker:
    return Trees(rounds, depth, seed)


def fitted(make: Maker, train: DataFrame):
    """The model that ``make`` fits to the training rows."""
    if isinstance(make, Trees):
        train = make.merged(train)
    return make(train).fit(train)


def assembled(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out).transform(df)


def whole_scale(train: DataFrame, columns: list[str]) -> tuple[float, float]:
    """Mean and population deviation over all values of all columns together, from per-column sums."""
    def total(of) -> float:
        return sum(train.agg(*[F.sum(of(F.col(f"`{c}`").cast("double"))).alias(c) for c in columns]).first())

    n = train.count() * len(columns)
    mean = total(lambda v: v) / n
    return mean, (total(lambda v: (v - mean) * (v - mean)) / n) ** 0.5


def column_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, mean, std)`` per column, sample deviation."""
    one = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c)["mean"].alias("mean"),
                              F.col(c)["std"].alias("std")) for c in columns])
    return one.select(F.inline(rows))


def flag_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if "_" in c]


def fit_fold(
    df: DataFrame, fold, make: Maker, columns: list[str], keep: list[str], standardize: bool = False,
    vector_names: dict[str, list[str]] | None = None,
):
    """Train on every other fold, predict this one: ``(predictions, importance rows)``.

    Levels that the training rows never show are left out of the features. ``vector_names`` names the
    entries of columns that hold vectors.
    """
    vector_names = vector_names or {}
    in_train = F.col("fold") != F.lit(fold)
    flags = flag_columns([c for c in columns if c not in vector_names])
    absent = {r["column"] for r in absent_levels(df, in_train, flags).collect()} if flags else set()
    used = [c for c in columns if c not in absent]
    scaled = df
    if standardize:
        mean, std = whole_scale(df.filter(in_train), used)
        scaled = df.withColumns({c: (F.col(f"`{c}`") - mean) / std for c in used})
    rows = assembled(scaled.select(*keep, "fold", "y", *used), used).select(*keep, "fold", "y", "features")
    train = rows.filter(in_train)
    model = fitted(make, train)
    scores = model.coefficients if hasattr(model, "coefficients") else model.featureImportances
    names = [n for c in used for n in vector_names.get(c, [c])]
    importance = [(str(fold), c, float(v)) for c, v in zip(names, scores.toArray(), strict=True)]
    return model.transform(rows.filter(~in_train)).drop("features"), importance


def leave_one_out(
    df: DataFrame, folds: list, make: Maker, columns: list[str], keep: list[str], standardize: bool = False,
    vector_names: dict[str, list[str]] | None = None, repeated: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Predict every fold from all the others.

    ``df`` has ``fold``, ``y``, the feature ``columns`` and the ``keep`` columns. Returns the predictions of
    all rows (with ``error``) and ``(fold, feature, importance)``. ``repeated``: the features take few different values
    together (see :func:`gram.moments_by_fold`). Linear models are fitted from sums that one scan gives
    for all folds. For other models the table is written once; folds are fitted a few at a time so that small ones do not
    leave the cluster idle.
    """
    if isinstance(make, gram.Linear):
        return linear_folds(df, folds, make, columns, keep, standardize, vector_names, repeated)
    table = write_once(df.select(*dict.fromkeys([*keep, "fold", "y", *columns])), "folds")
    with ThreadPool(FOLDS_AT_ONCE) as pool:
        fitted = pool.map(lambda f: fit_fold(table, f, make, columns, keep, standardize, vector_names), folds)
    predictions = fitted[0][0]
    for part, _ in fitted[1:]:
        predictions = predictions.unionByName(part)
    importance = df.sparkSession.createDataFrame(
        [row for _, rows in fitted for row in rows], "fold string, feature string, importance double")
    return metrics.residuals(predictions), importance


def linear_folds(
    df: DataFrame, folds: list, model: gram.Linear, columns: list[str], keep: list[str], standardize: bool = False,
    vector_names: dict[str, list[str]] | None = None, repeated: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """``leave_one_out`` for linear models: one scan for all fits, one for the predictions."""
    folds = [str(f) for f in folds]
    wide = {c: len(names) for c, names in (vector_names or {}).items() if c in columns}
    if wide:
        df = df.withColumns({c: vector_to_array(c) for c in wide})
    sources, columns = columns, [n for c in columns for n in (vector_names or {}).get(c, [c])]
    flags = flag_columns([c for c in sources if c not in wide])
    moments, sums = gram.moments_by_fold(df, folds, sources, flags, wide, repeated)
    ends = list(accumulate((wide.get(c, 1) for c in sources), initial=0))
    plain = {i for i, c in zip(ends, sources) if c not in wide}  # a term may be called like a column
    weights, importance = [], []
    for fold in folds:
        absent = {c for c, total, squares in zip(flags, *sums[fold], strict=True) if total == 0 and squares == 0}
        # values that cancel out need the count of distinct values too; never so for 0/1 flags
        odd = [c for c, total, squares in zip(flags, *sums[fold], strict=True) if total == 0 and squares > 0]
        if odd:
            absent |= {r["column"] for r in absent_levels(df, F.col("fold") != fold, odd).collect()}
        used = [i for i, c in enumerate(columns) if c not in absent or i not in plain]
        train = moments[fold].part(used)
        mean, std = gram.overall_scale(train) if standardize else (0.0, 1.0)
        coefficients, intercept = model.solve(train.scaled(mean, std) if standardize else train)
        importance += [(fold, columns[i], float(v)) for i, v in zip(used, coefficients, strict=True)]
        row = [0.0] * len(columns)
        for i, v in zip(used, coefficients, strict=True):
            row[i] = float(v) / std
        weights.append((fold, row, intercept - mean * sum(row)))
    spark = df.sparkSession
    fitted = spark.createDataFrame(weights, "_fold string, _weights array<double>, _intercept double")
    rows = df.select(*dict.fromkeys([*keep, "fold", "y", *sources]))
    # one row per fold
    scored = rows.join(F.broadcast(fitted), F.col("fold").cast("string") == F.col("_fold")).select(
        *keep, "fold", "y", gram.linear_prediction(sources, wide=wide).alias("prediction"))
    return metrics.residuals(scored), spark.createDataFrame(importance, "fold string, feature string, importance double")


def cross_validation(
    df: DataFrame, make: Maker, columns: list[str], k: int = 5, key: str = "_id", seed: int = 42, repeated: bool = False,
):
    """Measures per random fold: ``(per_fold, summary)``."""
    pred, _ = leave_one_out(k_folds(df, key, k, seed), [str(i) for i in range(k)], make, columns, [key], repeated=repeated)
    per_fold = metrics.measures(pred, ["fold"])
    return per_fold, metrics.mean_and_spread(per_fold)


def zone_sweep(
    df: DataFrame, zones: list[str], make: Maker, columns: list[str], k: int = 5, key: str = "_id", seed: int = 42,
) -> DataFrame:
    """One row per measure, one column per zone key: each key in turn is encoded as 0/1 columns next to ``columns``, the
    other keys are left out, and the model is cross-validated."""
    summaries = {}
    for zone in zones:
        encoded = cleaning.one_hot(df.select(key, "y", *columns, zone), [zone])
        features = [c for c in encoded.columns if c not in (key, "y")]
        # a zone's 0/1 columns alone take as many values together as the zone
        summaries[zone] = cross_validation(encoded, make, features, k, key, seed, repeated=not columns)[1]
    return metrics.results_table(summaries)


def district_validation(
    df: DataFrame, make: Maker, columns: list[str], districts: list[str], key: str = "_id",
    district: str = "DISTRICT", standardize: bool = False, keep: list[str] | None = None,
):
    """Leave one district out: ``(predictions, per_district, summary, importance)``.

    Predictions keep their row's key, so errors stay with their house. Summary and importance are
    weighted by district size.
    """
    pred, importance = leave_one_out(
        df.withColumn("fold", F.col(district)), districts, make, columns, [key, *(keep or [])], standardize)
    per_district = metrics.measures(pred, ["fold"]).withColumnRenamed("fold", "district")
    return pred, per_district, metrics.weighted_mean_and_spread(per_district), weighted_importance(
        importance, per_district.withColumnRenamed("district", "fold"))


def weighted_importance(importance: DataFrame, per_fold: DataFrame) -> DataFrame:
    """``(feature, importance)`` averaged over folds by size; a fold that lacks the feature counts as 0."""
    total = per_fold.agg(F.sum("n").alias("_all"))
    share = per_fold.join(F.broadcast(total)).select("fold", (F.col("n") / F.col("_all")).alias("share"))
    return importance.join(F.broadcast(share), "fold").groupBy("feature").agg(
        F.sum(F.col("importance") * F.col("share")).alias("importance"))


def group_importance(importance: DataFrame, groups: dict[str, str]) -> DataFrame:
    """``(feature_group, importance)``: sums over named feature groups; ``groups`` maps feature to group."""
    table = importance.sparkSession.createDataFrame(list(groups.items()), "feature string, feature_group string")
    return importance.join(F.broadcast(table), "feature").groupBy("feature_group").agg(
        F.sum("importance").alias("importance"))


def coefficient_filter(importance: DataFrame) -> DataFrame:
    return importance.filter(F.col("importance") > 0)


def zero_counts(importance: DataFrame) -> DataFrame:
    return importance.agg(
        F.count("*").alias("coefficients"), F.count_if(F.col("importance") == 0).alias("zero"),
        F.count_if(F.col("importance") != 0).alias("non_zero"))


def eliminate_features(
    df: DataFrame, make: Maker, columns: list[str], step: int = 5, k: int = 5, key: str = "_id",
    at_least: int = 1, seed: int = 42,
) -> tuple[list[str], list[tuple[int, float]]]:
    """Recursive elimination: drop the ``step`` weakest features while any are left, score each set by
    cross-validation, and return the best set and the ``(size, mean RMSE)`` history."""
    left, best, history = list(columns), list(columns), []
    while left:
        per_fold, summary = cross_validation(df, make, left, k, key, seed)
        rmse = summary.filter("measure = 'rmse'").first()["mean"]
        if not history or rmse <= min(r for _, r in history):
            best = list(left)
        history.append((len(left), rmse))
        if len(left) <= at_least:
            break
        rows = assembled(df.select("y", *left), left)
        model = fitted(make, rows)
        scores = model.coefficients if hasattr(model, "coefficients") else model.featureImportances
        ranked = sorted(zip(left, map(abs, scores.toArray())), key=lambda x: x[1], reverse=True)
        keep = max(at_least, len(left) - step)
        names = {c for c, _ in ranked[:keep]}
        left = [c for c in left if c in names]
    return best, history


def dropped_features(columns: list[str], kept: list[str], protect: str | None = None) -> list[str]:
    """Columns outside the selection, but never those of the protected zone."""
    return [c for c in columns if c not in kept and not (protect and protect in c)]


# Feature sets that are compared, by the letters used in the result tables.
FEATURE_SETS = ["S", "S+D", "S+D+C", "S+T", "S+C", "T", "S+T+C"]


def feature_set(groups: dict[str, list[str]], name: str) -> list[str]:
    """Columns of a feature set such as ``S+D``; ``groups`` maps a letter to its columns."""
    return [c for letter in name.split("+") for c in groups[letter]]
