"""Error measures of a prediction table, each table in one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEASURES = ["mae", "rmse", "mape", "r2"]


def measures(pred: DataFrame, by: list[str] | None = None, y: str = "y", p: str = "prediction") -> DataFrame:
    """``(*by, n, mae, rmse, mape, r2)``; MAPE skips labels of 0, R2 is NULL for a constant label."""
    err = F.col(y) - F.col(p)
    squares = F.sum(err * err)
    spread = F.var_pop(y) * F.count(y)
    return pred.groupBy(*(by or [])).agg(
        F.count(y).alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(F.abs(F.try_divide(err, F.col(y)))) * 100).alias("mape"),
        (1 - F.try_divide(squares, spread)).alias("r2"))


def residuals(pred: DataFrame, y: str = "y", p: str = "prediction") -> DataFrame:
    return pred.withColumn("error", F.col(y) - F.col(p))


def mean_and_spread(per_fold: DataFrame) -> DataFrame:
    """``(measure, mean, std)`` over folds, unweighted, population deviation."""
    long = per_fold.unpivot([], MEASURES, "measure", "v")
    return long.groupBy("measure").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def weighted_mean_and_spread(per_fold: DataFrame) -> DataFrame:
    """``(measure, mean, std)`` over folds, each weighted by its number of rows."""
    long = per_fold.unpivot(["n"], MEASURES, "measure", "v")
    one = long.groupBy("measure").agg(
        (F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("mean"))
    joined = long.join(F.broadcast(one), "measure")  # one row per measure
    off = F.col("v") - F.col("mean")
    return joined.groupBy("measure", "mean").agg(
        F.sqrt(F.sum(F.col("n") * off * off) / F.sum("n")).alias("std"))


def reported(summary: DataFrame) -> DataFrame:
    """Rounded as in the printed report: MAE and RMSE whole, MAPE two digits, R2 three; ties to even."""
    def rounded(c: str):
        m, v = F.col("measure"), F.col(c)
        return F.when(m.isin("mae", "rmse"), F.bround(v, 0)).when(m == "mape", F.bround(v, 2)).otherwise(
            F.bround(v, 3)).alias(c)

    return summary.select("measure", rounded("mean"), rounded("std"))


def results_table(summaries: dict[str, DataFrame], order: list[str] | None = None) -> DataFrame:
    """One row per measure, one column per model, in the wanted order."""
    order = order or list(summaries)
    union = None
    for name in order:
        part = summaries[name].select("measure", F.lit(name).alias("model"), "mean")
        union = part if union is None else union.unionByName(part)
    return union.groupBy("measure").pivot("model", order).agg(F.first("mean"))


def with_group_means(per_fold: DataFrame, table: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Measures per district next to district means; a district on one side only is kept."""
    means = table.groupBy(by).agg(*[F.avg(c).alias(c) for c in columns])
    return per_fold.join(means, by, "full_outer")
