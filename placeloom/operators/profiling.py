"""Table profiles: counts, summaries, histograms and box-plot figures, each in one or two passes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.session import write_once

BINS = 256
# Accuracy of the sketch: its ranks are off by at most one in so many.
SKETCH = 10_000


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``(column, count)``, missing values left out, most frequent first."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))
    return counted.orderBy(F.desc("count"), column)


def pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("count"))


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, missing)``, most missing first, in one pass."""
    columns = columns or df.columns
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
    long = one.unpivot([], list(columns), "column", "missing")
    return long.orderBy(F.desc("missing"), "column")


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column``, ``v`` for each value; NaN counts as missing, like NULL."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns
    ])).alias("r")).select("r.*").filter(F.col("v").isNotNull() & ~F.isnan("v"))


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, dict[float, float]]:
    """Exact, linearly interpolated quantiles in two passes over the table, without sorting or gathering the values.

    The first pass makes a mergeable sketch whose ranks are off by at most 1 / ``SKETCH``, which brackets every order
    statistic. The second counts what lies below each bracket and the values inside it, some 4 / ``SKETCH`` of all; only
    these are written and narrowed further, ``BINS`` bins at a time, until the bounds meet.
    """
    long = _long(df, columns)
    margin = 2 / SKETCH
    near = [min(max(p + side, 0.0), 1.0) for p in probs for side in (-margin, margin)]
    ends = long.groupBy("column").agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.percentile_approx("v", F.array(*map(F.lit, near)), SKETCH).alias("near")).collect()
    places = {r["column"]: {p: p * (r["n"] - 1) for p in probs} for r in ends}
    brackets = [(r["column"], i, r["near"][2 * i] if near[2 * i] > 0 else r["lo"], r["near"][2 * i + 1] if near[2 * i + 1] < 1 else r["hi"])
                for r in ends for i in range(len(probs))]
    if not brackets:
        return {}
    values = _in_brackets(long, brackets)
    below = {(r["column"], r["i"]): (r["below"], r["n"]) for r in values.groupBy("column", "i").agg(
        F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("below"), F.sum("n").alias("n")).collect()}

    def ranks(column: str, i: int) -> set[int]:
        place = places[column][probs[i]]
        return {math.floor(place), math.ceil(place)}

    # the sketch keeps its promise; a bracket that did not would be opened to the ends
    whole = {r["column"]: (r["lo"], r["hi"]) for r in ends}
    missed = [(c, i, *whole[c]) for c, i, _, _ in brackets if not all(
        below.get((c, i), (0, 0))[0] <= rank < below.get((c, i), (0, 0))[1] for rank in ranks(c, i))]
    if missed:
        lost = {(c, i) for c, i, _, _ in missed}
        brackets = [b for b in brackets if b[:2] not in lost] + missed
        below |= dict.fromkeys(lost, (0, 0))
        values = _in_brackets(long, brackets)
    targets = {(c, i, rank): [lo, hi, below[c, i][0]] for c, i, lo, hi in brackets for rank in ranks(c, i)}
    values = values.filter("v is not null")
    while unmet := [(c, i, rank, lo, hi) for (c, i, rank), (lo, hi, _) in targets.items() if lo < hi]:
        # one row for each wanted order statistic
        bounds = F.broadcast(df.sparkSession.createDataFrame(unmet, "column string, i int, rank long, lo double, hi double"))
        part = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS).cast("int")
        bins = (
            values.join(bounds, ["column", "i"]).filter(F.col("v").between(F.col("lo"), F.col("hi")))
            .groupBy("column", "i", "rank", F.least(part, F.lit(BINS - 1)).alias("bin"))
            .agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect())
        found = set()
        for row in sorted(bins, key=lambda r: r["bin"]):
            key = (row["column"], row["i"], row["rank"])
            if key in found:
                continue
            target = targets[key]
            if target[2] + row["n"] > row["rank"]:
                target[:] = [row["lo"], row["hi"], target[2]]
                found.add(key)
            else:
                target[2] += row["n"]

    def value(column: str, i: int) -> float:
        place = places[column][probs[i]]
        low, high = (targets[column, i, rank][0] for rank in (math.floor(place), math.ceil(place)))
        return low + (place - math.floor(place)) * (high - low)

    return {c: {p: value(c, i) for i, p in enumerate(probs)} for c in places}


def _in_brackets(long: DataFrame, brackets: list[tuple]) -> DataFrame:
    """``(column, i, v, n)``: values inside each bracket with their counts, and the count below it as ``v`` NULL."""
    rows = F.broadcast(long.sparkSession.createDataFrame(brackets, "column string, i int, lo double, hi double"))
    kept = long.join(rows, "column").filter(F.col("v") <= F.col("hi"))
    counted = kept.groupBy("column", "i", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count("*").alias("n"))
    return write_once(counted, "brackets")


def _quartiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, p25, p50, p75)``, one row per column."""
    found = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    rows = [(c, *q.values()) for c, q in found.items()]
    return df.sparkSession.createDataFrame(rows, "column string, p25 double, p50 double, p75 double")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: count, mean, std, min, quartiles, max; quartiles are exact and interpolated."""
    stats = _long(df, columns).groupBy("column").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    return stats.join(F.broadcast(_quartiles(df, columns)), "column").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def correlation_shift(df: DataFrame, a: str, b: str, condition: Column) -> DataFrame:
    """Pearson correlation before and after a filter, and the difference, in one pass."""
    one = df.agg(
        F.corr(a, b).alias("corr_before"),
        F.corr(F.when(condition, F.col(a)), F.when(condition, F.col(b))).alias("corr_after"))
    return one.withColumn("shift", F.col("corr_after") - F.col("corr_before"))


def _bin(v: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin; the last one is closed on the right."""
    width = (high - low) / bins
    raw = F.when(high > low, F.floor((v - low) / width)).otherwise(F.lit(0))
    return F.least(raw.cast("int"), F.lit(bins - 1))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """``(bin, low, high, count)`` with empty bins kept. The range is one row, so it is broadcast."""
    data = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = data.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    filled = data.join(F.broadcast(ends)).groupBy(_bin(F.col("v"), F.col("lo"), F.col("hi"), bins).alias("bin")) \
        .agg(F.count("*").alias("count"))
    width = (F.col("hi") - F.col("lo")) / bins
    frame = ends.filter(F.col("lo").isNotNull()).select(
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", width.alias("w"))
    return frame.join(filled, "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"),
        F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def histogram_2d(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """``(x_bin, y_bin, count)`` of the occupied cells of an equal-width grid."""
    data = df.select(F.col(x).alias("x"), F.col(y).alias("y")).na.drop()
    ends = data.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return data.join(F.broadcast(ends)).groupBy(
        _bin(F.col("x"), F.col("x0"), F.col("x1"), bins).alias("x_bin"),
        _bin(F.col("y"), F.col("y0"), F.col("y1"), bins).alias("y_bin"),
    ).agg(F.count("*").alias("count"))


def box_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: quartiles, whiskers at 1.5 interquartile ranges (drawn at the last value inside) and the
    number of outliers."""
    reach = 1.5 * (F.col("p75") - F.col("p25"))
    inside = F.col("v").between(F.col("p25") - reach, F.col("p75") + reach)
    return _long(df, columns).join(F.broadcast(_quartiles(df, columns)), "column").groupBy(
        "column", "p25", "p50", "p75").agg(
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))


def group_means(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    return df.groupBy(by).agg(*[F.avg(c).alias(c) for c in columns])


def share_of_total(df: DataFrame, by: str) -> DataFrame:
    """``(by, count, share)``. The total is one row from a second aggregate, not a single-task window."""
    counts = df.groupBy(by).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("_total"))
    return counts.join(F.broadcast(total)).select(by, "count", (F.col("count") / F.col("_total")).alias("share"))


def median_point(df: DataFrame, lat: str = "lat", lon: str = "lon") -> tuple[float | None, float | None]:
    """Exact median latitude and longitude; None where a column has no value."""
    found = exact_quantiles(df, [lat, lon], [0.5])
    return tuple(found[c][0.5] if c in found else None for c in (lat, lon))


def absent_levels(df: DataFrame, train: Column, columns: list[str]) -> DataFrame:
    """``(column)``: columns with at most two distinct values whose sum over the training rows is 0.

    A column has at most two distinct values exactly when none differs from both its ends, so two plain
    aggregates do; a distinct count per column would repeat every row once per column.
    """
    seen = df.filter(train).select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    ends = seen.agg(*[e for c in columns for e in (
        F.min(f"`{c}`").alias(f"{c}|lo"), F.max(f"`{c}`").alias(f"{c}|hi"), F.sum(f"`{c}`").alias(f"{c}|sum"))])
    between = seen.join(F.broadcast(ends)).agg(*[
        F.struct(F.lit(c).alias("column"), F.first(f"`{c}|sum`").alias("total"),
                 F.count_if((F.col(f"`{c}`") != F.col(f"`{c}|lo`")) & (F.col(f"`{c}`") != F.col(f"`{c}|hi`")))
                 .alias("inner")).alias(c)
        for c in columns])
    rows = F.array(*[F.col(f"`{c}`") for c in columns])
    return between.select(F.inline(rows)).filter((F.col("total") == 0) & (F.col("inner") == 0)).select("column")
