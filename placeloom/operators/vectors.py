"""Document vectors: weighted sums around a house, k nearest, and cosine similarity."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom.operators import spatial
from placeloom.operators.blocks import weighted_sums
from placeloom.operators.skew import salted_join
from placeloom.session import write_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Wanted rows that meet a batch in one product.
WANTED_AT_ONCE = 256


def sum_vectors(rows: DataFrame, key: str, vec: str, weight: Column) -> DataFrame:
    """``(key, pos, value)``: weighted sum per dimension."""
    return rows.select(key, weight.alias("_w"), F.posexplode(vec).alias("pos", "_v")).groupBy(key, "pos").agg(
        F.sum(F.col("_w") * F.col("_v").cast("double")).alias("value"))


def _vector_places(articles: DataFrame, vec: str) -> tuple[DataFrame, DataFrame]:
    """Places with a vector, ``(lat, lon, n_articles)``, and the located articles ``(lat, lon, vec)``."""
    at = articles.select("lat", "lon", vec).na.drop(subset=["lat", "lon"])
    counts = at.groupBy("lat", "lon").agg(F.count("*").alias("n_articles"), F.max(F.coalesce(F.size(vec), F.lit(0))).alias("_longest"))
    return counts.filter("_longest > 0").drop("_longest"), at


def weighted_vectors(
    houses: DataFrame, articles: DataFrame, size: int, radius_m: float, key: str = "house_id", vec: str = "vec",
    min_articles: int = 3, **block_sizes: int,
) -> DataFrame:
    """Distance-weighted vector sum ``(key, article_count, part, vec)``.

    Houses with fewer than ``min_articles`` articles in range have no row. Vectors of articles that
    share a place are added first.
    """
    counts, at = _vector_places(articles, vec)
    sums = at.select("lat", "lon", F.posexplode(vec).alias("p", "v")).repartition("lat", "lon").groupBy("lat", "lon", "p").agg(
        F.sum(F.col("v").cast("double")).alias("v"))
    cells = sums.groupBy("lat", "lon").agg(F.collect_list(F.struct("p", "v")).alias("c"))
    places = write_once(counts.join(cells, ["lat", "lon"]).select(
        "lat", "lon", "n_articles", F.col("c.p").alias("pos"), F.col("c.v").alias("val")), "places")
    found = weighted_sums(houses, places, size, radius_m, True, key, **block_sizes)
    return found.filter(F.col("article_count") >= min_articles)


def vector_article_counts(
    houses: DataFrame, articles: DataFrame, radius_m: float, key: str = "house_id", vec: str = "vec", **block_sizes: int,
) -> DataFrame:
    """``(key, article_count)`` for every house: articles in range at places with a vector; no vector is read."""
    none = [F.array().cast("array<int>").alias("pos"), F.array().cast("array<double>").alias("val")]
    places = _vector_places(articles, vec)[0].select("*", *none)
    found = weighted_sums(houses, places, 0, radius_m, True, key, **block_sizes)
    return houses.select(key).join(found.select(key, "article_count"), key, "left").select(
        key, F.coalesce("article_count", F.lit(0).cast("long")).alias("article_count"))


def nearest_vectors(
    houses: DataFrame, articles: DataFrame, k: int = 10, key: str = "house_id", article_key: str = "article_id",
    vec: str = "vec", rows_per_task: int = 200_000,
) -> DataFrame:
    """``(key, pos, value)``: unweighted vector sum of the ``k`` nearest articles."""
    near = spatial.nearest(
        houses, articles.select(article_key, "lat", "lon"), k, key, article_key, rows_per_task=rows_per_task)
    near = write_once(near.select(key, article_key), "nearest")
    rows = salted_join(near, articles.select(article_key, vec), [article_key], [key], rows_per_task)
    # the vectors move whole, before they are unfolded; the sums then need no further shuffle
    return sum_vectors(rows.repartition(key), key, vec, F.lit(1.0))


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def most_similar(vectors: DataFrame, wanted: DataFrame, k: int, key: str, vec: str, block: int = 4096) -> DataFrame:
    """``(wanted_key, key, similarity)``: for each wanted vector the ``k`` others closest by cosine.

    The wanted rows go out in blocks of bounded size. Each block meets every vector once, as a matrix product per
    Arrow batch, of which only the best ``k`` per wanted row leave the batch; these are merged by wanted row. Null
    vectors and those of length 0 have no similarity and are left out.
    """
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType
    usable = F.col(vec).isNotNull() & (_dot(F.col(vec), F.col(vec)) > 0)
    rows = vectors.filter(usable).select(key, F.col(vec).cast("array<double>").alias("_vec"))
    queries = wanted.filter(usable).select(F.col(key).alias("_key"), F.col(vec).cast("array<double>").alias("_vec")).distinct()
    blocks = max(1, -(-queries.count() // block))
    schema = T.StructType([T.StructField("wanted_key", kind), T.StructField(key, kind), T.StructField("similarity", T.DoubleType())])
    found = spark.createDataFrame([], schema)
    for part in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("_key"), F.lit(blocks)) == part).collect()  # about ``block`` rows
        if own:
            shared = spark.sparkContext.broadcast(([r["_key"] for r in own], _unit(np.array([r["_vec"] for r in own]))))
            found = found.union(rows.mapInPandas(partial(_best, shared, k, key), schema))
    order = Window.partitionBy("wanted_key").orderBy(F.desc("similarity"), key)
    return found.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).drop("_rank")


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _best(shared, k: int, key: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names, wanted = shared.value
    for batch in batches:
        if len(batch):
            keys, own = batch[key].to_numpy(), batch[key].to_numpy().astype(object)
            rows = _unit(np.stack(batch["_vec"].to_numpy())).T
            for start in range(0, len(names), WANTED_AT_ONCE):
                some = names[start:start + WANTED_AT_ONCE]
                closeness = wanted[start:start + WANTED_AT_ONCE] @ rows
                closeness[np.array(some, dtype=object)[:, None] == own[None, :]] = -np.inf
                for name, row in zip(some, closeness):
                    order = np.lexsort((keys, -row))[:k]
                    order = order[row[order] > -np.inf]
                    yield pd.DataFrame({"wanted_key": [name] * len(order), key: keys[order], "similarity": row[order]})
