"""Row numbers and fixed orders over whole tables without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeloom.session import write_once


def numbered(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Number rows from 0 in ``order``: range-sorted, numbered within each part, shifted by the part sizes.

    The parts are written once, since part numbers must not change between the count and the numbering.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism
    sorted_rows = write_once(
        df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "order")
    sizes = sorted_rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_part").orderBy(*order)
    return (
        sorted_rows.withColumn("_row", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_row") + F.col("_offset"))
        .drop("_part", "_row", "_offset")
    )


def shuffle_key(key: str, seed: int = 42):
    """A sort key in random order that depends only on ``key`` and ``seed``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in random order."""
    return df.orderBy(shuffle_key(key, seed), key)


def by_number_suffix(df: DataFrame, column: str) -> DataFrame:
    """Sort names such as ``district_2`` before ``district_10``."""
    return df.orderBy(F.substring_index(column, "_", -1).try_cast("int"), column)


def top(df: DataFrame, by: str, k: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(k)


def in_order_of(df: DataFrame, reference: DataFrame, key: str, position: str, first_by: str) -> DataFrame:
    """Rows of ``df`` in the key order of ``reference``; the first row (lowest ``first_by``) of each key."""
    one = Window.partitionBy(key).orderBy(first_by)
    firsts = df.withColumn("_first", F.row_number().over(one)).filter(F.col("_first") == 1).drop("_first")
    return reference.select(key, position).join(firsts, key).orderBy(position)
