"""A bitmap of fixed size over hashes: small enough to broadcast whatever the table, used only to save movement.

A clear bit says that a hash is not in the table. A set bit says nothing, so what passes is joined as usual.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 1 << 25  # 4 MiB
_WORD = 8 * 4096  # bits in one value of bitmap_construct_agg


def of(hashes: DataFrame, column: str) -> np.ndarray:
    """Bits of all values of a long column that holds hashes."""
    place = F.pmod(F.col(column), F.lit(BITS)) + 1
    parts = hashes.select(place.alias("_s")).groupBy(F.bitmap_bucket_number("_s").alias("_k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_s")).alias("_bits"))
    bits = np.zeros(BITS // 8, np.uint8)
    for row in parts.toLocalIterator():  # BITS in all
        bits[(row._k - 1) * _WORD // 8:row._k * _WORD // 8] = np.frombuffer(row._bits, np.uint8)
    return bits


def maybe(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For signed hashes: False where the table certainly lacks them."""
    place = hashes.astype(np.int64) & (BITS - 1)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def marked(rows: DataFrame, hashed: Column, table: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``_maybe``: whether the hash of the row may be in a column of hashes of ``table``."""
    bits = rows.sparkSession.sparkContext.broadcast(of(table, column))
    names = [*rows.columns, "_maybe"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(maybe(bits.value, hashes))], names=names)

    schema = T.StructType([*rows.schema.fields, T.StructField("_maybe", T.BooleanType())])
    return rows.withColumn("_hashed", hashed).mapInArrow(run, schema)
