import pytest
from pyspark.sql import functions as F

from placeloom.llm import quality


def test_every_labelled_row_teaches(spark):
    n = 52_000
    rows = spark.range(n).select(
        F.col("id").alias("_doc"), (F.col("id") % 3 > 0).cast("int").alias("_good"),
        F.array(*([(F.col("id") % 3 + F.pmod(F.xxhash64("id"), F.lit(1000)) / 400).alias("x")] + [F.lit(0.0)] * (len(quality.FEATURES) - 1))).alias("_x"))
    weights, threshold = quality.fit(rows)
    worths = sorted(r["w"] for r in rows.select(quality.worth(weights).alias("w")).collect())
    bad = rows.filter("_good = 0").count()
    assert threshold == pytest.approx((worths[bad - 1] + worths[bad]) / 2, abs=1e-12)
