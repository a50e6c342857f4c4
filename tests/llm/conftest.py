import random

import pytest
from odd_rows import prose
from pyspark.sql import types as T

# id, text and columns whose names clash with ones that operators use inside
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("_doc", T.StringType()),
    T.StructField("_th", T.StringType()), T.StructField("_key", T.StringType()), T.StructField("score", T.StringType())])


@pytest.fixture(scope="session")
def texts():
    """Null, empty and blank texts, repeats and near copies, a long text, one long run of a letter."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(20, 200)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t) for i, t in enumerate(base[:6])]
    rows += [(200 + i, t.replace("the", "THE", 1) + " tail") for i, t in enumerate(base[:8])]
    rows += [(300 + i, base[i] + "\n" + base[20] + "\n" + base[21]) for i in range(5)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "the"), (404, "the or"), (405, "a" * 3000), (406, prose(rng, 9000))]
    rows += [(407, "ab" * 700), (408, "THE\x0bor   an"), (409, "x<|endoftext|> y"), (None, base[3]), (None, "alone " * 60), (0, base[0])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in texts], SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
