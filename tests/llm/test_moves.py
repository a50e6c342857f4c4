"""What operators move between tasks, and what they keep for the next one."""

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from placeloom.llm import bpe, line_chunks, warc_fixity


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_archive_moves_texts_once(spark):
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>") for i in range(20)] + [(3, "u", "<p>3</p>")], "page_id long, url string, html string")
    found = warc_fixity.archive(pages)
    assert plan(found).count("Exchange hashpartitioning") == 1
    assert found.filter("copies = 2").count() == 1 and found.count() == 20


def test_pieces_stay_known_for_the_next_task():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    first = bpe._transducer(path)
    ids = first.encode("ofthoratan ofthoratan x")
    second = bpe._transducer(path)
    assert "ofthoratan" in second.known
    assert second.encode("ofthoratan ofthoratan x") == ids


class Rows:
    """Stands for a table: hands back the function of the Python workers."""

    schema = T.StructType([T.StructField("_doc", T.LongType())])

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_workers_hold_a_part_of_a_batch_and_nothing_of_other_stages(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    bpe._transducer(path)
    n = 3000
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n)), pa.array(range(n)), pa.array([f"a{i}\nb{i}\n" for i in range(n)])], names=["_doc", "_th", "_text"])
    parts = list(line_chunks._chunk_rows(Rows(), 2, True)(iter([batch])))
    assert sum(p.num_rows for p in parts) == n and max(p.num_rows for p in parts) <= 512
    places = pa.concat_arrays([p.column(0) for p in line_chunks._chunk_rows(Rows(), 2, False)(iter([batch]))])
    assert places.to_pylist() == list(range(n))
    assert bpe._transducer.cache_info().currsize == 0 and bpe.loaded.cache_info().currsize == 0
