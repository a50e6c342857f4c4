"""Incremental extraction of articles from a folder that receives dump parts."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from placeloom.functions import geo
from placeloom.operators import articles
from placeloom.sources.pages import PAGE_OPTIONS, PAGE_SCHEMA, _fields


def ingest_new_parts(
    spark: SparkSession, folder: str, out: str, progress: str, box=geo.USA_BOX, pattern: str = "*.xml-p*",
    parts_per_step: int = 64,
) -> StreamingQuery:
    """Extract the articles of parts not seen before, append them to ``out``, and stop.

    ``progress`` is the checkpoint folder: it records finished parts, so a second run skips them and a
    failed one resumes, each part landing exactly once.
    """
    pages = (
        spark.readStream.format("xml").options(**PAGE_OPTIONS).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", parts_per_step).schema(PAGE_SCHEMA).load(folder)
    )
    found = articles.extract(_fields(pages).select("title", "text"), box)
    return (
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress)
        .trigger(availableNow=True).outputMode("append").start()
    )
