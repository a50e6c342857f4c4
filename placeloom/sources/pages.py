"""Page dumps in XML, and link lists in HTML index pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.functions.markup import decode_entities

PAGE_OPTIONS = {"rowTag": "page", "ignoreSurroundingSpaces": "false"}
PAGE_SCHEMA = "title string, revision struct<timestamp: string, text: struct<_VALUE: string, _bytes: long>>"


def read_pages(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``(title, timestamp, text, part)`` of every page of an XML dump, compressed or not.

    One row element is one page; parts are read in parallel and bzip2 parts are split.
    """
    reader = spark.read.format("xml").options(**PAGE_OPTIONS).schema(PAGE_SCHEMA)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return _fields(reader.load(path)).withColumn("part", F.element_at(F.split(F.input_file_name(), "/"), -1))


def _fields(pages: DataFrame) -> DataFrame:
    return pages.select(
        "title", F.col("revision.timestamp").alias("timestamp"), F.col("revision.text._VALUE").alias("text"))


def write_pages(pages: DataFrame, path: str, compression: str = "bzip2") -> None:
    """Write ``(title, text)`` as an XML dump."""
    rows = pages.select("title", F.struct(
        F.lit("2020-12-01T00:00:00Z").alias("timestamp"),
        F.struct(F.col("text").alias("_VALUE"), F.length("text").cast("long").alias("_bytes")).alias("text"),
    ).alias("revision"))
    rows.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").option(
        "compression", compression).save(path)


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add one row per ``a`` element with an ``href``: column ``href``, entities decoded."""
    found = F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return pages.withColumn("href", F.explode(found)).withColumn("href", decode_entities(F.col("href")))


def file_items(pages: DataFrame, containing: str, html: str = "html", css_class: str | None = "file") -> DataFrame:
    """Add ``item`` (text of a list item holding ``containing``) and ``file`` (its first word)."""
    named = rf'[^>]*class="[^"]*\b{css_class}\b[^"]*"' if css_class else ""
    raw = F.regexp_extract_all(html, F.lit(rf"(?is)<li{named}[^>]*>(.*?)</li>"), F.lit(1))
    bare = F.transform(raw, lambda r: F.trim(decode_entities(F.regexp_replace(r, "<[^>]*>", ""))))
    items = pages.withColumn("item", F.explode(bare)).filter(F.contains("item", F.lit(containing)))
    return items.withColumn("file", F.regexp_extract("item", r"^(\S+)", 1))
