"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so (after a fixed pattern, between a least and a greatest size),
so equal texts have equal cuts. Chunks get 64-bit identifiers, which are verified: where chunks with one
identifier differ in their SHA-256, the digest takes its place. A document is then the ordered list of its
identifiers, and lists are compared, so long documents are read where they lie and never moved.

Rows: null counts as the empty text, which is equal to texts of no characters only (a text of blanks is one
space). Rows that repeat an id and a text all carry the same result. A null id is kept; the smallest
non-null id of a group stays. An empty table gives an empty result. Other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.session import write_once

LEAST, GREATEST = 256, 4096
# A chunk ends behind "e" and a blank, an event of the content that any language with Latin letters has often;
# in other scripts chunks simply reach the greatest size.
CHUNK = rf"(?s).{{{LEAST},{GREATEST}}}?(?:e |$)|.{{{GREATEST}}}|.+$"


def normalized(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def chunks(text: Column) -> Column:
    """The chunks of a text, in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), 0)


def _identifiers(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_recipe``: identifiers verified against digests over all chunks of the table."""
    digests = rows.select(F.explode(F.arrays_zip("_ids", "_digests")).alias("_c")).select("_c.*")
    doubtful = (
        digests.groupBy("_ids").agg(F.min("_digests").alias("_low"), F.max("_digests").alias("_high"))
        .filter("_low <> _high").select(F.col("_ids").alias("_id"), F.lit(True).alias("_doubtful")))
    if doubtful.isEmpty():  # the usual case: each identifier stands for one chunk
        return rows.select("_doc", "_sha", F.col("_ids").alias("_recipe"))
    places = rows.select("_doc", "_sha", F.posexplode(F.arrays_zip("_ids", "_digests")).alias("_at", "_c"))
    settled = places.join(doubtful, F.col("_c._ids") == F.col("_id"), "left").select(
        "_doc", "_sha", "_at",
        F.when(F.col("_doubtful"), F.expr("conv(substr(_c._digests, 1, 15), 16, 10)").cast("long"))
        .otherwise(F.col("_c._ids")).alias("_id"))
    lists = settled.groupBy("_doc", "_sha").agg(F.sort_array(F.collect_list(F.struct("_at", "_id"))).alias("_l"))
    spread = lists.select("_doc", "_sha", F.col("_l._id").alias("_recipe"))
    empty = rows.filter(F.size("_ids") == 0).select("_doc", "_sha", F.col("_ids").alias("_recipe"))
    return spread.unionByName(empty)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``keep_id`` of its group of equal texts, ``group_size``, ``kept``, ``text_sha256``."""
    text = normalized(F.col(text_col))
    cut = docs.select(F.col(id_col).alias("_doc"), text.alias("_t")).select(
        "_doc", F.sha2("_t", 256).alias("_sha"), chunks(F.col("_t")).alias("_chunks"))
    rows = write_once(cut.select(
        "_doc", "_sha", F.transform("_chunks", lambda c: F.xxhash64(c)).alias("_ids"),
        F.transform("_chunks", lambda c: F.substring(F.sha2(c, 256), 1, 32)).alias("_digests")), "chunks")
    recipes = _identifiers(rows)
    # Lists that occur once need no more work. The digest of the whole text is the exact check that follows.
    same = (
        recipes.groupBy("_recipe", "_sha").agg(F.min("_doc").alias("_keep"), F.count("*").alias("_n"))
        .filter("_n > 1"))
    return recipes.join(same, ["_recipe", "_sha"], "left").select(
        F.col("_doc").alias(id_col),
        F.coalesce("_keep", "_doc").alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_doc") == F.col("_keep"), F.col("_keep").isNull()).alias("kept"),
        F.col("_sha").alias("text_sha256"))
