"""Readers and writers: each query writes a table to the shared folder, reads it back and shows it."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeloom.operators import articles as art
from placeloom.plans import inputs
from placeloom.plans.inputs import IN_COUNTY, PAGE_FACTS
from placeloom.plans.registry import query, table
from placeloom.session import scratch_path
from placeloom.sources import files, pages, ranges


@query("csv_scan", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def csv_scan(spark, sf_dir):
    path = scratch_path(spark, "csv")
    files.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), path)
    return files.read_csv(spark, path, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string", own=True)


@query("csv_sink", "SELECT o_orderkey || ',' || o_orderstatus AS line FROM orders UNION ALL SELECT 'o_orderkey,o_orderstatus'")
def csv_sink(spark, sf_dir):
    path = scratch_path(spark, "csv")
    files.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), path)
    return spark.read.text(path).withColumnRenamed("value", "line").distinct()  # each file has the header


@query("round_trip_equality", "SELECT 0 AS only_left, 0 AS only_right")
def round_trip_equality(spark, sf_dir):
    path = scratch_path(spark, "csv")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    files.write_json_lines(docs, path)
    return files.same_rows(docs, files.read_json_lines(spark, path, docs.schema))


@query("variant_dataset", """
SELECT 3500 AS radius, 'NOMEAN' AS variant, c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 3500 GROUP BY 3""")
def variant_dataset(spark, sf_dir):
    path = scratch_path(spark, "variants")
    for radius in (1500, 2500, 3500):
        found = table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > radius).groupBy("c_mktsegment").agg(
            F.count("*").alias("n"))
        for variant in ("NOMEAN", "NOWEIGHT"):
            files.write_variant(found, path, radius=radius, variant=variant)
    return spark.read.parquet(path).filter("radius = 3500 AND variant = 'NOMEAN'").select(
        "radius", "variant", "c_mktsegment", "n")


@query("xml_pages", "SELECT 'Doc ' || doc_id AS title, md5(trim(text)) AS digest FROM documents")
def xml_pages(spark, sf_dir):
    path = scratch_path(spark, "xml")
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.trim("text").alias("text"))
    pages.write_pages(docs, path)
    return pages.read_pages(spark, path, "*.bz2").select("title", F.md5("text").alias("digest"))


@query("xml_articles", f"SELECT title AS name, round(lat, 6) AS lat, round(lon, 6) AS lon FROM ({PAGE_FACTS}) WHERE {IN_COUNTY}")
def xml_articles(spark, sf_dir):
    path = scratch_path(spark, "xml")
    pages.write_pages(inputs.pages(spark, sf_dir).select("title", "text"), path)
    found = art.extract(pages.read_pages(spark, path).select("title", "text"))
    return found.select("name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("foreign_csv", "SELECT doc_id, md5(text) AS digest, lang FROM documents")
def foreign_csv(spark, sf_dir):
    """CSV files whose texts hold line breaks and quotes, one from each task, read in byte ranges."""
    path = scratch_path(spark, "csv")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('"'), "lang", F.lit('",\n'), "text").alias("text"), "lang")
    docs.write.option("header", True).option("escape", '"').csv(path)
    back = files.read_csv(spark, path, "doc_id long, text string, lang string", range_bytes=1 << 20)
    return back.select("doc_id", F.md5(F.expr("substr(text, length(lang) + 5)")).alias("digest"), "lang")


# The documents as files named like dump parts, and some in a container that is left out.
_PART = "'dump-' || lang || (doc_id % 3) || '.xml-p' || doc_id || 'p' || (doc_id + n_chars) || '.txt'"
_FILES = f"(SELECT {_PART} AS file, strlen(text) AS bytes, n_chars AS pages FROM documents WHERE doc_id % 9 <> 0 AND strlen(text) > 0)"


FOLDERS = 512


def _part_files(spark, sf_dir, which="true"):
    """Folders that hold a file for each document."""
    folder = scratch_path(spark, "parts")
    kind = F.when(F.col("doc_id") % 9 == 0, "-multistream").otherwise("")
    name = F.concat(F.lit("dump-"), "lang", (F.col("doc_id") % 3).cast("string"), kind, F.lit(".xml-p"), F.col("doc_id").cast("string"), F.lit("p"),
                    (F.col("doc_id") + F.col("n_chars")).cast("string"), F.lit(".txt"))
    docs = table(spark, sf_dir, "documents").filter(which).select(
        name.alias("file"), F.col("text").alias("content"), F.pmod(F.crc32(name), F.lit(FOLDERS)).alias("home"))
    ranges.write_files(docs, folder, under="home")
    return [f"{folder}/{home}" for home in range(FOLDERS)]


@query("part_listing", f"SELECT file, bytes FROM {_FILES}")
def part_listing(spark, sf_dir):
    return files.list_parts(spark, _part_files(spark, sf_dir))


@query("json_lines_parts", "SELECT doc_id, lang, n_chars, text FROM documents")
def json_lines_parts(spark, sf_dir):
    path = scratch_path(spark, "json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "text")
    for part in range(3):
        files.write_json_lines(docs.filter(F.col("doc_id") % 3 == part), path, "append")
    return files.read_json_lines(spark, path, docs.schema)


_ARTICLE = ("SELECT 'Doc \"' || doc_id || '\"' AS name, 40 + doc_id / 1e4 AS lat, -80 - doc_id / 1e4 AS lon, "
            "CASE WHEN doc_id % 2 = 0 THEN lang END AS kind, md5(text) AS digest, source AS link, n_chars::INTEGER AS text_length FROM documents")


@query("positional_records", _ARTICLE)
def positional_records(spark, sf_dir):
    path = scratch_path(spark, "array")
    k = F.col("doc_id")
    records = table(spark, sf_dir, "documents").select(
        F.concat(F.lit('Doc "'), k.cast("string"), F.lit('"')).alias("name"), (40 + k / 10000.0).alias("lat"),
        (-80 - k / 10000.0).alias("lon"), F.when(k % 2 == 0, F.create_map(F.lit("kind"), F.col("lang"))).alias("templates"),
        "text", F.array("source").alias("wikilinks"), F.array(F.lit("http://x.org")).alias("ext_links"),
        F.col("n_chars").cast("int").alias("text_length"))
    ranges.write_json_array(files.article_to_array(records), path, single=False)
    back = files.article_from_array(ranges.read_json_array(spark, path, 1 << 20))
    return back.select("name", "lat", "lon", F.try_element_at("templates", F.lit("kind")).alias("kind"),
                       F.md5("text").alias("digest"), F.col("wikilinks")[0].alias("link"), "text_length")


@query("skip_if_written", "SELECT count(*) AS rows FROM customer")
def skip_if_written(spark, sf_dir):
    path = scratch_path(spark, "once")
    files.write_if_absent(table(spark, sf_dir, "customer"), path)
    files.write_if_absent(table(spark, sf_dir, "customer").filter("c_custkey < 5"), path)
    return spark.read.parquet(path).agg(F.count("*").alias("rows"))


@query("file_inventory", f"SELECT file, round(bytes / 1e6, 6) AS mb, pages FROM {_FILES}")
def file_inventory(spark, sf_dir):
    parts = files.list_parts(spark, _part_files(spark, sf_dir))
    return files.with_page_counts(parts).select("file", F.round("mb", 6).alias("mb"), "pages")


@query("file_inventory_totals", f"""
SELECT count(*) AS files, round(sum(bytes) / 1e6, 4) AS mb, CAST(sum(pages) AS BIGINT) AS pages FROM {_FILES}""")
def file_inventory_totals(spark, sf_dir):
    parts = files.list_parts(spark, _part_files(spark, sf_dir))
    return files.folder_totals(parts).select("files", F.round("mb", 4).alias("mb"), "pages")


@query("checksum_manifest", f"""
SELECT {_PART} AS file, CASE doc_id % 7 WHEN 1 THEN 'differs' WHEN 2 THEN 'missing' WHEN 3 THEN 'unlisted' ELSE 'ok' END AS status
FROM documents WHERE doc_id % 9 <> 0 AND strlen(text) > 0
UNION ALL SELECT {_PART.replace("'.xml-p'", "'-multistream.xml-p'")}, 'unlisted' FROM documents WHERE doc_id % 9 = 0 AND doc_id % 7 <> 2 AND strlen(text) > 0""")
def checksum_manifest(spark, sf_dir):
    path = scratch_path(spark, "sums")
    k = F.col("doc_id")
    folder = _part_files(spark, sf_dir, k % 7 != 2)
    md5 = F.md5("text")
    listed = F.when(k % 7 == 1, F.reverse(md5)).otherwise(md5)
    docs = table(spark, sf_dir, "documents").filter((k % 7 != 3) & (k % 9 != 0) & (F.length("text") > 0))
    docs.select(F.concat(listed, F.lit("  "), F.expr(_PART)).alias("value")).write.text(path)
    return files.verify(spark, folder, files.read_manifest(spark, path))


@query("html_links", """
SELECT href, count(*) AS count FROM (SELECT replace(unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1)), '&amp;', '&') AS href
FROM pages) GROUP BY 1""")
def html_links(spark, sf_dir):
    return pages.links(table(spark, sf_dir, "pages").select("page_id", "html")).groupBy("href").agg(F.count("*").alias("count"))


@query("html_file_items", """
SELECT page_id, item, split_part(item, ' ', 1) AS file FROM (SELECT page_id, trim(replace(regexp_replace(
  unnest(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1)), '<[^>]*>', '', 'g'), '&amp;', '&')) AS item FROM pages)
WHERE contains(item, 'th')""")
def html_file_items(spark, sf_dir):
    found = pages.file_items(table(spark, sf_dir, "pages").select("page_id", "html"), "th", css_class=None)
    return found.select("page_id", "item", "file")
