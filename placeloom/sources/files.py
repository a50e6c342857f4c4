"""CSV, JSON and Parquet tables, dump inventories and checksum manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from placeloom.sources import ranges

# Article record as one JSON array, by position.
ARTICLE_FIELDS = ["name", "coords", "templates", "text", "wikilinks", "ext_links", "text_length"]

ARTICLE_SCHEMA = (
    "name string, lat double, lon double, templates map<string,string>, text string, "
    "wikilinks array<string>, ext_links array<string>, text_length int"
)


NULL = "\\N"
COMPRESSED = r"\.(gz|bz2|zst|lz4|snappy|deflate)$"


def read_csv(spark: SparkSession, path: str, schema: StructType | str, own: bool = False, range_bytes: int = ranges.RANGE_BYTES) -> DataFrame:
    """CSV with a header; the schema is given, so no extra pass infers it. NaN is read as NULL.

    ``own`` files, written by ``write_csv``, hold no line breaks and are split like any text. A foreign file may hold some
    inside quotes; it is cut into byte ranges that many tasks read (``ranges.read_csv_records``). Compressed foreign files
    cannot be cut and are read by one task each.
    """
    if own:
        rows = spark.read.schema(schema).option("header", True).option("escape", '"').option("nullValue", NULL).csv(path)
    elif not ranges.files_in(spark, path).filter(F.col("path").rlike(COMPRESSED)).isEmpty():
        rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    else:
        shape = schema if isinstance(schema, str) else schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
        records = ranges.read_csv_records(spark, path, range_bytes=range_bytes).filter("first = 0")
        text = F.regexp_replace("value", r"\r?\n\z", "")
        parsed = F.from_csv(text, shape, {"escape": '"', "nullValue": "", "mode": "PERMISSIVE"})
        rows = records.filter(text != "").select(parsed.alias("r")).select("r.*")
    clean = {}
    for name, kind in rows.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("double", "float"):
            clean[name] = F.when(~F.isnan(column), column)
        elif kind == "string" and own:
            # \\ and \n in one pass: pieces between doubled backslashes hold only escaped line breaks
            pieces = F.split(column, r"\\\\")
            clean[name] = F.array_join(F.transform(pieces, lambda p: F.replace(
                F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))), "\\")
    return rows.withColumns(clean) if clean else rows


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header. Line breaks are written as \\n and \\r, a backslash as two, so that a record
    is a line; NULL is \\N, which no text can be, and so differs from an empty text."""
    def escaped(column: Column) -> Column:
        for plain, code in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
            column = F.replace(column, F.lit(plain), F.lit(code))
        return column

    texts = {name: escaped(F.col(f"`{name}`")) for name, kind in df.dtypes if kind == "string"}
    # no escape character of its own: quotes are doubled, backslashes are ours
    (df.withColumns(texts) if texts else df).write.mode(mode).option("header", True).option("escape", '"').option("nullValue", NULL).csv(path)


def write_variant(df: DataFrame, path: str, mode: str = "append", **settings) -> None:
    """Store a result under its settings: each becomes a partition column, so one variant reads alone."""
    tagged = df.withColumns({name: F.lit(value) for name, value in settings.items()})
    tagged.write.mode(mode).partitionBy(*settings).parquet(path)


def write_if_absent(df: DataFrame, path: str) -> None:
    """Do nothing when the path already holds a table."""
    df.write.mode("ignore").parquet(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str = ARTICLE_SCHEMA) -> DataFrame:
    """All parts of a JSON-lines folder as one table."""
    return spark.read.schema(schema).json(path)


# One positional record, each element kept as raw JSON text.
def article_from_array(lines: DataFrame, column: str = "value") -> DataFrame:
    """Articles from JSON arrays ``[name, [lat, lon], {..}, text, [..], [..], length]``, one per row."""
    raw = F.from_json(column, "array<string>")
    kept = lines.select(raw.alias("r")).filter(F.col("r").isNotNull())
    coords = F.from_json(F.col("r")[1], "array<double>")
    return kept.select(
        F.col("r")[0].alias("name"), coords[0].alias("lat"), coords[1].alias("lon"),
        F.from_json(F.col("r")[2], "map<string,string>").alias("templates"), F.col("r")[3].alias("text"),
        F.from_json(F.col("r")[4], "array<string>").alias("wikilinks"),
        F.from_json(F.col("r")[5], "array<string>").alias("ext_links"),
        F.col("r")[6].cast("int").alias("text_length"))


def article_to_array(articles: DataFrame) -> DataFrame:
    """``(value)``: one JSON array per article, the form :func:`article_from_array` reads."""
    parts = [
        F.to_json(F.array("name")), F.to_json(F.array("lat", "lon")),
        F.coalesce(F.to_json("templates"), F.lit("null")), F.to_json(F.array("text")), F.to_json("wikilinks"),
        F.to_json("ext_links"), F.col("text_length").cast("string"),
    ]
    bare = [F.substring(p, F.lit(2), F.length(p) - 2) if i in (0, 3) else p for i, p in enumerate(parts)]
    return articles.select(F.concat(F.lit("["), F.concat_ws(", ", *bare), F.lit("]")).alias("value"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``(only_left, only_right)``: rows of one table that the other lacks, counted with repeats."""
    left = a.exceptAll(b).agg(F.count("*").alias("only_left"))
    right = b.exceptAll(a).agg(F.count("*").alias("only_right"))
    return left.join(F.broadcast(right))


# ---- dump folders -----------------------------------------------------------------------------------

PART_GLOB = "*.xml-p*"
# Fixed value: copies of the dump parts in another container, which are left out.
OTHER_CONTAINER = "multistream"


def list_parts(spark: SparkSession, folder: str | list[str], pattern: str = PART_GLOB) -> DataFrame:
    """``(file, bytes)`` of the dump parts in a folder, or in several folders that tasks list. Only metadata is read: the
    content column is pruned."""
    name = F.element_at(F.split("path", "/"), -1)
    return _parts(spark, folder, pattern).select(name.alias("file"), "bytes").filter(
        ~F.contains("file", F.lit(OTHER_CONTAINER)))


def _parts(spark: SparkSession, folder: str | list[str], pattern: str) -> DataFrame:
    return ranges.files_in(spark, folder, pattern) if isinstance(folder, str) else ranges.files_of_folders(spark, folder, pattern)


def with_page_counts(parts: DataFrame) -> DataFrame:
    """Add ``mb`` and ``pages``: the last minus the first page number in a name like ``..p10p25.bz2``."""
    ends = [F.regexp_extract("file", r"p(\d+)p(\d+)\.[^.]*$", i).try_cast("long") for i in (1, 2)]
    return parts.select("file", (F.col("bytes") / 1e6).alias("mb"), (ends[1] - ends[0]).alias("pages"))


def folder_totals(parts: DataFrame) -> DataFrame:
    return with_page_counts(parts).agg(
        F.count("*").alias("files"), F.sum("mb").alias("mb"), F.sum("pages").alias("pages"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(file, md5)`` from lines of a digest, two blanks and a file name."""
    parts = F.split("value", "  ", 2)
    lines = spark.read.text(path).filter(F.size(parts) == 2)
    return lines.select(parts[1].alias("file"), parts[0].alias("md5"))


def verify(spark: SparkSession, folder: str | list[str], manifest: DataFrame, pattern: str = PART_GLOB) -> DataFrame:
    """``(file, status)`` per file of either side: ``ok``, ``differs``, ``missing`` or ``unlisted``. Files of any size are
    streamed through the digest."""
    found = ranges.file_digests(_parts(spark, folder, pattern)).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("digest").alias("actual"))
    return compare_digests(found, manifest)


def compare_digests(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Match ``(file, actual)`` with ``(file, md5)``; only true mismatches are ``differs``."""
    status = (
        F.when(F.col("actual").isNull(), "missing").when(F.col("md5").isNull(), "unlisted")
        .when(F.col("actual") == F.col("md5"), "ok").otherwise("differs"))
    return found.join(manifest, "file", "full_outer").select("file", status.alias("status"))
