"""WARC records of web pages, and a Merkle audit of replicas.

``archive`` packs pages into WARC records with a file and an offset each (equal pages are stored once; the file follows
from a digest of the page, so files have about ``PER_FILE`` records whatever ids or hosts repeat). ``write_files`` and
``read_files`` store them as real WARC files.

``audit`` compares two replicas. Leaves are digests of records; a node is the digest of the ordered digests of an offset
range, then of ``FAN`` nodes each up to the file, then of ``FAN`` files each up to one root. Only if the roots differ are
the nodes below compared, level by level and only under nodes that differ, down to the records. Every node is built
by a grouped job over at most ``FAN`` children or the records of one offset range, so no file is held by one task.

Rows: null url or html count as empty, null ids are kept; repeated rows are one record with ``copies``. Pages of any
length are one record. An empty archive has no nodes: two empty replicas agree, and against an empty one every record
is missing. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeloom.session import write_once

PER_FILE = 500
RANGE = 1 << 16  # bytes of a lowest offset range
FAN = 16
START = "WARC/1.0\r\n"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The text of a WARC resource record, with its closing blank lines."""
    return F.concat(
        F.lit(START + "WARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(F.coalesce(html, F.lit(""))).cast("string"),
        F.lit("\r\n\r\n"), F.coalesce(html, F.lit("")), F.lit("\r\n\r\n"))


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``file_no``, ``offset``, ``n_bytes``, ``copies``, ``record``; order within a file is by digest."""
    text = record(F.col(id_col), F.col(url_col), F.col(html_col))
    rows = pages.select(F.col(id_col).alias("page_id"), text.alias("record")).withColumn("_key", F.md5("record"))
    distinct = rows.select("page_id", F.sha2("record", 256)).distinct().count()  # moves digests only
    files = max(1, -(-distinct // PER_FILE))
    number = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") % files
    # texts are moved once, to their file: both the grouping of equal records and the offsets follow from it
    dealt = rows.withColumn("file_no", number).repartition("file_no")
    once = dealt.groupBy("file_no", "_key", "page_id", "record").agg(F.count("*").alias("copies"))
    size = F.octet_length("record").cast("long")
    before = Window.partitionBy("file_no").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = once.withColumn("n_bytes", size)
    return placed.withColumn("offset", F.coalesce(F.sum("n_bytes").over(before), F.lit(0)).cast("long")).select(
        "page_id", "file_no", "offset", "n_bytes", "copies", "record")


def write_files(records: DataFrame, path: str) -> None:
    """One folder ``file_no=...`` of WARC text per archive file."""
    (records.repartition("file_no").sortWithinPartitions("file_no", "offset").select(
        "file_no", F.regexp_replace("record", "\r\n\r\n$", "").alias("value"))
        .write.partitionBy("file_no").option("lineSep", "\r\n\r\n").text(path))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``page_id``, ``url``, ``html`` and ``whole`` (the length given in the header fits) of files by ``write_files``.

    Files are split at record starts, so a file of any size is read by many tasks. A page that holds a record
    start itself is cut there and shows ``whole`` false.
    """
    parts = spark.read.option("lineSep", START).text(path).filter("value <> ''").select("value")
    head, body = F.substring_index("value", "\r\n\r\n", 1), F.expr("substring(value, instr(value, '\r\n\r\n') + 4)")
    field = lambda name: F.regexp_extract(head, rf"(?m)^{name}: ([^\r\n]*)", 1)
    html = F.regexp_replace(body, "\r\n\r\n$", "")
    return parts.select(
        F.regexp_extract(head, r"<urn:page:(-?\d*)>", 1).try_cast("long").alias("page_id"), field("WARC-Target-URI").alias("url"),
        html.alias("html"), (F.octet_length(html) == field("Content-Length").cast("int")).alias("whole"))


def _parent(children: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Digest of the children's digests in order, per key."""
    listed = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("_digest").alias("d"))))
    text = F.array_join(F.transform(listed, lambda x: F.concat(x["o"].cast("string"), F.lit(":"), x["d"])), ",")
    return children.groupBy(*keys).agg(F.sha2(text, 256).alias("_digest"))


def tree(records: DataFrame) -> list[tuple[DataFrame, str, int]]:
    """Levels from records up to the root: the table, the column by which it was grouped and the number of its values
    in one node of this level. Each has ``_side``, ``_file``, ``_node``, ``_digest``, from rows of both
    replicas (``_side`` 0 and 1, ``_file``, ``offset``, ``_digest``)."""
    leaves = write_once(records.select("_side", "_file", F.col("offset").alias("_node"), "_digest"), "leaves")
    most = leaves.agg(F.max("_node").alias("n"), F.max("_file").alias("f")).first()
    levels: list[tuple[DataFrame, str, int]] = [(leaves, "", 1)]
    if most.n is None:
        return levels
    width, step = most.n, RANGE
    while True:  # ranges of a file; as many levels as the largest offset needs
        below = levels[-1][0].withColumn("_at", F.col("_node")).withColumn("_node", F.floor(F.col("_node") / step).cast("long"))
        levels.append((write_once(_parent(below, ["_side", "_file", "_node"], F.col("_at")), "nodes"), "_node", step))
        width, step = width // step, FAN
        if width == 0:
            break
    width = most.f
    while True:  # files
        below = levels[-1][0].withColumn("_at", F.col("_file")).withColumn("_file", F.floor(F.col("_file") / FAN).cast("long"))
        levels.append((write_once(_parent(below, ["_side", "_file", "_node"], F.col("_at")), "nodes"), "_file", FAN))
        if width < FAN:
            break
        width //= FAN
    return levels


def audit(one: DataFrame, other: DataFrame) -> DataFrame:
    """Records in which two replicas differ: ``file_no``, ``offset``, ``status`` (corrupt, missing, extra) and both digests.

    Each replica has ``file_no``, ``offset`` and ``record`` (text or binary)."""
    digest = lambda df, side: df.select(
        F.lit(side).alias("_side"), F.col("file_no").cast("long").alias("_file"), "offset", F.sha2(F.col("record").cast("binary"), 256).alias("_digest"))
    levels = tree(digest(one, 0).unionByName(digest(other, 1)))
    bad = None
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth][0]
        if bad is not None:  # the children of nodes that differ
            _, column, step = levels[depth + 1]
            above = {c: F.floor(F.col(c) / step).cast("long") if c == column else F.col(c) for c in ("_file", "_node")}
            level = level.withColumns({f"_up{c}": above[c] for c in above}).join(
                bad.select(*(F.col(c).alias(f"_up{c}") for c in above)), ["_up_file", "_up_node"], "left_semi")
        side = lambda n: F.max(F.when(F.col("_side") == n, F.col("_digest")))
        sides = level.groupBy("_file", "_node").agg(side(0).alias("_one"), side(1).alias("_two"))
        bad = write_once(sides.filter(~F.col("_one").eqNullSafe(F.col("_two"))), "differ")
        if bad.isEmpty():  # equal roots
            break
    status = F.when(F.col("_two").isNull(), "missing").when(F.col("_one").isNull(), "extra").otherwise("corrupt")
    return bad.select(
        F.col("_file").alias("file_no"), F.col("_node").alias("offset"), status.alias("status"), F.col("_one").alias("sha256_one"), F.col("_two").alias("sha256_two"))
