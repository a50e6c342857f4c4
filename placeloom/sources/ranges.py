"""Large single files read by many tasks: byte ranges whose start state is found by a prefix over the ranges before.

Whether a byte stands inside quotes depends on everything before it. Each range is therefore read once for every state it
may start in, which gives its end state (and change of depth); a prefix over these few numbers settles all start states,
and a second pass cuts the records. A record belongs to the range in which it begins; its rest is read from there on, so
a task holds one range and one record. Files are opened through Arrow's file systems (local or mounted folders, HDFS,
S3, GCS), in the tasks.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE_BYTES = 32 << 20


def open_file(path: str):
    """Random access to a file named by a path or URI."""
    if re.match(r"file:/", path):
        return fs.LocalFileSystem().open_input_file(re.sub("^file:/+", "/", unquote(path)))
    system, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inside)


def files_in(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``(path, bytes)`` of the files below ``path``; contents are not read. Spark lists no empty files."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", F.col("length").alias("bytes"))


def files_of_folders(spark: SparkSession, folders: list[str], pattern: str | None = None) -> DataFrame:
    """``files_in`` of many folders that hold no further folders: each is listed in a task, so neither the driver nor a task
    sees all files, and no file is a split of its own. Hidden and empty files are left out, as Spark does."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                local = re.sub("^file:/+", "/", folder)
                system, inside = fs.FileSystem.from_uri(local) if "://" in local else (fs.LocalFileSystem(), local)
                listed = [f for f in system.get_file_info(fs.FileSelector(inside, allow_not_found=True)) if f.is_file and f.size and f.base_name[0] not in "._"]
                for at in range(0, len(listed), 10_000):
                    part = listed[at:at + 10_000]
                    yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{f.base_name}" for f in part], "bytes": [f.size for f in part]})

    rows = spread(spark.createDataFrame([(f,) for f in folders], "folder string"), "folder", most=128).mapInArrow(run, "path string, bytes long")
    if not pattern:
        return rows
    return rows.filter(F.element_at(F.split("path", "/"), -1).rlike(_as_regex(pattern)))


def _as_regex(pattern: str) -> str:
    """A file name pattern of ``*`` and ``?`` as a regular expression."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def _ranges(files: DataFrame, size: int) -> DataFrame:
    """``(path, bytes, start, end)``, dealt evenly over tasks."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(size).cast("long"))
    rows = files.filter("bytes > 0").select("path", "bytes", F.explode(starts).alias("start")).withColumn(
        "end", F.least(F.col("start") + size, F.col("bytes")))
    return spread(rows, "path", "start")


def spread(rows: DataFrame, *by: str, most: int = 10_000) -> DataFrame:
    """A task for each row, up to ``most`` tasks: small rows that stand for much work."""
    return rows.repartition(max(1, min(rows.count(), most)), *by)


def _each(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on each (path, bytes, start, end, ...) yields tuples."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held, size = [], 0
                for out in work(row):
                    held.append(out)
                    size += len(out.get("value") or "")
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_pylist(held, schema=shape)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=shape)

    shape = pa.schema([(name, {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[kind])
                       for name, kind in (part.split() for part in schema.split(", "))])
    return rows.mapInArrow(run, schema)


# ---- JSON arrays ------------------------------------------------------------------------------------


def _marks(data: bytes, inside: bool, escape: bool) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """For the bytes of a piece: which stand outside strings, and the nesting change at each; then the state behind it.

    ``inside``: the piece starts in a string; ``escape``: behind an odd run of backslashes.
    """
    raw = np.frombuffer(data, np.uint8)
    slash = raw == 92
    # length of the run of backslashes that ends at each byte
    at = np.arange(len(raw))
    last_other = np.maximum.accumulate(np.where(slash, -1, at))
    run = np.where(slash, at - last_other, 0)
    run = run + np.where(slash & (last_other < 0), int(escape), 0)
    odd_before = np.r_[escape, (run[:-1] % 2 == 1)] if len(raw) else np.zeros(0, bool)
    quote = (raw == 34) & ~odd_before
    closed = np.cumsum(quote) + int(inside)
    outside = (closed % 2 == 0) & ~quote
    depth = np.where(outside & ((raw == 91) | (raw == 123)), 1, 0) - np.where(outside & ((raw == 93) | (raw == 125)), 1, 0)
    return outside, depth, bool(closed[-1] % 2) if len(raw) else inside, bool(run[-1] % 2) if len(raw) and slash[-1] else False


def _array_summary(row: dict) -> Iterator[dict]:
    with open_file(row["path"]) as file:
        data = file.read_at(row["end"] - row["start"], row["start"])
    out = {"path": row["path"], "start": row["start"]}
    for escape in (0, 1):
        for inside in (0, 1):
            _, depth, ends_inside, ends_escape = _marks(data, bool(inside), bool(escape))
            out |= {f"i{escape}{inside}": int(ends_inside), f"e{escape}{inside}": int(ends_escape), f"d{escape}{inside}": int(depth.sum())}
    yield out


def _array_elements(row: dict) -> Iterator[dict]:
    inside, escape, level = bool(row["inside"]), bool(row["escape"]), row["depth"]
    with open_file(row["path"]) as file:
        at, end, open_from, parts = row["start"], row["end"], None, []
        while at < row["bytes"]:
            stop = end if at < end else min(at + (1 << 20), row["bytes"])
            data = file.read_at(stop - at, at)
            outside, depth, inside, escape = _marks(data, inside, escape)
            raw = np.frombuffer(data, np.uint8)
            after = level + np.cumsum(depth)
            # an element ends at a comma of the outer array or at its end, and begins behind a comma or its start
            ends = outside & (((raw == 44) & (after == 1)) | ((raw == 93) & (after == 0)))
            begins = outside & (((raw == 44) | ((raw == 91) & (depth == 1))) & (after == 1))
            begin = 0 if open_from is not None else None
            for i in np.flatnonzero(ends | begins):
                if begin is not None and ends[i]:
                    text = b"".join([*parts, data[begin:i]]).decode().strip()
                    parts, begin, open_from = [], None, None
                    if text:
                        yield {"value": text}
                if at >= end:
                    return
                if begins[i]:
                    begin, open_from = int(i) + 1, at + int(i) + 1
            if open_from is None:
                return
            parts.append(data[begin:])
            level, at = int(after[-1]) if len(after) else level, stop


def read_json_array(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(value)``: the JSON text of each element of the arrays in the files at ``path``, one array to a file."""
    ranges = _ranges(files_in(spark, path), range_bytes)
    states = ", ".join(f"{k}{e}{i} int" if k != "d" else f"d{e}{i} long" for e in (0, 1) for i in (0, 1) for k in "ied")
    found = _each(ranges, _array_summary, f"path string, start long, {states}").collect()  # a few numbers for each range
    starts, state = [], (0, 0, 0)
    for at, r in enumerate(sorted(found, key=lambda r: (r["path"], r["start"]))):
        inside, escape, depth = state if r["start"] else (0, 0, 0)
        starts.append((r["path"], r["start"], inside, escape, depth))
        state = (r[f"i{escape}{inside}"], r[f"e{escape}{inside}"], depth + r[f"d{escape}{inside}"])
    known = spark.createDataFrame(starts, "path string, start long, inside int, escape int, depth long")
    return _each(spread(ranges.join(known, ["path", "start"]), "path", "start"), _array_elements, "value string")


def write_json_array(lines: DataFrame, path: str, column: str = "value", single: bool = True) -> None:
    """One file with one array of the JSON texts in ``column``, written by one task, which streams the rows; not ``single``: a
    file with an array from each task, so that no task passes the whole table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if texts:
                yield pa.RecordBatch.from_pydict({"value": [("[" if first and not i else ",") + t for i, t in enumerate(texts)]})
                first = False
        yield pa.RecordBatch.from_pydict({"value": ["[]" if first else "]"]})

    texts = lines.select(column)
    (texts.coalesce(1) if single else texts).mapInArrow(run, "value string").write.text(path)


# ---- CSV with line breaks in quotes -----------------------------------------------------------------


class _Csv:
    """Record ends of CSV text as Python's csv module sees them: a quote opens only at the start of a field."""

    def __init__(self, delimiter: str):
        d = re.escape(delimiter.encode())
        rest = rb"[^" + d + rb"\r\n]*"
        self.inside = re.compile(rb'(?:[^"]|"")*+(?:"(?!")' + rest + rb")?", re.S)
        self.field = re.compile(rb'"(?:[^"]|"")*+(?:"(?!")' + rest + rb")?|" + rest, re.S)
        self.open = re.compile(rb'"(?:[^"]|"")*+\Z', re.S)
        self.delimiter = delimiter.encode()

    def ends(self, data: bytes, inside: bool) -> tuple[list[int], bool]:
        """Places behind the line breaks that end a record, and whether the data ends inside quotes.

        The data starts and ends behind a line break or at an end of the file.
        """
        at, found = 0, []
        if inside:
            at = self.inside.match(data).end()
            if at == len(data) and not self._closed(data, 0):
                return found, True
        while at < len(data):
            if data[at:at + 1] == self.delimiter:
                at += 1
            elif data[at] in b"\r\n":
                at += 2 if data[at:at + 2] == b"\r\n" else 1
                found.append(at)
            start = at
            at = self.field.match(data, at).end()
            if at == len(data) and data[start:start + 1] == b'"' and not self._closed(data, start + 1):
                return found, True
        return found, False

    def _closed(self, data: bytes, start: int) -> bool:
        """Whether the quotes that are open at ``start`` close before the end of the data."""
        plain = re.compile(rb'(?:[^"]|"")*+', re.S).match(data, start).end()
        return plain < len(data)


def _line_end(file, at: int, size: int) -> int:
    """The first place from ``at`` on that stands behind a line feed, or the end of the file."""
    if at == 0:
        return 0
    at -= 1
    while at < size:
        piece = file.read_at(min(1 << 16, size - at), at)
        place = piece.find(b"\n")
        if place >= 0:
            return at + place + 1
        at += len(piece)
    return size


def read_csv_records(spark: SparkSession, path: str, delimiter: str = ",", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(path, first, value)``: the text of each record, its quoted line breaks kept; ``first`` is 1 for a file's first record."""
    machine = _Csv(delimiter)

    def piece(row: dict) -> tuple[int, bytes]:
        with open_file(row["path"]) as file:
            start, end = (_line_end(file, row[c], row["bytes"]) for c in ("start", "end"))
            return start, file.read_at(end - start, start) if end > start else b""

    def summary(row: dict) -> Iterator[dict]:
        _, data = piece(row)
        yield {"path": row["path"], "start": row["start"], "s0": int(machine.ends(data, False)[1]), "s1": int(machine.ends(data, True)[1])}

    def records(row: dict) -> Iterator[dict]:
        start, data = piece(row)
        ends, inside = machine.ends(data, bool(row["inside"]))
        at = 0
        if row["inside"]:
            if not ends:
                return  # the record that began before goes on beyond this range
            at, ends = ends[0], ends[1:]
        for end in ends:
            yield {"path": row["path"], "first": int(start + at == 0), "value": data[at:end].decode()}
            at = end
        rest = data[at:]
        if not rest:
            return
        here = start + len(data)
        with open_file(row["path"]) as file:
            while inside and here < row["bytes"]:
                end = _line_end(file, min(here + (1 << 16), row["bytes"]), row["bytes"])
                more = file.read_at(end - here, here)
                ends, inside = machine.ends(more, True)
                if ends:
                    rest, inside = rest + more[:ends[0]], False
                else:
                    rest += more
                here = end
        yield {"path": row["path"], "first": int(start + at == 0), "value": rest.decode()}

    ranges = _ranges(files_in(spark, path), range_bytes)
    found = _each(ranges, summary, "path string, start long, s0 int, s1 int").collect()  # two numbers for each range
    starts, inside = [], 0
    for r in sorted(found, key=lambda r: (r["path"], r["start"])):
        inside = inside if r["start"] else 0
        starts.append((r["path"], r["start"], inside))
        inside = r[f"s{inside}"]
    known = spark.createDataFrame(starts, "path string, start long, inside int")
    return _each(spread(ranges.join(known, ["path", "start"]), "path", "start"), records, "path string, first int, value string")


# ---- whole files ------------------------------------------------------------------------------------


def file_digests(files: DataFrame, kind: str = "md5", chunk: int = 4 << 20) -> DataFrame:
    """``(path, digest)``: each file of ``files`` (``path, bytes``) is streamed through the digest, a chunk at a time."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                digest = hashlib.new(kind)
                with open_file(path) as file:
                    while data := file.read(chunk):
                        digest.update(data)
                yield pa.RecordBatch.from_pydict({"path": [path], "digest": [digest.hexdigest()]})

    size = files.agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).first()
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, (size["b"] or 0) // RANGE_BYTES)
    return files.select("path").repartition(max(1, min(size["n"], tasks)), "path").mapInArrow(run, "path string, digest string")


def write_files(rows: DataFrame, folder: str, name: str = "file", content: str = "content", under: str | None = None) -> None:
    """A file for each row, in ``folder`` or in its subfolder named by the column ``under``; written again under the same name
    when a task is retried."""
    target = re.sub("^file:/+", "/", folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inside = fs.FileSystem.from_uri(target) if "://" in target else (fs.LocalFileSystem(), target)
        system.create_dir(inside, recursive=True)
        made = set()
        for batch in batches:
            homes = batch.column(2).to_pylist() if under else [None] * batch.num_rows
            for file, data, home in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), homes, strict=True):
                if under and home not in made:
                    system.create_dir(f"{inside}/{home}", recursive=True)
                    made.add(home)
                with system.open_output_stream(f"{inside}/{home}/{file}" if under else f"{inside}/{file}") as out:
                    out.write(data.encode() if isinstance(data, str) else data)
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, pa.schema([("n", pa.int64())]))

    rows.select(name, content, *([under] if under else [])).mapInArrow(run, "n long").agg(F.sum("n")).collect()
