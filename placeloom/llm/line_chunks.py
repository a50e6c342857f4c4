"""Removal of repeated multi-line passages.

``without_repeated_passages`` removes every passage of two or more lines that stands earlier (smaller document id, then
place), wherever it begins: each two adjacent lines are hashed together, and both lines go if these two stand anywhere
before. A longer passage is covered by its pairs. The first place of a line never goes, so each line stays somewhere.

``without_repeats`` works on content-defined line chunks: a rolling hash over the hashes of two lines ends a chunk of two
or more lines behind a line where it says so. It moves less, but leaves what spans no whole chunk.

In both, what has an equal hash is compared byte by byte; of equal ones the first stays.

Rows: a null text stays null and an empty one empty; neither has chunks. Line breaks are ``\\n`` and belong to
the line before them. A document whose lines are all removed keeps an empty text. Rows that repeat an id and a
text are one document here (its own first copy stays, in each row). Null ids sort behind all others. Other
columns, whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom.llm import bitmaps, workers
from placeloom.llm.registry import numbered
from placeloom.session import write_once

ONE_IN = 2  # a boundary behind one in so many lines
LEAST_LINES = 2
# A chunk ends at the latest after so many lines, so that it is a bounded piece of a long document.
MOST_LINES = 64
ODD = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def cut(text: str, one_in: int = ONE_IN) -> list[tuple[int, int, int]]:
    """Chunks of a text in order: (start, end, number of lines), in characters; together they are the text."""
    out, start, end, count, before, number = [], 0, 0, 0, 0, 0
    whole = text.count("\n") + (not text.endswith("\n"))
    for line in text.split("\n"):
        here = xxhash.xxh3_64_intdigest(line)
        rolled = (before * ODD ^ here) * ODD & MASK  # of this line and the one before it
        before = here
        end, count = end + len(line) + 1, count + 1
        number += 1
        # No chunk has one line, unless the text has: such chunks are never compared.
        if ((rolled >> 33) % one_in == 0 or count >= MOST_LINES) and count >= LEAST_LINES and number + 1 != whole:
            out.append((start, min(end, len(text)), count))
            start, count = end, 0
    if start < len(text):
        out.append((start, len(text), count))
    return out


def _chunk_rows(rows: DataFrame, one_in: int, with_text: bool) -> DataFrame:
    """``_doc``, ``_th``, ``_at`` and two hashes of each chunk of two or more lines, or the hashes and its text."""
    doc = rows.schema["_doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in workers.sliced(batches):
            texts, of, at, one, two, chunks = batch.column(2), [], [], [], [], []
            for row in range(batch.num_rows):
                text = texts[row].as_py() or ""
                for place, (start, end, count) in enumerate(cut(text, one_in)):
                    if count >= LEAST_LINES:
                        chunk = text[start:end].removesuffix("\n")
                        both = xxhash.xxh3_128_intdigest(chunk)
                        of.append(row)
                        at.append(place)
                        one.append((both >> 64) - (1 << 63))
                        two.append((both & MASK) - (1 << 63))
                        if with_text:
                            chunks.append(chunk)
            hashes = [pa.array(one, pa.int64()), pa.array(two, pa.int64())]
            if with_text:
                yield pa.RecordBatch.from_arrays([*hashes, pa.array(chunks, pa.string())], names=["_one", "_two", "_chunk"])
            else:
                place = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(place), batch.column(1).take(place), pa.array(at, pa.int32()), *hashes],
                    names=["_doc", "_th", "_at", "_one", "_two"])

    if with_text:
        return rows.mapInArrow(run, "_one long, _two long, _chunk string")
    schema = T.StructType([doc, *T._parse_datatype_string("_th long, _at int, _one long, _two long").fields])
    return rows.mapInArrow(run, schema)


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = ONE_IN) -> DataFrame:
    """``_doc``, ``_th`` (hash of the text) and ``_at``: the chunks to remove."""
    rows = docs.select(F.col(id_col).alias("_doc"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"))
    places = write_once(_chunk_rows(rows, one_in, False), "chunks")
    order = F.struct(F.col("_doc").isNull().alias("n"), F.col("_doc").alias("d"), F.col("_at").alias("a"), F.col("_th").alias("t"))
    firsts = places.groupBy("_one", "_two").agg(F.min(order).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    # Byte comparison: a pair of hashes that stands for different texts removes nothing.
    alike = (
        _chunk_rows(rows, one_in, True).groupBy("_one", "_two", "_chunk").agg(F.count("*").alias("_n"))
        .groupBy("_one", "_two").agg(F.count("*").alias("_kinds"), F.sum("_n").alias("_n"))
        .filter("_kinds = 1 and _n > 1").select("_one", "_two"))
    firsts = write_once(firsts.join(alike, ["_one", "_two"]).drop("_n"), "firsts")
    return places.join(firsts, ["_one", "_two"]).filter(~order.eqNullSafe(F.col("_first"))).select("_doc", "_th", "_at")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = ONE_IN) -> DataFrame:
    """``docs`` with the repeated chunks cut out of the text, and ``lines_removed`` (long)."""
    docs, (id_col, text_col), old = numbered(docs.drop("lines_removed"), id_col, text_col)
    gone = repeated_chunks(docs, id_col, text_col, one_in).groupBy("_doc", "_th").agg(F.collect_set("_at").alias("_gone"))
    keyed = docs.withColumn("_own", F.xxhash64(text_col))
    on = [keyed[id_col].eqNullSafe(gone["_doc"]), F.col("_own") == F.col("_th")]
    rows = keyed.join(gone, on, "left").select(*docs.columns, "_gone")
    names = docs.columns
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in workers.sliced(batches):
            texts, lists = batch.column(place).to_pylist(), batch.column(batch.num_columns - 1)
            counts = np.zeros(batch.num_rows, np.int64)
            for row in range(batch.num_rows):
                places = lists[row].as_py()
                if places:
                    places, text = set(places), texts[row]
                    chunks = list(enumerate(cut(text, one_in)))
                    texts[row] = "".join(text[a:b] for i, (a, b, _) in chunks if i not in places)
                    counts[row] = sum(n for i, (_, _, n) in chunks if i in places)
            columns = [*batch.columns[:-1], pa.array(counts)]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lines_removed"])

    out = rows.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lines_removed", T.LongType())]))
    return out.toDF(*old, "lines_removed")


def lines_of(text: str) -> list[str]:
    """Lines without their breaks; a break at the end starts no line."""
    lines = text.split("\n")
    return lines if lines[-1] else lines[:-1]


def _pair_rows(rows: DataFrame, bits=None) -> DataFrame:
    """``_doc``, ``_th``, ``_at`` and two hashes of each two adjacent lines; with ``bits``, the hashes and the lines of those
    that may be in this bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            texts, counts, raw, pairs = batch.column(2), [], [], []
            for row in range(batch.num_rows):
                lines = lines_of(texts[row].as_py() or "")
                both = [f"{a}\n{b}" for a, b in zip(lines, lines[1:])]
                counts.append(len(both))
                raw.extend(map(digest, both))
                if bits is not None:
                    pairs.extend(both)
            hashes = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
            if bits is not None:
                keep = np.flatnonzero(bitmaps.maybe(bits.value, hashes[:, 0]))
                one, two = hashes[keep, 0], hashes[keep, 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one), pa.array(two), pa.array([pairs[i] for i in keep], pa.string())], names=["_one", "_two", "_pair"])
            else:
                counts = np.array(counts, np.int64)
                of = pa.array(np.repeat(np.arange(batch.num_rows), counts))
                at = np.arange(len(raw)) - np.repeat(np.cumsum(counts) - counts, counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(of), batch.column(1).take(of), pa.array(at.astype(np.int32)),
                     pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy())], names=["_doc", "_th", "_at", "_one", "_two"])

    if bits is not None:
        return rows.mapInArrow(run, "_one long, _two long, _pair string")
    return rows.mapInArrow(run, T.StructType([rows.schema["_doc"], *T._parse_datatype_string("_th long, _at int, _one long, _two long").fields]))


def repeated_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_doc``, ``_th`` and ``_at``: the first lines of adjacent two that stand earlier."""
    rows = docs.select(F.col(id_col).alias("_doc"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"))
    places = write_once(_pair_rows(rows), "pairs")
    order = F.struct(F.col("_doc").isNull().alias("n"), F.col("_doc").alias("d"), F.col("_at").alias("a"), F.col("_th").alias("t"))
    twice = write_once(places.groupBy("_one", "_two").agg(F.min(order).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "twice")
    bits = docs.sparkSession.sparkContext.broadcast(bitmaps.of(twice, "_one"))
    # Byte comparison: hashes that stand for different lines are told apart by the lines themselves.
    unlike = (
        _pair_rows(rows, bits).groupBy("_one", "_two").agg(F.min("_pair").alias("_a"), F.max("_pair").alias("_b"))
        .filter("_a <> _b").select("_one", "_two"))
    firsts = twice.join(unlike, ["_one", "_two"], "left_anti")
    near = bitmaps.marked(places, F.col("_one"), twice, "_one").filter("_maybe").drop("_maybe")
    return near.join(firsts, ["_one", "_two"]).filter(~order.eqNullSafe(F.col("_first"))).select("_doc", "_th", "_at")


def without_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the passages of two or more lines that stand earlier, and ``lines_removed`` (long)."""
    docs, (id_col, text_col), old = numbered(docs.drop("lines_removed"), id_col, text_col)
    gone = repeated_pairs(docs, id_col, text_col).groupBy("_doc", "_th").agg(F.collect_set("_at").alias("_gone"))
    keyed = docs.withColumn("_own", F.xxhash64(text_col))
    on = [keyed[id_col].eqNullSafe(gone["_doc"]), F.col("_own") == F.col("_th")]
    rows = keyed.join(gone, on, "left").select(*docs.columns, "_gone")
    names = docs.columns
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(place).to_pylist(), batch.column(batch.num_columns - 1)
            counts = np.zeros(batch.num_rows, np.int64)
            for row in range(batch.num_rows):
                places = lists[row].as_py()
                if places:
                    out = {k for at in places for k in (at, at + 1)}
                    texts[row] = "".join(line for k, line in enumerate(_with_breaks(texts[row])) if k not in out)
                    counts[row] = len(out)
            columns = [*batch.columns[:-1], pa.array(counts)]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lines_removed"])

    out = rows.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lines_removed", T.LongType())]))
    return out.toDF(*old, "lines_removed")


def _with_breaks(text: str) -> list[str]:
    lines = text.split("\n")
    return [*(line + "\n" for line in lines[:-1]), lines[-1]]
