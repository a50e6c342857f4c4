"""Removal of repeated byte strings by two-stage suffix sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else in the table, the same text included.

Only strings that may repeat are sorted. In each string one place is its anchor: the first smallest hash of its
``GRAM``-byte pieces, a function of the string alone. Runs of strings with one anchor are one stretch of text; anchors
whose hash occurs once are done. The stretches of an anchor hash form a group, groups are dealt to tasks, and each
task builds one suffix array over many groups: suffixes smaller than their successors are sorted directly, all others
are induced from them by a scan over the buckets of first bytes, and the common prefixes of neighbours tell which
strings repeat. Equal stretches are sorted once. A group of more than ``BLOCK`` different stretches is dealt to blocks
and sorted by pairs of blocks, so no task holds a group of unbounded size.

Texts are UTF-8 bytes; matches never cross texts. Rows: null and empty texts, and those shorter than ``LENGTH``, lose
nothing; every copy of a repeated text goes, the first included; rows that repeat an id are judged like other
copies. An empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom.llm import bitmaps
from placeloom.llm.lm_bloom import mixed
from placeloom.session import write_once

LENGTH = 200
GRAM = 48
BLOCK = 8192
CHUNK_BYTES = 1 << 19  # bytes that one suffix array covers, unless one block pair needs more
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)
        return self.up[:n], self.down[:n]


def stretches(raw: bytes, powers: _Powers, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor: first start, last start, anchor hash, hash of the stretch."""
    n = len(raw)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    up, down = powers.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[np.frombuffer(raw, np.uint8)] * up[:n], out=sums[1:])
    grams = mixed((sums[gram:] - sums[:-gram]) * down[:n + 1 - gram])
    # leftmost smallest gram of each window, by doubling
    width, at, least = 1, np.arange(len(grams)), grams
    wanted = length - gram + 1
    while width < wanted:
        step = min(width, wanted - width)
        right = least[step:] < least[:-step]
        at = np.where(right, at[step:], at[:-step])
        least = np.where(right, least[step:], least[:-step])
        width += step
    edge = np.flatnonzero(at[1:] != at[:-1]) + 1
    first, last = np.concatenate(([0], edge)), np.concatenate((edge, [len(at)])) - 1
    anchor = grams[at[first]]
    whole = mixed((sums[last + length] - sums[first]) * down[first] + (at[first] - first).astype(np.uint64) * _BASE)
    whole = mixed(whole + (last - first).astype(np.uint64))
    return first, last, anchor.view(np.int64), whole.view(np.int64)


def two_stage(data: np.ndarray, length: int) -> np.ndarray:
    """Suffixes of ``data`` in the order of (at least) their first ``length`` bytes; the last byte is 0."""
    n = len(data)
    # a suffix is smaller than its successor if the next different byte is greater; the end counts as greater
    turn = np.concatenate((np.flatnonzero(data[1:] != data[:-1]), [n - 1]))
    rises = np.concatenate((data[turn[:-1] + 1] > data[turn[:-1]], [True]))
    smaller = np.repeat(rises, np.diff(np.concatenate(([-1], turn))))
    direct = np.flatnonzero(smaller)
    padded = np.concatenate((data, np.zeros(length, np.uint8)))
    view = np.lib.stride_tricks.sliding_window_view(padded, length)[direct]
    direct = direct[np.argsort(np.ascontiguousarray(view).view(f"S{length}").reshape(-1), kind="stable")]
    first = data[direct]
    starts = np.searchsorted(first, np.arange(257))
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~smaller[before]]
        letters = data[before]
        order = np.argsort(letters, kind="stable")
        before, letters = before[order], letters[order]
        cuts = np.flatnonzero(letters[1:] != letters[:-1]) + 1
        for part in np.split(before, cuts) if len(before) else ():
            queues[data[part[0]]].append(part)

    out = []
    for letter in range(256):
        queue, done = queues[letter], 0
        while done < len(queue):  # induced ones come before the sorted ones of a bucket, and may add to it
            part = np.concatenate(queue[done:])
            done = len(queue)
            out.append(part)
            induce(part)
        part = direct[starts[letter]:starts[letter + 1]]
        out.append(part)
        induce(part)
    return np.concatenate(out)


def repeated_starts(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int] | None]:
    """For each stretch: first and last start (relative) of a string that starts in another place too."""
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    sizes = np.array([len(t) for t in texts])
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    inside = np.arange(len(data)) - begin[owner]
    whole = inside + length <= sizes[owner]
    order = two_stage(data, length)
    order = order[whole[order]]
    # common prefixes of neighbours, up to ``length``, eight bytes at a time
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    eight = sum(padded[i:i + len(data)] << np.uint64(8 * i) for i in range(8))
    same = np.arange(len(order) - 1) if len(order) else np.zeros(0, np.int64)
    for lane in [*range(0, length - 7, 8), length - 8]:
        a, b = order[same] + lane, order[same + 1] + lane
        same = same[eight[a] == eight[b]]
    repeats = np.zeros(len(data), bool)
    repeats[order[same]] = repeats[order[same + 1]] = True
    found = np.flatnonzero(repeats)
    out: list[tuple[int, int] | None] = [None] * len(texts)
    if len(found):
        of = owner[found]
        edge = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        ends = np.concatenate((edge[1:], [len(of)])) - 1
        for k, a, b in zip(of[edge], found[edge], found[ends]):
            out[k] = (int(a - begin[k]), int(b - begin[k]))
    return out


def _raw(value) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


_PLACES = "_th long, _first int, _last int, _anchor long, _whole long"


def _places(rows: DataFrame, length: int, bits=None) -> DataFrame:
    """Stretches of each text; with ``bits`` only those whose anchor may be in that bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            size = 0
            for row, value in enumerate(batch.column(1)):
                raw = _raw(value)
                first, last, anchor, whole = stretches(raw, powers, length)
                if bits is not None:
                    keep = bitmaps.maybe(bits.value, anchor)
                    first, last, anchor, whole = first[keep], last[keep], anchor[keep], whole[keep]
                text = np.full(len(first), xxhash.xxh3_64_intdigest(raw) - (1 << 63), np.int64)
                for col, part in zip(cols, (text, first, last, anchor, whole)):
                    col.append(part)
                size += len(first)
                if size > 100_000 or row == batch.num_rows - 1:
                    text, first, last, anchor, whole = map(np.concatenate, cols)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(text), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(anchor), pa.array(whole)],
                        names=["_th", "_first", "_last", "_anchor", "_whole"])
                    cols, size = [[], [], [], [], []], 0

    return rows.mapInArrow(run, _PLACES)


def _split(rows: DataFrame, bits, schema: T.StructType) -> DataFrame:
    """``rows`` with ``_th`` and whether that hash may be in the bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.array([xxhash.xxh3_64_intdigest(_raw(v)) - (1 << 63) for v in batch.column(1)], np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(hashes), pa.array(bitmaps.maybe(bits.value, hashes))], names=[*batch.schema.names, "_th", "_maybe"])

    return rows.mapInArrow(run, T.StructType([*schema.fields, T.StructField("_th", T.LongType()), T.StructField("_maybe", T.BooleanType())]))


def _fetched(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Bytes of the wanted stretches (``_th``, ``_list`` of place and key), cut where the texts lie."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            anchor, whole, part = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(anchor, pa.int64()), pa.array(whole, pa.int64()), pa.array(part, pa.binary())], names=["_anchor", "_whole", "_bytes"])

        for batch in batches:
            rows: list[tuple] = []
            for th, raw, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if th != before:  # copies of a text lie together
                    raw = _raw(raw)
                    rows += [(p["_anchor"], p["_whole"], raw[p["_first"]:p["_last"] + length]) for p in places.as_py()]
                before = th
                if len(rows) > 20_000:
                    yield out(rows)
                    rows = []
            yield out(rows)

    joined = texts.join(wanted, "_th").select("_th", "_text", "_list")
    return joined.mapInArrow(run, "_anchor long, _whole long, _bytes binary")


def _sorted_groups(parts: DataFrame, length: int) -> DataFrame:
    """Repeated strings per stretch, from rows that lie together and in order by ``_anchor``, ``_i``, ``_j``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict[int, bytes]] = {}
        size = 0

        def done(groups: dict[tuple, dict[int, bytes]]) -> pa.RecordBatch:
            # a stretch that belongs to several block pairs stands in the array once
            flat = {(key[0], whole): text for key, own in groups.items() if len(own) > 1 for whole, text in own.items()}
            spans = repeated_starts(list(flat.values()), length) if flat else []
            rows = [(*key, *s) for key, s in zip(flat, spans) if s]
            columns = list(zip(*rows)) if rows else [(), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["_anchor", "_whole", "_from", "_to"])

        for batch in batches:
            for key, whole, text in zip(
                    zip(*(batch.column(c).to_pylist() for c in ("_anchor", "_i", "_j"))), batch.column("_whole").to_pylist(), batch.column("_bytes")):
                if key not in held and size > CHUNK_BYTES:
                    yield done(held)
                    held, size = {}, 0
                own = held.setdefault(key, {})
                if whole not in own:
                    own[whole] = _raw(text)
                    size += len(own[whole])
        yield done(held)

    return parts.mapInArrow(run, "_anchor long, _whole long, _from int, _to int")


def removed_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``_th`` (hash of a text) and ``_spans`` (array of start, end in bytes; may touch or overlap)."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.lit(0).alias("_doc"), F.col(text_col).cast("binary").alias("_text"))
    twice = write_once(
        _places(rows, length).groupBy("_anchor").agg(F.count("*").alias("_n")).filter("_n > 1").select("_anchor"), "anchors")
    bits = context.broadcast(bitmaps.of(twice, "_anchor"))
    places = write_once(
        _places(rows, length, bits).join(twice, "_anchor").groupBy("_th", "_first", "_last", "_anchor", "_whole")
        .agg(F.count("*").alias("_n")), "places")  # of a text and its copies
    kinds = places.groupBy("_anchor", "_whole").agg(
        F.sum("_n").alias("_n"), F.min(F.struct("_th", "_first", "_last")).alias("_at"))
    kinds = write_once(kinds, "stretches")
    # Stretches that occur twice repeat as a whole; those with company under their anchor are sorted.
    company = kinds.groupBy("_anchor").agg(F.count("*").alias("_kinds")).filter("_kinds > 1").select(
        "_anchor", F.ceil(F.col("_kinds") / BLOCK).cast("int").alias("_blocks"))
    company = write_once(company, "groups")
    wanted = kinds.join(company, "_anchor").select("_at.*", "_anchor", "_whole").groupBy("_th").agg(
        F.collect_list(F.struct("_first", "_last", "_anchor", "_whole")).alias("_list"))
    wanted = write_once(wanted, "wanted")
    some = context.broadcast(bitmaps.of(wanted, "_th"))
    texts = _split(rows, some, rows.schema).filter("_maybe").select("_th", "_text")
    parts = _fetched(texts, wanted, length).join(company, "_anchor")
    mine = F.pmod(F.col("_whole"), F.col("_blocks")).cast("int")
    dealt = parts.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        "_anchor", "_whole", "_bytes", F.least(mine, "_with").alias("_i"), F.greatest(mine, "_with").alias("_j"))
    together = dealt.repartition("_anchor", "_i", "_j").sortWithinPartitions("_anchor", "_i", "_j")
    found = _sorted_groups(together, length).groupBy("_anchor", "_whole").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    own = kinds.select("_anchor", "_whole", (F.col("_n") > 1).alias("_all"))
    covers = write_once(own.join(found, ["_anchor", "_whole"], "left").filter("_all or _from is not null"), "covers")
    start = F.when(F.col("_all"), F.col("_first")).otherwise(F.col("_first") + F.col("_from"))
    end = F.when(F.col("_all"), F.col("_last")).otherwise(F.col("_first") + F.col("_to")) + length
    return places.join(covers, ["_anchor", "_whole"]).select("_th", F.struct(start.alias("a"), end.alias("b")).alias("_s")).groupBy("_th").agg(
        F.array_sort(F.collect_list("_s")).alias("_spans"))


def _merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for span in spans or ():
        if out and span["a"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], span["b"]))
        else:
            out.append((span["a"], span["b"]))
    return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per document: ``n_bytes``, ``kept`` (binary, what is left) and ``spans`` (maximal removed runs, in bytes)."""
    spans = write_once(removed_spans(docs, text_col, length), "spans")
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("binary").alias("_text"))
    some = docs.sparkSession.sparkContext.broadcast(bitmaps.of(spans, "_th"))
    marked = _split(rows, some, rows.schema)
    hit = marked.filter("_maybe").join(spans, "_th", "left").select("_doc", "_text", "_spans")
    clear = marked.filter("not _maybe").select("_doc", "_text", F.lit(None).cast(spans.schema["_spans"].dataType).alias("_spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, kept, runs = [], [], []
            for value, own in zip(batch.column(1), batch.column(2)):
                raw, gone = _raw(value), _merged(own.as_py())
                edges = [0, *(x for span in gone for x in span), len(raw)]
                sizes.append(len(raw))
                kept.append(b"".join(raw[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2)))
                runs.append([{"start": a, "end": b} for a, b in gone])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(runs, kind)],
                names=[id_col, "n_bytes", "kept", "spans"])

    out = T.StructType([
        T.StructField(id_col, rows.schema["_doc"].dataType),
        *T._parse_datatype_string("n_bytes long, kept binary, spans array<struct<start: long, end: long>>").fields])
    return hit.unionByName(clear).mapInArrow(run, out)
