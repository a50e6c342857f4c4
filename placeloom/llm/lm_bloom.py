"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are quantised on a log scale, and a count of level *q* is stored as *q* keys in a
Bloom filter (key with 1, key with 2, ...). A count is read back by probing level after level until a probe
misses. The filter is cut into blocks by key and has one byte per training token at every size, so its rate of false
hits does not change with the input (it never loses a count). No task and not the driver holds all of it: each block
is built and probed where its keys meet. Texts are stored in batches; the distinct keys of each batch go to their
blocks, and the levels found there come back to the batch.

Pair probabilities are mixed with word probabilities; the weight of a mix depends on how often the left word
was seen and is the share of training tokens whose pair occurs at least twice (leave-one-out), over all
training documents.

Exact word counts, for the base score, are summed by a shuffle. Words in at most ``FREQUENT`` table rows (bounded)
are looked up where the texts lie, all others by a join, so no table that grows is broadcast.

Rows: a null or empty text is one end token. Null ids train and are not held out. Repeated rows count, and
are returned, as often as they occur. With an empty table the result is empty. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom.llm.quality import remainder
from placeloom.session import write_once

FREQUENT = 200_000  # most rows of the broadcast table of frequent words
BASE = 1.5  # of the log scale of counts
PROBES = 4  # bits per key
LEVELS = 64
BLOCK_TOKENS = 1_000_000  # training tokens per filter block
BATCH_TOKENS = 300_000
END = 0x9D39247E33776D41
_LOW = np.uint64(0xFFFFFFFF)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def words(text: str | None) -> list[bytes]:
    """Words with ASCII letters in lower case; ASCII white space parts them."""
    return (text or "").encode().lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def level(count: np.ndarray) -> np.ndarray:
    """Level of a count: 1 + floor(log_BASE count)."""
    return 1 + np.floor(np.log(count) / math.log(BASE) + 1e-9).astype(np.int64)


def middle(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its whole numbers; 0 for level 0."""
    low, high = np.ceil(BASE ** (levels - 1.0) - 1e-9), np.ceil(BASE ** levels.astype(float) - 1e-9) - 1
    return np.where(levels > 0, (low + np.maximum(low, high)) / 2, 0.0)


def keys(batch: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens of some texts: word keys, pair keys, and where each text starts. The end is each text's last
    token and also stands before its first."""
    digest, flat, starts = xxhash.xxh3_64_intdigest, [END], []
    for text in batch:
        starts.append(len(flat) - 1)
        flat.extend(map(digest, text))
        flat.append(END)
    hashes = np.array(flat, np.uint64)
    return mixed(hashes[1:] + _M1), mixed(hashes[:-1] * _M1 + mixed(hashes[1:])), np.array(starts, np.int64)


class Filter:
    """The bits, and how a key's blocks and bits are found."""

    def __init__(self, bits: np.ndarray, blocks: int, block_bits: int):
        self.bits, self.blocks, self.block_bits = bits, blocks, block_bits

    @staticmethod
    def block_of(key: np.ndarray, blocks: int) -> np.ndarray:
        return ((key >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)

    @staticmethod
    def place(own: np.ndarray, probe: int, block_bits: int) -> np.ndarray:
        """Bit within the block that a key's hash at a level has for a probe."""
        step = (own >> np.uint64(32)) | np.uint64(1)
        return (own + np.uint64(probe) * step & np.uint64(0xFFFFFFFF)) * np.uint64(block_bits) >> np.uint64(32)

    @staticmethod
    def at_level(key: np.ndarray, level: int) -> np.ndarray:
        return mixed(key + np.uint64(level * int(_M1) & 0xFFFFFFFFFFFFFFFF))

    def repeated_levels(self, key: np.ndarray) -> np.ndarray:
        """As ``levels``, probing each key once however often it stands in the array."""
        once, place = np.unique(key, return_inverse=True)
        return self.levels(once)[place]

    def levels(self, key: np.ndarray) -> np.ndarray:
        """Level of each key, by probing until a miss."""
        out = np.zeros(len(key), np.int64)
        alive = np.arange(len(key))
        offset = self.block_of(key, self.blocks) * np.uint64(self.block_bits)
        key = key & _LOW
        for at_level in range(1, LEVELS):
            own = self.at_level(key, at_level)
            for probe in range(PROBES):
                place = self.place(own, probe, self.block_bits) + offset
                byte = self.bits[(place >> np.uint64(3)).astype(np.int64)]
                hit = np.flatnonzero(byte >> (place & np.uint64(7)).astype(np.uint8) & 1)
                alive, key, own, offset = alive[hit], key[hit], own[hit], offset[hit]
            if not len(alive):
                break
            out[alive] = at_level
        return out


def _grouped(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of the batches with about ``BATCH_TOKENS`` tokens at most, and their words."""
    for batch in batches:
        texts, start, tokens, size = batch.column(column), 0, [], 0
        for row in range(batch.num_rows):
            tokens.append(words(texts[row].as_py()))
            size += len(tokens[-1]) + 1
            if size >= BATCH_TOKENS or row == batch.num_rows - 1:
                yield batch.slice(start, row + 1 - start), tokens
                start, tokens, size = row + 1, [], 0


def word_counts(texts: DataFrame) -> DataFrame:
    """``_word`` (binary; empty for the end) and ``_c`` over all rows of ``_text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["_word", "_n"])
        for part, tokens in _grouped(batches, 0):
            for text in tokens:
                counts.update(text)
            counts[b""] += part.num_rows
            if len(counts) > 200_000:
                yield out()
                counts.clear()
        yield out()

    return texts.select("_text").mapInArrow(run, "_word binary, _n long").groupBy("_word").agg(F.sum("_n").alias("_c"))


def geometry(tokens: int) -> tuple[int, int]:
    """Number of blocks and bits per block of the filter over so many training tokens: one byte per token."""
    blocks = max(48, -(-tokens // BLOCK_TOKENS))
    return blocks, 8 * -(-max(tokens, 1024) // blocks)


def block_bitmap(key: np.ndarray, count: np.ndarray, block_bits: int) -> np.ndarray:
    """Bits of one block from the low halves of its keys, which may repeat, and their counts."""
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.array([], int)
    key, top = key[first], level(np.add.reduceat(count, first)) if len(key) else count
    marks = np.zeros(block_bits, bool)
    for at_level in range(1, int(top.max(initial=0)) + 1):
        key, top = key[top >= at_level], top[top >= at_level]
        own = Filter.at_level(key, at_level)
        for probe in range(PROBES):
            marks[Filter.place(own, probe, block_bits).astype(np.int64)] = True
    return np.packbits(marks, bitorder="little")


def packed(a: np.ndarray) -> bytes:
    """A uint32 array in few bytes: its length, then its byte planes compressed."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 4).T)
    return len(a).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    size = int.from_bytes(raw[:4], "little")
    planes = np.frombuffer(pa.decompress(raw[4:], 4 * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, size).T).view(np.uint32).ravel()


def batch_texts(part: pa.RecordBatch, row: int) -> list[list[bytes]]:
    """Words of each text of a stored batch."""
    sizes = part.column("_sizes")[row].values.to_numpy()
    ends = np.cumsum(sizes)
    raw = pa.decompress(part.column("_raw")[row].as_py(), int(ends[-1]), codec="zstd", asbytes=True) if ends[-1] else b""
    return [raw[b - n:b].lower().split() for n, b in zip(sizes.tolist(), ends.tolist())]


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` (``_doc``, ``_th``, ``_text``, ``_held``) in batches of bounded size, a row of arrays each, with ``_batch``."""
    names = ["_doc", "_th", "_held"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part, _ in _grouped(batches, 3):
            texts = [(t or "").encode() for t in part.column(3).to_pylist()]
            ends = pa.array([0, part.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.concat_arrays([x])) for x in [*part.columns[:3], pa.array(list(map(len, texts)), pa.int64())]]
            raw = pa.compress(b"".join(texts), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), *lists, pa.array([raw], pa.binary())], names=["_batch", *names, "_sizes", "_raw"])
            number += 1

    fields = [T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in names]
    more = T._parse_datatype_string("_sizes array<long>, _raw binary").fields
    schema = T.StructType([T.StructField("_batch", T.LongType()), *fields, *more])
    return write_once(rows.select(*names, "_text").mapInArrow(run, schema), "batches")


def batch_keys(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys of a batch, and the place among them of each token's word and of its pair."""
    word, pair, _ = keys(texts)
    key, place = np.unique(np.concatenate([word, pair]), return_inverse=True)
    return key, place[:len(word)], place[len(word):]


def block_parts(batches: DataFrame, blocks: int) -> DataFrame:
    """``_block``, ``_batch``, ``_keys`` (differences of the low halves, in order) and ``_counts`` in training texts, of each batch's keys."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in range(part.num_rows):
                texts = batch_texts(part, row)
                key, word, pair = batch_keys(texts)
                trains = np.repeat(~np.array(part.column("_held")[row].as_py(), bool), [len(t) + 1 for t in texts])
                n = np.bincount(np.concatenate([word[trains], pair[trains]]), minlength=len(key))
                edges = np.searchsorted(Filter.block_of(key, blocks), np.arange(blocks + 1))
                own = np.flatnonzero(edges[:-1] < edges[1:])
                # within a block 32 bits tell keys apart about as well as the filter does
                low = (key & _LOW).astype(np.uint32)
                cut = lambda a: pa.array([packed(a[edges[i]:edges[i + 1]]) for i in own], pa.binary())
                low[1:] -= low[:-1].copy()  # differences; they wrap where a block starts
                low[edges[own]] = (key[edges[own]] & _LOW).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.astype(np.int32)), pa.array([part.column("_batch")[row].as_py()] * len(own), pa.int64()),
                     cut(low), cut(n.astype(np.uint32))], names=["_block", "_batch", "_keys", "_counts"])

    return batches.select("_batch", "_held", "_sizes", "_raw").mapInArrow(run, "_block int, _batch long, _keys binary, _counts binary")


def block_keys(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a block's rows, and their training counts."""
    return (np.concatenate([np.cumsum(unpacked(k), dtype=np.uint32) for k in part["_keys"]]).astype(np.uint64),
            np.concatenate([unpacked(c) for c in part["_counts"]]).astype(np.int64))


def block_levels(parts: DataFrame, block_bits: int) -> DataFrame:
    """``_batch``, ``_block`` and ``_levels`` (a byte per key, in the order of ``_keys``)."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        key, n = block_keys(part)
        bits = block_bitmap(key[n > 0], n[n > 0], block_bits)
        found = Filter(bits, 1, block_bits).repeated_levels(key).astype(np.uint8)
        ends = np.cumsum([int.from_bytes(k[:4], "little") for k in part["_keys"]])
        return pd.DataFrame({
            "_batch": part["_batch"], "_block": part["_block"], "_levels": [x.tobytes() for x in np.split(found, ends[:-1])]})

    return parts.groupBy("_block").applyInPandas(run, "_batch long, _block int, _levels binary")


def build_filter(texts: DataFrame, tokens: int) -> Filter:
    """The filter over words and pairs of ``_text`` in one piece, for tables whose filter fits in one place; ``tokens`` is
    their number. ``scores`` does not gather it."""
    blocks, block_bits = geometry(tokens)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        packed = block_bitmap(*block_keys(part), block_bits).tobytes()
        return pd.DataFrame({"_block": [int(part["_block"].iloc[0])], "_bits": [packed]})

    rows = texts.select(F.lit(0).alias("_doc"), F.lit(0).alias("_th"), "_text", F.lit(False).alias("_held"))
    built = block_parts(stored(rows), blocks).groupBy("_block").applyInPandas(build, "_block int, _bits binary")
    bits = np.zeros(blocks * block_bits // 8, np.uint8)
    for row in built.toLocalIterator():
        bits[row._block * block_bits // 8:(row._block + 1) * block_bits // 8] = np.frombuffer(row._bits, np.uint8)
    return Filter(bits, blocks, block_bits)


def token_levels(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Levels of each token's word, of its pair and of the token left of it, and where each text starts, from the bytes
    of ``_own`` and ``_pair``."""
    own, pair = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).astype(np.int64) for c in ("_own", "_pair"))
    ends = np.cumsum(batch.column("_tokens").to_numpy())
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    left = np.empty_like(own)
    left[1:] = own[:-1]
    left[starts] = own[ends - 1]  # the end stands before a text's first token
    return own, pair, left, starts


def mix_weights(levels: DataFrame) -> np.ndarray:
    """Weight of the pair estimate by level of the left word: the share of training tokens whose pair is not single."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, pair, left, _ = token_levels(batch)
                once = np.bincount(left[pair < 2], minlength=LEVELS)
                more = np.bincount(left[pair >= 2], minlength=LEVELS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(LEVELS)), pa.array(once), pa.array(more)], names=["_level", "_once", "_more"])

    out = np.full(LEVELS, 0.5)
    train = levels.filter("not _held").select("_tokens", "_own", "_pair")
    sums = train.mapInArrow(run, "_level long, _once long, _more long").groupBy("_level").agg(
        F.sum("_once").alias("once"), F.sum("_more").alias("more"))
    for row in sums.collect():  # LEVELS rows
        out[row._level] = (row.more + 1) / (row.more + row.once + 2)
    return out


def scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2,
    frequent: int = FREQUENT,
) -> DataFrame:
    """Per document: ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(
        F.col(id_col).alias("_doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_th"), F.col(text_col).alias("_text"),
        F.coalesce(remainder(F.col(id_col), folds) == held, F.lit(False)).alias("_held"))
    train = rows.filter("not _held")
    counts = write_once(word_counts(train), "words")
    octave = F.floor(F.log2("_c") * 8)
    total = counts.groupBy(octave.alias("o")).agg(F.count("*").alias("v"), F.sum("_c").alias("n")).orderBy(F.desc("o")).collect()
    n_all, v_all = sum(r.n for r in total), sum(r.v for r in total)
    room, least = frequent, None
    for row in total:  # at most some hundred steps of the log scale
        room -= row.v
        if room < 0:
            break
        least = row.o
    common = {}
    if least is not None:
        common = {bytes(r._word): math.log10(r._c + 1) for r in counts.filter(octave >= least).toLocalIterator()}
    table = context.broadcast(common)
    floor = math.log10(n_all + v_all + 1)
    batches = stored(rows)
    blocks, block_bits = geometry(n_all)
    found = block_levels(block_parts(batches, blocks), block_bits).groupBy("_batch").agg(
        F.sort_array(F.collect_list(F.struct("_block", "_levels"))).alias("_found"))

    def look_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for part in parts:
            for row in range(part.num_rows):
                texts = batch_texts(part, row)
                _, word, pair = batch_keys(texts)
                levels = np.frombuffer(b"".join(x["_levels"] for x in part.column("_found")[row].as_py()), np.uint8)
                sizes = np.array([len(t) + 1 for t in texts], np.int64)
                cut = lambda a: pa.array([x.tobytes() for x in np.split(a, np.cumsum(sizes)[:-1])], pa.binary())
                logs, n_known, rare = [], [], []
                for text in texts:
                    got = list(map(known.get, [*text, b""]))
                    rest = [w for w, c in zip([*text, b""], got) if c is None]
                    rare.append(rest)
                    logs.append(math.fsum(c for c in got if c is not None) if rest else math.fsum(got))
                    n_known.append(len(got) - len(rest))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c)[row].values for c in ("_doc", "_th", "_held")), pa.array(sizes), pa.array(n_known, pa.int64()),
                     pa.array(logs, pa.float64()), pa.array(rare, pa.list_(pa.binary())), cut(levels[word]), cut(levels[pair])],
                    names=["_doc", "_th", "_held", "_tokens", "_known", "_log", "_rare", "_own", "_pair"])

    schema = T.StructType([
        *rows.drop("_text").schema.fields,
        *T._parse_datatype_string("_tokens long, _known long, _log double, _rare array<binary>, _own binary, _pair binary").fields])
    looked_up = write_once(batches.join(found, "_batch").mapInArrow(look_up, schema), "levels")
    weights = mix_weights(looked_up)
    partly = looked_up.drop("_own", "_pair")

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                own, pair, left, starts = token_levels(part)
                single = (middle(own) + 1) / (n_all + v_all + 1)
                of_pair = np.minimum(1.0, middle(pair) / np.maximum(middle(left), 1))
                weight = np.where(left > 0, weights[left], 0.0)
                total = np.add.reduceat(np.log10(weight * of_pair + (1 - weight) * single), starts)
                names = ["_doc", "_th", "_held", "_tokens", "_known", "_log"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(total)], names=[*names, "_score"])

    schema = T.StructType([*partly.drop("_rare").schema.fields, T.StructField("_score", T.DoubleType())])
    scored = looked_up.drop("_rare").mapInArrow(score, schema)
    # Rare words meet their counts; sums depend on the text alone, so its hash is key enough, and copies share them.
    rare = partly.select("_th", F.explode("_rare").alias("_word")).join(counts, "_word")
    rest = rare.groupBy("_th").agg(F.count("*").alias("_more"), F.sum(F.log10(F.col("_c") + 1)).alias("_logs"))
    copies = partly.groupBy("_th").agg(F.count("*").alias("_copies"))
    share = lambda c: F.coalesce(F.col(c) / F.col("_copies"), F.lit(0.0))
    sums = scored.join(rest.join(copies, "_th"), "_th", "left")
    return sums.select(
        F.col("_doc").alias(id_col), F.col("_held").alias("held_out"), F.col("_tokens").alias("n_tokens"),
        (F.col("_known") + F.round(share("_more")).cast("long")).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("_log") + share("_logs") - F.col("_tokens") * floor).alias("base_score"), F.col("_score").alias("score"))
