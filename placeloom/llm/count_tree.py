"""N-gram Jaccard join over count vectors.

Shingles are hashed into groups and a document becomes the point of its group counts. The overlap of two sets is at most
the sum of the smaller coordinates, so points (and boxes of points, by their largest coordinates) whose bound is too
small cannot link.

Partitioning. Two linked sets of which the smaller has *n* shingles differ in at most *n*/9 of them (at 0.9; in general
``n * (1 - t) / t``). The groups are dealt to one block more than that, so in some block their counts agree: the
hash of each block's counts is an equality key, and no link is lost. Sizes fall into classes (factor 1.5); a set near
the lower end of its class also gets the keys of the class below.

Links. Sets that are equal are one class. In each key the class with the smallest hash is paired with the others, pairs
that pass the count bound are verified on the sets, and components are formed. Then, only for keys that still
hold several components, members are dealt to bounded blocks and each pair of blocks is searched with a tree over the
points (R-tree: packed nodes with coordinate maxima, descended in pairs while the bound allows). A task hands out what
such pairs connect as stars, fewer rows than it has members. What the stars of all keys connect is one family, so a class
is in one family only and its set moves once, not once for each key; families above a block are dealt to blocks again. A
task verifies a family on the sets and hands out a link only if it joins two components that no link of the family has
joined. Large groups of near copies thus give a line of rows, not a square, and no pair across components is left untested.

Rows: null, empty and wordless texts have no shingles and link with nothing; a text with fewer words than a
shingle has its whole word sequence as one. Equal texts and repeated rows share a class. Null ids take part but
never name a component. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom.llm import bitmaps, workers
from placeloom.llm.lm_bloom import mixed, words
from placeloom.llm.registry import numbered
from placeloom.session import write_once

GROUPS = 256  # coordinates of a point
FINE = 1 << 40  # finer groups, whose counts within a block make its key
FACTOR = 1.5
FAN = 16  # children of a tree node
BLOCK = 512  # members of a key that are searched together
BLOCK_SHINGLES = 1 << 21  # and their shingles in all
PAIRS_AT_ONCE = 1 << 13  # pairs of points or boxes that are compared in one step
ODD = 0x9E3779B97F4A7C15
_ODD = np.uint64(ODD)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text."""
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words(text)], np.uint64)
    if not len(hashes):
        return hashes
    size = max(1, len(hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    for i in range(min(n, len(hashes))):
        out = mixed(out * _ODD + hashes[i:i + size] + np.uint64(1))
    return np.unique(out)


def class_of(shingles: np.ndarray) -> int | None:
    """Hash of a set, as a signed integer; none of the empty set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63) if len(shingles) else None


def point(shingles: np.ndarray) -> np.ndarray:
    """Counts of a set's shingles by group."""
    return np.bincount((shingles % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS).astype(np.int32)


def size_class(n: int) -> tuple[int, int]:
    """Class of a set size and the greatest size in it."""
    number, top = 0, 8
    while top < n:
        number, top = number + 1, int(top * FACTOR)
    return number, top


def size_class_top(number: int) -> int:
    top = 8
    for _ in range(number):
        top = int(top * FACTOR)
    return top


def block_keys(shingles: np.ndarray, threshold: float) -> np.ndarray:
    """Keys of which two linked sets share at least one."""
    n = len(shingles)
    number, top = size_class(n)
    tops = [(number, top)]
    if number:
        below = size_class_top(number - 1)
        if n * threshold <= below:
            tops.append((number - 1, below))
    out = []
    for own, most in tops:
        differ = int(most * (1 - threshold) / threshold + 1e-9)  # most shingles in which two linked sets can differ
        spare = blanks(most, differ + 1)
        blocks = differ + 1 + spare
        spread = mixed(shingles + np.uint64((own + 1) * ODD % (1 << 64)))
        block = ((spread >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        fine = mixed((mixed(spread) & np.uint64(FINE - 1)) + np.uint64(77))
        order = np.argsort(block, kind="stable")
        places, starts = np.unique(block[order], return_index=True)
        sums = np.add.reduceat(fine[order], starts)  # additive hash of the counts of each block
        if blocks - len(places) > spare:  # too many blank blocks to leave them out
            all_sums = np.zeros(blocks, np.uint64)
            all_sums[places.astype(np.int64)] = sums
            places, sums = np.arange(blocks, dtype=np.uint64), all_sums
        out.append(mixed(sums ^ mixed(places * _ODD + np.uint64(own))))
    return np.concatenate(out).view(np.int64)


@lru_cache(maxsize=None)
def blanks(shingles: int, blocks: int) -> int:
    """Blank blocks that a set may have without using them as keys.

    Of ``differ + 1 + spare`` blocks at most ``differ`` are touched by a difference. A set with at most ``spare`` blank
    ones has ``differ + 1`` or more others, so one of these is untouched, and its partner has it too. A set with more
    blank blocks uses them as keys as well. The number is the expected one and four deviations for 2/3 of the size.
    """
    mean = blocks * (1 - 1 / blocks) ** (shingles / FACTOR)
    return int(mean + 4 * mean ** 0.5)


def enough(sizes_a: np.ndarray, sizes_b: np.ndarray, threshold: float) -> np.ndarray:
    """Least overlap of linked sets of these sizes."""
    return np.ceil((sizes_a + sizes_b) * threshold / (1 + threshold) - 1e-9)


def tree_pairs(points: np.ndarray, sizes: np.ndarray, parts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of different parts whose bound on the overlap allows a link, by descending a packed tree."""
    order = np.lexsort((points[:, 0], sizes))
    levels = [(points[order], sizes[order])]
    while len(levels[-1][1]) > 1:
        top, low = levels[-1]
        at = np.arange(0, len(low), FAN)
        levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(low, at)))
    a = b = np.zeros(1, np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        top, low = levels[depth]
        keep = np.zeros(len(a), bool)
        for start in range(0, len(a), PAIRS_AT_ONCE):
            i, j = a[start:start + PAIRS_AT_ONCE], b[start:start + PAIRS_AT_ONCE]
            keep[start:start + PAIRS_AT_ONCE] = np.minimum(top[i], top[j]).sum(1) >= enough(low[i], low[j], threshold)
        a, b = a[keep], b[keep]
        if depth:
            below = len(levels[depth - 1][1])
            child = np.arange(FAN)
            i = (a[:, None, None] * FAN + child[None, :, None] + 0 * child[None, None, :]).reshape(-1)
            j = (b[:, None, None] * FAN + child[None, None, :] + 0 * child[None, :, None]).reshape(-1)
            real = (i < below) & (j < below) & (i <= j)
            a, b = i[real], j[real]
    a, b = order[a], order[b]
    other = parts[a] != parts[b]
    return a[other], b[other]


def _points(rows: DataFrame, n: int, threshold: float) -> DataFrame:
    """Per row of ``_doc``, ``_text``: ``_class`` (hash of the set), ``_n``, ``_point`` (counts as bytes), ``_keys``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in workers.sliced(batches):
            texts, classes, sizes, points, keys = batch.column(1), [], [], [], []
            for row in range(batch.num_rows):
                shingles = shingle_set(texts[row].as_py(), n)
                sizes.append(len(shingles))
                classes.append(class_of(shingles))
                if len(shingles):
                    points.append(point(shingles).tobytes())
                    keys.append(block_keys(shingles, threshold))
                else:
                    points.append(None)
                    keys.append(np.array([], np.int64))
            ends = pa.array(np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32))
            flat = pa.array(np.concatenate(keys) if keys else np.array([], np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(points, pa.binary()),
                 pa.ListArray.from_arrays(ends, flat)], names=["_doc", "_class", "_n", "_point", "_keys"])

    more = T._parse_datatype_string("_class long, _n long, _point binary, _keys array<long>").fields
    return rows.mapInArrow(run, T.StructType([rows.schema["_doc"], *more]))


def _bounded(pairs: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``_a``, ``_b`` whose summed coordinate minima allow a link."""
    one = points.select(F.col("_class").alias("_a"), F.col("_n").alias("_na"), F.col("_point").alias("_pa"))
    two = points.select(F.col("_class").alias("_b"), F.col("_n").alias("_nb"), F.col("_point").alias("_pb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int32).reshape(-1, GROUPS) for c in ("_pa", "_pb"))
                least = enough(batch.column("_na").to_numpy(), batch.column("_nb").to_numpy(), threshold)
                good = pa.array(np.minimum(a, b).sum(1) >= least)
                yield batch.select(["_a", "_b"]).filter(good)

    joined = pairs.join(one, "_a").join(two, "_b").select("_a", "_b", "_na", "_nb", "_pa", "_pb")
    return joined.mapInArrow(run, "_a long, _b long")


def _sets(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``_class`` and ``_set`` for the classes in ``wanted`` (``_class``), from a scan of the texts.

    The scan drops most other sets by a bitmap of fixed size; what it lets through too much only costs its way.
    """
    shared = rows.sparkSession.sparkContext.broadcast(bitmaps.of(wanted, "_class"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in workers.sliced(batches):
            classes, sets = [], []
            for text in batch.column(1):
                shingles = shingle_set(text.as_py(), n)
                own = class_of(shingles)
                if own is not None and bitmaps.maybe(shared.value, np.array([own]))[0]:
                    classes.append(own)
                    sets.append(shingles.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sets, pa.binary())], names=["_class", "_set"])

    found = rows.mapInArrow(run, "_class long, _set binary")
    return write_once(found.groupBy("_class").agg(F.first("_set").alias("_set")), "sets")


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two sets, sorted and without repeats, link."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= round(threshold * 100) * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose sets link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column("_sa"), batch.column("_sb"))
            good = [linked(*(np.frombuffer(side.as_buffer(), np.uint64) for side in pair), threshold) for pair in sides]
            yield batch.select(["_a", "_b"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(sets.select(F.col("_class").alias("_b"), F.col("_set").alias("_sb")), "_b").join(
        sets.select(F.col("_class").alias("_a"), F.col("_set").alias("_sa")), "_a")
    return joined.select("_a", "_b", "_sa", "_sb").mapInArrow(run, "_a long, _b long")


def components(edges: DataFrame) -> DataFrame:
    """``_class`` and ``_root`` (smallest class reachable) for the classes in ``edges`` (``_a``, ``_b``).

    Each round takes the smallest label among the neighbours and then the label of that label; the number of rounds
    grows with the logarithm of a component's width, not with its size.
    """
    both = write_once(edges.select("_a", "_b").union(edges.select("_b", "_a")).distinct(), "edges")
    labels = write_once(both.groupBy("_a").agg(F.min("_b").alias("_m")).select(
        F.col("_a").alias("_class"), F.least("_a", "_m").alias("_root")), "labels")
    while True:
        near = both.join(labels.select(F.col("_class").alias("_b"), "_root"), "_b").groupBy("_a").agg(F.min("_root").alias("_m"))
        lower = labels.join(near, labels["_class"] == near["_a"]).select("_class", F.col("_root").alias("_was"), F.least("_root", "_m").alias("_root"))
        step = lower.select(F.col("_class").alias("_root"), F.col("_root").alias("_next"))
        found = write_once(lower.join(step, "_root", "left").select("_class", "_was", F.coalesce("_next", "_root").alias("_root")), "labels")
        labels = found.select("_class", "_root")
        if found.filter("_root <> _was").isEmpty():
            return labels


class Parts:
    """Disjoint sets of numbers."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def top(self, part: int) -> int:
        above = self.above
        while (up := above.get(part, part)) != part:
            above[part] = part = above.get(up, up)
        return part

    def join(self, one: int, two: int) -> None:
        self.above[self.top(one)] = self.top(two)


def spanning(classes: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What pairs of indexes connect, as edges from the smallest class of each group to its others."""
    tied = Parts()
    for i, j in zip(*(side.tolist() for side in pairs)):
        tied.join(i, j)
    least: dict[int, int] = {}
    at = np.unique(np.concatenate(pairs)).tolist()
    for i in at:
        own = tied.top(i)
        least[own] = min(least.get(own, int(classes[i])), int(classes[i]))
    centre = np.array([least[tied.top(i)] for i in at], np.int64)
    others = classes[at] if at else centre
    return centre[centre != others], others[centre != others]


def joining_links(sets: list[np.ndarray], parts: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links between the sets that join their parts as far as all links would, each joining two parts: a line, no square."""
    sizes = np.array([len(s) for s in sets])
    points = np.array([point(s) for s in sets])
    joined, out = Parts(), []
    for i, j in zip(*(side.tolist() for side in tree_pairs(points, sizes, parts, threshold))):
        one, two = joined.top(int(parts[i])), joined.top(int(parts[j]))
        if one != two and linked(sets[i], sets[j], threshold):
            joined.join(one, two)
            out.append((i, j))
    return out


def _in_blocks(members: DataFrame, group: str) -> DataFrame:
    """The rows of each pair of blocks ``_i``, ``_j`` of a group, the members dealt to blocks of bounded size."""
    dealt = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("_n") / BLOCK_SHINGLES)).cast("int")
    sizes = members.groupBy(group).agg(dealt.alias("_blocks"))
    mine = members.join(sizes, group).withColumn("_mine", F.pmod(F.xxhash64("_class"), F.col("_blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    return mine.withColumn("_with", others).select(
        *members.columns, F.least("_mine", "_with").alias("_i"), F.greatest("_mine", "_with").alias("_j"))


def _near(members: DataFrame, threshold: float) -> DataFrame:
    """From ``_key``, ``_class``, ``_root``, ``_n``, ``_point``: edges ``_a``, ``_b`` that connect what may link. A pair of
    blocks gives fewer than it has members, and what several keys hold is given once."""
    def search(part: pa.Table) -> pa.Table:
        points = np.frombuffer(b"".join(part["_point"].to_pylist()), np.int32).reshape(-1, GROUPS)
        pairs = tree_pairs(points, part["_n"].to_numpy(), part["_root"].to_numpy(), threshold)
        one, two = spanning(part["_class"].to_numpy(), pairs)
        return pa.table({"_a": one, "_b": two})

    return _in_blocks(members, "_key").groupBy("_key", "_i", "_j").applyInArrow(search, "_a long, _b long").distinct()


def _joining(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """From ``_family``, ``_class``, ``_root``, ``_n``: links ``_a``, ``_b`` that join different roots of a family, verified
    on the sets: fewer than a pair of blocks has members."""
    def search(part: pa.Table) -> pa.Table:
        held = [np.frombuffer(s.as_buffer(), np.uint64) for s in part["_set"]]
        links = joining_links(held, part["_root"].to_numpy(), threshold)
        ends = part["_class"].to_numpy()[np.array(links, np.int64).reshape(-1, 2)]
        return pa.table({"_a": ends.min(1), "_b": ends.max(1)})

    sides = _in_blocks(members, "_family").join(sets, "_class")
    return sides.groupBy("_family", "_i", "_j").applyInArrow(search, "_a long, _b long").distinct()


def _keys_in(found: DataFrame, shared: DataFrame) -> DataFrame:
    """``_class`` and ``_key`` of the keys that may be in ``shared``; the bitmap spares most others the shuffle."""
    bits = found.sparkSession.sparkContext.broadcast(bitmaps.of(shared, "_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            key = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.diff(lists.offsets.to_numpy())
            keep = bitmaps.maybe(bits.value, key)
            owner = np.repeat(np.arange(batch.num_rows), sizes)[keep]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(key[keep])], names=["_class", "_key"])

    return found.filter("_class is not null").select("_class", "_keys").mapInArrow(run, "_class long, _key long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, threshold: float = 0.9,
) -> DataFrame:
    """Per document: ``n_shingles`` and ``component_id``, the smallest id reachable by links of Jaccard >= threshold."""
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    found = write_once(_points(texts, n, threshold), "points")
    keys = found.filter("_class is not null").select("_class", F.explode("_keys").alias("_key"))
    shared = write_once(
        keys.groupBy("_key").agg(F.min("_class").alias("_low"), F.max("_class").alias("_high")).filter("_low <> _high").select("_key"), "keys")
    members = write_once(_keys_in(found, shared).join(shared, "_key").distinct(), "members")
    points = found.join(members.select("_class").distinct(), "_class").groupBy("_class").agg(
        F.first("_n").alias("_n"), F.first("_point").alias("_point"))
    points = write_once(points, "classes")

    centre = F.min(F.struct(F.xxhash64("_class").alias("h"), F.col("_class").alias("c")))
    centres = members.groupBy("_key").agg(centre.alias("_m")).select("_key", F.col("_m.c").alias("_a"))
    stars = members.join(centres, "_key").filter("_class <> _a").select("_a", F.col("_class").alias("_b")).distinct()
    stars = write_once(_bounded(stars, points, threshold), "stars")
    ends = stars.select(F.explode(F.array("_a", "_b")).alias("_class"))
    links = write_once(_verified(stars, _sets(texts, ends, n), threshold), "links")
    labels = components(links)

    own = F.coalesce("_root", "_class").alias("_root")
    placed = members.join(labels, "_class", "left").select("_key", "_class", own)
    # Keys with the same members (most pairs share many keys) are searched once.
    alike = [F.sum(F.xxhash64("_class", F.lit(i)).cast("decimal(38,0)")).alias(f"_s{i}") for i in (1, 2)]
    mixed_keys = placed.groupBy("_key").agg(F.min("_root").alias("_low"), F.max("_root").alias("_high"), *alike).filter("_low <> _high")
    once = mixed_keys.groupBy("_s1", "_s2").agg(F.min("_key").alias("_key")).select("_key")
    open_keys = placed.join(once, "_key").join(points, "_class")
    near = write_once(_near(open_keys, threshold), "families")
    if not near.isEmpty():
        whole = components(near).select("_class", F.col("_root").alias("_family"))
        related = whole.join(labels, "_class", "left").join(points, "_class").select("_family", "_class", own, "_n")
        more = write_once(_joining(related, _sets(texts, whole, n), threshold), "rest")
        if not more.isEmpty():
            labels = components(links.union(more))

    rows = found.join(labels, "_class", "left").select("_doc", "_n", "_class", own)
    least = rows.filter("_root is not null").groupBy("_root").agg(F.min("_doc").alias("_least"))
    return rows.join(least, "_root", "left").select(
        F.col("_doc").alias(id_col), F.col("_n").alias("n_shingles"), F.coalesce("_least", "_doc").alias("component_id"))


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8,
) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the smallest id stays.

    Rows that repeat the kept id stay as well, and so do rows without id."""
    docs, (id_col, text_col), old = numbered(docs, id_col, text_col)
    found = near_duplicates(docs, id_col, text_col, n, threshold)
    gone = write_once(found.filter(F.col(id_col) != F.col("component_id")).select(F.xxhash64(id_col).alias("_h"), F.col(id_col).alias("_gone")).distinct(), "gone")
    marked = bitmaps.marked(docs, F.xxhash64(id_col), gone, "_h")
    clear = marked.filter("not _maybe").select(docs.columns)
    rest = marked.filter("_maybe").select(docs.columns).join(gone, F.col(id_col) == F.col("_gone"), "left_anti")
    return clear.unionByName(rest).toDF(*old)
