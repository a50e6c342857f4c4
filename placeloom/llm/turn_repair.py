"""Conversation repair: the cheapest edits that give a conversation a well-formed order of roles.

Role initials must read ``(s?(ua)+)?`` after the edits Keep (0), Rerole to user or assistant (2), Delete (3, required
for blank and duplicate rows) and Insert of an empty user or assistant row (2); a truncated row that stays adds 1.
Of equal costs the edits whose initials come first in ASCII win.

Every path through the graph (row, state of the pattern) has one whole number as its weight: the cost in the high
digits, below it one base-256 digit per edit, placed by its position from the left, with zeros behind the last edit.
An ordinary minimum of integers therefore settles cost, letters and length at once. The graph is folded from the
last row to the first; a letter put in front moves the digits one place to the right.

Conversations of any length: rows are put in order by range, not by conversation, and cut into pieces of at most
``rows_per_piece``. A piece gives the best weights between each two states; pieces are joined sixteen at a time,
round by round. (Two paths of a piece with equal cost and equal ends are never prefixes of each other, since more
inserts cost more, so the choice within a piece holds whatever follows.) Only the edit letters of one conversation,
which the report returns, and a row at a time of its texts are held in one task: SHA-256 reads a text in order.

Rows: a null role or text counts as one space; null turns stand first; rows of one turn go by role, then by the
digest of role and text. A null conversation id is a conversation of its own. Repeated rows are duplicates. Empty
tables give empty tables; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.session import write_once

ROWS_PER_PIECE = 1024
FAN = 16

# states of the pattern: 0 nothing yet, 1 behind s, 2 behind u, 3 behind a; an ending is allowed in 0 and 3
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FORCED = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
ENDINGS = (0, 3)

BLANKS = " \t\n\x0b\f\r"


def fold(rows: list[tuple[str, bool, bool]], ends: Iterable[int], tail: bool) -> list[int | None]:
    """Least weight from each state before ``rows`` to one of the states ``ends`` behind them.

    A row is (role initial, must go, truncated). ``tail``: inserts are allowed behind the last row too.
    """
    width = 8 * (3 * len(rows) + 2)
    digits = (1 << width) - 1

    def put(weight: int | None, cost: int, letter: str) -> int | None:
        if weight is None:
            return None
        return ((weight >> width) + cost << width) + ((weight & digits) >> 8) + (ord(letter) << width - 8)

    def least(*weights: int | None) -> int | None:
        return min((w for w in weights if w is not None), default=None)

    def with_inserts(after: list[int | None]) -> list[int | None]:
        once = [least(after[s], put(after[FORCED[s]], 2, "I")) for s in range(4)]
        return [least(after[s], put(once[FORCED[s]], 2, "I")) for s in range(4)]

    best = [0 if s in ends else None for s in range(4)]
    if tail:
        best = with_inserts(best)
    for initial, gone, truncated in reversed(rows):
        step = []
        for s in range(4):
            ways = [put(best[s], 3, "D")]
            if not gone:
                ways.append(put(best[FORCED[s]], 2 + truncated, "R"))
                if initial in KEEP[s]:
                    ways.append(put(best[KEEP[s][initial]], int(truncated), "K"))
            step.append(least(*ways))
        best = with_inserts(step)
    return best


def split_weight(weight: int | None, n: int) -> tuple[int, str] | None:
    """Cost and edit letters of a weight over ``n`` rows."""
    if weight is None:
        return None
    size = 3 * n + 2
    letters = (weight & ((1 << 8 * size) - 1)).to_bytes(size, "big").rstrip(b"\0")
    return weight >> 8 * size, letters.decode()


def matrix(rows: list[tuple[str, bool, bool]], head: bool, tail: bool) -> list[tuple[int, str] | None]:
    """Sixteen (cost, letters), start state times end state; a tail has all allowed endings in place 0."""
    cells: list[tuple[int, str] | None] = [None] * 16
    for place, ends in ([(0, ENDINGS)] if tail else [(t, (t,)) for t in range(4)]):
        weights = fold(rows, ends, tail)
        for s in (0,) if head else range(4):
            cells[4 * s + place] = split_weight(weights[s], len(rows))
    return cells


def joined(one: list, two: list) -> list:
    """Best weights through two neighbouring pieces."""
    size = max((len(c[1]) for c in one if c), default=0) + max((len(c[1]) for c in two if c), default=0)
    cells: list[tuple[int, str] | None] = [None] * 16
    for s in range(4):
        for t in range(4):
            ways = []
            for m in range(4):
                a, b = one[4 * s + m], two[4 * m + t]
                if a and b:
                    letters = (a[1] + b[1]).encode()
                    ways.append(((a[0] + b[0] << 8 * size) + int.from_bytes(letters.ljust(size, b"\0"), "big"), letters))
            if ways:
                weight, letters = min(ways)
                cells[4 * s + t] = (weight >> 8 * size, letters.decode())
    return cells


PIECE = "_c string, _piece long, head boolean, tail boolean, first string, last string, illegal long, " \
    "blank long, duplicate long, truncated long, costs array<long>, letters array<string>"
BATCH = 2000


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of sorted batches, one list for each run of equal values in the first ``keys`` columns."""
    run: list[tuple] = []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if run and row[:keys] != run[0][:keys]:
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def _as_batches(rows: Iterable[tuple], schema: pa.Schema, most: int = BATCH) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= most or size > 1 << 22:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


ARROW_PIECE = pa.schema([
    ("_c", pa.string()), ("_piece", pa.int64()), ("head", pa.bool_()), ("tail", pa.bool_()), ("first", pa.string()),
    ("last", pa.string()), ("illegal", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("costs", pa.list_(pa.int64())), ("letters", pa.list_(pa.string()))])

LEGAL = {"su", "ua", "au"}


def _cells(cells: list) -> tuple[list, list]:
    return [c and c[0] for c in cells], [c and c[1] for c in cells]


def _fold_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pieces():
        for run in _runs(batches, 2):
            initials = [row[3] for row in run]
            blank = [row[4] for row in run]
            again = [not row[4] and not row[6] & 1 for row in run]
            cut = [row[5] and not b and not d for row, b, d in zip(run, blank, again, strict=True)]
            head, tail = bool(run[0][6] & 2), bool(run[-1][6] & 4)
            rows = [(i, b or d, t) for i, b, d, t in zip(initials, blank, again, cut, strict=True)]
            illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
            yield (*run[0][:2], head, tail, initials[0], initials[-1], illegal, sum(blank), sum(again), sum(cut),
                   *_cells(matrix(rows, head, tail)))

    yield from _as_batches(pieces(), ARROW_PIECE)


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input: key, group, place, then the columns of a piece from ``head`` on."""
    def groups():
        for run in _runs(batches, 2):
            first, last = run[0], run[-1]
            cells = [c if c is None else (c, l) for c, l in zip(first[10], first[11], strict=True)]
            illegal = first[7]
            for before, row in zip(run, run[1:], strict=False):
                illegal += row[7] + (before[6] + row[5] not in LEGAL)
                cells = joined(cells, [c if c is None else (c, l) for c, l in zip(row[10], row[11], strict=True)])
            sums = [sum(row[i] for row in run) for i in (8, 9, 12)]
            yield (*first[:2], first[3], last[4], first[5], last[6], illegal, *sums, *_cells(cells))

    yield from _as_batches(groups(), ARROW_PIECE, 64)


def in_order(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows with ``_c`` (key of the conversation), ``_pos`` (their order over the table) and what decides faults."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    rows = turns.select(
        conversation_key(F.col(conv_col)).alias("_c"), F.col(turn_col).alias("_turn"), role.alias("_role"), text.alias("_text"),
    ).withColumn("_key", F.unhex(F.sha2(F.concat(F.length("_role").cast("string"), F.lit(":"), "_role", "_text"), 256)))
    order = ["_c", F.col("_turn").asc_nulls_first(), "_role", "_key"]
    stripped = F.rtrim("_text", F.lit(BLANKS))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.monotonically_increasing_id().alias("_pos"), (stripped == "").alias("_blank"),
        (~F.right(stripped, F.lit(1)).isin(".", "!", "?")).alias("_cut"))
    return write_once(placed, "turns")


def conversation_key(column: Column) -> Column:
    """A key that is never null and tells a null id from every other."""
    return F.when(column.isNull(), "").otherwise(F.concat(F.lit("="), column.cast("string")))


def edits(ordered: DataFrame, rows_per_piece: int = ROWS_PER_PIECE, fan: int = FAN) -> DataFrame:
    """Per conversation of ``in_order``: faults, cost, edit letters, ``_pos`` of its first row and ``gaps``."""
    spans = ordered.groupBy("_c").agg(
        F.min("_pos").alias("_head"), F.max("_pos").alias("_tail"), F.count_distinct("_turn").alias("_turns"),
        F.max("_turn").alias("_last"), F.min("_turn").alias("_first"))
    # bits of a row: 1 its role and text are new, 2 first row, 4 last row; joined on the row, so no key is hot
    new = ordered.filter(~F.col("_blank")).groupBy("_c", "_key").agg(F.min("_pos").alias("_pos")).select("_pos", F.lit(1).alias("_bit"))
    ends = spans.select(F.inline(F.array(
        F.struct(F.col("_head").alias("_pos"), F.lit(2).alias("_bit")), F.struct(F.col("_tail").alias("_pos"), F.lit(4).alias("_bit")))))
    bits = new.unionByName(ends).groupBy("_pos").agg(F.sum("_bit").cast("int").alias("_bits"))
    rows = ordered.select("_c", "_pos", F.left("_role", F.lit(1)).alias("_initial"), "_blank", "_cut").join(bits, "_pos", "left").select(
        "_c", F.floor(F.col("_pos") / rows_per_piece).alias("_piece"), "_pos", "_initial", "_blank", "_cut", F.coalesce("_bits", F.lit(0)).alias("_bits"))
    pieces = write_once(
        rows.repartition("_c", "_piece").sortWithinPartitions("_c", "_piece", "_pos").mapInArrow(_fold_pieces, PIECE), "pieces")
    done = pieces.filter("head and tail")
    rest = pieces.filter("not (head and tail)")
    while not rest.isEmpty():
        place = F.row_number().over(_by_conversation()) - 1
        level = rest.withColumn("_i", place).select(
            "_c", F.floor(F.col("_i") / fan).alias("_group"), "_i", "head", "tail", "first", "last", "illegal", "blank", "duplicate",
            "costs", "letters", "truncated")
        level = write_once(
            level.repartition("_c", "_group").sortWithinPartitions("_c", "_group", "_i").mapInArrow(_join_pieces, PIECE), "pieces")
        done = done.unionByName(level.filter("head and tail"))
        rest = level.filter("not (head and tail)")
    gaps = F.coalesce(F.col("_last") - F.col("_first") + 1 - F.col("_turns"), F.lit(0)).cast("long")
    return done.join(spans, "_c").select(
        "_c", "_head", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal",
        F.col("costs")[0].alias("cost"), F.col("letters")[0].alias("audit"))


def _by_conversation():
    from pyspark.sql import Window

    return Window.partitionBy("_c").orderBy("_piece")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[str, str, str]]]]:
    """(conversation, new rows) as the edits say; rows are (role, text, edit)."""
    conv, letters, at, state = None, "", 0, 0

    def inserts():
        nonlocal at, state
        out = []
        while at < len(letters) and letters[at] == "I":
            state = FORCED[state]
            out.append((ROLES[state], "", "I"))
            at += 1
        return out

    for batch in batches:
        for key, audit, role, text in zip(*(batch.column(n).to_pylist() for n in ("_c", "_audit", "_role", "_text")), strict=True):
            if audit is not None:
                if conv is not None:
                    yield conv, inserts()
                conv, letters, at, state = key, audit, 0, 0
                continue
            out = inserts()
            edit = letters[at]
            at += 1
            if edit == "K":
                state = KEEP[state][role[0]]
                out.append((role, text, "K"))
            elif edit == "R":
                state = FORCED[state]
                out.append((ROLES[state], text, "R"))
            yield conv, out
    if conv is not None:
        yield conv, inserts()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def numbered():
        last, n = None, 0
        for conv, rows in _replayed(batches):
            if conv != last:
                last, n = conv, 0
            for row in rows:
                yield (conv, n, *row)
                n += 1

    yield from _as_batches(numbered(), pa.schema([
        ("_c", pa.string()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def digests():
        last, digest, n = None, None, 0
        for conv, rows in _replayed(batches):
            if conv != last:
                if last is not None:
                    yield last, digest.hexdigest()
                last, digest, n = conv, hashlib.sha256(), 0
            for role, text, _ in rows:
                digest.update(f"{chr(10) if n else ''}{role}:{text}".encode())
                n += 1
        if last is not None:
            yield last, digest.hexdigest()

    yield from _as_batches(digests(), pa.schema([("_c", pa.string()), ("sha256", pa.string())]))


def _replay_input(ordered: DataFrame, found: DataFrame) -> DataFrame:
    rows = ordered.select("_c", "_pos", F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_audit"), "_role", "_text")
    none = F.lit(None).cast("string")
    heads = found.select("_c", F.col("_head").alias("_pos"), F.lit(0).alias("_kind"), F.col("audit").alias("_audit"), none.alias("_role"), none.alias("_text"))
    return rows.unionByName(heads).repartition("_c").sortWithinPartitions("_c", "_pos", "_kind")


def repaired_turns(ordered: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: ``_c``, ``place`` from 0, ``role``, ``text`` and the edit that each row comes from."""
    return _replay_input(ordered, found).mapInArrow(_rows, "_c string, place long, role string, text string, edit string")


def repaired_digests(ordered: DataFrame, found: DataFrame) -> DataFrame:
    """SHA-256 of each repaired conversation, written ``role:text`` with line feeds between rows."""
    return _replay_input(ordered, found).mapInArrow(_digests, "_c string, sha256 string")


def report(
    turns: DataFrame, damaged: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", rows_per_piece: int = ROWS_PER_PIECE, fan: int = FAN,
) -> DataFrame:
    """Per conversation of ``turns``: faults, cost, edits and digest after repair of what ``damaged`` has left of it."""
    ordered = in_order(damaged, conv_col, turn_col, role_col, text_col)
    found = write_once(edits(ordered, rows_per_piece, fan), "edits")
    every = turns.select(F.col(conv_col)).distinct().withColumn("_c", conversation_key(F.col(conv_col)))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return every.join(found, "_c", "left").join(repaired_digests(ordered, found), "_c", "left").select(
        conv_col, *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(nothing)).alias("repaired_sha256"))
