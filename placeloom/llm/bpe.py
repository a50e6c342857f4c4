"""Byte-pair encoding as a streaming transducer, and decoding as an incremental byte-to-text machine.

The vocabulary file is a path (read by each worker; ship it with ``spark.files`` or keep it where every
worker sees it). Encoding follows the file's merge list exactly; added tokens in a text become their ids.

A long run of letters is never held as one list of parts: the merge list gives a *sufficient lookahead*,
the number of bytes right of a token that can still change it, and a token is emitted as soon as that
many bytes behind it are known. Memory is bounded by lookahead and block size.

Rows: a null or empty text has no tokens and decodes to the empty text; repeated rows and ties do not
matter, since each row stands for itself; extra columns are not touched.
"""

from __future__ import annotations

import codecs
import json
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom.llm import workers

# The pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Characters whose letter, number and space classes are the same in all recent Unicode versions. A text with
# others is cut by the tokenizer library's own splitter, whose Unicode version may differ.
SETTLED = r"[\x00-՗‐-‧‰-⁞₠-₵ぁ-ゖァ-ヺ一-龥가-힣！-～]*+"
# The same pattern for texts of ASCII and Latin letters only, spelt out for the faster standard module.
PLAIN = re.compile(r"[\x00-~À-ÖØ-öø-ſ–-„]*")
_L = "A-Za-zÀ-ÖØ-öø-ſ"
PLAIN_PATTERN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\t-\r {_L}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
CUT = regex.compile(r"(?<=\S) (?=\p{L})")

CHUNK_CHARS = 1 << 16  # texts are cut at a safe blank after so many characters
SHORT_BYTES = 128  # pieces up to this size are merged whole and remembered
CACHE_PIECES = 250_000
CACHE_PAIRS = 300_000
START_BYTES = 4  # by these first bytes the lengths that tokens may have are looked up
YIELD_TOKENS = 1 << 20


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Merges:
    """Merge list, vocabulary and added tokens of one byte-level BPE file."""

    def __init__(self, vocabulary: dict[bytes, int], pairs: list[tuple[bytes, bytes]], added: dict[str, int]):
        self.ids = vocabulary
        self.bytes_of = {i: b for b, i in vocabulary.items()} | {i: s.encode() for s, i in added.items()}
        # the first place of a pair in the list counts
        self.rank = {}
        for at, (a, b) in enumerate(pairs):
            self.rank.setdefault((vocabulary[a], vocabulary[b]), (at, vocabulary[a + b]))
        self.added = added
        self.added_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(added, key=len, reverse=True))) if added else None
        self.pairs = {at: pair for pair, (at, _) in self.rank.items()}
        self.end = len(pairs) + 1
        # the rule that makes a token where its bytes stand alone: that of its last merge
        self.made_at: dict[int, int] = {}
        rules = Counter(made for _, made in self.rank.values())
        for (a, b), (at, made) in self.rank.items():
            if rules[made] == 1 or self.merge(self.bytes_of[made], made) == [a, b]:
                self.made_at[made] = at
        self.whole = {b: i for b, i in vocabulary.items() if self.merge(b) == [i]}  # tokens that merges reach
        found: dict[bytes, set[int]] = {}
        for b in self.whole:
            if len(b) >= START_BYTES:
                found.setdefault(b[:START_BYTES], set()).add(len(b))
        self.long = {start: sorted(sizes, reverse=True) for start, sizes in found.items()}
        self.lengths: dict[bytes, list[int]] = {}
        self.side_by_side: dict[tuple[int, int], bool] = {}

    @staticmethod
    def from_file(path: str) -> Merges:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letter = byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocabulary = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in added}
        pairs = [tuple(p) if isinstance(p, list) else tuple(p.split(" ")) for p in spec["model"]["merges"]]
        return Merges(vocabulary, [(raw(a), raw(b)) for a, b in pairs], added)

    def lookahead(self) -> int:
        """Bytes right of a token's end that are enough to know that the token is final.

        ``reach(r)`` bounds how far right of its own end a text can change whether rule *r* is applied at a
        place. Rule (a, b) is held up only by an earlier rule: one that takes *b* for itself, (b, z), which
        needs *z* and what *z* depends on; or one inside *b* whose own right side changes. Both are earlier in
        the list, so one pass in list order settles all. A token is final when no rule that could take it
        as the left side, with that rule's reach, can still see unknown bytes.
        """
        length = {i: len(b) for i, b in self.bytes_of.items()}
        as_left: dict[int, int] = {}  # token -> widest view of the rules seen so far that take it as left side
        made: dict[int, int] = {}  # token -> reach of the rules that make it
        widest = 0
        for (a, b), (_, made_id) in sorted(self.rank.items(), key=lambda r: r[1][0]):
            reach = max(made.get(b, 0), as_left.get(b, 0))
            made[made_id] = max(made.get(made_id, 0), reach)
            view = length[b] + reach
            as_left[a] = max(as_left.get(a, 0), view)
            widest = max(widest, view)
        return widest

    def merge(self, piece: bytes, before: int = -1) -> list[int]:
        """Tokens of a piece held whole: the earliest rule, leftmost place first, until none applies.

        With ``before``: the parts from which that token, being the whole piece, is put together.
        """
        parts, get = [self.ids[piece[i:i + 1]] for i in range(len(piece))], self.rank.get
        while len(parts) > 1:
            found = [r for r in map(get, zip(parts, parts[1:])) if r is not None]
            if not found:
                break
            at, made = min(found)
            if made == before and len(parts) == 2:
                break
            a, b = self.pairs[at]
            out, i, last = [], 0, len(parts) - 1
            while i <= last:
                if i < last and parts[i] == a and parts[i + 1] == b:
                    out.append(made)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether the merges keep the tokens *a*, *b* apart when their bytes stand side by side.

        Seen backwards: the later of the two formations is undone step by step. At each step a rule across the
        border would have come first if it stands earlier in the list than the formation just undone, or is
        the same rule and that formation lies right of the border.
        """
        left, right = a, b
        bound, made = self.end, self.made_at
        while True:
            across = self.rank.get((left, right))
            if across is not None and across[0] < bound:
                return False
            at_left, at_right = made.get(left, -1), made.get(right, -1)
            if at_left < 0 and at_right < 0:
                return True
            if at_left > at_right:
                bound, left = at_left, self.pairs[at_left][1]
            else:
                bound, right = at_right + 1, self.pairs[at_right][0]

    def sizes(self, start: bytes) -> list[int]:
        """Lengths that a token with these first bytes may have, the longest first."""
        if len(self.lengths) >= CACHE_PAIRS:
            self.lengths.clear()
        short = [k for k in range(min(START_BYTES - 1, len(start)), 0, -1) if start[:k] in self.whole]
        found = self.lengths[start] = self.long.get(start, []) + short
        return found

    def tokens(self, piece: bytes) -> list[int]:
        """The same tokens as ``merge``: a sequence is the encoding exactly if each token may follow the one
        before it, and there is only one such sequence; it is searched with the longest tokens first."""
        if piece in self.whole:
            return [self.whole[piece]]
        size, ids, lengths, pairs = len(piece), self.whole, self.lengths, self.side_by_side
        first = piece[:START_BYTES]
        out, ends, tries = [-1], [0], [iter(lengths.get(first) or self.sizes(first))]
        dead: set[tuple[int, int]] = set()
        while ends[-1] < size:
            start, before = ends[-1], out[-1]
            for length in tries[-1]:
                if start + length > size:
                    continue
                token = ids.get(piece[start:start + length])
                if token is None or dead and (start + length, token) in dead:
                    continue
                ok = before < 0 or pairs.get((before, token))
                if ok is None:
                    ok = self.follows(before, token)
                    if len(pairs) >= CACHE_PAIRS:
                        pairs.clear()
                    pairs[before, token] = ok
                if ok:
                    start += length
                    out.append(token)
                    ends.append(start)
                    first = piece[start:start + START_BYTES]
                    tries.append(iter(lengths.get(first) or self.sizes(first)))
                    break
            else:
                dead.add((ends.pop(), out.pop()))
                tries.pop()
                if not tries:  # no such sequence: the list has rules that do not stand in order of need
                    return self.merge(piece)
        return out[1:]


class Transducer:
    """Text in, token ids out; state: the bytes that are not yet settled."""

    def __init__(self, merges: Merges, splitter=None, block: int | None = None):
        self.merges, self.splitter = merges, splitter
        self.ahead = merges.lookahead()
        self.block = block or max(512, 2 * self.ahead)
        self.pattern, self.settled = regex.compile(PATTERN), regex.compile(SETTLED)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def long_piece(self, piece: bytes) -> Iterator[int]:
        """Tokens of a piece of any length, in blocks: emitted once ``ahead`` bytes behind them are known."""
        start, size = 0, len(piece)
        while start < size:
            held = piece[start:start + self.ahead + self.block]
            final = start + len(held) == size
            end = 0
            for token in self.merges.tokens(held):
                end += len(self.merges.bytes_of[token])
                if not final and end > len(held) - self.ahead:
                    end -= len(self.merges.bytes_of[token])
                    break
                yield token
            start += end

    def piece(self, piece: str) -> Sequence[int]:
        tokens = self.older.get(piece)
        if tokens is None:
            raw = piece.encode()
            if len(raw) > SHORT_BYTES:
                return list(self.long_piece(raw))
            tokens = tuple(self.merges.tokens(raw))
        if len(self.known) >= CACHE_PIECES:
            self.known, self.older = {}, self.known
        self.known[piece] = tokens
        return tokens

    def plain(self, text: str, out: list[int]) -> None:
        """Append the tokens of a text without added tokens."""
        start, size = 0, len(text)
        while start < size:
            stop = size
            if size - start > CHUNK_CHARS:
                blank = CUT.search(text, start + CHUNK_CHARS)
                stop = blank.start() if blank else size
            chunk = text[start:stop]
            if PLAIN.fullmatch(chunk):
                pieces = PLAIN_PATTERN.findall(chunk)
            elif self.splitter is None or self.settled.fullmatch(chunk):
                pieces = self.pattern.findall(chunk)
            else:
                pieces = [chunk[i:j] for _, (i, j) in self.splitter.pre_tokenize_str(chunk)]
            found = list(map(self.known.get, pieces))
            if None in found:
                found = [(self.known.get(piece) or self.piece(piece)) if tokens is None else tokens for piece, tokens in zip(pieces, found)]
            out.extend(chain.from_iterable(found))
            start = stop

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        added = self.merges.added_pattern
        start = 0
        for found in added.finditer(text) if added else ():
            self.plain(text[start:found.start()], out)
            out.append(self.merges.added[found.group()])
            start = found.end()
        self.plain(text[start:] if start else text, out)
        return out


class TextMachine:
    """Ids in, text out; state: the bytes of a character that is not complete yet."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids, last: bool = False) -> str:
        table = self.bytes_of
        return self.state.decode(b"".join([table[i] for i in ids]), last)

    def text(self, ids: list[int]) -> str:
        """All of one sequence; bytes that are no UTF-8 become U+FFFD."""
        self.state.reset()
        return "".join(self.feed(ids[i:i + CHUNK_CHARS], i + CHUNK_CHARS >= len(ids)) for i in range(0, len(ids), CHUNK_CHARS))


@lru_cache(maxsize=2)
def loaded(path: str) -> Merges:
    return Merges.from_file(path)


@lru_cache(maxsize=2)
def _transducer(path: str) -> Transducer:
    """One for all tasks of a worker: the tokens of pieces seen before stay known."""
    from tokenizers import pre_tokenizers

    return Transducer(loaded(path), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True))


def forget() -> None:
    """Free the token list and the known pieces of this worker."""
    _transducer.cache_clear()
    loaded.cache_clear()


workers.KEPT.append(forget)


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])


def encode(docs: DataFrame, path: str, text_col: str = "text", to: str = "token_ids") -> DataFrame:
    """``docs`` with a column of token ids (array of int); an existing column ``to`` is replaced."""
    docs = docs.drop(to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _transducer(path)
        for batch in batches:
            texts, start, ends, flat = batch.column(batch.schema.get_field_index(text_col)), 0, [0], []
            for at in range(batch.num_rows):
                flat.extend(work.encode(texts[at].as_py()))
                ends.append(len(flat))
                if len(flat) >= YIELD_TOKENS or at == batch.num_rows - 1:
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
                    yield _with(batch.slice(start, at + 1 - start), to, ids)
                    start, ends, flat = at + 1, [0], []

    schema = T.StructType([*docs.schema.fields, T.StructField(to, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, ids_col: str = "token_ids", to: str = "decoded") -> DataFrame:
    """``tokens`` with the text of its ids, added tokens included; null ids give the empty text."""
    tokens = tokens.drop(to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = TextMachine(loaded(path).bytes_of)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            out = []
            for at in range(batch.num_rows):
                row = ids[at].values
                out.append("" if row is None else machine.text(row.to_numpy(zero_copy_only=False).tolist()))
            yield _with(batch, to, pa.array(out, pa.string()))

    schema = T.StructType([*tokens.schema.fields, T.StructField(to, T.StringType())])
    return tokens.mapInArrow(run, schema)


def coded(docs: DataFrame, path: str, text_col: str = "text", ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """``docs`` with the columns that ``encode`` and ``decode`` add, in one pass: one Python worker a task holds the token
    list and the known pieces, not two, and the ids need not be sent back."""
    docs = docs.drop(ids, to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, machine = _transducer(path), TextMachine(loaded(path).bytes_of)
        for batch in batches:
            texts, start, ends, flat, back = batch.column(batch.schema.get_field_index(text_col)), 0, [0], [], []
            for at in range(batch.num_rows):
                own = work.encode(texts[at].as_py())
                flat.extend(own)
                back.append(machine.text(own))
                ends.append(len(flat))
                if len(flat) >= YIELD_TOKENS or at == batch.num_rows - 1:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
                    yield _with(_with(batch.slice(start, at + 1 - start), ids, lists), to, pa.array(back, pa.string()))
                    start, ends, flat, back = at + 1, [0], [], []

    more = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(to, T.StringType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: token count, digest of its ids and digest of the text that the ids decode to."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return coded(rows, path, "_text", "_ids", "_decoded").select(
        id_col,
        F.size("_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("_decoded"), 256).alias("decoded_sha256"),
    )
