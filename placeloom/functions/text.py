"""Tokens, n-grams and weights of article text."""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Executors get the word function by value and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The English stop-word list of the NLTK corpus, as words.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him
his himself she she's her hers herself it it's its itself they them their theirs themselves what which who
whom this that that'll these those am is are was were be been being have has had having do does did doing a
an the and but if or because as until while of at by for with about against between into through during
before after above below to from up down in out on off over under again further then once here there when
where why how all any both each few more most other some such no nor not only own same so than too very s t
can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't
doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't
shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# Words added to it. Entries of two words never match, as single tokens are tested.
EXTRA_STOP_WORDS = ["ref", "ref ref", "ref name", "name", "also", "per", "one", "two", "three", "four", "five",
                    "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]

STOP_WORDS = ENGLISH_STOP_WORDS + EXTRA_STOP_WORDS


def split_category_prefix(text: Column) -> Column:
    """Put a blank after ``Category:``, so that the first word behind it becomes a token."""
    return F.regexp_replace(text, r"([cC]ategory:)([a-zA-z]+)", "$1 $2")


def tokens(text: Column) -> Column:
    """Lower-case runs of at least three ASCII letters."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))


def simple_tokens(text: Column, shortest: int = 2, longest: int = 15) -> Column:
    """Lower-case alphabetic tokens within a length range."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    return F.filter(words, lambda w: F.length(w).between(shortest, longest))


def without_stop_words(words: Column, stop: list[str] | None = None) -> Column:
    """Remove stop words and keep repeats; the list is one literal, tested as a hashed set."""
    listed = [w for w in (stop if stop is not None else STOP_WORDS) if " " not in w]
    return F.filter(words, lambda w: ~w.isin(listed))


# What :func:`split_category_prefix`, :func:`tokens` and :func:`without_stop_words` do to a column, for the bytes of one text.

_PREFIX = re.compile(rb"([cC]ategory:)([a-zA-z]+)")
# the only two letters outside ASCII whose lower case has a letter of ASCII
_KELVIN, _DOTTED_I = "\u212a".encode(), "\u0130".encode()
_LETTERS = bytes(c if 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def stop_set(stop: list[str] | None = None) -> frozenset[str]:
    return frozenset(w for w in (stop if stop is not None else STOP_WORDS) if " " not in w)


def words_of(text: bytes, stop: frozenset[str]) -> list[str]:
    """Lower-case runs of at least three ASCII letters that are no stop words, in order."""
    text = bytes(text)
    if b"ategory:" in text:
        text = _PREFIX.sub(rb"\1 \2", text)
    if not text.isascii():
        text = text.replace(_KELVIN, b"k").replace(_DOTTED_I, b"i ")
    return [w for w in text.translate(_LETTERS).decode("ascii").split() if len(w) > 2 and w not in stop]


def with_bigrams(words: Column) -> Column:
    """The words, then each pair of neighbours. ``words`` is used several times: pass a computed column."""
    firsts = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.transform(firsts, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))
    return F.concat(words, pairs)


def smooth_idf(n_docs: Column, df: Column) -> Column:
    """Smoothed inverse document frequency; 1 for a term that every document has."""
    return F.log((1 + n_docs) / (1 + df)) + 1
