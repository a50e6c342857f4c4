"""Templates of an article by one scan that pairs its braces.

Runs of braces are kept on a stack: a closing run is matched with the innermost open run, three braces with three
(an argument), otherwise two with two (a template). Braces without a partner are text, wherever they stand, so
neither depth nor a stray brace elsewhere matters. Comments and ``nowiki`` parts hold no braces.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

# Executors get the scan by value and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

AT_ONCE = 128  # articles held as Python strings

_MARKS = re.compile(r"<!--|<[nN][oO][wW][iI][kK][iI]>|\{{2,}|\}{2,}")
_ENDS = {"<!--": re.compile("-->"), "<nowiki>": re.compile("</nowiki>", re.I)}
_COORD = re.compile(r"\s*coord\s*(?=\||\}\})", re.I)
# a name is read up to its first pipe or brace, so no part of the text is read for two templates
_BOX = re.compile(r"[^|{}]*?infobox", re.I)


class Span(NamedTuple):
    start: int
    end: int
    braces: int  # 2: template, 3: argument


def paired(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Spans of templates and arguments in the order they open, and (start, end) of comments."""
    spans, comments, open_, missing = [], [], [], set()
    at = 0
    while match := _MARKS.search(text, at):
        at = match.end()
        mark = match[0]
        if mark[0] == "{":
            open_.append([match.start(), len(mark)])
        elif mark[0] == "}":
            here, left = match.start(), len(mark)
            while left >= 2 and open_:
                start, width = open_[-1]
                size = 3 if left >= 3 and width >= 3 else 2
                here, left = here + size, left - size
                spans.append(Span(start + width - size, here, size))
                if width - size < 2:
                    open_.pop()
                else:
                    open_[-1][1] = width - size
        elif (kind := mark.lower()) not in missing:
            # an opening without its end is text; the end is looked for only once
            end = _ENDS[kind].search(text, at)
            if not end:
                missing.add(kind)
                continue
            at = end.end()
            if kind == "<!--":
                comments.append((match.start(), at))
    spans.sort()
    return spans, comments


def without(text: str, cuts: list[tuple[int, int]], start: int, end: int) -> str:
    """``text[start:end]`` without the parts ``cuts`` that begin in it (sorted; they may nest)."""
    parts, at = [], start
    for i in range(bisect_left(cuts, (start, 0)), len(cuts)):
        a, b = cuts[i]
        if a >= end:
            break
        if a >= at:
            parts.append(text[at:a])
        at = max(at, b)
    parts.append(text[at:end])
    return "".join(parts)


def coordinate_tags(text: str) -> tuple[str | None, list[str]]:
    """Body of the first template named ``coord`` (empty where its name rules out reading it), and bodies of all
    readable tags."""
    first, bodies = None, []
    for start, end, braces in paired(text)[0]:
        if braces == 2 and (name := _COORD.match(text, start + 2)):
            tag = name[0] in ("coord", "Coord") and name.end() < end - 2
            if tag:
                bodies.append(text[name.end() + 1:end - 2])
            if first is None:
                first = bodies[-1] if tag else ""
    return first, bodies


def box_and_rest(text: str) -> tuple[str | None, str]:
    """Parameters of the first infobox, without the templates and comments inside, and the article without
    templates, arguments and comments."""
    spans, comments = paired(text)
    cuts = sorted([span[:2] for span in spans] + comments)
    box = next((span for span in spans if span.braces == 2 and _BOX.match(text, span.start + 2)), None)
    if box is None:
        return None, without(text, cuts, 0, len(text))
    _, _, body = without(text, cuts, box.start + 2, box.end - 2).partition("|")
    return body, without(text, cuts, 0, len(text))


def in_slices(articles: pa.Array, cut: Callable[[str], tuple], names: list[str], types: list[pa.DataType]) -> pa.Array:
    """``cut`` of every article as a struct; only ``AT_ONCE`` articles and their parts are held as Python objects."""
    done = []
    for at in range(0, max(1, len(articles)), AT_ONCE):
        found = [(None,) * len(names) if a is None else cut(a) for a in articles.slice(at, AT_ONCE).to_pylist()]
        done.append(pa.StructArray.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(types)], names))
    return pa.concat_arrays(done)


@arrow_udf(T.StructType([T.StructField("first", T.StringType()), T.StructField("bodies", T.ArrayType(T.StringType()))]))
def coordinate_tags_of(articles: pa.Array) -> pa.Array:
    return in_slices(articles, coordinate_tags, ["first", "bodies"], [pa.string(), pa.list_(pa.string())])


@arrow_udf(T.StructType([T.StructField("box", T.StringType()), T.StructField("rest", T.StringType())]))
def box_and_rest_of(articles: pa.Array) -> pa.Array:
    return in_slices(articles, box_and_rest, ["box", "rest"], [pa.string(), pa.string()])
