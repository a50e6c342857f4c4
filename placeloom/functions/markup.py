"""Fields of article markup as column expressions: coordinates, infobox, links, plain text.

Braces are paired by one scan (``spans``), which hands back the parts that hold a field; the fields themselves are cut
from these parts by expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeloom.functions.spans import box_and_rest_of, coordinate_tags_of

# Entities and what they stand for, in the order they are replaced.
ENTITIES = [("&quot;", '"'), ("&amp;", "&"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")]


def decode_entities(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def text_element(page: Column) -> Column:
    """Body of the ``<text xml:space="preserve">`` element, entities decoded."""
    return decode_entities(F.regexp_extract(page, r'(?s)<text xml:space="preserve">(.*?)</text>', 1))


# ---- coordinates ------------------------------------------------------------------------------------

_NUMBER = r"(?![.\-]\|)(?![0-9.\-]*(?:\.\.|--))[0-9.\-]+"
_SKIP = rf"(?:(?!{_NUMBER}\|)[^|]*\|)*+"
_NOT_A_NAME = r"(?!(?i:name|scale|source))"
_HALF = (
    rf"({_NUMBER})\|(?:([NSEWnsew])"
    rf"|({_NUMBER})\|(?:{_NOT_A_NAME}([NSEWnsew])|({_NUMBER})\|{_NOT_A_NAME}([^|])))"
)
_DIRECTED = rf"^{_SKIP}{_HALF}[^|]?+\|?{_SKIP}{_HALF}.*$"
_PLAIN = (
    rf"^{_SKIP}({_NUMBER})\|({_NUMBER})"
    rf"(?:$|\|(?:$|(?i:name|scale|source)|(?![NSEWnsew0-9.\-])|{_NUMBER}\|(?i:name|scale|source))).*$"
)


def is_number(text: Column) -> Column:
    """Digits, points and minus signs only; not a lone sign or point, nor two in a row."""
    return text.rlike(r"^(?![.\-]$)(?!.*(?:\.\.|--))[0-9.\-]+$")


def to_number(text: Column) -> Column:
    return F.when(is_number(text), text.try_cast("double"))


def coord_body(tag_text: Column) -> Column:
    """Body of a coordinate tag without blanks, with runs of pipes collapsed."""
    body = F.translate(tag_text, "\n \t", "")
    return F.replace(F.replace(body, F.lit("|||"), F.lit("|")), F.lit("||"), F.lit("|"))


def parse_coord(body: Column) -> Column:
    """``struct(lat, lon)`` of a cleaned tag body, NULL when it holds no coordinate.

    Forms: degrees, degrees-minutes, degrees-minutes-seconds (each with a direction letter), and a plain
    pair of decimals. S and W negate. Each pattern is matched once: its captures come back joined, are
    split, and are bound as lambda variables, so that no use of them repeats the match.
    """
    captures = F.transform(F.array(body), lambda b: F.struct(
        F.split(F.regexp_replace(b, _DIRECTED, "!$1!$2!$3!$4!$5!$6!$7!$8!$9!$10!$11!$12"), "!", -1).alias("d"),
        F.split(F.regexp_replace(b, _PLAIN, "!$1!$2"), "!", -1).alias("p")))
    return F.transform(captures, _coord_of)[0]


def _coord_of(found: Column) -> Column:
    d, p = found["d"], found["p"]

    def number(i: int) -> Column:
        return F.coalesce(d[i].try_cast("double"), F.lit(0.0))

    def degrees(at: int, negative: str) -> Column:
        letter = F.upper(F.concat(d[at + 1], d[at + 3], d[at + 5]))
        value = d[at].try_cast("double") + number(at + 2) / 60 + number(at + 4) / 3600
        return value * F.when(letter == negative, -1).otherwise(1)

    directed = F.struct(degrees(1, "S").alias("lat"), degrees(7, "W").alias("lon"))
    plain = F.struct(p[1].try_cast("double").alias("lat"), p[2].try_cast("double").alias("lon"))
    pair = F.when(F.size(d) == 13, directed).when(F.size(p) == 3, plain)
    return F.when(pair["lat"].isNotNull() & pair["lon"].isNotNull(), pair)


def first_usable_coord(article: Column) -> Column:
    """Coordinate of the first tag that can be read."""
    bodies = coordinate_tags_of(article)["bodies"]
    found = F.filter(F.transform(bodies, lambda b: parse_coord(coord_body(b))), lambda c: c.isNotNull())
    return F.try_element_at(found, F.lit(1))


def has_coord(article: Column) -> Column:
    """Cheap test to run before any parsing."""
    return article.rlike(r"(?i)\{\{\s*coord\s*[|}]")


def article_coord(article: Column) -> Column:
    """Coordinate of the first coordinate template; a tag with a blank before the pipe cannot be read."""
    return parse_coord(coord_body(coordinate_tags_of(article)["first"]))


# ---- links ------------------------------------------------------------------------------------------


def wikilinks(article: Column) -> Column:
    """Target of every internal link, in order."""
    links = F.regexp_extract_all(article, F.lit(r"\[\[([^\[\]|]*+)(?:\|[^\[\]]*+)?\]\]"), F.lit(1))
    return F.transform(links, lambda link: F.trim(link))


def link_set(article: Column) -> Column:
    """Distinct link targets, sorted; a link ends at ``]`` or a pipe."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(article, F.lit(r"\[\[([^\]|]*)"), F.lit(1))))


def external_links(article: Column) -> Column:
    return F.regexp_extract_all(article, F.lit(r"""https?://[^\s\[\]|{}<>"]+"""), F.lit(0))


def category_links(links: Column) -> Column:
    return F.filter(links, lambda link: F.contains(link, F.lit("Category:")))


# ---- templates and plain text -----------------------------------------------------------------------


def has_template(article: Column, name_part: str) -> Column:
    return article.rlike(rf"(?is)\{{\{{[^|{{}}]*{name_part}[^|{{}}]*[|}}]")


def template_count(article: Column) -> Column:
    return F.size(F.regexp_extract_all(article, F.lit(r"(?<!\{)(?:\{\{)+(?!\{)"), F.lit(0)))


def _labels(text: Column) -> Column:
    """Links replaced by their label, or their target."""
    text = F.regexp_replace(text, r"\[\[(?:[^\[\]|]*+\|)?([^\[\]|]*+)\]\]", "$1")
    text = F.regexp_replace(text, r"\[https?://[^\s\]]+\]", "")
    return F.regexp_replace(text, r"\[https?://[^\s\]]+\s+([^\]]*)\]", "$1")


def parts(article: Column) -> Column:
    """``struct(box, rest)`` for ``plain_part`` and ``box_part``; hold it where both are wanted, so that it is cut once."""
    return box_and_rest_of(article)


def plain_text(article: Column) -> Column:
    """Text without templates, comments, tags and quote marks; links and headings keep their label."""
    return plain_part(parts(article))


def plain_part(found: Column) -> Column:
    text = _labels(found["rest"])
    text = F.regexp_replace(text, r"<[^<>]*>", "")
    text = F.regexp_replace(text, r"'{2,5}", "")
    text = F.regexp_replace(text, r"(?m)^=+\s*(.*?)\s*=+\s*$", "$1")
    return F.regexp_replace(decode_entities(text), r"^\s+|\s+$", "")


def infobox(article: Column) -> Column:
    """``map(name, value)`` of the first infobox, values as plain text, empty ones left out; NULL if none."""
    return box_part(parts(article))


def box_part(found: Column) -> Column:
    fields = F.transform(F.split(_labels(found["box"]), r"\|"), lambda f: F.split(f, "=", 2))
    named = F.transform(
        F.filter(fields, lambda f: F.size(f) == 2), lambda f: F.struct(_strip(f[0]).alias("k"), _strip(f[1]).alias("v")))
    full = F.filter(named, lambda f: f["v"] != "")
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(full, empty, lambda seen, f: F.map_concat(
        F.map_filter(seen, lambda k, v: k != f["k"]), F.create_map(f["k"], f["v"])))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def item_counts(article: Column) -> Column:
    """``struct`` of the number of links, external links, templates, template arguments and comments."""
    def count(pattern: str) -> Column:
        return F.size(F.regexp_extract_all(article, F.lit(pattern), F.lit(0)))

    return F.struct(
        F.size(wikilinks(article)).alias("wikilinks"), F.size(external_links(article)).alias("external_links"),
        template_count(article).alias("templates"), count(r"\{\{\{[^{}]*\}\}\}").alias("arguments"),
        count(r"(?s)<!--.*?-->").alias("comments"))
