"""From page markup to located articles, and from articles to category points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.functions import geo, markup

# Parts of category names that make a point category. One name stands twice.
CATEGORY_PARTS = [
    "historic", "bridge", "river", "tourist attraction", "skyscraper", "park", "universit", "museum",
    "railway station", "shopping mall", "sports venue", "church", "music venue", "librar", "demolished",
    "theatre", "airport", "metropolitan", "unincorporated", "education", "tourist attraction", "high school",
    "public", "defunct", "golf", "transportation",
]


def located(pages: DataFrame, box=geo.COUNTY_BOX, text: str = "text") -> DataFrame:
    """Pages with a readable coordinate inside ``box``, with ``lat`` and ``lon``.

    The cheap test runs first; the coordinate is parsed once per row that passes it.
    """
    tagged = pages.filter(markup.has_coord(F.col(text)))
    at = geo.pin(tagged, tagged.columns, _at=markup.article_coord(F.col(text)))
    south, north, west, east = box
    found = at.filter(geo.inside_box(F.col("_at.lat"), F.col("_at.lon"), south, north, west, east))
    return found.select(*pages.columns, F.col("_at.lat").alias("lat"), F.col("_at.lon").alias("lon"))


def extract(pages: DataFrame, box=geo.COUNTY_BOX, name: str = "title", text: str = "text") -> DataFrame:
    """Article records of the pages inside ``box``; one map-side pass, no shuffle."""
    body = F.col(text)
    found = located(pages, box, text)
    others = [c for c in pages.columns if c not in (name, text)]
    cut = geo.pin(found, [*others, name, text, "lat", "lon"], _parts=markup.parts(body))
    plain = geo.pin(cut, [*others, name, text, "lat", "lon", "_parts"], _plain=markup.plain_part(F.col("_parts")))
    return plain.select(
        *others, F.col(name).alias("name"), "lat", "lon", markup.box_part(F.col("_parts")).alias("templates"),
        F.col("_plain").alias("text"), markup.wikilinks(body).alias("wikilinks"),
        markup.external_links(body).alias("ext_links"), F.length("_plain").alias("text_length"))


def matched_counts(pages: DataFrame, box=geo.COUNTY_BOX, text: str = "text") -> DataFrame:
    """One row: pages read and pages whose coordinate lies inside ``box``."""
    at = markup.article_coord(F.when(markup.has_coord(F.col(text)), F.col(text)))
    seen = geo.pin(pages.select(text), [], _at=at)
    south, north, west, east = box
    return seen.agg(
        F.count("*").alias("searched"),
        F.count_if(geo.inside_box(F.col("_at.lat"), F.col("_at.lon"), south, north, west, east)).alias("matched"))


def category_points(
    articles: DataFrame, parts: list[str] | None = None, key: str = "article_id", compat: bool = False,
) -> DataFrame:
    """``(category, key, lat, lon)``: an article is a point of every part found in one of its category links.

    The parts are a fixed list, so this is a map over each row and needs no join. ``compat`` keeps a part
    that stands twice in the list as two rows.
    """
    parts = parts or CATEGORY_PARTS
    if not compat:
        parts = list(dict.fromkeys(parts))
    # link targets hold no line break, so no match can span two of them
    joined = F.lower(F.array_join(markup.category_links(F.col("wikilinks")), "\n"))
    rows = geo.pin(articles.select(key, "lat", "lon", "wikilinks"), [key, "lat", "lon"], _links=joined)
    hits = F.array_compact(F.array(*[F.when(F.contains("_links", F.lit(p)), F.lit(p)) for p in parts]))
    return rows.select(F.explode(hits).alias("category"), key, "lat", "lon")


def in_category(articles: DataFrame, link: str) -> DataFrame:
    """Articles that carry exactly this category link."""
    return articles.filter(F.array_contains("wikilinks", link))


def key_frequency(articles: DataFrame, k: int = 10) -> DataFrame:
    """Most common infobox fields: ``(field, count)``."""
    counted = articles.select(F.explode(F.map_keys("templates")).alias("field")).groupBy("field").agg(
        F.count("*").alias("count"))
    return counted.orderBy(F.desc("count"), "field").limit(k)


def category_frequency(articles: DataFrame, k: int = 150) -> DataFrame:
    """Most common category links: ``(link, count)``."""
    counted = articles.select(F.explode(markup.category_links(F.col("wikilinks"))).alias("link")).groupBy(
        "link").agg(F.count("*").alias("count"))
    return counted.orderBy(F.desc("count"), "link").limit(k)
