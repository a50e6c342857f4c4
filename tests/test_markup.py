import random
import time

import pytest
from pyspark.sql import functions as F

from placeloom.functions import geo, markup, spans, text
from placeloom.operators import articles

CASES = [
    ("{{coord|40.44|-79.99}}", (40.44, -79.99)),
    ("{{coord|40.44|-79.99|}}", (40.44, -79.99)),
    ("{{coord|40.44|-79.99|display=inline}}", (40.44, -79.99)),
    ("{{Coord|40|N|80|W}}", (40.0, -80.0)),
    ("{{coord|40|26|N|79|59|W}}", (40 + 26 / 60, -(79 + 59 / 60))),
    ("{{coord|40|26|46|N|79|58|56|W|region:US}}", (40 + 26 / 60 + 46 / 3600, -(79 + 58 / 60 + 56 / 3600))),
    ("{{coord|40|26|s|79|59|e}}", (-(40 + 26 / 60), 79 + 59 / 60)),
    ("{{coord||40||26|||N|79|59|W}}", (40 + 26 / 60, -(79 + 59 / 60))),
    ("{{coord|40.1|-80.2|source:x}}", (40.1, -80.2)),
    ("{{coord|40.1|-80.2|scale:5000}}", (40.1, -80.2)),
    ("{{coord|40.1|-80.2|name=North}}", (40.1, -80.2)),
    ("{{coord |40|N|80|W}}", None),
    ("no tag", None),
    ("{{coord|display=title|40|N|80|W}}", (40.0, -80.0)),
    ("{{coord|40\n|26 |N|79|59|W|notes={{ref|{{x}}}}}}", (40 + 26 / 60, -(79 + 59 / 60))),
    ("{{coord|North|40|South}}", None),
    ("{{coord|40|North|80|West}}", (40.0, -80.0)),
    ("{{coord|4..0|N|80|W}}", None),
    ("{{coord|-40.5|N|80|W}}", (-40.5, -80.0)),
]


@pytest.mark.parametrize("source,want", CASES)
def test_coordinate_tags(spark, source, want):
    row = spark.createDataFrame([(source,)], "t string").select(
        markup.article_coord(F.col("t")).alias("a"), markup.first_usable_coord(F.col("t")).alias("f")).first()
    for got in (row["a"], row["f"]):
        if want is None:
            assert got is None
        else:
            assert got["lat"] == pytest.approx(want[0]) and got["lon"] == pytest.approx(want[1])


def test_first_template_only_or_first_usable(spark):
    row = spark.createDataFrame([("{{coord|bad}} x {{coord|1.5|2.5|a}}",)], "t string").select(
        markup.article_coord(F.col("t")).alias("a"), markup.first_usable_coord(F.col("t")).alias("f")).first()
    assert row["a"] is None and tuple(row["f"]) == (1.5, 2.5)


PAGE = """{{Infobox bridge
| name = Old '''Bridge'''
| length = {{convert|5|m}} 50 m
| near = [[Pittsburgh|the city]]
| empty =
| name = New Bridge
}}
'''Bridge''' at {{coord|40|26|N|79|59|W|display=title}} is [[River X|a river]] crossing.<ref>note</ref>
== History ==
Built [http://a.org/b long ago]. See https://c.org/d .
<!-- hidden --> &amp; more
[[Category:Bridges in Pittsburgh]]
[[Category:Historic places|x]]"""


def test_article_record(spark):
    pages = spark.createDataFrame([("Bridge", PAGE), ("Other", "text"), ("Far", "{{coord|10|N|10|E}}")], "title string, text string")
    rows = articles.extract(pages).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r["name"] == "Bridge" and r["lat"] == pytest.approx(40 + 26 / 60)
    assert r["templates"] == {"name": "New Bridge", "length": "50 m", "near": "the city"}
    assert r["wikilinks"] == ["Pittsburgh", "River X", "Category:Bridges in Pittsburgh", "Category:Historic places"]
    assert r["ext_links"] == ["http://a.org/b", "https://c.org/d"]
    assert r["text"].startswith("Bridge at") and "a river crossing" in r["text"]
    assert "History\nBuilt long ago" in r["text"] and "& more" in r["text"] and "hidden" not in r["text"]
    assert "{{" not in r["text"] and "Category:Bridges in Pittsburgh" in r["text"]
    assert r["text_length"] == len(r["text"])


def test_large_article_does_not_overflow(spark):
    body = "{{a|" * 3 + "x " * 200_000 + "}}" * 3 + "{ " * 5000 + "{{coord|40.5|-80.1|k=v}}" + "[[l]] " * 20_000
    pages = spark.createDataFrame([("Big", body)], "title string, text string")
    r = articles.extract(pages).first()
    assert r["lat"] == 40.5 and len(r["wikilinks"]) == 20_000


def test_category_points_dedupe_and_compat(spark):
    df = spark.createDataFrame(
        [(1, 40.0, -80.0, ["Category:Tourist attractions in X", "Park"]), (2, 40.0, -80.0, ["Category:Parks", "Category:City parks"])],
        "article_id long, lat double, lon double, wikilinks array<string>")
    got = sorted((r["category"], r["article_id"]) for r in articles.category_points(df).collect())
    assert got == [("park", 2), ("tourist attraction", 1)]
    assert articles.category_points(df, compat=True).filter("category = 'tourist attraction'").count() == 2


def test_tokens_and_bigrams(spark):
    df = spark.createDataFrame([("The House of an Old-Town 12 [[Category:Washington, x]] ab",)], "t string")
    kept = text.without_stop_words(text.tokens(text.split_category_prefix(F.col("t"))))
    row = geo.pin(df, [], w=kept).select("w", text.with_bigrams(F.col("w")).alias("g")).first()
    assert row["w"] == ["house", "old", "town", "category", "washington"]
    assert row["g"][5:] == ["house old", "old town", "town category", "category washington"]
    empty = spark.createDataFrame([("the",)], "t string")
    assert geo.pin(empty, [], w=text.without_stop_words(text.tokens(F.col("t")))).select(
        text.with_bigrams(F.col("w")).alias("g")).first()["g"] == []


def test_idf(spark):
    row = spark.range(1).select(text.smooth_idf(F.lit(3), F.lit(3)).alias("a"), text.smooth_idf(F.lit(3), F.lit(1)).alias("b")).first()
    assert row["a"] == pytest.approx(1.0) and row["b"] == pytest.approx(1.693147, abs=1e-6)


@pytest.mark.parametrize("depth", range(0, 21))
def test_fields_at_any_depth_with_stray_braces(depth):
    def inside(part):
        return "{{w|x=" * depth + part + "}}" * depth

    for before, after in (("", ""), ("{{open ", ""), ("}} ", ""), ("", " }}"), ("{{{ ", ""), ("<!-- no end {{", "")):
        article = before + inside("{{coord|40|N|80|W|n={{a|{{b}}}}}}") + " t " + inside("{{Infobox x|a={{b|{{c}}}}1|d=[[e|f]]}}") + after
        assert spans.coordinate_tags(article) == ("40|N|80|W|n={{a|{{b}}}}", ["40|N|80|W|n={{a|{{b}}}}"])
        assert spans.box_and_rest(article) == ("a=1|d=[[e|f]]", before + " t " + after)


def test_braces_pair_as_in_the_source():
    """Every span holds as many opening as closing braces; spans nest or lie apart."""
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["{{", "}}", "{{{", "}}}", "{", "}", "a", "|", "infobox", "{{{{"]) for _ in range(rng.randint(0, 25)))
        found, _ = spans.paired(text)
        for one in found:
            assert text[one.start:one.start + one.braces] == "{" * one.braces and text[one.end - one.braces:one.end] == "}" * one.braces
            assert one.start + one.braces <= one.end - one.braces
            for other in found:
                assert one.end <= other.start or other.end <= one.start or one.start <= other.start and other.end <= one.end \
                    or other.start <= one.start and one.end <= other.end


def test_comments_and_nowiki_hold_no_braces():
    text = "<!-- {{ --> <nowiki>{{</nowiki> {{coord|1|2}} <!-- }} {{coord|3|4}} -->"
    assert spans.coordinate_tags(text)[1] == ["1|2"]
    assert spans.box_and_rest(text)[1] == " <nowiki>{{</nowiki>  "


def test_long_runs_are_read_in_linear_time():
    for text in ("{{" * 200_000, "{{a|" * 100_000 + "}}" * 100_000, "}}{{" * 100_000, "<!--" * 200_000, "{{infobox" * 50_000 + "}}" * 50_000):
        start = time.time()
        spans.coordinate_tags(text)
        spans.box_and_rest(text)
        assert time.time() - start < 6


def test_few_articles_are_held_as_python_strings():
    import tracemalloc

    import pyarrow as pa

    from placeloom.functions import spans

    page = "{{Infobox place|name=N}} {{coord|40.5|-80.25}} " + "words " * 2000
    texts = pa.array([page, None, "", "{{coord |1|2}}"] + [page] * 2000)
    tracemalloc.start()
    found = [getattr(f, "func", f)(texts) for f in (spans.coordinate_tags_of, spans.box_and_rest_of)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8e6  # all strings at once take 24 MB and more
    for column, cut in zip(found, (spans.coordinate_tags, spans.box_and_rest)):
        assert [tuple(row.values()) for row in column[:5].to_pylist()] == [
            (None, None) if t is None else cut(t) for t in texts[:5].to_pylist()]
        assert len(column) == len(texts)


def test_words_of_bytes_equal_the_column_functions(spark):
    texts = [f"ab{chr(c)}cd {chr(c)}the{chr(c)}" for c in range(0x2500)] + [
        "Category:River category:the_x xCategory:[a", "Don't STOP the\u0130x \u212aELVIN \U0001f600abc ref name", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    words = text.without_stop_words(text.tokens(text.split_category_prefix(F.col("t"))))
    for r in df.select("t", words.alias("w")).collect():
        assert text.words_of(r["t"].encode(), text.stop_set()) == r["w"], r
    broken = spark.sql("select cast(unhex('616263ff646566c4616263e28441') as string) t")
    assert text.words_of(bytes.fromhex("616263ff646566c4616263e28441"), text.stop_set()) == broken.select(words).first()[0]
