"""Main text of pages: hand-made pages, pages without marked content, odd rows."""

import itertools
import random
import time

import pytest
from odd_rows import prose
from placeloom.llm import html_region
from placeloom.llm.html_region import Page, best_run
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("_html", T.StringType())])

CASES = [
    ("<article><h1>T</h1><p>one <b>two</b></p><p>three</p></article>", "T\none two\nthree"),
    ("<header><h1>Site</h1></header><article><header><h1>T</h1></header><p>a b c</p></article><footer>f</footer>", "T\na b c"),
    ("<main><p>a&amp;b &lt;x&gt; &#65;&#x42; caf&eacute; &copy 1</p></main>", "a&b <x> AB café © 1"),
    ("<article><p>one<p>two<br>more\n\t here<ul><li>x<li>y</ul></article>", "one\ntwo more here\nx\ny"),
    ("<article><p>a</p><div class='ad'>buy buy buy</div><aside>side</aside><p>b</p><form>name <input></form></article>", "a\nb"),
    ("<article><p>text</p><section id='comments'><p>first!</p><article class='comment'><p>me too</p></article></section></article>", "text"),
    ("<div class='cookie-notice'>we use many cookies on this site today</div><article><p>short</p></article>", "short"),
    ("<article><p>a</p><script>if (a < b) document.write('<p>no</p>')</script><style>p{}</style><!-- <p>no</p> --><p>b</p></article>", "a\nb"),
    ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1\n2\n3"),
    ("<article class='post has-sidebar'><div class='article-body'><p>kept</p></div><div class='postFooter'>gone</div></article>", "kept"),
    ("<article><p hidden>no</p><p style='display: none'>no</p><p title='the hidden one'>yes</p></article>", "yes"),
    ("<article><p>un<a href='x>y'>clo</a>sed <b>tags", "unclosed tags"),
    ("<article><p>2 < 3 and 3 > 2</p></article>", "2 < 3 and 3 > 2"),
    ("<article><p a='b>c\">odd</p><p>quote</p></article>", 'c">odd\nquote'),
    ("<nav><a>x</a></nav>", ""), ("", ""), ("<article></article>", ""), ("plain words only", "plain words only"),
    ("<article><div>outer <div>inner</div> tail</div></article>", "outer\ninner\ntail"),
    ("<article><p>a&nbsp;b&#32;&#10;c</p></article>", "a b c"),
    ("<nav><ul><li><nav>x</nav>y</ul></nav><article><p>z</p></article>", "z"),
    ("<article><p>one</p></article><div class='related'><p>other story</p></div><article><p>two two</p></article>", "one\ntwo two"),
]


@pytest.mark.parametrize("html, text", CASES)
def test_hand_made(html, text):
    assert Page(html).text({}, 0.1) == text


def test_best_run_against_all_runs():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([1, 2, -1, -2, 0, 3, -4]) for _ in range(rng.randint(0, 9))]
        sums = {(i, j): sum(scores[i:j + 1]) for i, j in itertools.combinations_with_replacement(range(len(scores)), 2)}
        top = max(sums.values(), default=0)
        found = best_run(scores)
        assert (found is None) == (top <= 0)
        if found:
            assert sums[found] == top


def wrapped(rng, paragraphs, marked):
    links = "".join(f"<li><a href='/{i}'>{prose(rng, 2)}</a></li>" for i in range(12))
    teasers = "".join(f"<div><a href='/t{i}'>{prose(rng, 3)}</a></div>" for i in range(6))
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    body = f"<article>{body}</article>" if marked else f"<div>{body}</div>"
    return f"<html><head><title>x</title></head><body><ul>{links}</ul>{body}<div>{teasers}</div><ul>{links}</ul></body></html>"


def test_weights_of_marked_pages_find_unmarked_content(spark):
    """Held-out accuracy: pages that do not mark their content, with lists and teasers that no name gives away."""
    rng = random.Random(2)
    rows, expected = [], {}
    for i in range(120):
        paragraphs = [" ".join(prose(rng, rng.randint(8, 60)).split()) for _ in range(rng.randint(2, 6))]
        rows.append((i, "u", wrapped(rng, paragraphs, i % 2 == 0), "t", "h"))
        expected[i] = "\n".join(paragraphs)
    found = html_region.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.text == expected[r.page_id] for r in found if r.page_id % 2 == 0)
    assert sum(r.text == expected[r.page_id] for r in found if r.page_id % 2) >= 58


def test_odd_rows(spark):
    rows = [(1, None, None, "t", "h"), (1, "u", "", "t", "h"), (None, "u", CASES[0][0], "t", "h"), (2, "u", CASES[0][0], None, "h"),
            (3, "u", "<article>" + "<b>" * 20000 + "<p>word</p>" * 20000, "t", "h"), (4, "u", "\x00\x1f", "t", "h")] * 2
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = html_region.extract(df)
    assert sorted(found.columns) == ["_html", "page_id", "text", "url"]
    texts = sorted(((r.page_id or 0, r.text) for r in found.collect()))
    assert texts == sorted([(1, ""), (1, ""), (0, CASES[0][1]), (2, CASES[0][1]), (3, "\n".join(["word"] * 20000)), (4, "\x00")] * 2)
    assert html_region.extract(df.limit(0)).count() == 0


def test_hostile_markup_is_read_in_linear_time():
    for html in ("<a " * 200000, "<a '" * 100000, "<article>" + "</p>" * 200000, "<div>" * 100000 + "x", "<p><ul>" * 50000, "&" * 10**6, "<!--" * 10**5):
        start = time.time()
        Page(html).text({}, 0.1)
        assert time.time() - start < 8
