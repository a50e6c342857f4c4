"""Markup extraction, categories and term tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeloom.functions import geo, markup, text
from placeloom.operators import articles as art
from placeloom.operators import terms
from placeloom.operators.ordering import top
from placeloom.plans import inputs
from placeloom.plans.inputs import IN_COUNTY, PAGE_FACTS
from placeloom.plans.registry import query, table
from placeloom.plans.spatial import TERMS, VOCAB

# ---- coordinates ------------------------------------------------------------------------------------


@query("article_coordinates", f"SELECT doc_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM ({PAGE_FACTS})")
def article_coordinates(spark, sf_dir):
    pages = inputs.pages(spark, sf_dir)
    at = geo.pin(pages, ["doc_id"], at=markup.article_coord(F.when(markup.has_coord(F.col("text")), F.col("text"))))
    return at.select("doc_id", F.round("at.lat", 6).alias("lat"), F.round("at.lon", 6).alias("lon"))


_USABLE = ("CASE WHEN doc_id % 8 = 7 THEN ('40.' || lpad(CAST((doc_id * 13) % 87 AS VARCHAR), 2, '0'))::DOUBLE ELSE lat END",
           "CASE WHEN doc_id % 8 = 7 THEN ('-79.' || lpad(CAST((doc_id * 17) % 49 + 50 AS VARCHAR), 2, '0'))::DOUBLE ELSE lon END")


@query("first_usable_coordinates", f"""
SELECT doc_id, round({_USABLE[0]}, 6) AS lat, round({_USABLE[1]}, 6) AS lon FROM ({PAGE_FACTS})""")
def first_usable_coordinates(spark, sf_dir):
    at = geo.pin(inputs.pages(spark, sf_dir), ["doc_id"], at=markup.first_usable_coord(F.col("text")))
    return at.select("doc_id", F.round("at.lat", 6).alias("lat"), F.round("at.lon", 6).alias("lon"))


@query("coordinate_forms", """
SELECT o_orderkey, round(CASE o_orderkey % 4 WHEN 0 THEN d + m / 60e0 + s / 3600e0 WHEN 1 THEN -(d + m / 60e0)
   WHEN 2 THEN d ELSE d + 0.25 END, 6) AS lat, round(CASE o_orderkey % 4 WHEN 0 THEN -(d + m / 60e0) WHEN 1 THEN d + s / 60e0
   WHEN 2 THEN -d ELSE -d - 0.5 END, 6) AS lon
FROM (SELECT o_orderkey, o_orderkey % 80 + 1 AS d, o_orderkey % 60 AS m, (o_orderkey * 7) % 60 AS s FROM orders)""")
def coordinate_forms(spark, sf_dir):
    k = F.col("o_orderkey")
    d, m, s = (x.cast("string") for x in (k % 80 + 1, k % 60, (k * 7) % 60))
    body = (
        F.when(k % 4 == 0, F.concat_ws("|", d, m, s, F.lit("N"), d, m, F.lit("0"), F.lit("W"), F.lit("type:city")))
        .when(k % 4 == 1, F.concat_ws("|", d, m, F.lit("s"), d, s, F.lit("E"), F.lit("name=x")))
        .when(k % 4 == 2, F.concat_ws("|", d, F.lit("N"), d, F.lit("W")))
        .otherwise(F.concat_ws("|", F.concat(d, F.lit(".25")), F.concat(F.lit("-"), d, F.lit(".5")), F.lit("scale:9")))
    )
    at = geo.pin(table(spark, sf_dir, "orders"), ["o_orderkey"], at=markup.parse_coord(body))
    return at.select("o_orderkey", F.round("at.lat", 6).alias("lat"), F.round("at.lon", 6).alias("lon"))


@query("number_strings", """
SELECT o_orderkey, o_orderkey % 6 < 3 AS is_number, CASE o_orderkey % 6 WHEN 0 THEN o_orderkey WHEN 1 THEN -(o_orderkey + 0.5)
  WHEN 2 THEN 5 END::DOUBLE AS number FROM orders""")
def number_strings(spark, sf_dir):
    k = F.col("o_orderkey")
    i = k.cast("string")
    raw = (
        F.when(k % 6 == 0, i).when(k % 6 == 1, F.concat(F.lit("-"), i, F.lit(".5"))).when(k % 6 == 2, "5.")
        .when(k % 6 == 3, F.concat(i, F.lit("..1"))).when(k % 6 == 4, "-").otherwise(F.concat(i, F.lit("N"))))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", markup.is_number(raw).alias("is_number"), markup.to_number(raw).alias("number"))


@query("located_articles", f"SELECT doc_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM ({PAGE_FACTS}) WHERE {IN_COUNTY}")
def located_articles(spark, sf_dir):
    found = art.located(inputs.pages(spark, sf_dir))
    return found.select("doc_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("searched_and_matched", f"SELECT count(*) AS searched, count(*) FILTER (WHERE {IN_COUNTY}) AS matched FROM ({PAGE_FACTS})")
def searched_and_matched(spark, sf_dir):
    return art.matched_counts(inputs.pages(spark, sf_dir))


@query("early_stop", f"SELECT least(25, count(*)) AS found FROM ({PAGE_FACTS}) WHERE {IN_COUNTY}")
def early_stop(spark, sf_dir):
    return art.located(inputs.pages(spark, sf_dir)).limit(25).agg(F.count("*").alias("found"))


# ---- fields -----------------------------------------------------------------------------------------


# what the documents' own text becomes as plain text, with what stands around it on its page
_TIDY = ("replace(replace(replace(replace(replace(replace(regexp_replace({}, '''{{2,5}}', '', 'g'), '&quot;', '\"'), '&amp;', '&'), "
         "'&apos;', '\'\''), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' ')")
_PLAIN = (f"regexp_replace({_TIDY.format('body')} || chr(10) || 'Category:' || category || chr(10) || 'the river site', "
          "'^\\s+|\\s+$', '', 'g')")


@query("article_records", f"""
SELECT doc_id, title AS name, round(lat, 6) AS lat, round(lon, 6) AS lon,
  CASE WHEN doc_id % 3 > 0 THEN 'Place ' || doc_id END AS place, CASE WHEN doc_id % 3 > 0 THEN 'Town ' || (doc_id % 5) END AS kind,
  CASE WHEN doc_id % 3 > 0 THEN CAST(doc_id % 9 AS VARCHAR) END AS area, CASE WHEN doc_id % 3 > 0 THEN 3 END AS fields,
  'http://x.org/' || doc_id AS link, 'River ' || (doc_id % 4) AS river, length({_PLAIN}) AS text_length, md5({_PLAIN}) AS digest
FROM ({PAGE_FACTS}) WHERE {IN_COUNTY}""")
def article_records(spark, sf_dir):
    found = art.extract(inputs.pages(spark, sf_dir))
    box = F.col("templates")
    return found.select(
        "doc_id", "name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"),
        F.try_element_at(box, F.lit("name")).alias("place"), F.try_element_at(box, F.lit("kind")).alias("kind"),
        F.try_element_at(box, F.lit("area")).alias("area"), F.map_keys(box).alias("_k"), "ext_links", "wikilinks",
        "text_length", F.md5("text").alias("digest"),
    ).select("doc_id", "name", "lat", "lon", "place", "kind", "area",
             F.when(F.col("_k").isNotNull(), F.size("_k")).alias("fields"),
             F.col("ext_links")[0].alias("link"), F.try_element_at("wikilinks", F.lit(-1)).alias("river"), "text_length", "digest")


@query("link_sets", """
SELECT doc_id, array_to_string(list_sort(list_distinct(['River ' || (doc_id % 4), 'Town ' || (doc_id % 5)])), ';') AS links
FROM documents""")
def link_sets(spark, sf_dir):
    i = F.col("doc_id")
    body = F.concat(F.lit("a [[River "), (i % 4).cast("string"), F.lit("|x]] [[Town "), (i % 5).cast("string"),
                    F.lit("]] [[River "), (i % 4).cast("string"), F.lit("]]"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(markup.link_set(body), ";").alias("links"))


@query("decoded_entities", """
SELECT p_partkey, 'a "' || p_name || '" & <b> ''x'' end' AS text FROM part""")
def decoded_entities(spark, sf_dir):
    page = F.concat(F.lit('<text xml:space="preserve">a &quot;'), "p_name",
                    F.lit("&quot; &amp; &lt;b&gt; &apos;x&apos;&nbsp;end</text>"))
    return table(spark, sf_dir, "part").select("p_partkey", markup.text_element(page).alias("text"))


@query("plain_text", """
SELECT p_partkey, 'History' || chr(10) || p_name || ' label of ' || p_type || ' bold Category:Golf' AS text,
  length('History' || p_name || ' label of ' || p_type || ' bold Category:Golf') + 1 AS text_length FROM part""")
def plain_text(spark, sf_dir):
    source = F.concat(
        F.lit("{{Infobox|a={{b|{{c}}}}}}\n== History ==\n"), "p_name", F.lit("<!-- x --> [[target|label]] of [http://a.b/c "),
        "p_type", F.lit("] '''bold''' [[Category:Golf]]{{end}}\n"))
    plain = geo.pin(table(spark, sf_dir, "part"), ["p_partkey"], text=markup.plain_text(source))
    return plain.withColumn("text_length", F.length("text"))


@query("markup_counts", """
SELECT p_partkey, 2 AS wikilinks, 1 AS external_links, 3 AS templates, 1 AS arguments, 1 AS comments FROM part""")
def markup_counts(spark, sf_dir):
    source = F.concat(F.lit("{{a|{{b}}}} [[x]] [[y|z]] {{{arg}}} {{c|"), "p_name", F.lit("}} <!-- n --> https://q.org/1 "))
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(F.array(markup.item_counts(source))))


@query("infobox_detection", "SELECT doc_id, doc_id % 3 > 0 AS has_infobox FROM documents")
def infobox_detection(spark, sf_dir):
    return inputs.pages(spark, sf_dir).select(
        "doc_id", markup.has_template(F.col("text"), "infobox").alias("has_infobox"))


@query("json_lines", """
SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"text":' || to_json(text)::VARCHAR || '}' AS line
FROM documents""")
def json_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.to_json(F.struct("doc_id", "lang", "n_chars", "text")).alias("line"))


# Each page's coordinate and box inside 0 to 20 templates; an unclosed brace before them, a stray one before or after.
_DEPTH = "CAST(doc_id % 21 AS INT)"


def _nested(spark, sf_dir):
    def inside(part):
        return F.concat(F.repeat(F.lit("{{w|x="), F.expr(_DEPTH)), part, F.repeat(F.lit("}}"), F.expr(_DEPTH)))

    k = F.col("doc_id")
    i = k.cast("string")
    tag = F.concat(F.lit("{{coord|40|"), (k % 60).cast("string"), F.lit("|N|79|"), (k % 50).cast("string"), F.lit("|W|n={{a|{{b}}}}}}"))
    box = F.concat(F.lit("{{Infobox town|name=Place "), i, F.lit("|seat={{nowrap|{{x}}}} [[a|Seat "), i, F.lit("]]|none={{y}}}}"))
    before = F.when(k % 3 == 0, "{{never closed ").when(k % 3 == 1, "}} ").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(
        before, F.lit("Start "), inside(tag), F.lit(" middle "), inside(box), F.lit("{{{arg|1}}} end "), "text",
        F.when(k % 3 == 2, " }}").otherwise("")).alias("text"))


@query("nested_coordinates", """
SELECT doc_id, round(40 + (doc_id % 60) / 60e0, 6) AS lat, round(-(79 + (doc_id % 50) / 60e0), 6) AS lon FROM documents""")
def nested_coordinates(spark, sf_dir):
    at = geo.pin(_nested(spark, sf_dir), ["doc_id"], at=markup.article_coord(F.col("text")))
    return at.select("doc_id", F.round("at.lat", 6).alias("lat"), F.round("at.lon", 6).alias("lon"))


@query("nested_boxes", "SELECT doc_id, 'Place ' || doc_id AS name, 'Seat ' || doc_id AS seat, 2 AS fields FROM documents")
def nested_boxes(spark, sf_dir):
    box = geo.pin(_nested(spark, sf_dir), ["doc_id"], box=markup.infobox(F.col("text")))
    return box.select("doc_id", F.try_element_at("box", F.lit("name")).alias("name"), F.try_element_at("box", F.lit("seat")).alias("seat"),
                      F.size("box").alias("fields"))


@query("nested_plain_text", f"""
SELECT doc_id, md5(regexp_replace(CASE doc_id % 3 WHEN 0 THEN '{{{{never closed ' WHEN 1 THEN '}}}} ' ELSE '' END
   || 'Start  middle  end ' || {_TIDY.format("text")} || CASE doc_id % 3 WHEN 2 THEN ' }}}}' ELSE '' END, '^\\s+|\\s+$', '', 'g')) AS digest
FROM documents""")
def nested_plain_text(spark, sf_dir):
    return _nested(spark, sf_dir).select("doc_id", F.md5(markup.plain_text(F.col("text"))).alias("digest"))


# ---- categories -------------------------------------------------------------------------------------


def _linked(spark, sf_dir):
    """Articles with three category links each."""
    k = F.col("article_id")
    link = F.concat(F.lit("Category:"), F.element_at(
        F.array(*map(F.lit, inputs.CATEGORY_LINKS)), (k % 6 + 1).cast("int")))
    other = F.concat(F.lit("Category:Tourist Attractions in "), "lang")
    return inputs.articles(spark, sf_dir).select(
        "article_id", "lat", "lon", F.array(link, F.lit("Park Avenue"), F.when(k % 4 == 0, other)).alias("l")
    ).select("article_id", "lat", "lon", F.array_compact("l").alias("wikilinks"))


_LINKED = (f"SELECT doc_id AS article_id, unnest(list_filter(['Category:' || ([{inputs._LINK_LIST}])[(doc_id % 6 + 1)::INT], "
           "CASE WHEN doc_id % 4 = 0 THEN 'Category:Tourist Attractions in ' || lang END], lambda x: x IS NOT NULL)) AS link FROM documents")
_PARTS = ", ".join(f"('{p}')" for p in dict.fromkeys(art.CATEGORY_PARTS))


@query("category_points", f"""
SELECT DISTINCT part AS category, article_id FROM ({_LINKED}), (VALUES {_PARTS}) c(part) WHERE contains(lower(link), part)""")
def category_points(spark, sf_dir):
    return art.category_points(_linked(spark, sf_dir)).select("category", "article_id")


@query("category_points_compat", f"""
SELECT part AS category, count(DISTINCT article_id) * CASE WHEN part = 'tourist attraction' THEN 2 ELSE 1 END AS points
FROM ({_LINKED}), (VALUES {_PARTS}) c(part) WHERE contains(lower(link), part) GROUP BY part""")
def category_points_compat(spark, sf_dir):
    return art.category_points(_linked(spark, sf_dir), compat=True).groupBy("category").agg(F.count("*").alias("points"))


@query("exact_category", f"SELECT article_id FROM ({_LINKED}) WHERE link = 'Category:Airports in Pennsylvania'")
def exact_category(spark, sf_dir):
    return art.in_category(_linked(spark, sf_dir), "Category:Airports in Pennsylvania").select("article_id")


@query("category_link_frequency", f"SELECT link, count(*) AS count FROM ({_LINKED}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 150")
def category_link_frequency(spark, sf_dir):
    return art.category_frequency(_linked(spark, sf_dir), 150)


@query("infobox_field_frequency", """
SELECT * FROM (SELECT 'name' AS field, count(*) FILTER (WHERE doc_id % 3 > 0) AS count FROM documents
UNION ALL SELECT 'kind', count(*) FILTER (WHERE doc_id % 3 = 1) FROM documents
UNION ALL SELECT 'area', count(*) FILTER (WHERE doc_id % 6 = 2) FROM documents)""")
def infobox_field_frequency(spark, sf_dir):
    k = F.col("doc_id")
    boxed = F.concat(
        F.lit("{{infobox x|name="), k.cast("string"), F.when(k % 3 == 1, F.lit("|kind=[[a|b]]")).otherwise("|kind="),
        F.when(k % 6 == 2, F.lit("|area=5")).otherwise(""), F.lit("}}"))
    templates = F.when(k % 3 > 0, markup.infobox(boxed))
    return art.key_frequency(table(spark, sf_dir, "documents").select(templates.alias("templates")), 10)


@query("category_link_test", f"""
SELECT article_id, bool_or(contains(lower(link), 'river')) AS has_river FROM ({_LINKED}) GROUP BY 1""")
def category_link_test(spark, sf_dir):
    links = markup.category_links(F.col("wikilinks"))
    return _linked(spark, sf_dir).select(
        "article_id", F.exists(links, lambda c: F.contains(F.lower(c), F.lit("river"))).alias("has_river"))


# ---- terms ------------------------------------------------------------------------------------------


def _terms(spark, sf_dir):
    return terms.term_counts(inputs.articles(spark, sf_dir))


def _words(spark, sf_dir):
    return terms.frequent_terms(inputs.articles(spark, sf_dir), table(spark, sf_dir, "documents").count())


@query("category_prefix", """
SELECT doc_id, regexp_replace('[[Category:' || lang || ', x]] category:a1 ' || source, '([cC]ategory:)([a-zA-z]+)', '\\1 \\2', 'g') AS text
FROM documents""")
def category_prefix(spark, sf_dir):
    raw = F.concat(F.lit("[[Category:"), "lang", F.lit(", x]] category:a1 "), "source")
    return table(spark, sf_dir, "documents").select("doc_id", text.split_category_prefix(raw).alias("text"))


@query("tokens", """
SELECT doc_id, len(w) AS words, md5(array_to_string(w, ' ')) AS digest
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{3,}') AS w FROM documents)""")
def tokens(spark, sf_dir):
    words = geo.pin(table(spark, sf_dir, "documents"), ["doc_id"], w=text.tokens(F.col("text")))
    return words.select("doc_id", F.size("w").cast("long").alias("words"), F.md5(F.array_join("w", " ")).alias("digest"))


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in text.STOP_WORDS)
_FILTERED = (f"SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z]{{3,}}'), lambda x: NOT list_contains([{_STOP}], x)) "
             "AS w FROM documents")


@query("stop_words", f"SELECT doc_id, len(w) AS words, md5(array_to_string(w, ' ')) AS digest FROM ({_FILTERED})")
def stop_words(spark, sf_dir):
    kept = text.without_stop_words(text.tokens(F.col("text")))
    words = geo.pin(table(spark, sf_dir, "documents"), ["doc_id"], w=kept)
    return words.select("doc_id", F.size("w").cast("long").alias("words"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("bigrams", f"""
SELECT doc_id, len(g) AS grams, md5(array_to_string(g, ',')) AS digest FROM
 (SELECT doc_id, list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS g FROM ({_FILTERED}))""")
def bigrams(spark, sf_dir):
    kept = geo.pin(table(spark, sf_dir, "documents"), ["doc_id"], w=text.without_stop_words(text.tokens(F.col("text"))))
    words = geo.pin(kept, ["doc_id"], g=text.with_bigrams(F.col("w")))
    return words.select("doc_id", F.size("g").cast("long").alias("grams"), F.md5(F.array_join("g", ",")).alias("digest"))


@query("simple_tokens", """
SELECT doc_id, len(w) AS words, md5(array_to_string(w, ' ')) AS digest FROM
 (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '\\p{L}+'), lambda x: length(x) BETWEEN 2 AND 15) AS w FROM documents)""")
def simple_tokens(spark, sf_dir):
    words = geo.pin(table(spark, sf_dir, "documents"), ["doc_id"], w=text.simple_tokens(F.col("text")))
    return words.select("doc_id", F.size("w").cast("long").alias("words"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("term_counts", f"""
SELECT article_id, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS words, max(tf) AS most FROM ({TERMS}) GROUP BY 1""")
def term_counts(spark, sf_dir):
    return _terms(spark, sf_dir).groupBy("article_id").agg(
        F.count("*").alias("terms"), F.sum("tf").alias("words"), F.max("tf").alias("most"))


@query("article_terms", f"SELECT term, tf FROM ({TERMS}) WHERE article_id = 3")
def article_terms(spark, sf_dir):
    return _terms(spark, sf_dir).filter("article_id = 3").select("term", "tf")


_WITH_VOCAB = f"WITH terms AS ({TERMS}), vocab AS ({VOCAB})"


@query("vocabulary", f"{_WITH_VOCAB} SELECT term, df, total, round(idf, 6) AS idf FROM vocab")
def vocabulary(spark, sf_dir):
    words = _words(spark, sf_dir)
    return words.select("term", "df", "total", F.round("idf", 6).alias("idf"))


@query("top_terms", f"{_WITH_VOCAB} SELECT term, total FROM vocab ORDER BY total DESC, term LIMIT 100")
def top_terms(spark, sf_dir):
    words = _words(spark, sf_dir)
    return top(words.select("term", "total"), "total", 100, "term")


@query("ordered_vocabulary", f"{_WITH_VOCAB} SELECT row_number() OVER (ORDER BY term) - 1 AS position, term FROM vocab")
def ordered_vocabulary(spark, sf_dir):
    words = _words(spark, sf_dir)
    return terms.ordered_vocabulary(words).select("position", "term")


@query("article_importance", f"""
{_WITH_VOCAB} SELECT article_id, round(sum(tf * length(term) / df::DOUBLE), 6) AS article_importance
FROM terms JOIN vocab USING (term) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def article_importance(spark, sf_dir):
    words = _words(spark, sf_dir)
    counts = terms.term_counts(inputs.articles(spark, sf_dir), among=words)
    importance = words.select("term", (F.length("term") / F.col("df")).alias("importance"))
    scored = terms.article_importance(counts, importance)
    rounded = scored.select("article_id", F.round("article_importance", 6).alias("article_importance"))
    return top(rounded, "article_importance", 20, "article_id")
