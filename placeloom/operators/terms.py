"""Term tables, document frequencies and distance-weighted text features, all in long form."""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.functions import text
from placeloom.operators import spatial
from placeloom.operators.blocks import COLUMNS_PER_BLOCK, weighted_sums
from placeloom.operators.ordering import numbered
from placeloom.session import write_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_DF = 0.02
TEXT_RADIUS_M = 6500.0
MIN_ARTICLES = 3
# A worker adds up the counts of its articles when it holds this many.
TERMS_AT_ONCE = 1_000_000


def _counting(singles: bool, pairs: bool, words: frozenset[str] | None, stop: list[str] | None):
    """A function that counts the terms in the texts of one article; ``words`` are those whose pairs count, None means all."""
    drop, words_of = text.stop_set(stop), text.words_of

    def count(texts) -> Counter:
        found: Counter = Counter()
        for one in texts:
            own = words_of(one.as_buffer(), drop)
            if singles:
                found.update(own)
            if pairs:
                next_ones = zip(own, own[1:])
                if words is not None:
                    next_ones = (p for p in next_ones if p[0] in words and p[1] in words)
                found.update(map(" ".join, next_ones))
        return found

    return count


def _counter(count, among: frozenset[str] | None):
    """A column function: term counts of an article, given its texts. ``among`` are the terms that count; None means all."""
    @F.arrow_udf("array<struct<term: string, tf: bigint>>")
    def run(articles: pa.Array) -> pa.Array:
        terms, counts, ends = [], [], [0]
        for article in articles:
            found = count(article.values or ())
            kept = found if among is None else {t: n for t, n in found.items() if t in among}
            terms.extend(kept)
            counts.extend(kept.values())
            ends.append(len(terms))
        cells = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int64())], names=["term", "tf"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells)

    return run


def _held(articles: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, _texts)``. The text travels once, before it is unfolded; the counts then stay where they are. An article in
    several rows is counted as one, but no pair crosses rows. Texts go to the workers as bytes, which hold what is no UTF-8, too."""
    held = articles.select(key, F.col(column).cast("binary").alias(column)).repartition(key)
    return held.groupBy(key).agg(F.collect_list(column).alias("_texts"))


def _counted(articles: DataFrame, key: str, column: str, count, among: frozenset[str] | None = None) -> DataFrame:
    """``(key, term, tf)``."""
    return _held(articles, key, column).select(key, _counter(count, among)("_texts").alias("_terms")).select(key, F.inline("_terms"))


def _found_in(articles: DataFrame, key: str, column: str, count) -> DataFrame:
    """``(term, df, total)`` like :func:`document_frequency`, of counts that are added up before they leave a worker."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(terms: list[str], counts: list[int]) -> Iterator[pa.RecordBatch]:
            found = pa.table({"term": pa.array(terms, pa.string()), "tf": pa.array(counts, pa.int64())})
            added = found.group_by("term", use_threads=False).aggregate([("tf", "count"), ("tf", "sum")])
            yield from added.select(["term", "tf_count", "tf_sum"]).rename_columns(["term", "df", "total"]).to_batches()

        terms, counts = [], []
        for batch in batches:
            for article in batch.column(0):
                found = count(article.values or ())
                terms.extend(found)
                counts.extend(found.values())
                if len(terms) > TERMS_AT_ONCE:
                    yield from rows(terms, counts)
                    terms, counts = [], []
        if terms:
            yield from rows(terms, counts)

    parts = _held(articles, key, column).select("_texts").mapInArrow(run, "term string, df bigint, total bigint")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def term_counts(
    articles: DataFrame, key: str = "article_id", column: str = "text", stop: list[str] | None = None,
    bigrams: bool = True, among: DataFrame | None = None,
) -> DataFrame:
    """``(key, term, tf)``: words and, on what stop words leave, pairs of neighbours.

    An article's terms are counted in its own row, so no task holds more than one article's terms at a time. ``among`` is
    a vocabulary (:func:`frequent_terms`): only its terms are counted. It is as small as its document-frequency cut.
    """
    only = None if among is None else frozenset(r["term"] for r in among.select("term").collect())
    # a pair of neighbours in the vocabulary has both its words in some pair there
    near = None if only is None else frozenset(chain.from_iterable(t.split(" ") for t in only if " " in t))
    return _counted(articles, key, column, _counting(True, bigrams, near, stop), only)


def frequent_terms(
    articles: DataFrame, n_docs: int, min_df: float = MIN_DF, key: str = "article_id", column: str = "text",
    stop: list[str] | None = None,
) -> DataFrame:
    """The :func:`vocabulary` of words and pairs, without a table of all pairs.

    A pair is in at least ``least`` documents only where both its words are, so pairs are counted between frequent words
    only. There are at most as many of those as an average document's words over ``min_df``.
    """
    least = _least(n_docs, min_df)
    if least <= 1:
        return vocabulary(term_counts(articles, key, column, stop), n_docs, min_df)
    singles = write_once(
        _frequent(_found_in(articles, key, column, _counting(True, False, None, stop)), n_docs, min_df), "words")
    frequent = frozenset(r["term"] for r in singles.select("term").collect())
    pairs = _frequent(_found_in(articles, key, column, _counting(False, True, frequent, stop)), n_docs, min_df)
    return write_once(singles.unionByName(pairs), "vocabulary")


def document_frequency(terms: DataFrame) -> DataFrame:
    """``(term, df, total)``. A term table has one row per article and term, so a plain count is the df."""
    return terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


def _least(n_docs: int, min_df: float) -> int:
    return math.ceil(round(min_df * n_docs, 9))


def vocabulary(terms: DataFrame, n_docs: int, min_df: float = MIN_DF) -> DataFrame:
    """``(term, df, total, idf)`` of the terms found in at least ``min_df`` of the documents.

    The number of terms is bounded by text length over ``min_df``, not by the number of documents.
    """
    return _frequent(document_frequency(terms), n_docs, min_df)


def _frequent(counted: DataFrame, n_docs: int, min_df: float) -> DataFrame:
    kept = counted.filter(F.col("df") >= _least(n_docs, min_df))
    return kept.withColumn("idf", text.smooth_idf(F.lit(n_docs), F.col("df")))


def place_vectors(
    articles: DataFrame, terms: DataFrame, positions: DataFrame, key: str = "article_id",
) -> DataFrame:
    """``(lat, lon, n_articles, pos, val)``: term counts summed over the articles of one place.

    Articles that share a place become one row. A place's vector holds at most the vocabulary.
    """
    where = articles.select(key, "lat", "lon").na.drop()
    counts = where.groupBy("lat", "lon").agg(F.count("*").alias("n_articles"))
    # moved to its place once; neither sum moves it again
    found = terms.join(positions, "term").join(where, key).repartition("lat", "lon")
    placed = found.groupBy("lat", "lon", "position").agg(F.sum("tf").cast("double").alias("v"))
    cells = placed.groupBy("lat", "lon").agg(
        F.collect_list(F.struct(F.col("position").cast("int").alias("p"), "v")).alias("c"))
    none = F.array().cast("array<struct<p:int,v:double>>")
    full = counts.join(cells, ["lat", "lon"], "left").withColumn("c", F.coalesce("c", none))
    return full.select("lat", "lon", "n_articles", F.col("c.p").alias("pos"), F.col("c.v").alias("val"))


def article_counts(
    houses: DataFrame, articles: DataFrame, radius_m: float = TEXT_RADIUS_M, key: str = "house_id", **settings: int,
) -> DataFrame:
    """``(key, article_count)`` for every house, 0 where none is in range; counted by cells, without pairs."""
    all_one = articles.select(F.lit("article").alias("category"), "lat", "lon")
    counted = spatial.count_in_radius(houses, all_one, radius_m, key, **settings).select(
        key, F.col("n_in_radius").alias("article_count"))
    return houses.select(key).join(counted, key, "left").select(
        key, F.coalesce("article_count", F.lit(0).cast("long")).alias("article_count"))


def text_features(
    houses: DataFrame, articles: DataFrame, terms: DataFrame, positions: DataFrame, size: int,
    radius_m: float = TEXT_RADIUS_M, weighted: bool = True, mean: bool = False, key: str = "house_id",
    article_key: str = "article_id", min_articles: int = MIN_ARTICLES, **block_sizes: int,
) -> DataFrame:
    """``(key, article_count, part, vec)``: term counts of the articles in range, each times its distance weight.

    ``vec`` has one entry per term, in the order of ``positions``, from ``part * COLUMNS_PER_BLOCK`` on. Houses with fewer than ``min_articles``
    articles in range have no row. ``mean`` divides by the number of articles (not by the sum of weights).
    A column per term would not scale and could collide with the table's own columns.
    """
    places = write_once(place_vectors(articles, terms, positions, article_key), "places")
    found = weighted_sums(houses, places, size, radius_m, weighted, key, **block_sizes)
    found = found.filter(F.col("article_count") >= min_articles)
    if mean:
        found = found.withColumn("vec", F.transform("vec", lambda x: x / F.col("article_count")))
    return found


def entries_of(features: DataFrame, *keep: str) -> DataFrame:
    """``(*keep, position, weight)``: one row per entry of the vectors."""
    return features.select(*keep, "part", F.posexplode("vec").alias("_at", "weight")).select(
        *keep, (F.col("part") * COLUMNS_PER_BLOCK + F.col("_at")).cast("long").alias("position"), "weight")


def long_weights(features: DataFrame, positions: DataFrame, key: str = "house_id") -> DataFrame:
    """``(key, term, weight)`` of the terms with a weight."""
    entries = entries_of(features, key).filter(F.col("weight") != 0)
    return entries.join(positions, "position").select(key, "term", "weight")


def scaled(features: DataFrame, words: DataFrame, positions: DataFrame) -> DataFrame:
    """Each entry of ``vec`` times the idf of its term (the vectors' form of :func:`tf_idf`).

    The idf vector is cut like the features; all of it is as long as the vocabulary, which the document-frequency cut bounds.
    """
    cells = F.array_sort(F.collect_list(F.struct("position", "idf")))
    idf = words.select("term", "idf").join(positions, "term").groupBy(
        F.floor(F.col("position") / COLUMNS_PER_BLOCK).cast("int").alias("part")).agg(F.transform(cells, lambda c: c["idf"]).alias("_idf"))
    idf = write_once(idf, "idf")  # of known, small size: the features are not moved to meet it
    product = F.zip_with("vec", "_idf", lambda a, b: a * b)
    return features.join(idf, "part").withColumn("vec", product).drop("_idf")


def tf_idf(weights: DataFrame, words: DataFrame) -> DataFrame:
    """Scale a long weight table by the idf of its terms. The vocabulary side is left to the optimizer."""
    return weights.join(words.select("term", "idf"), "term").withColumn("weight", F.col("weight") * F.col("idf"))


def ordered_vocabulary(words: DataFrame) -> DataFrame:
    """``(term, position)`` in alphabetical order: the position of each term in a feature vector.

    Sorted by range over all tasks, then numbered by partition offsets, so no task sees all terms.
    """
    return numbered(words.select("term"), ["term"], "position")


def as_ml_vectors(features: DataFrame, key: str = "house_id") -> DataFrame:
    """``(key, text_vec)`` for Spark ML, which wants the whole vector in one row."""
    parts = F.array_sort(F.collect_list(F.struct("part", "vec")))
    whole = features.groupBy(key).agg(F.flatten(F.transform(parts, lambda p: p["vec"])).alias("vec"))
    return whole.select(key, array_to_vector("vec").alias("text_vec"))


def article_importance(terms: DataFrame, importance: DataFrame, key: str = "article_id") -> DataFrame:
    """``(key, article_importance)``: raw counts times the importance of each term, summed."""
    return terms.join(importance, "term").groupBy(key).agg(
        F.sum(F.col("tf") * F.col("importance")).alias("article_importance"))
