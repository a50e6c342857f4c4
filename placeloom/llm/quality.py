"""Quality scores by Bradley-Terry pairwise ranking.

Each preference pair is a labelled good and a labelled bad document; the logistic loss on the difference of
their features gives one weight per feature, and a document's worth is the weighted sum of its features. The
acceptance threshold is a quantile of the worths of the labelled documents (the share labelled bad), and the
score is the Bradley-Terry probability against a document at that threshold, shifted so that the threshold
itself has score ``ACCEPT``.

Features come from the whole text alone; labels, language, source and id never enter. Training uses every labelled row
outside the held-out fold; pairs, weights and the threshold are all worked out over tables, nothing is sampled.

Rows: a null or empty text has all features 0 and is scored like any other; a null id is scored but never
learned from; repeated rows each get the same score; ties share a score. Labels without both classes (an
empty table too) teach nothing: every score is then ``ACCEPT`` and every document is kept.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom.llm import workers
from placeloom.llm.registry import numbered
from placeloom.operators.profiling import exact_quantiles
from placeloom.session import write_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # so that a Python worker imports no Spark ML

ACCEPT = 0.7
ROUNDS = 4  # partners that each good document meets on average

UPPER, LOWER, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
STOPS, RULES, SIGNS = b".,;:?", b"|", b"!#$%&*+<=>@^_~"
FEATURES = [
    "upper", "digits", "stops", "rules", "signs", "other", "words_upper", "words_signed", "words_again", "words_apart",
    "word_length", "length", "lines", "commonest"]


def features(text: str | None) -> list[float]:
    """Shares of characters and words of each kind; all between 0 and 1."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    size, n = len(raw), len(words)
    share = lambda kind: 1 - len(raw.translate(None, kind)) / size
    upper, digits, stops, rules, signs = map(share, (UPPER, DIGITS, STOPS, RULES, SIGNS))
    other = len(raw.translate(None, UPPER + LOWER + DIGITS + STOPS + RULES + SIGNS + b" \t\n\r")) / size
    again = sum(map(bytes.__eq__, words, words[1:])) / n
    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    return [
        upper, digits, stops, rules, signs, other, sum(map(bytes.isupper, words)) / n,
        sum(not w.rstrip(STOPS)[-1:].isalnum() and w[-1] < 128 for w in words) / n, again, len(counts) / n,
        min(1.0, size / n / 20), min(1.0, math.log1p(n) / 12), min(1.0, raw.count(b"\n") * 10 / n), max(counts.values()) / n]


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_x`` (array of double); no row is moved."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in workers.sliced(batches):
            texts = batch.column(place)
            flat = np.array([features(texts[i].as_py()) for i in range(batch.num_rows)], float).reshape(-1)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(FEATURES))
            column = pa.ListArray.from_arrays(ends, pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "_x"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_x", T.ArrayType(T.DoubleType()))]))


def remainder(key: Column, by: int) -> Column:
    """Fold of a document: CRC-32 of its id as text."""
    return F.crc32(key.cast("string")) % by


def fit(known: DataFrame) -> tuple[list[float], float] | None:
    """Weights and threshold from all rows of ``_doc``, ``_x`` and ``_good`` (0 or 1); None without both classes."""
    labelled = write_once(
        known.filter("_doc is not null and _good is not null").select("_x", "_good", F.xxhash64("_doc").alias("_h")), "labelled")
    found = labelled.agg(F.count("*").alias("n"), F.sum("_good").alias("good")).first()
    n, bad = found.n, found.n - (found.good or 0)
    if bad in (0, n):
        return None
    rounds = F.explode(F.sequence(F.lit(1), F.lit(ROUNDS)))
    place = F.pmod(F.xxhash64("_h", "_round"), F.lit(min(bad, n - bad)))
    seats = labelled.select("*", rounds.alias("_round")).select("_x", "_h", "_good", "_round", place.alias("_seat"))
    good = seats.filter("_good = 1").select("_round", "_seat", F.col("_x").alias("_a"), "_h")
    poor = seats.filter("_good = 0").select("_round", "_seat", F.col("_x").alias("_b"))
    # either order of a pair, by hash: the first is preferred or not
    sign = F.when(F.xxhash64("_h", "_round") % 2 == 0, 1.0).otherwise(-1.0)
    pairs = write_once(good.join(poor, ["_round", "_seat"]).select(
        ((sign + 1) / 2).alias("label"),
        F.zip_with("_a", "_b", lambda a, b: (a - b) * sign).alias("_d")), "pairs")
    model = LogisticRegression(fitIntercept=False, regParam=1e-4, maxIter=60).fit(
        pairs.select("label", array_to_vector("_d").alias("features")))
    weights = [float(w) for w in model.coefficients]
    # the border between the worst `bad` documents and the rest, halfway
    share = (bad - 0.5) / (n - 1)
    worths = labelled.select(worth(weights).alias("worth"))
    return weights, float(exact_quantiles(worths, ["worth"], [share])["worth"][share])


def worth(weights: list[float]) -> Column:
    return sum((F.col("_x")[i] * w for i, w in enumerate(weights)), F.lit(0.0))


def score(model: tuple[list[float], float] | None) -> Column:
    """Score of a row with ``_x``: ``ACCEPT`` at the threshold."""
    if not model:
        return F.lit(ACCEPT)
    weights, threshold = model
    return 1 / (1 + F.exp(-(worth(weights) - threshold) - math.log(ACCEPT / (1 - ACCEPT))))


def _learn(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, folds: int, held: int):
    marks = labels.select(F.col(id_col).alias("_doc"), F.col(label_col).cast("int").alias("_good")).filter(
        remainder(F.col("_doc"), folds) != held)
    return fit(rows.join(marks, "_doc"))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = 4, held: int = 2,
) -> DataFrame:
    """Per document: ``held_out``, ``score`` and ``predicted``; learns from labels outside the held-out fold."""
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    rows = write_once(with_features(texts, "_text").drop("_text"), "features")
    model = _learn(rows, labels, id_col, label_col, folds, held)
    return rows.select(
        F.col("_doc").alias(id_col),
        F.coalesce(remainder(F.col("_doc"), folds) == held, F.lit(False)).alias("held_out"),
        score(model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = 4, held: int = 2,
) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns. Texts are not shuffled: ids and features
    meet the labels."""
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
    docs, (id_col, text_col), old = numbered(docs, id_col, text_col)
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    texts = texts.filter(remainder(F.col("_doc"), folds) != held)  # only these can be learnt from
    rows = write_once(with_features(texts, "_text").drop("_text"), "features")
    model = _learn(rows, marks, "doc_id", "label", folds, held)
    if not model:
        return docs.toDF(*old)
    weights, threshold = model
    # only the text goes to Python, and one number comes back; rows stay where they are
    return docs.filter(worth_of(weights)(F.col(text_col)) >= threshold).toDF(*old)


def worth_of(weights: list[float]):
    """A column function: the worth of a text."""
    @F.arrow_udf(T.DoubleType())
    def run(texts: pa.Array) -> pa.Array:
        workers.let_go()
        return pa.array([float(np.dot(features(texts[i].as_py()), weights)) for i in range(len(texts))], pa.float64())

    return run
