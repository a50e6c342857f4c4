"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask keeps some positions of a stretch of words and ignores the others, so a replaced word at an ignored
position does not change the hash. Every position of every text is hashed under every mask; hashes are joined with
those of the benchmark. Around each hit the two texts are laid side by side on the hit's diagonal, and the pair
counts if some window of ``WINDOW`` words (the whole item, if it is shorter) agrees in at least ``SHARE`` of them.

Words are runs of letters and digits in lower case. Rows: null and empty texts have no words and no hits; an item with
fewer words than a mask keeps (8) has no seed and is never found; repeated documents and items are reported as often as
they have distinct (id, text); null ids are reported as null. An empty table on either side gives no rows. Other columns
are not read by ``leaks`` and pass through ``without_leaks``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.llm.registry import numbered
from placeloom.session import write_once

# 1: the word counts, 0: it is ignored. Put together from pairs and fours in ``seeds``.
MASKS = ["11111111", "111100001111", "111101111", "11011011011"]
WINDOW = 13
SHARE = 0.8
MAX_BROADCAST = 1_000_000  # rows of benchmark seeds that are broadcast (some 30 bytes each); more are shuffled


def word_hashes(text: Column) -> Column:
    """Hash of each word, in order."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.length(words) > 0, F.transform(F.split(words, " "), lambda w: F.xxhash64(w)))


def _apart(a: Column, b: Column, gap: int) -> Column:
    """Hash of ``a[i]`` with ``b[i + gap]``; places without the second are dropped."""
    size = F.greatest(F.size(a) - gap, F.lit(0))
    return F.zip_with(F.slice(a, 1, size), F.slice(b, gap + 1, size), lambda x, y: F.xxhash64(x, y))


def _with_seeds(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_h`` exploded to ``_mask``, ``_pos`` and ``_seed``; ``_h`` itself is dropped."""
    kept = [c for c in rows.columns if c != "_h"]
    # The outer forms of explode keep the optimizer from copying these expressions into filters on their size.
    twos = rows.withColumn("_2", _apart(F.col("_h"), F.col("_h"), 1))
    fours = twos.withColumn("_4", _apart(F.col("_2"), F.col("_2"), 2)).withColumn("_33", _apart(F.col("_2"), F.col("_2"), 3))
    all_masks = fours.select(*kept, F.array(
        _apart(F.col("_4"), F.col("_4"), 4), _apart(F.col("_4"), F.col("_4"), 8),
        _apart(F.col("_4"), F.col("_4"), 5), _apart(F.col("_33"), F.col("_33"), 6)).alias("_s"))
    each = all_masks.select(*kept, F.posexplode_outer("_s").alias("_mask", "_seeds"))
    return each.select(*kept, "_mask", F.posexplode_outer("_seeds").alias("_pos", "_seed"))


def _leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", window: int = WINDOW, share: float = SHARE,
) -> DataFrame:
    """``leaks`` with ``_th``, the hash of the document's text."""
    rows = docs.select(F.col(id_col).alias("_doc"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"))
    words = word_hashes(F.col("_text")).alias("_h")
    items = write_once(
        benchmark.select(F.col(item_col).alias("_item"), word_hashes(F.col(item_text)).alias("_words"))
        .filter("size(_words) >= 8").distinct(), "items")
    seeds = write_once(_with_seeds(items.select("*", F.col("_words").alias("_h"))).select(
        "_item", F.col("_words").alias("_w"), F.col("_pos").alias("_at"), "_mask", "_seed"), "seeds")
    plain = seeds.select("_item", F.xxhash64("_w").alias("_wh"), "_at", "_mask", "_seed")
    small = seeds.count() <= MAX_BROADCAST
    bounded = F.broadcast if small else (lambda df: df)
    hits = _with_seeds(rows.select("_doc", "_th", words)).join(bounded(plain), ["_mask", "_seed"])
    # Many hits lie on one diagonal; they are one candidate.
    found = write_once(
        hits.select("_doc", "_th", "_item", "_wh", (F.col("_pos") - F.col("_at")).alias("_diag")).distinct(), "hits")
    places = found.groupBy("_doc", "_th").agg(F.collect_list(F.struct("_item", "_wh", "_diag")).alias("_c"))
    # The words around each candidate, cut out where the document lies.
    longest = (items.agg(F.max(F.size("_words")).alias("n")).first().n or 0)
    start = lambda c: F.greatest(c["_diag"], F.lit(0))
    shared = [rows["_doc"].eqNullSafe(places["_doc"]), rows["_th"] == places["_th"]]
    near = rows.join(places, shared).select(rows["_doc"], rows["_th"], words, "_c")
    around = near.select("_doc", "_th", F.explode_outer(F.transform("_c", lambda c: F.struct(
        c["_item"].alias("_item"), c["_wh"].alias("_wh"), c["_diag"].alias("_diag"),
        F.slice(F.col("_h"), start(c) + 1, F.lit(longest)).alias("_near")))).alias("_p")).select("_doc", "_th", "_p.*")
    named = items.select(F.col("_item").alias("_i"), F.xxhash64("_words").alias("_w"), "_words")
    pairs = around.join(
        bounded(named), F.col("_item").eqNullSafe(F.col("_i")) & (F.col("_wh") == F.col("_w")))
    skipped = F.greatest(-F.col("_diag"), F.lit(0))
    own = F.slice("_words", skipped + 1, F.size("_words"))
    n = F.least(F.size(own), F.size("_near"))
    agree = F.zip_with(F.slice(own, 1, n), F.slice("_near", 1, n), lambda a, b: (a == b).cast("int"))
    span = F.least(F.lit(window), F.size("_words"))
    # Matches of each window from running sums.
    sums = F.aggregate("_agree", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    best = F.array_max(F.zip_with(
        F.slice("_sums", F.col("_span") + 1, F.greatest(F.size("_sums") - F.col("_span"), F.lit(0))),
        F.slice("_sums", 1, F.greatest(F.size("_sums") - F.col("_span"), F.lit(0))), lambda b, a: b - a))
    measured = pairs.withColumn("_agree", agree).withColumn("_span", span).withColumn("_sums", sums).withColumn("_best", best)
    good = measured.filter(F.col("_best") >= F.ceil(F.col("_span") * share))
    return good.groupBy("_doc", "_th", "_item", "_wh").agg(
        F.max(F.struct(F.col("_best"), F.col("_span"), -F.col("_diag"))).alias("_m")).select(
        F.col("_doc").alias(id_col), F.col("_item").alias(item_col), F.col("_m._best").cast("long").alias("n_matched"),
        F.col("_m._span").cast("long").alias("n_window"), (-F.col("_m.col3")).cast("long").alias("offset"), "_th")


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", window: int = WINDOW, share: float = SHARE,
) -> DataFrame:
    """One row per document and item that overlap: ids, best window's ``n_matched`` and ``n_window``, and the word at
    which the item's first word would stand in the document (``offset``), for the best place."""
    return _leaks(docs, benchmark, id_col, text_col, item_col, item_text, window, share).drop("_th")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that overlap with no item, with all their columns. A row goes for its own text, not for that
    of another row with the same id or, like it, without one."""
    docs, (id_col, text_col), old = numbered(docs, id_col, text_col)
    gone = _leaks(docs, benchmark, id_col, text_col, **options).select(F.col(id_col).alias("_doc"), "_th").distinct()
    on = F.col(id_col).eqNullSafe(F.col("_doc")) & (F.xxhash64(text_col) == F.col("_th"))
    return docs.join(gone, on, "left_anti").toDF(*old)
