import bz2
import hashlib
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from placeloom.functions import clean, geo
from placeloom.operators import cleaning, evaluation, folds, metrics, ordering, profiling, skew, terms
from placeloom.sources import files, pages
from placeloom.streaming.ingest import ingest_new_parts


def test_null_safe_filters(spark):
    df = spark.createDataFrame([("A", 5.0), (None, None), ("B", 25.0)], "owner string, rooms double")
    assert {r["owner"] for r in df.filter(clean.differs(F.col("owner"), "A")).collect()} == {None, "B"}
    assert {r["owner"] for r in df.filter(clean.none_of(F.col("owner"), ["B"])).collect()} == {None, "A"}
    assert df.filter("rooms <= 20").count() == 1


def test_blank_strings(spark):
    df = spark.createDataFrame([(" ",), ("",), ("\t\n",), ("x ",)], "s string")
    assert [r["s"] for r in cleaning.blank_strings_to_null(df).collect()] == [None, None, None, "x "]


def test_condition_scale(spark):
    rows = [(c, d) for c in range(1, 9) for d in ("AVERAGE", "VERY GOOD", "VERY POOR", "UNSOUND", None)]
    df = spark.createDataFrame([(float(c), d) for c, d in rows], "c double, d string")
    got = [r[0] for r in df.select(clean.condition_scale(F.col("c"), F.col("d"))).collect()]
    fixed = {"VERY GOOD": 2, "VERY POOR": 7, "UNSOUND": 8}
    assert got == [fixed.get(d, c + 1 if 2 <= c <= 6 else c) for c, d in rows]


def test_lookup_fails_on_unknown_key(spark):
    df = spark.createDataFrame([("X",)], "town string")
    table = spark.createDataFrame([("Y", "district_1")], "municipality string, district string")
    with pytest.raises(PySparkException):
        cleaning.lookup(df, table, "town", "municipality", "district").collect()


def test_drop_of_unknown_column_fails(spark):
    with pytest.raises(ValueError):
        cleaning.drop_columns(spark.range(1), ["nope"])


@pytest.mark.parametrize("seed", range(3))
def test_exact_quantiles(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([rng.gauss(0, 1), rng.expovariate(1e-6), 7.0, -1e12 * rng.random()]) for _ in range(997)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = profiling.exact_quantiles(df, ["v"], probs)["v"]
    for p in probs:
        assert got[p] == pytest.approx(np.percentile(values, p * 100), rel=1e-12)


def test_absent_levels(spark):
    df = spark.createDataFrame([(0, 0, 1, 1, True), (0, 0, -1, 0, True), (0, 1, 0, 0, False)], "x_a int, x_b int, x_c int, x_d int, t boolean")
    got = {r["column"] for r in profiling.absent_levels(df, F.col("t"), ["x_a", "x_b", "x_c", "x_d"]).collect()}
    assert got == {"x_a", "x_b", "x_c"}


def test_numbered_is_dense_and_ordered(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.randrange(10**6), i) for i in range(500)], "a int, b int").repartition(7)
    rows = sorted((r["position"], r["a"], r["b"]) for r in ordering.numbered(df, ["a", "b"]).collect())
    assert [r[0] for r in rows] == list(range(500))
    assert [r[1:] for r in rows] == sorted(r[1:] for r in rows)


def test_salted_join_equals_join(spark):
    big = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    small = spark.createDataFrame([(k, v) for k in range(50) for v in range(3)], "k long, v int")
    a = skew.salted_join(big, small, ["k"], ["id"], rows_per_task=10)
    assert a.count() == 3000
    assert a.exceptAll(big.join(small, "k").select(a.columns)).isEmpty()


def test_splits_are_disjoint_and_sized(spark):
    df = folds.train_test(spark.range(4000), "id")
    sizes = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    assert abs(sizes["test"] - 1000) < 120 and abs(sizes["validation"] - 750) < 110
    assert sum(sizes.values()) == 4000


def test_measures(spark):
    rows = [("p", 10.0, 10.0), ("p", 20.0, 20.0), ("c", 5.0, 4.0), ("c", 5.0, 6.0), ("z", 0.0, 1.0), ("z", 2.0, 1.0)]
    got = {r["f"]: r for r in metrics.measures(spark.createDataFrame(rows, "f string, y double, prediction double"), ["f"]).collect()}
    assert got["p"]["mae"] == 0 and got["p"]["r2"] == 1
    assert got["c"]["r2"] is None and got["c"]["mape"] == pytest.approx(20)
    assert got["z"]["mape"] == pytest.approx(50)


def ridge_by_hand(x, y, alpha):
    xc, yc = x - x.mean(0), y - y.mean()
    coef = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return coef, y.mean() - x.mean(0) @ coef


def test_linear_and_ridge_match_the_normal_equations(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3)) * [1, 5, 0.2]
    y = x @ [2.0, -1.0, 30.0] + 4 + rng.normal(size=300)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    rows = evaluation.assembled(df, ["a", "b", "c"])
    for maker, alpha in ((evaluation.linear(), 0.0), (evaluation.ridge(10.0), 10.0)):
        model = maker(rows).fit(rows)
        coef, intercept = ridge_by_hand(x, y, alpha)
        assert np.allclose(model.coefficients.toArray(), coef, atol=1e-6) and abs(model.intercept - intercept) < 1e-6


def test_district_validation_matches_by_hand(spark):
    rng = np.random.default_rng(4)
    n = 260
    d = rng.integers(1, 5, n)
    x = rng.normal(size=(n, 2))
    y = x @ [3.0, 1.0] + d + 50 + rng.normal(size=n) * 0.1
    names = [f"district_{i}" for i in range(1, 5)]
    df = spark.createDataFrame(
        [(i, float(x[i, 0]), float(x[i, 1]), int(d[i] == 1), float(y[i]), f"district_{d[i]}") for i in range(n)],
        "_id long, a double, b double, only_1 int, y double, DISTRICT string")
    pred, per, summary, importance = evaluation.district_validation(df, evaluation.linear(), ["a", "b", "only_1"], names)
    got = {r["_id"]: r["prediction"] for r in pred.collect()}
    for k in range(1, 5):
        tr, te = d != k, np.nonzero(d == k)[0]
        flag = (d == 1)[:, None].astype(float)
        feats = x if k == 1 else np.hstack([x, flag])
        coef, b0 = ridge_by_hand(feats[tr], y[tr], 0.0)
        assert np.allclose([got[i] for i in te], feats[te] @ coef + b0, atol=1e-5)
    assert len(got) == n and per.count() == 4
    assert {r["feature"] for r in importance.collect()} == {"a", "b", "only_1"}
    share = per.agg(F.sum(F.col("n") / n)).first()[0]
    assert share == pytest.approx(1.0)


def test_text_features_small(spark):
    houses = spark.createDataFrame([(1, 40.0, -80.0), (2, 41.0, -80.0)], "house_id long, lat double, lon double")
    docs = spark.createDataFrame(
        [(1, 40.0, -80.0, "red barn red"), (2, 40.0, -80.0, "barn"), (3, 40.001, -80.0, "blue"), (4, 41.0, -80.0, "red"),
         (5, 41.0, -80.0, "red")], "article_id long, lat double, lon double, text string")
    counts = terms.term_counts(docs, bigrams=False)
    words = terms.vocabulary(counts, 5, 0.02)
    pos = terms.ordered_vocabulary(words)
    assert [r["term"] for r in pos.orderBy("position").collect()] == ["barn", "blue", "red"]
    found = terms.text_features(houses, docs, counts, pos, 3, 1000.0).collect()
    assert [r["house_id"] for r in found] == [1] and found[0]["article_count"] == 3
    assert found[0]["vec"][0] == pytest.approx(2.0) and found[0]["vec"][2] == pytest.approx(2.0)
    assert 0.85 < found[0]["vec"][1] < 0.9
    mean = terms.text_features(houses, docs, counts, pos, 3, 1000.0, mean=True).first()
    assert mean["vec"][0] == pytest.approx(2 / 3)
    vec = terms.as_ml_vectors(terms.text_features(houses, docs, counts, pos, 3, 1000.0)).first()["text_vec"]
    assert vec.size == 3


def test_dump_folder_and_manifest(spark, tmp_path):
    names = ["d-articles1.xml-p1p10.bz2", "d-articles2.xml-p11p31.bz2", "d-multistream.xml-p1p9.bz2", "readme.txt"]
    for n in names:
        (tmp_path / n).write_bytes(n.encode() * 100)
    parts = files.list_parts(spark, str(tmp_path))
    got = {r["file"]: r["pages"] for r in files.with_page_counts(parts).collect()}
    assert got == {names[0]: 9, names[1]: 20}
    sums = tmp_path / "sums.txt"
    good = hashlib.md5((tmp_path / names[0]).read_bytes()).hexdigest()
    sums.write_text(f"{good}  {names[0]}\n{'0' * 32}  {names[1]}\n{good}  gone.xml-p1p2.bz2\n")
    status = {r["file"]: r["status"] for r in files.verify(spark, str(tmp_path), files.read_manifest(spark, str(sums))).collect()}
    assert status == {names[0]: "ok", names[1]: "differs", names[2]: "unlisted", "gone.xml-p1p2.bz2": "missing"}


def dump(path, titles):
    body = "".join(
        f"<page><title>{t}</title><revision><timestamp>2020-12-01T00:00:00Z</timestamp>"
        f'<text bytes="9" xml:space="preserve">A &amp;amp; {{{{coord|40.{i}|-80.1|k=v}}}} [[Category:Park]]</text>'
        "</revision></page>\n" for i, t in enumerate(titles, 1))
    path.write_bytes(bz2.compress(f'<mediawiki>\n<siteinfo><x/></siteinfo>\n{body}</mediawiki>'.encode()))


def test_incremental_ingest_skips_finished_parts(spark, tmp_path):
    source, out, progress = tmp_path / "in", tmp_path / "out", tmp_path / "progress"
    source.mkdir()
    dump(source / "d1.xml-p1p3.bz2", ["a", "b"])
    assert {r["title"] for r in pages.read_pages(spark, str(source)).collect()} == {"a", "b"}
    for titles, want in ((["c"], 3), (None, 3)):
        if titles:
            ingest_new_parts(spark, str(source), str(out), str(progress)).awaitTermination(60)
            dump(source / "d2.xml-p4p5.bz2", titles)
        ingest_new_parts(spark, str(source), str(out), str(progress)).awaitTermination(60)
        rows = spark.read.parquet(str(out)).collect()
        assert len(rows) == want
    assert rows[0]["wikilinks"] == ["Category:Park"] and rows[0]["text"].startswith("A &")


def test_positional_record_round_trip(spark):
    rows = [('a "q" \\ [x], [y]', 40.5, -80.25, {"k": "v, {}"}, "line\nbreak ]", ["l"], [], 12), ("b", 1.0, 2.0, None, "", [], ["u"], 0)]
    df = spark.createDataFrame(rows, files.ARTICLE_SCHEMA)
    back = files.article_from_array(files.article_to_array(df))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_bounding_box_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(10).select((F.col("id") + 35.0).alias("lat"), (F.col("id") - 85.0).alias("lon")).write.parquet(path)
    df = spark.read.parquet(path).filter(geo.inside_box(F.col("lat"), F.col("lon"), *geo.COUNTY_BOX))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(lat,40.0)" in plan and "LessThan(lat,40.87)" in plan
