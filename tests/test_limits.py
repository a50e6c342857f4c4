"""Inputs beyond the sizes and ranges of the test tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeloom.operators import cleaning, profiling, skew, spatial, vectors
from placeloom.sources import files


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, "two\nlines\r\n"), (2, 'say "hi", ok'), (3, ""), (4, None), (5, "back\\slash\\n \\\\n"), (6, "tail\\"), (7, ",")]
    df = spark.createDataFrame(rows, "id long, text string")
    files.write_csv(df, str(tmp_path / "csv"))
    back = files.read_csv(spark, str(tmp_path / "csv"), df.schema, own=True)
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == rows


def test_csv_nan_is_null(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,t\nNaN,"a\nb"\n1.5,c\n')
    got = files.read_csv(spark, str(tmp_path / "a.csv"), "x double, t string").collect()
    assert [tuple(r) for r in got] == [(None, "a\nb"), (1.5, "c")]


def test_quantiles_leave_out_nan(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (math.nan,), (None,)], "v double")
    assert profiling.exact_quantiles(df, ["v"], [0.25, 0.5, 0.75])["v"] == {0.25: 1.75, 0.5: 2.5, 0.75: 3.25}
    empty = spark.createDataFrame([(None, None)], "lat double, lon double")
    assert profiling.median_point(empty) == (None, None)


def test_more_hot_keys_than_the_former_limit(spark):
    df = spark.range(4500).select((F.col("id") % 1500).alias("k"))
    assert skew.hot_keys(df, ["k"], 2).count() == 1500


def test_near_duplicates_below_a_metre(spark):
    step = 0.566 / 111_200
    rows = [(1, "a", 40.0, -80.0), (2, "a", 40.0 + step, -80.0), (3, "a", 41.0, -80.0), (4, "a", 41.0 + step / 2, -80.0)]
    points = spark.createDataFrame(rows, "point_id long, category string, lat double, lon double")
    kept = {r.point_id for r in spatial.drop_near_duplicates(points, radius_m=0.5).collect()}
    assert kept == {1, 2}


def test_all_wanted_vectors(spark):
    rows = [(i, [math.cos(i / 9), math.sin(i / 9)]) for i in range(20)] + [(20, None), (21, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = vectors.most_similar(df, df.filter("id in (3, 10)"), 2, "id", "v", block=1).collect()
    assert {(r.wanted_key, r.id) for r in got} == {(3, 2), (3, 4), (10, 9), (10, 11)}


def test_one_hot_of_many_levels(spark):
    df = spark.range(2100).select("id", F.concat(F.lit("l"), F.col("id")).alias("c")).union(spark.sql("select 5000L, null"))
    flags = cleaning.one_hot(df, ["c"])
    assert len(flags.columns) == 2101 and flags.columns[:2] == ["id", "c_l0"]
    got = cleaning.level_vectors(df, ["c"])
    assert got.columns == ["id", "c_levels"]
    assert {(r.c_levels.size, int(r.c_levels.numNonzeros())) for r in got.filter("id < 9").collect()} == {(2100, 1)}
    assert got.filter("id = 5000").first().c_levels.numNonzeros() == 0


@pytest.mark.parametrize("kind", ["spread", "skewed", "constant", "two", "tiny"])
def test_quantiles_are_exact(spark, kind):
    rng = random.Random(1)
    n = 3 if kind == "tiny" else 30_000
    make = {"spread": lambda: rng.gauss(0, 1e6), "skewed": lambda: rng.choice([0.0, 0.0, rng.random() ** 9 * 1e12, -1.0]),
            "constant": lambda: 7.0, "two": lambda: float(rng.random() < 0.5), "tiny": lambda: rng.random()}[kind]
    values = [make() for _ in range(n)]
    df = spark.createDataFrame([(v, None) for v in values] + [(None, None), (float("nan"), None)], "a double, b double")
    probs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.9999, 1.0]
    got = profiling.exact_quantiles(df, ["a", "b"], probs)
    assert list(got) == ["a"]
    for p, want in zip(probs, np.quantile(values, probs), strict=True):
        assert got["a"][p] == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_templates_nested_to_any_depth(spark):
    from placeloom.functions import markup

    nest = lambda n: "{{x|" * n + "q" + "}}" * n
    rows = [(n, f"a {{{{coord|40.5|-80.25|{nest(n)}}}}} b {{{{Infobox place|name=N|note={nest(n)}|size=3}}}} c") for n in range(1, 21)]
    df = spark.createDataFrame(rows + [(99, "{{" * 8 + " open")], "n long, t string")
    got = df.select(
        "n", markup.article_coord(F.col("t")).alias("c"), markup.plain_text(F.col("t")).alias("p"), markup.infobox(F.col("t")).alias("i")).collect()
    for r in got:
        if r.n < 99:
            assert tuple(r.c) == (40.5, -80.25) and r.p.split() == ["a", "b", "c"], r.n
            assert r.i == {"name": "N", "size": "3"}, (r.n, r.i)
