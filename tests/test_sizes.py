"""Steps whose memory or disk once grew faster than their input."""

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from placeloom.functions.geo import geodesic_m
from placeloom.operators import blocks, evaluation, gram, terms, vectors


def test_block_sums_move_no_sums(spark):
    houses = spark.createDataFrame([(i, 40.44 + i * 1e-4, -80.0) for i in range(30)], "house_id long, lat double, lon double")
    places = spark.createDataFrame(
        [(40.44 + j * 1e-4, -80.0, 1, [j, 600 + j], [1.0, None if j == 3 else 2.0]) for j in range(40)],
        "lat double, lon double, n_articles long, pos array<int>, val array<double>")
    sums = blocks.weighted_sums(houses, places, 700, 900.0, False, houses_per_block=31, places_per_block=7)
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan.split("\n")[0] and "CoGroup" not in plan
    got = {(r["house_id"], r["part"]): (r["article_count"], r["vec"]) for r in sums.collect()}
    assert set(got) == {(i, p) for i in range(30) for p in (0, 1)}
    for i in range(30):
        near = [j for j in range(40) if geodesic_m(40.44 + i * 1e-4, -80.0, 40.44 + j * 1e-4, -80.0)[0] < 900]
        assert got[i, 0][0] == got[i, 1][0] == len(near)
        assert [j for j, v in enumerate(got[i, 0][1]) if v] == near
        assert sum(got[i, 1][1]) == 2 * len(set(near) - {3})  # a null value adds nothing


@pytest.mark.parametrize("base", [0.0, 40.0, -75.0, 89.7])
@pytest.mark.parametrize("radius", [2500.0, 19000.0, 40000.0])
def test_distances_from_chords(base, radius):
    rng = np.random.default_rng(1)
    lat, p_lat = (base + rng.uniform(-0.2, 0.2, n) for n in (50, 60))
    lon, p_lon = (180 + rng.uniform(-0.2, 0.2, n) for n in (50, 60))
    p_lat[:5], p_lon[:5] = lat[:5], lon[:5]
    got = blocks._distances(lat, lon, p_lat, p_lon, radius)
    want = geodesic_m(np.repeat(lat, 60), np.repeat(lon, 60), np.tile(p_lat, 50), np.tile(p_lon, 50)).reshape(50, 60)
    assert ((got < radius) == (want < radius)).all()
    assert np.abs(got - want)[want < radius].max() < 1e-6


def test_frequent_terms_without_all_pairs(spark):
    rng = np.random.default_rng(2)
    words = [f"q{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(30)]
    rows = [(i % 190, " ".join(rng.choice(words, 12, p=np.arange(30, 0, -1) / 465))) for i in range(200)] + [(500, None), (None, "qaa qab")]
    docs = spark.createDataFrame(rows, "article_id long, text string")
    all_terms = Counter()
    for i, t in rows:
        own = (t or "").split()
        for term in own + [f"{a} {b}" for a, b in zip(own, own[1:])]:
            all_terms[i, term] += 1
    counts = terms.term_counts(docs)
    assert {(r["article_id"], r["term"]): r["tf"] for r in counts.collect()} == dict(all_terms)
    assert counts.count() == len(all_terms)
    df, total = Counter(t for _, t in all_terms), Counter()
    for (_, t), n in all_terms.items():
        total[t] += n
    found = terms.frequent_terms(docs, 192, 0.03)
    assert {r["term"]: (r["df"], r["total"]) for r in found.collect()} == {t: (n, total[t]) for t, n in df.items() if n >= 6}
    assert found.filter("term like '% %'").count()
    some = terms.term_counts(docs, among=found)
    assert {(r["article_id"], r["term"]): r["tf"] for r in some.collect()} == {k: n for k, n in all_terms.items() if df[k[1]] >= 6}


def test_vector_counts_read_no_vectors(spark):
    houses = spark.createDataFrame([(1, 40.0, -80.0), (2, 41.0, -80.0), (3, None, -80.0)], "house_id long, lat double, lon double")
    articles = spark.createDataFrame(
        [(40.0, -80.0, [1.0]), (40.0, -80.0, None), (40.01, -80.0, [2.0]), (40.02, -80.0, None)], "lat double, lon double, vec array<float>")
    got = vectors.vector_article_counts(houses, articles, 5000.0)
    assert sorted(map(tuple, got.collect())) == [(1, 3), (2, 0), (3, 0)]


def test_nearest_vectors_are_summed_where_they_arrive(spark):
    houses = spark.createDataFrame([(1, 40.0, -80.0)], "house_id long, lat double, lon double")
    articles = spark.createDataFrame([(i, 40.0 + i / 100, -80.0, [float(i), 1.0]) for i in range(5)], "article_id long, lat double, lon double, vec array<float>")
    got = vectors.nearest_vectors(houses, articles, 3)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 3.0), (1, 1, 3.0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(house_id" in plan and "pos#" not in "".join(
        line for line in plan.split("\n") if "hashpartitioning(house_id" in line)


def test_similar_vectors_compare_a_bounded_number_at_once():
    rng = np.random.default_rng(4)
    rows, widths = rng.normal(size=(700, 8)), []

    class Watched(np.ndarray):
        def __matmul__(self, other):
            widths.append(len(self) * other.shape[1])
            return np.asarray(self) @ other

    class Shared:
        value = (list(range(600)), vectors._unit(rows[:600]).view(Watched))

    out = pd.concat(vectors._best(Shared, 3, "id", iter([pd.DataFrame({"id": range(700), "_vec": list(rows)})])))
    unit = vectors._unit(rows)
    close = unit[:600] @ unit.T
    close[range(600), range(600)] = -np.inf
    want = np.argsort(-close, axis=1)[:, :3]
    assert out["id"].tolist() == want.reshape(-1).tolist() and out["wanted_key"].tolist() == np.repeat(range(600), 3).tolist()
    assert max(widths) <= vectors.WANTED_AT_ONCE * 700


def test_linear_folds_with_a_vector_equal_plain_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(i, str(i % 3), *map(float, rng.normal(size=4))) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, fold string, y double, a double, b double, c double")
    folds = ["0", "1", "2"]
    want, weights = evaluation.leave_one_out(df, folds, evaluation.ridge(3.0), ["a", "b", "c"], ["id"])
    wide = df.withColumn("v", F.array("b", "c"))
    assert np.allclose(
        gram.moments_by_fold(wide, folds, ["a", "v"], wide={"v": 2})[0]["1"].cross,
        gram.moments_by_fold(df, folds, ["a", "b", "c"])[0]["1"].cross)
    from pyspark.ml.functions import array_to_vector
    got, importance = evaluation.leave_one_out(
        wide.withColumn("v", array_to_vector("v")), folds, evaluation.ridge(3.0), ["a", "v"], ["id"], vector_names={"v": ["b", "a"]})
    assert np.allclose([r["prediction"] for r in want.orderBy("id").collect()], [r["prediction"] for r in got.orderBy("id").collect()])
    assert [r["importance"] for r in weights.collect()] == pytest.approx([r["importance"] for r in importance.collect()])


@pytest.mark.parametrize("spot, weighted, radius", [((40.4, 179.97), True, 6500.0), ((-89.6, 10.0), True, 6500.0), ((40.4, -80.0), False, 2500.0), ((40.4, -80.0), True, 30000.0)])
def test_houses_share_what_is_far(monkeypatch, spot, weighted, radius):
    rng = np.random.default_rng(6)
    wide = 1 / np.cos(np.radians(spot[0]))
    lat, lon = spot[0] + rng.uniform(0, 0.03, 4000), spot[1] + rng.uniform(0, 0.03 * wide, 4000)
    lat[:300], lon[:300] = lat[0], lon[0]  # one house place with many houses
    lon = np.where(lon > 180, lon - 360, lon)
    p_lat, p_lon = (c + rng.uniform(-0.08 * w, 0.11 * w, 600) for c, w in zip(spot, (1, wide)))
    p_lat[:5], p_lon[:5], n = lat[:5], lon[:5], rng.integers(1, 4, 600).astype(float)
    values = rng.integers(0, 3, (600, 2)).astype(float)
    values[:, 1] *= np.arange(600) == 0
    w, inside = blocks._weights(lat, lon, p_lat, p_lon, radius, weighted)
    compared, weights = [], blocks._weights
    monkeypatch.setattr(blocks, "_weights", lambda a, b, c, *rest: compared.append(len(a) * len(c)) or weights(a, b, c, *rest))
    block = blocks._Block((0, 0, 0, 0), 2, radius, weighted, 100)
    block.house(pa.array(range(4000)), lat, lon)
    lists = pa.array([[0, 1]] * 600, pa.list_(pa.int32())), pa.array(list(values), pa.list_(pa.float64()))
    block.add(p_lat, p_lon, n, *lists)
    found = pa.Table.from_batches(block.rows(["key", "n", "part", "vec"]))
    got = {k: (m, v) for k, m, v in zip(*(found[c].to_pylist() for c in ("key", "n", "vec")))}
    count, sums = inside @ n, w @ values
    assert set(got) == set(np.nonzero(count)[0])
    at = sorted(got)
    assert [got[i][0] for i in at] == count[at].tolist()
    assert np.allclose([got[i][1] for i in at], sums[at], rtol=1e-8, atol=1e-9)
    assert (np.array([got[i][1] for i in at]) == 0).tolist() == (sums[at] == 0).tolist()
    if radius < blocks.CHORD_M:
        assert sum(compared) < 0.7 * inside.sum()  # once every house met every place in range


def test_document_counts_are_added_up_in_workers(spark, monkeypatch):
    monkeypatch.setattr(terms, "TERMS_AT_ONCE", 3)
    docs = spark.createDataFrame([(i, "river bridge river" if i % 2 else "bridge road Road") for i in range(40)], "article_id long, text string")
    found = terms.frequent_terms(docs, 40, 0.1)
    assert {(r["term"], r["df"], r["total"]) for r in found.collect()} == {
        ("river", 20, 40), ("bridge", 40, 40), ("road", 20, 40), ("river bridge", 20, 20), ("bridge river", 20, 20),
        ("bridge road", 20, 20), ("road road", 20, 20)}
    counted = terms._found_in(docs, "article_id", "text", terms._counting(True, False, None, None))
    assert "MapInArrow" in counted._jdf.queryExecution().optimizedPlan().toString()
