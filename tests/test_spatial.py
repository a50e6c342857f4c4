import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import geodesic, greedy
from placeloom.functions import geo
from placeloom.operators import blocks, spatial


def spread(n, seed, hot=0.35, lat=(40.0, 40.6), lon=(-80.5, -79.9), spot=(40.44, -79.99)):
    """Points of which a third lie in one small spot and some share a place."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if rng.random() < hot:
            p = (spot[0] + rng.random() * 0.01, spot[1] + rng.random() * 0.01)
        elif out and rng.random() < 0.1:
            p = out[rng.randrange(len(out))]
        else:
            p = (rng.uniform(*lat), rng.uniform(*lon))
        out.append(p)
    return out


def frames(spark, houses, points):
    h = spark.createDataFrame([(i, *p) for i, p in enumerate(houses)], "house_id long, lat double, lon double")
    p = spark.createDataFrame(
        [(i, "ab"[i % 2] if i % 10 else "rare", *p) for i, p in enumerate(points)],
        "point_id long, category string, lat double, lon double")
    return h.repartition(4), p.repartition(3)


def category(i):
    return "ab"[i % 2] if i % 10 else "rare"


@pytest.fixture(scope="module")
def data(spark):
    houses, points = spread(150, 1), spread(120, 2)
    dist = {(i, j): geodesic(*h, *p) for i, h in enumerate(houses) for j, p in enumerate(points)}
    return houses, points, dist, *frames(spark, houses, points)


def test_geodesic_matches_and_equal_points_are_zero(spark):
    rng = random.Random(5)
    pairs = [(rng.uniform(25, 49), rng.uniform(-125, -60), rng.uniform(25, 49), rng.uniform(-125, -60)) for _ in range(200)]
    pairs += [(40.0, -80.0, 40.0, -80.0), (0.0, 10.0, 0.0, 11.0), (10.0, 179.9, 10.0, -179.9)]
    df = spark.createDataFrame(pairs, "a double, b double, c double, d double")
    for r in geo.with_geodesic(df, "a", "b", "c", "d").collect():
        want = geodesic(r["a"], r["b"], r["c"], r["d"])
        assert abs(r["dist_m"] - want) < 1e-5


def test_missing_coordinate_gives_no_distance(spark):
    df = spark.createDataFrame([(40.0, None, 40.0, -80.0)], "a double, b double, c double, d double")
    assert geo.with_geodesic(df, "a", "b", "c", "d").first()["dist_m"] is None


@pytest.mark.parametrize("rows_per_task,crowded", [(20, 1000), (200_000, 1000), (20, 1)])
@pytest.mark.parametrize("radius", [800.0, 6500.0])
def test_count_in_radius(data, radius, rows_per_task, crowded):
    _, _, dist, h, p = data
    want = Counter((i, category(j)) for (i, j), d in dist.items() if d < radius)
    got = spatial.count_in_radius(h, p, radius, rows_per_task=rows_per_task, crowded=crowded).collect()
    assert {(r["house_id"], r["category"]): r["n_in_radius"] for r in got} == dict(want)


def test_count_across_a_pole_when_crowded(spark):
    rng = random.Random(9)
    houses = [(89.99 + rng.random() * 0.01, rng.uniform(-180, 180)) for _ in range(20)] + [(5.0, 179.999)]
    points = [(89.98 + rng.random() * 0.02, rng.uniform(-180, 180)) for _ in range(60)] + [(5.0, -179.999)] * 3
    h, p = frames(spark, houses, points)
    want = Counter((i, category(j)) for i, a in enumerate(houses) for j, b in enumerate(points) if geodesic(*a, *b) < 900)
    for crowded in (1, 1000):
        got = spatial.count_in_radius(h, p, 900.0, crowded=crowded).collect()
        assert {(r["house_id"], r["category"]): r["n_in_radius"] for r in got} == dict(want)


@pytest.mark.parametrize("rows_per_task", [20, 200_000])
def test_pairs_in_radius(data, rows_per_task):
    _, _, dist, h, p = data
    got = spatial.pairs_in_radius(h, p, 2500.0, rows_per_task=rows_per_task).collect()
    assert {(r["house_id"], r["point_id"]) for r in got} == {k for k, d in dist.items() if d < 2500.0}
    assert len(got) == len({(r["house_id"], r["point_id"]) for r in got})
    assert all(abs(r["dist_m"] - dist[r["house_id"], r["point_id"]]) < 1e-5 for r in got)


def test_radius_is_strict(spark):
    d = geodesic(40.0, -80.0, 40.01, -80.0)
    h = spark.createDataFrame([(1, 40.0, -80.0)], "house_id long, lat double, lon double")
    p = spark.createDataFrame([("x", 40.01, -80.0)], "category string, lat double, lon double")
    assert spatial.count_in_radius(h, p, d - 1e-4).count() == 0
    assert spatial.count_in_radius(h, p, d + 1e-4).count() == 1


def test_across_the_date_line_and_a_pole(spark):
    houses = [(10.0, 179.999), (10.0, -179.999), (89.9999, 0.0), (-89.9999, 90.0)]
    points = [(10.0, -179.999), (10.001, 179.999), (89.9999, 180.0), (-89.9999, -90.0)]
    h, p = frames(spark, houses, points)
    want = {(i, j) for i, a in enumerate(houses) for j, b in enumerate(points) if geodesic(*a, *b) < 500}
    got = spatial.pairs_in_radius(h, p, 500.0).collect()
    assert {(r["house_id"], r["point_id"]) for r in got} == want and len(want) == 6


@pytest.mark.parametrize("leaf_rows", [1, 50])
def test_nearest_per_category(data, leaf_rows):
    houses, points, dist, h, p = data
    want = {}
    for (i, j), d in dist.items():
        key = (i, category(j))
        want[key] = min(d, want.get(key, math.inf))
    got = spatial.nearest(h, p, group=["category"], leaf_rows=leaf_rows, rows_per_task=20).collect()
    assert len(got) == len(want)
    assert all(abs(r["dist_m"] - want[r["house_id"], r["category"]]) < 1e-5 for r in got)


@pytest.mark.parametrize("k", [1, 10, 500])
def test_k_nearest(data, k):
    houses, points, dist, h, p = data
    got = spatial.nearest(h, p, k, point_key="point_id").collect()
    for i in range(len(houses)):
        want = sorted((round(dist[i, j], 6), j) for j in range(len(points)))[:k]
        mine = sorted((r["rank"], r["point_id"]) for r in got if r["house_id"] == i)
        assert [j for _, j in mine] == [j for _, j in want]


def test_nearest_without_points(spark, data):
    h, p = data[3], data[4]
    assert spatial.nearest(h, p.limit(0), group=["category"]).count() == 0


def test_distance_features_keep_empty_categories(data):
    h, p = data[3], data[4]
    names = ["a", "b", "rare", "none"]
    long = spatial.distance_features(h, p, 100.0, categories=names)
    assert long.count() == 150 * 4
    assert long.filter("category = 'none'").filter("n_in_radius = 0 AND nearest_m IS NULL").count() == 150
    wide = spatial.widen_distance_features(h, long, names, compat=True)
    assert wide.filter("none_dist = 99999 AND none_count = 0").count() == 150


def clumps(seed, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        base = (40.0 + rng.randrange(6) * 0.001, -80.0 + rng.randrange(3) * 0.001)
        out.append((i, "ab"[rng.randrange(2)], base[0] + rng.random() * 0.00015, base[1] + rng.random() * 0.00015))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_near_duplicates_declared_and_greedy(spark, seed):
    rows = clumps(seed)
    df = spark.createDataFrame(rows, "point_id long, category string, lat double, lon double")
    near = {a[0] for a in rows for b in rows if a[0] != b[0] and a[1] == b[1] and geodesic(*a[2:], *b[2:]) < 8}
    kept = {r["point_id"] for r in spatial.drop_near_duplicates(df, rows_per_task=5).collect()}
    assert kept == {r[0] for r in rows} - near
    mine = sorted(r["point_id"] for r in spatial.drop_near_duplicates_greedy(df).collect())
    assert mine == greedy(rows, 8)


def test_greedy_on_a_pair_a_triple_and_a_chain(spark):
    step = 0.00005
    rows = [(1, "a", 40.0, -80.0), (2, "a", 40.0 + step, -80.0)]
    rows += [(i, "a", 40.1 + (i % 3) * step / 5, -80.0) for i in (3, 4, 5)]
    rows += [(6, "a", 40.2, -80.0), (7, "a", 40.2 + step, -80.0), (8, "a", 40.2 + 2 * step, -80.0), (9, "b", 40.2, -80.0)]
    df = spark.createDataFrame(rows, "point_id long, category string, lat double, lon double")
    mine = sorted(r["point_id"] for r in spatial.drop_near_duplicates_greedy(df).collect())
    assert mine == greedy(rows, 8)
    assert sorted(r["point_id"] for r in spatial.drop_near_duplicates(df).collect()) == [9]


@pytest.mark.parametrize("sizes", [{}, {"houses_per_block": 10, "places_per_block": 7}])
@pytest.mark.parametrize("weighted", [True, False])
def test_block_sums(spark, data, weighted, sizes):
    houses, points, dist, h, _ = data
    merged = Counter(points)
    rows = [(*p, n, [j % 5, 5 + j % 3], [1.0 + j, 2.0]) for j, (p, n) in enumerate(merged.items())]
    places = spark.createDataFrame(
        rows, "lat double, lon double, n_articles long, pos array<int>, val array<double>")
    got = {r["house_id"]: r for r in blocks.weighted_sums(h, places, 8, 3000.0, weighted, **sizes).collect()}
    for i, house in enumerate(houses):
        vec, count = [0.0] * 8, 0
        for lat, lon, n, pos, val in rows:
            d = geodesic(*house, lat, lon)
            if d < 3000.0:
                count += n
                for at, v in zip(pos, val):
                    vec[at] += v * (1 - d / 3000.0 if weighted else 1)
        assert (i in got) == (count > 0)
        if count:
            assert got[i]["article_count"] == count
            assert all(abs(x - y) < 1e-6 for x, y in zip(got[i]["vec"], vec))


def test_weights_lie_between_zero_and_one(data):
    pairs = spatial.pairs_in_radius(data[3], data[4], 2500.0)
    w = pairs.select(geo.decay_weight(F.col("dist_m"), 2500.0).alias("w"))
    assert w.filter("w <= 0 OR w > 1").count() == 0


def test_no_join_compares_all_pairs(data):
    h, p = data[3], data[4]
    for df in (
        spatial.count_in_radius(h, p, 3500.0), spatial.pairs_in_radius(h, p, 3500.0),
        spatial.nearest(h, p, group=["category"]), spatial.near_duplicate_ids(p),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_a_third_of_the_houses_at_one_place(spark):
    houses, points = spread(60, 5) + [(40.44, -79.99)] * 30, spread(50, 6)
    h, p = frames(spark, houses, points)
    dist = {(i, j): geodesic(*a, *b) for i, a in enumerate(houses) for j, b in enumerate(points)}
    got = spatial.count_in_radius(h, p, 2000.0, rows_per_task=10).collect()
    want = Counter((i, category(j)) for (i, j), d in dist.items() if d < 2000)
    assert {(r["house_id"], r["category"]): r["n_in_radius"] for r in got} == dict(want) and len(got) == len(want)
    near = spatial.nearest(h, p, 3, point_key="point_id", rows_per_task=10).collect()
    for i in range(len(houses)):
        first = [j for _, j in sorted((round(dist[i, j], 6), j) for j in range(len(points)))[:3]]
        assert [r["point_id"] for r in sorted(near, key=lambda r: r["rank"]) if r["house_id"] == i] == first
    places = spark.createDataFrame(
        [(*q, 1, [0], [1.0]) for q in set(points)], "lat double, lon double, n_articles long, pos array<int>, val array<double>")
    sums = blocks.weighted_sums(h, places, 1, 2000.0, False, houses_per_block=10).collect()
    in_range = {i: sum(geodesic(*a, *q) < 2000 for q in set(points)) for i, a in enumerate(houses)}
    assert {r["house_id"]: r["vec"][0] for r in sums} == {i: n for i, n in in_range.items() if n}


# computed from the direct problem with the published series of the geodesic
FAR = [
    ((0.0, 0.0, 0.5, 179.7), 19944127.421), ((0.0, 0.0, 0.0, 180.0), 20003931.459), ((0.0, 0.0, 0.5, 179.5), 19936288.579),
    ((90.0, 0.0, -90.0, 0.0), 20003931.459), ((10.0, 0.0, -10.0, 180.0), 20003931.459), ((0.0, 170.0, 0.0, -170.0), 2226389.816),
    ((0.0, 0.0, 0.0, 179.0), 19926188.852)]


@pytest.mark.parametrize("pair,metres", FAR)
def test_geodesic_between_opposite_places(pair, metres):
    assert geo.geodesic_m(*([x] for x in pair))[0] == pytest.approx(metres, abs=0.01)
    back = (*pair[2:], *pair[:2])
    assert geo.geodesic_m(*([x] for x in back))[0] == pytest.approx(metres, abs=0.01)


def test_azimuth_solver_agrees_with_the_series():
    rng = np.random.default_rng(1)
    lat1, lat2 = rng.uniform(-89, 89, (2, 3000))
    lon1, lon2 = rng.uniform(-180, 180, (2, 3000))
    assert np.abs(geo.geodesic_m(lat1, lon1, lat2, lon2) - geo.azimuth_m(lat1, lon1, lat2, lon2)).max() < 0.001
    # opposite places: no farther than half a meridian, and no jump between neighbours
    near = np.clip(-lat1 + rng.normal(size=3000) * 0.3, -90, 90)
    away = lon1 + 180 + rng.normal(size=3000) * 0.3
    far = geo.geodesic_m(lat1, lon1, near, away)
    assert far.max() <= 20003931.46 and far.min() > 19.7e6
    beside = geo.geodesic_m(lat1, lon1, np.clip(near + 1e-5, -90, 90), away)
    assert np.abs(far - beside).max() < 1.2
    assert np.isnan(geo.geodesic_m([np.nan, 0.0], [0.0, 0.0], [0.0, 0.0], [0.0, 180.0])).tolist() == [True, False]
