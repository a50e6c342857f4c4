"""Distance joins: count in radius, pairs in radius, k nearest, and near-duplicate removal.

Every join is an equality on grid cells. Cells wholly inside or outside a radius are settled by bounds
on their distance; only what the bounds leave open is tested with the exact geodesic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeloom.functions import geo
from placeloom.operators import tiles
from placeloom.operators.skew import salted_join
from placeloom.session import write_once


def _cells(df: DataFrame, level: int, y: str = "_y", x: str = "_x") -> DataFrame:
    return df.withColumns({y: geo.lat_cell(F.col("lat"), level), x: geo.lon_cell(F.col("lon"), level)})


def _corner(level: int, y: str, x: str):
    """South-west corner of a cell."""
    return geo.cell_low(F.col(y), level, -90.0), geo.cell_low(F.col(x), level, -180.0)


def _cover(boxes: DataFrame, radius_m: float, level: int, size: float = 0.0) -> DataFrame:
    """Repeat each point for every cell it can reach, with bounds ``_low``/``_high`` of its distance to the cell.

    With ``size`` the rows are boxes of that many degrees and ``lat``/``lon`` their south-west corner.
    """
    lat, lon = F.col("lat"), F.col("lon")
    rows = boxes.withColumn("_y", F.explode(geo.cover_lat_cells(lat, radius_m, level, size)))
    rows = rows.withColumn("_x", F.explode(geo.cover_lon_cells(lat, lon, radius_m, level, size)))
    low, high = geo.box_bounds_m(lat, lon, size, *_corner(level, "_y", "_x"), geo.step_degrees(level))
    rows = geo.pin(rows, rows.columns, _low=low, _high=high)
    return rows.filter(F.col("_low") < radius_m)


def count_in_radius(
    houses: DataFrame, points: DataFrame, radius_m: float, key: str = "house_id",
    category: str = "category", rows_per_task: int = 200_000, crowded: int = tiles.BUDGET,
) -> DataFrame:
    """``(key, category, n_in_radius)``: points of each category nearer than ``radius_m`` (strict).

    ``houses`` has ``key, lat, lon``; ``points`` has ``category, lat, lon``. Pairs with no point in range
    give no row (see :func:`distance_features`). Copies of a point are merged first. A cell that lies wholly in range
    contributes its count without looking at single points. ``crowded`` is the number of house-point pairs above which a
    tile of houses is cut.
    """
    found = _features(houses, points, key, [category], [], 0, radius_m, rows_per_task, crowded)
    return found.filter("n_in_radius > 0").select(key, category, "n_in_radius")


def _features(
    houses: DataFrame, points: DataFrame, key: str, group: list[str], ids: list[str], k: int, radius_m: float | None,
    rows_per_task: int, budget: int,
) -> DataFrame:
    places = points.select(*group, *ids, "lat", "lon").na.drop()
    if ids:
        # no more than k copies of one place can be among the k nearest
        same = Window.partitionBy(*group, "lat", "lon").orderBy(*ids)
        places = places.withColumn("_copy", F.row_number().over(same)).filter(F.col("_copy") <= k).drop("_copy").withColumn("_n", F.lit(1).cast("long"))
    else:
        places = places.groupBy(*group, "lat", "lon").agg(F.count("*").alias("_n"))

    homes = houses.select(key, "lat", "lon").na.drop()
    found = tiles.house_point_features(homes, places, key, group, ids, k, radius_m, budget, rows_per_task)
    return _no_rows(homes, places, key, group, ids) if found is None else found


def pairs_in_radius(
    houses: DataFrame, points: DataFrame, radius_m: float, key: str = "house_id",
    carry: list[str] | None = None, fan: int = 2, rows_per_task: int = 200_000,
) -> DataFrame:
    """``(key, *carry, dist_m)`` for every house and point nearer than ``radius_m`` (strict).

    ``carry`` names the columns of ``points`` to keep (default: all but the coordinates).
    """
    carry = carry or [c for c in points.columns if c not in ("lat", "lon")]
    level = geo.level_for(radius_m / fan)
    have = [c for c in carry if c not in ("lat", "lon")]
    reach = _cover(points.select(*have, "lat", "lon").na.drop(subset=["lat", "lon"]), radius_m, level).select(
        "_y", "_x", *have, F.col("lat").alias("_plat"), F.col("lon").alias("_plon"))
    located = _cells(houses.select(key, "lat", "lon").na.drop(), level)
    met = salted_join(located, reach, ["_y", "_x"], [key], rows_per_task)
    sphere = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("_plat"), F.col("_plon"))
    met = met.select(key, *have, "lat", "lon", "_plat", "_plon").filter(sphere * geo.SPHERE_LOW < radius_m)
    met = geo.with_geodesic(met, "lat", "lon", "_plat", "_plon", "dist_m").filter(F.col("dist_m") < radius_m)
    places = [F.col("_plat").alias("lat"), F.col("_plon").alias("lon")] if "lat" in carry else []
    return met.select(key, *have, *places, "dist_m")


# ---- nearest ----------------------------------------------------------------------------------------


def nearest(
    houses: DataFrame, points: DataFrame, k: int = 1, key: str = "house_id", point_key: str | None = None,
    group: list[str] | None = None, leaf_rows: int = tiles.BUDGET, rows_per_task: int = 200_000,
) -> DataFrame:
    """The ``k`` nearest points of every house per ``group``, however far away.

    Returns ``(key, *group, point_key, dist_m, rank)``; without ``point_key`` (``k`` must be 1) only the
    smallest distance, ``(key, *group, dist_m)``. Ties are broken by ``point_key``.

    Houses and points are first compared as cells: a cell of points is dropped when its lower bound exceeds the distance
    within which ``k`` points are certain. Only points of the surviving cells meet the houses of a tile; ``leaf_rows`` is
    the number of house-point pairs above which a tile is cut, so nothing is unbounded or all-pairs.
    """
    ids = [point_key] if point_key else []
    if not ids and k != 1:
        raise ValueError("k > 1 needs point_key")
    found = _features(houses, points, key, group or [], ids, k, None, rows_per_task, leaf_rows)
    return found if ids else found.filter("dist_m is not null").drop("n_in_radius")


def _no_rows(homes: DataFrame, places: DataFrame, key: str, group: list[str], ids: list[str]) -> DataFrame:
    if ids:
        ends = [F.lit(0.0).alias("dist_m"), F.lit(0).alias("rank")]
    else:
        ends = [F.lit(0).cast("long").alias("n_in_radius"), F.lit(0.0).alias("dist_m")]
    return homes.drop("lat", "lon").join(places.drop("lat", "lon", "_n"), F.lit(False)).select(key, *group, *ids, *ends)


# ---- features ---------------------------------------------------------------------------------------

# Fixed value: distance written for a category without points in the wide compatible form.
FAR_AWAY = 99999


def distance_features(
    houses: DataFrame, points: DataFrame, radius_m: float, key: str = "house_id", category: str = "category",
    categories: list[str] | None = None, rows_per_task: int = 200_000,
) -> DataFrame:
    """``(key, category, n_in_radius, nearest_m)`` for every house and category.

    ``categories`` adds categories that may have no point at all: count 0, distance NULL.
    """
    found = _features(houses, points, key, [category], [], 1, radius_m, rows_per_task, tiles.BUDGET).select(
        key, category, "n_in_radius", F.col("dist_m").alias("nearest_m"))
    if categories is None:
        return found
    names = F.explode(F.array(*[F.lit(c) for c in dict.fromkeys(categories)])).alias(category)
    return houses.select(key, names).join(found, [key, category], "left").select(
        key, category, F.coalesce("n_in_radius", F.lit(0).cast("long")).alias("n_in_radius"), "nearest_m")


def widen_distance_features(
    houses: DataFrame, features: DataFrame, categories: list[str], key: str = "house_id",
    category: str = "category", compat: bool = False,
) -> DataFrame:
    """One ``<category>_dist`` and ``<category>_count`` column per category, joined to ``houses``."""
    fill = F.lit(float(FAR_AWAY)) if compat else F.lit(None).cast("double")
    aggs = []
    for name in dict.fromkeys(categories):
        hit = F.col(category) == name
        dist = F.max(F.when(hit, F.col("nearest_m")))
        aggs += [F.coalesce(dist, fill).alias(f"{name}_dist"),
                 F.coalesce(F.sum(F.when(hit, F.col("n_in_radius"))), F.lit(0)).alias(f"{name}_count")]
    wide = features.groupBy(key).agg(*aggs)
    return houses.join(wide, key, "left")


# ---- duplicates -------------------------------------------------------------------------------------


def drop_same_place(points: DataFrame, key: str = "point_id") -> DataFrame:
    """Keep the lowest ``key`` of every exact coordinate."""
    order = Window.partitionBy("lat", "lon").orderBy(key)
    return points.withColumn("_copy", F.row_number().over(order)).filter(F.col("_copy") == 1).drop("_copy")


def near_duplicate_ids(
    points: DataFrame, radius_m: float = 8.0, key: str = "point_id", category: str = "category",
    rows_per_task: int = 200_000,
) -> DataFrame:
    """Keys of the points that have another point of their category nearer than ``radius_m``.

    Cells are small enough that two points in one cell are always that near, so a cell with two rows is
    settled by its count. Only the one point of a lone cell meets the points of the cells around it:
    each point is compared with at most one point per neighbouring cell.
    """
    placed = points.select(key, category, "lat", "lon").na.drop()
    # half a diagonal of a cell of this height is safely below the radius
    level = geo.level_for(radius_m / 1.5) + 1
    if 1.5 * 111_700 * 180 / 2 ** level > radius_m:  # the finest cells are too wide: test the points themselves
        pairs = _near_pairs(points, radius_m, key, category, rows_per_task)
        return pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct()
    celled = _cells(placed, level)
    cells = celled.groupBy(category, "_y", "_x").agg(
        F.count("*").alias("_n"), F.min(key).alias(key), F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    lone = cells.filter(F.col("_n") == 1).select(category, key, "lat", "lon")
    crowded = cells.filter(F.col("_n") > 1).select(category, "_y", "_x")
    in_crowd = celled.join(crowded, [category, "_y", "_x"], "left_semi").select(key)

    reach = _cover(lone, radius_m, level).select(
        category, "_y", "_x", F.col(key).alias("_lone"), F.col("lat").alias("_plat"), F.col("lon").alias("_plon"))
    met = salted_join(celled, reach, [category, "_y", "_x"], [key], rows_per_task)
    met = met.filter(F.col(key) != F.col("_lone"))
    met = geo.with_geodesic(met, "lat", "lon", "_plat", "_plon", "_d").filter(F.col("_d") < radius_m)
    near_lone = met.select(F.col("_lone").alias(key)).distinct()
    return in_crowd.unionByName(near_lone)


def drop_near_duplicates(
    points: DataFrame, radius_m: float = 8.0, key: str = "point_id", category: str = "category",
    rows_per_task: int = 200_000,
) -> DataFrame:
    """Keep the points with no other point of their category nearer than ``radius_m``."""
    near = near_duplicate_ids(points, radius_m, key, category, rows_per_task)
    return points.join(near, key, "left_anti")


def _near_pairs(points: DataFrame, radius_m: float, key: str, category: str, rows_per_task: int) -> DataFrame:
    """``(category, a, b)``, a < b: points of one category nearer than ``radius_m``."""
    level = geo.level_for(radius_m)
    placed = points.select(key, category, "lat", "lon").na.drop()
    reach = _cover(placed, radius_m, level).select(
        category, "_y", "_x", F.col(key).alias("b"), F.col("lat").alias("_plat"), F.col("lon").alias("_plon"))
    met = salted_join(_cells(placed, level), reach, [category, "_y", "_x"], [key], rows_per_task)
    met = met.filter(F.col(key) < F.col("b"))
    met = geo.with_geodesic(met, "lat", "lon", "_plat", "_plon", "_d").filter(F.col("_d") < radius_m)
    return met.select(category, F.col(key).alias("a"), "b")


def drop_near_duplicates_greedy(
    points: DataFrame, radius_m: float = 8.0, key: str = "point_id", category: str = "category",
    rows_per_task: int = 200_000,
) -> DataFrame:
    """Near-duplicate removal that goes through the points in key order.

    Give it one row per place (:func:`drop_same_place`): its pair list grows with the square of the copies.
    :func:`drop_near_duplicates` has no such list and is the default for large tables.

    A point is removed when some other point that is still a candidate lies near it; the first such
    candidate then no longer serves as one. The decision of a point waits only for the earlier points
    near it, so points are decided in rounds: a point whose earlier neighbours are all decided is decided
    next. Distant clumps advance together.
    """
    pairs = write_once(_near_pairs(points, radius_m, key, category, rows_per_task), "near")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = write_once(both, "near")
    # state per point: removed = left the result, spent = no longer serves as a partner
    state = write_once(both.select(F.col("a").alias(key)).distinct().select(
        key, F.lit(False).alias("decided"), F.lit(False).alias("removed"), F.lit(False).alias("spent")), "state")
    while not state.filter(~F.col("decided")).isEmpty():
        state = write_once(_decide_round(state, both, key), "state")
    return points.join(state.filter("removed").select(key), key, "left_anti")


def _decide_round(state: DataFrame, both: DataFrame, key: str) -> DataFrame:
    """Decide the open points that come first among all open points within two steps.

    Two points interact only when they can pick the same partner, that is within two steps.
    """
    open_ = state.filter(~F.col("decided")).select(key)
    first_near = both.join(open_.withColumnRenamed(key, "b"), "b").groupBy("a").agg(F.min("b").alias("m"))
    near = state.select(key).join(first_near.withColumnRenamed("a", key), key, "left").join(
        open_.withColumn("_self", F.col(key)), key, "left")
    one = near.select(key, F.least("m", "_self").alias("m"))
    two = both.join(one.withColumnRenamed(key, "b"), "b").groupBy("a").agg(F.min("m").alias("m2"))
    turn = one.join(two.withColumnRenamed("a", key), key).filter(
        F.least("m", "m2") == F.col(key)).select(key)
    usable = state.filter(~F.col("spent")).select(F.col(key).alias("b"))
    pick = (
        both.join(turn.withColumnRenamed(key, "a"), "a").join(usable, "b")
        .groupBy("a").agg(F.min("b").alias("b"))
    )
    turn_flag = turn.withColumn("_turn", F.lit(True))
    gone = pick.select(F.col("a").alias(key)).withColumn("_gone", F.lit(True))
    used = pick.select(F.col("b").alias(key)).distinct().withColumn("_used", F.lit(True))
    merged = state.join(turn_flag, key, "left").join(gone, key, "left").join(used, key, "left")
    yes = F.lit(False)
    return merged.select(
        key, (F.col("decided") | F.coalesce("_turn", yes)).alias("decided"),
        (F.col("removed") | F.coalesce("_gone", yes)).alias("removed"),
        (F.col("spent") | F.coalesce("_used", yes)).alias("spent"))
