"""Counts in a radius and nearest points in one pass over tiles.

Houses and points are written once with their finest grid cell. A tile is a cell of houses; it is compared with the cells
of points of its level by bounds on their distance. A cell wholly in range adds its count, one that is out of range and
cannot hold a nearest point goes, and the rest are open. A tile whose houses times open points exceed the budget is cut
into finer cells together with its open cells, so that each level works on what the one above has left. At last the
houses of each tile meet the points of its open cells in one task, in blocks of bounded size. Houses at one place count
once in the budget and are compared once; a tile with many houses is dealt to several tasks by their key.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom.functions import geo
from placeloom.functions.geo import MEAN_RADIUS, SPHERE_HIGH, SPHERE_LOW, geodesic_m
from placeloom.session import write_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Levels from one comparison of cells to the next finer one.
STEP = 2
START_CELLS = 256
# Pairs of house places and points that one task compares for a tile, houses of a tile in one task, pairs held at a time.
BUDGET = 2_000_000
HOUSES_PER_TASK = 200_000
BLOCK_PAIRS = 500_000


def _up(cell: str, levels: int):
    return F.shiftright(F.col(cell), levels)


def _frame(homes: DataFrame, places: DataFrame) -> tuple[int, tuple[int, int, int, int]] | None:
    """Start level and its cell range: the finest level at which all data lies in a few cells."""
    finest = geo.FINEST_LEVEL
    ends = homes.select(F.col("_hy").alias("y"), F.col("_hx").alias("x")).unionByName(
        places.select(F.col("_py").alias("y"), F.col("_px").alias("x"))).agg(
        F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1")).first()
    if ends is None or ends["y0"] is None:
        return None
    best = (0, (0, 0, 0, 1))
    for level in range(finest + 1):
        y0, y1, x0, x1 = (ends[c] >> (finest - level) for c in ("y0", "y1", "x0", "x1"))
        if (y1 - y0 + 1) * (x1 - x0 + 1) > START_CELLS:
            break
        best = (level, (y0, y1, x0, x1))
    return best


def house_point_features(
    houses: DataFrame, points: DataFrame, key: str, group: list[str], ids: list[str], k: int = 0, radius_m: float | None = None,
    budget: int = BUDGET, houses_per_task: int = HOUSES_PER_TASK,
) -> DataFrame | None:
    """``(key, *group, n_in_radius, dist_m)``, or ``(key, *group, *ids, dist_m, rank)`` with ``ids``; None without any row.

    ``houses`` has ``key, lat, lon``; ``points`` has ``group``, ``ids``, ``lat, lon`` and ``_n`` (copies), one row per place
    (with ``ids``, per point). ``k`` nearest per group are found (0: none; without ``ids`` at most 1) and points nearer
    than ``radius_m`` counted (None: not).
    """
    finest = geo.FINEST_LEVEL
    lat, lon = F.col("lat"), F.col("lon")
    homes = write_once(houses.select(
        key, "lat", "lon", geo.lat_cell(lat, finest).alias("_hy"), geo.lon_cell(lon, finest).alias("_hx")), "homes")
    places = write_once(points.select(
        *group, *ids, "lat", "lon", "_n", geo.lat_cell(lat, finest).alias("_py"), geo.lon_cell(lon, finest).alias("_px")), "places")
    frame = _frame(homes, places)
    if frame is None:
        return None
    level, (y0, y1, x0, x1) = frame
    grid = lambda a, b: F.explode(F.sequence(F.lit(a).cast("long"), F.lit(b).cast("long")))
    pairs = (
        _home_cells(homes, level).withColumn("_py", grid(y0, y1)).withColumn("_px", grid(x0, x1))
        .withColumns({"_near": F.lit(k > 0), "_open": F.lit(radius_m is not None)}).join(_place_cells(places, group, level), ["_py", "_px"]))
    met, most, levels = None, 0, []
    while True:
        scored = write_once(_scored(pairs, group, level, k, radius_m), "tiles")
        last = level >= finest
        # tiles over the budget are cut, the others are done; what is wholly in range is done in both
        done = scored.filter(((F.col("_work") <= budget) | F.lit(last)) & (F.col("_near") | F.col("_open")))
        sums = scored.filter("_whole").groupBy(*group, "_hy", "_hx").agg(F.sum("_n").alias("_n"))
        met = _met(met, done, sums, places, group, ids, level)
        levels.append(level)
        seen = scored.agg(F.max("_h").alias("h"), F.max(F.when(F.col("_near") | F.col("_open"), F.col("_work"))).alias("w")).first()
        most = max(most, seen["h"] or 0)
        if last or (seen["w"] or 0) <= budget:
            break
        finer = min(level + STEP, finest)
        drop = finer - level
        heavy = scored.filter((F.col("_work") > budget) & (F.col("_near") | F.col("_open")))
        h_next = _home_cells(homes, finer).withColumnsRenamed({"_hy": "_hy2", "_hx": "_hx2", "_h": "_h2", "_d": "_d2"}).withColumns(
            {"_hy": _up("_hy2", drop), "_hx": _up("_hx2", drop)})
        p_next = _place_cells(places, group, finer).withColumnsRenamed({"_py": "_py2", "_px": "_px2", "_p": "_p2", "_n": "_n2"}).withColumns(
            {"_py": _up("_py2", drop), "_px": _up("_px2", drop)})
        pairs = heavy.join(p_next, [*group, "_py", "_px"]).join(h_next, ["_hy", "_hx"]).select(
            *group, "_near", "_open", F.col("_hy2").alias("_hy"), F.col("_hx2").alias("_hx"), F.col("_py2").alias("_py"),
            F.col("_px2").alias("_px"), F.col("_h2").alias("_h"), F.col("_d2").alias("_d"), F.col("_p2").alias("_p"), F.col("_n2").alias("_n"))
        level = finer
    return _answers(homes, met, levels, key, group, ids, k, radius_m, -(-most // houses_per_task))


def _home_cells(homes: DataFrame, level: int) -> DataFrame:
    up = geo.FINEST_LEVEL - level
    return homes.groupBy(_up("_hy", up).alias("_hy"), _up("_hx", up).alias("_hx")).agg(
        F.count("*").alias("_h"), F.approx_count_distinct(F.struct("lat", "lon")).alias("_d"))


def _place_cells(places: DataFrame, group: list[str], level: int) -> DataFrame:
    up = geo.FINEST_LEVEL - level
    return places.groupBy(*group, _up("_py", up).alias("_py"), _up("_px", up).alias("_px")).agg(
        F.count("*").alias("_p"), F.sum("_n").alias("_n"))


def _scored(pairs: DataFrame, group: list[str], level: int, k: int, radius_m: float | None) -> DataFrame:
    """Pairs that are still needed, with ``_near`` (may hold one of the k nearest), ``_open`` (cut by the circle), ``_whole``
    (wholly inside it), and ``_work``, the pairs of different house places and points of the whole tile and group."""
    step = geo.step_degrees(level)
    low, high = geo.box_bounds_m(
        geo.cell_low(F.col("_hy"), level, -90.0), geo.cell_low(F.col("_hx"), level, -180.0), step,
        geo.cell_low(F.col("_py"), level, -90.0), geo.cell_low(F.col("_px"), level, -180.0), step)
    pairs = geo.pin(pairs, pairs.columns, _low=low, _high=high)
    tile = Window.partitionBy(*group, "_hy", "_hx")
    if k > 1:
        so_far = tile.orderBy("_high").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        pairs = pairs.withColumn("_seen", F.sum("_p").over(so_far))
        sure = F.min(F.when(F.col("_seen") >= k, F.col("_high"))).over(tile)
    else:
        sure = F.min("_high").over(tile)
    near = F.col("_near") & F.coalesce(F.col("_low") <= F.col("_sure"), F.lit(True))
    radius = F.lit(float("-inf") if radius_m is None else radius_m)
    whole = F.col("_open") & (F.col("_high") < radius)
    open_ = F.col("_open") & (F.col("_low") < radius) & (F.col("_high") >= radius)
    flagged = pairs.withColumn("_sure", sure).withColumns({"_whole": whole, "_o": open_, "_near": near})
    work = F.sum(F.when(F.col("_near") | F.col("_o"), F.col("_d") * F.col("_p")).otherwise(0)).over(tile)
    return flagged.withColumn("_work", work).filter("_near or _o or _whole").select(
        *group, "_hy", "_hx", "_py", "_px", "_h", "_d", "_p", "_n", "_near", F.col("_o").alias("_open"), "_whole", "_work")


def _met(met: DataFrame | None, done: DataFrame, sums: DataFrame, places: DataFrame, group: list[str], ids: list[str], level: int) -> DataFrame:
    """What the houses of a tile meet: points of open cells, and one row without a point for counts settled."""
    up = geo.FINEST_LEVEL - level
    at = places.withColumns({"_py": _up("_py", up), "_px": _up("_px", up)}).withColumnRenamed("_n", "_copies")
    columns = ["_level", "_hy", "_hx", *group, *ids, "_plat", "_plon", "_n", "_near", "_open"]
    found = done.select(*group, "_hy", "_hx", "_py", "_px", "_near", "_open").join(at, [*group, "_py", "_px"]).select(
        F.lit(level).alias("_level"), "_hy", "_hx", *group, *ids, F.col("lat").alias("_plat"), F.col("lon").alias("_plon"),
        F.col("_copies").alias("_n"), "_near", "_open")
    types = dict(places.dtypes)
    settled = sums.select(
        F.lit(level).alias("_level"), "_hy", "_hx", *group, *[F.lit(None).cast(types[c]).alias(c) for c in ids],
        F.lit(None).cast("double").alias("_plat"), F.lit(None).cast("double").alias("_plon"), "_n", F.lit(False).alias("_near"),
        F.lit(True).alias("_open"))
    both = found.unionByName(settled).select(columns)
    return both if met is None else met.unionByName(both)


def _answers(
    homes: DataFrame, met: DataFrame, levels: list[int], key: str, group: list[str], ids: list[str], k: int, radius_m: float | None, pieces: int,
) -> DataFrame:
    finest = geo.FINEST_LEVEL
    at = F.inline(F.array(*[F.struct(
        F.lit(n).alias("_level"), _up("_hy", finest - n).alias("_ty"), _up("_hx", finest - n).alias("_tx")) for n in levels]))
    piece = F.pmod(F.xxhash64(key), F.lit(max(1, pieces))).cast("int")
    left = homes.select(key, "lat", "lon", piece.alias("_piece"), at)
    right = met.withColumnsRenamed({"_hy": "_ty", "_hx": "_tx"}).withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(max(1, pieces) - 1))))
    fields = {f.name: f for f in [*homes.schema.fields, *met.schema.fields]}
    out = [fields[c] for c in [key, *group, *ids]]
    if ids:
        out += [T.StructField("dist_m", T.DoubleType()), T.StructField("rank", T.IntegerType())]
    else:
        out += [T.StructField("n_in_radius", T.LongType()), T.StructField("dist_m", T.DoubleType())]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return tile_answers(left, right, key, group, ids, k, radius_m)

    tile = ["_level", "_ty", "_tx", "_piece"]
    rows = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(run, T.StructType(out))
    if len(levels) > 1 and not ids:
        # counts settled above the level at which a tile was done
        rows = rows.groupBy(key, *group).agg(F.sum("n_in_radius").alias("n_in_radius"), F.min("dist_m").alias("dist_m"))
    return rows


def tile_answers(left: pa.Table, right: pa.Table, key: str, group: list[str], ids: list[str], k: int, radius_m: float | None) -> pa.Table:
    """Counts and nearest points of the houses of one tile, group by group and block by block."""
    names = [key, *group, *ids, *(["dist_m", "rank"] if ids else ["n_in_radius", "dist_m"])]
    types = [left.schema.field(key).type, *(right.schema.field(c).type for c in [*group, *ids]),
             *([pa.float64(), pa.int32()] if ids else [pa.int64(), pa.float64()])]
    schema = pa.schema(list(zip(names, types, strict=True)))
    parts: list[pa.Table] = []
    if left.num_rows and right.num_rows:
        spots, spot = np.unique(np.column_stack([left[c].to_numpy() for c in ("lat", "lon")]), axis=0, return_inverse=True)
        spot = spot.reshape(-1)
        by_spot, ends = np.argsort(spot, kind="stable"), np.r_[0, np.cumsum(np.bincount(spot, minlength=len(spots)))]
        codes = np.zeros(right.num_rows, dtype=np.int64)
        for c in group:
            each = right[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            codes = np.unique(codes * (int(each.max()) + 1) + each, return_inverse=True)[1]
        lat, lon = (right[c].to_numpy() for c in ("_plat", "_plon"))
        copies = right["_n"].to_numpy()
        near, open_ = (right[c].to_numpy() for c in ("_near", "_open"))
        # places of equal distance go by their ids
        by_id = np.arange(right.num_rows)
        if ids:
            by_id[right.select(ids).append_column("_i", pa.array(by_id)).sort_by([(c, "ascending") for c in ids])["_i"].to_numpy()] = np.arange(right.num_rows)
        for code in np.unique(codes):
            rows = np.flatnonzero(codes == code)
            single = rows[~np.isnan(lat[rows])]
            whole = int(copies[rows[np.isnan(lat[rows])]].sum())
            block = max(1, BLOCK_PAIRS // max(1, len(single)))
            for start in range(0, len(spots), block):
                stop = min(start + block, len(spots))
                house, point, dist, rank, count = _block(
                    spots[start:stop, 0], spots[start:stop, 1], lat[single], lon[single], copies[single], near[single], open_[single], by_id[single], k, radius_m)
                if ids:
                    # one row for each house of the spot
                    sizes = ends[start + house + 1] - ends[start + house]
                    each = np.repeat(np.arange(len(house)), sizes)
                    at = by_spot[ends[start + house][each] + np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
                    columns = [left[key].take(at), *(right[c].take(np.full(len(at), rows[0])) for c in group),
                               *(right[c].take(single[point[each]]) for c in ids), pa.array(dist[each]), pa.array(rank[each].astype(np.int32))]
                else:
                    nearest = np.full(stop - start, np.nan)
                    nearest[house] = dist
                    at = by_spot[ends[start]:ends[stop]]
                    here = spot[at] - start
                    columns = [left[key].take(at), *(right[c].take(np.full(len(at), rows[0])) for c in group), pa.array(count[here] + whole),
                               pa.array(nearest[here], from_pandas=True)]
                parts.append(pa.table(columns, schema=schema))
    return pa.concat_tables(parts) if parts else schema.empty_table()


def _block(lat, lon, p_lat, p_lon, copies, near, open_, by_id, k, radius_m):
    """House, point, distance and rank of the k nearest, and the number of points in range of each house."""
    n = len(lat)
    none = np.zeros(0, dtype=np.int64)
    count = np.zeros(n, dtype=np.int64)
    if not len(p_lat):
        return none, none, np.zeros(0), none, count
    y, x, py, px = (np.radians(v) for v in (lat[:, None], lon[:, None], p_lat[None, :], p_lon[None, :]))
    unit = np.sin((py - y) / 2) ** 2 + np.cos(y) * np.cos(py) * np.sin((px - x) / 2) ** 2
    sphere = 2 * MEAN_RADIUS * np.arcsin(np.sqrt(np.minimum(unit, 1.0)))
    ring = np.zeros_like(unit, dtype=bool)
    if radius_m is not None and open_.any():
        inside = open_[None, :] & (sphere * SPHERE_HIGH < radius_m)
        ring = open_[None, :] & (sphere * SPHERE_LOW < radius_m) & ~inside
        count += inside @ copies
    choice = np.zeros_like(unit, dtype=bool)
    if k and near.any():
        far = np.where(near[None, :], sphere, np.inf)
        most = min(k, int(near.sum()))
        limit = np.partition(far, most - 1, axis=1)[:, most - 1] * SPHERE_HIGH
        choice = near[None, :] & (sphere * SPHERE_LOW <= limit[:, None])
    house, point = np.nonzero(ring | choice)
    dist = geodesic_m(lat[house], lon[house], p_lat[point], p_lon[point]) if len(house) else np.zeros(0)
    if radius_m is not None:
        hit = ring[house, point] & (dist < radius_m)
        np.add.at(count, house[hit], copies[point[hit]])
    picked = choice[house, point]
    house, point, dist = house[picked], point[picked], dist[picked]
    order = np.lexsort((by_id[point], dist, house))
    house, point, dist = house[order], point[order], dist[order]
    rank = np.arange(len(house)) - np.searchsorted(house, house) + 1
    first = rank <= k
    return house[first], point[first], dist[first], rank[first], count
