"""Splits, regression models and their validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeloom.operators import cleaning, evaluation, folds, metrics, ordering, terms
from placeloom.plans import inputs
from placeloom.plans.inputs import HOUSES
from placeloom.plans.registry import query, table
from placeloom.plans.spatial import text_features
from placeloom.session import write_once


def _part(key: str, n: int, seed: int = 42) -> str:
    return f"CAST(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT % {n} AS INTEGER)"


# ---- splits -----------------------------------------------------------------------------------------


@query("train_test_split", f"""
SELECT o_orderkey, CASE WHEN {_part('o_orderkey', 4)} = 0 THEN 'test' WHEN {_part('o_orderkey', 4, 43)} = 0 THEN 'validation'
  ELSE 'train' END AS split FROM orders""")
def train_test_split(spark, sf_dir):
    return folds.train_test(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("quarter_split", f"""
SELECT o_orderkey, {_part('o_orderkey', 4)} + 1 AS quarter, {_part('o_orderkey', 4)} < 3 AS known FROM orders""")
def quarter_split(spark, sf_dir):
    return folds.quarters(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("k_folds", f"SELECT CAST({_part('o_orderkey', 5)} AS VARCHAR) AS fold, count(*) AS rows FROM orders GROUP BY 1")
def k_folds(spark, sf_dir):
    return folds.k_folds(table(spark, sf_dir, "orders"), "o_orderkey").groupBy("fold").agg(F.count("*").alias("rows"))


@query("quadrant_folds", f"""
WITH h AS ({HOUSES}), m AS (SELECT median(lat) la, median(lon) lo FROM h)
SELECT CASE WHEN lat >= la AND lon >= lo THEN '1' WHEN lat >= la THEN '2' WHEN lon < lo THEN '3' ELSE '4' END AS fold,
  count(*) AS rows FROM h, m GROUP BY 1""")
def quadrant_folds(spark, sf_dir):
    return folds.quadrant_folds(inputs.houses(spark, sf_dir)).groupBy("fold").agg(F.count("*").alias("rows"))


@query("zone_dummies", "SELECT c_custkey, c_acctbal, " + ", ".join(
    f"CAST(c_mktsegment = '{s}' AS INTEGER) AS c_mktsegment_{s}"
    for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def zone_dummies(spark, sf_dir):
    chosen, others = "c_mktsegment", ["c_nationkey", "c_name"]
    return cleaning.one_hot(cleaning.drop_columns(table(spark, sf_dir, "customer"), others), [chosen])


_ZONES = {"ZIP": "l_partkey % 19", "MUNI": "l_suppkey % 13", "SCHOOL": "l_linenumber", "NEIGH": "l_orderkey % 31"}


def _zone_sql(zone: str) -> str:
    """Predictions by a model of one zone's 0/1 columns: the zone's mean over the other folds."""
    return f"""
SELECT fold, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs((y - p) / y)) * 100 AS mape,
  1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2
FROM (SELECT l.fold, l.y, (t.s - f.s) / (t.n - f.n) AS p FROM l
  JOIN (SELECT {zone}, sum(y) s, count(*) n FROM l GROUP BY 1) t USING ({zone})
  JOIN (SELECT {zone}, fold, sum(y) s, count(*) n FROM l GROUP BY 1, 2) f USING ({zone}, fold)) GROUP BY 1"""


@query("zone_sweep", f"""
WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_extendedprice AS y, {", ".join(f"{e} AS {z}" for z, e in _ZONES.items())},
  {_part('(l_orderkey * 10 + l_linenumber)', 3)} AS fold FROM lineitem),
z AS ({" UNION ALL ".join(f"SELECT '{z}' AS zone, * FROM ({_zone_sql(z)})" for z in _ZONES)}),
u AS ({" UNION ALL ".join(f"SELECT zone, '{m}' AS measure, {m} AS v FROM z" for m in metrics.MEASURES)})
SELECT measure, {", ".join(f"round(avg(v) FILTER (WHERE zone = '{z}'), 3) + 0e0 AS {z}" for z in _ZONES)} FROM u GROUP BY measure""")
def zone_sweep(spark, sf_dir):
    """Which zone key predicts prices best on its own."""
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_id"), F.col("l_extendedprice").alias("y"),
        *[F.expr(e).alias(z) for z, e in _ZONES.items()])
    found = evaluation.zone_sweep(rows, list(_ZONES), evaluation.linear(), [], k=3)
    return found.select("measure", *[(F.round(z, 3) + 0.0).alias(z) for z in _ZONES])


# ---- scaling ----------------------------------------------------------------------------------------


@query("column_scale", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std FROM lineitem"
    for c in ("l_quantity", "l_extendedprice")))
def column_scale(spark, sf_dir):
    found = evaluation.column_scale(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
    return found.select("column", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


@query("whole_matrix_scale", """
SELECT round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS std FROM
 (SELECT l_quantity AS v FROM lineitem UNION ALL SELECT l_extendedprice FROM lineitem)""")
def whole_matrix_scale(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    mean, std = evaluation.whole_scale(items, ["l_quantity", "l_extendedprice"])
    return spark.createDataFrame([(round(mean, 5), round(std, 5))], "mean double, std double")


# ---- models -----------------------------------------------------------------------------------------


def _lines(spark, sf_dir):
    """One row per order line with a price to predict."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_id"), F.col("l_extendedprice").alias("y"),
        "l_quantity", "l_discount", "l_tax", F.concat(F.lit("district_"), (F.col("l_suppkey") % 13 + 1).cast("string")).alias("DISTRICT"),
        (F.col("l_returnflag") == "R").cast("int").alias("flag_R"), (F.col("l_returnflag") == "A").cast("int").alias("flag_A"))


_FEATURES = ["l_quantity", "l_discount", "l_tax", "flag_R", "flag_A"]
_LINES = ("SELECT l_orderkey * 10 + l_linenumber AS id, l_extendedprice AS y, l_quantity AS x, "
          "'district_' || (l_suppkey % 13 + 1) AS district FROM lineitem")


def _leave_out_sql(fold: str) -> str:
    """Predictions of a line fitted on every other fold, from sums per fold."""
    return f"""
l AS (SELECT *, {fold} AS fold FROM ({_LINES})),
s AS (SELECT fold, count(*) n, sum(x) sx, sum(y) sy, sum(x * x) sxx, sum(x * y) sxy FROM l GROUP BY 1),
t AS (SELECT sum(n) n, sum(sx) sx, sum(sy) sy, sum(sxx) sxx, sum(sxy) sxy FROM s),
o AS (SELECT fold, t.n - s.n n, t.sx - s.sx sx, t.sy - s.sy sy, t.sxx - s.sxx sxx, t.sxy - s.sxy sxy FROM s, t),
b AS (SELECT fold, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope, n, sx, sy FROM o),
p AS (SELECT l.*, (sy - slope * sx) / n + slope * x AS p FROM l JOIN b USING (fold)),
m AS (SELECT fold, count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse,
  avg(abs((y - p) / y)) * 100 AS mape, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 FROM p GROUP BY fold)"""


_LONG = " UNION ALL ".join(f"SELECT n, '{m}' AS measure, {m} AS v FROM m" for m in metrics.MEASURES)
_RANDOM = _leave_out_sql(f"CAST({_part('id', 5)} AS VARCHAR)")
_BY_DISTRICT = _leave_out_sql("district")
DISTRICTS = [f"district_{i}" for i in range(1, 14)]


@query("linear_regression", f"""
SELECT round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 3) AS intercept FROM ({_LINES})""")
def linear_regression(spark, sf_dir):
    rows = evaluation.assembled(_lines(spark, sf_dir).select("y", "l_quantity"), ["l_quantity"])
    model = evaluation.linear()(rows).fit(rows)
    row = (round(float(model.coefficients[0]), 4), round(model.intercept, 3))
    return spark.createDataFrame([row], "slope double, intercept double")


@query("ridge_regression", f"""
SELECT round(slope, 4) AS slope, round(my - slope * mx, 3) AS intercept FROM
 (SELECT covar_pop(y, x) * count(*) / (var_pop(x) * count(*) + 5000) AS slope, avg(y) AS my, avg(x) AS mx FROM ({_LINES}))""")
def ridge_regression(spark, sf_dir):
    rows = evaluation.assembled(_lines(spark, sf_dir).select("y", "l_quantity"), ["l_quantity"])
    model = evaluation.ridge(5000.0)(rows).fit(rows)
    row = (round(float(model.coefficients[0]), 4), round(model.intercept, 3))
    return spark.createDataFrame([row], "slope double, intercept double")


@query("lasso_regression", f"""
SELECT round(slope, 1) AS slope, round(my - slope * mx, 0) AS intercept FROM
 (SELECT (covar_pop(y, x) - 900) / var_pop(x) AS slope, avg(y) AS my, avg(x) AS mx FROM ({_LINES}))""")
def lasso_regression(spark, sf_dir):
    rows = evaluation.assembled(_lines(spark, sf_dir).select("y", "l_quantity"), ["l_quantity"])
    model = evaluation.lasso(900.0)(rows).fit(rows)
    row = (round(float(model.coefficients[0]), 1), float(round(model.intercept)))
    return spark.createDataFrame([row], "slope double, intercept double")


@query("cross_validation", f"""
WITH {_RANDOM} SELECT fold, n, round(mae, 3) AS mae, round(rmse, 3) AS rmse, round(mape, 3) AS mape, round(r2, 5) + 0e0 AS r2 FROM m""")
def cross_validation(spark, sf_dir):
    per_fold, _ = evaluation.cross_validation(_lines(spark, sf_dir), evaluation.linear(), ["l_quantity"])
    return per_fold.select("fold", "n", *[F.round(c, 3).alias(c) for c in ("mae", "rmse", "mape")], (F.round("r2", 5) + 0.0).alias("r2"))


@query("cross_validation_summary", f"""
WITH {_RANDOM} SELECT measure, round(avg(v), 3) + 0e0 AS mean, round(stddev_pop(v), 3) + 0e0 AS std FROM ({_LONG}) GROUP BY 1""")
def cross_validation_summary(spark, sf_dir):
    _, summary = evaluation.cross_validation(_lines(spark, sf_dir), evaluation.linear(), ["l_quantity"])
    return summary.select("measure", (F.round("mean", 3) + 0.0).alias("mean"), (F.round("std", 3) + 0.0).alias("std"))


@query("district_validation", f"""
WITH {_BY_DISTRICT} SELECT fold AS district, n, round(mae, 3) AS mae, round(rmse, 3) AS rmse, round(mape, 3) AS mape, round(r2, 5) + 0e0 AS r2 FROM m""")
def district_validation(spark, sf_dir):
    _, per_district, _, _ = evaluation.district_validation(_lines(spark, sf_dir), evaluation.linear(), ["l_quantity"], DISTRICTS)
    return per_district.select("district", "n", *[F.round(c, 3).alias(c) for c in ("mae", "rmse", "mape")], (F.round("r2", 5) + 0.0).alias("r2"))


@query("district_residuals", f"WITH {_BY_DISTRICT} SELECT id AS _id, round(p, 2) AS prediction, round(y - p, 2) AS error FROM p")
def district_residuals(spark, sf_dir):
    pred, _, _, _ = evaluation.district_validation(_lines(spark, sf_dir), evaluation.linear(), ["l_quantity"], DISTRICTS)
    return pred.select("_id", F.round("prediction", 2).alias("prediction"), F.round("error", 2).alias("error"))


@query("district_summary", f"""
WITH {_BY_DISTRICT}, l2 AS ({_LONG}), a AS (SELECT measure, sum(n * v) / sum(n) AS mean FROM l2 GROUP BY 1)
SELECT measure, round(mean, 3) + 0e0 AS mean, round(sqrt(sum(n * (v - mean) * (v - mean)) / sum(n)), 3) AS std
FROM l2 JOIN a USING (measure) GROUP BY measure, mean""")
def district_summary(spark, sf_dir):
    _, _, summary, _ = evaluation.district_validation(_lines(spark, sf_dir), evaluation.linear(), ["l_quantity"], DISTRICTS)
    return summary.select("measure", (F.round("mean", 3) + 0.0).alias("mean"), (F.round("std", 3) + 0.0).alias("std"))


@query("district_importance", f"""
WITH {_BY_DISTRICT} SELECT 'l_quantity' AS feature, round(sum(slope * m.n) / sum(m.n), 3) AS importance FROM b JOIN m USING (fold)""")
def district_importance(spark, sf_dir):
    _, _, _, importance = evaluation.district_validation(_lines(spark, sf_dir), evaluation.linear(), ["l_quantity"], DISTRICTS)
    return importance.select("feature", F.round("importance", 3).alias("importance"))


@query("quadrant_validation", f"""
WITH h AS (SELECT house_id AS id, price AS y, lat AS x, lat, lon FROM ({HOUSES})), g AS (SELECT median(lat) la, median(lon) lo FROM h),
{_leave_out_sql("CASE WHEN lat >= la AND lon >= lo THEN '1' WHEN lat >= la THEN '2' WHEN lon < lo THEN '3' ELSE '4' END").replace(
    f"FROM ({_LINES})", "FROM h, g")}
SELECT fold, n, round(mae, 2) AS mae, round(rmse, 2) AS rmse FROM m""")
def quadrant_validation(spark, sf_dir):
    rows = folds.quadrant_folds(inputs.houses(spark, sf_dir).withColumn("y", F.col("price")))
    pred, _ = evaluation.leave_one_out(rows, ["1", "2", "3", "4"], evaluation.linear(), ["lat"], ["house_id"])
    return metrics.measures(pred, ["fold"]).select("fold", "n", F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"))


@query("standardized_lasso")
def standardized_lasso(spark, sf_dir):
    _, per_district, _, _ = evaluation.district_validation(
        _lines(spark, sf_dir), evaluation.lasso(0.2), _FEATURES, DISTRICTS, standardize=True)
    return per_district


@query("boosted_trees")
def boosted_trees(spark, sf_dir):
    rows = evaluation.assembled(_lines(spark, sf_dir), _FEATURES)
    held = folds.part_of("_id", 4) == 0
    model = evaluation.fitted(evaluation.boosted_trees(rounds=5, depth=3), rows.filter(~held))
    return metrics.measures(model.transform(rows.filter(held)))


@query("boosted_stump", f"""
WITH l AS (SELECT l_linenumber AS x, l_extendedprice AS y FROM lineitem), v AS (SELECT DISTINCT x AS cut FROM l),
s AS (SELECT cut, avg(y) FILTER (WHERE x <= cut) AS low, avg(y) FILTER (WHERE x > cut) AS high,
  var_pop(y) FILTER (WHERE x <= cut) * count(*) FILTER (WHERE x <= cut) + var_pop(y) FILTER (WHERE x > cut) * count(*) FILTER (WHERE x > cut) AS loss
  FROM l, v GROUP BY cut HAVING count(*) FILTER (WHERE x > cut) > 0),
b AS (SELECT * FROM s ORDER BY loss LIMIT 1)
SELECT x, round(CASE WHEN x <= cut THEN low ELSE high END, 3) AS prediction FROM (SELECT DISTINCT x FROM l), b""")
def boosted_stump(spark, sf_dir):
    """One round of boosting with trees of depth one: the best cut, and the mean label on either side."""
    rows = evaluation.assembled(table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("x"), F.col("l_extendedprice").alias("y")), ["x"])
    model = evaluation.fitted(evaluation.boosted_trees(rounds=1, depth=1), rows)
    return model.transform(rows.select("x", "features").distinct()).select("x", F.round("prediction", 3).alias("prediction"))


@query("feature_sets")
def feature_sets(spark, sf_dir):
    groups = {"S": ["l_quantity"], "D": ["l_discount"], "C": ["l_tax"], "T": ["flag_R", "flag_A"]}
    lines = _lines(spark, sf_dir)
    summaries = {
        name: evaluation.cross_validation(lines, evaluation.linear(), evaluation.feature_set(groups, name), k=2)[1]
        for name in evaluation.FEATURE_SETS}
    return metrics.results_table(summaries)


@query("feature_elimination")
def feature_elimination(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    best, history = evaluation.eliminate_features(
        lines, evaluation.boosted_trees(rounds=3, depth=3), _FEATURES, step=2, k=2)
    rows = [(size, float(rmse), size == len(best)) for size, rmse in history]
    return spark.createDataFrame(rows, "features int, rmse double, best boolean")


def _text_table(spark, sf_dir):
    """Houses with a text vector, and the terms in vector order."""
    features, _, positions = text_features(spark, sf_dir, 6500.0)
    names = [r["term"] for r in positions.orderBy("position").collect()]  # the vocabulary, cut by document frequency
    # the quadrants of the houses that have a vector, without working the vectors out for each scan
    homes = inputs.houses(spark, sf_dir).select("house_id", "lat", "lon", F.col("price").alias("y"))
    table_ = write_once(homes.join(terms.as_ml_vectors(features), "house_id"), "text")
    return folds.quadrant_folds(table_), names


@query("text_model")
def text_model(spark, sf_dir):
    """Structured and text features together, leave one quadrant out."""
    rows, names = _text_table(spark, sf_dir)
    pred, _ = evaluation.leave_one_out(
        rows, ["1", "2", "3", "4"], evaluation.ridge(1000.0), ["lat", "text_vec"], ["house_id"],
        vector_names={"text_vec": names})
    return metrics.measures(pred, ["fold"])


@query("text_model_importance")
def text_model_importance(spark, sf_dir):
    rows, names = _text_table(spark, sf_dir)
    pred, importance = evaluation.leave_one_out(
        rows, ["1", "2", "3", "4"], evaluation.ridge(1000.0), ["lat", "text_vec"], ["house_id"],
        vector_names={"text_vec": names})
    weighted = evaluation.weighted_importance(importance, metrics.measures(pred, ["fold"]))
    return ordering.top(weighted.filter("feature <> 'lat'"), "importance", 15, "feature")


# ---- importance tables ------------------------------------------------------------------------------

_IMPORTANCE = "SELECT p_name || '_' || p_brand AS feature, p_brand AS grp, sum(p_size - 25) AS importance FROM part GROUP BY 1, 2"


def _importance(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(
        F.concat_ws("_", "p_name", "p_brand").alias("feature"), F.col("p_brand").alias("feature_group")).agg(
        F.sum(F.col("p_size") - 25).alias("importance"))


@query("group_importance", """
SELECT CASE p_type WHEN 'PROMO' THEN 'text' WHEN 'SMALL' THEN 'municipality' ELSE 'structured' END AS feature_group,
  sum(p_size)::BIGINT AS importance FROM part GROUP BY 1""")
def group_importance(spark, sf_dir):
    by_type = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("feature")).agg(F.sum("p_size").alias("importance"))
    groups = {t: {"PROMO": "text", "SMALL": "municipality"}.get(t, "structured")
              for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")}
    return evaluation.group_importance(by_type, groups)


@query("top_importance", f"SELECT feature, CAST(importance AS BIGINT) AS importance FROM ({_IMPORTANCE}) ORDER BY 2 DESC, 1 LIMIT 15")
def top_importance(spark, sf_dir):
    return ordering.top(_importance(spark, sf_dir).select("feature", "importance"), "importance", 15, "feature")


@query("positive_coefficients", f"SELECT feature, CAST(importance AS BIGINT) AS importance FROM ({_IMPORTANCE}) WHERE importance > 0")
def positive_coefficients(spark, sf_dir):
    return evaluation.coefficient_filter(_importance(spark, sf_dir).select("feature", "importance"))


@query("zero_coefficients", f"""
SELECT count(*) AS coefficients, count(*) FILTER (WHERE importance = 0) AS zero, count(*) FILTER (WHERE importance <> 0) AS non_zero FROM ({_IMPORTANCE})""")
def zero_coefficients(spark, sf_dir):
    return evaluation.zero_counts(_importance(spark, sf_dir))
