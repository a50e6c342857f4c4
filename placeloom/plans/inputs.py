"""Houses, points, articles and markup derived from the test tables, in Spark and in SQL.

The test tables hold no coordinates and no markup, so both follow from keys by integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.plans.registry import table


def _lat(key: Column, a: int, b: int) -> Column:
    return 40.0003 + ((key * a + b) % 870) / F.lit(1000.0) + (key % 97) * F.lit(0.00000137)


def _lon(key: Column, a: int, b: int) -> Column:
    return -80.5497 + ((key * a + b) % 1050) / F.lit(1000.0) + (key % 89) * F.lit(0.00000113)


def _sql_point(key: str, a: int, b: int, c: int, d: int) -> str:
    return (f"40.0003e0 + (({key} * {a} + {b}) % 870) / 1000e0 + ({key} % 97) * 0.00000137e0 AS lat, "
            f"-80.5497e0 + (({key} * {c} + {d}) % 1050) / 1000e0 + ({key} % 89) * 0.00000113e0 AS lon")


def houses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("house_id"), _lat(k, 7919, 0).alias("lat"), _lon(k, 104729, 0).alias("lon"),
        F.concat(F.lit("district_"), (F.col("c_nationkey") % 13 + 1).cast("string")).alias("district"),
        F.col("c_acctbal").alias("price"), F.col("c_mktsegment").alias("segment"))


HOUSES = (f"SELECT c_custkey AS house_id, {_sql_point('c_custkey', 7919, 0, 104729, 0)}, "
          "'district_' || (c_nationkey % 13 + 1) AS district, c_acctbal AS price, c_mktsegment AS segment FROM customer")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("point_id"), F.concat(F.lit("cat_"), (F.col("s_nationkey") % 5).cast("string")).alias("category"),
        _lat(k, 6007, 137).alias("lat"), _lon(k, 50021, 77).alias("lon"))


POINTS = (f"SELECT s_suppkey AS point_id, 'cat_' || (s_nationkey % 5) AS category, "
          f"{_sql_point('s_suppkey', 6007, 137, 50021, 77)} FROM supplier")
POINT_CATEGORIES = [f"cat_{i}" for i in range(5)]


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        k.alias("article_id"), _lat(k, 3571, 41).alias("lat"), _lon(k, 20011, 13).alias("lon"), "text", "lang", "source")


ARTICLES = (f"SELECT doc_id AS article_id, {_sql_point('doc_id', 3571, 41, 20011, 13)}, text, lang, source "
            "FROM documents")


def doc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        k.alias("article_id"), _lat(k, 3571, 41).alias("lat"), _lon(k, 20011, 13).alias("lon"),
        F.col("embedding").alias("vec"), "label")


DOC_VECTORS = (f"SELECT vec_id AS article_id, {_sql_point('vec_id', 3571, 41, 20011, 13)}, embedding AS vec, label "
               "FROM embeddings")


def near_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in clumps: some share a place, some lie a few metres apart."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("point_id"), F.col("p_brand").alias("category"),
        (40.1 + ((k * 31) % 61) * F.lit(0.0011) + (k % 3) * F.lit(0.00005)).alias("lat"),
        (-80.2 + ((k * 17) % 7) * F.lit(0.0013) + (k % 2) * F.lit(0.00003)).alias("lon"))


NEAR_POINTS = ("SELECT p_partkey AS point_id, p_brand AS category, "
               "40.1e0 + ((p_partkey * 31) % 61) * 0.0011e0 + (p_partkey % 3) * 0.00005e0 AS lat, "
               "-80.2e0 + ((p_partkey * 17) % 7) * 0.0013e0 + (p_partkey % 2) * 0.00003e0 AS lon FROM part")

# ---- markup -----------------------------------------------------------------------------------------
# Eight forms by doc_id % 8; the coordinate each one holds is known from the key.

_MINUTES, _WEST = "(id * 7) % 52", "(id * 11) % 29 + 30"


def _expr(sql: str) -> Column:
    return F.expr(sql.replace("id", "doc_id"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, title, text)``: documents wrapped in a coordinate tag, an infobox, links and categories."""
    m, w = _expr(_MINUTES).cast("string"), _expr(_WEST).cast("string")
    i = F.col("doc_id").cast("string")
    lat = F.concat(F.lit("40."), F.lpad(_expr("(id * 13) % 87").cast("string"), 2, "0"))
    lon = F.concat(F.lit("-79."), F.lpad(_expr("(id * 17) % 49 + 50").cast("string"), 2, "0"))
    form = F.col("doc_id") % 8
    tag = (
        F.when(form == 0, F.concat(F.lit("{{Coord|40|"), m, F.lit("|N|79|"), w, F.lit("|W|display=title}}")))
        .when(form == 1, F.concat(F.lit("{{coord|40|"), m, F.lit("|30|N|79|"), w, F.lit("|15|W|region:US}}")))
        .when(form == 2, F.concat(F.lit("{{coord|"), lat, F.lit("|"), lon, F.lit("|source:x}}")))
        .when(form == 3, F.concat(F.lit("{{coord|display=inline|\n "), lat, F.lit(" || "), lon, F.lit("|{{a|b}}}}")))
        .when(form == 4, F.lit("{{coord |40|N|80|W}}"))
        .when(form == 5, F.lit("no tag"))
        .when(form == 6, F.concat(F.lit("{{coord|30|"), m, F.lit("|S|79|"), w, F.lit("|W|scale:5}}")))
        .otherwise(F.concat(F.lit("{{coord|bad}} {{coord|"), lat, F.lit("|"), lon, F.lit("|name=q}}")))
    )
    box = F.concat(
        F.lit("{{Infobox place\n| name = Place "), i, F.lit("\n| kind = [[town|Town "), (F.col("doc_id") % 5).cast("string"),
        F.lit("]]\n| empty = \n| area = {{convert|5|km}} "), (F.col("doc_id") % 9).cast("string"), F.lit("\n}}\n"))
    links = F.concat(
        F.lit("\n[[Category:"), F.element_at(F.array(*map(F.lit, CATEGORY_LINKS)), (F.col("doc_id") % 6 + 1).cast("int")),
        F.lit("]]\n[[River "), (F.col("doc_id") % 4).cast("string"), F.lit("|the river]] [http://x.org/"), i,
        F.lit(" site] <!-- note -->"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("Page "), i).alias("title"),
        F.concat(F.when(F.col("doc_id") % 3 > 0, box).otherwise(""), tag, F.lit("\n"), "text", links).alias("text"))


CATEGORY_LINKS = ["Airports in Pennsylvania", "Historic Bridges", "Public libraries", "Rivers of Ohio", "Golf courses",
                  "Washington, Pennsylvania"]
_LINK_LIST = ", ".join(f"'{c}'" for c in CATEGORY_LINKS)

# one row per document: the coordinate its page holds (first template only), NULL when unreadable
PAGE_FACTS = f"""
SELECT doc_id, 'Page ' || doc_id AS title, text AS body,
  CASE WHEN doc_id % 8 = 0 THEN 40 + ((doc_id * 7) % 52) / 60e0
       WHEN doc_id % 8 = 1 THEN 40 + ((doc_id * 7) % 52) / 60e0 + 30 / 3600e0
       WHEN doc_id % 8 IN (2, 3) THEN ('40.' || lpad(CAST((doc_id * 13) % 87 AS VARCHAR), 2, '0'))::DOUBLE
       WHEN doc_id % 8 = 6 THEN -(30 + ((doc_id * 7) % 52) / 60e0) END AS lat,
  CASE WHEN doc_id % 8 IN (0, 6) THEN -(79 + ((doc_id * 11) % 29 + 30) / 60e0)
       WHEN doc_id % 8 = 1 THEN -(79 + ((doc_id * 11) % 29 + 30) / 60e0 + 15 / 3600e0)
       WHEN doc_id % 8 IN (2, 3) THEN ('-79.' || lpad(CAST((doc_id * 17) % 49 + 50 AS VARCHAR), 2, '0'))::DOUBLE END AS lon,
  ([{_LINK_LIST}])[(doc_id % 6 + 1)::INT] AS category
FROM documents"""
IN_COUNTY = "lat > 40.0 AND lat < 40.87 AND lon > -80.55 AND lon < -79.5"

# ---- distance in SQL --------------------------------------------------------------------------------


def sql_distance(pairs: str, keep: str, rounds: int = 6) -> str:
    """``keep`` and the geodesic ``d`` (metres) of the rows of ``pairs`` with ``lat, lon, lat2, lon2``."""
    f, b = "(1 / 298.257223563e0)", "(6378137e0 * (1 - 1 / 298.257223563e0))"
    sql = (f"SELECT {keep}, atan((1 - {f}) * tan(radians(lat))) u1, atan((1 - {f}) * tan(radians(lat2))) u2, "
           f"radians(lon2 - lon) l FROM ({pairs})")
    sql = f"SELECT {keep}, sin(u1) s1, cos(u1) c1, sin(u2) s2, cos(u2) c2, l, l AS lam FROM ({sql})"
    base = f"{keep}, s1, c1, s2, c2, l"
    for _ in range(rounds):
        sql = f"SELECT {base}, sin(lam) sl, cos(lam) cl FROM ({sql})"
        sql = (f"SELECT {base}, sl, sqrt((c2*sl)*(c2*sl) + (c1*s2 - s1*c2*cl)*(c1*s2 - s1*c2*cl)) ss, "
               f"s1*s2 + c1*c2*cl cs FROM ({sql})")
        sql = f"SELECT {base}, ss, cs, atan2(ss, cs) sg, CASE WHEN ss = 0 THEN 0 ELSE c1*c2*sl/ss END sa FROM ({sql})"
        sql = f"SELECT {base}, ss, cs, sg, sa, 1 - sa*sa ca FROM ({sql})"
        sql = (f"SELECT {base}, ss, cs, sg, sa, ca, CASE WHEN ca = 0 THEN 0 ELSE cs - 2*s1*s2/ca END cm, "
               f"{f}/16*ca*(4 + {f}*(4 - 3*ca)) k FROM ({sql})")
        sql = (f"SELECT {base}, ss, cs, sg, ca, cm, "
               f"l + (1 - k)*{f}*sa*(sg + k*ss*(cm + k*cs*(2*cm*cm - 1))) lam FROM ({sql})")
    sql = f"SELECT {keep}, ss, cs, sg, cm, ca * (6378137e0*6378137e0 - {b}*{b}) / ({b}*{b}) q FROM ({sql})"
    sql = (f"SELECT {keep}, ss, cs, sg, cm, 1 + q/16384*(4096 + q*(-768 + q*(320 - 175*q))) a, "
           f"q/1024*(256 + q*(-128 + q*(74 - 47*q))) bb FROM ({sql})")
    return (f"SELECT {keep}, {b}*a*(sg - bb*ss*(cm + bb/4*(cs*(2*cm*cm - 1) "
            f"- bb/6*cm*(4*ss*ss - 3)*(4*cm*cm - 3)))) d FROM ({sql})")


def sql_house_pairs(other: str, keep: str) -> str:
    """Distances of all houses to all rows of ``other``."""
    cols = ", ".join(f"o.{c}" for c in keep.split(", "))
    pairs = f"SELECT h.house_id, h.lat, h.lon, {cols}, o.lat lat2, o.lon lon2 FROM ({HOUSES}) h, ({other}) o"
    return sql_distance(pairs, f"house_id, {keep}")
