"""Projections, filters, recodes, lookups and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeloom.functions import clean
from placeloom.operators import cleaning, metrics, ordering, profiling
from placeloom.plans import inputs
from placeloom.plans.registry import query, table

# ---- columns ----------------------------------------------------------------------------------------


@query("projection", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")
def projection(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")


@query("column_drop", "SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority FROM orders")
def column_drop(spark, sf_dir):
    return cleaning.drop_columns(table(spark, sf_dir, "orders"), ["o_totalprice", "o_orderstatus"])


@query("column_pattern", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem")
def column_pattern(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    wanted = [*cleaning.columns_like(items, having="key"), *cleaning.columns_like(items, "number", "key")]
    return items.select(*wanted)


@query("feature_groups", """
SELECT 'measures' AS feature_group, 4 AS columns, round(sum(l_quantity + l_extendedprice + l_discount + l_tax), 2) AS total
FROM lineitem UNION ALL SELECT 'keys', 2, round(sum(l_partkey + l_suppkey), 2) FROM lineitem""")
def feature_groups(spark, sf_dir):
    groups = {"measures": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "keys": ["l_partkey", "l_suppkey"]}
    sums = table(spark, sf_dir, "lineitem").agg(*[
        F.round(F.sum(sum(F.col(c) for c in cols)).cast("double"), 2).alias(name) for name, cols in groups.items()])
    sizes = F.create_map(*[x for name, cols in groups.items() for x in (F.lit(name), F.lit(len(cols)))])
    return sums.unpivot([], list(groups), "feature_group", "total").select(
        "feature_group", sizes[F.col("feature_group")].alias("columns"), "total")


@query("rename_columns", "SELECT doc_id AS article_id, lang AS language, n_chars AS text_length FROM documents")
def rename_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return docs.withColumnsRenamed({"doc_id": "article_id", "lang": "language", "n_chars": "text_length"})


# ---- filters ----------------------------------------------------------------------------------------

_OWNER = "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END"


def _owners(spark, sf_dir):
    return table(spark, sf_dir, "customer").withColumn("owner", F.expr(_OWNER))


@query("null_safe_difference", f"""
SELECT c_custkey, {_OWNER} AS owner FROM customer
WHERE c_nationkey < 12 AND ({_OWNER}) IS DISTINCT FROM 'BUILDING'""")
def null_safe_difference(spark, sf_dir):
    kept = _owners(spark, sf_dir).filter((F.col("c_nationkey") < 12) & clean.differs(F.col("owner"), "BUILDING"))
    return kept.select("c_custkey", "owner")


@query("numeric_ranges", """
SELECT o_orderkey, year(o_orderdate) AS year FROM orders
WHERE o_totalprice < 300000 AND o_totalprice > 10000 AND year(o_orderdate) BETWEEN 1995 AND 2000""")
def numeric_ranges(spark, sf_dir):
    price = F.col("o_totalprice")
    kept = table(spark, sf_dir, "orders").filter((price < 300000) & (price > 10000))
    return kept.filter(F.year("o_orderdate").between(1995, 2000)).select(
        "o_orderkey", F.year("o_orderdate").alias("year"))


@query("category_rules", f"""
SELECT c_custkey, owner FROM (SELECT *, {_OWNER} AS owner FROM customer)
WHERE c_nationkey IN (1, 2, 3, 4, 5, 6, 7, 8) AND (owner IS NULL OR owner NOT IN ('MACHINERY', 'FURNITURE'))""")
def category_rules(spark, sf_dir):
    kept = _owners(spark, sf_dir).filter(F.col("c_nationkey").isin(list(range(1, 9))))
    return kept.filter(clean.none_of(F.col("owner"), ["MACHINERY", "FURNITURE"])).select("c_custkey", "owner")


@query("not_in_list", "SELECT p_partkey, p_type FROM part WHERE p_type NOT IN ('PROMO', 'SMALL')")
def not_in_list(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return parts.filter(~F.col("p_type").isin("PROMO", "SMALL")).select("p_partkey", "p_type")


@query("rare_categories", """
SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY 1 HAVING count(*) >= 30)""")
def rare_categories(spark, sf_dir):
    return cleaning.keep_frequent(table(spark, sf_dir, "part"), "p_name", 30).select("p_partkey", "p_name")


_BLANKS = ("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '   ' WHEN c_custkey % 11 = 0 THEN '' ELSE c_mktsegment END "
           "AS segment, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END AS name, "
           "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END AS balance FROM customer")
_NULLED = ("SELECT c_custkey, CASE WHEN regexp_matches(segment, '^\\s*$') THEN NULL ELSE segment END AS segment, "
           f"CASE WHEN regexp_matches(name, '^\\s*$') THEN NULL ELSE name END AS name, balance FROM ({_BLANKS})")


def _nulled(spark, sf_dir):
    k = F.col("c_custkey")
    raw = table(spark, sf_dir, "customer").select(
        k, F.when(k % 7 == 0, "   ").when(k % 11 == 0, "").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(k % 3 == 0, " ").otherwise(F.col("c_name")).alias("name"),
        F.when(k % 13 != 0, F.col("c_acctbal")).alias("balance"))
    return cleaning.blank_strings_to_null(raw)


@query("blank_to_null", _NULLED)
def blank_to_null(spark, sf_dir):
    return _nulled(spark, sf_dir)


@query("drop_nulls", f"SELECT * FROM ({_NULLED}) WHERE segment IS NOT NULL AND name IS NOT NULL AND balance IS NOT NULL")
def drop_nulls(spark, sf_dir):
    return _nulled(spark, sf_dir).na.drop("any")


@query("null_profile", f"""
WITH t AS ({_NULLED}) SELECT 'c_custkey' AS "column", count(*) FILTER (WHERE c_custkey IS NULL) AS missing FROM t
UNION ALL SELECT 'segment', count(*) FILTER (WHERE segment IS NULL) FROM t
UNION ALL SELECT 'name', count(*) FILTER (WHERE name IS NULL) FROM t
UNION ALL SELECT 'balance', count(*) FILTER (WHERE balance IS NULL) FROM t""")
def null_profile(spark, sf_dir):
    return profiling.null_profile(_nulled(spark, sf_dir))


@query("step_counts", f"""
WITH t AS ({_NULLED}), c AS (SELECT count(*) AS n0, count(*) FILTER (WHERE segment IS NOT NULL) AS n1,
  count(*) FILTER (WHERE segment IS NOT NULL AND balance > 1000) AS n2 FROM t)
SELECT 1 AS step, 'segment' AS name, n0 AS rows_before, n1 AS rows_after, n0 - n1 AS removed FROM c
UNION ALL SELECT 2, 'balance', n1, n2, n1 - n2 FROM c""")
def step_counts(spark, sf_dir):
    return cleaning.step_counts(_nulled(spark, sf_dir), {
        "segment": F.col("segment").isNotNull(), "balance": F.col("balance") > 1000})


@query("row_shuffle", """
SELECT row_number() OVER (ORDER BY md5('42:' || c_custkey), c_custkey) - 1 AS position, c_custkey FROM customer""")
def row_shuffle(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select("c_custkey", ordering.shuffle_key("c_custkey").alias("_k"))
    return ordering.numbered(keys, ["_k", "c_custkey"]).select("position", "c_custkey")


@query("peek", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def peek(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(10)


@query("sample_slice", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 190")
def sample_slice(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey").offset(190).limit(10)


@query("constant_fill", """
SELECT c_custkey, coalesce(max(o_totalprice), 99999) AS largest, count(o_orderkey) AS orders
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1""")
def constant_fill(spark, sf_dir):
    open_orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(
        F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("largest"), F.count("*").alias("orders"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(open_orders, "c_custkey", "left").select(
        "c_custkey", F.coalesce("largest", F.lit(99999.0)).alias("largest"),
        F.coalesce("orders", F.lit(0).cast("long")).alias("orders"))


# ---- recodes ----------------------------------------------------------------------------------------


@query("municipality_names", """
SELECT c_custkey, replace(left(raw, length(raw) - 2), '  ', ' ') AS name
FROM (SELECT c_custkey, replace(c_name, '#', '  ') || '  ' AS raw FROM customer)""")
def municipality_names(spark, sf_dir):
    raw = F.concat(F.replace(F.col("c_name"), F.lit("#"), F.lit("  ")), F.lit("  "))
    return table(spark, sf_dir, "customer").select("c_custkey", clean.municipality(raw).alias("name"))


@query("sale_year", """
SELECT o_orderkey, year(o_orderdate)::INTEGER AS year, CAST(year(o_orderdate) AS VARCHAR) AS year_text FROM orders""")
def sale_year(spark, sf_dir):
    text = F.date_format("o_orderdate", "MM-dd-yyyy")
    year = clean.sale_year(text)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", year.alias("year"), year.cast("string").alias("year_text"))


@query("remove_blanks", "SELECT p_partkey, replace(p_name, ' ', '') AS name FROM part")
def remove_blanks(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", clean.no_blanks(F.col("p_name")).alias("name"))


_CONDITIONS = ["GOOD", "VERY GOOD", "AVERAGE", "VERY POOR", "UNSOUND", "FAIR", "POOR"]
_CONDITION_SQL = ("SELECT p_partkey, (p_partkey % 8 + 1)::DOUBLE AS code, (["
                  + ", ".join(f"'{c}'" for c in _CONDITIONS) + "])[(p_partkey % 7 + 1)::INT] AS description FROM part")


@query("condition_scale", f"""
SELECT p_partkey, CASE description WHEN 'VERY GOOD' THEN 2 WHEN 'VERY POOR' THEN 7 WHEN 'UNSOUND' THEN 8
  ELSE CASE WHEN code BETWEEN 2 AND 6 THEN code + 1 ELSE code END END::DOUBLE AS condition FROM ({_CONDITION_SQL})""")
def condition_scale(spark, sf_dir):
    k = F.col("p_partkey")
    described = F.element_at(F.array(*map(F.lit, _CONDITIONS)), (k % 7 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        k, clean.condition_scale((k % 8 + 1).cast("double"), described).alias("condition"))


@query("ordinal_scale", """
SELECT o_orderkey, CASE grade WHEN 'A+' THEN '7' WHEN 'B-' THEN '12' WHEN 'E-' THEN '21' WHEN 'XX' THEN '2' ELSE grade END AS grade,
  CASE cdu WHEN 'EX' THEN '1' WHEN 'UN' THEN '8' ELSE cdu END AS cdu
FROM (SELECT o_orderkey, (['A+', 'B-', 'E-', 'XX', 'other'])[(o_orderkey % 5 + 1)::INT] AS grade,
  (['EX', 'UN', 'ZZ'])[(o_orderkey % 3 + 1)::INT] AS cdu FROM orders)""")
def ordinal_scale(spark, sf_dir):
    k = F.col("o_orderkey")
    grade = F.element_at(F.array(*map(F.lit, ["A+", "B-", "E-", "XX", "other"])), (k % 5 + 1).cast("int"))
    cdu = F.element_at(F.array(*map(F.lit, ["EX", "UN", "ZZ"])), (k % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        k, clean.scale(grade, clean.GRADE_SCALE).alias("grade"), clean.scale(cdu, clean.CDU_SCALE).alias("cdu"))


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("one_hot", "SELECT p_partkey, " + ", ".join(
    f"CAST(p_type = '{t}' AS INTEGER) AS p_type_{t}" for t in _TYPES) + " FROM part")
def one_hot(spark, sf_dir):
    return cleaning.one_hot(table(spark, sf_dir, "part").select("p_partkey", "p_type"), ["p_type", "p_type"])


@query("label_transform", """
SELECT o_orderkey, round(ln(1 + o_totalprice) - 9.4, 6) AS label, round(exp(ln(1 + o_totalprice) - 9.4 + 9.4) - 1, 2) AS back,
  least(greatest(o_totalprice, 10000), 400000) AS clipped FROM orders""")
def label_transform(spark, sf_dir):
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.round(clean.log_label(price), 6).alias("label"),
        F.round(clean.unlog_label(clean.log_label(price)), 2).alias("back"),
        clean.clip(price, 10000.0, 400000.0).alias("clipped"))


@query("half_even_rounding", """
SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS half FROM lineitem""")
def half_even_rounding(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", clean.half_even(F.col("l_quantity") / 2).cast("long").alias("half"))


@query("clean_houses", """
SELECT c_custkey AS "_id", 'district_' || (c_nationkey % 13 + 1) AS "DISTRICT", 2013 + c_custkey % 9 AS "SALEYEAR",
  CAST(CASE c_custkey % 7 WHEN 1 THEN 2 WHEN 3 THEN 7 WHEN 4 THEN 8
    ELSE CASE WHEN c_custkey % 8 + 1 BETWEEN 2 AND 6 THEN c_custkey % 8 + 2 ELSE c_custkey % 8 + 1 END END AS INTEGER) AS "CONDITION",
  CASE c_custkey % 3 WHEN 0 THEN '13' WHEN 1 THEN '14' ELSE '11' END AS "GRADE",
  CASE WHEN c_custkey % 2 = 0 THEN 'CentralHeat' ELSE 'CentralHeatwithAC' END AS "HEATINGCOOLINGDESC",
  CASE c_custkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '4' ELSE '8' END AS "CDU", CASE WHEN c_custkey % 3 = 0 THEN 'SPLITLEVEL' ELSE 'RANCH' END AS "STYLEDESC",
  CASE WHEN c_custkey % 5 = 2 THEN 'Stone' ELSE 'Brick' END AS "EXTFINISH_DESC"
FROM customer
WHERE c_custkey % 10 <> 9 AND (c_custkey % 6 <> 5) AND (c_custkey % 25) BETWEEN 1 AND 20 AND c_custkey % 5 >= 1
  AND c_custkey % 4 <> 3 AND c_acctbal > 1000 AND c_acctbal < 9000 AND 2013 + c_custkey % 9 BETWEEN 2015 AND 2020
  AND c_custkey % 12 <> 7 AND c_custkey % 23 <> 3 AND c_custkey % 31 <> 5 AND c_custkey % 29 <> 2 AND c_custkey % 37 <> 4 AND c_custkey % 41 <> 6
  AND c_custkey % 43 <> 7""")
def clean_houses(spark, sf_dir):
    k = F.col("c_custkey")
    raw = table(spark, sf_dir, "customer").select(
        k.alias("_id"), F.concat(F.lit("Town  "), (F.col("c_nationkey") % 13 + 1).cast("string"), F.lit("  ")).alias("MUNIDESC"),
        F.when(k % 10 == 9, "TWO FAMILY").otherwise("SINGLE FAMILY").alias("USEDESC"),
        F.when(k % 6 == 5, "CORPORATION").otherwise("REGULAR").alias("OWNERDESC"),
        (k % 25).cast("double").alias("TOTALROOMS"), (k % 5).cast("double").alias("BEDROOMS"),
        F.when(k % 4 == 3, "OTHER").otherwise("VALID SALE").alias("SALEDESC"),
        (F.col("c_acctbal") * 10).alias("SALEPRICE"), (F.col("c_acctbal") / 9000 * 1_000_000).alias("FAIRMARKETTOTAL"),
        F.concat(F.lit("01-05-"), (2013 + k % 9).cast("string")).alias("SALEDATE"),
        F.when(k % 31 == 5, "10 - Exempt").otherwise("20 - Taxable").alias("TAXDESC"), F.when(k % 29 == 2, 2.0).otherwise(1.0).alias("CARDNUMBER"),
        F.when(k % 43 == 7, "None").when(k % 2 == 0, "Central Heat").otherwise("Central Heat with AC").alias("HEATINGCOOLINGDESC"),
        F.when(k % 37 == 4, "LOG CABIN").when(k % 3 == 0, "SPLIT LEVEL").otherwise("RANCH").alias("STYLEDESC"),
        F.when(k % 41 == 6, "Log").when(k % 5 == 2, "Stone").otherwise("Brick").alias("EXTFINISH_DESC"),
        F.when(k % 12 == 7, "METAL").otherwise("SHINGLE").alias("ROOFDESC"),
        F.when(k % 23 == 3, "  ").otherwise("Full").alias("BASEMENTDESC"),
        (k % 8 + 1).cast("double").alias("CONDITION"),
        F.element_at(F.array(*map(F.lit, _CONDITIONS)), (k % 7 + 1).cast("int")).alias("CONDITIONDESC"),
        F.element_at(F.array(*map(F.lit, ["C+", "C", "B"])), (k % 3 + 1).cast("int")).alias("GRADE"),
        F.lit("x").alias("GRADEDESC"), F.when(k % 4 == 0, "EX").when(k % 4 == 1, "AV").otherwise("UN").alias("CDU"), F.lit("y").alias("CDUDESC"))
    towns = raw.select(F.regexp_extract("MUNIDESC", r"(\d+)", 1).alias("n")).distinct().select(
        F.concat(F.lit("Town "), "n").alias("municipality"), F.concat(F.lit("district_"), "n").alias("district"))
    kept = cleaning.clean_houses(raw, towns)
    return kept.select("_id", "DISTRICT", "SALEYEAR", F.col("CONDITION").cast("int").alias("CONDITION"), "GRADE",
                       "HEATINGCOOLINGDESC", "CDU", "STYLEDESC", "EXTFINISH_DESC")


@query("clean_points", f"""
SELECT point_id, name, category, lat, lon FROM (SELECT s.*, s_name AS name FROM ({inputs.POINTS}) s JOIN supplier ON s_suppkey = point_id)
WHERE point_id % 4 <> 1 AND lat > 40.0 AND lat < 40.87 AND lon > -80.55 AND lon < -79.5""")
def clean_points(spark, sf_dir):
    named = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point_id"), "s_name")
    p = inputs.points(spark, sf_dir).join(named, "point_id")
    raw = p.select(F.col("point_id").alias("_id"), F.when(F.col("point_id") % 4 != 1, F.col("s_name")).alias("name"),
                   F.col("category").alias("asset_type"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
                   F.lit("x").alias("other"))
    return cleaning.clean_points(raw)


# ---- lookups and joins ------------------------------------------------------------------------------


def _district_json(spark, sf_dir):
    """One row with a JSON dictionary from nation name to district."""
    entry = F.struct(F.col("n_name"), F.concat(F.lit("district_"), (F.col("n_nationkey") % 13 + 1).cast("string")))
    return table(spark, sf_dir, "nation").agg(
        F.to_json(F.map_from_entries(F.collect_list(entry))).alias("json"))


@query("json_dictionary", "SELECT n_name AS municipality, 'district_' || (n_nationkey % 13 + 1) AS district FROM nation")
def json_dictionary(spark, sf_dir):
    return cleaning.dictionary_table(_district_json(spark, sf_dir), "json", "municipality", "district")


@query("dictionary_lookup", """
SELECT c_custkey, 'district_' || (n_nationkey % 13 + 1) AS district FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def dictionary_lookup(spark, sf_dir):
    towns = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    houses = table(spark, sf_dir, "customer").join(towns, "c_nationkey")
    districts = cleaning.dictionary_table(_district_json(spark, sf_dir), "json", "municipality", "district")
    return cleaning.lookup(houses, districts, "n_name", "municipality", "district").select("c_custkey", "district")


@query("point_lookup", f"""
SELECT o_orderkey, round(lat, 6) AS lat, round(lon, 6) AS lon FROM orders JOIN ({inputs.HOUSES}) ON house_id = o_custkey""")
def point_lookup(spark, sf_dir):
    where = inputs.houses(spark, sf_dir).select(F.col("house_id").alias("o_custkey"), "lat", "lon")
    wanted = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return wanted.join(where, "o_custkey").select(
        "o_orderkey", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("natural_join", """
SELECT o_orderkey, o_orderpriority, n FROM orders JOIN
  (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def natural_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "inner").select("o_orderkey", "o_orderpriority", "n")


@query("outer_concat", """
WITH a AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_nationkey < 20 GROUP BY 1),
     b AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_nationkey > 3 GROUP BY 1)
SELECT k, customers, suppliers FROM a FULL OUTER JOIN b USING (k)""")
def outer_concat(spark, sf_dir):
    a = table(spark, sf_dir, "customer").filter("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("k")).agg(
        F.count("*").alias("customers"))
    b = table(spark, sf_dir, "supplier").filter("s_nationkey > 3").groupBy(F.col("s_nationkey").alias("k")).agg(
        F.count("*").alias("suppliers"))
    return a.join(b, "k", "full_outer")


@query("first_match_order", """
WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1)
SELECT c_custkey, -c_custkey AS position, o_orderkey FROM customer JOIN f ON o_custkey = c_custkey""")
def first_match_order(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select("c_custkey", (-F.col("c_custkey")).alias("position"))
    found = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return ordering.in_order_of(found, wanted, "c_custkey", "position", "o_orderkey")


@query("attach_coordinates", f"""
SELECT doc_id, quality, round(lat, 6) AS lat, round(lon, 6) AS lon FROM labels JOIN ({inputs.ARTICLES}) ON article_id = doc_id""")
def attach_coordinates(spark, sf_dir):
    where = inputs.articles(spark, sf_dir).select(F.col("article_id").alias("doc_id"), "lat", "lon")
    return table(spark, sf_dir, "labels").join(where, "doc_id").select(
        "doc_id", "quality", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


# ---- sets -------------------------------------------------------------------------------------------


@query("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return a.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("complement", f"SELECT house_id FROM ({inputs.HOUSES}) WHERE district <> 'district_3'")
def complement(spark, sf_dir):
    return inputs.houses(spark, sf_dir).filter(F.col("district") != "district_3").select("house_id")


@query("distinct_values", "SELECT DISTINCT o_orderpriority FROM orders")
def distinct_values(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderpriority").distinct()


@query("column_difference", """
WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS l_quantity, corr(l_discount, l_extendedprice) AS l_discount,
  corr(l_tax, l_extendedprice) AS l_tax, corr(l_suppkey, l_extendedprice) AS l_suppkey FROM lineitem)
SELECT feature, round(r, 6) AS r FROM (UNPIVOT c ON l_quantity, l_discount, l_tax INTO NAME feature VALUE r) WHERE abs(r) < 0.1""")
def column_difference(spark, sf_dir):
    from placeloom.operators.evaluation import dropped_features

    names = ["l_quantity", "l_discount", "l_tax", "l_suppkey"]
    items = table(spark, sf_dir, "lineitem")
    r = items.agg(*[F.corr(c, "l_extendedprice").alias(c) for c in names]).first()
    dropped = dropped_features(names, [c for c in names if abs(r[c]) >= 0.1], protect="key")
    return spark.createDataFrame([(c, r[c]) for c in dropped], "feature string, r double").select("feature", F.round("r", 6).alias("r"))


# ---- profiles ---------------------------------------------------------------------------------------


@query("value_counts", "SELECT owner, count(*) AS count FROM (SELECT " + _OWNER + """ AS owner FROM customer)
WHERE owner IS NOT NULL GROUP BY 1""")
def value_counts(spark, sf_dir):
    return profiling.value_counts(_owners(spark, sf_dir), "owner")


@query("pair_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY 1, 2")
def pair_counts(spark, sf_dir):
    return profiling.pair_counts(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("group_means", """
SELECT c_mktsegment, round(avg(c_acctbal), 4) AS c_acctbal, round(avg(c_nationkey), 4) AS c_nationkey FROM customer GROUP BY 1""")
def group_means(spark, sf_dir):
    means = profiling.group_means(table(spark, sf_dir, "customer"), "c_mktsegment", ["c_acctbal", "c_nationkey"])
    return means.select("c_mktsegment", *[F.round(c, 4).alias(c) for c in ("c_acctbal", "c_nationkey")])


def _describe_sql(t: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
        round(min({c})::DOUBLE, 4) AS min, round(quantile_cont({c}, 0.25)::DOUBLE, 4) AS p25,
        round(quantile_cont({c}, 0.5)::DOUBLE, 4) AS p50, round(quantile_cont({c}, 0.75)::DOUBLE, 4) AS p75,
        round(max({c})::DOUBLE, 4) AS max FROM {t}""" for c in columns)


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount"]


@query("describe", _describe_sql("lineitem", _MEASURES))
def describe(spark, sf_dir):
    found = profiling.describe(table(spark, sf_dir, "lineitem"), _MEASURES)
    return found.select("column", "count", *[F.round(c, 4).alias(c) for c in found.columns[2:]])


@query("correlation_shift", """
SELECT round(b, 6) AS corr_before, round(a, 6) AS corr_after, round(a - b, 6) AS shift FROM
 (SELECT corr(l_quantity, l_extendedprice) AS b, corr(l_quantity, l_extendedprice) FILTER (WHERE l_discount > 0.05) AS a FROM lineitem)""")
def correlation_shift(spark, sf_dir):
    one = profiling.correlation_shift(
        table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", F.col("l_discount") > 0.05)
    return one.select(*[F.round(c, 6).alias(c) for c in one.columns])


def _histogram_sql(bins: int) -> str:
    return f"""
WITH e AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / {bins} AS w FROM orders),
c AS (SELECT CAST(least(floor((o_totalprice - lo) / w), {bins - 1}) AS INTEGER) AS bin, count(*) AS n FROM orders, e GROUP BY 1)
SELECT b.bin, round(lo + b.bin * w, 4) AS low, round(lo + (b.bin + 1) * w, 4) AS high, coalesce(n, 0) AS count
FROM (SELECT CAST(unnest(range({bins})) AS INTEGER) AS bin) b CROSS JOIN e LEFT JOIN c ON c.bin = b.bin"""


@query("histogram", _histogram_sql(100))
def histogram(spark, sf_dir):
    found = profiling.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 100)
    return found.select("bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "count")


def _box_sql(t: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"""
SELECT '{c}' AS "column", round(p25, 4) AS p25, round(p50, 4) AS p50, round(p75, 4) AS p75,
  round(min({c}) FILTER (WHERE {c} BETWEEN p25 - 1.5 * (p75 - p25) AND p75 + 1.5 * (p75 - p25))::DOUBLE, 4) AS whisker_low,
  round(max({c}) FILTER (WHERE {c} BETWEEN p25 - 1.5 * (p75 - p25) AND p75 + 1.5 * (p75 - p25))::DOUBLE, 4) AS whisker_high,
  count(*) FILTER (WHERE NOT {c} BETWEEN p25 - 1.5 * (p75 - p25) AND p75 + 1.5 * (p75 - p25)) AS outliers
FROM {t}, (SELECT quantile_cont({c}, 0.25)::DOUBLE AS p25, quantile_cont({c}, 0.5)::DOUBLE AS p50,
  quantile_cont({c}, 0.75)::DOUBLE AS p75 FROM {t}) GROUP BY p25, p50, p75""" for c in columns)


@query("box_stats", _box_sql("lineitem", ["l_extendedprice", "l_quantity"]))
def box_stats(spark, sf_dir):
    found = profiling.box_stats(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"])
    return found.select("column", *[F.round(c, 4).alias(c) for c in found.columns[1:-1]], "outliers")


@query("share_of_total", """
SELECT o_orderpriority, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1""")
def share_of_total(spark, sf_dir):
    shares = profiling.share_of_total(table(spark, sf_dir, "orders"), "o_orderpriority")
    return shares.select("o_orderpriority", "count", F.round("share", 6).alias("share"))


@query("absent_levels", """
SELECT DISTINCT 'p_type_' || p_type AS "column" FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_type <> 'PROMO')""")
def absent_levels(spark, sf_dir):
    flags = cleaning.one_hot(table(spark, sf_dir, "part").select("p_partkey", "p_type"), ["p_type"])
    in_train = F.col("p_type_PROMO") == 0
    return profiling.absent_levels(flags, in_train, [c for c in flags.columns if c != "p_partkey"])


@query("top_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def top_rows(spark, sf_dir):
    return ordering.top(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 15, "o_orderkey")


@query("district_order", f"""
SELECT row_number() OVER (ORDER BY n) - 1 AS position, district FROM
 (SELECT DISTINCT district, CAST(split_part(district, '_', 2) AS INTEGER) AS n FROM ({inputs.HOUSES}))""")
def district_order(spark, sf_dir):
    names = inputs.houses(spark, sf_dir).select("district").distinct()
    numbers = names.withColumn("_n", F.substring_index("district", "_", -1).cast("int"))
    return ordering.numbered(numbers, ["_n"]).select("position", "district")


@query("category_sizes", "SELECT source, count(*) AS articles, count(DISTINCT lang) AS languages FROM documents GROUP BY 1")
def category_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("articles"), F.count_distinct("lang").alias("languages"))


# ---- measures of a prediction table -----------------------------------------------------------------


def _pred(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("prediction"),
        F.col("l_returnflag").alias("fold"), "l_orderkey", "l_linenumber")


_PRED = "SELECT l_extendedprice AS y, l_quantity * 1500 AS p, l_returnflag AS fold, l_orderkey, l_linenumber FROM lineitem"
_FOLD_MEASURES = (f"SELECT fold, count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, "
                  f"avg(abs((y - p) / y)) * 100 AS mape, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 "
                  f"FROM ({_PRED}) GROUP BY fold")
_LONG_MEASURES = " UNION ALL ".join(f"SELECT n, '{m}' AS measure, {m} AS v FROM m" for m in metrics.MEASURES)


@query("error_measures", f"""
SELECT fold, n, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(mape, 4) AS mape, round(r2, 6) AS r2 FROM ({_FOLD_MEASURES})""")
def error_measures(spark, sf_dir):
    found = metrics.measures(_pred(spark, sf_dir), ["fold"])
    return found.select("fold", "n", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "mape")], F.round("r2", 6).alias("r2"))


@query("fold_mean_and_spread", f"""
WITH m AS ({_FOLD_MEASURES}) SELECT measure, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS std FROM ({_LONG_MEASURES}) GROUP BY 1""")
def fold_mean_and_spread(spark, sf_dir):
    found = metrics.mean_and_spread(metrics.measures(_pred(spark, sf_dir), ["fold"]))
    return found.select("measure", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


@query("weighted_mean_and_spread", f"""
WITH m AS ({_FOLD_MEASURES}), l AS ({_LONG_MEASURES}), a AS (SELECT measure, sum(n * v) / sum(n) AS mean FROM l GROUP BY 1)
SELECT measure, round(mean, 5) AS mean, round(sqrt(sum(n * (v - mean) * (v - mean)) / sum(n)), 5) AS std
FROM l JOIN a USING (measure) GROUP BY measure, mean""")
def weighted_mean_and_spread(spark, sf_dir):
    found = metrics.weighted_mean_and_spread(metrics.measures(_pred(spark, sf_dir), ["fold"]))
    return found.select("measure", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


@query("reported_measures", f"""
WITH m AS ({_FOLD_MEASURES}), r AS (SELECT measure, avg(v) AS mean, stddev_pop(v) AS std FROM ({_LONG_MEASURES}) GROUP BY 1)
SELECT measure, CASE WHEN measure IN ('mae', 'rmse') THEN round_even(mean, 0) WHEN measure = 'mape' THEN round_even(mean, 2)
  ELSE round_even(mean, 3) END AS mean, CASE WHEN measure IN ('mae', 'rmse') THEN round_even(std, 0)
  WHEN measure = 'mape' THEN round_even(std, 2) ELSE round_even(std, 3) END AS std FROM r""")
def reported_measures(spark, sf_dir):
    return metrics.reported(metrics.mean_and_spread(metrics.measures(_pred(spark, sf_dir), ["fold"])))


@query("residuals", f"SELECT l_orderkey, l_linenumber, round(y - p, 4) AS error FROM ({_PRED})")
def residuals(spark, sf_dir):
    return metrics.residuals(_pred(spark, sf_dir)).select("l_orderkey", "l_linenumber", F.round("error", 4).alias("error"))


@query("results_table", f"""
WITH m AS ({_FOLD_MEASURES}), a AS (SELECT measure, avg(v) AS a FROM ({_LONG_MEASURES}) GROUP BY 1),
     w AS (SELECT measure, sum(n * v) / sum(n) AS w FROM ({_LONG_MEASURES}) GROUP BY 1)
SELECT measure, round(w, 5) AS weighted, round(a, 5) AS plain FROM a JOIN w USING (measure)""")
def results_table(spark, sf_dir):
    per_fold = metrics.measures(_pred(spark, sf_dir), ["fold"])
    found = metrics.results_table({
        "plain": metrics.mean_and_spread(per_fold), "weighted": metrics.weighted_mean_and_spread(per_fold)},
        ["weighted", "plain"])
    return found.select("measure", F.round("weighted", 5).alias("weighted"), F.round("plain", 5).alias("plain"))


@query("measures_with_group_means", f"""
SELECT fold, n, round(mae, 4) AS mae, round(y, 4) AS y FROM ({_FOLD_MEASURES})
FULL OUTER JOIN (SELECT fold, avg(y) AS y FROM ({_PRED}) GROUP BY 1) USING (fold)""")
def measures_with_group_means(spark, sf_dir):
    pred = _pred(spark, sf_dir)
    found = metrics.with_group_means(metrics.measures(pred, ["fold"]), pred, "fold", ["y"])
    return found.select("fold", "n", F.round("mae", 4).alias("mae"), F.round("y", 4).alias("y"))
