"""Row filters, duplicate-safe lookups and recodes over whole tables."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom.functions import clean

# Columns of the assessment table that carry no information for the price.
UNUSED_COLUMNS = [
    "PARID", "PROPERTYHOUSENUM", "PROPERTYFRACTION", "PROPERTYADDRESS", "PROPERTYCITY", "PROPERTYSTATE",
    "MUNIDESC", "SCHOOLDESC", "LEGAL1", "LEGAL2", "LEGAL3", "NEIGHDESC", "DEEDBOOK", "DEEDPAGE", "RECORDDATE",
    "CHANGENOTICEADDRESS1", "CHANGENOTICEADDRESS2", "CHANGENOTICEADDRESS3", "CHANGENOTICEADDRESS4",
    "COUNTYBUILDING", "COUNTYLAND", "COUNTYTOTAL", "COUNTYEXEMPTBLDG", "LOCALBUILDING", "LOCALLAND",
    "LOCALTOTAL", "FAIRMARKETBUILDING", "FAIRMARKETLAND", "TAXYEAR", "ASOFDATE",
]
EMPTY_COLUMNS = [
    "PROPERTYFRACTION", "PROPERTYUNIT", "TAXSUBCODE", "TAXSUBCODE_DESC", "CLEANGREEN", "FARMSTEADFLAG",
    "ABATEMENTFLAG", "ALT_ID", "PREVSALEDATE", "PREVSALEPRICE", "PREVSALEDATE2", "PREVSALEPRICE2",
]
# Levels with too few rows to deserve a column.
RARE_LEVELS = {
    "OWNERDESC": ["CORPORATION-RAILROAD", "REGULAR-ESTATE"],
    "STYLEDESC": ["MODULAR HOME", "MULTI-FAMILY", "CONVENTIONAL", "LOG CABIN"],
    "EXTFINISH_DESC": ["Concrete", "Log"],
    "ROOFDESC": ["METAL"],
    "BASEMENTDESC": ["Slab/Piers"],
}
# Which sales count as ordinary sales of houses.
MOST_ROOMS, LEAST_BEDROOMS = 20, 1
LEAST_PRICE, MOST_PRICE = 10_000, 1_000_000
FIRST_YEAR, LAST_YEAR = 2015, 2020
HEATINGS = ["Central Heat with AC", "Central Heat"]
TAXABLE = "20 - Taxable"
# Point categories left out of the features.
SMALL_POINT_CATEGORIES = [
    "homeless_shelters", "wic_offices", "va_facilities", "acha_community_sites", "achd_clinics",
    "veterans_social_orgs", "rec_centers", "family_support_centers",
]
# Columns encoded as 0/1 columns.
DUMMY_COLUMNS = ["SALEYEAR_STR", "HEATINGCOOLINGDESC", "OWNERDESC", "STYLEDESC", "EXTFINISH_DESC", "ROOFDESC",
                 "BASEMENTDESC"]
CODE_COLUMNS = ["OWNERCODE", "STYLE", "EXTERIORFINISH", "ROOF", "BASEMENT", "HEATINGCOOLING"]


def drop_columns(df: DataFrame, columns: list[str], strict: bool = True) -> DataFrame:
    """Drop columns; with ``strict`` a missing one is an error, as a typo would be silent otherwise."""
    missing = [c for c in columns if c not in df.columns]
    if strict and missing:
        raise ValueError(f"no such columns: {missing}")
    return df.drop(*columns)


def columns_like(df: DataFrame, having: str | None = None, without: str | None = None) -> list[str]:
    """Column names that contain ``having`` and do not contain ``without``."""
    return [c for c in df.columns if (having is None or having in c) and (without is None or without not in c)]


def blank_strings_to_null(df: DataFrame) -> DataFrame:
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: clean.blank_to_null(F.col(f"`{c}`")) for c in texts})


def keep_frequent(df: DataFrame, column: str, at_least: int) -> DataFrame:
    """Keep rows whose level of ``column`` has at least ``at_least`` rows.

    The level counts are reduced before the shuffle; the join side is one row per level.
    """
    often = df.groupBy(column).count().filter(F.col("count") >= at_least).select(column)
    return df.join(often, column, "left_semi")


def step_counts(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """Rows before and after each successive filter, in one pass: ``(step, name, rows_before, rows_after)``.

    A NULL condition drops the row, as in a filter.
    """
    so_far, aggs = F.lit(True), [F.count("*").alias("_0")]
    for i, condition in enumerate(steps.values(), 1):
        so_far = so_far & F.coalesce(condition, F.lit(False))
        aggs.append(F.count_if(so_far).alias(f"_{i}"))
    rows = F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"),
                 F.col(f"_{i - 1}").alias("rows_before"), F.col(f"_{i}").alias("rows_after"))
        for i, name in enumerate(steps, 1)
    ])
    out = df.agg(*aggs).select(F.inline(rows))
    return out.withColumn("removed", F.col("rows_before") - F.col("rows_after"))


def lookup(df: DataFrame, table: DataFrame, key: str, table_key: str, value: str) -> DataFrame:
    """Add ``value`` from a dictionary table. A key the table lacks fails the job when it is read."""
    found = df.join(table.select(F.col(table_key).alias(key), value), key, "left")
    message = F.concat(F.lit(f"no {value} for {key} "), F.col(key).cast("string"))
    return found.withColumn(value, F.coalesce(value, F.raise_error(message).cast("string")))


def dictionary_table(json_text: DataFrame, column: str, key: str, value: str) -> DataFrame:
    """Rows of a JSON object held in ``column``: one ``(key, value)`` per entry."""
    parsed = F.from_json(column, "map<string,string>")
    return json_text.select(F.explode(parsed).alias(key, value))


def levels_of(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Distinct levels of each column, sorted. They become column names, so the driver holds them all."""
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("level")) for c in columns
    ])).alias("p")).select("p.*").na.drop().distinct()
    rows = pairs.collect()
    return {c: sorted(r["level"] for r in rows if r["name"] == c) for c in columns}


def one_hot(df: DataFrame, columns: list[str], levels: dict[str, list[str]] | None = None) -> DataFrame:
    """Replace each column by one 0/1 column per level, all levels kept, whatever their number.

    The plan gets as wide as there are levels; ``level_vectors`` is the form for keys with very many.
    """
    columns = list(dict.fromkeys(columns))
    levels = levels or levels_of(df, columns)
    flags = [
        F.coalesce((F.col(c).cast("string") == lv).cast("int"), F.lit(0)).alias(clean.one_hot_name(c, lv))
        for c in columns for lv in levels[c]
    ]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], *flags)


def level_vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace each column by one sparse vector ``<column>_levels`` with a place per level in alphabetical order (the levels
    are in its metadata); NULL is the zero vector."""
    for column in dict.fromkeys(columns):
        as_text = df.withColumn("_level", F.col(f"`{column}`").cast("string"))
        index = StringIndexer(inputCol="_level", outputCol="_at", handleInvalid="keep", stringOrderType="alphabetAsc")
        # the place of NULL is the last one, which the encoder leaves out
        placed = index.fit(as_text.filter("_level is not null")).transform(as_text)
        encoder = OneHotEncoder(inputCol="_at", outputCol=f"{column}_levels", dropLast=True)
        df = encoder.fit(placed).transform(placed).drop("_level", "_at", column)
    return df


def clean_points(raw: DataFrame, box=None) -> DataFrame:
    """Point table: inside the county, five columns, no missing value."""
    from placeloom.functions import geo

    south, north, west, east = box or geo.COUNTY_BOX
    lat, lon = F.col("latitude"), F.col("longitude")
    return (
        raw.filter(geo.inside_box(lat, lon, south, north, west, east))
        .select(F.col("_id").alias("point_id"), "name", F.col("asset_type").alias("category"),
                lat.alias("lat"), lon.alias("lon"))
        .na.drop("any")
    )


def clean_houses(raw: DataFrame, districts: DataFrame) -> DataFrame:
    """The cleaned assessment table, up to (not including) the 0/1 columns.

    ``districts`` is ``(municipality, district)``; a municipality of a kept row that it lacks fails the job. The filters on
    raw columns come first, so they reach the file scan together.
    """
    c = F.col
    sold = raw.filter(
        (c("USEDESC") == "SINGLE FAMILY") & clean.differs(c("OWNERDESC"), "CORPORATION")
        & (c("TOTALROOMS") <= MOST_ROOMS) & (c("BEDROOMS") >= LEAST_BEDROOMS) & (c("SALEDESC") == "VALID SALE")
        & (c("SALEPRICE") < MOST_PRICE) & (c("FAIRMARKETTOTAL") < MOST_PRICE) & (c("SALEPRICE") > LEAST_PRICE)
        & (c("TAXDESC") == TAXABLE) & (c("CARDNUMBER") == 1) & c("HEATINGCOOLINGDESC").isin(HEATINGS))
    for column, rare in RARE_LEVELS.items():
        sold = sold.filter(clean.none_of(c(column), rare))
    named = lookup(sold.withColumn("MUNIDESC", clean.municipality(c("MUNIDESC"))), districts,
                   "MUNIDESC", "municipality", "district").withColumnRenamed("district", "DISTRICT")
    kept = blank_strings_to_null(named)
    kept = drop_columns(kept, list(dict.fromkeys(UNUSED_COLUMNS + EMPTY_COLUMNS)), strict=False)
    kept = drop_columns(kept, ["USECODE", "USEDESC", "SALECODE", "SALEDESC"], strict=False).na.drop("any")
    kept = kept.withColumn("SALEYEAR", clean.sale_year(c("SALEDATE"))).filter(c("SALEYEAR").between(FIRST_YEAR, LAST_YEAR))
    kept = drop_columns(kept, ["TAXCODE", "TAXDESC", "CLASS", "CLASSDESC", "HOMESTEADFLAG", "CARDNUMBER",
                               *CODE_COLUMNS], strict=False)
    texts = [x for x in DUMMY_COLUMNS if x != "SALEYEAR_STR"]
    kept = kept.withColumns({
        "SALEYEAR_STR": c("SALEYEAR").cast("string"),
        **{x: clean.no_blanks(c(x)) for x in texts},
        "CONDITION": clean.condition_scale(c("CONDITION"), c("CONDITIONDESC")),
        "GRADE": clean.scale(c("GRADE"), clean.GRADE_SCALE),
        "CDU": clean.scale(c("CDU"), clean.CDU_SCALE),
    })
    return drop_columns(kept, ["CONDITIONDESC", "GRADEDESC", "CDUDESC"], strict=False)
