"""Cleaning and recoding expressions for assessment tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordinal scale of grades, best first.
GRADES = ["XX+", "XX", "XX-", "X+", "X", "X-", "A+", "A", "A-", "B+", "B", "B-", "C+", "C", "C-", "D+", "D",
          "D-", "E+", "E", "E-"]
GRADE_SCALE = {grade: place for place, grade in enumerate(GRADES, 1)}

# Ordinal scale of condition-desirability-utility codes, best first.
CDU_CODES = ["EX", "VG", "GD", "AV", "FR", "PR", "VP", "UN"]
CDU_SCALE = {code: place for place, code in enumerate(CDU_CODES, 1)}

# Conditions placed by their description after the numeric codes have made room.
CONDITION_PLACES = {"VERY GOOD": 2.0, "VERY POOR": 7.0, "UNSOUND": 8.0}


def blank_to_null(c: Column) -> Column:
    return F.when(~c.rlike(r"^\s*$"), c)


def differs(c: Column, value) -> Column:
    """``c != value`` where a missing value counts as different."""
    return ~c.eqNullSafe(F.lit(value))


def none_of(c: Column, values: list) -> Column:
    """Keep rows outside ``values``; a missing value is kept."""
    return c.isNull() | ~c.isin(values)


def municipality(c: Column) -> Column:
    """Drop the two trailing characters, then turn double blanks into single ones."""
    return F.replace(F.substring(c, F.lit(1), F.length(c) - 2), F.lit("  "), F.lit(" "))


def sale_year(c: Column) -> Column:
    """The year that ends a date string."""
    return F.right(c, F.lit(4)).try_cast("int")


def no_blanks(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def condition_scale(code: Column, description: Column) -> Column:
    """Ordinal condition: the description decides first; other codes 2 to 6 move up by one."""
    by_name = reduce(
        lambda chain, item: chain.when(description == item[0], item[1]),
        list(CONDITION_PLACES.items())[1:],
        F.when(description == next(iter(CONDITION_PLACES)), next(iter(CONDITION_PLACES.values()))),
    )
    return by_name.when(code.between(2, 6), code + 1).otherwise(code)


def scale(c: Column, places: dict[str, int]) -> Column:
    """Replace levels by their place; levels outside the scale stay as they are (as text)."""
    table = F.create_map(*[F.lit(x) for pair in places.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c).cast("string"), c)


def one_hot_name(column: str, level) -> str:
    return f"{column}_{level}"


def log_label(c: Column, shift: float = 9.4) -> Column:
    return F.log1p(c) - shift


def unlog_label(c: Column, shift: float = 9.4) -> Column:
    return F.expm1(c + shift)


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c < low, low).when(c > high, high).otherwise(c)


def half_even(c: Column, digits: int = 0) -> Column:
    """Round with ties to the even digit, as the reports do."""
    return F.bround(c, digits)
