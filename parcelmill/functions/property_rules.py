"""Recoding rules of property tables as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelmill.functions import text
from parcelmill.runtime import lookup_join

# Category orders and recodes that results must reproduce.
GRADE_ORDER = [
    "Highest Cost", "Excellent", "Very Good", "Good", "Average", "Below Average", "Poor",
]
CONDITION_ORDER = [
    "Excellent", "Very Good", "Good", "Average", "Fair", "Poor", "Very Poor", "Unsound",
]
AREA_BY_SCHOOL = {
    "19th Ward Pittsburgh": "City Council District 4",
    "Woodland Hills": "Woodland Hills",
    "Chartiers Valley": "Chartiers Valley",
    "Bethel Park": "Bethel Park",
    "Moon Area": "Moon Area",
    "West Jefferson Hills": "West Jefferson Hills",
    "Plum Boro": "Plum Borough",
    "South Park": "South Park",
    "Upper St Clair": "Upper St. Clair Area",
}
EXTRA_USES = [
    "OFFICE/APARTMENTS OVER", "MOBILE HOME", "APART:20-39 UNITS", "APART:40+ UNITS",
    "CHARITABLE EXEMPTION/HOS/HOMES", "MOBILE HOME (IN PARK)", "COMM APRTM CONDOS 5-19 UNITS",
]
VALID_SALES = ["VALID SALE", "OTHER VALID"]
TEXT_FIXES = [
    ("property_city", "Mc Keesport", "McKeesport"),
    ("property_city", "Mc Kees Rocks", "McKees Rocks"),
    ("muni_desc", "Mckeesport", "McKeesport"),
    ("muni_desc", "Mckees Rocks", "McKees Rocks"),
]
# (city or None, pattern in muni_desc, new muni_desc), applied in order.
MUNICIPALITY_RULES = [
    ("Pittsburgh", "Pittsburgh", "Pittsburgh"),
    (None, "McKeesport", "McKeesport"),
    (None, "^28th Ward - Pittsburgh$", "Pittsburgh"),
    (None, "Clairton", "Clairton"),
    ("Homestead", "Ward", "Homestead"),
    ("Duquesne", "Ward", "Duquesne"),
]


def recode(x: Column, mapping: dict[str, str], otherwise: Column | None = None) -> Column:
    """Map listed values; others become ``otherwise`` (NULL when not given)."""
    pairs = list(mapping.items())
    first, *rest = pairs
    case = F.when(x == first[0], F.lit(first[1]))
    for old, new in rest:
        case = case.when(x == old, F.lit(new))
    return case if otherwise is None else case.otherwise(otherwise)


def pool_values(x: Column, groups: dict[str, Sequence[str]]) -> Column:
    """Give several values one name; other values stay."""
    return reduce(
        lambda case, item: F.when(x.isin(*item[1]), F.lit(item[0])).otherwise(case),
        reversed(list(groups.items())),
        x,
    )


def simple_style(x: Column) -> Column:
    """Any condominium is CONDO; both row-house kinds are ROW."""
    return (
        F.when(x.rlike("CONDO"), F.lit("CONDO"))
        .when(x.isin("ROW END", "ROW INTERIOR"), F.lit("ROW"))
        .otherwise(x)
    )


def district_name(school: Column, municipality: Column) -> Column:
    """The ward for city wards, the school district elsewhere, in title case."""
    is_ward = municipality.rlike("Ward") & municipality.rlike("PITTSBURGH")
    named = (
        F.when(is_ward, municipality)
        .when(municipality == "Mt. Oliver", F.lit("Mt. Oliver"))
        .otherwise(school)
    )
    return text.title_case(text.replace_first(text.title_case(named), " - ", " "))


def clean_rating(x: Column) -> Column:
    """Title case without the first plus or minus sign."""
    return text.squish(text.remove_first(text.title_case(x), r"\+|-"))


def heating_text(x: Column) -> Column:
    return text.replace_first(text.title_case(x), "With Ac", "With AC")


def has_cooling(heating: Column) -> Column:
    return heating.rlike("With AC$")


def heat_type(heating: Column) -> Column:
    bare = text.squish(text.remove_first(heating, "With AC$"))
    return F.when(bare == "No Heat But", F.lit("None")).otherwise(bare)


def fix_text(df: DataFrame, fixes=TEXT_FIXES) -> DataFrame:
    """First-match replacements, each a (column, text, replacement)."""
    for column, old, new in fixes:
        df = df.withColumn(column, text.replace_first(F.col(column), old, new))
    return df


def recode_municipality(df: DataFrame, rules=MUNICIPALITY_RULES) -> DataFrame:
    """Ordered rules on ``muni_desc``, some only for one ``property_city``."""
    # One projection per rule: a later rule reads the result of the earlier ones once.
    for city, pattern, name in rules:
        hit = F.col("muni_desc").rlike(pattern)
        if city is not None:
            hit = hit & (F.col("property_city") == city)
        df = df.withColumn("muni_desc", F.when(hit, F.lit(name)).otherwise(F.col("muni_desc")))
    return df


def adjust_prices(
    df: DataFrame,
    index: DataFrame,
    price: str,
    year: str,
    target: int,
    name: str = "sale_price_adj",
) -> DataFrame:
    """Bring prices to the target year with a (year, idx) table; unknown years give NULL."""
    goal = index.where(F.col("year") == target).agg(F.max("idx").alias("idx")).scalar()
    factors = index.select(F.col("year").alias(year), (goal / F.col("idx")).alias("__factor"))
    joined = lookup_join(df, factors, [year], base_table=True)
    return joined.withColumn(name, F.col(price) * F.col("__factor")).drop("__factor")
