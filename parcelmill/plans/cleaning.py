"""Table-cleaning jobs: assessments, transactions, parcel points, areas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelmill.functions import dates, text
from parcelmill.functions import property_rules as rules
from parcelmill.operators.aggregates import allow_list, mean_sd
from parcelmill.operators.geography import assign_areas
from parcelmill.operators.relational import across, anti_join, clean_names, matching, semi_join
from parcelmill.operators.windows import zscore_from
from parcelmill.runtime import big_join

# Run-together words in the raw headers and how they are split.
HEADER_WORDS = [
    ("property", "property_"), ("school", "school_"), ("muni", "muni_"), ("record", "record_"),
    ("sale", "sale_"), ("deed", "deed_"), ("instr", "instr_"), ("style", "style_"),
    ("year", "year_"), ("total", "total_"), ("finished", "finished_"), ("lot", "lot_"),
    ("grade", "grade_"), ("condition", "condition_"),
    ("finished_livingarea", "finished_living_area"), ("cdu", "cdu_"), ("basement", "basement_"),
    ("roof", "roof_"), ("heatingcooling", "heatingcooling_"),
]
# A parcel whose record is known to be wrong, and the columns of the source tables.
BAD_PARCELS = ("0014G00199000000",)
ASSESSMENT_COLUMNS = [
    "par_id", "usedesc", "school_desc", "muni_desc", "sale_desc", "sale_price", "sale_date",
    "year_blt", "style_desc", "bedrooms", "fullbaths", "halfbaths", "finished_living_area",
    "lot_area", "grade_desc", "condition_desc", "extfinish_desc", "roof_desc", "basement_desc",
    "cdu_desc", "heatingcooling_desc", "fireplaces", "bsmtgarage",
]
TRANSACTION_COLUMNS = [
    "par_id", "property_city", "school_code", "school_desc", "muni_desc", "sale_desc", "price",
]


def is_valid_sale() -> Column:
    return F.col("sale_desc").isin(*rules.VALID_SALES)


def clean_headers(df: DataFrame) -> DataFrame:
    """Snake-case names with known words split and ``parid`` renamed."""
    return clean_names(clean_names(df).withColumnsRenamed({"parid": "par_id"}), HEADER_WORDS)


def allowed_uses(raw: DataFrame, top: int = 10, extra: Sequence[str] = tuple(rules.EXTRA_USES)) -> DataFrame:
    return allow_list(raw.where(is_valid_sale()), "usedesc", top, extra)


def clean_assessments(
    raw: DataFrame,
    price_index: DataFrame,
    target_year: int = 2019,
    first_year: int = 1975,
    least_price: float = 100,
    bad_parcels: Sequence[str] = BAD_PARCELS,
    absent: Sequence[str] = (),
) -> DataFrame:
    """Valid sales of allowed uses, pruned, dated, recoded and brought to one year's prices.

    Headers of a raw file are cleaned first. A column that is missing is an error,
    unless it is named in ``absent``. Filters come before every join but the
    allow-list, so they reach the scan.
    """
    kept = [c for c in ASSESSMENT_COLUMNS if c not in absent]
    if not set(kept) <= set(raw.columns):
        raw = clean_headers(raw)
    lacking = [c for c in kept if c not in raw.columns]
    if lacking:
        raise ValueError(f"columns not found: {lacking}")
    sales = semi_join(raw.where(is_valid_sale()).select(*kept), allowed_uses(raw), ["usedesc"])
    dated = sales.withColumn("sale_date", dates.month_day_year(F.col("sale_date"))).withColumns(
        {
            "sale_year": dates.year_of(F.col("sale_date")),
            "sale_month": dates.month_name(F.col("sale_date")),
            "muni_desc": text.trim_ends(F.col("muni_desc")),
            "school_desc": text.trim_ends(F.col("school_desc")),
        }
    )
    usable = dated.where(
        (F.col("sale_year") > first_year)
        & (F.col("sale_price") > least_price)
        & ~F.col("par_id").isin(*bad_parcels)
    )
    aged = usable.withColumn("house_age_at_sale", F.col("sale_year") - F.col("year_blt")).where(
        F.col("house_age_at_sale") >= 0
    )
    named = aged.withColumns(
        {
            "style_desc": rules.simple_style(F.col("style_desc")),
            "school_desc": rules.district_name(F.col("school_desc"), F.col("muni_desc")),
        }
    ).drop("sale_date")
    return adjust(recode_descriptions(named), price_index, target_year)


def recode_descriptions(df: DataFrame) -> DataFrame:
    """Title-case every description, tidy ratings, split heating into type and cooling flag."""
    titled = across(df, matching(df, "_desc$"), text.title_case)
    rated = across(titled, ["grade_desc", "condition_desc"], rules.clean_rating)
    heating = rules.heating_text(F.col("heatingcooling_desc"))
    tidy = rated.withColumn("style_desc", text.squish(F.col("style_desc"))).withColumn(
        "heatingcooling_desc", heating
    )
    return tidy.withColumns(
        {
            "ac_flag": rules.has_cooling(F.col("heatingcooling_desc")),
            "heat_type": rules.heat_type(F.col("heatingcooling_desc")),
        }
    )


def adjust(df: DataFrame, price_index: DataFrame, target_year: int) -> DataFrame:
    return rules.adjust_prices(df, price_index, "sale_price", "sale_year", target_year)


def assign_and_repair(
    sales: DataFrame,
    parcel_points: DataFrame,
    vertices: DataFrame,
    school_areas: dict[str, str] = rules.AREA_BY_SCHOOL,
    step: float = 0.05,
) -> DataFrame:
    """Area of every sale: from its parcel's point, or by school district where that fails.

    A sale without a point meets no area and keeps its row, so one left join finds
    both kinds of failure and the district rule fills them in place.
    """
    located = big_join(sales, parcel_points.withColumnRenamed("pin", "par_id"), ["par_id"])
    placed = assign_areas(located, vertices, step)
    by_district = rules.recode(F.col("school_desc"), school_areas)
    return placed.withColumn("geo_id", F.coalesce("geo_id", by_district)).drop("longitude", "latitude")


def clean_transactions(raw: DataFrame) -> DataFrame:
    """Valid transactions with cleaned city and municipality names."""
    valid = clean_headers(raw).where(is_valid_sale()).select(*TRANSACTION_COLUMNS)
    titled = across(valid, ["property_city", "muni_desc"], text.title_case)
    return rules.recode_municipality(rules.fix_text(titled))


def clean_parcel_points(raw: DataFrame) -> DataFrame:
    """``pin, longitude, latitude`` of parcels with a point."""
    named = clean_names(raw).withColumnsRenamed({"intptlon10": "longitude", "intptlat10": "latitude"})
    return named.select("pin", "longitude", "latitude").dropna()


def unmatched_points(sales: DataFrame, parcel_points: DataFrame) -> DataFrame:
    return anti_join(sales, parcel_points, [("par_id", "pin")])


def model_table(sales: DataFrame, parcel_points: DataFrame) -> DataFrame:
    """The columns a price model and its maps use.

    Sales and parcels both grow, so neither side is taken to be small.
    """
    wanted = [
        "par_id", "sale_price_adj", "house_age_at_sale", "sale_year", "sale_month", "lot_area",
        "finished_living_area", "bedrooms", "fullbaths", "halfbaths", "geo_id", "style_desc",
        "grade_desc", "condition_desc", "ac_flag", "heat_type", "longitude", "latitude", "year_blt",
    ]
    joined = big_join(sales, parcel_points.withColumnRenamed("pin", "par_id"), ["par_id"])
    return joined.select(*wanted)


def summary_lookups(sales: DataFrame) -> dict[str, DataFrame]:
    """Mean and sd of lot area per area and of living area per style."""
    return {
        "lot_area": mean_sd(sales, ["geo_id"], "lot_area"),
        "finished_living_area": mean_sd(sales, ["style_desc"], "finished_living_area"),
    }


def with_lookups(df: DataFrame, lookups: dict[str, DataFrame]) -> DataFrame:
    """z-scores of lot and living area from stored lookups."""
    scored = zscore_from(df, lookups["lot_area"], ["geo_id"], "lot_area", "lot_area_zscore")
    return zscore_from(
        scored, lookups["finished_living_area"], ["style_desc"], "finished_living_area",
        "finished_living_area_zscore",
    )
