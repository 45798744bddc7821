from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from parcelmill.functions import dates, naming, numeric, text
from parcelmill.functions import property_rules as rules


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "fn, given, expected",
    [
        (lambda x: text.replace_first(x, r"\+|-", "#"), "a-b+c-", "a#b+c-"),
        (lambda x: text.remove_first(x, r"\+|-"), "Good+ +", "Good +"),
        (lambda x: text.remove_first(x, "^X"), "aX", "aX"),
        (lambda x: text.replace_first(x, "b", "#"), "a\nb\nb", "a\n#\nb"),
        (text.squish, "  NO  HEAT BUT\tWITH AC ", "NO HEAT BUT WITH AC"),
        (text.trim_ends, "\t a b \n", "a b"),
        (text.title_case, "MCKEES-ROCKS o'HARA 19TH WARD - PITTSBURGH", "Mckees-Rocks O'hara 19th Ward - Pittsburgh"),
        (text.title_case, "", ""),
        (text.title_case, None, None),
        (text.parcel_key, " \t0098-S-00148-0000-00", "0098S00148000000"),
        (lambda x: text.readable_term(x, "school_desc"), "school_desc_X19th.Ward..Pittsburgh", "19th Ward Pittsburgh"),
        (rules.simple_style, "CONDO GARDEN", "CONDO"),
        (rules.simple_style, "ROW INTERIOR", "ROW"),
        (rules.simple_style, None, None),
        (rules.clean_rating, "VERY  GOOD +", "Very Good"),
        (rules.clean_rating, "AVERAGE-", "Average"),
        (lambda x: rules.heat_type(rules.heating_text(x)), "NO HEAT BUT WITH AC", "None"),
        (lambda x: rules.heat_type(rules.heating_text(x)), "CENTRAL HEAT WITH AC", "Central Heat"),
        (lambda x: rules.district_name(F.lit("PITTSBURGH"), x), "19th Ward - PITTSBURGH", "19th Ward Pittsburgh"),
        (lambda x: rules.district_name(F.lit("BALDWIN"), x), "Mt. Oliver", "Mt. Oliver"),
        (lambda x: rules.district_name(F.lit("MOON AREA"), x), "Moon", "Moon Area"),
    ],
)
def test_text_rules(spark, fn, given, expected):
    assert one(spark, given, fn) == expected


def test_numbers_and_flags(spark):
    assert one(spark, 1234567.5, text.dollar, "double") == "$1,234,568"
    assert one(spark, -12.0, text.dollar, "double") == "-$12"
    assert one(spark, 0.0, numeric.log10_positive, "double") is None
    assert one(spark, "Central Heat With AC", rules.has_cooling) is True
    assert one(spark, None, rules.has_cooling) is None
    assert one(spark, None, lambda x: text.join_text(F.lit("a"), x, sep=" ")) is None


@pytest.mark.parametrize(
    "given, expected",
    [("03-15-2012", (2012, 3, 15)), ("3/5/2012", (2012, 3, 5)), ("02-30-2020", None), ("unknown", None), (None, None)],
)
def test_dates(spark, given, expected):
    found = one(spark, given, dates.month_day_year)
    assert found == (datetime.date(*expected) if expected else None)


def test_names():
    words = [("sale", "sale_"), ("finished", "finished_"), ("finished_livingarea", "finished_living_area")]
    given = ["SALEPRICE", "FinishedLivingArea", "sale price", "2nd %"]
    assert naming.snake_names(given) == ["saleprice", "finished_living_area", "sale_price", "x2nd_percent"]
    assert naming.snake_names(["saleprice", "finishedlivingarea", "saleprice"], words) == [
        "sale_price", "finished_living_area", "sale_price_2",
    ]
    assert naming.level_suffix("Very Good or better") == "Very.Good.or.better"
    assert naming.level_suffix("19th Ward") == "X19th.Ward"


def test_student_quantile():
    for df, expected in ((1, 12.7062), (2, 4.30265), (10, 2.22814), (30, 2.04227), (1000, 1.96234)):
        assert abs(numeric.student_quantile(0.975, df) - expected) < 2e-3
    assert abs(numeric.student_quantile(0.975, 30) - 2.042272) < 1e-5


def test_inflation_leaves_unknown_years_missing(spark):
    rows = spark.createDataFrame([(100.0, 1995), (100.0, 2001), (None, 1995)], "p double, y long")
    index = spark.createDataFrame([(1995, 50.0), (2000, 75.0)], "year long, idx double")
    found = rules.adjust_prices(rows, index, "p", "y", 2000, "q").collect()
    assert sorted([r["q"] for r in found], key=str) == [150.0, None, None]


def test_municipality_rules_see_earlier_results(spark):
    rows = spark.createDataFrame(
        [
            ("Pittsburgh", "19th Ward - Pittsburgh", "Pittsburgh"),
            ("Carnegie", "28th Ward - Pittsburgh", "Pittsburgh"),
            ("Carnegie", "19th Ward - Pittsburgh", "19th Ward - Pittsburgh"),
            ("Mc Keesport", "3rd Ward - Mckeesport", "McKeesport"),
            ("Homestead", "2nd Ward - Homestead", "Homestead"),
            ("Duquesne", "1st Ward - Duquesne", "Duquesne"),
            ("Clairton", "1st Ward - Clairton", "Clairton"),
            (None, "Moon", "Moon"),
        ],
        "property_city string, muni_desc string, expected string",
    )
    done = rules.recode_municipality(rules.fix_text(rows)).collect()
    assert [r["muni_desc"] for r in done] == [r["expected"] for r in done]
