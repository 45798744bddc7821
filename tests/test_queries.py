"""Registered queries against DuckDB at the smallest scale; PARCELMILL_ALL=1 runs every one."""

from __future__ import annotations

import os

import pytest
from check_oracle import compare, duck

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"
SOME = [
    "flagship_area_ranking", "PF11_null_filters", "J3_natural_left_join", "J8_point_in_polygon", "AG12_column_profile",
    "AG13_allow_list", "WN2_zscore_within_group", "WN4_sample_per_group", "RS5_complete_grid", "FC4_lump_top",
    "SF20_district_name", "SF21_municipality_rules", "DS3_grouped_histogram", "DS5_density", "DS7_box_summary",
    "GE3_repair_missed_points", "FE2_stratified_split", "MD7_linear_bounds", "SV5_rating_grid", "CJ1_clean_assessments",
    "FE11_reference_levels", "FE13_design_vector", "FE13_fit_and_apply_recipe", "MD1_normal_equations", "MD12_weak_term", "CJ8_full_report",
    "CJ7_linear_fold_metrics", "DS10_spline_holds", "SV3_top_styles",
]
NAMES = sorted(queries()) if os.environ.get("PARCELMILL_ALL") else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = queries()[name](spark, SF_DIR)
    sql = oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(con, df, sql) is None


def test_every_check_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 25
