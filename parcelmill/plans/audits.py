"""Data-quality checks as a ``(check, n_bad)`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelmill.operators.evaluation import odd_inputs
from parcelmill.operators.relational import bind_rows, reconcile_keys


def audit_sales(sales: DataFrame) -> DataFrame:
    """Rows of a clean sales table that should not be there."""
    return odd_inputs(
        sales,
        {
            "no_area": F.col("geo_id").isNull(),
            "no_point": F.col("longitude").isNull() | F.col("latitude").isNull(),
            "no_price": F.col("sale_price_adj").isNull() | (F.col("sale_price_adj") <= 0),
            "negative_age": F.col("house_age_at_sale") < 0,
            "no_bedrooms": F.col("bedrooms").isNull(),
            "no_condition": F.col("condition_desc").isNull(),
        },
    )


def unassigned_districts(sales: DataFrame) -> DataFrame:
    """Districts that still have sales without an area."""
    return sales.where(F.col("geo_id").isNull()).select("school_desc").distinct()


def audit_names(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Number of names known to one table only."""
    sides = reconcile_keys(left, right, left_key, right_key)
    both = [
        sides.agg(F.sum(F.when(F.col("side") == side, 1).otherwise(0)).cast("long").alias("n_bad"))
        .select(F.lit(side).alias("check"), F.coalesce("n_bad", F.lit(0)).cast("long").alias("n_bad"))
        for side in ("left_only", "right_only")
    ]
    return bind_rows(*both)
