"""A made-up table of sales with every gap and rare level that the recipe handles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sales_frame(spark: SparkSession) -> DataFrame:
    rng = np.random.default_rng(11)
    n = 1500
    frame = pd.DataFrame(
        {
            "par_id": [f"P{k:05d}" for k in range(n)],
            "house_age_at_sale": rng.integers(0, 100, n),
            "sale_year": rng.integers(1990, 2020, n),
            "sale_month": rng.choice(["Jan", "Jun", "Dec"], n),
            "lot_area": rng.lognormal(9, 0.5, n),
            "finished_living_area": rng.lognormal(7.4, 0.3, n),
            "bedrooms": rng.integers(1, 6, n).astype(float),
            "fullbaths": rng.integers(1, 4, n),
            "halfbaths": rng.integers(0, 2, n),
            # One area holds a third of the rows.
            "geo_id": np.where(np.arange(n) % 3 == 0, "Hot Area", rng.choice(["North", "South", "Tiny"], n, p=[0.5, 0.45, 0.05])),
            "style_desc": rng.choice(["COLONIAL", "RANCH", "LOG"], n, p=[0.6, 0.38, 0.02]),
            "grade_desc": rng.choice(["Average", "Good", "Excellent", "Poor"], n),
            "condition_desc": rng.choice(["Average", "Fair", "Unsound"], n),
            "ac_flag": rng.choice([True, False], n),
            "heat_type": rng.choice(["Central Heat", "None", "Wall Furnace"], n),
            "longitude": rng.uniform(-80, -79, n),
            "latitude": rng.uniform(40, 41, n),
            "year_blt": rng.integers(1900, 1990, n),
        }
    )
    frame["sale_price_adj"] = 10 ** (
        3.2 + 0.0005 * frame["finished_living_area"] - 0.002 * frame["house_age_at_sale"]
        + 0.2 * (frame["grade_desc"] == "Excellent") + rng.normal(0, 0.1, n)
    )
    frame.loc[frame.index % 17 == 0, "bedrooms"] = np.nan
    for column in ("condition_desc", "heat_type", "ac_flag"):
        frame[column] = frame[column].astype(object)
        frame.loc[frame.index % 13 == 0, column] = None
    table = spark.createDataFrame(frame)
    return table.withColumn("bedrooms", F.when(~F.isnan("bedrooms"), F.col("bedrooms"))).withColumn(
        "ac_flag", F.col("ac_flag").cast("boolean")
    )
