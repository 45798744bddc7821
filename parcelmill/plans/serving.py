"""The questions of the price app as batch jobs over a table of requests.

A request is one what-if house: ``request_id`` and the model's predictors.
Sales are reduced per (area, style) before they meet the requests, so many
requests for one popular area do not multiply its sales.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelmill.functions import text
from parcelmill.functions.property_rules import CONDITION_ORDER, GRADE_ORDER
from parcelmill.operators.aggregates import count_by, quantiles
from parcelmill.operators.distribution import density, heatmap, histogram, iqr_histogram
from parcelmill.operators.factors import lump_top
from parcelmill.operators.models import LinearFit, predict, with_bounds
from parcelmill.operators.relational import bind_rows, longer
from parcelmill.runtime import lookup_join, settle
from parcelmill.sources.tables import write_table

MATCH = ("geo_id", "style_desc")


def score_requests(model: PipelineModel, requests: DataFrame, bounds: LinearFit | None = None) -> DataFrame:
    """Predicted dollars for each request, with confidence bounds if the linear fit behind the model is given.

    A request with a missing predictor keeps its row, without numbers.
    """
    scored = predict(model, requests)
    shown = ["request_id", "pred", "pred_dollar", text.dollar(F.col("pred_dollar")).alias("price_text")]
    if bounds is None:
        return scored.select(*shown)
    return with_bounds(scored, bounds).select(*shown, "pred_lower_dollar", "pred_upper_dollar")


def comparable_sales(sales: DataFrame, requests: DataFrame, on: Sequence[str] = MATCH) -> DataFrame:
    """Past sales like each request, one row per (request, sale)."""
    wanted = requests.select("request_id", *on)
    return lookup_join(sales, wanted, list(on), "inner")


def for_requests(summary: DataFrame, requests: DataFrame, on: Sequence[str] = MATCH) -> DataFrame:
    """Rows of a per-group summary for each request."""
    return lookup_join(requests.select("request_id", *on), summary, list(on), "inner")


def wanted_sales(sales: DataFrame, requests: DataFrame, on: Sequence[str] = MATCH) -> DataFrame:
    return lookup_join(sales, requests.select(*on).distinct(), list(on), "left_semi")


def top_styles(sales: DataFrame, requests: DataFrame, n: int = 5) -> DataFrame:
    """Counts of the most frequent styles in the request's area, the rest pooled."""
    local = wanted_sales(sales, requests, ["geo_id"])
    pooled = lump_top(count_by(local, "geo_id", "style_desc"), "style_desc", n, by=["geo_id"])
    return for_requests(pooled, requests, ["geo_id"])


def price_histogram(sales: DataFrame, requests: DataFrame, predictions: DataFrame) -> DataFrame:
    """Price bins of comparable sales; ``is_prediction`` marks the bin of the predicted price."""
    bins = iqr_histogram(wanted_sales(sales, requests), "sale_price_adj", MATCH)
    own = for_requests(bins, requests)
    marked = lookup_join(own, predictions.select("request_id", "pred_dollar"), ["request_id"])
    slot = F.ceil(F.col("pred_dollar") / F.col("width") - 0.5)
    return marked.withColumn("is_prediction", slot == F.col("bin")).drop("pred_dollar")


def rating_grid(
    sales: DataFrame,
    requests: DataFrame,
    grades: Sequence[str] = tuple(GRADE_ORDER),
    conditions: Sequence[str] = tuple(CONDITION_ORDER),
) -> DataFrame:
    """Grade by condition counts of comparables on the full grid, in reversed declared order."""
    rated = wanted_sales(sales, requests).dropna(subset=["grade_desc", "condition_desc"])
    grid = heatmap(rated, "grade_desc", "condition_desc", MATCH)

    def place(column: str, order: Sequence[str]) -> Column:
        found = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
        return (len(order) + 1 - found).cast("long")

    ranked = grid.withColumns(
        {"grade_rank": place("grade_desc", grades), "condition_rank": place("condition_desc", conditions)}
    )
    return for_requests(ranked, requests)


def feature_profiles(sales: DataFrame, requests: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of each value of small-domain features (rooms, months) among comparables."""
    local = wanted_sales(sales, requests)
    rows = longer(local, MATCH, columns, "feature", "value", "string")
    return for_requests(count_by(rows, *MATCH, "feature", "value"), requests)


def feature_quartiles(sales: DataFrame, requests: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Quartiles of wide-domain features (areas, year built) among comparables."""
    local = wanted_sales(sales, requests)
    rows = longer(local, MATCH, columns, "feature", "value", "double")
    marks = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    return for_requests(quantiles(rows, [*MATCH, "feature"], "value", marks), requests)


def bath_grid(sales: DataFrame, requests: DataFrame) -> DataFrame:
    """Comparables by full and half baths, zeros included, for each request."""
    return for_requests(heatmap(wanted_sales(sales, requests), "fullbaths", "halfbaths", MATCH), requests)


def feature_density(sales: DataFrame, requests: DataFrame, column: str, points: int = 512) -> DataFrame:
    """Density of a wide-domain feature (areas) among the comparables of each request."""
    # A density goes over its rows several times.
    local = settle(wanted_sales(sales, requests).select(*MATCH, column))
    return for_requests(density(local, column, MATCH, points), requests)


def feature_histogram(sales: DataFrame, requests: DataFrame, column: str, width: float) -> DataFrame:
    """Counts in bins of a feature (year built) among the comparables of each request."""
    return for_requests(histogram(wanted_sales(sales, requests), column, MATCH, width=width), requests)


# Labels and order of the request summary.
SUMMARY_LINES = [
    ("Area:", "geo_id", "text"),
    ("Grade:", "grade_desc", "text"),
    ("Condition:", "condition_desc", "text"),
    ("Style:", "style_desc", "text"),
    ("Lot area:", "lot_area", "area"),
    ("Finished living area:", "finished_living_area", "area"),
    ("Bedrooms:", "bedrooms", "text"),
    ("Full Bathrooms:", "fullbaths", "text"),
    ("Half Bathrooms:", "halfbaths", "text"),
    ("Year Built:", "year_blt", "text"),
    ("Heat Source:", "heat_type", "text"),
    ("Air Conditioning:", "ac_flag", "text"),
    ("Sale Month:", "sale_month", "text"),
    ("Predicted price:", "pred_dollar", "dollar"),
]


def request_text(requests: DataFrame, lines=SUMMARY_LINES) -> DataFrame:
    """A request and its prediction as one text, a line per input; a missing input reads NA."""

    def shown(column: str, kind: str) -> Column:
        x = F.col(column)
        if kind == "area":
            return F.concat(text.comma(x), F.lit(" sq. ft."))
        if kind == "dollar":
            return text.dollar(x)
        return x.cast("string")

    parts = [F.concat(F.lit(label + " "), F.coalesce(shown(c, k), F.lit("NA"))) for label, c, k in lines]
    return requests.select("request_id", F.concat_ws("\n", *parts).alias("summary"))


def value_domains(
    sales: DataFrame,
    categories: Sequence[str],
    ordered: dict[str, Sequence[str]],
    ranges: dict[str, tuple[float, float]],
) -> DataFrame:
    """Choices an input form offers, as ``(column, kind, value, n, position)``.

    Categories come with counts, ordered ones with their declared rank, numeric
    columns with a low and a high quantile of their values.
    """
    rows = longer(sales, [], [*categories, *ordered], "column", "value", "string")
    counts = settle(count_by(rows.where(F.col("value").isNotNull()), "column", "value"))
    position: Column = F.lit(None).cast("long")
    for name, levels in ordered.items():
        found = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col("value"))
        position = F.when(F.col("column") == name, F.nullif(found, F.lit(0))).otherwise(position)
    listed = counts.select(
        "column", F.lit("level").alias("kind"), "value", F.col("n"), position.alias("position")
    )
    marks = sorted({p for pair in ranges.values() for p in pair})
    numbers = longer(sales, [], list(ranges), "column", "x", "double")
    table = settle(quantiles(numbers, ["column"], "x", {f"q{p}": p for p in marks}))
    pieces = [listed]
    for name, (low, high) in ranges.items():
        for kind, p in (("low", low), ("high", high)):
            one = table.where(F.col("column") == name).select(
                "column",
                F.lit(kind).alias("kind"),
                F.round(F.col(f"`q{p}`"), 2).cast("string").alias("value"),
                F.lit(None).cast("long").alias("n"),
                F.lit(None).cast("long").alias("position"),
            )
            pieces.append(one)
    return bind_rows(*pieces)


def store_trimmed(results: DataFrame, path: str) -> None:
    """The columns the app looks up, partitioned by area so one area is one folder.

    A hot area is written by as many tasks as its rows need.
    """
    trimmed = results.select("geo_id", "style_desc", "grade_desc", "condition_desc", "sale_price_adj")
    write_table(trimmed, path, "geo_id")
