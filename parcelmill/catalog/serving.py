"""Queries: the app's questions over a table of what-if houses."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelmill.catalog.aggregation import in_list
from parcelmill.catalog.charts import density_sql
from parcelmill.catalog.inputs import Inputs, rounded
from parcelmill.catalog.pricing import AREA, BOUNDS, FIT1, T_TERMS, small_fit
from parcelmill.catalog.registry import query
from parcelmill.functions.numeric import normal_quantile
from parcelmill.functions.property_rules import CONDITION_ORDER, GRADE_ORDER
from parcelmill.operators.distribution import heatmap, histogram
from parcelmill.operators.models import least_squares, predict
from parcelmill.operators.recipe import with_label
from parcelmill.plans import serving
from parcelmill.runtime import scratch_path, settle
from parcelmill.sources.tables import read_table

SCORED_REQUESTS = {
    **FIT1,
    "asked": "SELECT r.*, pow(10, a + b * finished_living_area) AS pred_dollar FROM requests r, fit1",
}


@query(
    "SV1_score_requests",
    """SELECT request_id, round(log10(pred_dollar), 6) AS pred, round(pred_dollar, 3) AS pred_dollar,
    '$' || format('{:,}', CAST(round(pred_dollar) AS BIGINT)) AS price_text FROM asked""",
    **SCORED_REQUESTS,
)
def sv1(t: Inputs):
    scored = serving.score_requests(small_fit(t.housing(), AREA), t.requests())
    return rounded(rounded(scored, 6, "pred"), 3, "pred_dollar")


@query(
    "SV1_requests_with_bounds",
    """SELECT request_id, round(pow(10, a + b * finished_living_area), 3) AS pred_dollar,
    round(pow(10, a + b * finished_living_area - half), 2) AS pred_lower_dollar,
    round(pow(10, a + b * finished_living_area + half), 2) AS pred_upper_dollar FROM (
      SELECT r.request_id, r.finished_living_area, a, b, (TERMS) * sqrt(s2 * (1.0 / n + pow(r.finished_living_area - xm, 2) / sxx)) AS half
      FROM requests r, fit1, spread)""".replace("TERMS", f"{normal_quantile(0.975)!r} + {T_TERMS}"),
    **BOUNDS,
)
def sv1_bounds(t: Inputs):
    housing = t.kept("par_id", "sale_price_adj", *AREA)
    model = small_fit(housing, AREA)
    closed = least_squares(with_label(predict(model, housing)), names=AREA)
    scored = serving.score_requests(model, t.requests(), closed)
    table = scored.select("request_id", "pred_dollar", "pred_lower_dollar", "pred_upper_dollar")
    return rounded(rounded(table, 3, "pred_dollar"), 2, "pred_lower_dollar", "pred_upper_dollar")


@query(
    "SV2_comparable_sales",
    "SELECT request_id, h.par_id, h.sale_price_adj FROM housing h JOIN requests r USING (geo_id, style_desc)",
)
def sv2(t: Inputs):
    found = serving.comparable_sales(t.housing(), t.requests())
    return found.select("request_id", "par_id", "sale_price_adj")


STYLES = """SELECT request_id, p.style_desc, p.n, r.geo_id FROM requests r JOIN (SELECT geo_id, CASE WHEN k <= {top} THEN style_desc ELSE 'Other' END
      AS style_desc, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, rank() OVER (PARTITION BY geo_id ORDER BY n DESC) AS k FROM
      (SELECT geo_id, style_desc, count(*) AS n FROM housing GROUP BY ALL)) GROUP BY 1, 2) p ON p.geo_id = r.geo_id"""


@query("SV3_top_styles", STYLES.format(top=5))
def sv3(t: Inputs):
    return serving.top_styles(t.housing(), t.requests())


@query("SV3_top_three_styles", STYLES.format(top=3))
def sv3_three(t: Inputs):
    """With fewer places than styles, the rest are pooled."""
    return serving.top_styles(t.housing(), t.requests(), 3)


@query(
    "SV4_price_histogram",
    """SELECT a.request_id, s.geo_id, s.style_desc, s.bin, round(s.bin * s.w, 6) AS center, round(s.w, 6) AS width, s.n,
    ceil(a.pred_dollar / s.w - 0.5) = s.bin AS is_prediction FROM filled s JOIN asked a USING (geo_id, style_desc)""",
    **SCORED_REQUESTS,
    wide="""SELECT geo_id, style_desc, (quantile_cont(sale_price_adj, 0.75) - quantile_cont(sale_price_adj, 0.25)) / 10 AS w
        FROM housing GROUP BY ALL""",
    slots="""SELECT geo_id, style_desc, w, CAST(ceil(sale_price_adj / w - 0.5) AS BIGINT) AS bin, count(*) AS n FROM housing
        JOIN wide USING (geo_id, style_desc) GROUP BY ALL""",
    grid="SELECT geo_id, style_desc, w, unnest(range(min(bin), max(bin) + 1)) AS bin FROM slots GROUP BY geo_id, style_desc, w",
    filled="""SELECT g.geo_id, g.style_desc, g.w, g.bin, coalesce(s.n, 0) AS n FROM grid g LEFT JOIN slots s
        ON s.geo_id = g.geo_id AND s.style_desc = g.style_desc AND s.bin = g.bin""",
)
def sv4(t: Inputs):
    housing, requests = t.kept(), settle(t.requests())
    predictions = predict(small_fit(housing), requests).select("request_id", "pred_dollar")
    table = serving.price_histogram(housing, requests, predictions)
    return rounded(table, 6, "center", "width")


@query(
    "SV5_rating_grid",
    f"""SELECT r.request_id, g.geo_id, g.style_desc, g.grade_desc, c.condition_desc, coalesce(n, 0) AS n,
    CAST({len(GRADE_ORDER)} + 1 - list_position([{in_list(GRADE_ORDER)}], g.grade_desc) AS BIGINT) AS grade_rank,
    CAST({len(CONDITION_ORDER)} + 1 - list_position([{in_list(CONDITION_ORDER)}], c.condition_desc) AS BIGINT) AS condition_rank
    FROM (SELECT DISTINCT geo_id, style_desc, grade_desc FROM rated) g
    JOIN (SELECT DISTINCT geo_id, style_desc, condition_desc FROM rated) c ON c.geo_id = g.geo_id AND c.style_desc = g.style_desc
    LEFT JOIN (SELECT geo_id, style_desc, grade_desc, condition_desc, count(*) AS n FROM rated GROUP BY ALL) k
      ON k.geo_id = g.geo_id AND k.style_desc = g.style_desc AND k.grade_desc = g.grade_desc AND k.condition_desc = c.condition_desc
    JOIN requests r ON r.geo_id = g.geo_id AND r.style_desc = g.style_desc""",
    rated="SELECT * FROM housing WHERE grade_desc IS NOT NULL AND condition_desc IS NOT NULL",
)
def sv5(t: Inputs):
    return serving.rating_grid(t.kept(), settle(t.requests()))


PROFILES = ("bedrooms", "fullbaths", "halfbaths", "sale_month")


@query(
    "SV6_feature_profiles",
    "SELECT request_id, p.* FROM requests r JOIN ("
    + " UNION ALL ".join(
        f"SELECT geo_id, style_desc, '{c}' AS feature, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM housing GROUP BY ALL"
        for c in PROFILES
    )
    + ") p ON p.geo_id = r.geo_id AND p.style_desc = r.style_desc",
)
def sv6(t: Inputs):
    return serving.feature_profiles(t.housing(), t.requests(), PROFILES)


@query(
    "SV6_feature_quartiles",
    "SELECT request_id, p.* FROM requests r JOIN ("
    + " UNION ALL ".join(
        f"""SELECT geo_id, style_desc, '{c}' AS feature, round(quantile_cont({c}, 0.25), 6) AS q1,
        round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3 FROM housing GROUP BY ALL"""
        for c in ("lot_area", "finished_living_area", "year_blt")
    )
    + ") p ON p.geo_id = r.geo_id AND p.style_desc = r.style_desc",
)
def sv6_quartiles(t: Inputs):
    wide = ("lot_area", "finished_living_area", "year_blt")
    table = serving.feature_quartiles(t.kept(), t.requests(), wide)
    return rounded(table, 6, "q1", "median", "q3")


@query(
    "SV6_bedroom_bathroom_grid",
    """SELECT a.geo_id, a.bedrooms, b.fullbaths, coalesce(n, 0) AS n FROM (SELECT DISTINCT geo_id, bedrooms FROM housing) a
    JOIN (SELECT DISTINCT geo_id, fullbaths FROM housing) b ON a.geo_id = b.geo_id LEFT JOIN (SELECT geo_id, bedrooms, fullbaths,
    count(*) AS n FROM housing GROUP BY ALL) c ON c.geo_id = a.geo_id AND c.bedrooms IS NOT DISTINCT FROM a.bedrooms
    AND c.fullbaths IS NOT DISTINCT FROM b.fullbaths""",
)
def sv6_grid(t: Inputs):
    return heatmap(t.housing(), "bedrooms", "fullbaths", ["geo_id"])


@query(
    "SV6_bathroom_grid",
    """SELECT r.request_id, a.fullbaths, b.halfbaths, coalesce(n, 0) AS n FROM requests r
    JOIN (SELECT DISTINCT geo_id, style_desc, fullbaths FROM housing) a ON a.geo_id = r.geo_id AND a.style_desc = r.style_desc
    JOIN (SELECT DISTINCT geo_id, style_desc, halfbaths FROM housing) b ON b.geo_id = r.geo_id AND b.style_desc = r.style_desc
    LEFT JOIN (SELECT geo_id, style_desc, fullbaths, halfbaths, count(*) AS n FROM housing GROUP BY ALL) c
    ON c.geo_id = r.geo_id AND c.style_desc = r.style_desc AND c.fullbaths IS NOT DISTINCT FROM a.fullbaths
    AND c.halfbaths IS NOT DISTINCT FROM b.halfbaths""",
)
def sv6_baths(t: Inputs):
    return serving.bath_grid(t.housing(), t.requests()).select("request_id", "fullbaths", "halfbaths", "n")


# The id of a request is made of what its comparables have in common.
COMPARABLE = "geo_id || '|' || style_desc"
DENSITY = """SELECT k AS request_id, j AS point, round(lo + j * step, 6) AS x, round(s / (n * bw * sqrt(2 * pi())), 9) AS density
    FROM total WHERE k IN (SELECT request_id FROM requests)"""


def _density(t: Inputs, column: str):
    t = t.stored()
    requests = settle(t.requests().select("request_id", *serving.MATCH))
    table = serving.feature_density(t.housing(), requests, column).select("request_id", "point", "x", "density")
    return rounded(rounded(table, 6, "x"), 9, "density")


@query("SV6_living_area_density", DENSITY, **density_sql("finished_living_area", COMPARABLE, 512))
def sv6_density(t: Inputs):
    return _density(t, "finished_living_area")


@query("SV6_lot_area_density", DENSITY, **density_sql("lot_area", COMPARABLE, 512))
def sv6_lots(t: Inputs):
    return _density(t, "lot_area")


@query(
    "SV6_year_built_of_comparables",
    """SELECT r.request_id, g.bin, g.bin * 5.0::DOUBLE AS center, 5.0::DOUBLE AS width, coalesce(n, 0) AS n FROM requests r
    JOIN grid g ON g.geo_id = r.geo_id AND g.style_desc = r.style_desc
    LEFT JOIN slots s ON s.geo_id = g.geo_id AND s.style_desc = g.style_desc AND s.bin = g.bin""",
    slots="SELECT geo_id, style_desc, CAST(ceil(year_blt / 5.0::DOUBLE - 0.5) AS BIGINT) AS bin, count(*) AS n FROM housing GROUP BY ALL",
    grid="SELECT geo_id, style_desc, unnest(range(min(bin), max(bin) + 1)) AS bin FROM slots GROUP BY geo_id, style_desc",
)
def sv6_years_of_comparables(t: Inputs):
    table = serving.feature_histogram(t.housing(), t.requests(), "year_blt", 5)
    return table.select("request_id", "bin", "center", "width", "n")


@query(
    "SV6_year_built_histogram",
    """SELECT g.style_desc, g.bin, g.bin * 5.0::DOUBLE AS center, 5.0::DOUBLE AS width, coalesce(n, 0) AS n FROM grid g
    LEFT JOIN slots s ON s.style_desc = g.style_desc AND s.bin = g.bin""",
    slots="SELECT style_desc, CAST(ceil(year_blt / 5.0::DOUBLE - 0.5) AS BIGINT) AS bin, count(*) AS n FROM housing GROUP BY ALL",
    grid="SELECT style_desc, unnest(range(min(bin), max(bin) + 1)) AS bin FROM slots GROUP BY style_desc",
)
def sv6_years(t: Inputs):
    return histogram(t.housing(), "year_blt", ["style_desc"], width=5)


def _line(label: str, column: str, kind: str) -> str:
    number = f"format('{{:,}}', CAST(round({column}) AS BIGINT))"
    shown = {"area": f"{number} || ' sq. ft.'", "dollar": f"'$' || {number}"}.get(kind, f"CAST({column} AS VARCHAR)")
    return f"'{label} ' || coalesce({shown}, 'NA')"


@query(
    "SV7_request_text",
    "SELECT request_id, " + " || chr(10) || ".join(_line(*line) for line in serving.SUMMARY_LINES) + " AS summary FROM asked",
    **SCORED_REQUESTS,
)
def sv7(t: Inputs):
    scored = predict(small_fit(t.housing()), t.requests())
    return serving.request_text(scored)


@query(
    "SV8_value_domains",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", 'level' AS kind, {c} AS value, count(*) AS n, CAST({place} AS BIGINT) AS position
        FROM housing WHERE {c} IS NOT NULL GROUP BY {c}"""
        for c, place in (
            ("geo_id", "NULL"),
            ("style_desc", "NULL"),
            ("grade_desc", f"list_position([{in_list(GRADE_ORDER)}], grade_desc)"),
            ("condition_desc", f"list_position([{in_list(CONDITION_ORDER)}], condition_desc)"),
        )
    )
    + "".join(
        f""" UNION ALL SELECT '{c}', '{kind}', CAST(round(quantile_cont({c}, {p}), 2) AS VARCHAR), NULL, NULL FROM housing"""
        for c, kind, p in (
            ("lot_area", "low", 0.0), ("lot_area", "high", 0.7), ("finished_living_area", "low", 0.0),
            ("finished_living_area", "high", 0.95), ("year_blt", "low", 0.0), ("year_blt", "high", 1.0),
        )
    ).replace("quantile_cont(year_blt", "quantile_cont(CAST(year_blt AS DOUBLE)"),
)
def sv8(t: Inputs):
    return serving.value_domains(
        t.kept("geo_id", "style_desc", "grade_desc", "condition_desc", "lot_area", "finished_living_area", "year_blt"),
        ["geo_id", "style_desc"],
        {"grade_desc": GRADE_ORDER, "condition_desc": CONDITION_ORDER},
        {"lot_area": (0.0, 0.7), "finished_living_area": (0.0, 0.95), "year_blt": (0.0, 1.0)},
    )


@query(
    "SV9_trimmed_results",
    """SELECT geo_id, style_desc, count(*) AS n, max(sale_price_adj) AS highest FROM housing GROUP BY ALL""",
)
def sv9(t: Inputs):
    path = scratch_path(t.spark, "trimmed")
    serving.store_trimmed(t.housing(), path)
    return read_table(t.spark, path).groupBy("geo_id", "style_desc").agg(
        F.count(F.lit(1)).alias("n"), F.max("sale_price_adj").alias("highest")
    )
