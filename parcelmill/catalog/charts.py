"""Queries: the tables behind histograms, densities, box plots, grids and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelmill.catalog.inputs import Inputs, rounded
from parcelmill.catalog.registry import query
from parcelmill.functions.dates import month_rank
from parcelmill.operators import aggregates as agg
from parcelmill.operators import distribution as dist
from parcelmill.operators import splines
from parcelmill.operators.factors import level_order
from parcelmill.operators.windows import keep_frequent
from parcelmill.runtime import lookup_join


def bins_sql(value: str, keys: str = "", width: str = "(max(v) - min(v)) / 29.0", source: str = "housing", where: str = "true") -> dict:
    """Steps of a filled histogram: values, width, counts, ends, grid."""
    k = f"{keys}, " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    same = " AND ".join(f"{{a}}.{c.strip()} = {{b}}.{c.strip()}" for c in keys.split(",")) if keys else "true"
    return {
        "vals": f"SELECT {k}CAST({value} AS DOUBLE) AS v FROM {source} WHERE {value} IS NOT NULL AND {where}",
        "wide": f"SELECT {k}{width} AS w FROM vals {by}",
        "slots": f"""SELECT {', '.join('vals.' + c.strip() for c in keys.split(',')) + ',' if keys else ''} w,
            CAST(ceil(v / w - 0.5) AS BIGINT) AS bin, count(*) AS n FROM vals JOIN wide ON {same.format(a='vals', b='wide')} GROUP BY ALL""",
        "grid": f"SELECT {k}w, unnest(range(min(bin), max(bin) + 1)) AS bin FROM slots GROUP BY {k}w",
        "hist": f"""SELECT {', '.join('grid.' + c.strip() for c in keys.split(',')) + ',' if keys else ''} grid.bin,
            round(grid.bin * grid.w, 6) AS center, round(grid.w, 6) AS width, coalesce(slots.n, 0) AS n FROM grid LEFT JOIN slots
            ON grid.bin = slots.bin AND {same.format(a='grid', b='slots')}""",
    }


@query("DS1_histogram", "SELECT * FROM hist", **bins_sql("finished_living_area"))
def ds1(t: Inputs):
    return rounded(dist.histogram(t.kept("finished_living_area"), "finished_living_area"), 6, "center", "width")


@query("DS1_histogram_log_axis", "SELECT * FROM hist", **bins_sql("log10(sale_price_adj)", where="sale_price_adj > 0"))
def ds1_log(t: Inputs):
    return rounded(dist.histogram(t.kept("sale_price_adj"), "sale_price_adj", log10=True), 6, "center", "width")


@query(
    "DS2_histogram_iqr_width",
    "SELECT * FROM hist",
    **bins_sql("sale_price_adj", width="(quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 10"),
)
def ds2(t: Inputs):
    return rounded(dist.iqr_histogram(t.kept("sale_price_adj"), "sale_price_adj"), 6, "center", "width")


@query("DS2_histogram_fixed_width", "SELECT * FROM hist", **bins_sql("year_blt", width="max(5.0::DOUBLE)"))
def ds2_fixed(t: Inputs):
    return dist.histogram(t.housing(), "year_blt", width=5)


@query("DS3_grouped_histogram", "SELECT * FROM hist", **bins_sql("finished_living_area", "style_desc"))
def ds3(t: Inputs):
    table = dist.histogram(t.kept("style_desc", "finished_living_area"), "finished_living_area", ["style_desc"])
    return rounded(table, 6, "center", "width")


@query(
    "DS4_tallest_bin",
    "SELECT geo_id, max(n) AS max_count FROM bins GROUP BY geo_id",
    ends="SELECT geo_id, min(sale_price_adj) AS lo, max(sale_price_adj) AS hi, count(*) AS n FROM housing GROUP BY geo_id",
    cells="SELECT *, (hi - lo) / ceil(log2(n) + 1) AS cell, pow(10, floor(log10((hi - lo) / ceil(log2(n) + 1)))) AS b FROM ends",
    units="""SELECT geo_id, lo, CASE WHEN 10 * b - cell < 1.5 * (cell - 5 * b) THEN 10 * b
        WHEN 5 * b - cell < 2.75 * (cell - 2 * b) THEN 5 * b WHEN 2 * b - cell < 1.5 * (cell - b) THEN 2 * b ELSE b END AS u FROM cells""",
    bins="""SELECT h.geo_id, greatest(ceil(sale_price_adj / u) - 1, floor(lo / u + 1e-7)) AS bin, count(*) AS n
        FROM housing h JOIN units USING (geo_id) GROUP BY ALL""",
)
def ds4(t: Inputs):
    return dist.tallest_bin(dist.pretty_histogram(t.kept("geo_id", "sale_price_adj"), "sale_price_adj", ["geo_id"]), ["geo_id"])


def density_sql(value: str, key: str, points: int) -> dict:
    last = points - 1
    return {
        "vals": f"SELECT {key} AS k, {value} AS v FROM housing",
        "ends": """SELECT k, min(v) AS lo, max(v) AS hi, count(*) AS n, stddev_samp(v) AS sd,
            (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34 AS robust FROM vals GROUP BY k""",
        "bands": """SELECT *, 0.9 * CASE WHEN robust > 0 THEN least(sd, robust) WHEN sd > 0 THEN sd WHEN lo <> 0 THEN abs(lo) ELSE 1 END
            * pow(n, -0.2) AS bw FROM ends""",
        "stats": f"""SELECT k, n, bw, CASE WHEN lo = hi THEN lo - bw ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + bw ELSE hi END AS hi,
            (CASE WHEN lo = hi THEN 2 * bw ELSE hi - lo END) / {last} AS step FROM bands""",
        "places": f"""SELECT s.*, (v - lo) / (hi - lo) * {last} AS p,
            least(greatest(floor((v - lo) / (hi - lo) * {last}), 0), {last - 1}) AS i FROM vals JOIN stats s USING (k)""",
        "shares": """SELECT k, lo, hi, n, step, bw, i, 1.0 - (p - i) AS w FROM places
            UNION ALL SELECT k, lo, hi, n, step, bw, i + 1, p - i FROM places""",
        "grid": "SELECT k, lo, n, step, bw, i, sum(w) AS w FROM shares GROUP BY ALL",
        "total": f"""SELECT k, lo, n, step, bw, j, sum(w * exp(-0.5 * pow((j - i) * step / bw, 2))) AS s FROM grid,
            range({points}) t(j) GROUP BY ALL""",
    }


@query(
    "DS5_density",
    """SELECT k AS style_desc, j AS point, round(lo + j * step, 6) AS x, round(s / (n * bw * sqrt(2 * pi())), 6) AS density FROM total""",
    **density_sql("log10(sale_price_adj)", "style_desc", 512),
)
def ds5(t: Inputs):
    return rounded(dist.density(t.kept("style_desc", "sale_price_adj"), "sale_price_adj", ["style_desc"], log10=True), 6, "x", "density")


def _axis(v: str) -> str:
    return f"""min({v}) AS lo_{v}, max({v}) AS hi_{v}, (max({v}) - min({v})) / 99 AS st_{v},
        1.06 * least(stddev_samp({v}), (quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25)) / 1.34) * pow(count(*), -0.2) AS bw_{v}"""


@query(
    "DS6_density_2d",
    """SELECT CAST(x AS BIGINT) AS ix, CAST(y AS BIGINT) AS iy, round(lo_a + x * st_a, 6) AS x, round(lo_b + y * st_b, 6) AS y,
    round(w / peak, 6) AS ndensity FROM s2, (SELECT max(w) AS peak FROM s2), stats""",
    vals="SELECT finished_living_area AS a, log10(sale_price_adj) AS b FROM housing",
    stats=f"SELECT {_axis('a')}, {_axis('b')} FROM vals",
    cells="""SELECT floor((a - lo_a) / (hi_a - lo_a) * 99 + 0.5) AS i, floor((b - lo_b) / (hi_b - lo_b) * 99 + 0.5) AS j, count(*) AS w
        FROM vals, stats GROUP BY ALL""",
    s1="""SELECT x, j, sum(w * exp(-0.5 * pow((x - i) * st_a / bw_a, 2))) AS w FROM cells, stats, range(100) t(x) GROUP BY ALL""",
    s2="""SELECT x, y, sum(w * exp(-0.5 * pow((y - j) * st_b / bw_b, 2))) AS w FROM s1, stats, range(100) t(y) GROUP BY ALL""",
)
def ds6(t: Inputs):
    table = dist.density_2d(
        t.kept("finished_living_area", "sale_price_adj"), "finished_living_area", "sale_price_adj", log10=(False, True)
    )
    return rounded(table.drop("band"), 6, "x", "y", "ndensity")


def _group_axis(v: str) -> str:
    return f"""min({v}) AS lo_{v}, max({v}) AS hi_{v}, (max({v}) - min({v})) / 99 AS st_{v},
        1.06 * least(stddev_samp({v}), (quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25)) / 1.34) * pow(count(*), -0.2) AS bw_{v}"""


@query(
    "DS6_contour_bands",
    """SELECT k AS style_desc, CAST(least(floor(w / peak * 10) + 1, 10) AS BIGINT) AS band, count(*) AS cells
    FROM s2 JOIN (SELECT k, max(w) AS peak FROM s2 GROUP BY k) USING (k) GROUP BY ALL""",
    vals="SELECT style_desc AS k, lot_area AS a, sale_price_adj AS b FROM housing",
    stats=f"SELECT k, {_group_axis('a')}, {_group_axis('b')} FROM vals GROUP BY k",
    cells="""SELECT k, floor((a - lo_a) / (hi_a - lo_a) * 99 + 0.5) AS i, floor((b - lo_b) / (hi_b - lo_b) * 99 + 0.5) AS j, count(*) AS w
        FROM vals JOIN stats USING (k) GROUP BY ALL""",
    s1="""SELECT k, x, j, sum(w * exp(-0.5 * pow((x - i) * st_a / bw_a, 2))) AS w FROM cells JOIN stats USING (k), range(100) t(x) GROUP BY ALL""",
    s2="""SELECT k, x, y, sum(w * exp(-0.5 * pow((y - j) * st_b / bw_b, 2))) AS w FROM s1 JOIN stats USING (k), range(100) t(y) GROUP BY ALL""",
)
def ds6_bands(t: Inputs):
    chosen = t.kept("style_desc", "lot_area", "sale_price_adj")
    table = dist.density_2d(chosen, "lot_area", "sale_price_adj", ["style_desc"])
    return table.groupBy("style_desc", "band").agg(F.count(F.lit(1)).alias("cells"))


BOX = """SELECT {k}, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
    round(min(CASE WHEN v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN v END), 6) AS whisker_low,
    round(max(CASE WHEN v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN v END), 6) AS whisker_high,
    CAST(sum(CASE WHEN v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers,
    count(*) AS n FROM vals JOIN box ON vals.g IS NOT DISTINCT FROM box.g GROUP BY ALL"""
BOX_NUMBERS = ("q1", "median", "q3", "whisker_low", "whisker_high")


def box_sql(value: str, key: str) -> dict:
    return {
        "vals": f"SELECT {key} AS g, {value} AS v FROM housing",
        "box": """SELECT g, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
            FROM vals GROUP BY g""",
    }


@query("DS7_box_summary", BOX.format(k="vals.g AS condition_desc"), **box_sql("sale_price_adj", "condition_desc"))
def ds7(t: Inputs):
    table = dist.box_summary(t.kept("condition_desc", "sale_price_adj"), ["condition_desc"], "sale_price_adj")
    return rounded(table, 6, *BOX_NUMBERS)


@query("DS7_box_summary_log_axis", BOX.format(k="vals.g AS geo_id"), **box_sql("log10(sale_price_adj)", "geo_id"))
def ds7_log(t: Inputs):
    table = dist.box_summary(t.kept("geo_id", "sale_price_adj"), ["geo_id"], "sale_price_adj", log10=True)
    return rounded(table, 6, *BOX_NUMBERS)


@query(
    "DS8_bar_table",
    "SELECT geo_id, count(*) AS n, row_number() OVER (ORDER BY count(*), geo_id) AS level_rank FROM housing GROUP BY geo_id",
)
def ds8(t: Inputs):
    return dist.bar_table(t.housing(), "geo_id")


@query(
    "DS9_heat_map",
    """SELECT a.grade_desc, b.condition_desc, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT grade_desc FROM housing) a
    CROSS JOIN (SELECT DISTINCT condition_desc FROM housing) b LEFT JOIN (SELECT grade_desc, condition_desc, count(*) AS n
    FROM housing GROUP BY ALL) c ON a.grade_desc IS NOT DISTINCT FROM c.grade_desc
    AND b.condition_desc IS NOT DISTINCT FROM c.condition_desc""",
)
def ds9(t: Inputs):
    return dist.heatmap(t.housing(), "grade_desc", "condition_desc")


@query(
    "DS10_trend",
    """SELECT k AS style_desc, p AS point, round(lo + p / 79.0 * (hi - lo), 4) AS x,
    round((s2 * t0 - s1 * t1 + (s0 * t1 - s1 * t0) * p / 79.0) / (s0 * s2 - s1 * s1), 2) AS y FROM sums""",
    vals="""SELECT style_desc AS k, CAST(finished_living_area AS DOUBLE) AS x, sale_price_adj AS v FROM housing""",
    stats="SELECT k, min(x) AS lo, max(x) AS hi FROM vals GROUP BY k",
    slices="""SELECT k, lo, hi, least(floor(u * 512), 511) AS i, count(*) AS c0, sum(u) AS c1, sum(u * u) AS c2, sum(v) AS d0,
        sum(u * v) AS d1 FROM (SELECT k, lo, hi, v, (x - lo) / (hi - lo) AS u FROM vals JOIN stats USING (k)) GROUP BY ALL""",
    weights="""SELECT *, exp(-0.5 * pow(((i + 0.5) / 512 - p / 79.0) / 0.1, 2)) AS w FROM slices, range(80) t(p)""",
    sums="""SELECT k, lo, hi, p, sum(w * c0) AS s0, sum(w * c1) AS s1, sum(w * c2) AS s2, sum(w * d0) AS t0, sum(w * d1) AS t1
        FROM weights GROUP BY ALL""",
)
def ds10(t: Inputs):
    table = dist.trend(t.kept("style_desc", "finished_living_area", "sale_price_adj"), "finished_living_area", "sale_price_adj", ["style_desc"])
    return rounded(rounded(table, 4, "x"), 2, "y")


@query("DS10_spline_trend")
def ds10_spline(t: Inputs):
    """The drift of prices over the years as a penalised spline with its band, per style."""
    rows = t.kept("style_desc", "sale_date", "sale_price_adj").withColumn("day", F.datediff("sale_date", F.lit("1990-01-01")))
    return rounded(splines.trend(rows, "day", "sale_price_adj", ["style_desc"]), 2, "x", "y", "y_lower", "y_upper")


@query(
    "DS10_spline_holds",
    """SELECT style_desc, count(*) AS n, round(avg(sale_price_adj), 2) AS mean, round(avg(sale_price_adj * day) / avg(day), 2) AS slanted, true AS fits_better
    FROM (SELECT *, date_diff('day', DATE '1990-01-01', sale_date) AS day FROM housing) GROUP BY style_desc""",
)
def ds10_spline_holds(t: Inputs):
    """A penalty on bends leaves lines alone: smoothed values have the mean of the prices and the same product with the day."""
    rows = t.kept("style_desc", "sale_date", "sale_price_adj").withColumn("day", F.datediff("sale_date", F.lit("1990-01-01")))
    smooth = splines.smoothed(rows, splines.fit(rows, "day", "sale_price_adj", ["style_desc"]), "day", ["style_desc"])
    price = F.col("sale_price_adj")
    table = smooth.groupBy("style_desc").agg(
        F.count(F.lit(1)).alias("n"), F.avg("smooth").alias("mean"), (F.avg(F.col("smooth") * F.col("day")) / F.avg("day")).alias("slanted"),
        (F.avg(F.pow(price - F.col("smooth"), 2)) <= F.var_pop(price)).alias("fits_better"),
    )
    return rounded(table, 2, "mean", "slanted")


@query(
    "DS11_count_and_median_per_year",
    """SELECT sale_year, style_desc, round(quantile_cont(sale_price_adj, 0.5), 6) AS median, count(*) AS n FROM housing GROUP BY ALL""",
)
def ds11(t: Inputs):
    table = agg.count_and_median(t.kept("sale_year", "style_desc", "sale_price_adj"), ["sale_year", "style_desc"], "sale_price_adj")
    return rounded(table, 6, "median")


@query(
    "DS12_scatter_pairs",
    """SELECT style_desc, finished_living_area, sale_price_adj, bedrooms FROM housing WHERE bedrooms IS NOT NULL""",
)
def ds12(t: Inputs):
    return dist.scatter(t.housing(), "style_desc", "finished_living_area", "sale_price_adj", "bedrooms")


@query(
    "DS13_colour_scale",
    """SELECT geo_id, median, round((median - min(median) OVER ()) / (max(median) OVER () - min(median) OVER ()), 6) AS scaled
    FROM (SELECT geo_id, quantile_cont(sale_price_adj, 0.5) AS median FROM housing GROUP BY geo_id)""",
)
def ds13(t: Inputs):
    table = agg.median(t.kept("geo_id", "sale_price_adj"), ["geo_id"], "sale_price_adj")
    return rounded(dist.rescale(table, "median"), 6, "scaled")


@query(
    "DS14_month_profile",
    """SELECT sale_month, month(any_value(sale_date)) AS month_rank, count(*) AS n FROM housing GROUP BY sale_month""",
)
def ds14(t: Inputs):
    counts = agg.count_by(t.housing(), "sale_month")
    return counts.select("sale_month", month_rank(F.col("sale_month")).cast("long").alias("month_rank"), "n").orderBy("month_rank")


@query(
    "DS3_histogram_of_frequent_areas",
    "SELECT * FROM hist",
    **{
        "kept": """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY geo_id) AS cnt FROM housing)
            WHERE cnt > (SELECT count(*) / 25 FROM housing)""",
        **bins_sql("house_age_at_sale", "geo_id", source="kept"),
    },
)
def ds3_frequent(t: Inputs):
    housing = t.kept("geo_id", "house_age_at_sale")
    kept = keep_frequent(housing, "geo_id", housing.count() / 25)
    return rounded(dist.histogram(kept, "house_age_at_sale", ["geo_id"]), 6, "center", "width")


@query(
    "DS7_box_with_rank",
    """SELECT g AS style_desc, round(median, 6) AS median, row_number() OVER (ORDER BY median, g) AS level_rank FROM box""",
    **box_sql("sale_price_adj", "style_desc"),
)
def ds7_rank(t: Inputs):
    housing = t.kept("style_desc", "sale_price_adj")
    boxes = dist.box_summary(housing, ["style_desc"], "sale_price_adj").select("style_desc", "median")
    ranks = level_order(housing, "style_desc", "sale_price_adj").select("style_desc", "level_rank")
    return rounded(lookup_join(boxes, ranks, ["style_desc"]), 6, "median")
