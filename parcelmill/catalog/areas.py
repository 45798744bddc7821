"""Queries: points, polygons, hulls, nearest sites, grids."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from parcelmill.catalog.inputs import Inputs, rounded
from parcelmill.catalog.registry import query
from parcelmill.functions import property_rules as rules
from parcelmill.operators import aggregates as agg
from parcelmill.operators import geography as geo
from parcelmill.operators import relational as rel
from parcelmill.operators.factors import rank_levels
from parcelmill.runtime import lookup_join, settle

INSIDE = "s.longitude BETWEEN r.x0 AND r.x1 AND s.latitude BETWEEN r.y0 AND r.y1"


@query(
    "GE1_points",
    "SELECT par_id, longitude, latitude FROM sales WHERE longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90",
)
def ge1(t: Inputs):
    return geo.points(t.sales()).select("par_id", "longitude", "latitude")


@query(
    "GE2_assign_overlapping_areas",
    """SELECT s.par_id, d.name AS geo_id FROM spots s LEFT JOIN (SELECT label AS name, min(x) AS x0, max(x) AS x1, min(y) AS y0,
      max(y) AS y1 FROM town_layer GROUP BY label) d
    ON abs(s.longitude - (x0 + x1) / 2) / ((x1 - x0) / 2) + abs(s.latitude - (y0 + y1) / 2) / ((y1 - y0) / 2) < 1""",
)
def ge2(t: Inputs):
    towns = t.town_layer().withColumnRenamed("label", "geo_id")
    return geo.assign_areas(t.spots(), towns).select("par_id", "geo_id")


@query(
    "GE3_repair_missed_points",
    """SELECT par_id, coalesce(r.geo_id, CASE s.school_desc WHEN 'ASIA' THEN 'EAST' WHEN 'EUROPE' THEN 'NORTH' END) AS geo_id
    FROM spots s LEFT JOIN (SELECT * FROM rectangles WHERE geo_id <> 'AREA_7') r ON """
    + INSIDE,
)
def ge3(t: Inputs):
    vertices = t.rectangles().where(F.col("geo_id") != "AREA_7")
    placed = geo.assign_areas(t.spots(), vertices)
    name = rules.recode(F.col("school_desc"), {"ASIA": "EAST", "EUROPE": "NORTH"})
    fixed = rel.repair_rows(placed, F.col("geo_id").isNull(), "par_id", lambda bad: bad.withColumn("geo_id", name))
    return fixed.select("par_id", "geo_id")


UNIFIED = """SELECT school_district AS geo_id, 'school_district' AS layer, part_id, seq, x, y FROM school_layer
      WHERE school_district <> 'NATION_3'
    UNION ALL SELECT council_district, 'council_district', part_id, seq, x, y FROM council_layer
    UNION ALL SELECT label, 'label', part_id, seq, x, y FROM town_layer WHERE label = 'ASIA'"""


def unified(t: Inputs):
    layers = {"school_district": t.school_layer(), "council_district": t.council_layer(), "label": t.town_layer()}
    return geo.unify_layers(layers, ("school_district", "NATION_3"), {"label": ["ASIA"]})


@query(
    "GE4_merge_layers",
    f"SELECT geo_id, layer, seq, round(x, 6) AS x, round(y, 6) AS y FROM ({UNIFIED})",
)
def ge4(t: Inputs):
    return rounded(unified(t).drop("part_id"), 6, "x", "y")


@query(
    "GE5_dissolve_parts",
    """SELECT geo_id, count(DISTINCT part) AS n_parts, count(*) AS n_vertices FROM (
      SELECT CASE WHEN school_district < 'NATION_2' THEN 'WEST' ELSE 'EAST' END AS geo_id, school_district AS part
      FROM school_layer) GROUP BY geo_id""",
)
def ge5(t: Inputs):
    side = F.when(F.col("geo_id") < "NATION_2", F.lit("WEST")).otherwise(F.lit("EAST"))
    layered = t.areas().withColumn("layer", F.col("geo_id")).withColumn("geo_id", side)
    parts = geo.dissolve(layered).groupBy("geo_id", "part_id").agg(F.count(F.lit(1)).alias("n"))
    return parts.groupBy("geo_id").agg(
        F.count(F.lit(1)).alias("n_parts"), F.sum("n").cast("long").alias("n_vertices")
    )


@query(
    "GE6_centroids",
    """SELECT school_district AS geo_id, round((min(x) + max(x)) / 2, 6) AS lng, round((min(y) + max(y)) / 2, 6) AS lat
    FROM school_layer GROUP BY school_district""",
)
def ge6(t: Inputs):
    return rounded(geo.centroids(t.areas()), 6, "lng", "lat")


METRES = (math.pi / 180 * geo.EARTH_RADIUS_M) ** 2


@query(
    "GE7_area_size",
    f"""SELECT school_district AS geo_id, round((max(x) - min(x)) * (max(y) - min(y)) / 2
    * cos(radians((min(y) + max(y)) / 2)) * {METRES!r} / 1e6, 4) AS area_km2 FROM school_layer GROUP BY school_district""",
)
def ge7(t: Inputs):
    sizes = geo.area_size(t.areas())
    return sizes.select("geo_id", F.round(F.col("area_m2") / 1e6, 4).alias("area_km2"))


@query("GE8_convex_hulls")
def ge8(t: Inputs):
    return geo.convex_hulls(t.sales().withColumnRenamed("school_desc", "geo_name"), "geo_name")


@query(
    "GE8_points_inside_their_hull",
    "SELECT school_desc, count(*) AS n, 0::BIGINT AS n_outside FROM sales GROUP BY school_desc",
)
def ge8_inside(t: Inputs):
    sales = settle(t.sales().select("par_id", F.col("school_desc").alias("geo_id"), "longitude", "latitude"))
    sides = geo.edges(geo.convex_hulls(sales, "geo_id")).groupBy("geo_id").agg(
        F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("ring")
    )
    joined = lookup_join(sales, sides, ["geo_id"])
    # Every point is on the left of, or on, every edge of a counter-clockwise ring.
    turn = lambda e: (e["x2"] - e["x1"]) * (F.col("latitude") - e["y1"]) - (e["y2"] - e["y1"]) * (
        F.col("longitude") - e["x1"]
    )
    outside = F.exists("ring", lambda e: turn(e) < -1e-12)
    return joined.groupBy(F.col("geo_id").alias("school_desc")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(outside, 1).otherwise(0)).alias("n_outside")
    )


@query(
    "GE9_first_of_overlapping_areas",
    """SELECT par_id, geo_id FROM (SELECT s.par_id, d.name AS geo_id, row_number() OVER (PARTITION BY s.par_id
      ORDER BY d.area_rank) AS r FROM spots s LEFT JOIN (SELECT label AS name, min(x) AS x0, max(x) AS x1, min(y) AS y0,
      max(y) AS y1, row_number() OVER (ORDER BY label DESC) AS area_rank FROM town_layer GROUP BY label) d
    ON abs(s.longitude - (x0 + x1) / 2) / ((x1 - x0) / 2) + abs(s.latitude - (y0 + y1) / 2) / ((y1 - y0) / 2) < 1)
    WHERE r = 1""",
)
def ge9(t: Inputs):
    towns = settle(t.town_layer().withColumnRenamed("label", "geo_id"))
    order = rank_levels(towns.select("geo_id").distinct(), F.desc("geo_id"), name="area_rank")
    return geo.first_area(t.spots(), towns, order, "par_id")


@query(
    "GE10_nearest_site",
    """SELECT par_id, geo_id AS nearest FROM (SELECT s.par_id, c.geo_id, row_number() OVER (PARTITION BY s.par_id ORDER BY
      (s.longitude - c.lng) * (s.longitude - c.lng) + (s.latitude - c.lat) * (s.latitude - c.lat), c.geo_id) AS r
      FROM spots s CROSS JOIN sites c) WHERE r = 1""",
    sites="""SELECT geo_id, max_by(longitude, par_id) AS lng, max_by(latitude, par_id) AS lat FROM sales GROUP BY geo_id""",
)
def ge10(t: Inputs):
    sites = t.sales().groupBy("geo_id").agg(
        F.max_by("longitude", "par_id").alias("longitude"), F.max_by("latitude", "par_id").alias("latitude")
    )
    found = geo.nearest_site(t.spots(), sites, "par_id", "geo_id")
    return found.select("par_id", F.col("geo_id").alias("nearest"))


@query(
    "GE11_grid_bins",
    """SELECT CAST(floor(longitude / 0.05) AS BIGINT) AS cell_x, CAST(floor(latitude / 0.05) AS BIGINT) AS cell_y, count(*) AS n,
    round(avg(abs(log10(sale_price_adj) - 5.2)), 6) AS mean_value FROM housing GROUP BY ALL""",
)
def ge11(t: Inputs):
    gap = F.abs(F.log10("sale_price_adj") - 5.2)
    return rounded(geo.grid_bins(t.housing(), gap, 0.05), 6, "mean_value")


@query(
    "GE12_choropleth",
    """SELECT geo_id, round((median - min(median) OVER ()) / (max(median) OVER () - min(median) OVER ()), 6) AS shade,
    coalesce(geo_id || ': ' || format('{:,}', CAST(round(median) AS BIGINT)), geo_id) AS label
    FROM (SELECT DISTINCT school_district AS geo_id FROM school_layer) LEFT JOIN
      (SELECT geo_id, quantile_cont(sale_price_adj, 0.5) AS median FROM housing GROUP BY geo_id) USING (geo_id)""",
)
def ge12(t: Inputs):
    metric = agg.median(t.kept("geo_id", "sale_price_adj"), ["geo_id"], "sale_price_adj")
    table = geo.choropleth(t.areas().select("geo_id").distinct(), metric, "median")
    return rounded(table.select("geo_id", "shade", "label"), 6, "shade")


@query("GE13_drop_geometry", "SELECT DISTINCT geo_id FROM (" + UNIFIED + ")")
def ge13(t: Inputs):
    return unified(t).drop("layer", "part_id", "seq", "x", "y").distinct()


@query(
    "GE14_selected_area",
    "SELECT par_id, sale_price_adj FROM housing WHERE geo_id = 'NATION_7'",
)
def ge14(t: Inputs):
    return geo.area_lookup(t.housing(), "NATION_7").select("par_id", "sale_price_adj")
