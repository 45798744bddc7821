"""Queries: scans and sinks, projection and filters, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelmill.catalog.inputs import GRADES, HOUSING_TYPES, Inputs, rounded
from parcelmill.catalog.registry import query
from parcelmill.functions import property_rules as rules
from parcelmill.operators import geography as geo
from parcelmill.operators import models
from parcelmill.operators import relational as rel
from parcelmill.operators.aggregates import count_by, quantiles
from parcelmill.operators.recipe import GRADE_GROUPS, DesignVector
from parcelmill.operators.windows import keep_frequent
from parcelmill.plans import cleaning
from parcelmill.runtime import big_join, lookup_join, scratch_path
from parcelmill.sources import tables as io

# --- IO: scans, sources, sinks -----------------------------------------------

RAW_SCHEMA = """par_id string, usedesc string, school_desc string, muni_desc string, sale_desc string,
 sale_price double, sale_date string, year_blt bigint, style_desc string, bedrooms bigint, fullbaths bigint,
 halfbaths bigint, finished_living_area double, lot_area double, grade_desc string, condition_desc string,
 heatingcooling_desc string"""


@query("IO1_large_csv_scan", "SELECT * FROM raw")
def io1(t: Inputs):
    path = scratch_path(t.spark, "assessments")
    io.write_csv(t.raw(), path)
    return io.read_csv(t.spark, path, RAW_SCHEMA)


@query(
    "IO2_csv_scan_summary",
    "SELECT style_desc, count(*) AS n, round(sum(sale_price), 2) AS total FROM sales WHERE sale_price > 100 GROUP BY 1",
)
def io2(t: Inputs):
    path = scratch_path(t.spark, "sales")
    io.write_csv(t.sales().select("par_id", "style_desc", "sale_price"), path)
    back = io.read_csv(t.spark, path, "par_id bigint, style_desc string, sale_price double")
    sums = back.where(F.col("sale_price") > 100).groupBy("style_desc")
    return sums.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("sale_price"), 2).alias("total"))


@query("IO3_partitioned_sink", "SELECT geo_id, count(*) AS n, max(par_id) AS last_par_id FROM sales GROUP BY geo_id")
def io3(t: Inputs):
    path = scratch_path(t.spark, "by-area")
    io.write_csv(t.sales().select("geo_id", "par_id"), path, partition_by="geo_id")
    back = io.read_csv(t.spark, path, "par_id bigint, geo_id string")
    return back.groupBy("geo_id").agg(F.count(F.lit(1)).alias("n"), F.max("par_id").alias("last_par_id"))


@query(
    "IO4_polygon_scan",
    """SELECT school_district AS geo_id, part_id, seq, round(x, 6) AS x, round(y, 6) AS y FROM school_layer""",
)
def io4(t: Inputs):
    path = scratch_path(t.spark, "polygons")
    io.write_polygons(t.areas(), path)
    return rounded(io.read_polygons(t.spark, path), 6, "x", "y")


@query("IO5_polygon_sink", "SELECT school_district AS geo_id, count(*) AS n_vertices FROM school_layer GROUP BY 1")
def io5(t: Inputs):
    path = scratch_path(t.spark, "layer")
    io.write_polygons(t.areas(), path)
    return io.read_polygons(t.spark, path).groupBy("geo_id").agg(F.count(F.lit(1)).alias("n_vertices"))


@query("IO6_model_save_load", "SELECT count(*) AS n, 0.0::DOUBLE AS largest_difference FROM housing")
def io6(t: Inputs):
    housing = t.kept()
    fitted = models.fit(housing, models.linear(), [DesignVector(["finished_living_area"])])
    path = scratch_path(t.spark, "model")
    io.save_model(fitted, path)
    first = fitted.transform(housing).withColumnRenamed("pred", "before").drop("features")
    again = io.load_model(path).transform(first)
    gap = F.abs(F.col("pred") - F.col("before"))
    return again.agg(F.count(F.lit(1)).alias("n"), F.round(F.max(gap), 6).alias("largest_difference"))


LEVELS = [(k, v) for k, v in GRADES.items()]


@query(
    "IO7_literal_table",
    f"""SELECT l.label, count(*) AS n FROM sales s JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in LEVELS)})
    AS l(digit, label) ON substr(s.grade_desc, 1, 1) = l.digit GROUP BY l.label""",
)
def io7(t: Inputs):
    labels = io.literal_table(t.spark, LEVELS, "digit string, label string")
    graded = t.sales().withColumn("digit", F.substring("grade_desc", 1, 1))
    return lookup_join(graded, labels, ["digit"], "inner", base_table=True).groupBy("label").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "IO8_schema_preview",
    " UNION ALL ".join(
        f"""SELECT CAST({k + 1} AS BIGINT) AS position, '{c}' AS "column", '{kind}' AS type, coalesce(string_agg(CAST({c} AS VARCHAR), ', ' ORDER BY par_id), '')
        AS first_values FROM head"""
        for k, (c, kind) in enumerate(HOUSING_TYPES.items())
    ),
    head="SELECT * FROM housing ORDER BY par_id LIMIT 5",
)
def io8(t: Inputs):
    return io.preview(t.housing().orderBy("par_id"))


@query("IO9_published_view", "SELECT geo_id, count(*) AS n FROM housing GROUP BY geo_id")
def io9(t: Inputs):
    io.publish(t.housing(), "clean_sales")
    return t.spark.sql("SELECT geo_id, count(*) AS n FROM clean_sales GROUP BY geo_id")


@query("IO10_single_column", "SELECT DISTINCT geo_id FROM housing")
def io10(t: Inputs):
    return io.pull(t.housing(), "geo_id").distinct()


# --- PF: projection, filter, predicates --------------------------------------


@query("PF1_select", "SELECT par_id, geo_id, sale_price, lot_area FROM sales")
def pf1(t: Inputs):
    return t.sales().select("par_id", "geo_id", "sale_price", "lot_area")


@query(
    "PF2_drop",
    "SELECT * EXCLUDE (longitude, latitude, heatingcooling_desc, lot_area, finished_living_area) FROM sales",
)
def pf2(t: Inputs):
    return t.sales().drop("longitude", "latitude", "heatingcooling_desc", "lot_area", "finished_living_area")


@query(
    "PF3_select_by_pattern",
    "SELECT par_id, grade_desc, condition_desc, school_desc, style_desc, sale_price_adj, sale_year, sale_month, sale_date FROM housing",
)
def pf3(t: Inputs):
    housing = t.housing()
    return housing.select("par_id", *rel.matching(housing, "_desc$"), *rel.starting_with(housing, "sale_"))


@query("PF4_reorder", "SELECT * FROM housing")
def pf4(t: Inputs):
    return rel.front(t.housing(), "par_id", "longitude", "latitude", "geo_id")


@query("PF5_rename", "SELECT par_id AS pin, longitude AS lng, latitude AS lat, sale_price FROM sales")
def pf5(t: Inputs):
    chosen = t.sales().select("par_id", "longitude", "latitude", "sale_price")
    return chosen.withColumnsRenamed({"par_id": "pin", "longitude": "lng", "latitude": "lat"})


@query(
    "PF6_clean_names",
    """SELECT PARID AS par_id, PROPERTYCITY AS property_city, SCHOOLCODE AS school_code, SCHOOLDESC AS school_desc,
    MUNIDESC AS muni_desc, SALEDESC AS sale_desc, PRICE AS price FROM raw_transactions""",
)
def pf6(t: Inputs):
    return cleaning.clean_headers(t.raw_transactions())


@query(
    "PF7_derive_columns",
    """SELECT par_id, sale_year - year_blt AS age, sale_price / finished_living_area AS price_per_unit,
    lot_area / 43560 AS acres FROM sales WHERE finished_living_area > 0""",
)
def pf7(t: Inputs):
    derived = t.sales().where(F.col("finished_living_area") > 0).withColumns(
        {
            "age": F.col("sale_year") - F.col("year_blt"),
            "price_per_unit": F.col("sale_price") / F.col("finished_living_area"),
            "acres": F.col("lot_area") / 43560,
        }
    )
    return derived.select("par_id", "age", "price_per_unit", "acres")


@query("PF8_across", "SELECT par_id, lower(geo_id) AS geo_id, lower(school_desc) AS school_desc, lower(style_desc) AS style_desc FROM sales")
def pf8(t: Inputs):
    chosen = t.sales().select("par_id", "geo_id", "school_desc", "style_desc")
    return rel.across(chosen, ["geo_id", *rel.matching(chosen, "_desc$")], F.lower)


@query(
    "PF9_filter_conditions",
    """SELECT par_id, sale_price, sale_year FROM sales
    WHERE sale_year > 1996 AND sale_price > 100 AND (style_desc = 'BUILDING' OR style_desc = 'HOUSEHOLD')""",
)
def pf9(t: Inputs):
    style = F.col("style_desc")
    kept = t.sales().where((F.col("sale_year") > 1996) & (F.col("sale_price") > 100))
    return kept.where((style == "BUILDING") | (style == "HOUSEHOLD")).select("par_id", "sale_price", "sale_year")


@query(
    "PF10_in_list",
    """SELECT par_id, CASE WHEN grade_desc IN ('Below Average', 'Poor') THEN 'Below Average or worse'
    WHEN grade_desc IN ('Very Good', 'Excellent', 'Highest Cost') THEN 'Very Good or better'
    ELSE grade_desc END AS grade_group
    FROM housing WHERE condition_desc IN ('Good', 'Average')""",
)
def pf10(t: Inputs):
    kept = t.housing().where(F.col("condition_desc").isin("Good", "Average"))
    return kept.select("par_id", rules.pool_values(F.col("grade_desc"), GRADE_GROUPS).alias("grade_group"))


@query(
    "PF11_null_filters",
    """SELECT 'no_price' AS kind, par_id FROM sales WHERE sale_price IS NULL
    UNION ALL SELECT 'rooms_and_condition', par_id FROM sales WHERE bedrooms IS NOT NULL AND condition_desc IS NOT NULL
    UNION ALL SELECT 'complete', par_id FROM sales WHERE bedrooms IS NOT NULL AND condition_desc IS NOT NULL
      AND heatingcooling_desc IS NOT NULL AND sale_price IS NOT NULL""",
)
def pf11(t: Inputs):
    sales = t.sales()
    parts = {
        "no_price": sales.where(F.col("sale_price").isNull()),
        "rooms_and_condition": rel.drop_missing(sales, "bedrooms", "condition_desc"),
        "complete": rel.drop_missing(sales),
    }
    return rel.bind_labelled({k: v.select("par_id") for k, v in parts.items()}, "kind").select("kind", "par_id")


@query(
    "PF12_conditional_recode",
    """SELECT par_id, CASE WHEN sale_price > 300000 THEN 'high' WHEN sale_price > 100000 THEN 'middle'
    WHEN sale_price IS NULL THEN 'unknown' ELSE 'low' END AS price_class FROM sales""",
)
def pf12(t: Inputs):
    price = F.col("sale_price")
    label = (
        F.when(price > 300000, F.lit("high"))
        .when(price > 100000, F.lit("middle"))
        .when(price.isNull(), F.lit("unknown"))
        .otherwise(F.lit("low"))
    )
    return t.sales().select("par_id", label.alias("price_class"))


@query(
    "PF13_regex_filter",
    "SELECT par_id, heatingcooling_desc FROM sales WHERE regexp_matches(heatingcooling_desc, '^Central|Furnace$')",
)
def pf13(t: Inputs):
    kept = t.sales().where(F.col("heatingcooling_desc").rlike("^Central|Furnace$"))
    return kept.select("par_id", "heatingcooling_desc")


@query(
    "PF14_equals_own_statistic",
    """SELECT DISTINCT 'lot_area' AS name, 'min' AS kind, CAST(lot_area AS DOUBLE) AS value FROM housing WHERE lot_area = (SELECT min(lot_area) FROM housing)
    UNION ALL SELECT DISTINCT 'year_blt', 'max', CAST(year_blt AS DOUBLE) FROM housing WHERE year_blt = (SELECT max(year_blt) FROM housing)
    UNION ALL SELECT DISTINCT 'finished_living_area', 'q95', finished_living_area FROM housing
      WHERE finished_living_area = (SELECT quantile_cont(finished_living_area, 0.95) FROM housing)
    UNION ALL SELECT DISTINCT 'lot_area', 'q70', lot_area FROM housing
      WHERE lot_area = (SELECT quantile_cont(lot_area, 0.7) FROM housing)""",
)
def pf14(t: Inputs):
    housing = t.kept()
    goals = [
        ("lot_area", "min", housing.agg(F.min("lot_area").alias("g"))),
        ("year_blt", "max", housing.agg(F.max("year_blt").alias("g"))),
        ("finished_living_area", "q95", quantiles(housing, [], "finished_living_area", {"g": 0.95})),
        ("lot_area", "q70", quantiles(housing, [], "lot_area", {"g": 0.7})),
    ]
    found = [
        rel.where_equals(housing, name, goal.scalar()).select(
            F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.col(name).cast("double").alias("value")
        )
        for name, kind, goal in goals
    ]
    return rel.bind_rows(*found)


@query(
    "PF15_frequent_categories",
    """SELECT par_id, geo_id, n FROM (SELECT par_id, geo_id, count(*) OVER (PARTITION BY geo_id) AS n FROM housing)
    WHERE n > (SELECT count(*) / 25 FROM housing)""",
)
def pf15(t: Inputs):
    housing = t.kept()
    least = housing.count() / 25
    return keep_frequent(housing, "geo_id", least).select("par_id", "geo_id", "n")


# --- J: joins ----------------------------------------------------------------


@query(
    "J1_left_join",
    """SELECT h.par_id, h.geo_id, p.p_name, p.p_retailprice FROM housing h LEFT JOIN part p ON p.p_partkey = h.par_id""",
)
def j1(t: Inputs):
    parts = t.table("part").select(F.col("p_partkey").alias("par_id"), "p_name", "p_retailprice")
    return big_join(t.housing(), parts, ["par_id"]).select("par_id", "geo_id", "p_name", "p_retailprice")


@query(
    "J2_inner_join",
    """SELECT h.par_id, h.geo_id, c.c_acctbal FROM housing h JOIN customer c ON c.c_custkey = h.par_id""",
)
def j2(t: Inputs):
    customers = t.table("customer").select(F.col("c_custkey").alias("par_id"), "c_acctbal")
    return big_join(t.housing(), customers, ["par_id"], "inner").select("par_id", "geo_id", "c_acctbal")


@query(
    "J3_natural_left_join",
    """SELECT h.par_id, h.style_desc, h.condition_desc, s.n_like FROM housing h
    LEFT JOIN (SELECT style_desc, condition_desc, count(*) AS n_like FROM housing WHERE sale_year < 1998 GROUP BY ALL) s
    ON h.style_desc IS NOT DISTINCT FROM s.style_desc AND h.condition_desc IS NOT DISTINCT FROM s.condition_desc""",
)
def j3(t: Inputs):
    housing = t.housing()
    old = count_by(housing.where(F.col("sale_year") < 1998), "style_desc", "condition_desc", name="n_like")
    joined = rel.natural_left_join(housing.select("par_id", "style_desc", "condition_desc"), old)
    return joined.select("par_id", "style_desc", "condition_desc", "n_like")


@query(
    "J4_semi_join_allow_list",
    """SELECT par_id, usedesc FROM raw WHERE usedesc IN (SELECT usedesc FROM (SELECT usedesc, count(*) AS n FROM raw
    WHERE sale_desc IN ('VALID SALE', 'OTHER VALID') GROUP BY usedesc ORDER BY n DESC, usedesc LIMIT 5))""",
)
def j4(t: Inputs):
    raw = t.raw()
    counts = count_by(raw.where(cleaning.is_valid_sale()), "usedesc").orderBy(F.desc("n"), "usedesc").limit(5)
    return rel.semi_join(raw.select("par_id", "usedesc"), counts, ["usedesc"])


@query(
    "J5_semi_join_many_keys",
    """SELECT par_id, geo_id, style_desc, condition_desc FROM housing h WHERE EXISTS (SELECT 1 FROM requests r
    WHERE r.geo_id = h.geo_id AND r.style_desc = h.style_desc AND r.condition_desc IS NOT DISTINCT FROM h.condition_desc)""",
)
def j5(t: Inputs):
    keys = ["geo_id", "style_desc", "condition_desc"]
    return rel.semi_join(t.housing().select("par_id", *keys), t.requests(), keys)


@query(
    "J6_anti_join",
    """SELECT par_id, geo_id, style_desc, condition_desc FROM housing h WHERE NOT EXISTS (SELECT 1 FROM requests r
    WHERE r.geo_id = h.geo_id AND r.style_desc = h.style_desc AND r.condition_desc IS NOT DISTINCT FROM h.condition_desc)""",
)
def j6(t: Inputs):
    keys = ["geo_id", "style_desc", "condition_desc"]
    return rel.anti_join(t.housing().select("par_id", *keys), t.requests(), keys)


@query(
    "J7_reconcile_keys",
    """SELECT DISTINCT o_custkey AS key, 'left_only' AS side FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)
    UNION ALL SELECT DISTINCT s_suppkey, 'right_only' FROM supplier WHERE s_suppkey NOT IN (SELECT o_custkey FROM orders)""",
)
def j7(t: Inputs):
    return rel.reconcile_keys(t.table("orders"), t.table("supplier"), "o_custkey", "s_suppkey")


@query(
    "J8_point_in_polygon",
    """SELECT s.par_id, r.geo_id FROM spots s LEFT JOIN rectangles r
    ON s.longitude BETWEEN r.x0 AND r.x1 AND s.latitude BETWEEN r.y0 AND r.y1""",
)
def j8(t: Inputs):
    return geo.assign_areas(t.spots(), t.rectangles()).select("par_id", "geo_id")


@query(
    "J9_join_own_aggregate",
    """SELECT par_id, h.geo_id, n, round(mean_price, 6) AS mean_price FROM housing h
    JOIN (SELECT geo_id, count(*) AS n, avg(sale_price_adj) AS mean_price FROM housing GROUP BY geo_id) g USING (geo_id)""",
)
def j9(t: Inputs):
    joined = rel.with_group_aggregate(
        t.housing(), ["geo_id"], n=F.count(F.lit(1)), mean_price=F.avg("sale_price_adj")
    )
    return rounded(joined.select("par_id", "geo_id", "n", "mean_price"), 6, "mean_price")


@query(
    "J10_bind_predictions",
    """SELECT h.*, round(a + b * finished_living_area, 4) AS pred FROM housing h, (SELECT
    regr_intercept(log10(sale_price_adj), finished_living_area) AS a,
    regr_slope(log10(sale_price_adj), finished_living_area) AS b FROM housing)""",
)
def j10(t: Inputs):
    housing = t.kept()
    fitted = models.fit(housing, models.linear(), [DesignVector(["finished_living_area"])])
    return rounded(models.predict(fitted, housing).drop("features", "pred_dollar"), 4, "pred")
