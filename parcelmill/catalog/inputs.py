"""The given tables in the shape of property data.

Each relation exists twice: as a DataFrame on ``Inputs`` and as SQL text in
``BASE_CTES`` for the checks. Column expressions that only disguise clean
columns as raw text are shared by both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmill.functions import dates
from parcelmill.functions import property_rules as rules
from parcelmill.runtime import big_join, settle

SEED = 1234
LEAST_PRICE = 100
GRADES = {
    "1": "Excellent", "2": "Very Good", "3": "Good", "4": "Average", "5": "Below Average",
}
CONDITIONS = {"F": "Good", "O": "Average", "P": "Poor"}
PRICE_INDEX = [(1995 + k, round(100 * 1.02**k, 4)) for k in range(6)]

# Raw text made from clean columns; the same expressions run on both engines.
RAW_EXPRESSIONS = {
    "par_id": "lpad(CAST(par_id AS STRING), 16, '0')",
    "usedesc": """CASE WHEN par_id % 3 = 0 THEN 'SINGLE FAMILY'
        WHEN par_id % 97 = 1 THEN 'MOBILE HOME' WHEN par_id % 89 = 2 THEN 'OFFICE/APARTMENTS OVER'
        WHEN par_id % 83 = 4 THEN 'APART:40+ UNITS'
        ELSE 'USE ' || CAST(par_id * 7 % 13 AS STRING) END""",
    "school_desc": "'  ' || upper(school_desc) || ' - AREA '",
    "muni_desc": """CASE par_id % 7 WHEN 0 THEN CAST(par_id % 32 + 1 AS STRING) || 'th Ward - PITTSBURGH '
        WHEN 1 THEN 'Mt. Oliver' WHEN 2 THEN '  MCKEES-ROCKS ' ELSE ' ' || geo_id || ' ' END""",
    "sale_desc": "CASE par_id % 10 WHEN 0 THEN 'LOVE AND AFFECTION SALE' WHEN 1 THEN 'OTHER VALID' ELSE 'VALID SALE' END",
    "sale_price": "sale_price",
    "sale_date": """CASE WHEN par_id % 50 = 7 THEN '02-30-2000' WHEN par_id % 50 = 8 THEN 'unknown'
        WHEN par_id % 2 = 0 THEN lpad(CAST(month(sale_date) AS STRING), 2, '0') || '-'
            || lpad(CAST(day(sale_date) AS STRING), 2, '0') || '-' || CAST(year(sale_date) AS STRING)
        ELSE CAST(month(sale_date) AS STRING) || '/' || CAST(day(sale_date) AS STRING) || '/'
            || CAST(year(sale_date) AS STRING) END""",
    "year_blt": "CASE WHEN par_id % 41 = 0 THEN 2005 ELSE year_blt END",
    "style_desc": """CASE par_id % 9 WHEN 0 THEN 'CONDO GARDEN' WHEN 1 THEN 'ROW END' WHEN 2 THEN 'ROW INTERIOR'
        WHEN 3 THEN 'CONDO HIGH RISE' WHEN 4 THEN 'OLD  STYLE' ELSE style_desc END""",
    "bedrooms": "bedrooms",
    "fullbaths": "fullbaths",
    "halfbaths": "halfbaths",
    "finished_living_area": "finished_living_area",
    "lot_area": "lot_area",
    "grade_desc": """CASE par_id % 8 WHEN 0 THEN 'GOOD +' WHEN 1 THEN 'AVERAGE-' WHEN 2 THEN 'VERY  GOOD +'
        WHEN 3 THEN 'BELOW AVERAGE' WHEN 4 THEN 'EXCELLENT-' WHEN 5 THEN 'POOR' ELSE 'AVERAGE' END""",
    "condition_desc": "CASE WHEN condition_desc IS NULL THEN NULL WHEN par_id % 4 = 0 THEN 'FAIR' ELSE 'VERY GOOD' END",
    "heatingcooling_desc": "upper(heatingcooling_desc)",
}
TRANSACTION_EXPRESSIONS = {
    "PARID": "lpad(CAST(par_id AS STRING), 16, '0')",
    "PROPERTYCITY": """CASE par_id % 6 WHEN 0 THEN 'PITTSBURGH' WHEN 1 THEN 'MC KEESPORT' WHEN 2 THEN 'MC KEES ROCKS'
        WHEN 3 THEN 'HOMESTEAD' WHEN 4 THEN 'DUQUESNE' ELSE geo_id END""",
    "SCHOOLCODE": "CAST(par_id % 47 AS STRING)",
    "SCHOOLDESC": "school_desc",
    "MUNIDESC": """CASE par_id % 11 WHEN 0 THEN '19TH WARD - PITTSBURGH' WHEN 1 THEN '28TH WARD - PITTSBURGH'
        WHEN 2 THEN '3RD WARD - MCKEESPORT' WHEN 3 THEN 'MCKEES ROCKS' WHEN 4 THEN '1ST WARD - CLAIRTON'
        WHEN 5 THEN '2ND WARD - HOMESTEAD' WHEN 6 THEN '1ST WARD - DUQUESNE' ELSE geo_id END""",
    "SALEDESC": "CASE par_id % 10 WHEN 0 THEN 'LOVE AND AFFECTION SALE' WHEN 1 THEN 'OTHER VALID' ELSE 'VALID SALE' END",
    "PRICE": "sale_price",
}

SALES_SQL = """
SELECT o.o_orderkey AS par_id, n.n_name AS geo_id, r.r_name AS school_desc, c.c_mktsegment AS style_desc,
 o.o_orderpriority AS grade_desc,
 CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE o.o_orderstatus END AS condition_desc,
 CASE o.o_orderkey % 5 WHEN 0 THEN 'Central Heat With AC' WHEN 1 THEN 'Central Heat'
   WHEN 2 THEN 'No Heat But With AC' WHEN 3 THEN 'Wall Furnace' END AS heatingcooling_desc,
 f.price AS sale_price, CAST(o.o_orderdate AS DATE) AS sale_date,
 CAST(year(o.o_orderdate) AS BIGINT) AS sale_year, CAST(month(o.o_orderdate) AS BIGINT) AS sale_month_no,
 1900 + (o.o_orderkey * 7) % 95 AS year_blt,
 o.o_totalprice AS lot_area, f.qty AS finished_living_area,
 CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE f.n_lines END AS bedrooms,
 f.n_flag AS fullbaths, f.n_status AS halfbaths,
 -80.5 + (o.o_orderkey * 37 % 1000) / CAST(1000 AS DOUBLE) AS longitude,
 40.1 + (o.o_orderkey * 91 % 600) / CAST(1000 AS DOUBLE) AS latitude
FROM orders o
JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN region r ON r.r_regionkey = n.n_regionkey
LEFT JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS price, sum(l_quantity) AS qty, count(*) AS n_lines,
   count(DISTINCT l_returnflag) AS n_flag, count(DISTINCT l_linestatus) AS n_status
  FROM lineitem GROUP BY l_orderkey) f ON f.l_orderkey = o.o_orderkey
"""


def _case(column: str, mapping: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


HOUSING_SQL = f"""
SELECT par_id, sale_price AS sale_price_adj, sale_year - year_blt AS house_age_at_sale, sale_year,
 strftime(sale_date, '%b') AS sale_month, lot_area, finished_living_area, bedrooms, fullbaths, halfbaths,
 geo_id, style_desc, {_case("substr(grade_desc, 1, 1)", GRADES)} AS grade_desc,
 {_case("condition_desc", CONDITIONS)} AS condition_desc,
 regexp_matches(heatingcooling_desc, 'With AC$') AS ac_flag,
 CASE trim(regexp_replace(heatingcooling_desc, 'With AC$', '')) WHEN 'No Heat But' THEN 'None'
   ELSE trim(regexp_replace(heatingcooling_desc, 'With AC$', '')) END AS heat_type,
 longitude, latitude, year_blt, school_desc, sale_date
FROM sales WHERE sale_price > {LEAST_PRICE}
"""
# The columns of the sales table in order, with their Spark types.
HOUSING_TYPES = {
    "par_id": "bigint", "sale_price_adj": "double", "house_age_at_sale": "bigint", "sale_year": "bigint", "sale_month": "string",
    "lot_area": "double", "finished_living_area": "double", "bedrooms": "bigint", "fullbaths": "bigint", "halfbaths": "bigint",
    "geo_id": "string", "style_desc": "string", "grade_desc": "string", "condition_desc": "string", "ac_flag": "boolean", "heat_type": "string",
    "longitude": "double", "latitude": "double", "year_blt": "bigint", "school_desc": "string", "sale_date": "date",
}
REQUESTS_SQL = """
SELECT geo_id || '|' || style_desc AS request_id, * EXCLUDE (rn, par_id)
FROM (SELECT *, row_number() OVER (PARTITION BY geo_id, style_desc ORDER BY sale_date DESC, par_id DESC) AS rn
 FROM housing) WHERE rn = 1
"""


def _select(expressions: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f'{text} AS "{name}"' for name, text in expressions.items()) + f" FROM {source}"


def _layer_sql(key: str, name: str) -> str:
    corners = [(1, "x0", "ym"), (2, "xm", "y0"), (3, "x1", "ym"), (4, "xm", "y1"), (5, "x0", "ym")]
    box = (
        f"SELECT {key} AS {name}, min(longitude) AS x0, max(longitude) AS x1, min(latitude) AS y0,"
        f" max(latitude) AS y1, (min(longitude) + max(longitude)) / 2 AS xm,"
        f" (min(latitude) + max(latitude)) / 2 AS ym FROM sales GROUP BY {key}"
    )
    return " UNION ALL ".join(
        f"SELECT {name}, 1 AS part_id, {seq} AS seq, {x} AS x, {y} AS y FROM ({box})" for seq, x, y in corners
    )


BASE_CTES = {
    "sales": SALES_SQL,
    "housing": HOUSING_SQL,
    "raw": _select(RAW_EXPRESSIONS, "sales"),
    "raw_transactions": _select(TRANSACTION_EXPRESSIONS, "sales"),
    "requests": REQUESTS_SQL,
    "price_index": "SELECT * FROM (VALUES "
    + ", ".join(f"(CAST({y} AS BIGINT), CAST({v} AS DOUBLE))" for y, v in PRICE_INDEX)
    + ") AS t(year, idx)",
    "rectangles": """SELECT 'AREA_' || CAST(i AS STRING) AS geo_id, -80.5 + 0.2 * (i % 5) AS x0,
        40.1 + 0.15 * (i // 5) AS y0, -80.5 + 0.2 * (i % 5) + 0.2 AS x1, 40.1 + 0.15 * (i // 5) + 0.15 AS y1
        FROM range(20) t(i)""",
    "spots": """SELECT par_id, geo_id AS nation, school_desc, style_desc, longitude + 0.0001234 AS longitude,
        latitude + 0.0001234 AS latitude, bedrooms FROM sales""",
    "school_layer": _layer_sql("geo_id", "school_district"),
    "council_layer": _layer_sql("style_desc", "council_district"),
    "town_layer": _layer_sql("school_desc", "label"),
}


# Plans, not data: one per application, folder and relation, so that schemas are read once.
_PLANS: dict[tuple[str, str, str], DataFrame] = {}


class Inputs:
    """DataFrames of the given tables and of what is derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._stored: DataFrame | None = None

    def stored(self) -> Inputs:
        """The same with the sales computed once, for queries that make several tables of them."""
        kept = Inputs(self.spark, self.sf_dir)
        kept._stored = settle(self.sales())
        return kept

    def _plan(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _PLANS or _PLANS[key].sparkSession is not self.spark:
            _PLANS[key] = make()
        return _PLANS[key]

    def table(self, name: str) -> DataFrame:
        return self._plan(name, lambda: self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))

    def sales(self) -> DataFrame:
        """One row per order in the shape of a house sale."""
        return self._plan("sales", self._sales) if self._stored is None else self._stored

    def _sales(self) -> DataFrame:
        lines = (
            self.table("lineitem")
            .groupBy("l_orderkey")
            .agg(
                F.round(F.sum("l_extendedprice"), 2).alias("price"),
                F.sum("l_quantity").alias("qty"),
                F.count(F.lit(1)).alias("n_lines"),
                # Sets of one order's flags are small, and unlike two distinct counts they need one pass.
                F.size(F.collect_set("l_returnflag")).cast("long").alias("n_flag"),
                F.size(F.collect_set("l_linestatus")).cast("long").alias("n_status"),
            )
            .withColumnRenamed("l_orderkey", "o_orderkey")
        )
        orders = self.table("orders").join(lines, "o_orderkey", "left")
        buyers = self.table("customer").select(
            F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment"
        )
        placed = big_join(orders, buyers, ["o_custkey"], "inner")
        nations = self.table("nation").withColumnRenamed("n_nationkey", "c_nationkey")
        regions = self.table("region").withColumnRenamed("r_regionkey", "n_regionkey")
        placed = placed.join(nations.join(regions, "n_regionkey"), "c_nationkey")
        key = F.col("o_orderkey")
        heating = (
            F.when(key % 5 == 0, F.lit("Central Heat With AC"))
            .when(key % 5 == 1, F.lit("Central Heat"))
            .when(key % 5 == 2, F.lit("No Heat But With AC"))
            .when(key % 5 == 3, F.lit("Wall Furnace"))
        )
        return placed.select(
            key.alias("par_id"),
            F.col("n_name").alias("geo_id"),
            F.col("r_name").alias("school_desc"),
            F.col("c_mktsegment").alias("style_desc"),
            F.col("o_orderpriority").alias("grade_desc"),
            F.when(key % 13 != 0, F.col("o_orderstatus")).alias("condition_desc"),
            heating.alias("heatingcooling_desc"),
            F.col("price").alias("sale_price"),
            F.col("o_orderdate").cast("date").alias("sale_date"),
            dates.year_of(F.col("o_orderdate")).alias("sale_year"),
            dates.month_no(F.col("o_orderdate")).alias("sale_month_no"),
            (1900 + (key * 7) % 95).alias("year_blt"),
            F.col("o_totalprice").alias("lot_area"),
            F.col("qty").alias("finished_living_area"),
            F.when(key % 17 != 0, F.col("n_lines")).alias("bedrooms"),
            F.col("n_flag").alias("fullbaths"),
            F.col("n_status").alias("halfbaths"),
            (F.lit(-80.5) + (key * 37 % 1000) / F.lit(1000.0)).alias("longitude"),
            (F.lit(40.1) + (key * 91 % 600) / F.lit(1000.0)).alias("latitude"),
        )

    def housing(self, *columns: str) -> DataFrame:
        """Sales above a least price as the model table; all or the listed columns."""
        table = self._plan("housing", self._housing) if self._stored is None else self._housing()
        return table.select(*columns) if columns else table

    def kept(self, *columns: str) -> DataFrame:
        """The same, computed once: for queries that go over the rows several times."""
        return settle(self.housing(*columns))

    def _housing(self) -> DataFrame:
        heating = F.col("heatingcooling_desc")
        return self.sales().where(F.col("sale_price") > LEAST_PRICE).select(
            "par_id",
            F.col("sale_price").alias("sale_price_adj"),
            (F.col("sale_year") - F.col("year_blt")).alias("house_age_at_sale"),
            "sale_year",
            dates.month_name(F.col("sale_date")).alias("sale_month"),
            "lot_area",
            "finished_living_area",
            "bedrooms",
            "fullbaths",
            "halfbaths",
            "geo_id",
            "style_desc",
            rules.recode(F.substring("grade_desc", 1, 1), GRADES).alias("grade_desc"),
            rules.recode(F.col("condition_desc"), CONDITIONS).alias("condition_desc"),
            rules.has_cooling(heating).alias("ac_flag"),
            rules.heat_type(heating).alias("heat_type"),
            "longitude",
            "latitude",
            "year_blt",
            "school_desc",
            "sale_date",
        )

    def _expressions(self, expressions: dict[str, str]) -> DataFrame:
        return self.sales().select(*[F.expr(text).alias(name) for name, text in expressions.items()])

    def raw(self) -> DataFrame:
        return self._expressions(RAW_EXPRESSIONS)

    def raw_transactions(self) -> DataFrame:
        return self._expressions(TRANSACTION_EXPRESSIONS)

    def requests(self) -> DataFrame:
        """The newest sale of each area and style as a what-if house."""
        housing = self.housing()
        picked = housing.groupBy("geo_id", "style_desc").agg(
            F.max_by(F.struct(*housing.columns), F.struct("sale_date", "par_id")).alias("s")
        )
        name = F.concat(F.col("geo_id"), F.lit("|"), F.col("style_desc"))
        return picked.select(name.alias("request_id"), "s.*").drop("par_id")

    def price_index(self) -> DataFrame:
        return self.spark.createDataFrame(PRICE_INDEX, "year long, idx double")

    def rectangles(self) -> DataFrame:
        """Twenty rectangular areas over the point box, as closed rings."""
        i = F.col("id")
        x0, y0 = F.lit(-80.5) + 0.2 * (i % 5), F.lit(40.1) + 0.15 * F.floor(i / 5)
        x1, y1 = x0 + 0.2, y0 + 0.15
        ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
        vertex = F.posexplode(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ring]))
        out = self.spark.range(20).select(F.concat(F.lit("AREA_"), i.cast("string")).alias("geo_id"), vertex)
        return out.select("geo_id", F.lit(1).alias("part_id"), F.col("pos").alias("seq"), "col.x", "col.y")

    def spots(self) -> DataFrame:
        """Sale points, shifted so that none lies on an area's edge."""
        return self.sales().select(
            "par_id",
            F.col("geo_id").alias("nation"),
            "school_desc",
            "style_desc",
            (F.col("longitude") + 0.0001234).alias("longitude"),
            (F.col("latitude") + 0.0001234).alias("latitude"),
            "bedrooms",
        )

    def layer(self, key: str, name: str) -> DataFrame:
        """One diamond per value of a column, over the extent of its points."""
        box = self.sales().groupBy(F.col(key).alias(name)).agg(
            F.min("longitude").alias("x0"),
            F.max("longitude").alias("x1"),
            F.min("latitude").alias("y0"),
            F.max("latitude").alias("y1"),
        )
        xm, ym = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
        ring: list[tuple[Column, Column]] = [
            (F.col("x0"), ym), (xm, F.col("y0")), (F.col("x1"), ym), (xm, F.col("y1")), (F.col("x0"), ym),
        ]
        vertex = F.posexplode(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ring]))
        return box.select(name, vertex).select(
            name, F.lit(1).alias("part_id"), (F.col("pos") + 1).alias("seq"), "col.x", "col.y"
        )

    def school_layer(self) -> DataFrame:
        return self.layer("geo_id", "school_district")

    def council_layer(self) -> DataFrame:
        return self.layer("style_desc", "council_district")

    def town_layer(self) -> DataFrame:
        return self.layer("school_desc", "label")

    def areas(self) -> DataFrame:
        """The school layer as a plain vertex table."""
        return self.school_layer().withColumnRenamed("school_district", "geo_id")


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


