"""Queries: scalar functions and functions passed to operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelmill.catalog.inputs import Inputs
from parcelmill.catalog.registry import query
from parcelmill.functions import dates, numeric, text
from parcelmill.functions import property_rules as rules
from parcelmill.operators import evaluation as ev
from parcelmill.operators import factors as fct
from parcelmill.operators import relational as rel
from parcelmill.operators.aggregates import count_by
from parcelmill.plans import cleaning


def title_sql(x: str) -> str:
    words = r"'[\p{L}\p{N}''._]+|[^\p{L}\p{N}''._]+'"
    return f"array_to_string(list_transform(regexp_extract_all(lower({x}), {words}), lambda w: upper(w[1]) || w[2:]), '')"


def squish_sql(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def trim_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


DATE_SQL = r"CAST(try_strptime(regexp_replace(trim(sale_date), '[/.\s]+', '-', 'g'), '%m-%d-%Y') AS DATE)"


@query(
    "SF1_detect",
    r"""SELECT par_id, regexp_matches(heatingcooling_desc, 'WITH AC$|^WALL') AS hit,
    regexp_matches(muni_desc, 'Ward') AND regexp_matches(muni_desc, 'PITTSBURGH') AS is_ward FROM raw""",
)
def sf1(t: Inputs):
    heat, muni = F.col("heatingcooling_desc"), F.col("muni_desc")
    ward = text.detect(muni, "Ward") & text.detect(muni, "PITTSBURGH")
    return t.raw().select("par_id", text.detect(heat, "WITH AC$|^WALL").alias("hit"), ward.alias("is_ward"))


@query("SF2_replace_first", r"SELECT par_id, regexp_replace(muni_desc, '[A-Z_]', '<\0>') AS muni_desc FROM raw")
def sf2(t: Inputs):
    found = text.replace_first(F.col("muni_desc"), "([A-Z_])", "<$2>")
    return t.raw().select("par_id", found.alias("muni_desc"))


@query("SF3_replace_all", "SELECT par_id, regexp_replace(school_desc, '-| ', '.', 'g') AS school_desc FROM raw")
def sf3(t: Inputs):
    return t.raw().select("par_id", text.replace_all(F.col("school_desc"), "-| ", ".").alias("school_desc"))


@query(
    "SF4_remove_first_and_all",
    r"""SELECT par_id, regexp_replace(grade_desc, '\+|-|O', '') AS first_removed,
    regexp_replace(grade_desc, '\+|-|O', '', 'g') AS all_removed FROM raw""",
)
def sf4(t: Inputs):
    grade = F.col("grade_desc")
    return t.raw().select(
        "par_id",
        text.remove_first(grade, r"\+|-|O").alias("first_removed"),
        text.remove_all(grade, r"\+|-|O").alias("all_removed"),
    )


@query("SF5_trim", f"SELECT par_id, {trim_sql('muni_desc')} AS muni_desc, {trim_sql('school_desc')} AS school_desc FROM raw")
def sf5(t: Inputs):
    return rel.across(t.raw().select("par_id", "muni_desc", "school_desc"), ["muni_desc", "school_desc"], text.trim_ends)


@query("SF6_squish", f"SELECT par_id, {squish_sql('grade_desc')} AS grade_desc, {squish_sql('style_desc')} AS style_desc FROM raw")
def sf6(t: Inputs):
    return rel.across(t.raw().select("par_id", "grade_desc", "style_desc"), ["grade_desc", "style_desc"], text.squish)


@query(
    "SF7_title_case",
    f"SELECT par_id, {title_sql('muni_desc')} AS muni_desc, {title_sql('usedesc')} AS usedesc FROM raw",
)
def sf7(t: Inputs):
    return rel.across(t.raw().select("par_id", "muni_desc", "usedesc"), ["muni_desc", "usedesc"], text.title_case)


@query("SF8_concatenate", "SELECT par_id, geo_id || ': ' || condition_desc AS label FROM housing")
def sf8(t: Inputs):
    label = text.join_text(F.col("geo_id"), F.col("condition_desc"), sep=": ")
    return t.housing().select("par_id", label.alias("label"))


@query(
    "SF9_collapse_rows",
    """SELECT geo_id, string_agg(style_desc || ': ' || CAST(n AS VARCHAR), ', ' ORDER BY style_desc) AS styles
    FROM (SELECT geo_id, style_desc, count(*) AS n FROM housing GROUP BY ALL) GROUP BY geo_id""",
)
def sf9(t: Inputs):
    counts = count_by(t.housing(), "geo_id", "style_desc")
    item = F.struct("style_desc", text.join_text(F.col("style_desc"), F.col("n").cast("string"), sep=": ").alias("v"))
    packed = counts.groupBy("geo_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return packed.select("geo_id", F.array_join(F.col("items.v"), ", ").alias("styles"))


@query(
    "SF10_money_format",
    """SELECT par_id, '$' || format('{:,}', CAST(round(sale_price_adj) AS BIGINT)) AS price_text,
    format('{:,}', CAST(round(lot_area) AS BIGINT)) AS lot_text FROM housing""",
)
def sf10(t: Inputs):
    return t.housing().select(
        "par_id",
        text.dollar(F.col("sale_price_adj")).alias("price_text"),
        text.comma(F.col("lot_area")).alias("lot_text"),
    )


@query("SF11_parse_date", f"SELECT par_id, sale_date AS given, {DATE_SQL} AS parsed FROM raw")
def sf11(t: Inputs):
    given = F.col("sale_date")
    return t.raw().select("par_id", given.alias("given"), dates.month_day_year(given).alias("parsed"))


@query(
    "SF12_year_and_month",
    """SELECT par_id, CAST(year(sale_date) AS BIGINT) AS sale_year, strftime(sale_date, '%b') AS sale_month,
    CAST(month(sale_date) AS BIGINT) AS month_rank FROM sales""",
)
def sf12(t: Inputs):
    day = F.col("sale_date")
    return t.sales().select(
        "par_id",
        dates.year_of(day).alias("sale_year"),
        dates.month_name(day).alias("sale_month"),
        dates.month_rank(dates.month_name(day)).cast("long").alias("month_rank"),
    )


@query(
    "SF13_age_at_sale",
    """SELECT par_id, age FROM (SELECT r.par_id, s.sale_year - r.year_blt AS age FROM raw r
    JOIN sales s ON lpad(CAST(s.par_id AS STRING), 16, '0') = r.par_id) WHERE age >= 0""",
)
def sf13(t: Inputs):
    dated = t.raw().withColumn("parsed", F.col("par_id").cast("long"))
    years = t.sales().select(F.col("par_id").alias("parsed"), "sale_year")
    age = F.col("sale_year") - F.col("year_blt")
    joined = dated.join(years, "parsed").withColumn("age", age)
    return joined.where(F.col("age") >= 0).select("par_id", "age")


@query(
    "SF14_logs_and_powers",
    """SELECT par_id, round(log10(sale_price_adj), 6) AS log_price, round(pow(10, log10(lot_area)), 4) AS lot_back,
    abs(sale_price_adj - lot_area) AS gap, CAST(round(finished_living_area / 10) AS DOUBLE) AS tens FROM housing""",
)
def sf14(t: Inputs):
    return t.housing().select(
        "par_id",
        F.round(numeric.log10_positive(F.col("sale_price_adj")), 6).alias("log_price"),
        F.round(numeric.from_log10(F.log10("lot_area")), 4).alias("lot_back"),
        F.abs(F.col("sale_price_adj") - F.col("lot_area")).alias("gap"),
        F.round(F.col("finished_living_area") / 10, 0).alias("tens"),
    )


@query(
    "SF15_casts",
    """SELECT par_id, CAST(sale_year AS VARCHAR) AS year_text, upper(CAST(ac_flag AS VARCHAR)) AS ac_text,
    CAST(CAST(ac_flag AS VARCHAR) AS BOOLEAN) AS ac_again FROM housing""",
)
def sf15(t: Inputs):
    flag = F.col("ac_flag")
    return t.housing().select(
        "par_id",
        F.col("sale_year").cast("string").alias("year_text"),
        F.upper(flag.cast("string")).alias("ac_text"),
        flag.cast("string").cast("boolean").alias("ac_again"),
    )


HEAT_TEXT = f"regexp_replace({title_sql('heatingcooling_desc')}, 'With Ac', 'With AC')"
HEAT_BARE = squish_sql(f"regexp_replace({HEAT_TEXT}, 'With AC$', '')")
HEAT_TYPE = f"CASE {HEAT_BARE} WHEN 'No Heat But' THEN 'None' ELSE {HEAT_BARE} END"


@query(
    "SF16_split_heating",
    f"SELECT par_id, regexp_matches({HEAT_TEXT}, 'With AC$') AS ac_flag, {HEAT_TYPE} AS heat_type FROM raw",
)
def sf16(t: Inputs):
    named = t.raw().withColumn("heatingcooling_desc", rules.heating_text(F.col("heatingcooling_desc")))
    heat = F.col("heatingcooling_desc")
    return named.select("par_id", rules.has_cooling(heat).alias("ac_flag"), rules.heat_type(heat).alias("heat_type"))


@query(
    "SF17_identifier",
    r"""SELECT par_id, chr(9) || ' ' || substr(par_id, 1, 4) || '-S-' || substr(par_id, 5) || '- ' AS shown,
    substr(par_id, 1, 4) || 'S' || substr(par_id, 5) AS again FROM raw""",
)
def sf17(t: Inputs):
    shown = F.concat(
        F.lit("\t "), F.substring("par_id", 1, 4), F.lit("-S-"), F.expr("substring(par_id, 5)"), F.lit("- ")
    )
    return t.raw().select("par_id", shown.alias("shown"), text.parcel_key(shown).alias("again"))


@query(
    "SF18_inflation",
    """SELECT s.par_id, s.sale_price * ((SELECT idx FROM price_index WHERE year = 2000) / p.idx) AS sale_price_adj
    FROM sales s LEFT JOIN price_index p ON p.year = s.sale_year""",
)
def sf18(t: Inputs):
    adjusted = rules.adjust_prices(t.sales(), t.price_index(), "sale_price", "sale_year", 2000)
    return adjusted.select("par_id", "sale_price_adj")


STYLE_SQL = """CASE WHEN regexp_matches(style_desc, 'CONDO') THEN 'CONDO'
    WHEN style_desc IN ('ROW END', 'ROW INTERIOR') THEN 'ROW' ELSE style_desc END"""


@query("SF19_simple_style", f"SELECT par_id, {STYLE_SQL} AS style_desc FROM raw")
def sf19(t: Inputs):
    return t.raw().select("par_id", rules.simple_style(F.col("style_desc")).alias("style_desc"))


def district_sql(muni: str, school: str) -> str:
    named = f"""CASE WHEN regexp_matches({muni}, 'Ward') AND regexp_matches({muni}, 'PITTSBURGH') THEN {muni}
        WHEN {muni} = 'Mt. Oliver' THEN 'Mt. Oliver' ELSE {school} END"""
    return title_sql(f"regexp_replace({title_sql(named)}, ' - ', ' ')")


DISTRICT_SQL = district_sql(trim_sql("muni_desc"), trim_sql("school_desc"))


@query("SF20_district_name", f"SELECT par_id, {DISTRICT_SQL} AS school_desc FROM raw")
def sf20(t: Inputs):
    name = rules.district_name(text.trim_ends(F.col("school_desc")), text.trim_ends(F.col("muni_desc")))
    return t.raw().select("par_id", name.alias("school_desc"))


MUNI_STEPS = {
    "titled": f"""SELECT par_id, SCHOOLCODE AS school_code, SCHOOLDESC AS school_desc, SALEDESC AS sale_desc, PRICE AS price,
        regexp_replace(regexp_replace({title_sql('PROPERTYCITY')}, 'Mc Keesport', 'McKeesport'), 'Mc Kees Rocks', 'McKees Rocks')
          AS property_city,
        regexp_replace(regexp_replace({title_sql('MUNIDESC')}, 'Mckeesport', 'McKeesport'), 'Mckees Rocks', 'McKees Rocks') AS m0
        FROM (SELECT *, PARID AS par_id FROM raw_transactions) WHERE SALEDESC IN ('VALID SALE', 'OTHER VALID')""",
    "m1": "SELECT *, CASE WHEN property_city = 'Pittsburgh' AND contains(m0, 'Pittsburgh') THEN 'Pittsburgh' ELSE m0 END AS m1 FROM titled",
    "m2": "SELECT *, CASE WHEN contains(m1, 'McKeesport') THEN 'McKeesport' ELSE m1 END AS m2 FROM m1",
    "m3": "SELECT *, CASE WHEN m2 = '28th Ward - Pittsburgh' THEN 'Pittsburgh' ELSE m2 END AS m3 FROM m2",
    "m4": "SELECT *, CASE WHEN contains(m3, 'Clairton') THEN 'Clairton' ELSE m3 END AS m4 FROM m3",
    "m5": "SELECT *, CASE WHEN property_city = 'Homestead' AND contains(m4, 'Ward') THEN 'Homestead' ELSE m4 END AS m5 FROM m4",
    "m6": "SELECT *, CASE WHEN property_city = 'Duquesne' AND contains(m5, 'Ward') THEN 'Duquesne' ELSE m5 END AS muni_desc FROM m5",
}


@query("SF21_municipality_rules", "SELECT par_id, property_city, muni_desc FROM m6", **MUNI_STEPS)
def sf21(t: Inputs):
    valid = cleaning.clean_headers(t.raw_transactions()).where(cleaning.is_valid_sale())
    titled = rel.across(valid, ["property_city", "muni_desc"], text.title_case)
    done = rules.recode_municipality(rules.fix_text(titled))
    return done.select("par_id", "property_city", "muni_desc")


def rating_sql(column: str) -> str:
    return squish_sql(rf"regexp_replace({title_sql(column)}, '\+|-', '')")


@query(
    "SF22_clean_rating",
    f"SELECT par_id, {rating_sql('grade_desc')} AS grade_desc, {rating_sql('condition_desc')} AS condition_desc FROM raw",
)
def sf22(t: Inputs):
    rated = t.raw().select("par_id", "grade_desc", "condition_desc")
    return rel.across(rated, ["grade_desc", "condition_desc"], rules.clean_rating)


# --- UD: functions as arguments ----------------------------------------------


@query(
    "UD1_map_over_elements",
    """SELECT geo_id, CAST(list_sum(list_transform(list(n ORDER BY style_desc), lambda x: x * x)) AS DOUBLE) AS sum_of_squares,
    CAST(list_max(list_transform(list(n ORDER BY style_desc), lambda x: x + 1)) AS BIGINT) AS largest
    FROM (SELECT geo_id, style_desc, count(*) AS n FROM housing GROUP BY ALL) GROUP BY geo_id""",
)
def ud1(t: Inputs):
    packed = count_by(t.housing(), "geo_id", "style_desc").groupBy("geo_id").agg(F.collect_list("n").alias("n"))
    squares = F.transform("n", lambda x: x.cast("double") * x)
    return packed.select(
        "geo_id",
        F.aggregate(squares, F.lit(0.0), lambda a, b: a + b).alias("sum_of_squares"),
        F.array_max(F.transform("n", lambda x: x + 1)).alias("largest"),
    )


@query(
    "UD2_lambda_over_columns",
    """SELECT par_id, round(pow(10, log10(sale_price_adj) / 2), 6) AS sale_price_adj, round(pow(10, log10(lot_area) / 2), 6)
    AS lot_area FROM housing""",
)
def ud2(t: Inputs):
    chosen = t.housing().select("par_id", "sale_price_adj", "lot_area")
    return rel.across(chosen, ["sale_price_adj", "lot_area"], lambda c: F.round(F.pow(F.lit(10.0), F.log10(c) / 2), 6))


@query(
    "UD3_chosen_aggregate",
    """SELECT geo_id, max(lot_area) AS stat, row_number() OVER (ORDER BY max(lot_area) DESC, geo_id) AS level_rank
    FROM housing GROUP BY geo_id""",
)
def ud3(t: Inputs):
    return fct.level_order(t.housing(), "geo_id", "lot_area", fun=F.max, desc=True)


@query(
    "UD4_metric_bundle",
    """SELECT 'rmse' AS metric, round(sqrt(avg(pow(sale_price_adj - lot_area, 2))), 3) AS estimate FROM housing
    UNION ALL SELECT 'rsq', round(pow(corr(sale_price_adj, lot_area), 2), 8) FROM housing
    UNION ALL SELECT 'mape', round(avg(abs((sale_price_adj - lot_area) / sale_price_adj)) * 100, 6) FROM housing
    UNION ALL SELECT 'mae', round(avg(abs(sale_price_adj - lot_area)), 4) FROM housing""",
)
def ud4(t: Inputs):
    bundle = {"rmse": ev.rmse, "rsq": ev.rsq, "mape": ev.mape, "mae": ev.mae}
    table = ev.metrics(t.housing(), "sale_price_adj", "lot_area", bundle=bundle)
    digits = {"rmse": 3, "rsq": 8, "mape": 6, "mae": 4}
    value = F.col("estimate")
    shown = F.coalesce(*[F.when(F.col("metric") == m, F.round(value, d)) for m, d in digits.items()])
    return table.withColumn("estimate", shown)
