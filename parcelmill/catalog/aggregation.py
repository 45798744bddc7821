"""Queries: aggregates, window-style operators, order, set operations, reshaping, categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelmill.catalog.inputs import HOUSING_TYPES, SEED, Inputs, rounded
from parcelmill.catalog.registry import query
from parcelmill.functions.dates import MONTHS
from parcelmill.functions.property_rules import EXTRA_USES, GRADE_ORDER
from parcelmill.operators import aggregates as agg
from parcelmill.operators import factors as fct
from parcelmill.operators import relational as rel
from parcelmill.operators import windows as win
from parcelmill.operators.recipe import CONDITION_GROUPS, GRADE_GROUPS
from parcelmill.functions.property_rules import pool_values
from parcelmill.plans import cleaning
from parcelmill.runtime import lookup_join, settle


def in_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def pooled_sql(column: str, groups: dict) -> str:
    whens = " ".join(f"WHEN {column} IN ({in_list(old)}) THEN '{new}'" for new, old in groups.items())
    return f"CASE {whens} ELSE {column} END"


@query(
    "flagship_area_ranking",
    """SELECT g.geo_id, n, round(median_price, 6) AS median_price,
    CAST(row_number() OVER (ORDER BY median_price, g.geo_id) AS BIGINT) AS price_rank, n_large
    FROM (SELECT geo_id, count(*) AS n, quantile_cont(sale_price_adj, 0.5) AS median_price FROM housing GROUP BY geo_id) g
    JOIN (SELECT geo_id, CAST(sum(CASE WHEN z > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_large FROM
      (SELECT geo_id, (finished_living_area - avg(finished_living_area) OVER w) / stddev_samp(finished_living_area) OVER w AS z
       FROM housing WINDOW w AS (PARTITION BY style_desc)) GROUP BY geo_id) z ON z.geo_id = g.geo_id""",
)
def flagship(t: Inputs):
    housing = t.kept("geo_id", "style_desc", "sale_price_adj", "finished_living_area")
    stats = agg.count_and_median(housing, ["geo_id"], "sale_price_adj")
    ranked = fct.rank_levels(stats, F.asc_nulls_last("median"), F.asc("geo_id"), name="price_rank")
    scored = win.zscore(housing, ["style_desc"], "finished_living_area", "z")
    large = scored.groupBy("geo_id").agg(F.sum(F.when(F.col("z") > 1, 1).otherwise(0)).alias("n_large"))
    joined = lookup_join(ranked, large, ["geo_id"])
    return joined.select(
        "geo_id", "n", F.round("median", 6).alias("median_price"), "price_rank", "n_large"
    ).orderBy("price_rank")


# --- AG ----------------------------------------------------------------------


@query("AG1_count_sorted", "SELECT geo_id, condition_desc, count(*) AS n FROM housing GROUP BY ALL")
def ag1(t: Inputs):
    return agg.count_by(t.housing(), "geo_id", "condition_desc", sort=True)


@query(
    "AG2_mean_sd",
    """SELECT geo_id, round(avg(lot_area), 6) AS lot_area_mean, round(stddev_samp(lot_area), 3) AS lot_area_sd
    FROM housing GROUP BY geo_id""",
)
def ag2(t: Inputs):
    table = agg.mean_sd(t.housing(), ["geo_id"], "lot_area")
    return rounded(rounded(table, 6, "lot_area_mean"), 3, "lot_area_sd")


@query(
    "AG3_group_median",
    "SELECT geo_id, style_desc, round(quantile_cont(sale_price_adj, 0.5), 6) AS median FROM housing GROUP BY ALL",
)
def ag3(t: Inputs):
    return rounded(agg.median(t.kept("geo_id", "style_desc", "sale_price_adj"), ["geo_id", "style_desc"], "sale_price_adj"), 6, "median")


@query(
    "AG4_count_and_median",
    "SELECT sale_year, round(quantile_cont(sale_price_adj, 0.5), 6) AS median, count(*) AS n FROM housing GROUP BY ALL",
)
def ag4(t: Inputs):
    return rounded(agg.count_and_median(t.kept("sale_year", "sale_price_adj"), ["sale_year"], "sale_price_adj"), 6, "median")


@query(
    "AG5_quantiles",
    """SELECT style_desc, round(quantile_cont(lot_area, 0.7), 6) AS q70, round(quantile_cont(lot_area, 0.95), 6) AS q95
    FROM housing GROUP BY style_desc""",
)
def ag5(t: Inputs):
    return rounded(agg.quantiles(t.kept("style_desc", "lot_area"), ["style_desc"], "lot_area", {"q70": 0.7, "q95": 0.95}), 6, "q70", "q95")


@query(
    "AG5_quantiles_of_large_groups",
    """SELECT style_desc, round(quantile_cont(lot_area, 0.05), 6) AS q05, round(quantile_cont(lot_area, 0.5), 6) AS q50,
    round(quantile_cont(lot_area, 0.95), 6) AS q95 FROM housing GROUP BY style_desc""",
)
def ag5_large(t: Inputs):
    marks = {"q05": 0.05, "q50": 0.5, "q95": 0.95}
    # A low limit sends these groups down the path for groups one task could not hold.
    found = agg.quantiles(t.kept("style_desc", "lot_area"), ["style_desc"], "lot_area", marks, max_group_rows=1000)
    return rounded(found, 6, *marks)


@query(
    "AG6_iqr",
    """SELECT geo_id, round(quantile_cont(sale_price_adj, 0.75) - quantile_cont(sale_price_adj, 0.25), 6) AS iqr
    FROM housing GROUP BY geo_id""",
)
def ag6(t: Inputs):
    return rounded(agg.iqr(t.kept("geo_id", "sale_price_adj"), ["geo_id"], "sale_price_adj"), 6, "iqr")


@query(
    "AG7_min_max_sum",
    """SELECT geo_id, min(lot_area) AS smallest, max(year_blt) AS newest, CAST(sum(bedrooms) AS BIGINT) AS rooms
    FROM housing GROUP BY geo_id""",
)
def ag7(t: Inputs):
    return t.housing().groupBy("geo_id").agg(
        F.min("lot_area").alias("smallest"), F.max("year_blt").alias("newest"), F.sum("bedrooms").alias("rooms")
    )


@query(
    "AG8_top_three_by_sum",
    """SELECT geo_id, round(sum(finished_living_area), 2) AS total FROM housing GROUP BY geo_id
    ORDER BY sum(finished_living_area) DESC, geo_id LIMIT 3""",
)
def ag8(t: Inputs):
    return rounded(agg.top_groups_by_sum(t.housing(), "geo_id", "finished_living_area"), 2, "total")


@query("AG9_distinct", "SELECT DISTINCT geo_id, style_desc, grade_desc FROM housing")
def ag9(t: Inputs):
    return t.housing().select("geo_id", "style_desc", "grade_desc").distinct()


@query("AG10_row_count", "SELECT count(*) AS n FROM housing")
def ag10(t: Inputs):
    return t.housing().agg(F.count(F.lit(1)).alias("n"))


@query(
    "AG11_share_of_total",
    """SELECT grade_desc, condition_desc, n, round(n / sum(n) OVER (), 8) AS share
    FROM (SELECT grade_desc, condition_desc, count(*) AS n FROM housing GROUP BY ALL)""",
)
def ag11(t: Inputs):
    counts = settle(agg.count_by(t.housing(), "grade_desc", "condition_desc"))
    return rounded(agg.share_of_total(counts), 8, "share")


def _profile_sql() -> str:
    def column(position: int, c: str, kind: str) -> str:
        length = f"min(length({c})) AS min_length, max(length({c})) AS max_length" if kind == "string" else "CAST(NULL AS BIGINT) AS min_length, CAST(NULL AS BIGINT) AS max_length"
        marks = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1.0}
        if kind in ("bigint", "double"):
            numbers = [f"round(avg({c}), 4) AS mean", f"round(stddev_samp({c}), 3) AS sd"]
            numbers += [f"round(quantile_cont(CAST({c} AS DOUBLE), {p}), 4) AS {name}" for name, p in marks.items()]
        else:
            numbers = [f"CAST(NULL AS DOUBLE) AS {name}" for name in ("mean", "sd", *marks)]
        return f"""SELECT CAST({position} AS BIGINT) AS position, '{c}' AS "column", '{kind}' AS type, CAST(count(*) - count({c}) AS BIGINT) AS n_missing,
            round(count({c}) / count(*), 6) AS complete_rate, count(DISTINCT {c}) AS n_unique, {length}, {", ".join(numbers)} FROM housing"""

    return " UNION ALL ".join(column(k + 1, c, kind) for k, (c, kind) in enumerate(HOUSING_TYPES.items()))


@query("AG12_column_profile", _profile_sql())
def ag12(t: Inputs):
    """All columns of the sales table, with their positions and types."""
    table = agg.profile(t.kept(*HOUSING_TYPES))
    table = rounded(table, 4, "mean", "p0", "p25", "p50", "p75", "p100")
    return rounded(rounded(table, 3, "sd"), 6, "complete_rate")


@query(
    "AG13_allow_list",
    f"""SELECT usedesc FROM best UNION ALL SELECT usedesc FROM counts WHERE usedesc NOT IN (SELECT usedesc FROM best)
    AND usedesc IN ({in_list(EXTRA_USES)})""",
    counts="""SELECT usedesc, count(*) AS n FROM raw WHERE sale_desc IN ('VALID SALE', 'OTHER VALID') GROUP BY usedesc""",
    best="SELECT usedesc FROM counts ORDER BY n DESC, usedesc LIMIT 10",
)
def ag13(t: Inputs):
    return cleaning.allowed_uses(t.raw())


@query(
    "AG14_recode_counts",
    f"""SELECT condition_desc, {pooled_sql("condition_desc", CONDITION_GROUPS)} AS condition_new, count(*) AS n
    FROM housing GROUP BY ALL""",
)
def ag14(t: Inputs):
    new = pool_values(F.col("condition_desc"), CONDITION_GROUPS)
    return agg.recode_counts(t.housing(), "condition_desc", new, "condition_new")


@query(
    "AG15_grouped_metric",
    """SELECT geo_id, round(sqrt(avg(pow(log10(sale_price_adj) - 5.2, 2))), 6) AS rmse,
    round(avg(abs(log10(sale_price_adj) - 5.2)), 6) AS mae FROM housing GROUP BY geo_id""",
)
def ag15(t: Inputs):
    gap = F.log10("sale_price_adj") - 5.2
    return t.housing().groupBy("geo_id").agg(
        F.round(F.sqrt(F.avg(gap * gap)), 6).alias("rmse"), F.round(F.avg(F.abs(gap)), 6).alias("mae")
    )


# --- WN ----------------------------------------------------------------------


@query("WN1_group_size_on_rows", "SELECT par_id, geo_id, count(*) OVER (PARTITION BY geo_id) AS n FROM housing")
def wn1(t: Inputs):
    return win.add_count(t.housing().select("par_id", "geo_id"), "geo_id")


@query(
    "WN2_zscore_within_group",
    """SELECT par_id, round((lot_area - avg(lot_area) OVER g) / stddev_samp(lot_area) OVER g, 6) AS lot_area_zscore,
    round((finished_living_area - avg(finished_living_area) OVER s) / stddev_samp(finished_living_area) OVER s, 6)
      AS finished_living_area_zscore
    FROM housing WINDOW g AS (PARTITION BY geo_id), s AS (PARTITION BY style_desc)""",
)
def wn2(t: Inputs):
    housing = t.kept("par_id", "geo_id", "style_desc", "lot_area", "finished_living_area")
    scored = win.zscore(housing, ["geo_id"], "lot_area", "lot_area_zscore")
    scored = win.zscore(scored, ["style_desc"], "finished_living_area", "finished_living_area_zscore")
    out = scored.select("par_id", "lot_area_zscore", "finished_living_area_zscore")
    return rounded(out, 6, "lot_area_zscore", "finished_living_area_zscore")


@query(
    "WN3_zscore_from_lookup",
    """SELECT h.par_id, round((h.lot_area - m) / s, 6) AS lot_area_zscore FROM housing h
    LEFT JOIN (SELECT geo_id, avg(lot_area) AS m, stddev_samp(lot_area) AS s FROM housing WHERE sale_year < 1999
      GROUP BY geo_id) l USING (geo_id)""",
)
def wn3(t: Inputs):
    housing = t.housing()
    stored = agg.mean_sd(housing.where(F.col("sale_year") < 1999), ["geo_id"], "lot_area")
    scored = win.zscore_from(housing, stored, ["geo_id"], "lot_area", "lot_area_zscore")
    return rounded(scored.select("par_id", "lot_area_zscore"), 6, "lot_area_zscore")


HASH = f"md5(concat_ws('|', '{SEED}', CAST(par_id AS VARCHAR))), CAST(par_id AS VARCHAR)"


@query(
    "WN4_sample_per_group",
    f"""SELECT geo_id, par_id FROM (SELECT geo_id, par_id, row_number() OVER (PARTITION BY geo_id ORDER BY {HASH}) AS r
    FROM housing) WHERE r <= 100""",
)
def wn4(t: Inputs):
    return win.sample_per_group(t.housing().select("geo_id", "par_id"), ["geo_id"], 100, "par_id", SEED)


@query(
    "WN5_parent_then_child_order",
    """SELECT school_desc, geo_id, n, CAST(sum(n) OVER (PARTITION BY school_desc) AS BIGINT) AS parent_total
    FROM (SELECT school_desc, geo_id, count(*) AS n FROM housing GROUP BY ALL)""",
)
def wn5(t: Inputs):
    return win.parent_child_counts(t.housing(), "school_desc", "geo_id")


@query(
    "WN6_rank_within_facet",
    """SELECT style_desc, geo_id, n, row_number() OVER (PARTITION BY style_desc ORDER BY n, geo_id) AS position
    FROM (SELECT style_desc, geo_id, count(*) AS n FROM housing GROUP BY ALL)""",
)
def wn6(t: Inputs):
    counts = agg.count_by(t.housing(), "style_desc", "geo_id")
    return win.rank_within(counts, ["style_desc"], F.asc("n"), F.asc("geo_id"))


# --- SL ----------------------------------------------------------------------


@query("SL1_sort", "SELECT geo_id, style_desc, count(*) AS n FROM housing GROUP BY ALL")
def sl1(t: Inputs):
    return agg.count_by(t.housing(), "geo_id", "style_desc").orderBy("geo_id", F.desc("n"), "style_desc")


@query(
    "SL2_first_k",
    "SELECT geo_id, count(*) AS n FROM housing GROUP BY geo_id ORDER BY n DESC, geo_id LIMIT 10",
)
def sl2(t: Inputs):
    return agg.count_by(t.housing(), "geo_id").orderBy(F.desc("n"), "geo_id").limit(10)


@query(
    "SL3_declared_order",
    f"""SELECT grade_desc, CAST(list_position([{in_list(GRADE_ORDER)}], grade_desc) AS BIGINT) AS level_rank
    FROM (SELECT DISTINCT grade_desc FROM housing)""",
)
def sl3(t: Inputs):
    levels = t.housing().select("grade_desc").distinct()
    return fct.declared(levels, "grade_desc", GRADE_ORDER).orderBy("level_rank")


# --- ST ----------------------------------------------------------------------


@query(
    "ST1_union_by_name",
    """SELECT par_id, geo_id, sale_price, CAST(NULL AS BIGINT) AS bedrooms FROM sales WHERE sale_year < 1998
    UNION ALL SELECT par_id, geo_id, NULL, bedrooms FROM sales WHERE sale_year >= 1998""",
)
def st1(t: Inputs):
    sales = t.sales()
    old = sales.where(F.col("sale_year") < 1998).select("par_id", "geo_id", "sale_price")
    new = sales.where(F.col("sale_year") >= 1998).select("geo_id", "bedrooms", "par_id")
    return rel.bind_rows(old, new)


@query(
    "ST2_labelled_union",
    """SELECT 'mean' AS model, geo_id, round(avg(sale_price_adj), 6) AS estimate FROM housing GROUP BY geo_id
    UNION ALL SELECT 'max', geo_id, max(sale_price_adj) FROM housing GROUP BY geo_id""",
)
def st2(t: Inputs):
    groups = t.housing().groupBy("geo_id")
    return rel.bind_labelled(
        {
            "mean": groups.agg(F.round(F.avg("sale_price_adj"), 6).alias("estimate")),
            "max": groups.agg(F.max("sale_price_adj").alias("estimate")),
        }
    )


@query(
    "ST3_exactly_one_of_three",
    """SELECT school_district AS name, count(*) AS n FROM school_layer GROUP BY 1
    UNION ALL SELECT council_district, count(*) FROM council_layer GROUP BY 1
    UNION ALL SELECT label, count(*) FROM town_layer GROUP BY 1""",
)
def st3(t: Inputs):
    merged = rel.bind_rows(t.school_layer(), t.council_layer(), t.town_layer())
    name = rel.exactly_one(F.col("school_district"), F.col("council_district"), F.col("label"))
    return merged.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "ST4_repair_and_append",
    """SELECT par_id, coalesce(heatingcooling_desc, 'Unknown ' || style_desc) AS heatingcooling_desc FROM sales""",
)
def st4(t: Inputs):
    rows = t.sales().select("par_id", "style_desc", "heatingcooling_desc")
    named = F.concat(F.lit("Unknown "), F.col("style_desc"))
    fixed = rel.repair_rows(
        rows, F.col("heatingcooling_desc").isNull(), "par_id", lambda bad: bad.withColumn("heatingcooling_desc", named)
    )
    return fixed.select("par_id", "heatingcooling_desc")


# --- RS ----------------------------------------------------------------------


@query(
    "RS1_longer_chosen",
    """SELECT par_id, 'lot_area' AS name, lot_area AS value FROM housing
    UNION ALL SELECT par_id, 'finished_living_area', finished_living_area FROM housing""",
)
def rs1(t: Inputs):
    return rel.longer(t.housing(), ["par_id"], ["lot_area", "finished_living_area"])


@query(
    "RS2_longer_all_numeric",
    "SELECT par_id, name, value FROM (SELECT par_id, "
    + ", ".join(
        f"CAST({c} AS DOUBLE) AS {c}"
        for c in ("sale_price_adj", "sale_year", "bedrooms", "fullbaths", "halfbaths")
    )
    + """ FROM housing) UNPIVOT INCLUDE NULLS (value FOR name IN (sale_price_adj, sale_year, bedrooms, fullbaths, halfbaths))""",
)
def rs2(t: Inputs):
    chosen = t.housing().select(
        "par_id", "sale_price_adj", "sale_year", "bedrooms", "fullbaths", "halfbaths", "geo_id"
    )
    numeric = [c for c in rel.numeric_columns(chosen) if c != "par_id"]
    return rel.longer(chosen.select("par_id", *numeric), ["par_id"], as_type="double")


@query(
    "RS3_wider",
    """SELECT geo_id, count(*) FILTER (style_desc = 'BUILDING') AS BUILDING,
    count(*) FILTER (style_desc = 'HOUSEHOLD') AS HOUSEHOLD, count(*) FILTER (style_desc = 'MACHINERY') AS MACHINERY
    FROM housing GROUP BY geo_id""",
)
def rs3(t: Inputs):
    levels = ["BUILDING", "HOUSEHOLD", "MACHINERY"]
    wide = rel.wider(agg.count_by(t.housing(), "geo_id", "style_desc"), ["geo_id"], "style_desc", "n", levels)
    return wide.fillna(0, levels)


@query(
    "RS4_unnest",
    """SELECT geo_id, style_desc, grade_desc, count(*) AS n FROM housing GROUP BY ALL""",
)
def rs4(t: Inputs):
    counts = agg.count_by(t.housing(), "geo_id", "style_desc", "grade_desc")
    return rel.unnest(rel.nest(counts, ["geo_id"], "tables"), "tables")


@query(
    "RS5_complete_grid",
    """SELECT a.geo_id, b.sale_month, coalesce(n, 0) AS n FROM (SELECT DISTINCT geo_id FROM housing) a
    CROSS JOIN (SELECT DISTINCT sale_month FROM housing) b
    LEFT JOIN (SELECT geo_id, sale_month, count(*) AS n FROM housing WHERE style_desc = 'BUILDING' AND
      sale_year = 1996 GROUP BY ALL) c ON c.geo_id = a.geo_id AND c.sale_month = b.sale_month
    WHERE a.geo_id IN (SELECT geo_id FROM housing WHERE style_desc = 'BUILDING' AND sale_year = 1996)
      AND b.sale_month IN (SELECT sale_month FROM housing WHERE style_desc = 'BUILDING' AND sale_year = 1996)""",
)
def rs5(t: Inputs):
    chosen = t.housing().where((F.col("style_desc") == "BUILDING") & (F.col("sale_year") == 1996))
    return rel.complete_counts(agg.count_by(chosen, "geo_id", "sale_month"), "geo_id", "sale_month")


@query(
    "RS6_enframe",
    """SELECT geo_id, name, value FROM (SELECT geo_id, row_number() OVER (PARTITION BY geo_id ORDER BY n, style_desc) AS name,
    n AS value FROM (SELECT geo_id, style_desc, count(*) AS n FROM housing GROUP BY ALL))""",
)
def rs6(t: Inputs):
    counts = agg.count_by(t.housing(), "geo_id", "style_desc")
    packed = counts.groupBy("geo_id").agg(F.sort_array(F.collect_list(F.struct("n", "style_desc"))).alias("c"))
    return rel.enframe(packed.select("geo_id", F.col("c.n").alias("counts")), "counts")


# --- FC ----------------------------------------------------------------------

BY_MEDIAN = """SELECT geo_id, round(quantile_cont(sale_price_adj, 0.5), 6) AS stat,
    row_number() OVER (ORDER BY quantile_cont(sale_price_adj, 0.5), geo_id) AS level_rank FROM housing GROUP BY geo_id"""


@query("FC1_reorder_by_median", BY_MEDIAN)
def fc1(t: Inputs):
    return rounded(fct.level_order(t.kept("geo_id", "sale_price_adj"), "geo_id", "sale_price_adj"), 6, "stat")


@query("FC2_reverse_order", f"SELECT geo_id, (SELECT count(*) FROM o) + 1 - level_rank AS level_rank FROM o", o=BY_MEDIAN)
def fc2(t: Inputs):
    order = settle(fct.level_order(t.kept("geo_id", "sale_price_adj"), "geo_id", "sale_price_adj"))
    return fct.reverse(order).select("geo_id", "level_rank")


@query(
    "FC3_move_to_front",
    """SELECT grade_desc, row_number() OVER (ORDER BY CASE grade_desc WHEN 'Average' THEN 1 WHEN 'Good' THEN 2 ELSE 3 END,
    grade_desc) AS level_rank FROM (SELECT DISTINCT grade_desc FROM housing)""",
)
def fc3(t: Inputs):
    return fct.relevel(t.housing().select("grade_desc").distinct(), "grade_desc", ["Average", "Good"])


@query(
    "FC4_lump_top",
    """SELECT CASE WHEN r <= 5 THEN geo_id ELSE 'Other' END AS geo_id, CAST(sum(n) AS BIGINT) AS n
    FROM (SELECT geo_id, n, rank() OVER (ORDER BY n DESC) AS r FROM (SELECT geo_id, count(*) AS n FROM housing GROUP BY geo_id))
    GROUP BY 1""",
)
def fc4(t: Inputs):
    return fct.lump_top(agg.count_by(t.housing(), "geo_id"), "geo_id", 5)


@query(
    "FC5_lump_rare",
    """SELECT par_id, CASE WHEN n < (SELECT count(*) / 25 FROM housing) THEN 'Other' ELSE geo_id END AS geo_id
    FROM (SELECT par_id, geo_id, count(*) OVER (PARTITION BY geo_id) AS n FROM housing)""",
)
def fc5(t: Inputs):
    housing = settle(t.housing().select("par_id", "geo_id"))
    return fct.lump_rare(housing, "geo_id", housing.count() / 25)


@query(
    "FC6_explicit_missing",
    "SELECT coalesce(condition_desc, '(Missing)') AS condition_desc, count(*) AS n FROM housing GROUP BY 1",
)
def fc6(t: Inputs):
    shown = t.housing().withColumn("condition_desc", fct.explicit_missing(F.col("condition_desc")))
    return agg.count_by(shown, "condition_desc")


SUMMER = MONTHS[4:9]


@query(
    "FC7_declared_levels",
    f"""SELECT par_id, CASE WHEN sale_month IN ({in_list(SUMMER)}) THEN sale_month END AS sale_month,
    CAST(list_position([{in_list(SUMMER)}], sale_month) AS BIGINT) AS level_rank FROM housing""",
)
def fc7(t: Inputs):
    return fct.declared(t.housing().select("par_id", "sale_month"), "sale_month", SUMMER)


__all__ = ["GRADE_GROUPS", "in_list", "pooled_sql", "HASH"]
