"""Queries: splits, folds and what the recipe learns and produces."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from parcelmill.catalog.aggregation import HASH, pooled_sql
from parcelmill.catalog.inputs import SEED, Inputs, rounded
from parcelmill.catalog.registry import query
from parcelmill.operators import design as ds
from parcelmill.operators import recipe as rec
from parcelmill.operators.relational import longer
from parcelmill.runtime import settle


@query(
    "FE1_random_split",
    f"""SELECT par_id, CASE WHEN row_number() OVER (ORDER BY {HASH}) <= floor(count(*) OVER () * 0.75) THEN 'train'
    ELSE 'test' END AS split FROM housing""",
)
def fe1(t: Inputs):
    return rec.split(t.housing("par_id"), "par_id", SEED).select("par_id", "split")


STRATA = {
    "cuts": """SELECT quantile_cont(sale_price_adj, 0.25) AS a, quantile_cont(sale_price_adj, 0.5) AS b,
        quantile_cont(sale_price_adj, 0.75) AS c FROM housing""",
    "binned": """SELECT h.*, CAST(sale_price_adj > a AS INT) + CAST(sale_price_adj > b AS INT) + CAST(sale_price_adj > c AS INT) AS bin
        FROM housing h, cuts""",
    "labelled": f"""SELECT *, CASE WHEN row_number() OVER (PARTITION BY bin ORDER BY {HASH})
        <= floor(count(*) OVER (PARTITION BY bin) * 0.75) THEN 'train' ELSE 'test' END AS split FROM binned""",
}


@query("FE2_stratified_split", "SELECT par_id, split FROM labelled", **STRATA)
def fe2(t: Inputs):
    labelled = rec.split(t.kept("par_id", "sale_price_adj"), "par_id", SEED, strata="sale_price_adj")
    return labelled.select("par_id", "split")


@query(
    "FE3_folds",
    f"SELECT par_id, (row_number() OVER (ORDER BY {HASH}) - 1) % 10 + 1 AS fold FROM housing",
)
def fe3(t: Inputs):
    return rec.folds(t.housing("par_id"), "par_id", SEED).select("par_id", "fold")


@query(
    "FE4_column_roles",
    """SELECT role, count(*) AS n_columns, CAST(sum(n_present) AS BIGINT) AS n_present FROM (
      SELECT CASE WHEN name = 'par_id' THEN 'id' WHEN name = 'sale_price_adj' THEN 'outcome'
        WHEN name IN ('longitude', 'latitude', 'year_blt') THEN 'metadata'
        WHEN name IN ('school_desc', 'sale_date') THEN 'unused' ELSE 'predictor' END AS role, n_present
      FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM housing) ON COLUMNS(*) INTO NAME name VALUE n_present)) GROUP BY role""",
)
def fe4(t: Inputs):
    housing = t.housing()
    roles = t.spark.createDataFrame(rec.Roles().table(housing), "name string, role string")
    present = longer(housing.agg(*[F.count(c).alias(c) for c in housing.columns]), [], None, "name", "n")
    return roles.join(present, "name").groupBy("role").agg(
        F.count(F.lit(1)).alias("n_columns"), F.sum("n").cast("long").alias("n_present")
    )


@query("FE5_log_outcome", "SELECT par_id, round(log10(sale_price_adj), 6) AS label FROM housing")
def fe5(t: Inputs):
    return rounded(rec.with_label(t.housing()).select("par_id", "label"), 6, "label")


MODES = """SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS mode FROM (SELECT {c}, count(*) AS n FROM housing WHERE {c} IS NOT NULL
    GROUP BY {c} ORDER BY n DESC, CAST({c} AS VARCHAR) LIMIT 1)"""


@query(
    "FE6_impute_mode",
    """SELECT par_id, coalesce(condition_desc, (SELECT mode FROM m WHERE name = 'condition_desc')) AS condition_desc,
    coalesce(heat_type, (SELECT mode FROM m WHERE name = 'heat_type')) AS heat_type FROM housing""",
    m=MODES.format(c="condition_desc") + " UNION ALL " + MODES.format(c="heat_type"),
)
def fe6(t: Inputs):
    chosen = t.kept("par_id", "condition_desc", "heat_type")
    return rec.ModeImputer(["condition_desc", "heat_type"]).fit(chosen).transform(chosen)


@query(
    "FE7_impute_median",
    """SELECT par_id, coalesce(CAST(bedrooms AS DOUBLE), (SELECT quantile_cont(bedrooms, 0.5) FROM housing)) AS bedrooms FROM housing""",
)
def fe7(t: Inputs):
    chosen = t.kept("par_id", "bedrooms")
    return rec.MedianImputer(["bedrooms"]).fit(chosen).transform(chosen)


HEAT_RULE = """CASE WHEN heat_type IN ('Central Heat', 'None') THEN heat_type WHEN heat_type IS NULL THEN 'Missing' ELSE 'Other' END"""


@query(
    "FE8_rule_recodes",
    f"""SELECT par_id, {pooled_sql("condition_desc", rec.CONDITION_GROUPS)} AS condition_desc,
    {pooled_sql("grade_desc", rec.GRADE_GROUPS)} AS grade_desc, {HEAT_RULE} AS heat_type FROM housing""",
)
def fe8(t: Inputs):
    stages = [
        rec.ValueRules("heat_type", {"Central Heat": ["Central Heat"], "None": ["None"]}, "Missing", "Other"),
        rec.ValueRules("condition_desc", rec.CONDITION_GROUPS),
        rec.ValueRules("grade_desc", rec.GRADE_GROUPS),
    ]
    chosen = t.housing().select("par_id", "condition_desc", "grade_desc", "heat_type")
    return Pipeline(stages=stages).fit(chosen).transform(chosen)


@query(
    "FE9_pool_rare_by_share",
    """SELECT par_id, CASE WHEN n >= 0.041 * total THEN geo_id ELSE 'school_other' END AS geo_id FROM
    (SELECT par_id, geo_id, count(*) OVER (PARTITION BY geo_id) AS n, count(*) OVER () AS total FROM housing)""",
)
def fe9(t: Inputs):
    chosen = t.kept("par_id", "geo_id")
    return rec.RareLevels({"geo_id": 0.041}, {"geo_id": "school_other"}).fit(chosen).transform(chosen)


@query(
    "FE10_pool_rare_by_count",
    """SELECT par_id, CASE WHEN n >= 500 THEN geo_id ELSE 'school_other' END AS geo_id FROM
    (SELECT par_id, geo_id, count(*) OVER (PARTITION BY geo_id) AS n FROM housing)""",
)
def fe10(t: Inputs):
    chosen = t.kept("par_id", "geo_id")
    return rec.RareLevels({"geo_id": 500}, {"geo_id": "school_other"}).fit(chosen).transform(chosen)


REFERENCES = " ".join(f"WHEN '{name}' THEN '{level}'" for name, level in rec.REFERENCE_LEVELS.items())
SUFFIX = "regexp_replace(level, '[^0-9A-Za-z._]', '.', 'g')"


def _mode_sql(column: str) -> str:
    return f"(SELECT {column} FROM d_text WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)"


def _pooled_sql(name: str, nth: int, least: str, other: str) -> str:
    return f"""SELECT par_id, '{name}' AS name, {nth} AS nth, CASE WHEN {name} IS NULL THEN NULL
        WHEN n >= {least} OR (top_n < {least} AND {name} = top) THEN {name} ELSE '{other}' END AS level
      FROM d_filled LEFT JOIN (SELECT {name}, count(*) AS n, sum(count(*)) OVER () AS total, max(count(*)) OVER () AS top_n,
        first_value({name}) OVER (ORDER BY count(*) DESC, {name} DESC) AS top FROM d_text WHERE {name} IS NOT NULL GROUP BY {name}) USING ({name})"""


def design_sql(source: str = "housing", area_rows: int = 500) -> dict[str, str]:
    """The recipe learnt from ``source``: d_filled (rows), d_cells (row, column, level), d_levels and d_coded (row, term)."""
    merged = {
        "condition_desc": pooled_sql("condition_desc", rec.CONDITION_GROUPS), "grade_desc": pooled_sql("grade_desc", rec.GRADE_GROUPS), "ac_flag": "ac_flag",
    }
    own = {"grade_desc": 3, "condition_desc": 4, "ac_flag": 5, "heat_type": 6, "sale_month": 7}
    return {
        "d_text": f"SELECT * REPLACE (upper(CAST(ac_flag AS VARCHAR)) AS ac_flag) FROM {source}",
        "d_full": "SELECT * REPLACE (" + ", ".join(f"coalesce({c}, {_mode_sql(c)}) AS {c}" for c in merged) + ", "
        + ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont({c}, 0.5) FROM d_text)) AS {c}" for c in ("bedrooms", "fullbaths", "halfbaths"))
        + ") FROM d_text",
        "d_filled": "SELECT * REPLACE (" + ", ".join(f"{x} AS {c}" for c, x in merged.items()) + f", {HEAT_RULE} AS heat_type) FROM d_full",
        "d_cells": " UNION ALL ".join(
            [_pooled_sql("geo_id", 1, str(area_rows), "school_other"), _pooled_sql("style_desc", 2, "0.05 * total", "style_other")]
            + [f"SELECT par_id, '{c}', {k}, {c} FROM d_filled" for c, k in own.items()]
        ),
        "d_levels": f"""SELECT name, nth, level, count(*) AS n, row_number() OVER (PARTITION BY name
            ORDER BY CASE WHEN level = CASE name {REFERENCES} END THEN 0 ELSE 1 END, level) AS position FROM d_cells WHERE level IS NOT NULL GROUP BY name, nth, level""",
        "d_coded": f"""SELECT par_id, name || '_' || CASE WHEN regexp_matches({SUFFIX}, '^([0-9]|[.][0-9]|_)') THEN 'X' ELSE '' END || {SUFFIX} AS term
            FROM d_cells JOIN d_levels USING (name, level) WHERE position > 1""",
    }


NUMBERS = rec.Roles().numeric


def learnt(rows) -> tuple:
    """The rows prepared for the recipe of all columns, and what the recipe learns from them."""
    ready = settle(ds.prepared(rows, ds.sales_recipe()))
    return ready, ds.learn(ready, ds.sales_recipe())


def coded_rows(ready, design):
    """(par_id, term, value): the non-zero entries of every design row, the numbers always."""
    names = ds.term_names(design).select("term", F.col("name").alias("of_term"))
    entries = ds.encode(ready, design).select("par_id", F.explode(F.arrays_zip("terms", "weights")).alias("e"))
    return entries.select("par_id", F.col("e.terms").alias("term"), F.col("e.weights").alias("value")).join(names, "term").select(
        "par_id", F.col("of_term").alias("term"), "value"
    )


@query("FE11_reference_levels", "SELECT name, level, position, n FROM d_levels", **design_sql())
def fe11(t: Inputs):
    """Levels of all seven nominal columns, the reference level first."""
    return learnt(t.housing())[1].levels.select("name", "level", "position", "n")


@query("FE12_dummy_columns", "SELECT par_id, term, 1.0::DOUBLE AS value FROM d_coded", **design_sql())
def fe12(t: Inputs):
    """Dummies of all seven nominal columns, as the entries that are 1."""
    coded = coded_rows(*learnt(t.housing()))
    return coded.where(~F.col("term").isin(*NUMBERS))


BAKED = {
    **STRATA,
    "train": "SELECT * FROM labelled WHERE split = 'train'",
    "med": "SELECT quantile_cont(bedrooms, 0.5) AS m FROM train",
    "mode": """SELECT condition_desc AS c FROM train WHERE condition_desc IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1""",
    "kept": """SELECT geo_id FROM (SELECT geo_id, count(*) AS n, max(count(*)) OVER () AS most, row_number() OVER (ORDER BY count(*) DESC, geo_id DESC) AS place
        FROM train GROUP BY geo_id) WHERE n >= 440 OR (most < 440 AND place = 1)""",
}


@query(
    "FE13_fit_and_apply_recipe",
    f"""SELECT par_id, coalesce(CAST(bedrooms AS DOUBLE), (SELECT m FROM med)) AS bedrooms, {HEAT_RULE} AS heat_type,
    coalesce({pooled_sql("condition_desc", rec.CONDITION_GROUPS)}, (SELECT CASE c WHEN 'Poor' THEN 'Poor or worse' ELSE c END FROM mode))
      AS condition_desc, CASE WHEN geo_id IN (SELECT geo_id FROM kept) THEN geo_id ELSE 'school_other' END AS geo_id
    FROM labelled WHERE split = 'test'""",
    **BAKED,
)
def fe13(t: Inputs):
    rows = settle(rec.split(t.kept(), "par_id", SEED, strata="sale_price_adj"))
    recipe = ds.sales_recipe(area_rows=440)
    design = ds.learn(ds.prepared(rows.where(F.col("split") == "train"), recipe), recipe)
    baked = ds.bake(ds.prepared(rows.where(F.col("split") == "test"), recipe), design)
    level = {c.column: F.col(f"__l{k}").alias(c.column) for k, c in enumerate(recipe.categories)}
    beds = F.col(f"__x{list(recipe.numeric).index('bedrooms')}").alias("bedrooms")
    return baked.select("par_id", beds, level["heat_type"], level["condition_desc"], level["geo_id"])


@query(
    "FE13_design_vector",
    " UNION ALL ".join([f"SELECT par_id, '{c}' AS term, round(CAST({c} AS DOUBLE), 6) AS value FROM d_filled" for c in NUMBERS])
    + " UNION ALL SELECT par_id, term, 1.0::DOUBLE FROM d_coded",
    **design_sql(),
)
def fe13_vector(t: Inputs):
    return rounded(coded_rows(*learnt(t.housing())), 6, "value")


@query(
    "FE14_impute_mode_within_group",
    """SELECT par_id, coalesce(h.condition_desc, l.mode, (SELECT condition_desc FROM housing WHERE condition_desc IS NOT NULL
      GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS condition_desc FROM housing h LEFT JOIN (SELECT geo_id, style_desc,
      condition_desc AS mode FROM (SELECT geo_id, style_desc, condition_desc, row_number() OVER (PARTITION BY geo_id, style_desc
      ORDER BY count(*) DESC, condition_desc) AS r FROM housing WHERE condition_desc IS NOT NULL
      GROUP BY geo_id, style_desc, condition_desc) WHERE r = 1) l
    USING (geo_id, style_desc)""",
)
def fe14(t: Inputs):
    chosen = t.kept("par_id", "geo_id", "style_desc", "condition_desc")
    filled = rec.impute_mode_within(chosen, ["geo_id", "style_desc"], "condition_desc")
    return filled.select("par_id", "condition_desc")
