"""Queries: models, evaluation and attribution.

Queries whose SQL states the least-squares solution use one or two predictors. The full recipe is checked by
what must hold of its solution (residuals have no product with any term), full-size trees by what must hold of
every fit; both are compared with other implementations in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelmill.catalog.aggregation import HASH
from parcelmill.catalog.features import NUMBERS, coded_rows, design_sql
from parcelmill.catalog.inputs import SEED, Inputs, rounded
from parcelmill.catalog.registry import query
from parcelmill.functions.numeric import normal_quantile
from parcelmill.operators import design as ds
from parcelmill.operators import ensembles, models
from parcelmill.operators import evaluation as ev
from parcelmill.operators import normal_equations as equations
from parcelmill.operators import recipe as rec
from parcelmill.operators.aggregates import median
from parcelmill.operators.distribution import box_summary
from parcelmill.operators.relational import longer
from parcelmill.plans import modelling
from parcelmill.runtime import settle

AREA = ["finished_living_area"]
TWO = ["finished_living_area", "house_age_at_sale"]
ONE, BOTH = ds.Recipe(AREA), ds.Recipe(TWO)


def small_fit(rows: DataFrame, names: list[str] = AREA):
    return models.fit(rows, models.linear(), [rec.DesignVector(names)])


FIT1 = {
    "fit1": """SELECT regr_intercept(log10(sale_price_adj), finished_living_area) AS a,
        regr_slope(log10(sale_price_adj), finished_living_area) AS b FROM housing""",
    "scored": """SELECT h.*, a + b * finished_living_area AS pred, pow(10, a + b * finished_living_area) AS pred_dollar
        FROM housing h, fit1""",
}
FIT2 = {
    "s1": """SELECT regr_intercept(y, x) AS ay, regr_slope(y, x) AS b_y, regr_intercept(z, x) AS az, regr_slope(z, x) AS bz FROM
        (SELECT log10(sale_price_adj) AS y, finished_living_area AS x, CAST(house_age_at_sale AS DOUBLE) AS z FROM housing)""",
    "s2": """SELECT regr_slope(log10(sale_price_adj) - ay - b_y * finished_living_area,
        house_age_at_sale - az - bz * finished_living_area) AS c FROM housing, s1""",
    "fit2": "SELECT ay - c * az AS a, b_y - c * bz AS b, c FROM s1, s2",
}
T_TERMS = """((pow({z}, 3) + {z}) / 4 / df + (5 * pow({z}, 5) + 16 * pow({z}, 3) + 3 * {z}) / 96 / pow(df, 2)
    + (3 * pow({z}, 7) + 19 * pow({z}, 5) + 17 * pow({z}, 3) - 15 * {z}) / 384 / pow(df, 3))""".format(
    z=repr(normal_quantile(0.975))
)
BOUNDS = {
    **FIT1,
    "spread": """SELECT count(*) AS n, count(*) - 2 AS df, avg(finished_living_area) AS xm, var_pop(finished_living_area) * count(*) AS sxx,
        sum(pow(log10(sale_price_adj) - pred, 2)) / (count(*) - 2) AS s2 FROM scored""",
    "bounded": f"""SELECT scored.*, ({normal_quantile(0.975)!r} + {T_TERMS})
        * sqrt(s2 * (1.0 / n + pow(finished_living_area - xm, 2) / sxx)) AS half FROM scored, spread""",
}


@query(
    "MD1_linear_model",
    """SELECT '(Intercept)' AS term, round(a, 6) AS estimate FROM fit2 UNION ALL SELECT 'finished_living_area', round(b, 8) FROM fit2
    UNION ALL SELECT 'house_age_at_sale', round(c, 8) FROM fit2""",
    **FIT2,
)
def md1(t: Inputs):
    table = equations.fit(t.kept("par_id", "sale_price_adj", *TWO), BOTH).coefficients(t.spark).select("term", "estimate")
    digits = F.when(F.col("term") == "(Intercept)", F.round("estimate", 6)).otherwise(F.round("estimate", 8))
    return table.withColumn("estimate", digits)


@query(
    "MD1_normal_equations",
    "SELECT term, n, 0.0::DOUBLE AS product FROM (SELECT term, count(*) AS n FROM d_coded GROUP BY term UNION ALL SELECT '(Intercept)', count(*) FROM housing"
    + "".join(f" UNION ALL SELECT '{c}', count(*) FROM housing" for c in NUMBERS)
    + ")",
    **design_sql(),
)
def md1_equations(t: Inputs):
    """The whole recipe: the residuals have no product with any term (numbers from their mean, per standard deviation and row)."""
    housing = t.kept()
    fitted = equations.fit(housing, ds.sales_recipe())
    left = models.residuals(fitted.predict(housing)).select("par_id", "resid")
    entries = coded_rows(ds.prepared(housing, fitted.recipe), fitted.design)
    entries = entries.unionByName(housing.select("par_id", F.lit("(Intercept)").alias("term"), F.lit(1.0).alias("value")))
    sums = entries.join(left, "par_id").groupBy("term").agg(
        F.count(F.lit(1)).alias("n"), F.abs(F.coalesce(F.covar_pop("resid", "value") / F.greatest(F.stddev_pop("value"), F.lit(1.0)), F.lit(0.0))).alias("apart"),
        F.abs(F.avg("resid")).alias("mean"),
    )
    # Of a dummy only the rows with a 1 are entries.
    product = F.when(F.col("term").isin("(Intercept)", *NUMBERS), F.col("apart") + F.when(F.col("term") == "(Intercept)", F.col("mean")).otherwise(0.0)).otherwise(F.col("mean"))
    return rounded(sums.select("term", "n", product.alias("product")), 7, "product")


@query("MD2_random_forest")
def md2(t: Inputs):
    """A forest of 500 trees on all predictors."""
    housing = t.kept()
    return ensembles.fit(housing, ds.sales_recipe(), ensembles.forest()).predict(housing).select("par_id", "pred", "pred_dollar")


@query("MD3_bagged_trees")
def md3(t: Inputs):
    """Twenty-five bagged trees without a limit of depth."""
    housing = t.kept()
    return ensembles.fit(housing, ds.sales_recipe(), ensembles.bagged_trees()).predict(housing).select("par_id", "pred", "pred_dollar")


# Trees can't be written in SQL, so what must hold of every fit is checked: a prediction for each row, better than the mean.
FIT_HOLDS = "SELECT count(*) AS n, count(*) AS n_scored, true AS beats_mean FROM housing"


def fit_holds(scored: DataFrame) -> DataFrame:
    label = F.log10("sale_price_adj")
    error = F.sqrt(F.avg(F.pow(label - F.col("pred"), 2)))
    return scored.agg(
        F.count(F.lit(1)).alias("n"), F.count("pred").alias("n_scored"), (error < F.stddev_pop(label)).alias("beats_mean")
    )


@query(
    "MD1_recipe_fit_holds",
    """SELECT count(*) AS n, count(*) AS n_scored, 0.0::DOUBLE AS mean_resid, 0.0::DOUBLE AS with_area, 0.0::DOUBLE AS with_lot,
    0.0::DOUBLE AS with_age FROM housing""",
)
def md1_recipe(t: Inputs):
    """Least squares over the whole recipe: residuals have mean 0 and no product with any predictor."""
    housing = t.kept()
    scored = models.residuals(equations.fit(housing, ds.sales_recipe()).predict(housing))
    products = {"with_area": "finished_living_area", "with_lot": "lot_area", "with_age": "house_age_at_sale"}
    table = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count("pred").alias("n_scored"),
        F.abs(F.avg("resid")).alias("mean_resid"),
        *[F.abs(F.corr("resid", F.col(c).cast("double"))).alias(name) for name, c in products.items()],
    )
    return rounded(table, 6, "mean_resid", *products)


@query("MD4_recipe_folds_hold", FIT_HOLDS)
def md4_recipe(t: Inputs):
    """Out-of-fold predictions with the recipe learnt again in each of ten folds."""
    return fit_holds(equations.out_of_fold(rec.folds(t.kept(), "par_id", SEED), ds.sales_recipe()))


@query(
    "CJ9_recipe_bounds_hold",
    "SELECT count(*) AS n, count(*) AS n_ordered, count(*) AS n_resid FROM housing",
)
def cj9_recipe(t: Inputs):
    """Every sale has bounds around its prediction, with the model of the whole recipe."""
    housing = t.kept()
    scored = modelling.score_with_bounds(equations.fit(housing, ds.sales_recipe()), housing)
    ordered = (F.col("pred_lower") <= F.col("pred")) & (F.col("pred") <= F.col("pred_upper"))
    return scored.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(ordered, 1)).alias("n_ordered"), F.count("resid").alias("n_resid"))


@query("MD2_forest_holds", FIT_HOLDS)
def md2_holds(t: Inputs):
    housing = t.kept()
    return fit_holds(ensembles.fit(housing, ds.sales_recipe(), ensembles.forest()).predict(housing))


@query("MD3_bagged_holds", FIT_HOLDS)
def md3_holds(t: Inputs):
    housing = t.kept()
    return fit_holds(ensembles.fit(housing, ds.sales_recipe(), ensembles.bagged_trees()).predict(housing))


@query("MD8_tree_bounds_hold", "SELECT count(*) AS n, count(*) AS n_ordered, count(*) AS n_errors FROM housing")
def md8_holds(t: Inputs):
    housing = t.kept()
    bounded_ = ensembles.fit(housing, ds.sales_recipe(), ensembles.bagged_trees()).with_bounds(housing)
    ordered = (F.col("pred_lower") <= F.col("pred")) & (F.col("pred") <= F.col("pred_upper"))
    return bounded_.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(ordered, 1)).alias("n_ordered"), F.count(F.when(F.col("std_error") > 0, 1)).alias("n_errors")
    )


IMPORTANCE_HOLDS = """SELECT 1.0::DOUBLE AS total, CAST(0 AS BIGINT) AS n_negative, count(DISTINCT term) + {n} AS n_terms FROM d_coded""".format(n=len(NUMBERS))


def importance_holds(table: DataFrame) -> DataFrame:
    found = table.agg(
        F.sum("importance").alias("total"), F.count(F.when(F.col("importance") < 0, 1)).alias("n_negative"), F.count(F.lit(1)).alias("n_terms")
    )
    return rounded(found, 6, "total")


@query("MD13_importance_holds", IMPORTANCE_HOLDS, **design_sql())
def md13_holds(t: Inputs):
    return importance_holds(ensembles.fit(t.kept(), ds.sales_recipe(), ensembles.forest()).importance(t.spark))


@query("MD14_importance_holds", IMPORTANCE_HOLDS, **design_sql())
def md14_holds(t: Inputs):
    return importance_holds(ensembles.fit(t.kept(), ds.sales_recipe(), ensembles.bagged_trees()).importance(t.spark))


CV = {
    "folded": f"SELECT *, (row_number() OVER (ORDER BY {HASH}) - 1) % 10 + 1 AS fold FROM housing",
    "fits": """SELECT k, regr_intercept(log10(sale_price_adj), finished_living_area) AS a,
        regr_slope(log10(sale_price_adj), finished_living_area) AS b,
        regr_intercept(log10(sale_price_adj), house_age_at_sale) AS a_age, regr_slope(log10(sale_price_adj), house_age_at_sale) AS b_age
        FROM folded, range(1, 11) t(k) WHERE fold <> k GROUP BY k""",
    "held": """SELECT par_id, fold, sale_price_adj, a + b * finished_living_area AS pred,
        pow(10, a + b * finished_living_area) AS pred_dollar, pow(10, a_age + b_age * house_age_at_sale) AS age_dollar
        FROM folded JOIN fits ON fold = k""",
}


def held_out(t: Inputs, names: list[str] = AREA) -> DataFrame:
    rows = rec.folds(t.kept("par_id", "sale_price_adj", *names), "par_id", SEED)
    return equations.out_of_fold(rows, ds.Recipe(names))


@query("MD4_out_of_fold_predictions", "SELECT par_id, fold, round(pred, 5) AS pred FROM held", **CV)
def md4(t: Inputs):
    return rounded(held_out(t).select("par_id", "fold", "pred"), 5, "pred")


FOLD_METRICS = """SELECT fold, 'rmse' AS metric, sqrt(avg(pow(sale_price_adj - {p}, 2))) AS estimate FROM held GROUP BY fold
    UNION ALL SELECT fold, 'rsq', pow(corr(sale_price_adj, {p}), 2) FROM held GROUP BY fold
    UNION ALL SELECT fold, 'mae', avg(abs(sale_price_adj - {p})) FROM held GROUP BY fold"""


@query(
    "MD5_fold_metrics",
    """SELECT metric, round(avg(estimate), 2) AS mean, count(*) AS n, round(stddev_samp(estimate) / sqrt(count(*)), 2) AS std_err
    FROM m GROUP BY metric""",
    **CV,
    m=FOLD_METRICS.format(p="pred_dollar"),
)
def md5(t: Inputs):
    by_fold = ev.metrics(held_out(t), "sale_price_adj", "pred_dollar", ["fold"], ev.DEFAULT_METRICS)
    return rounded(ev.fold_summary(by_fold), 2, "mean", "std_err")


@query("MD6_predict_dollars", "SELECT par_id, round(pred, 5) AS pred, round(pred_dollar, 2) AS pred_dollar FROM scored", **FIT1)
def md6(t: Inputs):
    housing = t.kept()
    scored = models.predict(small_fit(housing), housing).select("par_id", "pred", "pred_dollar")
    return rounded(rounded(scored, 5, "pred"), 2, "pred_dollar")


GAPS = {
    "gaps": """SELECT * REPLACE (CASE WHEN par_id % 7 = 0 THEN NULL ELSE finished_living_area END AS finished_living_area) FROM housing""",
    "fit_gaps": """SELECT regr_intercept(log10(sale_price_adj), finished_living_area) AS a,
        regr_slope(log10(sale_price_adj), finished_living_area) AS b FROM gaps""",
}


def with_gaps(rows: DataFrame) -> DataFrame:
    """A seventh of the rows lacks the predictor."""
    return rows.withColumn("finished_living_area", F.when(F.col("par_id") % 7 != 0, F.col("finished_living_area")))


@query(
    "MD6_predict_every_row",
    "SELECT par_id, round(a + b * finished_living_area, 5) AS pred, round(pow(10, a + b * finished_living_area), 2) AS pred_dollar FROM gaps, fit_gaps",
    **GAPS,
)
def md6_gaps(t: Inputs):
    rows = settle(with_gaps(t.housing("par_id", "sale_price_adj", *AREA)))
    scored = models.predict(small_fit(rows), rows).select("par_id", "pred", "pred_dollar")
    return rounded(rounded(scored, 5, "pred"), 2, "pred_dollar")


LEVEL_MEANS = """SELECT par_id, round(CASE WHEN h.grade_desc IN ('Excellent', 'Very Good', 'Good') THEN m END, 5) AS pred
    FROM housing h LEFT JOIN (SELECT grade_desc, avg(log10(sale_price_adj)) AS m FROM housing
      WHERE grade_desc IN ('Excellent', 'Very Good', 'Good') GROUP BY grade_desc) g ON g.grade_desc = h.grade_desc"""


@query("MD6_unknown_levels", LEVEL_MEANS)
def md6_levels(t: Inputs):
    """A model of level means, trained on three grades only: other and missing grades get no prediction."""
    rows = t.kept("par_id", "sale_price_adj", "grade_desc")
    known = rows.where(F.col("grade_desc").isin("Excellent", "Very Good", "Good"))
    fitted = models.fit(known, models.linear(), [rec.DummyCoder(["grade_desc"], {}), rec.DesignVector([])])
    return rounded(models.predict(fitted, rows).select("par_id", "pred"), 5, "pred")


def bounded(t: Inputs) -> DataFrame:
    housing = t.kept("par_id", "sale_price_adj", *AREA)
    return modelling.score_with_bounds(equations.fit(housing, ONE), housing)


@query(
    "MD7_linear_bounds",
    """SELECT par_id, round(pred - half, 5) AS pred_lower, round(pred + half, 5) AS pred_upper,
    round(pow(10, pred - half), 2) AS pred_lower_dollar, round(pow(10, pred + half), 2) AS pred_upper_dollar FROM bounded""",
    **BOUNDS,
)
def md7(t: Inputs):
    chosen = bounded(t).select("par_id", "pred_lower", "pred_upper", "pred_lower_dollar", "pred_upper_dollar")
    return rounded(rounded(chosen, 5, "pred_lower", "pred_upper"), 2, "pred_lower_dollar", "pred_upper_dollar")


@query("MD8_tree_bounds")
def md8(t: Inputs):
    housing = t.kept()
    bounded_ = ensembles.fit(housing, ds.sales_recipe(), ensembles.bagged_trees()).with_bounds(housing)
    return bounded_.select("par_id", "pred", "pred_lower", "pred_upper", "std_error")


@query(
    "MD9_metrics",
    """SELECT 'rmse' AS metric, round(sqrt(avg(pow(sale_price_adj - pred_dollar, 2))), 2) AS estimate FROM scored
    UNION ALL SELECT 'rsq', round(pow(corr(sale_price_adj, pred_dollar), 2), 2) FROM scored
    UNION ALL SELECT 'mape', round(avg(abs((sale_price_adj - pred_dollar) / sale_price_adj)) * 100, 2) FROM scored""",
    **FIT1,
)
def md9(t: Inputs):
    housing = t.kept()
    table = ev.metrics(models.predict(small_fit(housing), housing), "sale_price_adj", "pred_dollar")
    return rounded(table, 2, "estimate")


@query(
    "MD10_metrics_per_area",
    """SELECT g.geo_id, 'rsq' AS metric, round(estimate, 6) AS estimate, n FROM (SELECT geo_id, count(*) AS n,
    pow(corr(sale_price_adj, pred_dollar), 2) AS estimate FROM pooled GROUP BY geo_id) g""",
    **FIT1,
    pooled="""SELECT sale_price_adj, pred_dollar, CASE WHEN count(*) OVER (PARTITION BY geo_id) < 500 THEN 'Other' ELSE geo_id END AS geo_id
        FROM scored""",
)
def md10(t: Inputs):
    housing = t.kept()
    table = modelling.area_rsq(models.predict(small_fit(housing), housing).drop("features"))
    return rounded(table, 6, "estimate")


@query(
    "MD10_rmse_per_area",
    """SELECT geo_id, 'rmse' AS metric, round(sqrt(avg(pow(log10(sale_price_adj) - pred, 2))), 6) AS estimate FROM scored GROUP BY geo_id""",
    **FIT1,
)
def md10_rmse(t: Inputs):
    housing = t.kept()
    return rounded(modelling.area_rmse(models.predict(small_fit(housing), housing)), 6, "estimate")


@query(
    "MD11_model_comparison",
    """SELECT model_name, fold, round(max(CASE WHEN metric = 'rmse' THEN estimate END), 2) AS rmse,
    round(max(CASE WHEN metric = 'rsq' THEN estimate END), 6) AS rsq, round(max(CASE WHEN metric = 'mae' THEN estimate END), 2) AS mae
    FROM (SELECT 'area' AS model_name, * FROM m1 UNION ALL SELECT 'age', * FROM m2) GROUP BY model_name, fold""",
    **CV,
    m1=FOLD_METRICS.format(p="pred_dollar"),
    m2=FOLD_METRICS.format(p="age_dollar"),
)
def md11(t: Inputs):
    tables = {
        name: ev.metrics(held_out(t, columns), "sale_price_adj", "pred_dollar", ["fold"], ev.DEFAULT_METRICS)
        for name, columns in (("area", AREA), ("age", ["house_age_at_sale"]))
    }
    wide = ev.compare_wide(ev.compare_models(tables))
    return rounded(rounded(wide, 2, "rmse", "mae"), 6, "rsq")


@query(
    "MD12_coefficient_table",
    """SELECT term, round(estimate, 8) AS estimate, round(se, 10) AS std_error, round(estimate / se, 3) AS statistic,
    CASE WHEN abs(estimate / se) > 6 THEN 0.0::DOUBLE END AS p_value
    FROM (SELECT '(Intercept)' AS term, a AS estimate, sqrt(s2 * (1.0 / n + xm * xm / sxx)) AS se FROM fit1, spread
      UNION ALL SELECT 'finished_living_area', b, sqrt(s2 / sxx) FROM fit1, spread)""",
    **BOUNDS,
)
def md12(t: Inputs):
    table = equations.fit(t.kept("par_id", "sale_price_adj", *AREA), ONE).coefficients(t.spark)
    shown = rounded(rounded(table, 8, "estimate"), 10, "std_error")
    return rounded(rounded(shown, 3, "statistic"), 6, "p_value")


@query(
    "MD12_weak_term",
    """SELECT round(b / se, 4) AS statistic, round(1 - 2 * area, 6) AS p_value FROM tested, (
      SELECT sum(w * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) * pow(1 + pow(x, 2) / df, -(df + 1) / 2.0)) AS area FROM steps)""",
    **{
        "fit_lot": """SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS xm, count(*) - 2 AS df, regr_sxx(y, x) AS sxx
            FROM (SELECT log10(sale_price_adj) AS y, lot_area AS x FROM housing)""",
        "tested": """SELECT any_value(b) AS b, any_value(df) AS df, sqrt(sum(pow(log10(sale_price_adj) - a - b * lot_area, 2)) / any_value(df) / any_value(sxx)) AS se
            FROM housing, fit_lot""",
        # Simpson's rule from 0 to |t|, in 2,000 steps.
        "steps": """SELECT df, abs(b / se) * k / 2000 AS x, abs(b / se) / 2000 / 3 * CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS w
            FROM tested, range(2001) r(k)""",
    },
)
def md12_weak(t: Inputs):
    """A p-value away from 0, against the integral of the density."""
    rows = t.kept("par_id", "sale_price_adj", "lot_area")
    table = equations.fit(rows, ds.Recipe(["lot_area"])).coefficients(t.spark).where("term = 'lot_area'").select("statistic", "p_value")
    return rounded(rounded(table, 4, "statistic"), 6, "p_value")


@query("MD13_importance")
def md13(t: Inputs):
    grown = ensembles.fit(t.kept(), ds.sales_recipe(), ensembles.forest())
    return ev.ranked_terms(grown.importance(t.spark), "importance", rec.Roles().nominal)


@query("MD14_importance_with_spread")
def md14(t: Inputs):
    grown = ensembles.fit(t.kept(), ds.sales_recipe(), ensembles.bagged_trees())
    return ev.ranked_terms(grown.importance(t.spark), "importance", rec.Roles().nominal)


TERMS = " UNION ALL ".join(
    f"""SELECT '{c}' AS term_type, replace({c}, ' ', '.') AS level, '{c}_' || replace({c}, ' ', '.') AS term,
    avg(log10(sale_price_adj)) AS estimate FROM housing WHERE {c} IS NOT NULL GROUP BY {c}"""
    for c in ("geo_id", "grade_desc", "heat_type")
)


def mean_terms(t: Inputs) -> DataFrame:
    """Mean log price per level, named like dummy columns."""
    housing = t.kept()
    parts = [
        housing.where(F.col(c).isNotNull())
        .groupBy(F.concat(F.lit(f"{c}_"), F.replace(F.col(c), F.lit(" "), F.lit("."))).alias("term"))
        .agg(F.avg(F.log10("sale_price_adj")).alias("estimate"))
        for c in ("geo_id", "grade_desc", "heat_type")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "MD15_term_source",
    """SELECT term, term_type, level, round(estimate, 6) AS estimate,
    row_number() OVER (PARTITION BY term_type ORDER BY estimate, term) AS position FROM terms""",
    terms=TERMS,
)
def md15(t: Inputs):
    ranked = ev.ranked_terms(mean_terms(t), "estimate", ["geo_id", "grade_desc", "heat_type"])
    return rounded(ranked, 6, "estimate")


@query(
    "MD16_residuals",
    """SELECT par_id, round(log10(sale_price_adj) - pred, 5) AS resid, round(sale_price_adj - pred_dollar, 2) AS resid_dollar FROM scored""",
    **FIT1,
)
def md16(t: Inputs):
    housing = t.kept()
    table = models.residuals(models.predict(small_fit(housing), housing)).select("par_id", "resid", "resid_dollar")
    return rounded(rounded(table, 5, "resid"), 2, "resid_dollar")


@query(
    "MD17_interval_width",
    """SELECT par_id, round(pow(10, pred + half) - pow(10, pred - half), 2) AS prediction_range,
    round((pow(10, pred + half) - pow(10, pred - half)) / pred_dollar, 6) AS prediction_range_pct FROM bounded""",
    **BOUNDS,
)
def md17(t: Inputs):
    table = ev.interval_width(bounded(t)).select("par_id", "prediction_range", "prediction_range_pct")
    return rounded(rounded(table, 2, "prediction_range"), 6, "prediction_range_pct")


@query(
    "MD18_contributions",
    """SELECT par_id, 'finished_living_area' AS term, finished_living_area AS value, round(finished_living_area * b, 6) AS effect,
    round(pow(10, a) * finished_living_area * b, 3) AS effect_dollar, round(pow(10, finished_living_area * b), 6) AS multiplier
    FROM housing, fit2 UNION ALL SELECT par_id, 'house_age_at_sale', CAST(house_age_at_sale AS DOUBLE),
    round(house_age_at_sale * c, 6), round(pow(10, a) * house_age_at_sale * c, 3), round(pow(10, house_age_at_sale * c), 6)
    FROM housing, fit2""",
    **FIT2,
)
def md18(t: Inputs):
    housing = t.kept("par_id", "sale_price_adj", *TWO)
    fitted = small_fit(housing, TWO)
    table = ev.coefficient_table(t.spark, fitted, names=TWO)
    effects = ev.contributions(models.predict(fitted, housing), table, TWO, "par_id").drop("estimate")
    return rounded(rounded(effects, 6, "effect", "multiplier"), 3, "effect_dollar")


@query(
    "MD18_rebuilt_price",
    """SELECT par_id, round(finished_living_area * b + house_age_at_sale * c, 6) AS effect,
    round(pow(10, a) * (finished_living_area * b + house_age_at_sale * c), 3) AS effect_dollar,
    round(pow(10, a + finished_living_area * b + house_age_at_sale * c), 3) AS price FROM housing, fit2""",
    **FIT2,
)
def md18_price(t: Inputs):
    housing = t.kept("par_id", "sale_price_adj", *TWO)
    fitted = small_fit(housing, TWO)
    table = settle(ev.coefficient_table(t.spark, fitted, names=TWO))
    effects = ev.contributions(models.predict(fitted, housing), table, TWO, "par_id")
    return rounded(rounded(ev.rebuilt_price(effects, table, "par_id"), 6, "effect"), 3, "effect_dollar", "price")


@query(
    "MD19_median_residual",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, round(quantile_cont(log10(sale_price_adj) - pred, 0.5), 6) AS median,
        count(*) AS n FROM scored GROUP BY {c}"""
        for c in ("geo_id", "style_desc", "grade_desc", "condition_desc", "bedrooms")
    ),
    **FIT1,
)
def md19(t: Inputs):
    columns = ["geo_id", "style_desc", "grade_desc", "condition_desc", "bedrooms"]
    housing = t.kept("par_id", "sale_price_adj", *AREA, *columns)
    scored = settle(models.residuals(models.predict(small_fit(housing), housing)).select("resid", *columns))
    rows = longer(scored, ["resid"], columns, "feature", "value", "string")
    table = box_summary(rows, ["feature", "value"], "resid").select("feature", "value", "median", "n")
    return rounded(table, 6, "median")


@query(
    "MD20_odd_inputs",
    """SELECT 'no_bedrooms' AS "check", count(*) AS n_bad FROM sales WHERE bedrooms IS NULL
    UNION ALL SELECT 'no_condition', count(*) FROM sales WHERE condition_desc IS NULL
    UNION ALL SELECT 'no_price', count(*) FROM sales WHERE sale_price IS NULL OR sale_price <= 100
    UNION ALL SELECT 'old_house', count(*) FROM sales WHERE sale_year - year_blt > 90""",
)
def md20(t: Inputs):
    return ev.odd_inputs(
        t.sales(),
        {
            "no_bedrooms": F.col("bedrooms").isNull(),
            "no_condition": F.col("condition_desc").isNull(),
            "no_price": F.col("sale_price").isNull() | (F.col("sale_price") <= 100),
            "old_house": F.col("sale_year") - F.col("year_blt") > 90,
        },
    )


@query(
    "MD21_readable_effects",
    "SELECT replace(level, '.', ' ') AS level, round(estimate, 6) AS estimate FROM terms WHERE term_type = 'grade_desc'",
    terms=TERMS,
)
def md21(t: Inputs):
    return rounded(ev.readable_effects(mean_terms(t), "grade_desc"), 6, "estimate")


@query(
    "MD19_area_residual_map",
    """SELECT geo_id, round(quantile_cont(log10(sale_price_adj) - pred, 0.5), 6) AS median FROM scored GROUP BY geo_id""",
    **FIT1,
)
def md19_map(t: Inputs):
    housing = t.kept()
    scored = models.residuals(models.predict(small_fit(housing), housing)).drop("features")
    return rounded(median(scored, ["geo_id"], "resid"), 6, "median")
