"""Least squares from sums of products: against refits by the built-in solver and plain numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelmill.functions.numeric import student_two_sided
from parcelmill.operators import design as ds
from parcelmill.operators import models
from parcelmill.operators import normal_equations as ne
from parcelmill.operators import recipe as rec
from sales_table import sales_frame


@pytest.fixture(scope="module")
def sales(spark):
    return sales_frame(spark).withColumn("fold", F.pmod(F.xxhash64("par_id"), F.lit(3)) + 1).checkpoint()


RECIPE = ds.sales_recipe(area_rows=100)


def test_fit_equals_the_built_in_solver(spark, sales):
    fitted = ne.fit(sales, RECIPE)
    other = models.fit(sales, models.linear(), rec.recipe_stages(area_rows=100))
    names = rec.feature_names(other.stages)
    table = {r["term"]: r for r in fitted.coefficients(spark).collect()}
    assert list(table) == ["(Intercept)", *names]
    last = other.stages[-1]
    np.testing.assert_allclose([table[n]["estimate"] for n in names], last.coefficients.toArray(), rtol=1e-6, atol=1e-10)
    for column, values in (("std_error", last.summary.coefficientStandardErrors), ("statistic", last.summary.tValues), ("p_value", last.summary.pValues)):
        np.testing.assert_allclose([table[n][column] for n in [*names, "(Intercept)"]], values, rtol=1e-5, atol=1e-9)
    a = fitted.predict(sales).select("par_id", "pred", "pred_dollar")
    b = models.predict(other, sales).select("par_id", F.col("pred").alias("other"))
    assert a.join(b, "par_id").where("abs(pred - other) < 1e-8").count() == 1500


def test_bounds_equal_the_dense_form(sales):
    fitted = ne.fit(sales, RECIPE)
    other = models.fit(sales, models.linear(), rec.recipe_stages(area_rows=100))
    closed = models.least_squares(other.transform(rec.with_label(sales)))
    a = fitted.with_bounds(sales).select("par_id", "pred_lower", "pred_upper_dollar")
    b = models.with_bounds(models.predict(other, sales), closed).select("par_id", F.col("pred_lower").alias("low"), F.col("pred_upper_dollar").alias("high"))
    assert a.join(b, "par_id").where("abs(pred_lower - low) < 1e-7 and abs(pred_upper_dollar / high - 1) < 1e-6").count() == 1500


def test_folds_equal_refits(spark, sales):
    fitted = ne.fit(sales, RECIPE, fold="fold", v=3)
    for k in (1, 2, 3):
        other = models.fit(sales.where(F.col("fold") != k), models.linear(), rec.recipe_stages(area_rows=100))
        assert fitted.models[k].names == ["(Intercept)", *rec.feature_names(other.stages)]
        last = other.stages[-1]
        np.testing.assert_allclose(fitted.models[k].coefficients, [last.intercept, *last.coefficients], rtol=1e-6, atol=1e-9)
    held = ne.out_of_fold(sales, RECIPE, v=3).select("par_id", "pred")
    refits = models.resample(sales, models.linear, v=3, stages=lambda: rec.recipe_stages(area_rows=100)).select("par_id", F.col("pred").alias("other"))
    assert held.join(refits, "par_id").where("abs(pred - other) < 1e-8").count() == 1500


def small(spark):
    rows = [
        (1, 100.0, 1.0, "a", "u", 1), (2, 200.0, 2.0, "a", None, 2), (3, 150.0, None, "b", "v", 1), (4, 400.0, 4.5, "b", "v", 2), (5, 90.0, 0.5, None, "u", 1),
        (6, 500.0, 3.0, "c", "u", 2), (7, -1.0, 9.0, "a", "u", 1), (8, None, 9.0, "z", "u", 2), (9, 130.0, 1.5, "a", "v", 1), (10, 310.0, 2.5, "b", "u", 2),
    ]
    return spark.createDataFrame(rows, "par_id long, sale_price_adj double, `size.m` double, kind string, use string, fold long")


def test_missing_and_unknown_values(spark):
    rows = small(spark)
    recipe = ds.Recipe(["size.m"], ["size.m"], [ds.Category("kind", least=2, other="rest"), ds.Category("use", impute=True)])
    fitted = ne.fit(rows, recipe)
    assert fitted.model.names == ["(Intercept)", "size.m", "kind_b", "kind_rest", "use_v"]
    new = rows.unionByName(spark.createDataFrame([(11, None, None, "never", "u", 1), (12, None, 1.0, "a", "never", 1)], rows.schema))
    scored = {r["par_id"]: r["pred"] for r in fitted.predict(new).collect()}
    assert len(scored) == 12 and scored[5] is None and scored[12] is None and scored[11] is not None and scored[8] is not None
    # Median of all rows with a price: 2.25; "use" becomes the most frequent value.
    x, y = [], []
    for r in rows.where("sale_price_adj > 0 and kind is not null").collect():
        kind, use = r["kind"], r["use"] or "u"
        x.append([1, r["size.m"] or 2.0, kind == "b", kind == "c", use == "v"])
        y.append(math.log10(r["sale_price_adj"]))
    beta = np.linalg.lstsq(np.array(x, dtype=float), np.array(y), rcond=None)[0]
    np.testing.assert_allclose(fitted.model.coefficients, beta, atol=1e-10)


def test_collinear_terms_are_named_and_unused(spark):
    rows = small(spark).withColumn("twice", 2 * F.col("`size.m`")).withColumn("same", F.col("kind"))
    recipe = ds.Recipe(["size.m", "twice"], ["size.m", "twice"], [ds.Category("kind", impute=True), ds.Category("same", impute=True)])
    fitted = ne.fit(rows, recipe)
    assert fitted.model.collinear == ["twice", "same_b", "same_c"]
    plain = ne.fit(rows, ds.Recipe(["size.m"], ["size.m"], [ds.Category("kind", impute=True)]))
    a, b = ({r["par_id"]: r["pred"] for r in f.predict(rows).collect()} for f in (fitted, plain))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 if b[k] is not None else a[k] is None for k in a)
    table = {r["term"]: r for r in fitted.coefficients(spark).collect()}
    assert table["twice"]["estimate"] is None and table["twice"]["p_value"] is None and table["size.m"]["p_value"] is not None


def test_nothing_to_learn_from(spark):
    rows = small(spark)
    fitted = ne.fit(rows.where("par_id > 100"), ds.Recipe(["size.m"], [], [ds.Category("kind")]))
    assert fitted.model.n == 0 and {r["pred"] for r in fitted.predict(rows).collect()} == {None}
    one_fold = ne.out_of_fold(rows.where("fold = 1"), ds.Recipe(["size.m"]), v=2)
    assert one_fold.count() == 5


def test_five_thousand_levels(spark):
    n, levels = 40_000, 5_000
    rows = spark.range(n).select(
        F.col("id").alias("par_id"), F.format_string("l%05d", F.col("id") % levels).alias("area"), (F.col("id") % 7).cast("string").alias("kind"), (F.col("id") * 37 % 101 / 10.0).alias("x")
    )
    price = F.pow(F.lit(10.0), 2 + F.col("x") / 10 + F.substring("area", 2, 5).cast("double") / 5000 + F.when(F.col("kind") == "3", 0.5).otherwise(0.0))
    rows = rows.withColumn("sale_price_adj", price).checkpoint()
    fitted = ne.fit(rows, ds.Recipe(["x"], [], [ds.Category("area"), ds.Category("kind")]))
    m = fitted.model
    assert len(m.names) == 2 + 4_999 + 6 and not m.collinear
    by_name = dict(zip(m.names, m.coefficients, strict=True))
    assert abs(by_name["x"] - 0.1) < 1e-8 and abs(by_name["kind_X3"] - 0.5) < 1e-8 and abs(by_name["area_l02500"] - 0.5) < 1e-8
    gap = fitted.predict(rows).agg(F.max(F.abs(F.col("pred") - F.log10("sale_price_adj")))).first()[0]
    assert gap < 1e-8
    bounded = fitted.with_bounds(rows.limit(50))
    assert bounded.where("pred_lower <= pred and pred <= pred_upper").count() == 50


def test_a_hundred_thousand_levels_are_numbered(spark):
    rows = spark.range(200_000).select(F.col("id").alias("par_id"), F.format_string("l%06d", F.col("id") % 100_000).alias("c"), F.lit("k").alias("d"))
    ready = ds.prepared(rows, recipe := ds.Recipe([], [], [ds.Category("c", reference="l000007"), ds.Category("d")]))
    learnt = ds.learn(ready, recipe)
    assert learnt.levels.where("name = 'c'").agg(F.count("*"), F.max("position"), F.max("term"), F.sum("n")).first() == (100_000, 100_000, 99_999, 200_000)
    coded = ds.encode(ready, learnt)
    first = {r["c"]: (r["terms"], r["weights"]) for r in coded.where("c in ('l000000', 'l000007', 'l099999')").collect()}
    assert first == {"l000000": ([1], [1.0]), "l000007": ([], []), "l099999": ([99_999], [1.0])}
    assert coded.where("size(terms) = 1").count() == 199_998


def test_encoded_rows_equal_the_design_vector(spark, sales):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    fitted = Pipeline(stages=rec.recipe_stages(area_rows=100)).fit(sales)
    ready = ds.prepared(sales, RECIPE)
    coded = ds.encode(ready, ds.learn(ready, RECIPE)).select("par_id", "terms", "weights")
    both = coded.join(fitted.transform(sales).select("par_id", vector_to_array("features").alias("x")), "par_id").collect()
    assert len(both) == 1500
    for r in both:
        dense = np.zeros(len(r["x"]))
        dense[np.array(r["terms"]) - 1] = r["weights"]
        np.testing.assert_allclose(dense, r["x"])


def test_cholesky_leaves_out_what_is_determined():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 6))
    x[:, 3] = x[:, 0] - x[:, 2]
    x /= np.sqrt((x**2).sum(axis=0))
    kept, lower = ne.cholesky(x.T @ x)
    assert kept.tolist() == [0, 1, 2, 4, 5]
    np.testing.assert_allclose(lower @ lower.T, (x.T @ x)[np.ix_(kept, kept)], atol=1e-12)


@pytest.mark.parametrize("df", [1, 2, 7, 30, 1000, 1e6])
@pytest.mark.parametrize("t", [0.0, 0.3, -1.0, 2.5, 6.0])
def test_two_sided_tail(t, df):
    x = np.linspace(0, abs(t), 20_001)
    density = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - (df + 1) / 2 * np.log1p(x * x / df)) / math.sqrt(df * math.pi)
    assert student_two_sided(t, df) == pytest.approx(1 - 2 * np.trapezoid(density, x), abs=1e-8)


def test_predictions_make_no_design_rows(sales):
    """Scoring adds numbers and effects in the row; tables of few levels are broadcast, so rows aren't shuffled by them."""
    fitted = ne.fit(sales, RECIPE)
    plan = fitted.predict(sales)._jdf.queryExecution()
    assert "lambda" not in plan.optimizedPlan().toString()
    assert "SortMergeJoin" not in plan.executedPlan().toString() and "Exchange hashpartitioning" not in plan.executedPlan().toString()


def test_pairs_of_levels_are_counted_without_functions_on_arrays(sales, monkeypatch):
    plans, real = [], ne.settle
    monkeypatch.setattr(ne, "settle", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    rows = ds.prepared(sales.withColumn("__y", F.log10("sale_price_adj")), RECIPE)
    origin = [0.0] * (len(RECIPE.numeric) + 1)
    table = ne.settle(ne.cells(rows, RECIPE, origin)).toPandas().set_index(["a", "b"])["value"]
    assert len(plans) == 2 and not any("lambda" in p for p in plans)
    # A plain count of two levels, of a level with a gap, and of the numbers in rows of a level.
    first, second = RECIPE.categories[0].column, RECIPE.categories[1].column
    one = sales.withColumns({"a": F.xxhash64(F.lit(first), first), "b": F.xxhash64(F.lit(second), second), "g": F.when(F.col("bedrooms").isNull(), F.xxhash64(F.lit("bedrooms")))})
    for x, y in (("a", "b"), ("a", "g")):
        for r in one.where(f"{y} is not null").groupBy(x, y).agg(F.count(F.lit(1)).alias("n")).collect():
            assert table[(r[0], r[1])] == table[(r[1], r[0])] == r["n"]
    gaps = one.where("g is not null").agg(F.first("g").alias("g"), F.count("g").alias("n"), F.sum("sale_year").alias("s")).first()
    year = 1 + list(RECIPE.numeric).index("sale_year")
    assert gaps["n"] > 0 and table[(gaps["g"], gaps["g"])] == gaps["n"] and table[(year, gaps["g"])] == gaps["s"]
