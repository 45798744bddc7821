from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from parcelmill.operators import evaluation as ev
from parcelmill.operators import models
from parcelmill.operators import recipe as rec
from parcelmill.plans import modelling, serving
from parcelmill.sources.tables import load_model, save_model
from parcelmill.streaming.requests import request_stream, score_stream
from sales_table import sales_frame


@pytest.fixture(scope="module")
def sales(spark):
    return sales_frame(spark).checkpoint()


def test_splits_and_folds_partition_the_rows(sales):
    for strata in (None, "sale_price_adj"):
        labelled = rec.split(sales, "par_id", 1, strata=strata)
        counts = {r["split"]: r["count"] for r in labelled.groupBy("split").count().collect()}
        assert sum(counts.values()) == 1500 and abs(counts["train"] - 1125) <= 4
    sizes = [r["count"] for r in rec.folds(sales, "par_id", 1).groupBy("fold").count().collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 1 and sum(sizes) == 1500


def test_recipe_learns_from_its_rows_only(spark, sales):
    stages = rec.recipe_stages(area_rows=100)
    fitted = Pipeline(stages=stages).fit(sales)
    strange = sales.limit(5).withColumns(
        {"geo_id": F.lit("Unseen"), "style_desc": F.lit("LOG"), "condition_desc": F.lit(None).cast("string"),
         "heat_type": F.lit(None).cast("string"), "bedrooms": F.lit(None).cast("double")}
    )
    baked = fitted.transform(strange).collect()
    assert {(r["geo_id"], r["style_desc"], r["heat_type"]) for r in baked} == {("school_other", "style_other", "Missing")}
    assert all(r["bedrooms"] is not None and r["condition_desc"] is not None for r in baked)
    names = rec.feature_names(fitted.stages)
    width = fitted.transform(sales).select(F.size(vector_to_array("features"))).first()[0]
    assert width == len(names)
    assert "grade_desc_Very.Good.or.better" in names and "grade_desc_Average" not in names
    assert "ac_flag_FALSE" in names and "ac_flag_TRUE" not in names


def test_dummies_add_up(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("c d",), (None,)], "k string")
    coded = rec.DummyCoder(["k"], {"k": "b"}).fit(rows).transform(rows).collect()
    assert [(r["k_a"], r["k_c.d"]) for r in coded] == [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (None, None)]


def test_modes_and_pooling(spark):
    rows = spark.createDataFrame([("x", "b"), ("x", "a"), ("y", "b"), ("y", "b"), ("y", None)], "g string, v string")
    assert rec.modes(rows, ["v"]).first()["mode"] == "b"
    assert {r["g"]: r["mode"] for r in rec.group_modes(rows, ["g"], "v").collect()} == {"x": "a", "y": "b"}
    kept = rec.kept_levels(rows, {"v": 0.5, "g": 3})
    assert {(r["name"], r["level"]) for r in kept.collect()} == {("v", "b"), ("g", "y")}


@pytest.fixture(scope="module")
def linear_fit(sales):
    return models.fit(sales, models.linear(), rec.recipe_stages(area_rows=100))


def test_linear_model_equals_closed_form(spark, sales, linear_fit):
    baked = linear_fit.transform(rec.with_label(sales))
    names = rec.feature_names(linear_fit.stages)
    rows = baked.select("label", vector_to_array("features").alias("x")).toPandas()
    x = np.column_stack([np.ones(len(rows)), np.array(rows["x"].to_list())])
    beta, *_ = np.linalg.lstsq(x, rows["label"].to_numpy(), rcond=None)
    table = {r["term"]: r for r in ev.coefficient_table(spark, linear_fit).collect()}
    np.testing.assert_allclose([table[n]["estimate"] for n in ["(Intercept)", *names]], beta, rtol=1e-5, atol=1e-8)
    fitted = models.least_squares(baked, names=names)
    np.testing.assert_allclose(fitted.coefficients, beta, rtol=1e-6, atol=1e-9)
    np.testing.assert_allclose(
        fitted.std_errors, [table[n]["std_error"] for n in ["(Intercept)", *names]], rtol=1e-5
    )
    bounded = models.with_bounds(models.predict(linear_fit, sales), fitted).toPandas()
    inverse = np.linalg.inv(x.T @ x) * fitted.sigma2
    half = 1.9616 * np.sqrt(np.einsum("ij,jk,ik->i", x, inverse, x))
    np.testing.assert_allclose(bounded["pred_upper"] - bounded["pred"], half, rtol=1e-3)


def test_contributions_add_up_to_the_prediction(spark, sales, linear_fit):
    scored = models.predict(linear_fit, sales)
    table = ev.coefficient_table(spark, linear_fit)
    names = rec.feature_names(linear_fit.stages)
    effects = ev.contributions(scored, table, names, "par_id")
    base = {r["term"]: r["estimate"] for r in table.collect()}["(Intercept)"]
    sums = effects.groupBy("par_id").agg(F.sum("effect").alias("e"))
    gap = scored.join(sums, "par_id").agg(F.max(F.abs(F.col("pred") - F.col("e") - base))).first()[0]
    assert gap < 1e-8


def test_saved_models_predict_the_same(spark, sales, linear_fit, tmp_path):
    save_model(linear_fit, str(tmp_path / "m"))
    again = load_model(str(tmp_path / "m"))
    a = linear_fit.transform(sales).select("par_id", "pred")
    b = again.transform(sales).select("par_id", F.col("pred").alias("pred2"))
    assert a.join(b, "par_id").where("pred <> pred2").count() == 0


def test_out_of_fold_rows_appear_once(sales):
    rows = rec.folds(sales, "par_id", 3, v=3)
    held = models.resample(rows, models.linear, v=3, stages=lambda: rec.recipe_stages(area_rows=100))
    assert held.count() == 1500 and held.select("par_id").distinct().count() == 1500
    table = {r["metric"]: r for r in ev.fold_summary(ev.metrics(held, "sale_price_adj", "pred_dollar", ["fold"])).collect()}
    assert table["rsq"]["mean"] > 0.5 and table["rsq"]["n"] == 3


def test_tree_models(spark, sales):
    fitted = models.fit(sales, models.bagged_trees(trees=5, depth=5), rec.recipe_stages(area_rows=100))
    scored = models.predict(fitted, sales)
    assert {r["metric"]: r["estimate"] for r in ev.metrics(scored, "sale_price_adj", "pred_dollar").collect()}["rsq"] > 0.4
    bounds = models.tree_bounds(fitted, sales)
    assert bounds.where("pred_lower > pred OR pred_upper < pred").count() == 0
    pairs = bounds.select("par_id", F.col("pred").alias("mean")).join(scored.select("par_id", "pred"), "par_id")
    assert pairs.where("abs(mean - pred) > 1e-9").count() == 0
    spread = ev.tree_importance_table(spark, fitted).toPandas()
    total = ev.importance_table(spark, fitted).toPandas()
    assert abs(total["importance"].sum() - 1) < 1e-6 and spread["used"].max() == 5
    assert spread.sort_values("value").iloc[-1]["term"] == "finished_living_area"


def test_metrics_of_constants(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "t double, e double")
    table = {r["metric"]: r["estimate"] for r in ev.metrics(rows, "t", "e").collect()}
    assert table["rsq"] is None and table["mape"] == 150.0


def test_area_rsq_pools_small_areas(sales, linear_fit):
    table = modelling.area_rsq(models.predict(linear_fit, sales).drop("features"), 100).toPandas()
    assert table["n"].sum() == 1500 and "school_other" in set(table["geo_id"]) | {"school_other"}


def test_serving_reduces_sales_before_requests(spark, sales, linear_fit):
    first = sales.where("par_id IN ('P00000', 'P00004', 'P00003')").withColumn("request_id", F.col("par_id"))
    scored = serving.score_requests(linear_fit, first)
    assert scored.count() == 3 and scored.first()["price_text"].startswith("$")
    found = serving.comparable_sales(sales, first)
    expected = first.select("request_id", "geo_id", "style_desc").join(sales, ["geo_id", "style_desc"]).count()
    assert found.count() == expected
    bins = serving.price_histogram(sales, first, scored)
    per_request = {r["request_id"]: r["n"] for r in bins.groupBy("request_id").agg(F.sum("n").alias("n")).collect()}
    assert per_request == {r["request_id"]: r["count"] for r in found.groupBy("request_id").count().collect()}
    text = serving.request_text(first.withColumn("pred_dollar", F.lit(123456.7))).first()["summary"]
    assert text.splitlines()[0].startswith("Area: ") and text.splitlines()[-1] == "Predicted price: $123,457"
    assert len(text.splitlines()) == len(serving.SUMMARY_LINES)


def test_stream_scores_what_arrives(spark, sales, linear_fit, tmp_path):
    arrived = str(tmp_path / "requests")
    sales.limit(20).withColumnRenamed("par_id", "request_id").write.parquet(arrived)
    stream = request_stream(spark, arrived, spark.read.parquet(arrived).schema)
    running = score_stream(linear_fit, stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert running.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def gappy(spark, n=300):
    """Rows of which some lack a number, some a category, and some hold a level that training never saw."""
    rows = []
    for k in range(n):
        size = None if k % 15 == 0 else 50.0 + k % 40
        grade = None if k % 10 == 3 else ("rare" if k == n - 1 else f"g{k % 3}")
        rows.append((k, 10.0 ** (2 + (size or 60) / 100 + (k % 3) / 10), size, grade))
    return spark.createDataFrame(rows, "par_id long, sale_price_adj double, size double, grade string")


@pytest.mark.parametrize("make", [models.linear, lambda: models.bagged_trees(trees=3, depth=4)])
def test_every_row_is_scored_or_marked_missing(spark, make):
    rows = gappy(spark)
    stages = [rec.DummyCoder(["grade"], {}), rec.DesignVector(["size"])]
    fitted = models.fit(rows.where("grade != 'rare' or grade is null"), make(), stages)
    scored = models.predict(fitted, rows).collect()
    assert len(scored) == 300
    for r in scored:
        lacks = r["size"] is None or r["grade"] in (None, "rare")
        assert (r["pred"] is None) == lacks and (r["pred_dollar"] is None) == lacks and (r["features"] is None) == lacks


def test_bounds_of_rows_with_gaps(spark):
    rows = gappy(spark)
    fitted = models.fit(rows, models.linear(), [rec.DummyCoder(["grade"], {}), rec.DesignVector(["size"])])
    prepared = models.predict(fitted, rows)
    closed = models.least_squares(prepared.withColumn("label", F.log10("sale_price_adj")))
    bounded = models.with_bounds(prepared, closed).collect()
    assert len(bounded) == 300
    assert all((r["pred"] is None) == (r["pred_lower"] is None) == (r["pred_upper_dollar"] is None) for r in bounded)
    trees = models.fit(rows, models.bagged_trees(trees=3, depth=4), [rec.DummyCoder(["grade"], {}), rec.DesignVector(["size"])])
    of_trees = models.tree_bounds(trees, rows).collect()
    assert len(of_trees) == 300 and sum(r["pred_lower"] is None for r in of_trees) == sum(r["pred"] is None for r in of_trees) > 0


def test_many_levels_have_no_cap(spark):
    rows = spark.range(9000).select(
        F.concat(F.lit("l"), (F.col("id") % 4500).cast("string")).alias("c"), F.lit(10.0).alias("sale_price_adj")
    )
    assert len(rec.DummyCoder(["c"], {}).fit(rows)._value("levels")["c"]) == 4500


def test_the_most_frequent_level_stays_when_all_are_rare(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "c string")
    pooled = rec.RareLevels({"c": 100}, {"c": "other"}).fit(rows).transform(rows)
    assert sorted(str(r["c"]) for r in pooled.collect()) == ["None", "b", "b", "other", "other"]
