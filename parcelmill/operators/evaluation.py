"""Metrics, residual summaries, coefficients, importances and contributions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmill.functions.numeric import from_log10, ratio
from parcelmill.functions.text import readable_term
from parcelmill.operators.recipe import feature_names
from parcelmill.operators.relational import bind_labelled, longer, wider
from parcelmill.operators.windows import rank_within
from parcelmill.runtime import settle

Metric = Callable[[Column, Column], Column]


def rmse(truth: Column, estimate: Column) -> Column:
    return F.sqrt(F.avg((truth - estimate) * (truth - estimate)))


def rsq(truth: Column, estimate: Column) -> Column:
    """Squared correlation; NULL when either side is constant."""
    both = truth.isNotNull() & estimate.isNotNull()
    t, e = F.when(both, truth), F.when(both, estimate)
    share = F.try_divide(F.covar_pop(t, e), F.stddev_pop(t) * F.stddev_pop(e))
    return share * share


def mape(truth: Column, estimate: Column) -> Column:
    return F.avg(F.abs(F.try_divide(truth - estimate, truth))) * 100


def mae(truth: Column, estimate: Column) -> Column:
    return F.avg(F.abs(truth - estimate))


DOLLAR_METRICS: dict[str, Metric] = {"rmse": rmse, "rsq": rsq, "mape": mape}
DEFAULT_METRICS: dict[str, Metric] = {"rmse": rmse, "rsq": rsq, "mae": mae}


def metrics(
    df: DataFrame,
    truth: str,
    estimate: str,
    keys: Sequence[str] = (),
    bundle: dict[str, Metric] | None = None,
) -> DataFrame:
    """One row per (group, metric); all metrics of a bundle in one pass."""
    bundle = bundle or DOLLAR_METRICS
    wide = df.groupBy(*keys).agg(*[m(F.col(truth), F.col(estimate)).alias(n) for n, m in bundle.items()])
    return longer(wide, keys, list(bundle), "metric", "estimate")


def fold_summary(by_fold: DataFrame, keys: Sequence[str] = ("metric",)) -> DataFrame:
    """Mean, number of folds and standard error of a metric over the folds."""
    return by_fold.groupBy(*keys).agg(
        F.avg("estimate").alias("mean"),
        F.count("estimate").alias("n"),
        (F.stddev_samp("estimate") / F.sqrt(F.count("estimate"))).alias("std_err"),
    )


def compare_models(tables: dict[str, DataFrame], dataset: str = "train") -> DataFrame:
    """Fold metrics of several models, labelled."""
    labelled = bind_labelled(tables, "model_name")
    return labelled.withColumn("dataset", F.lit(dataset))


def compare_wide(long: DataFrame, bundle: Sequence[str] = tuple(DEFAULT_METRICS)) -> DataFrame:
    return wider(long, ["model_name", "fold"], "metric", "estimate", bundle)


def interval_width(df: DataFrame) -> DataFrame:
    """Width of the dollar interval, alone and relative to the prediction."""
    width = F.col("pred_upper_dollar") - F.col("pred_lower_dollar")
    return df.withColumns(
        {"prediction_range": width, "prediction_range_pct": ratio(width, F.col("pred_dollar"))}
    )


# --- inside a model ----------------------------------------------------------


def coefficient_table(spark: SparkSession, model: PipelineModel, names: Sequence[str] | None = None) -> DataFrame:
    """term, estimate, std_error, statistic, p_value of a freshly fitted linear model."""
    last = model.stages[-1]
    names = [*(names or feature_names(model.stages)), "(Intercept)"]
    summary = last.summary
    estimates = [*last.coefficients.toArray().tolist(), last.intercept]
    rows = zip(names, estimates, summary.coefficientStandardErrors, summary.tValues, summary.pValues)
    return spark.createDataFrame(
        [(n, *map(float, rest)) for n, *rest in rows],
        "term string, estimate double, std_error double, statistic double, p_value double",
    )


def importance_table(spark: SparkSession, model: PipelineModel, names: Sequence[str] | None = None) -> DataFrame:
    """term and importance (they add up to one)."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    names = names or feature_names(model.stages)
    return spark.createDataFrame(list(zip(names, values)), "term string, importance double")


def tree_importance_table(spark: SparkSession, model: PipelineModel, names: Sequence[str] | None = None) -> DataFrame:
    """Importance with its spread over trees: value, standard error, trees that used the term."""
    names = names or feature_names(model.stages)
    per_tree = [t.featureImportances.toArray() for t in model.stages[-1].trees]
    rows = []
    for k, name in enumerate(names):
        values = [float(tree[k]) for tree in per_tree]
        mean = sum(values) / len(values)
        square = sum((v - mean) ** 2 for v in values) / max(len(values) - 1, 1)
        rows.append((name, mean, math.sqrt(square / len(values)), sum(v > 0 for v in values)))
    return spark.createDataFrame(rows, "term string, value double, std_error double, used long")


def term_source(terms: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Column a term comes from, and the level left when the column name is taken off."""
    kind: Column = F.lit("other")
    for name in reversed(list(sources)):
        kind = F.when(F.col("term").startswith(f"{name}_"), F.lit(name)).otherwise(kind)
    marked = terms.withColumn("term_type", kind)
    cut = F.expr("substring(term, length(term_type) + 2)")
    level = F.when(F.col("term_type") == "other", F.col("term")).otherwise(cut)
    return marked.withColumn("level", level)


def ranked_terms(terms: DataFrame, value: str, sources: Sequence[str]) -> DataFrame:
    """Terms with their source column and their position by value within it."""
    return rank_within(term_source(terms, sources), ["term_type"], F.asc(value), F.asc("term"))


def readable_effects(coefficients: DataFrame, prefix: str) -> DataFrame:
    """Level names behind the coefficients of one column."""
    own = coefficients.where(F.col("term").startswith(f"{prefix}_"))
    return own.select(readable_term(F.col("term"), prefix).alias("level"), "estimate")


def contributions(
    scored: DataFrame, coefficients: DataFrame, names: Sequence[str], row_id: str, features: str = "features"
) -> DataFrame:
    """Effect of every term on every row's prediction.

    ``effect`` is value * estimate on the log scale. ``effect_dollar`` is the
    intercept in dollars times the effect; ``multiplier`` is the exact factor
    10^effect. The effects of a row and the intercept add up to its prediction.
    """
    coefficients = settle(coefficients)
    base = coefficients.where(F.col("term") == "(Intercept)").agg(F.max("estimate").alias("b")).scalar()
    # One model's coefficients: as many entries as the model has terms.
    found = {r["term"]: r["estimate"] for r in coefficients.where(F.col("term").isin(*names)).collect()}
    weights = F.array(*[F.struct(F.lit(n).alias("term"), F.lit(found[n]).alias("estimate")) for n in names])
    paired = F.arrays_zip(weights.alias("w"), vector_to_array(features).alias("v"))
    rows = scored.select(row_id, F.explode(paired).alias("p"))
    effect = F.col("p.v") * F.col("p.w.estimate")
    return rows.select(
        row_id,
        F.col("p.w.term").alias("term"),
        F.col("p.v").alias("value"),
        F.col("p.w.estimate").alias("estimate"),
        effect.alias("effect"),
        (from_log10(base) * effect).alias("effect_dollar"),
        from_log10(effect).alias("multiplier"),
    )


def rebuilt_price(effects: DataFrame, coefficients: DataFrame, row_id: str, chosen: Sequence[str] | None = None) -> DataFrame:
    """Sum of the chosen terms' effects on each row, and the price from the intercept and these effects alone."""
    base = coefficients.where(F.col("term") == "(Intercept)").agg(F.max("estimate").alias("b")).scalar()
    rows = effects if chosen is None else effects.where(F.col("term").isin(*chosen))
    total = rows.groupBy(row_id).agg(F.sum("effect").alias("effect"), F.sum("effect_dollar").alias("effect_dollar"))
    return total.withColumn("price", from_log10(base + F.col("effect")))


def odd_inputs(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Number of rows that break each named rule, in one pass."""
    counts = df.agg(
        *[F.sum(F.when(rule, 1).otherwise(0)).cast("long").alias(name) for name, rule in rules.items()]
    )
    return longer(counts, [], list(rules), "check", "n_bad")
