"""Price models on log10 dollars: fit, resample, predict, bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelmill.functions.numeric import from_log10, log10_positive, normal_quantile, student_quantile
from parcelmill.operators.recipe import Roles, recipe_stages, with_label
from parcelmill.operators.relational import bind_rows
from parcelmill.runtime import settle


#: The deepest trees that Spark grows, and the cut points it tries for a number.
DEPTH, BINS = 30, 64


def linear(label: str = "label") -> LinearRegression:
    """Least squares by the normal equations: one pass over the rows."""
    return LinearRegression(
        featuresCol="features", labelCol=label, predictionCol="pred", solver="normal",
        regParam=0.0, standardization=True,
    )


def forest(label: str = "label", trees: int = 500, depth: int = DEPTH, seed: int = 1234) -> RandomForestRegressor:
    """Random forest, a square-root share of the features at each split, leaves of five rows."""
    return RandomForestRegressor(
        featuresCol="features", labelCol=label, predictionCol="pred", numTrees=trees, maxDepth=depth,
        featureSubsetStrategy="sqrt", minInstancesPerNode=5, maxBins=BINS, seed=seed,
    )


def bagged_trees(
    label: str = "label", trees: int = 25, depth: int = DEPTH, min_leaf: int = 8, seed: int = 1234
) -> RandomForestRegressor:
    """Trees on bootstrap samples that see every feature at every split."""
    return RandomForestRegressor(
        featuresCol="features", labelCol=label, predictionCol="pred", numTrees=trees, maxDepth=depth,
        featureSubsetStrategy="all", minInstancesPerNode=min_leaf, maxBins=BINS, seed=seed,
    )


def fit(train: DataFrame, model: Estimator, stages: list | None = None, outcome: str = "sale_price_adj") -> PipelineModel:
    """Recipe and model learnt on the given rows; rows without a usable outcome are left out."""
    stages = recipe_stages(Roles(outcome=outcome)) if stages is None else stages
    rows = with_label(train, outcome).where(F.col("label").isNotNull())
    prepared = Pipeline(stages=stages).fit(rows)
    usable = prepared.transform(rows).where(F.col("features").isNotNull())
    return PipelineModel([*prepared.stages, model.fit(usable)])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Every input row with ``pred`` (log10) and ``pred_dollar``; the outcome is not needed.

    Both are missing where a predictor is missing or has an unknown level.
    """
    prepared = PipelineModel(model.stages[:-1]).transform(df)
    scored = _filled(model.stages[-1], prepared, lambda rows: model.stages[-1].transform(rows), ["pred"])
    return scored.withColumn("pred_dollar", from_log10(F.col("pred")))


def _filled(last, prepared: DataFrame, score: Callable[[DataFrame], DataFrame], outputs: list[str]) -> DataFrame:
    """Score rows without features on a vector of zeros and take the outcome away again."""
    zeros = array_to_vector(F.array_repeat(F.lit(0.0), last.numFeatures))
    whole = prepared.withColumn("__known", F.col("features").isNotNull()).withColumn("features", F.coalesce("features", zeros))
    scored = score(whole)
    known = F.col("__known")
    return scored.withColumns({c: F.when(known, F.col(c)) for c in [*outputs, "features"]}).drop("__known")


def resample(
    df: DataFrame,
    model: Callable[[], Estimator],
    fold: str = "fold",
    v: int = 10,
    stages: Callable[[], list] | None = None,
    outcome: str = "sale_price_adj",
    threads: int = 4,
) -> DataFrame:
    """Out-of-fold predictions: recipe and model are learnt again for every fold.

    The table is written once; folds are fitted side by side from it.
    """
    rows = settle(df)

    def one(k: int) -> DataFrame:
        fitted = fit(rows.where(F.col(fold) != k), model(), stages() if stages else None, outcome)
        return predict(fitted, rows.where(F.col(fold) == k)).drop("features")

    with ThreadPoolExecutor(threads) as pool:
        parts = list(pool.map(one, range(1, v + 1)))
    return bind_rows(*parts)


# --- bounds of the linear model ----------------------------------------------


@dataclass
class LinearFit:
    """Closed-form least squares: what bounds and tests need, of the size of the model.

    ``inverse`` belongs to the design with predictors taken from their ``center``.
    """

    names: list[str]
    coefficients: np.ndarray
    center: np.ndarray
    inverse: np.ndarray
    sigma2: float
    n: int

    @property
    def df(self) -> int:
        return self.n - len(self.coefficients)

    @property
    def std_errors(self) -> np.ndarray:
        back = np.eye(len(self.coefficients))
        back[0, 1:] = -self.center
        return np.sqrt(self.sigma2 * np.diag(back @ self.inverse @ back.T))


def least_squares(
    df: DataFrame, features: str = "features", label: str = "label", names: list[str] | None = None
) -> LinearFit:
    """Means, then sums of products around them: one small square matrix per task, added up by entry."""
    used = df.where(F.col(features).isNotNull() & F.col(label).isNotNull())
    center = used.select(Summarizer.mean(F.col(features)).alias("m")).first()["m"].toArray()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch) == 0:
                continue
            x = np.array(batch["x"].to_list(), dtype=float) - center
            rows = np.column_stack([np.ones(len(x)), x, batch["y"].to_numpy(dtype=float)])
            part = rows.T @ rows
            total = part if total is None else total + part
        if total is not None:
            size = total.shape[0]
            i, j = np.divmod(np.arange(size * size), size)
            yield pd.DataFrame({"i": i, "j": j, "v": total.ravel()})

    data = used.select(vector_to_array(features).alias("x"), F.col(label).alias("y"))
    sums = data.mapInPandas(partial, "i long, j long, v double")
    cells = sums.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    size = int(cells["i"].max()) + 1
    gram = np.zeros((size, size))
    gram[cells["i"], cells["j"]] = cells["v"]
    xx, xy, yy = gram[:-1, :-1], gram[:-1, -1], gram[-1, -1]
    # Scaled to ones on the diagonal before inversion: predictors differ by many powers of ten.
    scale = 1.0 / np.sqrt(np.maximum(np.diag(xx), 1e-300))
    inverse = np.linalg.pinv(xx * np.outer(scale, scale), hermitian=True) * np.outer(scale, scale)
    beta = inverse @ xy
    residual = max(yy - beta @ xy, 0.0)
    beta[0] -= center @ beta[1:]
    n = int(round(gram[0, 0]))
    terms = names or [f"x{k}" for k in range(1, size - 1)]
    return LinearFit(["(Intercept)", *terms], beta, center, inverse, residual / max(n - len(beta), 1), n)


def with_bounds(df: DataFrame, fitted: LinearFit, level: float = 0.95, features: str = "features") -> DataFrame:
    """Confidence bounds of the mean prediction, on the log scale and in dollars.

    The half width is t * sqrt(s2 * x'(X'X)^-1 x), the length of x times a root of
    the inverse, worked out batch by batch.
    """
    weight, vectors = np.linalg.eigh(fitted.inverse * fitted.sigma2)
    root = vectors * np.sqrt(np.maximum(weight, 0.0))
    center, quantile = fitted.center, student_quantile(0.5 + level / 2, fitted.df)

    @F.pandas_udf("double")
    def half_width(x: pd.Series) -> pd.Series:
        values = np.array(x.to_list(), dtype=float).reshape(len(x), len(center)) - center
        rows = np.column_stack([np.ones(len(values)), values])
        return pd.Series(quantile * np.sqrt(((rows @ root) ** 2).sum(axis=1)))

    # A row without features has no bounds.
    known = F.col(features).isNotNull()
    size = F.array_repeat(F.lit(0.0), len(center))
    half = F.when(known, half_width(vector_to_array(F.coalesce(features, array_to_vector(size)))))
    bounded = df.withColumn("__half", half).withColumns(
        {"pred_lower": F.col("pred") - F.col("__half"), "pred_upper": F.col("pred") + F.col("__half")}
    )
    return bounded.drop("__half").withColumns(
        {
            "pred_lower_dollar": from_log10(F.col("pred_lower")),
            "pred_upper_dollar": from_log10(F.col("pred_upper")),
        }
    )


def tree_bounds(model: PipelineModel, df: DataFrame, level: float = 0.95) -> DataFrame:
    """Bounds of a tree ensemble: mean of the trees plus and minus z * sd / sqrt(trees)."""
    last = model.stages[-1]
    names = [f"__tree_{k}" for k in range(len(last.trees))]

    def votes_of(rows: DataFrame) -> DataFrame:
        for name, tree in zip(names, last.trees):
            rows = tree.setPredictionCol(name).setFeaturesCol("features").transform(rows)
        return rows.withColumn("__votes", F.array(*names)).drop(*names)

    scored = _filled(last, PipelineModel(model.stages[:-1]).transform(df), votes_of, ["__votes"])
    votes, n = F.col("__votes"), len(names)
    mean = F.aggregate(votes, F.lit(0.0), lambda a, b: a + b) / n
    square = F.aggregate(votes, F.lit(0.0), lambda a, b: a + (b - F.col("pred")) * (b - F.col("pred")))
    spread = F.sqrt(square / max(n - 1, 1)) / float(np.sqrt(n))
    z = normal_quantile(0.5 + level / 2)
    out = scored.withColumn("pred", mean).withColumn("__se", spread)
    return out.withColumns(
        {
            "pred_lower": F.col("pred") - z * F.col("__se"),
            "pred_upper": F.col("pred") + z * F.col("__se"),
        }
    ).drop("__se", "__votes")


def residuals(df: DataFrame, outcome: str = "sale_price_adj") -> DataFrame:
    """Residuals on the log scale and in dollars."""
    return df.withColumns(
        {
            "resid": log10_positive(F.col(outcome)) - F.col("pred"),
            "resid_dollar": F.col(outcome) - F.col("pred_dollar"),
        }
    )
