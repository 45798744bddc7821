"""Least squares from sums of products, for one model or for all models of a cross-validation.

The sums are a table of cells (fold, a, b, value): of numbers with numbers, of numbers by level, and of pairs of
levels that meet in a row. They are plain grouped sums, combined before the shuffle, taken in one pass by fold
over values *before* imputation and pooling. What a model's recipe does to a value is linear in it (an imputed value is a
weight, pooled levels are added up), so each model's normal equations come from the same cells: those of
all folds less its own, led through its map of values to terms. No training row is read twice and none again for
another fold; there is no limit on the number of terms but the square matrix that is solved.

Terms that others determine get no coefficient: in the order of the terms, a term is left out if the ones before
it explain it. Predictions then don't use it.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmill.functions.numeric import from_log10, log10_positive, student_quantile, student_two_sided
from parcelmill.operators.design import ALL_ROWS, NO_FOLD, Design, Recipe, by_model, encode, learn, less_own_fold, prepared, term_names
from parcelmill.runtime import quoted, settle

#: A term is left out if the ones before it explain all but this share of it.
COLLINEAR = 1e-9
#: Entries of dense design rows that are made at once for bounds.
DENSE_ENTRIES = 1 << 22
#: Rows that give the origin from which numbers are counted; it only keeps sums of products small.
ORIGIN_ROWS = 1_000


@dataclass
class LeastSquares:
    """One model: coefficients by term (0: intercept), NaN where a term is collinear.

    ``inverse`` belongs to the design with numbers counted from ``origin``; it is 0 for collinear terms.
    """

    names: list[str]
    coefficients: np.ndarray
    origin: np.ndarray
    inverse: np.ndarray
    sigma2: float
    n: int
    collinear: list[str] = field(default_factory=list)

    @property
    def df(self) -> int:
        return self.n - int(np.isfinite(self.coefficients).sum())

    @property
    def used(self) -> np.ndarray:
        """Coefficients as predictions use them."""
        return np.where(np.isfinite(self.coefficients), self.coefficients, 0.0)

    @property
    def std_errors(self) -> np.ndarray:
        variance = np.diag(self.inverse).copy()
        # The intercept at 0 instead of at the origin of the numbers.
        to_zero = np.concatenate([[1.0], -self.origin])
        variance[0] = to_zero @ self.inverse @ to_zero
        return np.where(np.isfinite(self.coefficients), np.sqrt(np.maximum(self.sigma2 * variance, 0.0)), np.nan)


def cholesky(matrix: np.ndarray, least: float = COLLINEAR) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, lower factor of these) of a matrix with ones on the diagonal; rows that earlier ones determine are not kept."""
    try:
        lower = np.linalg.cholesky(matrix)
        if (np.diag(lower) ** 2 > least).all():
            return np.arange(len(matrix)), lower
    except np.linalg.LinAlgError:
        pass
    kept: list[int] = []
    lower = np.zeros_like(matrix)
    for row in range(len(matrix)):
        m = len(kept)
        part = np.zeros(m)
        if m:
            part = np.linalg.solve(lower[:m, :m], matrix[kept, row]) if m < 2 else _forward(lower[:m, :m], matrix[kept, row])
        pivot = matrix[row, row] - part @ part
        if pivot > least:
            lower[m, :m], lower[m, m] = part, np.sqrt(pivot)
            kept.append(row)
    return np.array(kept, dtype=int), lower[: len(kept), : len(kept)]


def _forward(lower: np.ndarray, right: np.ndarray, block: int = 256) -> np.ndarray:
    """Solve a lower triangular system, block by block."""
    out = right.astype(float).copy()
    for a in range(0, len(out), block):
        b = min(a + block, len(out))
        out[a:b] = np.linalg.solve(lower[a:b, a:b], out[a:b] - lower[a:b, :a] @ out[:a])
    return out


def solved(gram: np.ndarray, with_y: np.ndarray, yy: float, names: list[str], origin: np.ndarray, y_origin: float) -> LeastSquares:
    """The model from sums of products of its design (intercept first) counted from the origin."""
    size = np.sqrt(np.maximum(np.diag(gram), 0.0))
    there = np.flatnonzero(size > 0)  # a term that no usable row has is determined, too
    scale = 1.0 / size[there]
    kept, lower = cholesky(gram[np.ix_(there, there)] * np.outer(scale, scale))
    at = there[kept]
    root = np.linalg.inv(lower) * scale[kept]
    inverse = np.zeros_like(gram)
    inverse[np.ix_(at, at)] = root.T @ root
    beta = inverse @ with_y
    n = int(round(gram[0, 0]))
    residual = max(yy - beta @ with_y, 0.0)
    coefficients = np.full(len(gram), np.nan)
    coefficients[at] = beta[at]
    if len(at):
        coefficients[0] = y_origin + beta[0] - origin @ beta[1:]
    left_out = [names[k] for k in range(len(names)) if k not in set(at.tolist())]
    return LeastSquares(names, coefficients, origin, inverse, residual / max(n - len(at), 1), n, left_out)


def cells(rows: DataFrame, recipe: Recipe, origin: list[float], fold: str | None = None) -> DataFrame:
    """(fold, a, b, value): the sums of products of ``prepared`` rows with a ``__y``, each pair both ways.

    0 stands for the constant, 1 and so on for the numbers, the one after for ``__y``, hashes for levels. Rows
    that lack a number or category which isn't imputed are left out, as is a fit of them.
    """
    d = len(recipe.numeric)
    ids = {f"__l{k}": F.xxhash64(F.lit(c.column), c.merged(F.col(f"__c{k}"))) for k, c in enumerate(recipe.categories)}
    usable = F.col("__y").isNotNull()
    for j, name in enumerate(recipe.numeric):
        if name not in recipe.medians:
            usable &= F.col(f"__x{j}").isNotNull()
    for k, c in enumerate(recipe.categories):
        if not c.impute:
            usable &= F.col(f"__c{k}").isNotNull()
    gaps = {f"__g{k}": F.when(F.col(f"__x{list(recipe.numeric).index(name)}").isNull(), F.xxhash64(F.lit(name))) for k, name in enumerate(recipe.medians)}
    numbers = [F.lit(1.0), *[F.coalesce(F.col(f"__x{j}") - origin[j], F.lit(0.0)) for j in range(d)], F.col("__y") - origin[d]]
    names = [f"__d{j}" for j in range(d + 2)]
    own = F.lit(NO_FOLD) if fold is None else quoted(fold)
    made = dict(zip(names, numbers, strict=True)) | ids | gaps
    narrow = settle(rows.where(usable).select(own.cast("long").alias("fold"), *[x.alias(n) for n, x in made.items()]))
    lacking = narrow.where(reduce(lambda a, b: a | b, [F.col(g).isNotNull() for g in gaps], F.lit(False)))
    pairs = list(combinations_with_replacement(range(d + 2), 2))
    dense = narrow.groupBy("fold").agg(
        F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.sum(F.col(names[a]) * F.col(names[b])).alias("value")) for a, b in pairs]).alias("cell")
    )
    # Every row has all its levels; the few rows with gaps are gone over for these.
    each = [
        some.select("fold", *names, F.explode(F.array(*marks)).alias("level")).where("level is not null") for some, marks in ((narrow, ids), (lacking, gaps)) if marks
    ]
    by_level = [reduce(DataFrame.unionByName, each).groupBy("fold", "level").agg(
        F.array(
            *[F.struct(F.lit(a).cast("long").alias("a"), F.col("level").alias("b"), F.sum(names[a]).alias("value")) for a in range(d + 2)],
            F.struct(F.col("level").alias("a"), F.col("level").alias("b"), F.sum(names[0]).alias("value")),
        ).alias("cell")
    )] if each else []
    of_levels = list(combinations(ids, 2))
    with_gaps = [p for p in combinations([*ids, *gaps], 2) if p[1] in gaps]
    together = [
        some.select("fold", F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in met])).alias("p"))
        .where("p.a is not null and p.b is not null").groupBy("fold", "p.a", "p.b").agg(F.count(F.lit(1)).cast("double").alias("value"))
        for some, met in ((narrow, of_levels), (lacking, with_gaps)) if met
    ]
    spread = [x.select("fold", F.explode("cell").alias("c")).select("fold", "c.*") for x in (dense, *by_level)]
    once = reduce(DataFrame.unionByName, [*spread, *together])
    turned = once.where("a != b").select("fold", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    return once.unionByName(turned).groupBy("fold", "a", "b").agg(F.sum("value").alias("value"))


@dataclass
class Fitted:
    """The models of a recipe by number (0: of all rows; k: of all folds but k), and what their recipes learnt."""

    design: Design
    models: dict[int, LeastSquares]

    @property
    def recipe(self) -> Recipe:
        return self.design.recipe

    @property
    def model(self) -> LeastSquares:
        return self.models[ALL_ROWS]

    def coefficients(self, spark: SparkSession, k: int = ALL_ROWS) -> DataFrame:
        """term, estimate, std_error, statistic, p_value; all but the term are missing for collinear terms."""
        m = self.models[k]
        rows = []
        for name, b, se in zip(m.names, m.coefficients.tolist(), m.std_errors.tolist(), strict=True):
            if not np.isfinite(b):
                rows.append((name, None, None, None, None))
                continue
            t = b / se if se > 0 else None
            rows.append((name, b, se, t, None if t is None or m.df < 1 else student_two_sided(t, m.df)))
        return spark.createDataFrame(rows, "term string, estimate double, std_error double, statistic double, p_value double")

    def predict(self, rows: DataFrame, fold: str | None = None) -> DataFrame:
        """Every row with ``pred`` (log10) and ``pred_dollar``, by model 0 or by the model of the row's fold.

        Missing where a predictor is missing or has a level that the model doesn't know. Joins with tables of levels only.
        """
        return self._scored(rows, fold).drop("terms", "weights", *self._made())

    def _made(self) -> list[str]:
        return [*[f"__x{j}" for j in range(len(self.recipe.numeric))], *[f"__c{k}" for k in range(len(self.recipe.categories))]]

    def _scored(self, rows: DataFrame, fold: str | None = None) -> DataFrame:
        first = 1 + len(self.recipe.numeric)
        spark = rows.sparkSession
        pairs = [(k, j, float(b)) for k, m in self.models.items() for j, b in enumerate(m.used) if j >= first]
        effects = spark.createDataFrame(pairs, "k long, term int, effect double")
        k = F.lit(ALL_ROWS) if fold is None else quoted(fold)
        coded = encode(prepared(rows, self.recipe), self.design, k, effects)
        pred = by_model({n: float(m.used[0]) for n, m in self.models.items()}, k, "double") + F.col("effect")
        for j in range(1, first):
            slope = by_model({n: float(m.used[j]) for n, m in self.models.items()}, k, "double")
            pred = pred + slope * F.col(f"__x{j - 1}")
        return coded.withColumn("pred", pred).withColumn("pred_dollar", from_log10(F.col("pred"))).drop("effect")

    def with_bounds(self, rows: DataFrame, level: float = 0.95) -> DataFrame:
        """``predict`` by model 0 with confidence bounds of the mean prediction, on the log scale and in dollars.

        The half width is t * sqrt(s2 * x'(X'X)^-1 x), worked out for a few dense rows at a time.
        """
        m = self.model
        scored = self._scored(rows)
        weight, vectors = np.linalg.eigh(m.inverse * m.sigma2)
        shared = rows.sparkSession.sparkContext.broadcast(vectors * np.sqrt(np.maximum(weight, 0.0)))
        origin, terms, quantile = m.origin, len(m.names), student_quantile(0.5 + level / 2, m.df)
        step = max(DENSE_ENTRIES // terms, 1)

        @F.arrow_udf("double")
        def half_width(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            root = shared.value
            for batch in batches:
                places, weights = batch.flatten()
                sizes = places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                at, values = places.flatten().to_numpy(), weights.flatten().to_numpy()
                out = np.empty(len(batch))
                for a in range(0, len(batch), step):
                    own = sizes[a : a + step]
                    some = slice(ends[a], ends[a + len(own)])
                    dense = np.zeros((len(own), terms))
                    dense[:, 0] = 1
                    dense[:, 1:] = -origin
                    np.add.at(dense, (np.repeat(np.arange(len(own)), own), at[some]), values[some])
                    out[a : a + step] = quantile * np.sqrt(((dense @ root) ** 2).sum(axis=1))
                yield pa.array(out)

        empty = lambda name, kind: F.coalesce(F.col(name), F.array().cast(kind)).alias(name)
        half = F.when(F.col("terms").isNotNull(), half_width(F.struct(empty("terms", "array<int>"), empty("weights", "array<double>"))))
        bounded = scored.withColumn("__half", half).withColumns(
            {"pred_lower": F.col("pred") - F.col("__half"), "pred_upper": F.col("pred") + F.col("__half")}
        )
        return bounded.drop("__half", "terms", "weights", *self._made()).withColumns(
            {"pred_lower_dollar": from_log10(F.col("pred_lower")), "pred_upper_dollar": from_log10(F.col("pred_upper"))}
        )


def fit(
    rows: DataFrame, recipe: Recipe, outcome: str = "sale_price_adj", fold: str | None = None, v: int = 0, design: Design | None = None
) -> Fitted:
    """Least squares of log10 of ``outcome``: model 0 of all rows, or with ``fold`` models 1 to ``v``, each without its fold.

    The recipe is learnt from rows with a positive outcome; the fit leaves out those that lack a predictor. A
    model without usable rows predicts nothing. ``design`` is what the recipe learnt from these rows before, if it did.
    """
    labelled = prepared(rows.withColumn("__y", log10_positive(quoted(outcome))).where("__y is not null"), recipe)
    d = len(recipe.numeric)

    def summed() -> tuple[list[float], DataFrame]:
        near = labelled.limit(ORIGIN_ROWS).agg(*[F.coalesce(F.avg(f"__x{j}"), F.lit(0.0)).alias(f"x{j}") for j in range(d)], F.coalesce(F.avg("__y"), F.lit(0.0)).alias("y"))
        origin = [float(x) for x in near.first()]
        return origin, settle(cells(labelled, recipe, origin, fold))

    # What the recipe learns and the sums don't need each other.
    with ThreadPoolExecutor(2) as pool:
        learnt, sums = pool.submit(lambda: design or learn(labelled, recipe, fold, v)), pool.submit(summed)
        found, (origin, sums) = learnt.result(), sums.result()
    design = found
    trained = less_own_fold(sums, design.models, ["a", "b"], "value")
    # What each value of a row is in a model's design: terms and weights; the outcome is term -1.
    fixed = [(k, j, j if j <= d else -1, 1.0) for k in design.models for j in range(d + 2)]
    for (k, name), median in design.medians.items():
        j = list(recipe.numeric).index(name)
        fixed.append((k, None, j + 1, median - origin[j]))
    spark = rows.sparkSession
    names = {n: j for j, n in enumerate(recipe.numeric)}
    ways = spark.createDataFrame(fixed, "k long, id long, term int, weight double")
    gaps = F.array(*[F.xxhash64(F.lit(n)) for n in names]) if names else F.array().cast("array<bigint>")
    ways = ways.withColumn("id", F.coalesce("id", F.try_element_at(gaps, F.greatest(F.col("term"), F.lit(1)))))
    ways = ways.unionByName(
        design.maps.where("term is not null").select("k", F.xxhash64("name", "raw").alias("id"), "term", "weight")
    )
    ways = settle(ways)
    left = ways.select("k", F.col("id").alias("a"), F.col("term").alias("i"), F.col("weight").alias("wi"))
    right = ways.select("k", F.col("id").alias("b"), F.col("term").alias("j"), F.col("weight").alias("wj"))
    products = trained.join(left, ["k", "a"]).join(right, ["k", "b"]).groupBy("k", "i", "j").agg(
        F.sum(F.col("value") * F.col("wi") * F.col("wj")).alias("value")
    )
    with ThreadPoolExecutor(2) as pool:
        found, labels = pool.map(lambda df: df.toPandas(), [products, term_names(design)])
    models = {}
    for k in design.models:
        own = labels[labels["k"] == k].sort_values("term")["name"].tolist()
        at = found[found["k"] == k]
        whole = np.zeros((len(own) + 1, len(own) + 1))
        whole[at["i"].to_numpy(), at["j"].to_numpy()] = at["value"]  # the outcome, -1, is the last one
        start = np.zeros(len(own) - 1)
        start[:d] = origin[:d]
        models[k] = solved(whole[:-1, :-1], whole[:-1, -1], float(whole[-1, -1]), own, start, origin[d])
    return Fitted(design, models)


def out_of_fold(rows: DataFrame, recipe: Recipe, fold: str = "fold", v: int = 10, outcome: str = "sale_price_adj") -> DataFrame:
    """Every row predicted by the model that didn't learn from its fold (1 to ``v``)."""
    stored = settle(rows)
    return fit(stored, recipe, outcome, fold, v).predict(stored, fold)
