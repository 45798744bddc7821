"""Smooth trends by penalised cubic regression splines, one for each group.

A spline is given by its heights at a few knots (quantiles of x); between two knots a row only involves those two
heights and the bends there. So sums of products by group and interval, one aggregation over the rows, hold all
that a fit needs. The smoothness is the one with the least generalised cross-validation score; each group is solved from its
handful of sums.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelmill.functions.numeric import normal_quantile
from parcelmill.operators.aggregates import quantiles
from parcelmill.runtime import lookup_join, settle

KNOTS = 10
#: Natural logarithms of the smoothing weights that are tried.
WEIGHTS = np.arange(-30.0, 30.0, 0.05)
_PARTS = ("below", "above", "bend_below", "bend_above")


def _between(u: Column, low: Column, high: Column) -> dict[str, Column]:
    """What a row at ``u`` has of the heights and the bends of the knots ``low`` and ``high``."""
    h, left, right = high - low, u - low, high - u
    return {"below": right / h, "above": left / h, "bend_below": (right * right * right / h - h * right) / 6, "bend_above": (left * left * left / h - h * left) / 6}


def _second_differences(knots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bends at all knots from heights, their penalty): the integral of the squared second derivative is a quadratic form of the heights."""
    count = len(knots)
    bends, penalty = np.zeros((count, count)), np.zeros((count, count))
    if count > 2:
        h = np.diff(knots)
        inner = np.arange(count - 2)
        slopes = np.zeros((count - 2, count))
        slopes[inner, inner], slopes[inner, inner + 1], slopes[inner, inner + 2] = 1 / h[:-1], -1 / h[:-1] - 1 / h[1:], 1 / h[1:]
        band = np.diag((h[:-1] + h[1:]) / 3) + np.diag(h[1:-1] / 6, 1) + np.diag(h[1:-1] / 6, -1)
        bends[1:-1] = np.linalg.solve(band, slopes)
        penalty = slopes.T @ bends[1:-1]
    return bends, penalty


def _solve(knots: np.ndarray, sums: pd.DataFrame, points: int) -> dict:
    """Heights, bends, effective degrees of freedom and the curve on a grid, from the sums of each interval."""
    count = len(knots)
    bends, penalty = _second_differences(knots)
    xx, xy, n, yy = np.zeros((count, count)), np.zeros(count), 0.0, 0.0
    for r in sums.to_dict("records"):
        j = int(r["interval"])
        rows = np.zeros((4, count))
        rows[0, j] = rows[1, min(j + 1, count - 1)] = 1
        rows[2], rows[3] = bends[j], bends[min(j + 1, count - 1)]
        moments = np.array([[r[f"{a}_{b}"] if a <= b else r[f"{b}_{a}"] for b in range(4)] for a in range(4)])
        xx += rows.T @ moments @ rows
        xy += rows.T @ np.array([r[f"{a}_y"] for a in range(4)])
        n, yy = n + r["n"], yy + r["yy"]
    # Where some knots have hardly any rows, the penalty alone decides.
    size = np.trace(xx) / count
    whole = xx + (1e-10 * size / max(np.trace(penalty), 1e-300)) * penalty + 1e-14 * size * np.eye(count)
    lower = np.linalg.cholesky(whole)
    inverse = np.linalg.inv(lower)
    rough, turn = np.linalg.eigh(inverse @ penalty @ inverse.T)
    rough = np.maximum(rough, 0.0)
    rough[:2] = 0.0  # lines have no bends
    z = turn.T @ inverse @ xy
    shrunk = 1 / (1 + np.exp(WEIGHTS)[:, None] * (rough / max(rough.max(), 1e-300))[None, :])
    left = np.maximum(yy - 2 * (shrunk * z**2).sum(axis=1) + (shrunk**2 * z**2).sum(axis=1), 0.0)
    used = shrunk.sum(axis=1)
    score = np.where(n > used, n * left / np.maximum(n - used, 1e-9) ** 2, np.inf)
    best = len(WEIGHTS) - 1 - int(np.argmin(score[::-1]))  # of equal scores the smoothest
    back = inverse.T @ turn
    heights = back @ (shrunk[best] * z)
    sigma2 = left[best] / max(n - used[best], 1.0)
    u = np.linspace(knots[0], knots[-1], points)
    basis = _basis(knots, bends, u)
    errors = np.sqrt(sigma2 * ((basis @ back) ** 2 * shrunk[best]).sum(axis=1))
    return {"heights": heights, "bends": bends @ heights, "edf": float(used[best]), "u": u, "y": basis @ heights, "error": errors}


def _basis(knots: np.ndarray, bends: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Rows of the spline's design at the places ``u``."""
    count = len(knots)
    if count == 1:
        return np.ones((len(u), 1))
    j = np.clip(np.searchsorted(knots, u, side="right") - 1, 0, count - 2)
    h, left, right = knots[j + 1] - knots[j], u - knots[j], knots[j + 1] - u
    out = ((right**3 / h - h * right) / 6)[:, None] * bends[j] + ((left**3 / h - h * left) / 6)[:, None] * bends[j + 1]
    out[np.arange(len(u)), j] += right / h
    out[np.arange(len(u)), j + 1] += left / h
    return out


def fit(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), knots: int = KNOTS, points: int = 80) -> DataFrame:
    """One row per group: keys, lo, hi, knots, heights, bends, edf, and the curve as arrays at, y, error.

    Positions run from 0 (``lo``) to 1 (``hi``). Rows without x or y, or with infinite ones, are left out. Groups with few different x
    have fewer knots: two give a line, one the mean.
    """
    keys = list(keys)
    usable = lambda c: F.col(c).cast("double").isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf"))
    rows = df.where(usable(x) & usable(y)).select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    group = keys or ["__all"]
    rows = rows if keys else rows.withColumn("__all", F.lit(0))
    rows = settle(rows)
    marks = {f"q{k}": k / (knots - 1) for k in range(knots)}
    places = quantiles(rows.select(*group, "__x").distinct(), group, "__x", marks)
    width = F.col(f"q{knots - 1}") - F.col("q0")
    at = F.array_distinct(F.array(*[F.coalesce(F.try_divide(F.col(q) - F.col("q0"), width), F.lit(0.0)) for q in marks]))
    placed = settle(places.select(*group, F.col("q0").alias("lo"), F.col(f"q{knots - 1}").alias("hi"), at.alias("knots")))
    joined = lookup_join(rows, placed, group, "inner", base_table=True)
    u = F.coalesce(F.try_divide(F.col("__x") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    last = F.greatest(F.size("knots") - 2, F.lit(0))
    joined = joined.withColumn("__u", u)
    joined = joined.withColumn("interval", F.least(F.size(F.filter(F.slice("knots", 2, KNOTS * knots), lambda k: k <= F.col("__u"))), last))
    joined = joined.withColumns({"__low": F.get("knots", F.col("interval")), "__high": F.get("knots", F.col("interval") + 1)})
    parts = _between(F.col("__u"), F.col("__low"), F.col("__high"))
    # A group with one place has heights only.
    parts = {name: F.coalesce(c, F.lit(1.0 if name == "below" else 0.0)) for name, c in parts.items()}
    joined = joined.withColumns({f"__{name}": c for name, c in parts.items()})
    names = [f"__{name}" for name in _PARTS]
    sums = joined.groupBy(*group, "lo", "hi", "knots", "interval").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("__y") * F.col("__y")).alias("yy"),
        *[F.sum(F.col(a) * F.col("__y")).alias(f"{k}_y") for k, a in enumerate(names)],
        *[F.sum(F.col(names[a]) * F.col(names[b])).alias(f"{a}_{b}") for a in range(4) for b in range(a, 4)],
    )

    def solved(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        found = _solve(np.array(first["knots"], dtype=float), frame, points)
        span = first["hi"] - first["lo"]
        return pd.DataFrame(
            {
                **{k: [first[k]] for k in group}, "lo": [first["lo"]], "hi": [first["hi"]], "knots": [first["knots"]], "heights": [found["heights"]],
                "bends": [found["bends"]], "edf": [found["edf"]], "at": [first["lo"] + found["u"] * span], "y": [found["y"]], "error": [found["error"]],
            }
        )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields if f.name in group)
    arrays = "array<double>"
    schema = f"{kinds}, lo double, hi double, knots {arrays}, heights {arrays}, bends {arrays}, edf double, at {arrays}, y {arrays}, error {arrays}"
    out = sums.groupBy(*group).applyInPandas(solved, schema)
    return out if keys else out.drop("__all")


def trend(
    df: DataFrame, x: str, y: str, keys: Sequence[str] = (), knots: int = KNOTS, points: int = 80, level: float = 0.95
) -> DataFrame:
    """keys, point, x, y, y_lower, y_upper: each group's smooth trend on an even grid, with a confidence band."""
    fitted = fit(df, x, y, keys, knots, points)
    z = normal_quantile(0.5 + level / 2)
    rows = fitted.select(*keys, F.posexplode(F.arrays_zip(F.col("at").alias("x"), "y", "error")).alias("point", "p"))
    return rows.select(
        *keys, F.col("point").cast("long").alias("point"), F.col("p.x").alias("x"), F.col("p.y").alias("y"),
        (F.col("p.y") - z * F.col("p.error")).alias("y_lower"), (F.col("p.y") + z * F.col("p.error")).alias("y_upper"),
    )


def smoothed(df: DataFrame, fitted: DataFrame, x: str, keys: Sequence[str] = (), name: str = "smooth") -> DataFrame:
    """Every row with its group's spline at ``x``; missing outside of the range the spline was fitted on."""
    keys = list(keys)
    curve = fitted.select(*keys, F.struct("lo", "hi", "knots", "heights", "bends").alias("__curve"))
    joined = lookup_join(df, curve, keys) if keys else df.crossJoin(F.broadcast(curve))
    c = F.col("__curve")
    place = F.col(x).cast("double")
    # Step by step, so that a row's place among the knots is looked up once and not wherever it is used.
    joined = joined.withColumn("__u", F.coalesce(F.try_divide(place - c["lo"], c["hi"] - c["lo"]), F.lit(0.0)))
    joined = joined.withColumn("__j", F.greatest(F.least(F.size(F.filter(c["knots"], lambda k: k <= F.col("__u"))), F.size(c["knots"]) - 1) - 1, F.lit(0)))
    j = F.col("__j")
    parts = _between(F.col("__u"), F.get(c["knots"], j), F.get(c["knots"], j + 1))
    value = (
        F.get(c["heights"], j) * parts["below"] + F.get(c["heights"], j + 1) * parts["above"]
        + F.get(c["bends"], j) * parts["bend_below"] + F.get(c["bends"], j + 1) * parts["bend_above"]
    )
    value = F.when(F.size(c["knots"]) == 1, F.get(c["heights"], F.lit(0))).otherwise(value)
    return joined.withColumn(name, F.when(place.between(c["lo"], c["hi"]), value)).drop("__curve", "__u", "__j")
