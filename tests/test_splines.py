"""Smooth trends against a dense penalised fit."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelmill.operators import splines


def dense(x, y, knots):
    """Fitted values by plain least squares with the penalty as rows; the smoothing weight by the same score."""
    u = (x - x.min()) / (x.max() - x.min())
    fine = np.linspace(0, 1, 4001)

    def cardinal(at):
        out = []
        for k in range(len(knots)):
            heights = np.eye(len(knots))[k]
            h = np.diff(knots)
            a = np.zeros((len(knots), len(knots)))
            b = np.zeros(len(knots))
            a[0, 0] = a[-1, -1] = 1
            for i in range(1, len(knots) - 1):
                a[i, i - 1], a[i, i], a[i, i + 1] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
                b[i] = 6 * ((heights[i + 1] - heights[i]) / h[i] - (heights[i] - heights[i - 1]) / h[i - 1])
            m = np.linalg.solve(a, b)
            j = np.clip(np.searchsorted(knots, at, side="right") - 1, 0, len(knots) - 2)
            d, e = at - knots[j], knots[j + 1] - at
            out.append(
                (m[j] * e**3 + m[j + 1] * d**3) / (6 * h[j]) + (heights[j] / h[j] - m[j] * h[j] / 6) * e + (heights[j + 1] / h[j] - m[j + 1] * h[j] / 6) * d
            )
        return np.stack(out, axis=1)

    basis = cardinal(u)
    second = np.gradient(np.gradient(cardinal(fine), fine, axis=0), fine, axis=0)
    penalty = np.trapezoid(second[:, :, None] * second[:, None, :], fine, axis=0)
    best = (np.inf, None)
    for weight in np.exp(np.arange(-25, 8, 0.1)):
        hat = basis @ np.linalg.solve(basis.T @ basis + weight * penalty, basis.T)
        fitted = hat @ y
        score = len(y) * ((y - fitted) ** 2).sum() / (len(y) - np.trace(hat)) ** 2
        if score < best[0]:
            best = (score, fitted)
    return best[1]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    out = []
    for k in range(900):
        x = float(rng.uniform(0, 10))
        out.append(("wave", x, float(np.sin(x) * 3 + rng.normal() * 0.4)))
    out += [("line", float(k % 97), 2.0 * (k % 97) - 5) for k in range(300)]
    out += [("noise", float(rng.uniform(0, 1)), float(rng.normal())) for _ in range(400)]
    out += [("two", float(k % 2), float(k % 2 * 4 + k % 3)) for k in range(12)] + [("one", 3.0, 1.0), ("one", 3.0, 2.0)]
    out += [("wave", None, 1.0), ("wave", 1.0, None), ("wave", float("nan"), 2.0), ("none", None, 1.0), (None, 1.0, 1.0), (None, 2.0, 3.0)]
    return spark.createDataFrame(out, "g string, x double, y double").where("x is null or not isnan(x)").checkpoint()


def test_spline_equals_a_dense_fit(rows):
    fitted = splines.fit(rows, "x", "y", ["g"]).checkpoint()
    by_group = {r["g"]: r for r in fitted.collect()}
    assert set(by_group) == {"wave", "line", "noise", "two", "one", None}
    smooth = splines.smoothed(rows, fitted, "x", ["g"]).toPandas()
    own = smooth[(smooth["g"] == "wave") & smooth["x"].notna() & smooth["y"].notna()]
    want = dense(own["x"].to_numpy(), own["y"].to_numpy(), np.array(by_group["wave"]["knots"]))
    np.testing.assert_allclose(own["smooth"], want, atol=0.03)
    assert np.abs(own["smooth"] - 3 * np.sin(own["x"])).mean() < 0.15
    assert 6 < by_group["wave"]["edf"] <= 10 and by_group["line"]["edf"] < 2.01
    line = smooth[smooth["g"] == "line"]
    np.testing.assert_allclose(line["smooth"], line["y"], atol=1e-6)
    np.testing.assert_allclose(smooth[smooth["g"] == "one"]["smooth"], 1.5)
    two = smooth[smooth["g"] == "two"].groupby("x").mean(numeric_only=True)
    np.testing.assert_allclose(two["smooth"], two["y"], atol=1e-6)


def test_trend_has_a_band(rows):
    table = splines.trend(rows, "x", "y", ["g"], points=40).toPandas()
    assert (table.groupby("g", dropna=False).size() == 40).all() and (table["y_lower"] <= table["y"]).all() and (table["y"] <= table["y_upper"]).all()
    wave = table[table["g"] == "wave"]
    inside = (wave["y_lower"] <= 3 * np.sin(wave["x"])) & (3 * np.sin(wave["x"]) <= wave["y_upper"])
    assert inside.mean() > 0.8
    assert (wave["y_upper"] - wave["y_lower"]).median() < 0.6


def test_one_trend_of_all_rows_and_of_none(rows):
    alone = splines.trend(rows.where("g = 'noise'"), "x", "y", points=5)
    assert alone.count() == 5 and alone.columns == ["point", "x", "y", "y_lower", "y_upper"]
    assert splines.fit(rows.where("g = 'none'"), "x", "y", ["g"]).count() == 0
    fitted = splines.fit(rows.where("g = 'noise'"), "x", "y")
    outside = rows.where("g = 'line'").limit(3).withColumn("x", F.lit(50.0))
    assert {r["smooth"] for r in splines.smoothed(outside, fitted, "x").collect()} == {None}
