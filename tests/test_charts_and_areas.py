from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from parcelmill.operators import distribution as dist
from parcelmill.operators import factors as fct
from parcelmill.operators import geography as geo


@pytest.fixture(scope="module")
def prices(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"id": range(2000), "x": rng.normal(100, 15, 2000), "e": rng.normal(0, 1, 2000)})
    frame["g"] = np.where(frame["id"] % 3 == 0, "a", "b")
    frame["y"] = 3 * frame["x"] + 7
    return spark.createDataFrame(frame)


def test_histogram_counts_every_row_once(prices):
    bins = dist.histogram(prices, "x", ["g"]).toPandas()
    assert bins["n"].sum() == 2000
    for _, part in bins.groupby("g"):
        assert list(part["bin"].sort_values()) == list(range(part["bin"].min(), part["bin"].max() + 1))
        assert 30 <= len(part) + 1 <= 32
    constant = dist.histogram(prices.withColumn("x", F.lit(4.0)), "x").toPandas()
    assert list(constant["n"]) == [2000]


def test_pretty_breaks_like_known_cases(spark):
    rows = spark.createDataFrame([(float(v),) for v in range(1, 101)], "v double")
    table = dist.pretty_histogram(rows, "v").toPandas().sort_values("bin")
    # 1..100 gives ten classes of width ten, the first one closed on both sides.
    assert list(table["n"]) == [10] * 10 and table["low"].min() == 0


def test_density_integrates_to_about_one(prices):
    table = dist.density(prices, "x", ["g"]).toPandas()
    for _, part in table.groupby("g"):
        part = part.sort_values("x")
        assert 0.97 < np.trapezoid(part["density"], part["x"]) < 1.01
    few = prices.where("id < 1")
    flat = dist.density(few, "x").toPandas().sort_values("x")  # a constant group has a width too
    assert len(flat) == 512 and (flat["density"] > 0).all()


def test_density_matches_direct_sum(prices):
    rows = prices.toPandas()["x"].to_numpy()
    q1, q3 = np.quantile(rows, [0.25, 0.75])
    width = 0.9 * min(rows.std(ddof=1), (q3 - q1) / 1.34) * len(rows) ** -0.2
    for row in dist.density(prices, "x").where("point % 100 = 56").collect():
        direct = np.exp(-0.5 * ((rows - row["x"]) / width) ** 2).sum() / (len(rows) * width * np.sqrt(2 * np.pi))
        assert abs(direct - row["density"]) < 2e-3 * direct + 1e-6


def test_density_2d_peak_is_one(prices):
    table = dist.density_2d(prices, "x", "e", points=30).toPandas()
    assert table["ndensity"].max() == 1.0 and table["band"].between(1, 10).all()
    peak = table.loc[table["ndensity"].idxmax()]
    assert abs(peak["x"] - 100) < 8 and abs(peak["y"]) < 0.6


def test_box_summary(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 5, 100]] + [("b", 7.0)], "g string, v double")
    table = {r["g"]: r for r in dist.box_summary(rows, ["g"], "v").collect()}
    a = table["a"]
    assert (a["q1"], a["median"], a["q3"], a["whisker_low"], a["whisker_high"], a["n_outliers"], a["n"]) == (
        2.25, 3.5, 4.75, 1.0, 5.0, 1, 6,
    )
    assert table["b"]["n"] == 1 and table["b"]["n_outliers"] == 0


def test_trend_of_a_line_is_the_line(prices):
    table = dist.trend(prices, "x", "y").toPandas()
    np.testing.assert_allclose(table["y"], 3 * table["x"] + 7, rtol=2e-3)


def test_factor_orders(spark):
    rows = spark.createDataFrame(
        [("a", 1.0), ("a", 9.0), ("b", 2.0), ("c", 3.0), ("c", 3.0), (None, 0.0)], "f string, v double"
    )
    order = {r["f"]: r["level_rank"] for r in fct.level_order(rows, "f", "v").collect()}
    assert order == {None: 1, "b": 2, "c": 3, "a": 4}
    top = {r["f"]: r["level_rank"] for r in fct.level_order(rows, "f", "v", fun=F.max, desc=True).collect()}
    assert top["a"] == 1
    counts = spark.createDataFrame([("a", 5), ("b", 5), ("c", 1), ("d", 1)], "f string, n long")
    assert {r["f"]: r["n"] for r in fct.lump_top(counts, "f", 1).collect()} == {"a": 5, "b": 5, "Other": 2}
    assert fct.lump_rare(rows, "f", 2).where("f = 'Other'").count() == 1
    declared = fct.declared(rows, "f", ["c", "a"]).collect()
    assert {(r["f"], r["level_rank"]) for r in declared} == {("c", 1), ("a", 2), (None, None)}


# --- areas -------------------------------------------------------------------

L_SHAPE = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4), (0, 0)]


def ring(area, part, points):
    return [(area, part, k + 1, float(x), float(y)) for k, (x, y) in enumerate(points)]


def square(x, y, size):
    return [(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]


@pytest.fixture(scope="module")
def shapes(spark):
    rows = ring("L", 1, L_SHAPE) + ring("two", 1, square(5, 5, 1)) + ring("two", 2, square(7, 7, 1)) + ring("over", 1, square(0.5, 0.5, 2))
    return spark.createDataFrame(rows, "geo_id string, part_id int, seq int, x double, y double")


@pytest.fixture(scope="module")
def grid_points(spark):
    rows = [(i * 100 + j, i * 0.1 + 0.037, j * 0.1 + 0.041) for i in range(90) for j in range(90)]
    return spark.createDataFrame(rows, "id long, longitude double, latitude double")


def inside(x, y):
    hits = set()
    if 0 < x < 4 and 0 < y < 4 and not (x > 1 and y > 1):
        hits.add("L")
    if (5 < x < 6 and 5 < y < 6) or (7 < x < 8 and 7 < y < 8):
        hits.add("two")
    if 0.5 < x < 2.5 and 0.5 < y < 2.5:
        hits.add("over")
    return hits


@pytest.mark.parametrize("options", [{"step": 0.7}, {"step": 0.3, "max_cells": 0}])
def test_assign_areas(grid_points, shapes, options):
    found: dict[int, set] = {}
    spots = {r["id"]: (r["longitude"], r["latitude"]) for r in grid_points.collect()}
    for row in geo.assign_areas(grid_points, shapes, **options).collect():
        found.setdefault(row["id"], set()).add(row["geo_id"])
    assert len(found) == len(spots)
    for key, (x, y) in spots.items():
        assert found[key] == (inside(x, y) or {None})


def test_first_area_centroid_and_size(spark, grid_points, shapes):
    order = spark.createDataFrame([("over", 1), ("L", 2), ("two", 3)], "geo_id string, area_rank long")
    found = geo.first_area(grid_points, shapes, order, "id", step=0.5).collect()
    assert len(found) == grid_points.count()
    spots = {r["id"]: (r["longitude"], r["latitude"]) for r in grid_points.collect()}
    for row in found:
        hits = inside(*spots[row["id"]])
        assert row["geo_id"] == ("over" if "over" in hits else next(iter(hits), None))
    centers = {r["geo_id"]: (r["lng"], r["lat"]) for r in geo.centroids(shapes).collect()}
    assert centers["over"] == pytest.approx((1.5, 1.5)) and centers["two"] == pytest.approx((6.5, 6.5))
    assert centers["L"] == pytest.approx(((4 * 2 + 3 * 0.5) / 7, (4 * 0.5 + 3 * 2.5) / 7))
    sizes = {r["geo_id"]: r["area_m2"] for r in geo.area_size(shapes).collect()}
    assert sizes["over"] == pytest.approx(4 * 111195.08**2, rel=2e-3)


def test_hulls_against_brute_force(spark):
    rng = np.random.default_rng(3)
    points = np.round(rng.normal(0, 1, (400, 2)), 2)
    frame = pd.DataFrame({"g": ["a"] * 400, "longitude": points[:, 0], "latitude": points[:, 1]})
    line = pd.DataFrame({"g": ["line"] * 3, "longitude": [0.0, 1, 2], "latitude": [0.0, 1, 2]})
    rows = spark.createDataFrame(pd.concat([frame, line, line]))
    for slice_rows in (100_000, 20):
        hulls = geo.convex_hulls(rows, "g", slice_rows=slice_rows).toPandas().sort_values("seq")
        corners = hulls[hulls["g"] == "a"][["x", "y"]].to_numpy()
        assert (corners[0] == corners[-1]).all()
        for (ax, ay), (bx, by) in zip(corners[:-1], corners[1:]):
            turn = (bx - ax) * (points[:, 1] - ay) - (by - ay) * (points[:, 0] - ax)
            assert turn.min() > -1e-9
        assert len(hulls[hulls["g"] == "line"]) == 3


def test_nearest_site_with_a_dense_spot_far_away(spark):
    rng = np.random.default_rng(9)
    sites = np.vstack([rng.normal(50, 0.01, (300, 2)), rng.uniform(0, 10, (20, 2)), [[50.0, 50.0]]])
    points = np.vstack([rng.uniform(0, 60, (200, 2)), rng.normal(50, 0.02, (100, 2))])
    names = [f"s{k:03d}" for k in range(len(sites))]
    s = spark.createDataFrame(pd.DataFrame({"label": names, "longitude": sites[:, 0], "latitude": sites[:, 1]}))
    p = spark.createDataFrame(pd.DataFrame({"id": range(len(points)), "longitude": points[:, 0], "latitude": points[:, 1]}))
    found = {r["id"]: r["label"] for r in geo.nearest_site(p, s, "id", "label").collect()}
    distance = ((points[:, None, :] - sites[None, :, :]) ** 2).sum(axis=2)
    assert found == {k: names[i] for k, i in enumerate(distance.argmin(axis=1))}


def test_unify_layers_keeps_one_name_space(spark):
    a = spark.createDataFrame([("City", 1, 1, 0.0, 0.0), ("Moon  Area", 1, 1, 1.0, 1.0)], "school string, part_id int, seq int, x double, y double")
    b = spark.createDataFrame([("District 1", 1, 1, 0.0, 0.0)], "council string, part_id int, seq int, x double, y double")
    c = spark.createDataFrame([("Hill", 1, 1, 2.0, 2.0), ("Dale", 1, 1, 3.0, 3.0)], "label string, part_id int, seq int, x double, y double")
    merged = geo.unify_layers({"school": a, "council": b, "label": c}, ("school", "City"), {"label": ["Hill"]})
    assert {r["geo_id"] for r in merged.collect()} == {"Moon Area", "District 1", "Hill"}
    assert same_rows(geo.dissolve(merged).select("geo_id"), merged.select("geo_id"))
