"""Points, polygon areas and grids, on plain coordinate columns.

Polygons are vertex rows ``(geo_id, part_id, seq, x, y)`` with closed rings.
Points carry ``longitude`` and ``latitude`` unless told otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelmill.operators.relational import bind_rows, exactly_one
from parcelmill.functions.text import squish
from parcelmill.runtime import BROADCAST_ROWS, fits, lookup_join, settle

EARTH_RADIUS_M = 6_371_008.8


def points(df: DataFrame, lng: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Rows with usable coordinates in degrees."""
    return df.where(F.col(lng).between(-180, 180) & F.col(lat).between(-90, 90))


# --- polygons ----------------------------------------------------------------


def edges(vertices: DataFrame) -> DataFrame:
    """One row per ring edge: each vertex with its successor."""
    ring = Window.partitionBy("geo_id", "part_id").orderBy("seq")
    after = vertices.select(
        "geo_id",
        "part_id",
        "seq",
        F.col("x").alias("x1"),
        F.col("y").alias("y1"),
        F.lead("x").over(ring).alias("x2"),
        F.lead("y").over(ring).alias("y2"),
    )
    return after.where(F.col("x2").isNotNull())


def dissolve(vertices: DataFrame) -> DataFrame:
    """Number the rings of each area anew; an area is inside any of its parts."""
    parts = vertices.select("geo_id", "layer", "part_id").distinct() if "layer" in vertices.columns else (
        vertices.select("geo_id", "part_id").distinct()
    )
    old = [c for c in parts.columns if c != "geo_id"]
    order = Window.partitionBy("geo_id").orderBy(*old)
    numbered = parts.withColumn("__new", F.row_number().over(order))
    joined = lookup_join(vertices, numbered, ["geo_id", *old])
    return joined.drop(*old).withColumnRenamed("__new", "part_id").select(
        "geo_id", "part_id", "seq", "x", "y"
    )


def centroids(vertices: DataFrame) -> DataFrame:
    """Area-weighted centroid of each area over all its parts."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    sums = edges(vertices).groupBy("geo_id", "part_id").agg(
        F.sum(cross).alias("a"),
        F.sum((F.col("x1") + F.col("x2")) * cross).alias("sx"),
        F.sum((F.col("y1") + F.col("y2")) * cross).alias("sy"),
    )
    turn = F.signum("a")
    return sums.groupBy("geo_id").agg(
        F.try_divide(F.sum(turn * F.col("sx")), 3 * F.sum(turn * F.col("a"))).alias("lng"),
        F.try_divide(F.sum(turn * F.col("sy")), 3 * F.sum(turn * F.col("a"))).alias("lat"),
    )


def area_size(vertices: DataFrame) -> DataFrame:
    """Square metres of each area, on a plane scaled at the ring's middle latitude."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    parts = edges(vertices).groupBy("geo_id", "part_id").agg(
        F.abs(F.sum(cross) / 2).alias("a"), ((F.min("y1") + F.max("y1")) / 2).alias("mid")
    )
    metres = (math.pi / 180 * EARTH_RADIUS_M) ** 2
    square = F.col("a") * F.cos(F.radians("mid")) * metres
    return parts.groupBy("geo_id").agg(F.sum(square).alias("area_m2"))


def unify_layers(
    layers: dict[str, DataFrame], drop: tuple[str, str], keep: dict[str, Sequence[str]]
) -> DataFrame:
    """Merge vertex layers with different name columns into one ``geo_id`` space.

    ``layers`` maps a name column to its vertex table; ``drop`` names the
    container area to leave out; ``keep`` restricts a layer to some areas.
    """
    chosen = []
    for column, table in layers.items():
        if column == drop[0]:
            table = table.where(F.col(column) != drop[1])
        if column in keep:
            table = table.where(F.col(column).isin(*keep[column]))
        chosen.append(table.withColumn("layer", F.lit(column)))
    merged = bind_rows(*chosen)
    name = squish(exactly_one(*[F.col(c) for c in layers]))
    return merged.select(name.alias("geo_id"), "layer", "part_id", "seq", "x", "y")


def _crosses(edge: Column, x: Column, y: Column) -> Column:
    """Does a ray from (x, y) to the right cross this edge?"""
    at = F.try_divide((edge["x2"] - edge["x1"]) * (y - edge["y1"]), edge["y2"] - edge["y1"])
    return ((edge["y1"] > y) != (edge["y2"] > y)) & (x < at + edge["x1"])


def area_index(vertices: DataFrame, step: float) -> DataFrame:
    """Cells of a square grid that a ring's box touches, with the edges of that row of cells.

    A horizontal ray only meets edges of its own row, so each cell carries no others.
    """
    sides = settle(edges(vertices))
    ring = ["geo_id", "part_id"]
    box = sides.groupBy(*ring).agg(
        F.floor(F.min(F.least("x1", "x2")) / step).alias("cx0"),
        F.floor(F.max(F.greatest("x1", "x2")) / step).alias("cx1"),
    )
    rows = sides.select(
        *ring,
        F.explode(
            F.sequence(F.floor(F.least("y1", "y2") / step), F.floor(F.greatest("y1", "y2") / step))
        ).alias("cell_y"),
        F.struct("x1", "y1", "x2", "y2").alias("edge"),
    )
    bands = rows.groupBy(*ring, "cell_y").agg(F.collect_list("edge").alias("edges"))
    placed = lookup_join(bands, box, ring)
    return placed.select(
        *ring, F.explode(F.sequence("cx0", "cx1")).alias("cell_x"), "cell_y", "edges"
    )


def assign_areas(
    df: DataFrame,
    vertices: DataFrame,
    step: float = 0.05,
    lng: str = "longitude",
    lat: str = "latitude",
    how: str = "left",
    max_cells: int = BROADCAST_ROWS,
) -> DataFrame:
    """Spatial join: each point with every area that contains it.

    A point in two areas appears twice, a point in none keeps a NULL ``geo_id``.
    The grid cell makes it an equi-join and the exact test is a condition of the
    join, so no candidate pair is written out. A small index is broadcast; a
    larger one is joined on the cell plus a salt.
    """
    spots = df.withColumns(
        {
            "__cx": F.floor(F.col(lng) / step),
            "__cy": F.floor(F.col(lat) / step),
        }
    )
    index = settle(area_index(vertices, step)).select(
        F.col("geo_id").alias("__area"), F.col("cell_x").alias("__ix"), F.col("cell_y").alias("__iy"), "edges"
    )
    hits = F.size(F.filter("edges", lambda e: _crosses(e, F.col(lng), F.col(lat))))
    match = (F.col("__cx") == F.col("__ix")) & (F.col("__cy") == F.col("__iy")) & (hits % 2 == 1)
    helpers = ["__cx", "__cy", "__ix", "__iy", "edges"]
    if fits(index.withColumn("edges", F.to_json("edges")), max_cells):
        index = F.broadcast(index)
    joined = spots.join(index, match, how).drop(*helpers)
    return joined.drop("geo_id").withColumnRenamed("__area", "geo_id")


def first_area(
    df: DataFrame, vertices: DataFrame, order: DataFrame, row_id: str, **options
) -> DataFrame:
    """Resolve overlaps: each point belongs to the first area, by declared rank, that holds it."""
    ranked = lookup_join(assign_areas(df, vertices, **options), order, ["geo_id"])
    return ranked.groupBy(row_id).agg(
        F.min_by("geo_id", F.struct(F.coalesce("area_rank", F.lit(2**31 - 1)), "geo_id")).alias("geo_id")
    )


# --- hulls -------------------------------------------------------------------


def _turns(points_xy: np.ndarray) -> list[tuple[float, float]]:
    """One side of a convex hull of points sorted by x, then y."""
    side: list[tuple[float, float]] = []
    for x, y in points_xy:
        while len(side) > 1:
            (ax, ay), (bx, by) = side[-2], side[-1]
            if (bx - ax) * (y - ay) - (by - ay) * (x - ax) > 0:
                break
            side.pop()
        side.append((float(x), float(y)))
    return side


def _hull(frame: pd.DataFrame) -> list[tuple[float, float]]:
    ordered = frame[["x", "y"]].drop_duplicates().sort_values(["x", "y"]).to_numpy()
    if len(ordered) < 3:
        return [tuple(map(float, p)) for p in ordered]
    return _turns(ordered)[:-1] + _turns(ordered[::-1])[:-1]


def convex_hulls(
    df: DataFrame, key: str, lng: str = "longitude", lat: str = "latitude", slice_rows: int = 100_000
) -> DataFrame:
    """Closed hull ring of each group's points as vertex rows, counter-clockwise.

    Only the lowest and highest point of each x can be a corner, so the rows are
    reduced to those first. Hash slices of about ``slice_rows`` points give partial
    hulls, whose corners alone meet in the last step.
    """
    ends = df.where(F.col(lng).isNotNull() & F.col(lat).isNotNull()).groupBy(key, F.col(lng).alias("x")).agg(
        F.min(lat).alias("lo"), F.max(lat).alias("hi")
    )
    corners = ends.select(key, "x", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("y"))
    key_type = df.schema[key].dataType.simpleString()

    def part(frame: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(_hull(frame), columns=["x", "y"])
        out.insert(0, key, frame[key].iloc[0])
        return out

    def ring(frame: pd.DataFrame) -> pd.DataFrame:
        found = _hull(frame)
        out = pd.DataFrame(found + found[:1], columns=["x", "y"])
        out.insert(0, key, frame[key].iloc[0])
        out.insert(1, "part_id", np.int32(1))
        out.insert(2, "seq", np.arange(1, len(out) + 1, dtype="int32"))
        return out

    corners = settle(corners)
    sizes = corners.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    counted = lookup_join(corners, sizes, [key])
    slot = F.pmod(F.xxhash64("x", "y"), F.ceil(F.col("__n") / F.lit(float(slice_rows))))
    partial = counted.select(key, "x", "y", slot.alias("slot")).groupBy(key, "slot")
    corners = partial.applyInPandas(part, f"{key} {key_type}, x double, y double")
    full = f"{key} {key_type}, part_id int, seq int, x double, y double"
    return corners.groupBy(key).applyInPandas(ring, full)


# --- nearest site and grids --------------------------------------------------


def _site_spacing(places: DataFrame, reach: float, few: int = 32, halvings: int = 24) -> float:
    """The widest cell, by halving the map, in which no cell has more than ``few`` sites."""
    if reach == 0:
        return 1.0
    width = F.lit(reach) / F.pow(F.lit(2.0), F.col("level"))
    crowd = (
        places.select("sx", "sy", F.explode(F.sequence(F.lit(0), F.lit(halvings))).alias("level"))
        .groupBy("level", F.floor(F.col("sx") / width).alias("x"), F.floor(F.col("sy") / width).alias("y"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("level")
        .agg(F.max("n").alias("peak"))
    )
    level = crowd.where(F.col("peak") <= few).agg(F.min("level")).first()[0]
    return reach / 2.0 ** (halvings if level is None else level)


def nearest_site(
    df: DataFrame,
    sites: DataFrame,
    row_id: str,
    label: str,
    step: float | None = None,
    lng: str = "longitude",
    lat: str = "latitude",
) -> DataFrame:
    """Label of the closest site for every point (the cell of the point in a Voronoi map).

    Sites are looked up in the 3 x 3 cells around the point. A hit no farther
    than one cell width is final. Points without one go on with cells twice as
    wide, until the cells are wider than the whole map. Ties take the smallest label.
    The first width is the widest one that leaves few sites in any cell, so a dense
    spot is settled in narrow cells and its sites never all meet its points.
    """
    places = settle(
        sites.groupBy(F.col(lng).alias("sx"), F.col(lat).alias("sy")).agg(F.min(label).alias(label))
    )
    todo = settle(df.select(row_id, F.col(lng).alias("px"), F.col(lat).alias("py")))
    ends = places.select(F.col("sx").alias("x"), F.col("sy").alias("y")).union(todo.select("px", "py"))
    span = ends.agg(
        (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")
    ).first()
    reach = math.hypot(span["w"] or 0.0, span["h"] or 0.0)
    near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    step = step or _site_spacing(places, reach)
    done = []
    while True:
        around = (
            places.withColumn("dx", F.explode(near))
            .withColumn("dy", F.explode(near))
            .select(
                (F.floor(F.col("sx") / step) + F.col("dx")).alias("__cx"),
                (F.floor(F.col("sy") / step) + F.col("dy")).alias("__cy"),
                "sx",
                "sy",
                label,
            )
        )
        cells = todo.withColumns({"__cx": F.floor(F.col("px") / step), "__cy": F.floor(F.col("py") / step)})
        joined = lookup_join(cells, around, ["__cx", "__cy"], "left")
        square = F.pow(F.col("px") - F.col("sx"), 2) + F.pow(F.col("py") - F.col("sy"), 2)
        best = F.struct(square.alias("d2"), F.col(label))
        picked = settle(
            joined.groupBy(row_id, "px", "py").agg(
                F.min(F.when(F.col("sx").isNotNull(), best)).alias("best")
            )
        )
        last = step > reach
        final = F.col("best").isNotNull() & (F.col("best.d2") <= step * step)
        if last:
            final = F.lit(True)
        done.append(picked.where(final).select(row_id, F.col(f"best.{label}").alias(label), F.sqrt("best.d2").alias("distance")))
        todo = picked.where(~final).select(row_id, "px", "py")
        if last or todo.isEmpty():
            return bind_rows(*done)
        step *= 2


def grid_bins(
    df: DataFrame, value: Column, step: float, lng: str = "longitude", lat: str = "latitude"
) -> DataFrame:
    """Count and mean of a value per square grid cell."""
    return (
        df.where(F.col(lng).isNotNull() & F.col(lat).isNotNull())
        .groupBy(
            F.floor(F.col(lng) / step).alias("cell_x"), F.floor(F.col(lat) / step).alias("cell_y")
        )
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"))
    )


def choropleth(areas: DataFrame, metric: DataFrame, value: str) -> DataFrame:
    """Every area with its metric, the metric on [0, 1] and a label."""
    joined = settle(lookup_join(areas, metric, ["geo_id"]))
    ends = joined.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("b")).scalar()
    shade = F.try_divide(F.col(value) - ends["lo"], ends["hi"] - ends["lo"])
    label = F.concat(F.col("geo_id"), F.lit(": "), F.format_number(F.round(value, 0), 0))
    return joined.withColumn("shade", shade).withColumn("label", F.coalesce(label, F.col("geo_id")))


def area_lookup(areas: DataFrame, geo_id: str) -> DataFrame:
    return areas.where(F.col("geo_id") == geo_id)
