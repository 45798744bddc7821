"""The tables behind charts: histograms, densities, box summaries, grids, trends.

Rows are reduced to bins by one aggregation. Everything after that works on
the bins, whose number is fixed by the grid and not by the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelmill.functions.numeric import log10_positive
from parcelmill.operators.aggregates import count_by, iqr, quantiles
from parcelmill.operators.factors import level_order
from parcelmill.operators.relational import complete_counts
from parcelmill.runtime import lookup_join, settle


def _scaled(df: DataFrame, column: str, log10: bool) -> DataFrame:
    """A log axis transforms the data first, so rows without a logarithm drop out."""
    value = log10_positive(F.col(column)) if log10 else F.col(column).cast("double")
    return df.withColumn("__x", value).where(F.col("__x").isNotNull())


def _bounds(data: DataFrame, keys: Sequence[str]) -> DataFrame:
    return data.groupBy(*keys).agg(
        F.min("__x").alias("__lo"), F.max("__x").alias("__hi"), F.count(F.lit(1)).alias("__n")
    )


def _attach(data: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join group statistics, or read a one-row table as a scalar."""
    if keys:
        return lookup_join(data, stats, keys)
    packed = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    return data.withColumn("__s", packed).select("*", "__s.*").drop("__s")


def histogram(
    df: DataFrame,
    column: str,
    keys: Sequence[str] = (),
    bins: int = 30,
    width: float | None = None,
    width_table: DataFrame | None = None,
    log10: bool = False,
    fill: bool = True,
) -> DataFrame:
    """Counts in equal bins centred on multiples of the width, closed on the right.

    The width is (max - min) / (bins - 1) of the group, a fixed ``width``, or
    ``__w`` per group from ``width_table``. With ``fill``, bins between the first
    and the last that hold nothing are listed with a zero.
    """
    keys = list(keys)
    data = _scaled(df.select(*keys, column), column, log10)
    if width is not None:
        sized = data.withColumn("__w", F.lit(float(width)))
    elif width_table is not None:
        sized = _attach(data, width_table, keys)
    else:
        stats = _bounds(data, keys)
        spread = (F.col("__hi") - F.col("__lo")) / F.lit(float(bins - 1))
        sized = _attach(data, stats.select(*keys, spread.alias("__w")), keys)
    step = F.when(F.col("__w") > 0, F.col("__w")).otherwise(F.lit(1.0))
    slot = F.ceil(F.col("__x") / step - 0.5).cast("long")
    counts = sized.groupBy(*keys, step.alias("width"), slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    if fill:
        counts = settle(counts)
        ends = counts.groupBy(*keys, "width").agg(F.min("bin").alias("a"), F.max("bin").alias("b"))
        grid = ends.select(*keys, "width", F.explode(F.sequence("a", "b")).alias("bin"))
        counts = lookup_join(grid, counts, [*keys, "width", "bin"], base_table=True)
        counts = counts.withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    center = F.col("bin") * F.col("width")
    return counts.select(*keys, "bin", center.alias("center"), "width", "n")


def iqr_histogram(df: DataFrame, column: str, keys: Sequence[str] = (), parts: int = 10, **options) -> DataFrame:
    """Histogram whose width is the inter-quartile range divided by ``parts``."""
    spread = iqr(df, keys, column, "__iqr")
    widths = spread.select(*keys, (F.col("__iqr") / parts).alias("__w"))
    return histogram(df, column, keys, width_table=widths, **options)


def pretty_histogram(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Histogram on round breaks (1, 2 or 5 times a power of ten), about log2(n) + 1 classes."""
    keys = list(keys)
    data = _scaled(df.select(*keys, column), column, False)
    stats = _bounds(data, keys)
    classes = F.greatest(F.ceil(F.log2(F.col("__n").cast("double")) + 1), F.lit(1))
    cell = (F.col("__hi") - F.col("__lo")) / classes
    base = F.pow(F.lit(10.0), F.floor(F.log10(F.when(cell > 0, cell).otherwise(F.lit(1.0)))))
    # A rounder unit is taken while it is nearer to the cell, with a bias of 1.5 to larger units.
    unit = (
        F.when(10 * base - cell < 1.5 * (cell - 5 * base), 10 * base)
        .when(5 * base - cell < 2.75 * (cell - 2 * base), 5 * base)
        .when(2 * base - cell < 1.5 * (cell - base), 2 * base)
        .otherwise(base)
    )
    sized = _attach(data, stats.select(*keys, "__lo", unit.alias("__u")), keys)
    first = F.floor(F.col("__lo") / F.col("__u") + 1e-7)
    slot = F.greatest(F.ceil(F.col("__x") / F.col("__u")) - 1, first).cast("long")
    counts = sized.groupBy(*keys, F.col("__u").alias("width"), slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    low = F.col("bin") * F.col("width")
    return counts.select(*keys, "bin", low.alias("low"), (low + F.col("width")).alias("high"), "n")


def tallest_bin(bins: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return bins.groupBy(*keys).agg(F.max("n").alias("max_count"))


def _bandwidth(data: DataFrame, keys: Sequence[str], factor: float) -> DataFrame:
    """factor * min(sd, IQR / 1.34) * n^(-1/5) next to the group's range and size.

    Without spread the size of the first value stands in, and 1 if that is 0.
    A group of equal values gets a range of a bandwidth on both sides.
    """
    moments = data.groupBy(*keys).agg(
        F.min("__x").alias("__lo"),
        F.max("__x").alias("__hi"),
        F.count(F.lit(1)).alias("__n"),
        F.stddev_samp("__x").alias("__sd"),
    )
    stats = _attach(moments, iqr(data, keys, "__x", "__iqr"), keys)
    robust = F.col("__iqr") / 1.34
    size = F.when(F.abs("__lo") > 0, F.abs("__lo")).otherwise(F.lit(1.0))
    width = F.when(robust > 0, F.least("__sd", robust)).when(F.col("__sd") > 0, F.col("__sd")).otherwise(size)
    sized = stats.withColumn("__bw", F.lit(factor) * width * F.pow(F.col("__n").cast("double"), F.lit(-0.2)))
    flat = F.when(F.col("__lo") == F.col("__hi"), F.col("__bw")).otherwise(F.lit(0.0))
    return sized.select(*keys, (F.col("__lo") - flat).alias("__lo"), (F.col("__hi") + flat).alias("__hi"), "__n", "__bw")


def _split_weight(position: Column, last: int) -> Column:
    """A row's share of its two neighbouring grid points."""
    left = F.least(F.greatest(F.floor(position), F.lit(0)), F.lit(last - 1)).cast("int")
    right_share = position - left
    return F.array(
        F.struct(left.alias("i"), (1.0 - right_share).alias("w")),
        F.struct((left + 1).alias("i"), right_share.alias("w")),
    )


def density(
    df: DataFrame, column: str, keys: Sequence[str] = (), points: int = 512, log10: bool = False
) -> DataFrame:
    """Gaussian kernel density on ``points`` grid points over each group's range.

    Rows are first shared out linearly between their two grid points; the kernel
    then runs from grid point to grid point.
    """
    keys = list(keys)
    data = _scaled(df.select(*keys, column), column, log10)
    stats = settle(_bandwidth(data, keys, 0.9))
    sized = _attach(data, stats, keys)
    last = points - 1
    place = (F.col("__x") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * last
    carried = [*keys, "__lo", "__hi", "__n", "__bw"]
    shares = sized.select(
        *carried, F.explode(_split_weight(place, last)).alias("s")
    )
    grid = shares.groupBy(*carried, F.col("s.i").alias("i")).agg(F.sum("s.w").alias("w"))
    step = (F.col("__hi") - F.col("__lo")) / last
    spread = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("j"))
    offset = (F.col("j") - F.col("i")) * step / F.col("__bw")
    kernel = F.col("w") * F.exp(-0.5 * offset * offset)
    total = spread.groupBy(*carried, "j").agg(F.sum(kernel).alias("k"))
    scale = F.col("__n") * F.col("__bw") * math.sqrt(2 * math.pi)
    return total.select(
        *keys,
        F.col("j").cast("long").alias("point"),
        (F.col("__lo") + F.col("j") * step).alias("x"),
        (F.col("k") / scale).alias("density"),
    )


def density_2d(
    df: DataFrame,
    x: str,
    y: str,
    keys: Sequence[str] = (),
    points: int = 100,
    bands: int = 10,
    log10: tuple[bool, bool] = (False, False),
) -> DataFrame:
    """Gaussian density of two columns on a square grid, scaled to a maximum of one.

    The kernel is a product, so the grid is smoothed along one axis and then
    along the other. ``band`` is the filled contour level from 1 to ``bands``.
    """
    keys = list(keys)
    last = points - 1
    data = df.select(*keys, x, y)
    for column, name, logs in ((x, "__a", log10[0]), (y, "__b", log10[1])):
        data = _scaled(data, column, logs).withColumnRenamed("__x", name)
    data = data.select(*keys, "__a", "__b")
    stats = None
    for name in ("__a", "__b"):
        one = _bandwidth(data.withColumnRenamed(name, "__x"), keys, 1.06).withColumnsRenamed(
            {"__lo": f"{name}_lo", "__hi": f"{name}_hi", "__bw": f"{name}_bw", "__n": f"{name}_n"}
        )
        stats = one if stats is None else _attach(stats, one, keys)
    stats = settle(stats)
    sized = _attach(data, stats, keys)

    def cell(name: str) -> Column:
        span = F.col(f"{name}_hi") - F.col(f"{name}_lo")
        return F.floor((F.col(name) - F.col(f"{name}_lo")) / span * last + 0.5).cast("int")

    carried = [*keys, *[c for c in stats.columns if c not in keys]]
    grid = sized.groupBy(*carried, cell("__a").alias("i"), cell("__b").alias("j")).agg(
        F.count(F.lit(1)).cast("double").alias("w")
    )

    def smooth(cells: DataFrame, axis: str, name: str) -> DataFrame:
        step = (F.col(f"{name}_hi") - F.col(f"{name}_lo")) / last
        other = "j" if axis == "i" else "i"
        spread = cells.select(*carried, axis, other, "w", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("t"))
        offset = (F.col("t") - F.col(axis)) * step / F.col(f"{name}_bw")
        summed = F.sum(F.col("w") * F.exp(-0.5 * offset * offset)).alias("w")
        return spread.groupBy(*carried, F.col("t").alias(axis), other).agg(summed)

    smoothed = settle(smooth(smooth(grid, "i", "__a"), "j", "__b"))
    peak = smoothed.groupBy(*keys).agg(F.max("w").alias("__peak"))
    out = _attach(smoothed, peak, keys)
    level = F.col("w") / F.col("__peak")
    at = {
        name: F.col(f"{name}_lo") + F.col(axis) * (F.col(f"{name}_hi") - F.col(f"{name}_lo")) / last
        for name, axis in (("__a", "i"), ("__b", "j"))
    }
    return out.select(
        *keys,
        F.col("i").cast("long").alias("ix"),
        F.col("j").cast("long").alias("iy"),
        at["__a"].alias("x"),
        at["__b"].alias("y"),
        level.alias("ndensity"),
        F.least(F.floor(level * bands) + 1, F.lit(bands)).cast("long").alias("band"),
    )


def box_summary(
    df: DataFrame, keys: Sequence[str], column: str, log10: bool = False, **options
) -> DataFrame:
    """Box-plot numbers per group: quartiles, whiskers at 1.5 IQR, outliers, group size."""
    keys = list(keys)
    data = _scaled(df.select(*keys, column), column, log10)
    boxes = quantiles(data, keys, "__x", {"q1": 0.25, "median": 0.5, "q3": 0.75}, **options)
    boxes = settle(boxes)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    low, high = F.col("q1") - reach, F.col("q3") + reach
    inside = F.col("__x").between(low, high)
    joined = _attach(data, boxes, keys)
    return joined.groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("__x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("__x"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(1)).cast("long").alias("n_outliers"),
        F.count(F.lit(1)).alias("n"),
    )


def bar_table(df: DataFrame, category: str, by: str | None = None) -> DataFrame:
    """Counts per category with a level rank: by the count, or by the median of ``by``."""
    counts = count_by(df, category)
    if by is None:
        return level_order(counts, category, "n", F.max).withColumnRenamed("stat", "n")
    order = level_order(df, category, by).select(category, "level_rank")
    return lookup_join(counts, order, [category])


def heatmap(df: DataFrame, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts on the full grid of two categories, zeros included."""
    return complete_counts(count_by(df, *by, first, second), first, second, by)


def trend(
    df: DataFrame,
    x: str,
    y: str,
    keys: Sequence[str] = (),
    points: int = 80,
    bins: int = 512,
    span: float = 0.1,
    log10_x: bool = False,
) -> DataFrame:
    """Local-linear trend of y on ``points`` grid points per group.

    Rows are summed up in ``bins`` slices of x. The kernel has a standard
    deviation of ``span`` times the group's range; its weight is that of the
    slice centre, the sums inside a slice are exact.
    """
    keys = list(keys)
    data = _scaled(df.select(*keys, x, y).where(F.col(y).isNotNull()), x, log10_x)
    stats = settle(_bounds(data, keys)).where(F.col("__hi") > F.col("__lo"))
    sized = _attach(data, stats, keys).where(F.col("__hi").isNotNull())
    carried = [*keys, "__lo", "__hi"]
    width = F.col("__hi") - F.col("__lo")
    # Positions run from zero to one, which keeps the normal equations well scaled.
    u = (F.col("__x") - F.col("__lo")) / width
    slot = F.least(F.floor(u * bins), F.lit(bins - 1)).cast("int")
    v = F.col(y).cast("double")
    slices = sized.groupBy(*carried, slot.alias("i")).agg(
        F.count(F.lit(1)).cast("double").alias("s0"),
        F.sum(u).alias("s1"),
        F.sum(u * u).alias("s2"),
        F.sum(v).alias("t0"),
        F.sum(u * v).alias("t1"),
    )
    spread = slices.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("p"))
    at = F.col("p") / F.lit(float(points - 1))
    gap = ((F.col("i") + 0.5) / bins - at) / span
    weight = F.exp(-0.5 * gap * gap)
    sums = spread.groupBy(*carried, "p").agg(
        *[F.sum(weight * F.col(c)).alias(c) for c in ("s0", "s1", "s2", "t0", "t1")]
    )
    determinant = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    slope = F.try_divide(F.col("s0") * F.col("t1") - F.col("s1") * F.col("t0"), determinant)
    level = F.try_divide(F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1"), determinant)
    return sums.select(
        *keys,
        F.col("p").cast("long").alias("point"),
        (F.col("__lo") + at * width).alias("x"),
        (level + slope * at).alias("y"),
    )


def rescale(df: DataFrame, column: str, name: str = "scaled") -> DataFrame:
    """Scale a small table's metric to [0, 1] for a colour scale."""
    df = settle(df)
    ends = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")).alias("b")).scalar()
    return df.withColumn(name, F.try_divide(F.col(column) - ends["lo"], ends["hi"] - ends["lo"]))


def scatter(df: DataFrame, *columns: str) -> DataFrame:
    """Pairs for a point layer: every row with all coordinates present."""
    return df.select(*columns).dropna()


