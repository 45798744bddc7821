"""Ordered categories: a level table with ranks, attached where an order is needed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelmill.operators.aggregates import median
from parcelmill.operators.windows import global_row_number
from parcelmill.runtime import at_most, lookup_join, settle

LEVEL_ROWS = 1_000_000


def rank_levels(levels: DataFrame, *order: Column, name: str = "level_rank") -> DataFrame:
    """Number the rows of a level table; a very long one is ranked range by range."""
    levels = settle(levels)
    if at_most(levels, LEVEL_ROWS):
        return levels.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    return global_row_number(levels, *order, name=name)


def level_order(
    df: DataFrame,
    factor: str,
    by: str,
    fun: Callable[[Column], Column] | None = None,
    desc: bool = False,
    name: str = "level_rank",
) -> DataFrame:
    """Levels ranked by a statistic of another column: the median unless ``fun`` builds another."""
    if fun is None:
        stats = median(df, [factor], by, "stat")
    else:
        stats = df.groupBy(factor).agg(fun(F.col(by)).alias("stat"))
    first = F.desc_nulls_last("stat") if desc else F.asc_nulls_last("stat")
    return rank_levels(stats, first, F.asc(factor), name=name)


def reorder(
    df: DataFrame,
    factor: str,
    by: str,
    fun: Callable[[Column], Column] | None = None,
    desc: bool = False,
    name: str = "level_rank",
) -> DataFrame:
    """Attach each row's level rank."""
    ranks = level_order(df, factor, by, fun, desc, name).select(factor, name)
    return lookup_join(df, ranks, [factor])


def reverse(df: DataFrame, name: str = "level_rank") -> DataFrame:
    """Turn the level order round."""
    last = df.agg(F.max(name).alias("last")).scalar()
    return df.withColumn(name, (last + 1 - F.col(name)).cast("long"))


def relevel(levels: DataFrame, factor: str, first: Sequence[str], name: str = "level_rank") -> DataFrame:
    """Listed levels first, the others after them in alphabetical order."""
    place = F.array_position(F.array(*[F.lit(v) for v in first]), F.col(factor))
    listed = F.coalesce(F.nullif(place, F.lit(0)), F.lit(len(first) + 1))
    return rank_levels(levels, listed, F.asc(factor), name=name)


def lump_top(
    counts: DataFrame,
    factor: str,
    n: int,
    weight: str = "n",
    other: str = "Other",
    by: Sequence[str] = (),
) -> DataFrame:
    """Keep the ``n`` heaviest levels (ties share the better rank), pool the rest.

    ``counts`` holds one or more weighted rows per level.
    """
    sums = settle(counts.groupBy(*by, factor).agg(F.sum(weight).alias(weight)))
    window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc(weight))
    ranked = sums.withColumn("__r", F.rank().over(window))
    pooled = F.when(F.col("__r") <= n, F.col(factor)).otherwise(F.lit(other))
    return ranked.groupBy(*by, pooled.alias(factor)).agg(F.sum(weight).alias(weight))


def lump_rare(df: DataFrame, factor: str, fewer_than: int, other: str = "Other") -> DataFrame:
    """Pool levels with fewer rows than a number; a missing level stays missing."""
    sizes = df.groupBy(factor).agg(F.count(F.lit(1)).alias("__n"))
    joined = lookup_join(df, sizes, [factor])
    pooled = F.when((F.col("__n") < fewer_than) & F.col(factor).isNotNull(), F.lit(other))
    return joined.withColumn(factor, pooled.otherwise(F.col(factor))).drop("__n")


def explicit_missing(x: Column, label: str = "(Missing)") -> Column:
    return F.coalesce(x, F.lit(label))


def declared(df: DataFrame, factor: str, levels: Sequence[str], name: str = "level_rank") -> DataFrame:
    """Rank by a declared list; undeclared values become NULL."""
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(factor))
    ranked = df.withColumn(name, F.nullif(place, F.lit(0)))
    return ranked.withColumn(factor, F.when(F.col(name).isNotNull(), F.col(factor)))
