"""Projection, filters, joins, set operations and reshaping."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelmill.functions.naming import snake_names
from parcelmill.runtime import lookup_join, settle

# --- columns -----------------------------------------------------------------


def matching(df: DataFrame, pattern: str) -> list[str]:
    """Names that contain a match of ``pattern``."""
    return [name for name in df.columns if re.search(pattern, name)]


def starting_with(df: DataFrame, *prefixes: str) -> list[str]:
    return [name for name in df.columns if name.startswith(prefixes)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def front(df: DataFrame, *names: str) -> DataFrame:
    """Listed columns first, then the rest in their order."""
    return df.select(*names, *[c for c in df.columns if c not in names])


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    return df.drop(*matching(df, pattern))


def clean_names(df: DataFrame, prefixes: list[tuple[str, str]] | None = None) -> DataFrame:
    return df.toDF(*snake_names(df.columns, prefixes))


def across(df: DataFrame, names: Iterable[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Apply one column function to several columns."""
    return df.withColumns({name: fn(F.col(name)) for name in names})


def drop_missing(df: DataFrame, *names: str) -> DataFrame:
    """Keep rows where the listed columns (all, when none is listed) are present."""
    return df.dropna(subset=list(names) or None)


def where_equals(df: DataFrame, column: str, goal: Column) -> DataFrame:
    """Distinct values of a column equal to a scalar (``table.scalar()``).

    An interpolated quantile may equal no row, then the result is empty.
    """
    return df.where(F.col(column) == goal).select(column).distinct()


# --- joins -------------------------------------------------------------------


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [name for name in left.columns if name in set(right.columns)]


def natural_left_join(left: DataFrame, right: DataFrame, **options) -> DataFrame:
    """Left join on every column both tables have."""
    return lookup_join(left, right, common_columns(left, right), "left", **options)


def semi_join(left: DataFrame, right: DataFrame, on, **options) -> DataFrame:
    """Rows of ``left`` with a match. Only the distinct keys of ``right`` move."""
    return _filter_join(left, right, on, "left_semi", **options)


def anti_join(left: DataFrame, right: DataFrame, on, **options) -> DataFrame:
    """Rows of ``left`` without a match."""
    return _filter_join(left, right, on, "left_anti", **options)


def _filter_join(left: DataFrame, right: DataFrame, on, how: str, **options) -> DataFrame:
    names = [key if isinstance(key, str) else key[1] for key in on]
    return lookup_join(left, right.select(*names).distinct(), on, how, **options)


def reconcile_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Keys found on one side only, labelled ``left_only`` or ``right_only``."""
    a = left.select(F.col(left_key).alias("key"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = right.select(F.col(right_key).alias("key"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    sides = a.unionByName(b).groupBy("key").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    label = F.when(F.col("b") == 0, F.lit("left_only")).otherwise(F.lit("right_only"))
    return sides.where(F.col("a") + F.col("b") == 1).select("key", label.alias("side"))


def with_group_aggregate(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Attach aggregates of each row's group (pre-aggregated, joined back)."""
    stats = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in aggregates.items()])
    return lookup_join(df, stats, keys)


# --- set operations ----------------------------------------------------------


def bind_rows(*tables: DataFrame) -> DataFrame:
    """Union all by name; columns a table lacks are filled with NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def bind_labelled(tables: dict[str, DataFrame], label: str = "model") -> DataFrame:
    return bind_rows(*[df.withColumn(label, F.lit(name)) for name, df in tables.items()])


def exactly_one(*columns: Column) -> Column:
    """The value of the one column that is present; NULL when none or several are."""
    present = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns])
    return F.when(present == 1, F.coalesce(*columns))


def repair_rows(
    df: DataFrame, broken: Column, key: str, fix: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Take out rows whose key has a broken row, repair those rows and append them."""
    rows = settle(df)
    bad = rows.where(broken)
    return bind_rows(anti_join(rows, bad, [key]), fix(bad))


# --- reshaping ---------------------------------------------------------------


def longer(
    df: DataFrame,
    ids: Sequence[str],
    values: Sequence[str] | None = None,
    name: str = "name",
    value: str = "value",
    as_type: str | None = None,
) -> DataFrame:
    """Columns to rows; all columns but ``ids`` when none are listed."""
    chosen = list(values) if values is not None else [c for c in df.columns if c not in set(ids)]
    if as_type:
        df = df.select(*ids, *[F.col(f"`{c}`").cast(as_type).alias(c) for c in chosen])
    return df.unpivot(list(ids), [F.col(f"`{c}`") for c in chosen], name, value)


def wider(df: DataFrame, ids: Sequence[str], name: str, value: str, levels: Sequence) -> DataFrame:
    """Rows to columns for a declared list of names."""
    return df.groupBy(*ids).pivot(name, list(levels)).agg(F.first(value, ignorenulls=True))


def unnest(df: DataFrame, column: str) -> DataFrame:
    """One row per element of an array of structs, fields as columns."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(column).alias("__row")).select(*rest, "__row.*")


def nest(df: DataFrame, ids: Sequence[str], into: str) -> DataFrame:
    """Collect the other columns of small groups as an ordered array of structs."""
    inner = [c for c in df.columns if c not in set(ids)]
    return df.groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct(*inner))).alias(into))


def enframe(df: DataFrame, column: str) -> DataFrame:
    """One row per array element with its position, counted from one."""
    rest = [c for c in df.columns if c != column]
    out = df.select(*rest, F.posexplode(column).alias("pos", "value"))
    return out.select(*rest, (F.col("pos") + 1).cast("long").alias("name"), "value")


def complete_counts(counts: DataFrame, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """Every seen combination of two categories (within ``by``), missing counts as zero.

    ``counts`` is already one row per combination. The two level lists of a
    group meet in a join on the group keys, so the result has as many rows as the grid.
    """
    counts = settle(counts)
    group = list(by) or ["__all"]
    base = counts if by else counts.withColumn("__all", F.lit(0))
    rows = base.select(*group, first).distinct()
    columns = base.select(*group, second).distinct()
    grid = lookup_join(rows, columns, group, "inner")
    filled = lookup_join(grid, base, [*group, first, second])
    out = filled.select(*group, first, second, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return out if by else out.drop("__all")
