"""Row-level group statistics, samples and ranks without hot groups."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelmill.operators.aggregates import count_by, mean_sd
from parcelmill.operators.relational import with_group_aggregate
from parcelmill.runtime import lookup_join, settle


SLICE_ROWS = 1_000_000


def add_count(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Group size on each row."""
    return with_group_aggregate(df, keys, **{name: F.count(F.lit(1))})


def keep_frequent(df: DataFrame, key: str, more_than: int, name: str = "n") -> DataFrame:
    """Rows of categories with more than a number of rows, with that number."""
    return add_count(df, key, name=name).where(F.col(name) > more_than)


def zscore(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Standardise within a group by the sample sd; NULL for constant or one-row groups."""
    stats = mean_sd(df, keys, column, "__z")
    joined = lookup_join(df, stats, keys)
    score = F.try_divide(F.col(column) - F.col("__z_mean"), F.col("__z_sd"))
    return joined.withColumn(name, score).drop("__z_mean", "__z_sd")


def zscore_from(df: DataFrame, summary: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Standardise by stored ``<column>_mean`` and ``<column>_sd``."""
    joined = lookup_join(df, summary, keys)
    score = F.try_divide(F.col(column) - F.col(f"{column}_mean"), F.col(f"{column}_sd"))
    return joined.withColumn(name, score).drop(f"{column}_mean", f"{column}_sd")


def hash_order(seed: int, row_id: str) -> Column:
    """A repeatable pseudo-random sort key of a row id."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row_id).cast("string")))


def sample_per_group(df: DataFrame, keys: Sequence[str], n: int, row_id: str, seed: int) -> DataFrame:
    """``n`` repeatable random rows per group.

    Ranked first in 256 hash slices of each group, then over the at most
    ``256 * n`` survivors; the first ``n`` of a group are first in their slice too.
    """
    ranked = df.withColumn("__h", hash_order(seed, row_id)).withColumn("__slice", F.substring("__h", 1, 2))
    order = ["__h", F.col(row_id).cast("string")]
    for part in ([*keys, "__slice"], list(keys)):
        window = Window.partitionBy(*part).orderBy(*order)
        ranked = ranked.withColumn("__r", F.row_number().over(window)).where(F.col("__r") <= n)
    return ranked.drop("__h", "__slice", "__r")


def slice_digits(df: DataFrame) -> int:
    """Leading hex digits of a hash that cut the rows into slices of at most about a million."""
    return max(2, math.ceil(math.log(max(df.count(), 1) / SLICE_ROWS, 16)))


def hash_rank(
    df: DataFrame,
    row_id: str,
    seed: int,
    keys: Sequence[str] = (),
    name: str = "rank",
    digits: int | None = None,
) -> DataFrame:
    """Exact rank (from 1) of each row in hash order, over the table or within ``keys``.

    The hash is even, so its leading hex digits cut the rows into equal slices.
    Slice sizes are counted and summed up first; the ranking itself then runs
    slice by slice. ``digits`` is chosen so that a slice has about a million rows
    at most. ``row_id`` must tell the rows apart.
    """
    if digits is None:
        digits = slice_digits(df)
    hashed = df.withColumn("__h", hash_order(seed, row_id)).withColumn("__slice", F.substring("__h", 1, digits))
    sizes = hashed.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__c"))
    # 16 ** digits rows per key.
    upto = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__slice")
    offsets = sizes.withColumn("__before", F.sum("__c").over(upto) - F.col("__c")).drop("__c")
    joined = lookup_join(hashed, offsets, [*keys, "__slice"])
    inside = Window.partitionBy(*keys, "__slice").orderBy("__h", F.col(row_id).cast("string"))
    rank = (F.col("__before") + F.row_number().over(inside)).cast("long")
    return joined.withColumn(name, rank).drop("__h", "__slice", "__before")


def rank_within(df: DataFrame, keys: Sequence[str], *order: Column, name: str = "position") -> DataFrame:
    """Position within a facet of a small aggregate (terms, levels)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window).cast("long"))


def parent_child_counts(df: DataFrame, parent: str, child: str, total: str = "parent_total") -> DataFrame:
    """Counts of (parent, child) ordered by the parent's total, then the child's count."""
    counts = settle(count_by(df, parent, child))
    totals = counts.groupBy(parent).agg(F.sum("n").alias(total))
    return lookup_join(counts, totals, [parent]).orderBy(F.desc(total), parent, F.desc("n"), child)


def global_row_number(df: DataFrame, *order: Column, name: str = "position", slices: int = 200) -> DataFrame:
    """Row number over a global order without a single-task window.

    Rows are range-partitioned by the order and written once; partition sizes
    give the offset of every partition.
    """
    ranged = settle(df.repartitionByRange(slices, *order).withColumn("__pid", F.spark_partition_id()))
    upto = Window.orderBy("__pid")
    sizes = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__c"))
    offsets = sizes.withColumn("__before", F.sum("__c").over(upto) - F.col("__c")).drop("__c")
    joined = lookup_join(ranged, offsets, ["__pid"])
    inside = Window.partitionBy("__pid").orderBy(*order)
    number = (F.col("__before") + F.row_number().over(inside)).cast("long")
    return joined.withColumn(name, number).drop("__pid", "__before")
