"""Counts, moments, exact quantiles and column profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelmill.operators.relational import anti_join, bind_rows
from parcelmill.runtime import BROADCAST_ROWS, at_most, lookup_join, settle

# A group up to this size may be held by one task; a larger one is narrowed down first.
GROUP_ROWS = 1_000_000
SLICES = 512


def count_by(df: DataFrame, *keys: str, sort: bool = False, name: str = "n") -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return counts.orderBy(F.desc(name), *keys) if sort else counts


def mean_sd(df: DataFrame, keys: Sequence[str], column: str, prefix: str | None = None) -> DataFrame:
    """Mean and sample standard deviation per group, missing values left out."""
    label = prefix or column
    return df.groupBy(*keys).agg(
        F.avg(column).alias(f"{label}_mean"), F.stddev_samp(column).alias(f"{label}_sd")
    )


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    max_group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Exact interpolated quantiles per group, one column per entry of ``probs``.

    The group sizes are counted first. While no group is larger than
    ``max_group_rows`` the built-in aggregate does the work. Larger groups are
    narrowed down instead: each pass leaves under a hundredth of the values around
    a wanted rank, so few passes are needed and no task ever holds such a group.
    """
    keys = list(keys)
    data = df.select(*keys, F.col(value).cast("double").alias("__v"))
    sizes = data.groupBy(*keys).agg(F.count("__v").alias("__n"))
    peak = sizes.agg(F.max("__n")).first()[0] or 0
    if peak <= max_group_rows:
        return _builtin_quantiles(data, keys, probs)
    grouped = keys or ["__all"]
    if not keys:
        data = data.withColumn("__all", F.lit(0))
        sizes = sizes.withColumn("__all", F.lit(0))
    hot = settle(sizes.where(F.col("__n") > max_group_rows).select(*grouped))
    small = _builtin_quantiles(anti_join(data, hot, grouped), grouped, probs)
    large = _narrowed_quantiles(lookup_join(data, hot, grouped, "inner"), grouped, probs, max_group_rows)
    out = bind_rows(small, large)
    return out if keys else out.drop("__all")


def _builtin_quantiles(data: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    wanted = F.array(*[F.lit(float(p)) for p in probs.values()])
    packed = data.groupBy(*keys).agg(F.percentile("__v", wanted).alias("__q"))
    return packed.select(*keys, *[F.col("__q")[i].alias(name) for i, name in enumerate(probs)])


def _narrowed_quantiles(
    data: DataFrame, keys: list[str], probs: dict[str, float], max_group_rows: int
) -> DataFrame:
    """Find order statistics by repeated counting in slices of the remaining range."""
    values = data.where(F.col("__v").isNotNull())
    bounds = values.groupBy(*keys).agg(
        F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.count("__v").alias("n")
    )
    bounds = settle(bounds)
    ranks = []
    for p in probs.values():
        position = (F.col("n") - 1) * F.lit(float(p))
        ranks += [F.floor(position).cast("long"), F.ceil(position).cast("long")]
    open_targets = settle(
        bounds.select(
            *keys,
            F.explode(F.array_distinct(F.array(*ranks))).alias("rank"),
            "lo",
            "hi",
            F.lit(0).cast("long").alias("before"),
            F.col("n").alias("inside"),
        )
        # The first and the last value are known already.
        .withColumns(
            {
                "hi": F.when(F.col("rank") == 0, F.col("lo")).otherwise(F.col("hi")),
                "lo": F.when((F.col("rank") == F.col("inside") - 1) & (F.col("rank") > 0), F.col("hi")).otherwise(F.col("lo")),
            }
        )
    )
    found = []
    small_enough = (F.col("inside") <= max_group_rows) | (F.col("lo") == F.col("hi"))
    while True:
        found.append(open_targets.where(small_enough))
        rest = open_targets.where(~small_enough)
        if rest.isEmpty():
            break
        open_targets = settle(_narrow_once(values, rest, keys))
    targets = settle(bind_rows(*found))
    picked = settle(_pick(values, targets, keys))
    return _interpolate(bounds, picked, keys, probs)


def _in_range(values: DataFrame, targets: DataFrame, keys: list[str], low: str = "lo", high: str = "hi") -> DataFrame:
    joined = lookup_join(values, targets, keys, "inner", base_table=True)
    return joined.where(F.col("__v").between(F.col(low), F.col(high)))


def _narrow_once(values: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Close in on each rank between two values that a sketch puts just below and above it.

    Only the order of values matters, not their distances, so every pass leaves a
    small fixed share of the values: at most three of ``SLICES`` parts and the error
    of the sketch. Values equal to a border are settled at once, so ties cannot keep
    a range large.
    """
    cuts = F.array(*[F.lit(k / SLICES) for k in range(SLICES + 1)])
    target = [*keys, "rank", "before", "inside"]
    # Ranks that are looked for in the same range share its sketch.
    span = [*keys, "lo", "hi", "before", "inside"]
    inside = _in_range(values, targets.select(*span).distinct(), keys)
    sketches = inside.groupBy(*span).agg(F.percentile_approx("__v", cuts, 10_000).alias("cuts"))
    sketched = targets.select(*target, "lo", "hi").join(
        sketches.select(*[F.col(k).alias(f"__b_{k}") for k in keys], F.col("lo").alias("__b_lo"), F.col("hi").alias("__b_hi"), "cuts"),
        _same([*keys, "lo", "hi"]),
    )
    slot = F.floor((F.col("rank") - F.col("before")) / F.col("inside") * SLICES).cast("int")
    borders = sketched.select(
        *target,
        F.col("lo").alias("from"),
        F.col("hi").alias("to"),
        F.col("cuts")[F.greatest(slot - 1, F.lit(0))].alias("lo"),
        F.col("cuts")[F.least(slot + 2, F.lit(SLICES))].alias("hi"),
    )
    borders = settle(borders)
    x = F.col("__v")
    between = (x > F.col("lo")) & (x < F.col("hi"))
    # The border and what lies below it in the present range is counted with it, once for ranks with the same borders.
    span = [*keys, "from", "to", "before", "lo", "hi"]
    each = (
        _in_range(values, borders.select(*span).distinct(), keys, "from", "to")
        .groupBy(*span)
        .agg(
            F.count(F.when(x < F.col("lo"), 1)).alias("below"),
            F.count(F.when(x == F.col("lo"), 1)).alias("at_lo"),
            F.count(F.when(between, 1)).alias("mid"),
            F.min(F.when(between, x)).alias("mid_lo"),
            F.max(F.when(between, x)).alias("mid_hi"),
        )
    )
    named = each.withColumnsRenamed({c: f"__b_{c}" for c in span})
    counted = borders.join(named, _same(span))
    from_lo = F.col("before") + F.col("below")
    from_mid = from_lo + F.col("at_lo")
    from_hi = from_mid + F.col("mid")
    low, middle = F.col("rank") < from_mid, F.col("rank") < from_hi
    return counted.select(
        *keys,
        "rank",
        F.when(low, F.col("lo")).when(middle, F.col("mid_lo")).otherwise(F.col("hi")).alias("lo"),
        F.when(low, F.col("lo")).when(middle, F.col("mid_hi")).otherwise(F.col("hi")).alias("hi"),
        F.when(low, from_lo).when(middle, from_mid).otherwise(from_hi).alias("before"),
        F.when(low, F.col("at_lo")).when(middle, F.col("mid")).otherwise(F.lit(1)).cast("long").alias("inside"),
    )


def _same(keys: list[str]) -> Column:
    match = F.lit(True)
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"__b_{key}"))
    return match


def _pick(values: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    ready = targets.where(F.col("lo") == F.col("hi")).select(*keys, "rank", F.col("lo").alias("x"))
    # Ranks in the same range share the count of its values.
    wide = targets.where(F.col("lo") < F.col("hi"))
    span = [*keys, "lo", "hi", "before"]
    counts = _in_range(values, wide.select(*span).distinct(), keys).groupBy(*span, "__v").agg(F.count("__v").alias("c"))
    # At most max_group_rows values per range.
    upto = Window.partitionBy(*span).orderBy("__v")
    end = F.col("before") + F.sum("c").over(upto)
    wanted = wide.select("rank", *[F.col(c).alias(f"__b_{c}") for c in span])
    wanted = F.broadcast(wanted) if at_most(wanted, BROADCAST_ROWS) else wanted
    placed = counts.withColumn("end", end).join(wanted, _same(span))
    hit = (F.col("end") - F.col("c") <= F.col("rank")) & (F.col("rank") < F.col("end"))
    return bind_rows(ready, placed.where(hit).select(*keys, "rank", F.col("__v").alias("x")))


def _interpolate(
    bounds: DataFrame, picked: DataFrame, keys: list[str], probs: dict[str, float]
) -> DataFrame:
    table = picked.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at")
    )
    joined = lookup_join(bounds, table, keys, base_table=True)
    columns = []
    for name, p in probs.items():
        position = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.floor(position).cast("long"), F.ceil(position).cast("long")
        mixed = (high - position) * F.col("at")[low] + (position - low) * F.col("at")[high]
        columns.append(F.when(low == high, F.col("at")[low]).otherwise(mixed).alias(name))
    return joined.select(*keys, *columns)


def median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median", **options) -> DataFrame:
    """Median per group; missing values are left out."""
    return quantiles(df, keys, value, {name: 0.5}, **options)


def count_and_median(df: DataFrame, keys: Sequence[str], value: str, **options) -> DataFrame:
    return lookup_join(median(df, keys, value, **options), count_by(df, *keys), keys)


def iqr(df: DataFrame, keys: Sequence[str], value: str, name: str = "iqr", **options) -> DataFrame:
    q = quantiles(df, keys, value, {"__q1": 0.25, "__q3": 0.75}, **options)
    return q.select(*keys, (F.col("__q3") - F.col("__q1")).alias(name))


def top_groups_by_sum(df: DataFrame, key: str, value: str, k: int = 3, name: str = "total") -> DataFrame:
    sums = df.groupBy(key).agg(F.sum(value).alias(name))
    return sums.orderBy(F.desc(name), key).limit(k)


def share_of_total(counts: DataFrame, column: str = "n", name: str = "share") -> DataFrame:
    """Each row's part of the column total; the total is a scalar subquery."""
    total = counts.agg(F.sum(column).alias("total")).scalar()
    return counts.withColumn(name, F.try_divide(F.col(column).cast("double"), total))


def allow_list(df: DataFrame, key: str, top: int, extra: Sequence[str]) -> DataFrame:
    """The ``top`` most frequent values plus those of ``extra`` that occur among the rest."""
    counts = settle(count_by(df, key))
    best = counts.orderBy(F.desc("n"), key).limit(top)
    others = anti_join(counts, best, [key]).where(F.col(key).isin(*extra))
    return bind_rows(best, others).select(key)


def recode_counts(df: DataFrame, old: str, new: Column, new_name: str) -> DataFrame:
    """Counts of each (old, new) pair, to check a recode."""
    return df.select(F.col(old), new.alias(new_name)).groupBy(old, new_name).agg(
        F.count(F.lit(1)).alias("n")
    )


def profile(df: DataFrame, max_group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per column: missing, complete rate, distinct, text lengths, moments, quartiles.

    Distinct values are counted as the rows of a distinct (column, value) table,
    which spreads every column over all tasks.
    """
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    texts = df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).unpivot(
        [], df.columns, "column", "text"
    )
    values = texts.groupBy("column", "text").agg(F.count(F.lit(1)).alias("c"))
    is_text = F.array_contains(
        F.array([F.lit(f.name) for f in df.schema.fields if isinstance(f.dataType, T.StringType)] or [F.lit("")]),
        F.col("column"),
    )
    length = F.when(is_text, F.length("text").cast("long"))
    present = F.sum(F.when(F.col("text").isNotNull(), F.col("c")).otherwise(0))
    general = values.groupBy("column").agg(
        (F.sum("c") - present).cast("long").alias("n_missing"),
        (present / F.sum("c")).alias("complete_rate"),
        F.count("text").alias("n_unique"),
        F.min(length).alias("min_length"),
        F.max(length).alias("max_length"),
    )
    numbers = df.select([F.col(f"`{c}`").cast("double").alias(c) for c in numeric]).unpivot(
        [], numeric, "column", "value"
    )
    moments = mean_sd(numbers, ["column"], "value", "x").withColumnsRenamed({"x_mean": "mean", "x_sd": "sd"})
    marks = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1.0}
    spread = quantiles(numbers, ["column"], "value", marks, max_group_rows)
    kinds = df.sparkSession.createDataFrame(
        [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position long, column string, type string",
    )
    out = kinds
    for part in (general, moments, spread):
        out = lookup_join(out, part, ["column"])
    return out


