"""Joins and group statistics: every path gives the same rows, also with one hot key."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from parcelmill.operators import aggregates as agg
from parcelmill.operators import relational as rel
from parcelmill.operators import windows as win
from parcelmill.runtime import big_join, fits, lookup_join
from parcelmill.sources import tables


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows hold one key, a tenth hold none; half the values are copies."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 10 != 1, F.concat(F.lit("k"), F.col("id") % 7))
    value = F.when(F.col("id") % 2 == 0, F.lit(5.0)).otherwise((F.col("id") * 7919 % 1009) / 10.0)
    return spark.range(3000).select("id", key.alias("k"), value.alias("v"), F.lit("x").alias("c"))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("max_rows", [0, 2])
def test_lookup_join_is_the_same_broadcast_or_not(skewed, how, max_rows):
    stats = skewed.groupBy("k").agg(F.count(F.lit(1)).alias("n.rows")).where("k is null or k != 'k2'")
    rows = skewed.withColumn("a.b", F.col("k")).withColumn("m", F.create_map(F.lit("x"), F.col("v")))
    stats = stats.withColumnRenamed("k", "a.b")
    plain = lookup_join(rows, stats, ["a.b"], how).drop("m")
    shuffled = lookup_join(rows, stats, ["a.b"], how, max_rows=max_rows).drop("m")
    assert same_rows(plain.toDF(*[c.replace(".", "_") for c in plain.columns]), shuffled.toDF(*[c.replace(".", "_") for c in plain.columns]))
    expected = skewed.where("k = 'k2'").count()
    assert plain.count() == {"left": 3000, "left_anti": expected}.get(how, 3000 - expected)


def test_equal_rows_of_one_key_join(spark):
    rows = spark.range(1000).select(F.lit("hot").alias("k"), F.lit(1).alias("v"))
    right = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, w int")
    for limit in (0, 100):
        assert [tuple(r) for r in lookup_join(rows, right, ["k"], max_rows=limit).distinct().collect()] == [("hot", 1, 1)]
        assert lookup_join(rows, right, ["k"], max_rows=limit).count() == 1000


def test_fits_counts_rows_and_bytes(spark):
    rows = spark.createDataFrame([("x" * 1000,), (None,)], "t string")
    assert fits(rows) and not fits(rows, rows=1) and not fits(rows, size=500) and not fits(rows, rows=0)
    assert fits(rows.limit(0))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_big_join_of_hot_keys(skewed, spark, how):
    right = spark.createDataFrame([("hot", 1), ("k1", 2), (None, 3), ("zz", 4)], "k string, w int")
    plain = big_join(skewed, right, ["k"], how)
    shuffled = big_join(skewed, right, ["k"], how, max_rows=0)
    assert same_rows(plain, shuffled)


def test_semi_and_anti_split_the_rows(skewed, spark):
    keys = spark.createDataFrame([("hot",), (None,)], "k string")
    inside, outside = rel.semi_join(skewed, keys, ["k"]), rel.anti_join(skewed, keys, ["k"])
    assert inside.count() + outside.count() == 3000
    assert outside.where("k IS NULL OR k = 'hot'").count() == 0


@pytest.mark.parametrize("limit", [0, 3, 200, 10**6])
@pytest.mark.parametrize("keys", [["k"], []])
def test_quantiles_match_numpy_on_every_path(skewed, limit, keys):
    probs = {"a": 0.0, "b": 0.25, "m": 0.5, "c": 0.95, "z": 1.0}
    found = agg.quantiles(skewed, keys, "v", probs, max_group_rows=limit).toPandas()
    rows = skewed.toPandas()
    groups = rows.groupby("k", dropna=False) if keys else [(None, rows)]
    expected = {(g if isinstance(g, str) else None): np.quantile(x["v"], list(probs.values())) for g, x in groups}
    assert len(found) == len(expected)
    for _, row in found.iterrows():
        name = row["k"] if keys and isinstance(row["k"], str) else None
        np.testing.assert_allclose(row[list(probs)].astype(float), expected[name])


def test_quantiles_of_missing_and_constant_values(spark):
    rows = spark.createDataFrame(
        [("gone", None), ("gone", None), ("one", 4.0), ("same", 2.0), ("same", 2.0), ("same", None)], "k string, v double"
    )
    for limit in (0, 100):
        found = {r["k"]: r["m"] for r in agg.quantiles(rows, ["k"], "v", {"m": 0.5}, limit).collect()}
        assert found == {"gone": None, "one": 4.0, "same": 2.0}
    assert agg.quantiles(rows.limit(0), ["k"], "v", {"m": 0.5}).count() == 0


def test_quantiles_of_infinite_and_widely_spread_values(spark):
    spread = [float(f"{k % 9 + 1}e{k // 5 - 300}") for k in range(3000)]
    rows = [("wide", x) for x in spread] + [("ends", x) for x in [float("-inf"), 1.0, 2.0, 3.0, float("inf")] * 30]
    table = spark.createDataFrame(rows, "k string, v double")
    probs = {"low": 0.0, "m": 0.5, "high": 1.0}
    for limit in (0, 40, 10**6):
        found = {r["k"]: (r["low"], r["m"], r["high"]) for r in agg.quantiles(table, ["k"], "v", probs, limit).collect()}
        assert found["ends"] == (float("-inf"), 2.0, float("inf"))
        np.testing.assert_allclose(found["wide"], np.quantile(spread, [0, 0.5, 1]))


def test_quantiles_narrow_in_few_passes(spark, monkeypatch):
    passes = []
    once = agg._narrow_once
    monkeypatch.setattr(agg, "_narrow_once", lambda *a: passes.append(1) or once(*a))
    table = spark.range(3000).select(F.pow(F.lit(1.5), (F.col("id") % 1500).cast("double") - 700).alias("v"))
    agg.quantiles(table, [], "v", {"m": 0.37}, 40).collect()
    assert len(passes) <= 2


def test_add_count_equals_window(skewed):
    counted = win.add_count(skewed, "k")
    by_hand = {r["k"]: r["count"] for r in skewed.groupBy("k").count().collect()}
    assert all(by_hand[r["k"]] == r["n"] for r in counted.collect())


def test_zscore_has_mean_zero_sd_one_and_no_value_for_constants(spark, skewed):
    stats = win.zscore(skewed, ["k"], "v", "z").groupBy("k").agg(F.avg("z").alias("m"), F.stddev_samp("z").alias("s"))
    for row in stats.collect():
        assert abs(row["m"]) < 1e-9 and abs(row["s"] - 1) < 1e-9
    flat = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 3.0)], "k string, v double")
    assert win.zscore(flat, ["k"], "v", "z").where("z IS NOT NULL").count() == 0


def test_sample_and_ranks_are_exact(skewed):
    rows = skewed.toPandas()
    order = win.hash_order(7, "id")
    hashed = skewed.select("id", "k", order.alias("h")).toPandas().sort_values(["h", "id"])
    sample = win.sample_per_group(skewed, ["k"], 5, "id", 7).toPandas()
    expected = hashed.groupby("k", dropna=False).head(5)
    assert sorted(sample["id"]) == sorted(expected["id"])
    ranked = win.hash_rank(skewed, "id", 7, digits=1).toPandas().sort_values("rank")
    assert list(ranked["id"]) == list(hashed["id"]) and list(ranked["rank"]) == list(range(1, len(rows) + 1))
    within = win.hash_rank(skewed, "id", 7, ["k"], digits=2).toPandas()
    for _, part in within.groupby("k", dropna=False):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))


def test_global_row_number(skewed):
    numbered = win.global_row_number(skewed, F.asc("v"), F.asc("id"), slices=5).toPandas().sort_values("position")
    expected = skewed.toPandas().sort_values(["v", "id"])
    assert list(numbered["id"]) == list(expected["id"])
    assert list(numbered["position"]) == list(range(1, 3001))


def test_reconcile_repair_and_complete(spark):
    a = spark.createDataFrame([("x",), ("y",), (None,)], "n string")
    b = spark.createDataFrame([("y",), ("z",)], "m string")
    sides = {r["key"]: r["side"] for r in rel.reconcile_keys(a, b, "n", "m").collect()}
    assert sides == {"x": "left_only", None: "left_only", "z": "right_only"}
    counts = spark.createDataFrame([("a", "p", 2), ("b", "q", 1), (None, "q", 4)], "f string, g string, n long")
    grid = {(r["f"], r["g"]): r["n"] for r in rel.complete_counts(counts, "f", "g").collect()}
    assert grid == {("a", "p"): 2, ("a", "q"): 0, ("b", "p"): 0, ("b", "q"): 1, (None, "p"): 0, (None, "q"): 4}
    one = rel.exactly_one(F.col("f"), F.col("g"))
    both = spark.createDataFrame([("a", None), (None, "b"), ("a", "b"), (None, None)], "f string, g string")
    assert [r[0] for r in both.select(one).collect()] == ["a", "b", None, None]


def test_profile_counts(spark):
    rows = spark.createDataFrame([("a", 1.0), ("bb", 2.0), (None, None), ("a", 6.0)], "t string, x double")
    table = {r["column"]: r for r in agg.profile(rows).collect()}
    assert (table["t"]["n_missing"], table["t"]["n_unique"], table["t"]["max_length"]) == (1, 2, 2)
    assert (table["x"]["mean"], table["x"]["p50"], table["x"]["complete_rate"]) == (3.0, 2.0, 0.75)


def test_partitioned_sink_writes_the_files_a_value_needs(spark):
    rows = [("hot", k) for k in range(900)] + [("cold", k) for k in range(50)] + [(None, 1), (None, 1)]
    table = spark.createDataFrame(rows, "area string, id long").repartition(6)
    dealt = tables.spread_by(table, "area", file_rows=100)
    # Adaptive execution would merge partitions as small as these.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    placed = dealt.withColumn("task", F.spark_partition_id()).groupBy("area").agg(
        F.count("id").alias("n"), F.countDistinct("task").alias("tasks")
    )
    found = {r["area"]: (r["n"], r["tasks"]) for r in placed.collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {a: n for a, (n, _) in found.items()} == {"hot": 900, "cold": 50, None: 2}
    assert found["cold"][1] == found[None][1] == 1 < found["hot"][1] <= 9
    assert dealt.columns == ["area", "id"] and tables.spread_by(table.limit(0), "area").count() == 0
