"""How often jobs go over their rows."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from parcelmill.operators import aggregates as agg
from parcelmill.operators import splines
from parcelmill.plans import cleaning, serving

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ranks_share_the_sketch_of_their_range(spark, monkeypatch):
    rows = spark.range(4000).select((F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 4001).cast("double").alias("v")).checkpoint()
    ranges, real = [], agg._in_range
    monkeypatch.setattr(agg, "_in_range", lambda values, targets, keys, *more: ranges.append(targets.count()) or real(values, targets, keys, *more))
    probs = {"low": 0.25, "middle": 0.5, "high": 0.75}
    found = {r["k"]: tuple(r[n] for n in probs) for r in agg.quantiles(rows, ["k"], "v", probs, 500).collect()}
    assert ranges[0] == 2
    want = rows.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, probs.values()))).alias("q")).collect()
    assert found == {r["k"]: tuple(r["q"]) for r in want}


def test_a_place_among_knots_is_looked_up_once(spark):
    rows = spark.range(200).select((F.col("id") % 2).alias("k"), F.col("id").alias("x"), (F.col("id") * 1.5).alias("y")).checkpoint()
    smooth = splines.smoothed(rows, splines.fit(rows, "x", "y", ["k"]), "x", ["k"])
    assert plan(smooth).count("lambdafunction(") == 1


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_audits_clean_the_sales_once(spark, monkeypatch):
    calls, real = [], cleaning.clean_assessments
    monkeypatch.setattr(cleaning, "clean_assessments", lambda raw, *more, **named: calls.append(plan(raw)) or real(raw, *more, **named))
    assert queries()["CJ10_data_quality_audits"](spark, SF_DIR).count() == 8
    assert len(calls) == 1 and "Join" not in calls[0]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_densities_go_over_stored_rows(spark, monkeypatch):
    seen, real = [], serving.density
    monkeypatch.setattr(serving, "density", lambda rows, *more: seen.append(plan(rows)) or real(rows, *more))
    assert queries()["SV6_lot_area_density"](spark, SF_DIR).count() > 0
    assert len(seen) == 1 and "Join" not in seen[0] and "Aggregate" not in seen[0]
