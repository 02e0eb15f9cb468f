"""Percentiles by narrowing ranges against numpy and against Spark's own, whatever the values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.operators.percentiles import doubles, exact_percentiles, ordered

SHARES = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}


def test_order_and_back():
    values = np.array([-math.inf, -1e300, -1.5, -1e-320, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 2.5e10, math.inf, math.nan])
    keys = ordered(values.copy())
    assert (np.diff(keys) >= 0).all() and keys[4] == keys[5]
    assert np.array_equal(doubles(keys)[:-1], values[:-1]) and math.isnan(doubles(keys)[-1])


def test_groups_of_all_sizes(spark):
    r = random.Random(4)
    draw = {"hot": lambda: r.gauss(0, 1e3), "same": lambda: 7.25, "whole": lambda: float(r.randrange(9)), "wide": lambda: r.choice([-1, 1]) * 10 ** r.uniform(-300, 300), None: lambda: r.random()}
    rows = [(g, f()) for g, f in draw.items() for _ in range({"hot": 5000, "wide": 501}.get(g, 40))] + [("one", -3.5), ("two", 1.0), ("two", 2.0), ("none", None), ("hot", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    want = {}
    for g in {g for g, v in rows if v is not None}:
        values = np.array([v for k, v in rows if k == g and v is not None])
        want[g] = (len(values), *(np.quantile(values, q) for q in SHARES.values()))
    for small in (0, 45, 10**6):
        got = {r.g: tuple(r)[1:] for r in exact_percentiles(frame, "v", SHARES, ("g",), small=small).collect()}
        assert got.keys() == want.keys()
        assert all(got[g] == pytest.approx(want[g], rel=1e-12) for g in want)


def test_without_groups_and_without_rows(spark):
    frame = spark.range(1000).select(F.pmod(F.col("id") * 7919, F.lit(1009)).alias("v"))
    values = [r.v for r in frame.collect()]
    for small in (0, 10**6):
        got = exact_percentiles(frame, "v", SHARES, small=small).first()
        assert tuple(got)[1:] == pytest.approx([np.quantile(values, q) for q in SHARES.values()])
        assert exact_percentiles(frame.limit(0), "v", SHARES, small=small).count() == 0
        assert exact_percentiles(frame.select(F.lit("g").alias("g"), F.lit(None).cast("double").alias("v")), "v", SHARES, ("g",), small=small).count() == 0


def test_special_values(spark):
    frame = spark.createDataFrame([(x,) for x in (0.0, -0.0, math.inf, -math.inf, math.nan, 1.0)], "v double")
    for small in (0, 100):
        got = exact_percentiles(frame, "v", {"low": 0.0, "mid": 0.4, "high": 1.0}, small=small).first()
        assert got.low == -math.inf and got.mid == 0.0 and math.isnan(got.high)


def test_no_task_holds_a_group(spark):
    """After the first projection all rows of a hot group are counted where they lie; only sums are shuffled."""
    frame = spark.range(0, 20_000, numPartitions=8).select(F.lit("hot").alias("g"), F.rand(3).alias("v"))
    from sievemark.operators import percentiles

    plans, before = [], percentiles.materialise
    percentiles.materialise = lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), before(df, name))[1]
    try:
        exact_percentiles(frame, "v", {"p": 0.5}, ("g",), small=0).collect()
    finally:
        percentiles.materialise = before
    rounds = [p for name, p in plans if name == "percentile"]
    assert len(rounds) == 4 and all("partial_count" in p for p in rounds)
    assert "percentile(" not in " ".join(rounds)


def test_shares_outside(spark):
    with pytest.raises(ValueError):
        exact_percentiles(spark.range(3), "id", {"p": 1.5})
