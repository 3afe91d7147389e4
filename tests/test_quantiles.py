import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideledger.operators import quantiles
from tideledger.plans.registry import shape

PROBS = {"p0": 0.0, "p5": 0.05, "med": 0.5, "p99": 0.99, "p100": 1.0}


@pytest.mark.parametrize("split", [1, 50, 10**9])
@pytest.mark.parametrize("grid", [4, 200])
def test_exact_on_hot_and_tied_keys(spark, split, grid):
    rng = random.Random(5)
    data = {"hot": [rng.gauss(0, 1) for _ in range(3000)], "tied": [1.0] * 400 + [2.0] * 3,
            "heavy": [10 ** rng.uniform(0, 9) for _ in range(300)], "one": [4.5],
            "two": [1.0, 2.0]}
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r.k: r for r in quantiles.exact_percentiles(df, ["k"], "v", PROBS, grid, split).collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        for name, p in PROBS.items():
            assert got[k][name] == pytest.approx(np.percentile(vs, p * 100), rel=1e-12), (k, name)


@pytest.mark.parametrize("grid,target", [(4, 3), (4, 40), (200, 25)])
def test_no_task_orders_more_than_the_target(spark, grid, target):
    rng = random.Random(6)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(2500)] + [("tied", float(i % 2)) for i in range(900)]
    rows += [("skewed", 10 ** rng.uniform(0, 9)) for _ in range(600)]
    df = spark.createDataFrame(rows, "k string, v double")
    cells = quantiles.wanted_buckets(df.withColumnRenamed("v", "__v"), ["k"], PROBS, grid, target)
    sizes = cells.groupBy("k", "__path").count().collect()
    assert max(r["count"] for r in sizes) <= target and len({r["__path"] for r in sizes}) > 1
    by_cutting = quantiles.exact_percentiles(df, ["k"], "v", PROBS, grid, 1, target=target)
    built_in = quantiles.exact_percentiles(df, ["k"], "v", PROBS)
    assert sorted(map(tuple, by_cutting.collect())) == sorted(map(tuple, built_in.collect()))  # bit for bit


def test_needs_a_key(spark):
    with pytest.raises(ValueError):
        quantiles.exact_percentiles(spark.range(3), [], "id", PROBS)


def test_shape_drops_negative_zero(spark):
    df = spark.createDataFrame([(-1e-12,)], "x double")
    assert str(shape(df, "x:6").first()[0]) == "0.0"
