import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideledger.operators import features as feat

D0 = dt.date(2020, 1, 1)


def frame(spark, values, key="a"):
    rows = [(key, D0 + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, date date, value double")


def column(df, expr):
    return [r.x for r in df.withColumn("x", expr).orderBy("date").collect()]


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        if w is None or (isinstance(w, float) and math.isnan(w)):
            assert g is None
        else:
            assert g == pytest.approx(w, abs=1e-9)


GAPPY = [1.0, 4.0, None, 2.0, 8.0, None, None, None, None, None, 3.0, 5.0, 0.5]


def loop_slopes(values, w):
    x = np.arange(w) - (w - 1) / 2
    out = [None] * len(values)
    for i in range(w - 1, len(values)):
        y = np.array([np.nan if v is None else v for v in values[i - w + 1:i + 1]])
        if not np.isnan(y).all():
            out[i] = float(np.nansum(x * (y - np.nanmean(y))) / np.sum(x ** 2))
    return out


@pytest.mark.parametrize("w", [3, 5, 7])
def test_trend_with_gaps(spark, w):
    close(column(frame(spark, GAPPY), feat.trend(["k"], "date", "value", w)), loop_slopes(GAPPY, w))


def test_series_shorter_than_window(spark):
    assert column(frame(spark, [1.0, 2.0]), feat.trend(["k"], "date", "value", 5)) == [None, None]


def test_rolling_needs_two(spark):
    df = frame(spark, [None, 2.0, None, 4.0])
    close(column(df, feat.rolling_mean(["k"], "date", "value", 3)), [None, None, None, 3.0])
    close(column(df, feat.persistence(["k"], "date", "value", 3)), [None, 2.0, 2.0, 3.0])
    close(column(df, feat.rolling_std(["k"], "date", "value", 3)), [None, None, None, math.sqrt(2)])


def test_relative_change_zero_and_missing_base(spark):
    df = frame(spark, [0.0, None, 2.0, 5.0, 4.0])
    close(column(df, feat.rel_change(["k"], "date", "value", 1)), [None, 0.0, None, 150.0, -20.0])
    close(column(df, feat.rel_change(["k"], "date", "value", 2)), [None, None, 0.0, None, 100.0])


def test_detrend_matches_least_squares_and_skips_short(spark):
    rng = random.Random(2)
    values = [0.3 * i + rng.random() for i in range(40)]
    got = [r.detrended for r in feat.detrend(frame(spark, values), ["k"]).orderBy("date").collect()]
    x = np.arange(40)
    close(got, list(np.array(values) - np.polyval(np.polyfit(x, values, 1), x)))
    short = feat.detrend(frame(spark, values[:10]), ["k"]).collect()
    assert all(r.detrended is None for r in short)


def test_detrend_bridges_gaps(spark):
    values = [None, 2.0, None, 8.0] * 10
    got = [r.detrended for r in feat.detrend(frame(spark, values), ["k"]).orderBy("date").collect()]
    filled, last = [], None
    for v in values:
        last = v if v is not None else last
        filled.append(last)
    filled[0] = 2.0
    x = np.arange(40)
    close(got, list(np.array(filled) - np.polyval(np.polyfit(x, filled, 1), x)))


def test_mean_fill_keeps_mean(spark):
    values = [float(i % 5) if i % 3 else None for i in range(33)]
    rows = feat.detrend(frame(spark, values), ["k"], fill="mean", keep_mean=True).collect()
    known = [v for v in values if v is not None]
    assert np.mean([r.detrended for r in rows]) == pytest.approx(np.mean(known))


def test_engineer_is_one_shuffle(spark):
    fanned = feat.engineer(frame(spark, GAPPY), ["k"])
    plan = fanned._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    n_made = 5 + 4 * 2 + 4 * 2
    assert len(fanned.columns) == 3 + n_made + 5 * (n_made + 1)


def test_catalog_reads_lineage(spark):
    names = ["swh_max_persistence_7_lag_3", "anom_swh_p80", "swe_mean_deseasonalized_detrended_trend_14",
             "clima_swh_mean_lag_1", "total_obs"]
    rows = {r.feature: r for r in feat.feature_catalog(
        spark.createDataFrame([(n,) for n in names], "feature string")).collect()}
    first = rows[names[0]]
    assert (first.base, first.transform, first.window, first.lag, first.is_derived) == (
        "swh_max", "persistence", 7, 3, True)
    assert rows[names[1]].category == "anomaly" and not rows[names[1]].is_derived
    assert (rows[names[2]].base, rows[names[2]].transform, rows[names[2]].window) == ("swe_mean", "trend", 14)
    assert rows[names[3]].category == "climatology" and rows[names[3]].lag == 1
    assert rows[names[4]].category == "other"


def test_wide_and_long_round_trip(spark):
    df = frame(spark, [1.0, 2.0]).withColumn("b", F.col("value") * 2)
    long = feat.to_long(df, ["k", "date"], ["value", "b"])
    back = feat.to_wide(long, ["k", "date"], ["value", "b"]).orderBy("date").collect()
    assert [(r.value, r.b) for r in back] == [(1.0, 2.0), (2.0, 4.0)]
