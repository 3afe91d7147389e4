import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tideledger.operators import runs


def loop_runs(flags):
    out, start = [], None
    for i, f in enumerate([*flags, 0]):
        if f == 1 and start is None:
            start = i
        if f != 1 and start is not None:
            out.append((start, i - 1, i - start))
            start = None
    return out


def series():
    rng = random.Random(3)
    cases = {"ones": [1] * 12, "zeros": [0] * 9, "ends": [1, 1, 0, 0, 1], "one": [1],
             "gap": [1, None, 1, 1, None]}
    cases.update({f"r{i}": [int(rng.random() < 0.6) for _ in range(40)] for i in range(6)})
    return cases


@pytest.fixture(scope="module")
def flagged(spark):
    rows = [(k, i, f) for k, flags in series().items() for i, f in enumerate(flags)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "k string, i int, f int")


def expected():
    return sorted((k, *r) for k, flags in series().items() for r in loop_runs(flags))


def test_run_lengths(flagged):
    got = runs.run_lengths(flagged, ["k"], "i", "f").collect()
    assert sorted(map(tuple, got)) == expected()


@pytest.mark.parametrize("width", [1, 2, 5, 100])
def test_chunked_runs_equal_plain_ones(flagged, width):
    cut = flagged.withColumn("c", F.floor(F.col("i") / width))
    got = runs.run_lengths_chunked(cut, ["k"], "i", "f", "c").collect()
    assert sorted(map(tuple, got)) == expected()


def test_empty_chunks_do_not_split_a_run(spark):
    rows = [("a", i, 1) for i in (0, 1, 50, 51, 99)] + [("a", 100, 0), ("a", 200, 1)]
    df = spark.createDataFrame(rows, "k string, i int, f int").withColumn("c", F.floor(F.col("i") / 10))
    got = runs.run_lengths_chunked(df, ["k"], "i", "f", "c").collect()
    assert sorted(map(tuple, got)) == [("a", 0, 99, 5), ("a", 200, 200, 1)]


def test_run_length_per_row_and_smoothing(flagged):
    got = {(r.k, r.i): (r.run_days, r.smoothed) for r in runs.keep_long_runs(
        runs.with_run_length(flagged, ["k"], "i", "f"), ["k"], "i", "f", 3).collect()}
    for k, flags in series().items():
        length = [0] * len(flags)
        for s, e, n in loop_runs(flags):
            length[s:e + 1] = [n] * n
        for i, n in enumerate(length):
            assert got[(k, i)] == (n, int(n >= 3)), (k, i)


def test_runs_of_codes(spark):
    codes = ["a", "a", None, "b", "b", "a", "b"]
    df = spark.createDataFrame([("x", i, c) for i, c in enumerate(codes)], "k string, i int, c string")
    got = sorted((r.c, r.run_start, r.run_days)
                 for r in runs.run_lengths(df, ["k"], "i", "c", code="c").collect())
    want = []
    for code, grp in itertools.groupby(enumerate(codes), key=lambda t: t[1]):
        grp = list(grp)
        if code is not None:
            want.append((code, grp[0][0], len(grp)))
    assert got == sorted(want)


def test_max_consecutive_above(spark):
    df = spark.createDataFrame([("p", i, v) for i, v in enumerate([1.0, 3.0, 3.0, None, 3.0, 0.0])]
                               + [("q", 0, 0.0)], "k string, i int, v double")
    for chunk in (None, "c"):
        rows = runs.max_consecutive_above(df.withColumn("c", F.floor(F.col("i") / 2)), ["k"], "i", "v",
                                          F.lit(2.0), chunk).collect()
        assert {r.k: r.max_consecutive_above for r in rows} == {"p": 2, "q": 0}


def test_run_day_features_first_row_is_no_start(spark):
    df = spark.createDataFrame([("p", i, f) for i, f in enumerate([1, 1, 0, 1, 1, 1])],
                               "k string, i int, f int")
    rows = runs.run_day_features(df, ["k"], "i", "f").orderBy("i").collect()
    assert [r.event_count_2 for r in rows] == [0, 0, 0, 1, 0, 0]
    assert [r.event_dummy_3 for r in rows] == [0, 0, 0, 1, 1, 1]


def test_duration_ladder_over_new_year(spark):
    start = dt.date(2019, 12, 28)
    flags = [0, 0, 1, 1, 1, 1, 0, 1]
    rows = [("p", start + dt.timedelta(days=i), f) for i, f in enumerate(flags)]
    df = spark.createDataFrame(rows, "k string, date date, f int").withColumn("year", F.year("date"))
    got = {(r.year, r.min_days): (r.days_closed, r.num_events, r.total_loss)
           for r in runs.duration_ladder(df, ["k"], "date", "f", "year", F.lit(10.0)).collect()}
    assert got[(2019, 1)] == (2, 1, 20.0)
    assert got[(2020, 1)] == (3, 1, 30.0)     # the run carried over is no start in 2020
    assert got[(2020, 2)] == (2, 0, 20.0)
    assert got[(2019, 4)] == (2, 1, 20.0)
    assert got[(2020, 7)] == (0, 0, 0.0)
