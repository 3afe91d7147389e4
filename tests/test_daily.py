import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideledger.operators import daily


def hourly(spark, years=(2021, 2022, 2023, 2024)):
    rng = random.Random(7)
    rows = []
    for y in years:
        for d in range(6):
            for h in range(24):
                ts = dt.datetime(y, 1, 1 + d, h)
                v = None if rng.random() < 0.03 else rng.random() * 3
                rows.append(("P", ts, ts.date(), v, rng.random()))
    return spark.createDataFrame(rows, "port_name string, ts timestamp, date date, swh double, swe double"), rows


@pytest.mark.parametrize("bounded,chunk", [(True, None), (False, "part")])
def test_daily_table_against_numpy(spark, bounded, chunk):
    df, rows = hourly(spark)
    df = df.withColumn("part", F.floor(F.hour("ts") / 5))
    got = {r.date: r for r in daily.daily_model(df, ["port_name"], "ts", 2024, "2022-01-01", bounded, chunk)
           .collect()}
    assert min(got) == dt.date(2022, 1, 1)
    known = [r for r in rows if r[3] is not None]
    cut = np.percentile([r[3] for r in known if r[2].year < 2024], 60)
    for date, row in got.items():
        day = [r[3] for r in known if r[2] == date]
        clima = np.mean([r[3] for r in known if (r[2].month, r[2].day) == (date.month, date.day)])
        assert row.swh_mean == pytest.approx(np.mean(day))
        assert row.swh_p60 == pytest.approx(np.percentile(day, 60))
        assert row.swh_sd == pytest.approx(np.std(day, ddof=1))
        assert row.anom_swh_p80 == pytest.approx(np.percentile(np.array(day) - clima, 80))
        assert row.anom_swh_max == pytest.approx(max(day) - clima)
        assert row.hours_above == sum(v > cut for v in day)
        best = run = 0
        for r in (r for r in rows if r[2] == date):
            run = run + 1 if r[3] is not None and r[3] > cut else 0
            best = max(best, run)
        assert row.max_consecutive_above == best
        assert row.total_obs == len(day)


def test_reanalysis_uses_population_sd_for_cv(spark):
    df, rows = hourly(spark)
    row = daily.daily_reanalysis(df, ["port_name"], "ts", 2024, 2024, True).orderBy("date").first()
    day = [r[3] for r in rows if r[2] == row.date and r[3] is not None]
    assert row.swh_cv == pytest.approx(np.std(day) / np.mean(day))
    assert row.swh_sd == pytest.approx(np.std(day, ddof=1))
