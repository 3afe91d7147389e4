import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tideledger.operators import aep, resample

K = ["run"]


def daily(spark, start=dt.date(2016, 1, 1), n=900, seed=1, skip=()):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        day = start + dt.timedelta(days=i)
        if i not in skip:
            rows.append(("r", day, rng.random(), int(rng.random() < 0.2)))
    return spark.createDataFrame(rows, "run string, date date, v double, y int"), rows


def loop_candidates(rows, half=10, block=7):
    dates = [r[1] for r in rows]
    out = set()
    for slot in range(53):
        ref = dt.date(dates[0].year, 1, 1) + dt.timedelta(days=7 * slot)
        for year in sorted({d.year for d in dates}):
            try:
                centre = dt.date(year, ref.month, ref.day)
            except ValueError:
                centre = dt.date(year, 2, 28)
            for i, d in enumerate(dates[:len(dates) - block + 1]):
                if abs((d - centre).days) <= half and dates[i + block - 1] <= centre + dt.timedelta(days=half):
                    out.add((slot, d))
    return out


def test_leap_day_centres_fall_back(spark):
    df, _ = daily(spark, dt.date(2016, 1, 1), 800)
    centres = resample.slot_centres(df, K, block_length=1, days_per_year=60)
    leap = {r.year: r.centre for r in centres.where("slot = 59").collect()}
    assert leap == {2016: dt.date(2016, 2, 29), 2017: dt.date(2017, 2, 28), 2018: dt.date(2018, 2, 28)}


def test_candidates_against_loop(spark):
    df, rows = daily(spark, skip=set(range(200, 215)) | {700})
    got = {(r.slot, r.block_start) for r in resample.seasonal_candidates(df, K, ["v"]).collect()}
    assert got == loop_candidates(rows)


def test_simulated_years_are_whole_and_reproducible(spark):
    df, rows = daily(spark)
    days = aep.simulate(df, K, ["date", "v", "y"], 5, seed=3).collect()
    assert sorted((r.sim, r.day) for r in days) == [(s, d) for s in range(5) for d in range(1, 366)]
    again = aep.simulate(df.repartition(13), K, ["date", "v", "y"], 5, seed=3).collect()
    assert sorted(map(tuple, days)) == sorted(map(tuple, again))
    other = aep.simulate(df, K, ["date", "v", "y"], 5, seed=4).collect()
    assert sorted(map(tuple, days)) != sorted(map(tuple, other))
    pool = loop_candidates(rows)
    for r in days:
        if (r.day - 1) % 7 == 0:
            assert ((r.day - 1) // 7, r.date) in pool


def test_blocks_from_anywhere(spark):
    df, rows = daily(spark, n=60)
    got = resample.draw_days(resample.anywhere_candidates(df, K, ["date"]), K, 3).collect()
    assert len(got) == 3 * 365 and {r.date for r in got} <= {r[1] for r in rows}


def loop_losses(pred, obs, min_days):
    def total(flags):
        out, run, n = 0, 0, 0
        for f in [*flags, 0]:
            if f:
                run += 1
            else:
                n += run > 0
                out += run if run >= min_days else 0
                run = 0
        return out, n
    parts = {"fp": [p and not o for p, o in zip(pred, obs)], "fn": [o and not p for p, o in zip(pred, obs)],
             "tp": [p and o for p, o in zip(pred, obs)]}
    return total(pred), {k: total(v) for k, v in parts.items()}


@pytest.mark.parametrize("min_days", [1, 2, 3])
def test_losses_against_loop(spark, min_days):
    rng = random.Random(min_days)
    sims = {s: ([int(rng.random() < 0.5) for _ in range(30)], [int(rng.random() < 0.4) for _ in range(30)])
            for s in range(6)}
    sims[6] = ([0] * 30, [0] * 30)
    sims[7] = ([1] * 30, [1] * 30)
    rows = [("r", s, d, p, o) for s, (ps, os_) in sims.items() for d, (p, o) in enumerate(zip(ps, os_), 1)]
    days = spark.createDataFrame(rows, "run string, sim int, day int, pred int, obs int")
    money = spark.createDataFrame([("r", 10, 2.5)], "run string, n_workers int, daily_wage double")
    loss = {r.sim: r for r in aep.price(aep.sim_loss_days(days, K, "pred", min_days), money, K).collect()}
    parts = {(r.sim, r.component): r for r in aep.component_losses(
        aep.sim_component_days(days, K, min_days), money, K, K).collect()}
    for s, (pred, obs) in sims.items():
        (total, events), comp = loop_losses(pred, obs, min_days)
        assert (loss[s].loss, loss[s].n_events) == (25.0 * total, events)
        for c, (n_days, n_events) in comp.items():
            assert (parts[(s, c)].loss, parts[(s, c)].n_events) == (25.0 * n_days, n_events), (s, c)
        if min_days == 1:
            assert parts[(s, "insurance")].loss == loss[s].loss


def test_curves_fall_and_ties_are_ranked(spark):
    df = spark.createDataFrame([("r", s, float(s % 3)) for s in range(9)], "run string, sim int, loss double")
    curve = aep.exceedance_rank(df, K).orderBy("rank").collect()
    assert [r.loss for r in curve] == sorted((r.loss for r in curve), reverse=True)
    assert [r.probability for r in curve] == pytest.approx([i / 10 for i in range(1, 10)])
    assert aep.loss_at_probability(aep.exceedance_rank(df, K), K, 0.35).first().loss == 2.0
    last = aep.exceedance_ecdf(df, K).orderBy(F.desc("i")).first()
    assert last.exceedance == 0.0 and last.return_period is None


def test_curves_of_different_length_add_up(spark):
    rows = [("a", s, float(10 * s)) for s in range(4)] + [("b", s, float(s)) for s in range(2)]
    df = spark.createDataFrame(rows, "run string, sim int, loss double")
    got = {round(r.probability, 6): r.aggregate_loss for r in
           aep.aggregate_curves(aep.exceedance_rank(df, K)).collect()}
    curves = {"a": [(i / 5, v) for i, v in enumerate([30.0, 20.0, 10.0, 0.0], 1)],
              "b": [(i / 3, v) for i, v in enumerate([1.0, 0.0], 1)]}
    for i in range(1, 5):
        p = i / 5
        want = sum(min(c, key=lambda t: round(abs(t[0] - p), 12))[1] for c in curves.values())
        assert got[round(p, 6)] == want


def test_event_match_against_loop(spark):
    rng = random.Random(12)
    pred = [int(rng.random() < 0.4) for _ in range(80)]
    obs = [int(rng.random() < 0.3) for _ in range(80)]
    rows = [("r", dt.date(2020, 1, 1) + dt.timedelta(days=i), p, o) for i, (p, o) in enumerate(zip(pred, obs))]
    df = spark.createDataFrame(rows, "run string, date date, pred int, obs int")
    got = {}
    for r in aep.event_match(df, K).collect():
        got[r.outcome] = got.get(r.outcome, 0) + 1

    def spans(flags):
        out, s = [], None
        for i, f in enumerate([*flags, 0]):
            if f and s is None:
                s = i
            if not f and s is not None:
                out.append((s, i))
                s = None
        return out
    tp = sum(any(obs[a:b]) for a, b in spans(pred))
    fn = sum(not any(pred[a:b]) for a, b in spans(obs))
    assert got == {"tp": tp, "fp": len(spans(pred)) - tp, "fn": fn}


def test_trigger_rebuilt_in_each_year(spark):
    df, _ = daily(spark)
    sims = aep.resampled_trigger(df, K, "v", 3, "persistence", 3, 1, adjust="none").collect()
    base = {(r.sim, r.day): r.v for r in aep.simulate(df, K, ["v"], 3).collect()}
    for r in sims:
        window = [base[(r.sim, d)] for d in range(max(1, r.day - 3), r.day)]
        assert r.trigger == (pytest.approx(sum(window) / len(window)) if window else None)


def test_season_fitted_inside_a_year_is_constant(spark):
    df, _ = daily(spark)
    rows = aep.resampled_trigger(df, K, "v", 2, "none", adjust="deseasonalized", climatology="sim").collect()
    for s in (0, 1):
        values = [r.trigger for r in rows if r.sim == s]
        assert max(values) - min(values) < 1e-9


def test_bernoulli_rate(spark):
    df, _ = daily(spark, n=300)
    days = resample.bernoulli_days(df.withColumn("p", F.lit(0.3)), K, 20, "p")
    assert days.agg(F.avg("flag")).first()[0] == pytest.approx(0.3, abs=0.03)


def test_a_series_with_gaps_still_gives_whole_years(spark):
    import datetime as dt

    from tideledger.operators import resample
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(0, 700, 9)]
    daily = spark.createDataFrame([("p", d, float(i)) for i, d in enumerate(days)], "port string, date date, v double")
    drawn = resample.draw_days(resample.seasonal_candidates(daily, ["port"], ["v"]), ["port"], 5)
    years = {r.sim: (r.n, r.days) for r in drawn.groupBy("sim").agg(
        __import__("pyspark.sql.functions", fromlist=["f"]).count("*").alias("n"),
        __import__("pyspark.sql.functions", fromlist=["f"]).count_distinct("day").alias("days")).collect()}
    assert years == {i: (365, 365) for i in range(5)}
