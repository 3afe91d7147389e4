import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideledger.operators import forests, models, newton, search, selection

D0 = dt.date(2022, 6, 1)


def test_p_values_in_closed_form(spark):
    rows = [(f, 1.0, 1.0) for f in (0.1, 1.0, 30.0)] + [(f, 1.0, 2.0) for f in (0.5, 4.0)] + [(2.0, 4.0, 2.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "f double, a double, b double").select(
        selection.f_p_value("f", "a", "b")).collect()]
    want = [1 - 2 / math.pi * math.atan(math.sqrt(f)) for f in (0.1, 1.0, 30.0)]
    want += [1 - math.sqrt(f / (f + 2)) for f in (0.5, 4.0)]
    want += [1 - (4 * 2.0 / (4 * 2.0 + 2)) ** 2]
    assert got == pytest.approx(want, rel=1e-9)


def sample(spark, n=400):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append(("r", D0 + dt.timedelta(days=i), a, b, int(a + 0.7 * rng.gauss(0, 1) > 0.8)))
    return spark.createDataFrame(rows, "run string, date date, a double, b double, y int"), rows


def test_f_score_and_information_rank_the_signal_first(spark):
    from tideledger.operators.features import to_long
    df, rows = sample(spark)
    long = to_long(df, ["run", "date", "y"], ["a", "b"])
    f = {r.feature: r.f_score for r in selection.f_scores(long, ["run"]).collect()}
    groups = [[r[2] for r in rows if r[4] == c] for c in (0, 1)]
    every = [r[2] for r in rows]
    between = sum(len(g) * (np.mean(g) - np.mean(every)) ** 2 for g in groups)
    within = sum(np.sum((np.array(g) - np.mean(g)) ** 2) for g in groups)
    assert f["a"] == pytest.approx(between / (within / (len(every) - 2)))
    mi = {r.feature: r.score for r in selection.select_mutual_info(long, ["run"]).collect()}
    assert mi["a"] > mi["b"] >= 0
    voted = selection.feature_selection(long, ["run"], "vote").collect()
    assert voted[0].feature == "a" and voted[0].method_count == 3


@pytest.mark.parametrize("strict", [False, True])
def test_sweep_against_every_threshold(spark, strict):
    rng = random.Random(3)
    data = [(round(rng.random(), 3), int(rng.random() < 0.3)) for _ in range(200)] + [(0.0, 1), (1.0, 0)]
    df = spark.createDataFrame([("k", p, y) for p, y in data], "k string, probability double, label int")
    got = models.threshold_sweep(df, ["k"], start=0.01, step=0.01, count=98, strict=strict).first()
    best = (-1, None)
    for i in range(98):
        t = round(0.01 + i * 0.01, 2)
        pred = [(p > t) if strict else (p >= t) for p, _ in data]
        tp = sum(p and y for p, (_, y) in zip(pred, data))
        wrong = sum(bool(p) != bool(y) for p, (_, y) in zip(pred, data))
        if tp and 2 * tp / (2 * tp + wrong) > best[0]:
            best = (2 * tp / (2 * tp + wrong), t)
    assert (got.f1, got.threshold) == (pytest.approx(best[0]), pytest.approx(best[1]))


def newton_by_hand(x, y, ridge, weight=None, steps=60):
    x = np.column_stack([np.ones(len(x)), x])
    w, weight = np.zeros(x.shape[1]), np.ones(len(y)) if weight is None else weight
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (p - y)) + ridge * w)
    return w


def test_grouped_fits_equal_single_ones(spark):
    df, rows = sample(spark)
    both = df.unionByName(df.where("b > 0").withColumn("run", F.lit("other")))
    folded = both.withColumn("fold", F.when(F.col("date") < D0 + dt.timedelta(days=250), 0).otherwise(1))
    part = F.dayofyear("date") % 2
    blocks = newton.pack(folded, ["run"], ["a", "b"], "y", F.col("fold"), part)
    models_ = newton.grid(["ab", "a"], [1, newton.ALL_FOLDS], [newton.NO_PART, 0, 1], list(newton.VARIANTS))
    fits = newton.fit(blocks, ["run"], ["a", "b"], models_, sets={"ab": ["a", "b"], "a": ["a"]}).collect()
    assert len(fits) == 2 * len(models_) and all(f.converged for f in fits)
    for f in fits:
        own = [r for r in rows if (f.run == "r" or r[3] > 0) and (f.fold > 1 or r[1] < D0 + dt.timedelta(days=250))
               and r[1].timetuple().tm_yday % 2 != f.part]
        x = np.array([[r[2], r[3]] for r in own])[:, :2 if f.set == "ab" else 1]
        y = np.array([r[4] for r in own])
        assert (f.n, f.pos) == (len(y), y.sum())
        kind, c = newton.VARIANTS[f.variant]
        if kind == "l1":  # the slope of the losses is within the penalty, and opposite to each coefficient
            d = np.column_stack([np.ones(len(x)), x])
            slope = d.T @ (1 / (1 + np.exp(-d @ np.array(f.w))) - y)
            assert np.allclose(np.where(np.array(f.w) == 0, np.clip(slope, -1, 1) - slope, slope + np.sign(f.w)), 0, atol=1e-6)
        else:
            ridge = np.array([0.0] + [1 / c if kind == "l2" else 0.0] * x.shape[1])
            assert np.allclose(f.w, newton_by_hand(x, y, ridge), atol=1e-7)


def test_balanced_standardised_fits(spark):
    df, rows = sample(spark)
    blocks = newton.pack(df, ["run"], ["a", "b"], "y")
    fit = newton.fit(blocks, ["run"], ["a", "b"], newton.grid(), balanced=True, standardised=True).first()
    x, y = np.array([[r[2], r[3]] for r in rows]), np.array([r[4] for r in rows])
    scaled = (x - x.mean(axis=0)) / x.std(axis=0)
    w = newton_by_hand(scaled, y, np.array([0.0, 1, 1]), np.where(y == 1, 0.5 * len(y) / y.sum(), 0.5 * len(y) / (1 - y).sum()))
    assert np.allclose(np.array(fit.w)[1:] * x.std(axis=0), w[1:], atol=1e-7)


def test_runs_of_one_class_have_no_fit(spark):
    df, _ = sample(spark, 60)
    quiet = df.unionByName(df.withColumns({"run": F.lit("quiet"), "y": F.lit(0)}))
    got = models.logistic_probabilities(quiet, ["run"], ["a"], "y", ["L2"])
    assert {r.run for r in got.select("run").distinct().collect()} == {"r"}
    assert models.logistic_probabilities(df.limit(0), ["run"], ["a"], "y", ["L2"]).count() == 0


def test_calibrated_probabilities_follow_the_rate(spark):
    df, rows = sample(spark)
    got = models.calibrated_probabilities(df, ["run"], ["a", "b"], ["run", "date"], 3)
    n, mean, low, high = got.agg(F.count("*"), F.avg("probability"), F.min("probability"), F.max("probability")).first()
    assert n == len(rows) and 0 < low < high < 1
    assert mean == pytest.approx(np.mean([r[4] for r in rows]), abs=0.03)


def test_one_class_folds_are_skipped_and_folds_without_a_hit_count(spark):
    df, _ = sample(spark, 120)
    quiet = search.time_series_folds(df.withColumn("y", F.when(
        F.col("date") < D0 + dt.timedelta(days=60), 0).otherwise(F.col("y"))), ["run"], 5)
    got = models.fold_probabilities(quiet, ["run"], {"all": ["a", "b"]}, ["L2"], 5, ["run", "date"])
    assert {r.test_fold for r in got.select("test_fold").distinct().collect()} == {3, 4}
    folds = models.model_cv(quiet, ["run"], {"all": ["a", "b"]}, ["L2"], 5, ["run", "date"]).collect()
    assert {r.test_fold for r in folds} == {3, 4}


def test_holdout_needs_earlier_rows_of_two_classes(spark):
    df, _ = sample(spark, 60)
    best = spark.createDataFrame([("r", "all", "L2", 0.5, 0.1)], "run string, feature_set string, lr_variant string, "
                                 "optimal_threshold double, cv_f1_score double")
    for year in (2023, 2022):
        got = models.fit_predict_holdout(df.withColumn("y", F.lit(0)), ["run"], {"all": ["a"]}, best, year, ["run", "date"])
        assert got.count() == 0


def grown_by_hand(x, y, depth, rows=None):
    """Greedy Gini tree over all cuts of whole numbers; equal gains go to the first feature, then the lowest cut."""
    rows = np.arange(len(y)) if rows is None else rows
    n, pos = len(rows), y[rows].sum()
    gini = lambda a, b: 2 * b * (a - b) / a
    best = None
    if depth and 0 < pos < n:
        for f in range(x.shape[1]):
            for cut in sorted(set(x[rows, f]))[:-1]:
                low, high = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                gain = round(gini(n, pos) - gini(len(low), y[low].sum()) - gini(len(high), y[high].sum()), 9)
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, low, high)
    if best is None:
        return {int(r): pos / n for r in rows}
    return grown_by_hand(x, y, depth - 1, best[1]) | grown_by_hand(x, y, depth - 1, best[2])


@pytest.mark.parametrize("block_rows", [1 << 16, 60])
def test_trees_equal_greedy_ones_over_one_block_or_many(spark, monkeypatch, block_rows):
    monkeypatch.setattr(forests, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (240, 3))
    y = ((x[:, 0] > 6) ^ (x[:, 1] > 3) ^ (rng.random(240) < 0.2)).astype(int)
    rows = [("r", i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "run string, i int, a double, b double, c double, y int")
    both = df.unionByName(df.withColumns({"run": F.lit("s"), "y": 1 - F.col("y")}))
    trees = [forests.Ensemble("one", 1, 1), forests.Ensemble("three", 1, 3), forests.Ensemble("all", 1, None)]
    got = models.tree_probabilities(both, ["run"], ["a", "b", "c"], ["run", "i"], ensembles=trees).collect()
    assert len(got) == 2 * 3 * 240
    for name, depth in (("one", 1), ("three", 3), ("all", 99)):
        want = grown_by_hand(x, y, depth)
        assert {r.i: r.probability for r in got if r.run == "r" and r.variant == name} == pytest.approx(want)
        flipped = {r.i: 1 - r.probability for r in got if r.run == "s" and r.variant == name}
        assert flipped == pytest.approx(want)


def test_forests_find_the_signal_and_are_the_same_again(spark):
    df, _ = sample(spark)
    small = [forests.Ensemble("forest", 60, 6, features="sqrt", resample=True, seed=1),
             forests.Ensemble("forest", 40, None, min_split=5, features=0.8, resample=True, seed=2)]
    found = [{r.feature: r.importance_mean for r in selection.select_forest(d, ["run"], ["a", "b"], "y", ["run", "date"], small).collect()}
             for d in (df, df.repartition(3))]
    assert found[0] == found[1] and found[0]["a"] > found[0]["b"] and sum(found[0].values()) == pytest.approx(1)
    cuts = [forests.Ensemble("extra", 50, 5, features="sqrt", random_cuts=True)]
    extra = {r.feature: r.importance_mean for r in selection.select_extra_trees(
        df, ["run"], ["a", "b"], "y", ["run", "date"], cuts).collect()}
    assert extra["a"] > extra["b"]
    assert models.tree_probabilities(df.limit(0), ["run"], ["a", "b"], ["run", "date"], ensembles=cuts).count() == 0
    boosted = models.tree_probabilities(df, ["run"], ["a", "b"], ["run", "date"],
                                        ensembles=[forests.Ensemble("boosted", 5, 2, boosted=True)])
    means = {r.y: r.p for r in boosted.groupBy("y").agg(F.avg("probability").alias("p")).collect()}
    assert means[1] > means[0] + 0.2
