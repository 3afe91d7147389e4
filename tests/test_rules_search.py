import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideledger.operators import rules, search

D0 = dt.date(2021, 1, 1)
K = ["run"]


def ranked(spark, names, run="r"):
    return spark.createDataFrame([(run, n, i) for i, n in enumerate(names)],
                                 "run string, feature string, pos int")


def loop_wide(names, max_rules):
    out = [("single", (n,)) for n in names]
    cap2, cap3 = min(200, max_rules // 2), min(60, max_rules // 6)
    two = []
    for (i, a), (j, b) in itertools.product(enumerate(names), repeat=2):
        if i != j:
            two.append(("and_2", (a, b)))
            if (i + j) % 7 == 0:
                two.append(("or_2", (a, b)))
    three = []
    for a, b, c in zip(names, names[1:], names[2:]):
        if len(three) < cap3:
            three += [("majority_3", (a, b, c)), ("piecewise", (a, b, a))]
    return sorted(out + two[:cap2] + three)


@pytest.mark.parametrize("n,cap", [(2, 500), (6, 40), (9, 500), (20, 100)])
def test_wide_rules(spark, n, cap):
    names = [f"f{i:02d}" for i in range(n)]
    got = rules.wide_rules(ranked(spark, names), K, cap).collect()
    assert sorted((r.rule_type, tuple(r.features)) for r in got) == loop_wide(names, cap)


@pytest.mark.parametrize("n,cap", [(2, 50), (7, 11)])
def test_double_rules(spark, n, cap):
    names = [f"f{i}" for i in range(n)]
    want = [(t, p) for p in itertools.combinations(names, 2) for t in ("double_AND", "double_OR")][:cap]
    got = rules.double_rules(ranked(spark, names), K, cap).collect()
    assert sorted((r.rule_type, tuple(r.features)) for r in got) == sorted(want)


def test_triples_need_four(spark):
    assert rules.triple_rules(ranked(spark, ["a", "b", "c"]), K).count() == 0
    got = {r.rule_type: r.features for r in rules.triple_rules(ranked(spark, list("abcd")), K).collect()}
    assert got == {"triple_AND": ["a", "b", "c"], "triple_AND_OR": ["a", "b", "d"]}


def test_themed_rules_pair_across_groups(spark):
    names = ["swh_max_x", "swh_trend_3", "anom_a", "other"]
    got = rules.themed_rules(ranked(spark, names), K).collect()
    ands = {tuple(r.features) for r in got if r.rule_type == "and_2"}
    assert ands == {("swh_max_x", "swh_trend_3"), ("swh_max_x", "anom_a"), ("anom_a", "swh_trend_3")}
    assert {tuple(r.features) for r in got if r.rule_type == "or_2"} <= ands


@pytest.mark.parametrize("logic", list(itertools.product(["AND", "OR"], repeat=3)))
def test_chains_are_left_associative(spark, logic):
    grid = list(itertools.product([True, False], repeat=4))
    df = spark.createDataFrame([(list(g), list(logic)) for g in grid], "f array<boolean>, l array<string>")
    got = df.select("f", rules.chain_fired(F.col("f"), F.col("l")).alias("x"),
                    rules.rule_multi([F.get("f", F.lit(i)) for i in range(4)], logic).alias("y")).collect()
    for r in got:
        acc = r.f[0]
        for op, v in zip(logic, r.f[1:]):
            acc = (acc and v) if op == "AND" else (acc or v)
        assert r.x == acc and r.y == acc


def test_folds_expand(spark):
    rows = [("r", D0 + dt.timedelta(days=i)) for i in range(23)]
    df = spark.createDataFrame(rows, "run string, date date")
    got = [r.test_fold for r in search.time_series_folds(df, K, 4).orderBy("date").collect()]
    size = 23 // 5
    want = [-1] * (23 - 4 * size) + [f for f in range(4) for _ in range(size)]
    assert got == want


def test_stratified_folds_balance_labels(spark):
    rows = [("r", D0 + dt.timedelta(days=i), int(i % 9 == 0)) for i in range(90)]
    df = search.stratified_folds(spark.createDataFrame(rows, "run string, date date, y int"), K, "y", 5)
    assert {r.n for r in df.where("y = 1").groupBy("test_fold").agg(F.count("*").alias("n")).collect()} == {2}


def long_table(spark, seed=4, n=70, k=3):
    rng = random.Random(seed)
    data = {"good": [], "noise": [], "flat": [], "gaps": []}
    y = []
    for i in range(n):
        v = rng.random()
        y.append(int(v > 0.7))
        data["good"].append(v + 0.3 * rng.random())
        data["noise"].append(float(rng.randint(0, 4)))
        data["flat"].append(1.0)
        data["gaps"].append(v if i % 3 else None)
    rows = [("r", f, D0 + dt.timedelta(days=i), v, y[i]) for f, vs in data.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "run string, feature string, date date, value double, y int")
    return search.time_series_folds(df, ["run", "feature"], k), data, y


def brute_threshold(values, y, train, test, grid, min_accuracy=0.2):
    known = [values[i] for i in train if values[i] is not None]
    if len(known) < 5 or np.std(known, ddof=1) < 1e-6:
        return None
    cands = sorted(set(np.percentile(known, [g * 100 for g in grid])))
    if len(cands) < 2 or sum(values[i] is not None for i in test) < 5:
        return None
    best = None
    for t in cands:
        pred = [values[i] is not None and values[i] > t for i in test]
        truth = [y[i] for i in test]
        tp = sum(p and o for p, o in zip(pred, truth))
        fp = sum(p and not o for p, o in zip(pred, truth))
        fn = sum(o and not p for p, o in zip(pred, truth))
        if tp + fp == 0 or (len(test) - fp - fn) / len(test) < min_accuracy:
            continue
        f1 = 2 * tp / (2 * tp + fp + fn)
        if best is None or f1 > best[0]:
            best = (f1, t, tp, fp, fn)
    return best


@pytest.mark.parametrize("seed", [4, 9])
@pytest.mark.parametrize("score_on", ["test", "train"])
def test_threshold_search_against_loop(spark, seed, score_on):
    k, n = 3, 70
    long, data, y = long_table(spark, seed, n, k)
    got = {(r.feature, r.fold): r for r in
           search.fold_threshold_search(long, K, k, search.STABLE_GRID, score_on).collect()}
    size = n // (k + 1)
    for f, values in data.items():
        for fold in range(k):
            start = n - (k - fold) * size
            train, test = range(start), range(start, start + size)
            want = brute_threshold(values, y, train, test if score_on == "test" else train, search.STABLE_GRID)
            if want is None:
                assert (f, fold) not in got
                continue
            r = got[(f, fold)]
            assert (r.f1, r.threshold) == (pytest.approx(want[0]), pytest.approx(want[1]))
            assert (r.tp, r.fp, r.fn) == want[2:]


def test_cv_counts_every_test_day(spark):
    long, _data, _y = long_table(spark)
    cv = search.rule_cv(rules.single_rules(ranked(spark, ["good", "noise", "flat"]), K), long, K, 3)
    rows = {r.rule_id: r for r in cv.collect()}
    assert "single|flat" not in rows
    for r in rows.values():
        assert r.tp_total + r.fp_total + r.fn_total + r.tn_total == 3 * (70 // 4)


def test_greedy_prune_against_loop(spark):
    rng = random.Random(8)
    n, keep = 12, 5
    clash = {(a, b) for a in range(1, n + 1) for b in range(a + 1, n + 1) if rng.random() < 0.3}
    kept = []
    for r in range(1, n + 1):
        if len(kept) < keep and not any((a, r) in clash for a in kept):
            kept.append(r)
    cand = spark.createDataFrame([("r", i, f"rule{i}") for i in range(1, n + 1)],
                                 "run string, rank int, rule_id string")
    corr = spark.createDataFrame([("r", a, b, 0.99 if (a, b) in clash else 0.1)
                                  for a in range(1, n + 1) for b in range(a + 1, n + 1)],
                                 "run string, a int, b int, corr double")
    got = search.greedy_prune(cand, corr, K, 0.95, keep).collect()
    assert sorted(r["rank"] for r in got) == kept


@pytest.mark.parametrize("kind", ["double_AND", "double_OR"])
def test_grid_optimize_against_loop(spark, kind):
    long, data, y = long_table(spark, 6)
    rule = rules.double_rules(ranked(spark, ["good", "gaps"]), K).where(F.col("rule_type") == kind)
    got = search.grid_optimize(rule, long, K, 5).first()
    grids = [np.percentile([v for v in data[f] if v is not None], np.linspace(5, 95, 5)) for f in ("good", "gaps")]
    best = -1
    for t in itertools.product(*grids):
        hit = [[v is not None and v > x for v in data[f]] for f, x in zip(("good", "gaps"), t)]
        pred = [(a and b) if kind == "double_AND" else (a or b) for a, b in zip(*hit)]
        tp = sum(p and o for p, o in zip(pred, y))
        wrong = sum(bool(p) != bool(o) for p, o in zip(pred, y))
        best = max(best, 2 * tp / (2 * tp + wrong) if tp else 0)
    assert got.f1 == pytest.approx(best)
    assert got.tp + got.fp + got.fn + got.tn == len(y)


def test_stable_rules_fall_back_per_key(spark):
    rows = [("a", "x", 0.7, 0.1, 5), ("a", "y", 0.5, 0.1, 5), ("b", "x", 0.2, 0.1, 5), ("b", "y", 0.3, None, 5)]
    cv = spark.createDataFrame(rows, "run string, rule_id string, f1_mean double, f1_std double, n_folds int")
    got = sorted((r.run, r.rule_id) for r in search.stable_rules(cv, K, fallback=1).collect())
    assert got == [("a", "x"), ("b", "y")]
