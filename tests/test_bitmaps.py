import datetime as dt
import random

from pyspark.sql import functions as F

from tideledger.operators import bitmaps, rules, search
from tideledger.operators.runs import keep_long_runs

D0 = dt.date(2021, 1, 1)


def sample(spark, days=300):
    rng = random.Random(4)
    rows = [("p", D0 + dt.timedelta(days=i), f, None if rng.random() < 0.05 else rng.random(), int(i % 9 < 3), i // 100)
            for i in range(days) for f in ("a", "b", "c")]
    long = spark.createDataFrame(rows, "port_name string, date date, feature string, value double, y int, test_fold int")
    limits = spark.createDataFrame([("p", f, k, 0.3 + 0.1 * k) for f in ("a", "b", "c") for k in range(3) if (f, k) != ("c", 0)],
                                   "port_name string, feature string, fold int, threshold double")
    ranked = spark.createDataFrame([("p", f, i) for i, f in enumerate("abc")], "port_name string, feature string, pos int")
    return long, limits, rules.wide_rules(ranked, ["port_name"], 500)


def test_rules_by_sets_equal_rules_by_days(spark):
    long, limits, wide = sample(spark)
    key = ["port_name"]
    rows = long.select(*key, "feature", F.col("test_fold").alias("fold"), "date", "value", "y")
    flags = search.fire_rules(rules.rule_slots(wide, key), limits, rows, key)
    for days in (1, 2, 3):
        kept = keep_long_runs(flags, ["port_name", "rule_id", "fold"], "date", "pred", days, "pred")
        want = {(r.rule_id, r.fold): (r.tp, r.fp, r.fn, r.tn) for r in kept.groupBy("rule_id", "fold").agg(
            *[F.count_if(c).alias(n) for n, c in (("tp", (F.col("pred") == 1) & (F.col("y") == 1)), ("fp", (F.col("pred") == 1) & (F.col("y") == 0)),
                                                  ("fn", (F.col("pred") == 0) & (F.col("y") == 1)), ("tn", (F.col("pred") == 0) & (F.col("y") == 0)))]).collect()}
        got = {(r.rule_id, r.fold): (r.tp, r.fp, r.fn, r.tn)
               for r in bitmaps.rule_fold_metrics(wide, limits, long, key, days).collect()}
        assert got == want and len({i for i, _ in got}) > 10
    assert not any("c" in i.split("|")[1].split("+") and k == 0 for i, k in got)  # no threshold in that fold


def test_correlation_and_votes_equal_days(spark):
    long, limits, wide = sample(spark)
    key = ["port_name"]
    sets, days, whole = bitmaps.first_fold_sets(wide, limits, long, key)
    flags = search.first_fold_flags(wide, limits, long, key)
    ids = sorted(r.rule_id for r in sets.select("rule_id").distinct().collect())
    rank = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("rule_id")).cast("int")
    ranked = sets.withColumns({"rank": rank, "rule_name": F.col("rule_id"), "f1_mean": F.lit(0.5)})
    want = {(r.a, r.b): round(r["corr"], 9) for r in search.rule_pair_corr(flags.withColumn("rank", rank), key).collect()}
    assert {(r.a, r.b): round(r["corr"], 9) for r in bitmaps.pair_correlation(ranked, whole, key).collect()} == want
    votes = {r.date: (r.votes, r.ensemble_pred) for r in search.ensemble_vote(flags, key).collect()}
    table = bitmaps.ensemble_table(ranked, days, key, columns=len(ids) + 1)
    got = table.collect()
    assert {r.date: (r.votes, r.ensemble_pred) for r in got} == votes
    by_day = {(r.date, r.rule_id): r.pred for r in flags.collect()}
    assert all(r[f"rule_{k}_pred"] == by_day[r.date, i] and r[f"rule_{k}_name"] == i for r in got for k, i in enumerate(ids, 1))
    assert all(r[f"rule_{len(ids) + 1}_pred"] is None for r in got)
