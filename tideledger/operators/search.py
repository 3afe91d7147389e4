"""Cross-validated search of thresholds and rules.

Input is the long table (keys, feature, date, value, y) with `test_fold` from
`time_series_folds`; keys are the run or port. Nothing is copied per rule but the rows a
rule reads, and thresholds are scored from per-bucket counts instead of one pass each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideledger.functions.scalars import (confusion_aggs, hash_draw, ratio, with_metrics)
from tideledger.operators.quantiles import rank_in
from tideledger.operators.rules import combine_slots, rule_slots
from tideledger.session import durable

# Percentile grids of the threshold search.
FINE_GRID = [p / 100 for p in range(5, 96, 2)]
COARSE_GRID = [p / 100 for p in range(10, 91, 10)]
STABLE_GRID = [p / 100 for p in range(10, 95, 5)]


def time_series_folds(days: DataFrame, keys: Sequence[str], k: int, order: str = "date",
                      ) -> DataFrame:
    """Adds test_fold: -1 for the rows only ever trained on, else the fold the row tests.

    Expanding windows with k folds of n // (k + 1) rows: a row trains fold f when its own
    test_fold is below f.
    """
    series = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(series)
    i = F.row_number().over(series.orderBy(order)) - 1
    numbered = days.withColumns({"__n": n, "__i": i})
    size = F.floor(F.col("__n") / (k + 1))
    start = F.col("__n") - k * size
    fold = F.when(F.col("__i") < start, -1).otherwise(
        F.floor((F.col("__i") - start) / size)).cast("int")
    return numbered.withColumn("test_fold", fold).drop("__n", "__i")


def stratified_folds(days: DataFrame, keys: Sequence[str], label: str, k: int, seed: int = 42,
                     order: str = "date") -> DataFrame:
    """Hash-shuffled folds with the label balanced across them."""
    draw = hash_draw(F.lit(seed), *[F.col(c) for c in keys], F.col(order))
    w = Window.partitionBy(*keys, label).orderBy(draw, order)
    return days.withColumn("test_fold", F.ntile(k).over(w) - 1)


def _train_rows(long: DataFrame, k: int) -> DataFrame:
    """A row per fold that a day trains in; made after the days were dealt, so the copies are not shuffled."""
    return (long.where(F.col("test_fold") < k - 1)
                .withColumn("fold", F.explode(F.sequence(F.col("test_fold") + 1, F.lit(k - 1)))))


def fold_threshold_search(long: DataFrame, keys: Sequence[str], k: int,
                          grid: Sequence[float] = FINE_GRID, score_on: str = "test",
                          min_accuracy: float = 0.2, min_rows: int = 5,
                          min_sd: float = 1e-6) -> DataFrame:
    """Best threshold per (keys, feature, fold) with its counts.

    Candidates are train-fold percentiles; the best F1 on the scored rows wins, the lowest
    threshold on ties. score_on='test' scores on the fold itself, 'train' does not look at it.
    """
    by = [*keys, "feature", "fold"]
    # dealt once by series: grouping by series and fold needs no other shuffle
    long = long.select(*keys, "feature", "test_fold", "value", "y").repartition(*keys, "feature")
    train = _train_rows(long, k)
    cand = (train.groupBy(*by)
                 .agg(F.count("value").alias("__n"), F.stddev_samp("value").alias("__sd"),
                      F.percentile("value", F.array(*[F.lit(float(p)) for p in grid]))
                       .alias("__p"))
                 .where((F.col("__n") >= min_rows) & (F.col("__sd") >= min_sd))
                 .withColumn("__t", F.array_distinct("__p"))
                 .where(F.size("__t") >= 2).select(*by, "__t"))
    scored = (long.where(F.col("test_fold") >= 0).withColumn("fold", F.col("test_fold"))
              if score_on == "test" else train)
    # how many candidates each row exceeds: a row fires candidates 0 .. level - 1
    cells = (rank_in(scored.join(cand, by), "__t", "value", "__level", len(grid))
                   .groupBy(*by, "__level")
                   .agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("known"),
                        F.sum("y").alias("pos")))
    packed = (cells.groupBy(*by)     # at most one cell per candidate
                   .agg(F.collect_list(F.struct("__level", "n", "pos")).alias("__cells"),
                        F.sum("n").alias("__rows"), F.sum("known").alias("__known"),
                        F.sum("pos").alias("__pos"))
                   .where(F.col("__known") >= min_rows)
                   .join(cand, by)
                   .select(*by, "__cells", "__rows", "__pos",
                           F.posexplode("__t").alias("__j", "threshold")))

    def above(field: str) -> Column:
        return F.aggregate(F.filter("__cells", lambda c: c.getField("__level") > F.col("__j")),
                           F.lit(0).cast("bigint"), lambda acc, c: acc + c.getField(field))

    counted = (packed.withColumns({"__fired": above("n"), "tp": above("pos")})
                     .where(F.col("__fired") > 0)
                     .withColumns({"fp": F.col("__fired") - F.col("tp"),
                                   "fn": F.col("__pos") - F.col("tp")})
                     .withColumn("tn", F.col("__rows") - F.col("__fired") - F.col("fn")))
    best = (with_metrics(counted).where(F.col("accuracy") >= min_accuracy)
            .groupBy(*by)
            .agg(F.max(F.struct(F.col("f1"), (-F.col("threshold")).alias("neg"), "tp", "fp",
                                "tn", "fn")).alias("b")))
    return best.select(*by, (-F.col("b.neg")).alias("threshold"), F.col("b.f1").alias("f1"),
                       "b.tp", "b.fp", "b.tn", "b.fn")


def fire_rules(slots: DataFrame, thresholds: DataFrame, rows: DataFrame,
               keys: Sequence[str]) -> DataFrame:
    """Flag per (keys, rule_id, fold, date) where every slot of the rule has a threshold.

    `slots` from `rule_slots`, `thresholds` (keys, feature, fold, threshold), `rows`
    (keys, feature, fold, date, value, y).
    """
    armed = slots.join(thresholds.select(*keys, "feature", "fold", "threshold"),
                       [*keys, "feature"])
    hits = (armed.join(rows, [*keys, "feature", "fold"])
                 .withColumn("__f", F.coalesce(F.col("value") > F.col("threshold"),
                                               F.lit(False))))
    # clustered by rule and fold first: the day roll-up and any later run-length window
    # over (keys, rule_id, fold) then need no further shuffle
    hits = hits.repartition(*[F.col(c) for c in (*keys, "rule_id", "fold")])
    per_day = (hits.groupBy(*keys, "rule_id", "fold", "date")
                   .agg(F.first("rule_type").alias("rule_type"), F.first("logic").alias("logic"),
                        F.first("n_slots").alias("n_slots"), F.max("y").alias("y"),
                        F.array_sort(F.collect_list(F.struct("slot", "__f"))).alias("__s"))
                   .where(F.size("__s") == F.col("n_slots")))
    fired = F.transform("__s", lambda s: s.getField("__f"))
    return per_day.select(
        *keys, "rule_id", "rule_type", "fold", "date", "y",
        combine_slots(F.col("rule_type"), fired, F.col("logic")).cast("int").alias("pred"))


def cv_summary(fold_metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Means and totals over folds."""
    return fold_metrics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.avg("f1").alias("f1_mean"), F.stddev_samp("f1").alias("f1_std"),
        F.avg("precision").alias("precision_mean"), F.avg("recall").alias("recall_mean"),
        F.avg("accuracy").alias("accuracy_mean"),
        *[F.sum(c).alias(f"{c}_total") for c in ("tp", "fp", "tn", "fn")])


def rule_cv(rules: DataFrame, long: DataFrame, keys: Sequence[str], k: int,
            thresholds: DataFrame | None = None, min_folds: int = 3, smooth_days: int = 2,
            **search) -> DataFrame:
    """Thresholds, fold metrics and their summary; rules with too few folds are left out."""
    if thresholds is None:
        thresholds = fold_threshold_search(long, keys, k, **search)
    from tideledger.operators.bitmaps import rule_fold_metrics
    folds = rule_fold_metrics(rules, thresholds, long, keys, smooth_days)
    return cv_summary(folds, [*keys, "rule_id", "rule_type"]).where(F.col("n_folds") >= min_folds)


def stable_rules(cv: DataFrame, keys: Sequence[str], min_f1: float = 0.6, max_std: float = 0.2,
                 min_folds: int = 4, fallback: int = 10) -> DataFrame:
    """Rules good and steady enough; a key without any keeps its `fallback` best instead."""
    whole = Window.partitionBy(*keys)
    ok = ((F.col("f1_mean") >= min_f1) & (F.col("f1_std") <= max_std)
          & (F.col("n_folds") >= min_folds))
    ranked = cv.withColumns({
        "__ok": F.coalesce(ok, F.lit(False)),
        "__rank": F.row_number().over(whole.orderBy(F.desc("f1_mean"), "rule_id"))})
    some = F.max("__ok").over(whole)
    return (ranked.withColumn("__some", some)
                  .where(F.when(F.col("__some"), F.col("__ok"))
                          .otherwise(F.col("__rank") <= fallback))
                  .drop("__ok", "__some", "__rank"))


def prune_candidates(cv: DataFrame, keys: Sequence[str], max_std: float = 0.18,
                     min_folds: int = 4, top: int = 30) -> DataFrame:
    """The best rules by F1 that enter redundancy pruning, ranked 1 .. top.

    A key where no rule is steady enough goes on with all its rules.
    """
    steady = stable_rules(cv, keys, min_f1=-1.0, max_std=max_std, min_folds=min_folds,
                          fallback=top)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("f1_mean"), "rule_id"))
    return steady.withColumn("rank", place).where(F.col("rank") <= top)


def rule_pair_corr(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Correlation of each ranked rule's flags with those ranked before it, 0 if one is flat.

    `preds` is (keys, rank, date, pred); the ranks are capped, so pairs are too.
    """
    a = preds.select(*keys, "date", F.col("rank").alias("a"), F.col("pred").alias("pa"))
    b = preds.select(*keys, "date", F.col("rank").alias("b"), F.col("pred").alias("pb"))
    pairs = a.join(b, [*keys, "date"]).where(F.col("a") < F.col("b"))
    n, sa, sb = F.count(F.lit(1)), F.sum("pa"), F.sum("pb")
    # 0/1 flags: the sums are whole numbers, so this form is exact up to the last division
    cov = n * F.sum(F.col("pa") * F.col("pb")) - sa * sb
    var = (n * sa - sa * sa).cast("double") * (n * sb - sb * sb)
    return pairs.groupBy(*keys, "a", "b").agg(
        F.coalesce(F.try_divide(cov.cast("double"), F.sqrt(var)), F.lit(0.0)).alias("corr"))


def greedy_prune(candidates: DataFrame, corr: DataFrame, keys: Sequence[str],
                 limit: float = 0.95, keep: int = 15) -> DataFrame:
    """Walk rules in rank order; keep one unless it repeats a kept one; stop at `keep`.

    The walk folds an array of at most `top` ranks per key, so it stays one expression.
    """
    clash = (corr.where(F.col("corr") > limit).groupBy(*keys, F.col("b").alias("rank"))
                 .agg(F.collect_list("a").alias("__clash")))
    walk = (candidates.join(clash, [*keys, "rank"], "left")
                      .groupBy(*keys)
                      .agg(F.array_sort(F.collect_list(F.struct(
                          F.col("rank"),
                          F.coalesce("__clash", F.array().cast("array<int>")).alias("clash"))))
                          .alias("__w")))
    kept = F.aggregate(
        "__w", F.array().cast("array<int>"),
        lambda acc, r: F.when(
            (F.size(acc) < keep) & ~F.arrays_overlap(acc, r.getField("clash")),
            F.concat(acc, F.array(r.getField("rank")))).otherwise(acc))
    return walk.select(*keys, F.explode(kept).alias("rank")).join(candidates, [*keys, "rank"])


def first_fold_flags(rules: DataFrame, thresholds: DataFrame, long: DataFrame,
                     keys: Sequence[str]) -> DataFrame:
    """Flags of each rule over all days with the thresholds of its first complete fold."""
    slots = rule_slots(rules, keys)
    armed = (slots.join(thresholds.select(*keys, "feature", "fold", "threshold"),
                        [*keys, "feature"])
                  .groupBy(*keys, "rule_id", "fold")
                  .agg(F.count(F.lit(1)).alias("__c"), F.first("n_slots").alias("__n"))
                  .where(F.col("__c") == F.col("__n"))
                  .groupBy(*keys, "rule_id").agg(F.min("fold").alias("fold")))
    chosen = slots.join(armed, [*keys, "rule_id"])
    days = long.select(*keys, "feature", "date", "value", "y")
    limits = thresholds.select(*keys, "feature", "fold", "threshold")
    hits = (chosen.join(limits, [*keys, "feature", "fold"]).join(days, [*keys, "feature"])
                  .withColumn("__f", F.coalesce(F.col("value") > F.col("threshold"),
                                                F.lit(False))))
    per_day = hits.groupBy(*keys, "rule_id", "date").agg(
        F.first("rule_type").alias("rule_type"), F.first("logic").alias("logic"),
        F.max("y").alias("y"), F.array_sort(F.collect_list(F.struct("slot", "__f"))).alias("__s"))
    fired = F.transform("__s", lambda s: s.getField("__f"))
    return per_day.select(*keys, "rule_id", "date", "y",
                          combine_slots(F.col("rule_type"), fired, F.col("logic"))
                          .cast("int").alias("pred"))


def ensemble_vote(flags: DataFrame, keys: Sequence[str], at_least: int = 3) -> DataFrame:
    """Fire on days where at least `at_least` of the kept rules fire."""
    return flags.groupBy(*keys, "date").agg(
        F.sum("pred").alias("votes"), (F.sum("pred") >= at_least).cast("int")
        .alias("ensemble_pred"))


def ensemble_wide(flags: DataFrame, keys: Sequence[str], ranks: Sequence[int]) -> DataFrame:
    """One prediction column per kept rule position."""
    wide = flags.groupBy(*keys, "date").pivot("rank", list(ranks)).agg(F.max("pred"))
    return wide.withColumnsRenamed({str(r): f"rule_{r}_pred" for r in ranks})


def best_rule(cv: DataFrame, thresholds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best single rule by F1, precision, recall with the mean, median and p75 threshold."""
    order = Window.partitionBy(*keys).orderBy(F.desc("f1_mean"), F.desc("precision_mean"),
                                              F.desc("recall_mean"), "rule_id")
    top = (cv.where(F.col("rule_type") == "single").withColumn("__r", F.row_number().over(order))
             .where(F.col("__r") == 1)
             .withColumn("feature", F.substring_index("rule_id", "|", -1)))
    return (top.select(*keys, "feature", "f1_mean").join(thresholds, [*keys, "feature"])
               .groupBy(*keys, "feature").agg(
                   F.first("f1_mean").alias("f1_mean"), F.count(F.lit(1)).alias("n_folds"),
                   F.avg("threshold").alias("threshold_mean"),
                   F.median("threshold").alias("threshold_median"),
                   F.percentile("threshold", F.lit(0.75)).alias("threshold_p75")))


# ---- grid search of one combination --------------------------------------------------------

def grid_values(long: DataFrame, keys: Sequence[str], size: int = 5) -> DataFrame:
    """Percentile grid from the 5th to the 95th per (keys, feature): (level, threshold)."""
    steps = [0.05 + 0.90 * i / (size - 1) for i in range(size)]
    return (long.groupBy(*keys, "feature")
                .agg(F.percentile("value", F.array(*[F.lit(s) for s in steps])).alias("__t"))
                .select(*keys, "feature", F.posexplode("__t").alias("level", "threshold")))


#: Odd multipliers of the rounds that scramble a combination's number.
SCRAMBLE = (736_339, 611_953, 999_331, 524_287)
#: More combinations than this are refused: products with a multiplier must stay whole numbers of 64 bits.
MOST_COMBINATIONS = 1 << 42


def scrambled(number: Column, bits: Column, count: Column, *key: Column) -> Column:
    """A keyed permutation of 0 .. count - 1 (count <= 2 ** bits) applied to `number`.

    A round multiplies by an odd number, adds a drawn one and folds the upper half into the lower: each
    can be undone within `bits` bits. Numbers at or above `count` go round again, which keeps it a permutation.
    """
    top = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits)
    half = F.floor((bits + 1) / 2).cast("int")
    added = [hash_draw(*key, F.lit(k)) for k in range(len(SCRAMBLE))]

    def rounds(x: Column) -> Column:
        for factor, plus in zip(SCRAMBLE, added):
            x = (x * F.lit(factor).cast("bigint") + plus) % top
            x = F.aggregate(F.array(x), F.lit(0).cast("bigint"), lambda _, y: y.bitwiseXOR(F.call_function("shiftright", y, half)))
        return x

    # each turn lands below `count` with a chance of a half or more
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(number.cast("bigint").alias("x"), F.lit(False).alias("in")),
                       lambda acc, _: F.when(acc["in"], acc).otherwise(
                           F.aggregate(F.array(rounds(acc["x"])), acc, lambda a, y: F.struct(y.alias("x"), (y < count).alias("in")))),
                       lambda acc: acc["x"])


def threshold_grid(slots: DataFrame, grid: DataFrame, keys: Sequence[str], max_points: int = 200,
                   seed: int = 42) -> DataFrame:
    """All combinations of the slots' grid levels, or `max_points` of them per rule, drawn without repeats.

    One row per combination with `levels` and `thresholds` arrays in slot order. Combinations are
    numbered; the numbers that a keyed permutation (of seed and rule) puts first are decoded digit by
    digit, a digit per slot, so the product is never made.
    """
    per_slot = (slots.join(grid, [*keys, "feature"])
                     .groupBy(*keys, "rule_id", "slot")
                     .agg(F.array_sort(F.collect_list(F.struct("level", "threshold")))
                           .alias("__g")))
    one = F.lit(1).cast("bigint")
    packed = per_slot.groupBy(*keys, "rule_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "__g"))),
                    lambda s: s.getField("__g")).alias("__gs"))

    def product(lists: Column) -> Column:
        return F.aggregate(lists, one, lambda acc, g: F.when(acc > MOST_COMBINATIONS, acc).otherwise(acc * F.size(g)))

    packed = packed.withColumn("__count", product(F.col("__gs"))).withColumn("__count", F.when(
        F.col("__count") <= MOST_COMBINATIONS, F.col("__count")).otherwise(
            F.raise_error(F.concat(F.lit("too many combinations: "), "rule_id")).cast("bigint")))
    bits = F.length(F.bin(F.greatest(F.col("__count") - 1, one)))
    drawn = packed.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least("__count", F.lit(max_points)) - 1)))
    number = F.when(F.col("__count") <= max_points, F.col("__i")).otherwise(
        scrambled(F.col("__i"), bits, F.col("__count"), F.lit(seed), F.col("rule_id")))
    # a slot's digit has the product of the later slots' sizes below it
    later = F.transform("__gs", lambda g, i: product(F.slice("__gs", i + 2, F.size("__gs"))))
    picked = F.transform(F.arrays_zip(F.col("__gs").alias("g"), F.col("__later").alias("below")), lambda z: F.get(
        z["g"], (F.floor(F.col("__number") / z["below"]) % F.size(z["g"])).cast("int")))
    points = (drawn.withColumns({"__number": number, "__later": later}).withColumn("__pt", picked))
    return points.select(
        *keys, "rule_id", F.transform("__pt", lambda x: x.getField("level")).alias("levels"),
        F.transform("__pt", lambda x: x.getField("threshold")).alias("thresholds"))


def grid_optimize(rules: DataFrame, long: DataFrame, keys: Sequence[str], size: int = 5,
                  metric: str = "f1", max_points: int = 200, seed: int = 42) -> DataFrame:
    """Best threshold combination per rule over all days.

    Days are first counted by the grid cell they fall in, (size + 1)^slots cells per rule, and
    the combinations are scored on the cells; the cost of a combination does not grow with days.
    """
    slots = rule_slots(rules, keys)
    grid = grid_values(long, keys, size)
    ladders = grid.groupBy(*keys, "feature").agg(
        F.array_sort(F.collect_list("threshold")).alias("__t"))
    leveled = (rank_in(long.join(ladders, [*keys, "feature"]), "__t", "value", "lv", size)
               .select(*keys, "feature", "date", "y", "lv"))
    cells = (slots.join(leveled, [*keys, "feature"])
                  .groupBy(*keys, "rule_id", "date")
                  .agg(F.max("y").alias("y"),
                       F.transform(F.array_sort(F.collect_list(F.struct("slot", "lv"))),
                                   lambda s: s.getField("lv")).alias("cell"))
                  .groupBy(*keys, "rule_id", "cell")
                  .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")))
    points = threshold_grid(slots, grid, keys, max_points, seed)
    kinds = rules.select(*keys, "rule_id", "rule_type", "logic")
    fired = F.zip_with("cell", "levels", lambda c, l: c > l)
    scored = (points.join(kinds, [*keys, "rule_id"]).join(cells, [*keys, "rule_id"])
                    .withColumn("__f", combine_slots(F.col("rule_type"), fired, F.col("logic")))
                    .groupBy(*keys, "rule_id", "rule_type", "levels", "thresholds")
                    .agg(F.sum(F.when(F.col("__f"), F.col("pos")).otherwise(0)).alias("tp"),
                         F.sum(F.when(F.col("__f"), F.col("n") - F.col("pos")).otherwise(0))
                          .alias("fp"),
                         F.sum(F.when(~F.col("__f"), F.col("pos")).otherwise(0)).alias("fn"),
                         F.sum(F.when(~F.col("__f"), F.col("n") - F.col("pos")).otherwise(0))
                          .alias("tn")))
    order = Window.partitionBy(*keys, "rule_id").orderBy(F.desc(metric), "levels")
    return (with_metrics(scored).withColumn("__r", F.row_number().over(order))
            .where(F.col("__r") == 1).drop("__r"))


def compare_with_baseline(multi: DataFrame, single: DataFrame, keys: Sequence[str],
                          top: int = 3) -> DataFrame:
    """Best multi rules against the best single rule: percent change in loss and F1."""
    order = Window.partitionBy(*keys).orderBy("mean_loss", "rule_id")
    best = (multi.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top))
    base = single.select(*keys, F.col("mean_loss").alias("single_loss"),
                         F.col("f1").alias("single_f1"))
    return (best.join(base, list(keys))
                .withColumns({
                    "loss_change_pct": ratio(F.col("single_loss") - F.col("mean_loss"),
                                             F.col("single_loss"), 0.0) * 100,
                    "f1_change_pct": ratio(F.col("f1") - F.col("single_f1"),
                                           F.col("single_f1"), 0.0) * 100}))


def rule_detail(thresholds: DataFrame, long: DataFrame, keys: Sequence[str], top: int = 3) -> DataFrame:
    """Best single rules in full: counts over all days, firing rate, threshold percentile.

    `thresholds` is (keys, feature, threshold, score), one row per rule.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "feature")
    best = (thresholds.withColumn("place", F.row_number().over(order))
                      .where(F.col("place") <= top))
    above = F.coalesce((F.col("value") > F.col("threshold")).cast("int"), F.lit(0))
    rows = long.join(best, [*keys, "feature"]).withColumn("pred", above)
    counts = rows.groupBy(*keys, "feature", "place", "threshold").agg(
        *confusion_aggs(F.col("pred"), F.col("y")), F.avg("pred").alias("fire_rate"),
        (F.avg((F.col("value") <= F.col("threshold")).cast("double")) * 100)
        .alias("threshold_pct"))
    return with_metrics(counts)


def arm_rules(rules: DataFrame, thresholds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rules with their thresholds in slot order; (keys, feature, threshold) holds one per feature."""
    slots = rule_slots(rules, keys).join(thresholds, [*keys, "feature"])
    return (slots.groupBy(*keys, "rule_id", "rule_type", "logic", "n_slots")
                 .agg(F.array_sort(F.collect_list(F.struct("slot", "feature", "threshold")))
                       .alias("__s"))
                 .where(F.size("__s") == F.col("n_slots"))
                 .select(*keys, "rule_id", "rule_type", "logic",
                         F.transform("__s", lambda s: s.getField("feature")).alias("features"),
                         F.transform("__s", lambda s: s.getField("threshold"))
                          .alias("thresholds")))


def fire_wide(days: DataFrame, armed: DataFrame, keys: Sequence[str],
              features: Sequence[str]) -> DataFrame:
    """Every armed rule on every row of a wide table: adds rule_id, rule_type and pred.

    The features of a row travel as one map, so any number of rules is one expression. The
    rules are written first, so the days meet a table of known size.
    """
    values = F.create_map(*[x for f in features for x in (F.lit(f), F.col(f))])
    joined = days.join(durable(armed), list(keys)).withColumn("__m", values)
    fired = F.zip_with("features", "thresholds",
                       lambda f, t: F.coalesce(F.element_at(F.col("__m"), f) > t, F.lit(False)))
    hit = combine_slots(F.col("rule_type"), fired, F.col("logic"))
    return (joined.withColumn("pred", hit.cast("int"))
                  .drop("__m", "features", "thresholds", "logic"))
