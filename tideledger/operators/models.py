"""Classifiers beside the rules: logistic variants, trees, calibration, threshold sweeps.

Every fit has a run key: the logistic fits of all runs, folds, feature sets and variants are solved
together (`newton.py`), so the number of jobs does not grow with them. Trees are grown level by
level for all runs (`forests.py`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideledger.functions.scalars import hash_draw, with_metrics
from tideledger.operators import forests, newton
from tideledger.operators.forests import Ensemble


# Tree models beside the logistic ones.
TREE_MODELS = [
    Ensemble("tree", 1, 3), Ensemble("forest", 100, 3, features="sqrt", resample=True),
    Ensemble("boosted", 100, 3, boosted=True),
]


def tree_probabilities(rows: DataFrame, keys: Sequence[str], features: Sequence[str], order: Sequence[str], label: str = "y",
                       ensembles: Sequence[Ensemble] = tuple(TREE_MODELS)) -> DataFrame:
    """Rows with variant and probability of the ensembles grown on all rows of their run; `order` names a row of it."""
    blocks = forests.pack(rows, keys, features, label, order)
    grown = forests.grow(blocks, keys, len(features), ensembles)
    scored = forests.probabilities(blocks, grown, keys, ensembles)
    names = F.array(*[F.lit(e.name) for e in ensembles])
    made = scored.select(*keys, "rid", F.get(names, F.col("ensemble")).alias("variant"), "probability")
    return rows.withColumn("rid", F.xxhash64(*order)).join(made, [*keys, "rid"]).drop("rid")


def parts_of(order: Sequence[str], k: int, seed: int = 42) -> Column:
    """Calibration part of a row, 0 to k - 1, the same on any retry."""
    return hash_draw(F.lit(seed), *[F.col(c) for c in order]) % k


def logistic_probabilities(rows: DataFrame, keys: Sequence[str], features: Sequence[str], label: str = "y",
                           variants: Sequence[str] = tuple(newton.VARIANTS)) -> DataFrame:
    """Rows with variant and probability of the fit on all rows of their run.

    Runs of one class have no fit and no rows.
    """
    blocks = newton.pack(rows, keys, features, label)
    fits = newton.fit(blocks, keys, features, newton.grid(variants=variants))
    return newton.scored(rows, fits, keys, features).drop("set", "n_parts")


def calibrated_probabilities(rows: DataFrame, keys: Sequence[str], features: Sequence[str], order: Sequence[str],
                             k: int, label: str = "y", variants: Sequence[str] = ("L2",)) -> DataFrame:
    """Rows with variant and the mean of k probabilities: fitted without one part, its scores brought to a sigmoid.

    Targets of the sigmoid are smoothed by the counts of the part. A run where a part leaves one
    class to train on has no rows.
    """
    blocks = newton.pack(rows, keys, features, label, part=parts_of(order, k))
    fits = newton.fit(blocks, keys, features, newton.grid(parts=range(k), variants=variants))
    made = newton.scored(rows, newton.calibrate(blocks, fits, keys), keys, features)
    return made.where(F.col("n_parts") == k).drop("set", "n_parts")


def threshold_sweep(probs: DataFrame, keys: Sequence[str], probability: str = "probability",
                    label: str = "label", start: float = 0.001, step: float = 0.001,
                    count: int = 994, strict: bool = False) -> DataFrame:
    """Best F1 threshold per key among start + i x step, i < count; the lowest on ties.

    Rows are counted per highest threshold they reach and added up from the top; no pass per
    threshold. A row is positive at or above the threshold, with `strict` above it.
    """
    spot = F.round((F.col(probability) - start) / step, 6)
    level = (F.ceil(spot) - 1) if strict else F.floor(spot)
    level = F.least(F.greatest(level, F.lit(-1)), F.lit(count - 1)).cast("int")
    cells = (probs.groupBy(*keys, level.alias("__lv"))
                  .agg(F.count(F.lit(1)).alias("__n"), F.sum(label).alias("__pos")))
    up = Window.partitionBy(*keys).orderBy("__lv")
    from_top = up.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*keys)
    counted = cells.withColumns({
        "__fired": F.sum("__n").over(from_top), "tp": F.sum("__pos").over(from_top),
        "__all": F.sum("__n").over(whole), "__p": F.sum("__pos").over(whole),
        "__low": F.coalesce(F.lag("__lv").over(up) + 1, F.lit(0))})
    usable = (counted.where((F.col("__lv") >= 0) & (F.col("tp") > 0))
              .withColumns({"threshold": F.col("__low") * step + start,
                            "fp": F.col("__fired") - F.col("tp"), "fn": F.col("__p") - F.col("tp")})
              .withColumn("tn", F.col("__all") - F.col("__fired") - F.col("fn")))
    best = Window.partitionBy(*keys).orderBy(F.desc("f1"), "threshold")
    cols = ["threshold", "tp", "fp", "tn", "fn", "precision", "recall", "accuracy", "f1"]
    return (with_metrics(usable).withColumn("__r", F.row_number().over(best))
            .where(F.col("__r") == 1).select(*keys, *cols))


def fold_probabilities(data: DataFrame, keys: Sequence[str], feature_sets: Mapping[str, Sequence[str]],
                       variants: Sequence[str], k: int, order: Sequence[str], cal_parts: int = 2,
                       label: str = "y") -> DataFrame:
    """Calibrated test-fold probabilities of an expanding-window cross-validation, per set and variant.

    `data` has test_fold. A fold is left out where its training rows, or those without a
    calibration part, are of one class, or where it has no positive test row.
    """
    features = list(dict.fromkeys(f for fs in feature_sets.values() for f in fs))
    blocks = newton.pack(data, keys, features, label, F.col("test_fold"), parts_of(order, cal_parts))
    fits = newton.fit(blocks, keys, features, newton.grid(
        list(feature_sets), range(k), range(cal_parts), variants), sets=feature_sets)
    made = newton.scored(data, newton.calibrate(blocks, fits, keys), keys, features, fold="test_fold")
    usable = (data.groupBy(*keys, "test_fold").agg(F.sum(label).alias("__p")).where("__p > 0").drop("__p"))
    return made.where(F.col("n_parts") == cal_parts).drop("n_parts").join(usable, [*keys, "test_fold"], "left_semi")


def model_cv(data: DataFrame, keys: Sequence[str], feature_sets: Mapping[str, Sequence[str]], variants: Sequence[str],
             k: int, order: Sequence[str], step: float = 0.001, cal_parts: int = 2, label: str = "y") -> DataFrame:
    """Best threshold and metrics per run, set, variant and fold, for those with two usable folds or more.

    A fold in which no threshold finds a positive row counts with threshold 0.5 and an F1 of 0.
    """
    probs = fold_probabilities(data, keys, feature_sets, variants, k, order, cal_parts, label)
    by = [*keys, "set", "variant", "test_fold"]
    cells = probs.select(*by, "probability", F.col(label).alias("label"))
    found = threshold_sweep(cells, by, start=0.01, step=step, count=int(round(0.98 / step)))
    fired = F.col("probability") >= 0.5
    plain = cells.groupBy(*by).agg(*[F.count_if(c).alias(f"__{n}") for n, c in (
        ("fp", fired), ("fn", ~fired & (F.col("label") == 1)), ("tn", ~fired & (F.col("label") == 0)))])
    names = ("tp", "fp", "tn", "fn", "precision", "recall", "accuracy", "f1")
    missed = with_metrics(plain.join(found, by, "left_anti").select(
        *by, F.lit(0.5).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.col("__fp").alias("fp"),
        F.col("__tn").alias("tn"), F.col("__fn").alias("fn"))).select(*by, "threshold", *names)
    folds = found.select(*by, "threshold", *names).unionByName(missed)
    several = Window.partitionBy(*keys, "set", "variant")
    return folds.withColumn("__n", F.count(F.lit(1)).over(several)).where("__n >= 2").drop("__n")


def model_grid(data: DataFrame, keys: Sequence[str], feature_sets: Mapping[str, Sequence[str]],
               variants: Sequence[str], k: int, order: Sequence[str], label: str = "y") -> DataFrame:
    """Feature sets x logistic variants of each run ranked by mean fold F1."""
    folds = model_cv(data, keys, feature_sets, variants, k, order, label=label)
    sizes = F.create_map(*[F.lit(v) for name, fs in feature_sets.items() for v in (name, len(fs))])
    summary = folds.groupBy(*keys, "set", "variant").agg(
        F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("std_f1"),
        F.avg("threshold").alias("mean_threshold"), F.count(F.lit(1)).alias("n_folds"))
    # means of equal folds differ in their last bits by the order of addition
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round("mean_f1", 12)), "set", "variant"))
    return summary.select(*keys, F.col("set").alias("feature_set"), F.col("variant").alias("lr_variant"), "mean_f1", "std_f1",
                          "mean_threshold", "n_folds", sizes[F.col("set")].alias("n_features"), place.alias("place"))


def best_models(graded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Set, variant, threshold and F1 of each run's first model."""
    return graded.where("place = 1").select(*keys, "feature_set", "lr_variant", F.col("mean_threshold").alias("optimal_threshold"),
                                            F.col("mean_f1").alias("cv_f1_score"))


def fit_predict_holdout(rows: DataFrame, keys: Sequence[str], feature_sets: Mapping[str, Sequence[str]], best: DataFrame,
                        holdout_year: int, order: Sequence[str], label: str = "y", cal_parts: int = 3) -> DataFrame:
    """Raw and calibrated probabilities of the held-out year by each run's best model, fitted on the years before.

    `best` is as `best_models` gives it. A run without earlier rows, or with one class there, has no rows.
    """
    features = list(dict.fromkeys(f for fs in feature_sets.values() for f in fs))
    year = F.year("date")
    inside = rows.where(year <= holdout_year).withColumn("__held", (year == holdout_year).cast("int"))
    variants = [v for v in newton.VARIANTS if v != "none"]
    blocks = newton.pack(inside, keys, features, label, F.col("__held"), parts_of(order, cal_parts))
    wanted = newton.grid(list(feature_sets), [1], [newton.NO_PART, *range(cal_parts)], variants)
    chosen = best.select(*keys, F.col("feature_set").alias("set"), F.col("lr_variant").alias("variant"))
    fits = newton.fit(blocks, keys, features, wanted, sets=feature_sets, only=chosen)
    held = inside.where("__held = 1").drop("__held")
    raw = newton.scored(held, fits.where(F.col("part") == newton.NO_PART), keys, features, out="estimated_probability")
    made = newton.scored(held, newton.calibrate(blocks, fits, keys), keys, features, out="calibrated_probability")
    made = made.where(F.col("n_parts") == cal_parts)
    both = raw.select(*order, label, "estimated_probability").join(made.select(*order, "calibrated_probability"), list(order))
    return both.join(best, list(keys)).select(
        *order, "estimated_probability", "calibrated_probability", "optimal_threshold",
        (F.col("calibrated_probability") >= F.col("optimal_threshold")).cast("int").alias("predicted_event"),
        F.col(label).cast("int").alias("observed_event"), "feature_set", "lr_variant", "cv_f1_score")


def oof_balanced_lr(data: DataFrame, keys: Sequence[str], features: Sequence[str], k: int, label: str = "y") -> DataFrame:
    """Every row with the probability that the fit before its fold gives it, classes balanced, features standardised.

    Rows of the first block, and of folds whose training rows are of one class, have probability 0.
    """
    blocks = newton.pack(data, keys, features, label, F.col("test_fold"))
    fits = newton.fit(blocks, keys, features, newton.grid(folds=range(k)), balanced=True, standardised=True)
    lines = fits.select(*keys, F.col("fold").alias("test_fold"), "columns", "w")
    probability = F.coalesce(newton.sigmoid(newton.margin(features)), F.lit(0.0))
    return data.join(lines, [*keys, "test_fold"], "left").withColumn("probability", probability).drop("columns", "w")
