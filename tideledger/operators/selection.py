"""Feature scores from the long table (keys, feature, date, value, y), all features at once."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideledger.functions.scalars import ratio
from tideledger.operators import forests
from tideledger.operators.forests import Ensemble

# Weight of each method's vote and the name patterns that boost a feature.
METHOD_WEIGHTS = {
    "random_forest": 2.5, "extra_trees": 2.0, "mutual_info": 2.2, "f_test": 1.8,
    "domain_selection": 3.0,
}
DOMAIN_PATTERNS = [
    (r"swh_max_sw|swe_max_sw|swh_max_wa|swe_max_wa", 4.0),
    (r"_sw$", 3.5),
    (r"_p(85|90|95|99)", 3.0),
    (r"_p(75|80)", 2.5),
    (r"_trend_(7|14|21)", 2.8),
    (r"_trend_(3|5)", 2.2),
    (r"_persistence_(5|7|14)", 2.6),
    (r"_change_(1|3|5)", 2.4),
    (r"_change_(7|14)", 2.0),
    (r"anom_", 2.2),
    (r"_cv|_range|_iqr|_std", 2.0),
    (r"_lag_(1|2)", 2.0),
    (r"_lag_(3|5)", 1.8),
    (r"_wa$", 1.8),
]
QUICK_PATTERNS = [
    (r"swh_max_sw|swe_max_sw|swh_max_wa|swe_max_wa", 4.0),
    (r"_sw", 3.5),
    (r"_p(80|90|95)", 3.0),
    (r"_trend_(3|5|7|14)", 2.5),
    (r"_persistence_(5|7|14)", 2.3),
    (r"anom_", 3.5),
    (r"_iqr|_std|_cv", 2.5),
]


def boost(name: Column, patterns: Sequence[tuple[str, float]]) -> Column:
    """Product of the boosts whose pattern the name matches."""
    out = F.lit(1.0)
    for pattern, factor in patterns:
        out = out * F.when(name.rlike(pattern), factor).otherwise(1.0)
    return out


def label_correlation(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """|correlation| with the label, gaps as 0; 0 where it is undefined."""
    return long.groupBy(*keys, "feature").agg(
        F.coalesce(F.abs(F.corr(F.coalesce("value", F.lit(0.0)), F.col("y").cast("double"))),
                   F.lit(0.0)).alias("base_correlation"),
        F.avg(F.col("value").isNull().cast("double")).alias("missing"),
        F.stddev_samp("value").alias("sd"))


def select_domain(long: DataFrame, keys: Sequence[str], patterns=tuple(DOMAIN_PATTERNS)) -> DataFrame:
    """Correlation x pattern boosts x quality penalty x type bonus."""
    f = F.col("feature")
    penalty = F.when((F.col("missing") < 0.3) & (F.col("sd") > 1e-6), 1.0).otherwise(0.5)
    bonus = (F.when(F.contains(f, F.lit("_max_")) | F.contains(f, F.lit("_p9")), 1.2)
              .when(F.contains(f, F.lit("_trend_")) | F.contains(f, F.lit("_change_")), 1.15)
              .when(F.contains(f, F.lit("_persistence_")), 1.1).otherwise(1.0))
    return label_correlation(long, keys).withColumns(
        {"boost": boost(f, patterns), "penalty": penalty, "bonus": bonus}).withColumn(
        "score", F.col("base_correlation") * F.col("boost") * F.col("penalty") * F.col("bonus"))


def select_corr_boost(long: DataFrame, keys: Sequence[str], patterns=tuple(QUICK_PATTERNS)) -> DataFrame:
    """Correlation x pattern boosts: the list the search uses by default."""
    return label_correlation(long, keys).withColumn(
        "score", F.col("base_correlation") * boost(F.col("feature"), patterns))


def select_mutual_info(long: DataFrame, keys: Sequence[str], bins: int = 10) -> DataFrame:
    """Mutual information (nats) of the label with each feature cut into equal-count bins."""
    by = [*keys, "feature"]
    value = F.coalesce("value", F.lit(0.0))
    cut = F.ntile(bins).over(Window.partitionBy(*by).orderBy(value, "date"))
    cells = (long.withColumn("__b", cut).groupBy(*by, "__b", "y")
                 .agg(F.count(F.lit(1)).alias("__n")))
    whole = Window.partitionBy(*by)
    marks = cells.withColumns({
        "__all": F.sum("__n").over(whole),
        "__nb": F.sum("__n").over(Window.partitionBy(*by, "__b")),
        "__ny": F.sum("__n").over(Window.partitionBy(*by, "y"))})
    share = F.col("__n") / F.col("__all")
    gain = F.log(F.col("__n") * F.col("__all") / (F.col("__nb") * F.col("__ny")))
    return marks.groupBy(*by).agg(F.sum(share * gain).alias("score"))


def f_scores(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One-way ANOVA F of each feature over the label classes, gaps as 0."""
    by = [*keys, "feature"]
    v = F.coalesce("value", F.lit(0.0))
    classes = long.groupBy(*by, "y").agg(
        F.count(F.lit(1)).alias("__n"), F.avg(v).alias("__m"), F.var_pop(v).alias("__v"))
    sums = classes.groupBy(*by).agg(
        F.sum("__n").alias("n"), F.count(F.lit(1)).alias("classes"),
        (F.sum(F.col("__n") * F.col("__m")) / F.sum("__n")).alias("__mean"),
        F.sum(F.col("__n") * F.col("__v")).alias("__within"),
        F.sum(F.col("__n") * F.col("__m") * F.col("__m")).alias("__sq"))
    between = F.col("__sq") - F.col("n") * F.col("__mean") * F.col("__mean")
    return sums.select(
        *by, "n", "classes",
        ratio(between / F.nullif(F.col("classes") - 1, F.lit(0)),
              F.col("__within") / F.nullif(F.col("n") - F.col("classes"), F.lit(0)), 0.0)
        .alias("f_score"))


def _beta_tail(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction."""
    flip = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x)
                       + b * np.log1p(-x)) / a
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    out = np.where(x <= 0, 0.0, front * h)
    return np.where(flip, 1 - out, out)


@F.pandas_udf(T.DoubleType())
def f_p_value(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper tail of the F distribution, one row per feature."""
    fv, a, b = (s.to_numpy(dtype=float) for s in (f, d1, d2))
    return pd.Series(_beta_tail(b / (b + a * np.maximum(fv, 0)), b / 2, a / 2))


def select_f_test(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """0.7 x normalised F + 0.3 x normalised -ln p."""
    base = f_scores(long, keys).withColumn(
        "p_value", f_p_value(F.col("f_score"), (F.col("classes") - 1).cast("double"),
                             (F.col("n") - F.col("classes")).cast("double")))
    logp = -F.log(F.col("p_value") + 1e-10)
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    return base.withColumn("__lp", logp).withColumn(
        "score", 0.7 * F.col("f_score") / (F.max("f_score").over(w) + 1e-6)
        + 0.3 * F.col("__lp") / (F.max("__lp").over(w) + 1e-6)).drop("__lp")


def ranked_list(scores: DataFrame, keys: Sequence[str], method: str, top_k: int = 200) -> DataFrame:
    """(keys, method, feature, position) of the best features, with the list's length.

    Scores that agree to nine digits tie, and the name decides.
    """
    order = Window.partitionBy(*keys).orderBy(F.round("score", 9).desc(), "feature")
    top = (scores.withColumn("position", F.row_number().over(order))
                 .where(F.col("position") <= top_k))
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return top.select(*keys, F.lit(method).alias("method"), "feature", "position",
                      size.alias("list_size"))


def vote_features(lists: DataFrame, keys: Sequence[str], weights: Mapping[str, float] = METHOD_WEIGHTS,
                  min_votes: int = 2, n_methods: int = 5, top_k: int = 150) -> DataFrame:
    """Weighted votes that fall off with the position; a feature needs `min_votes` methods."""
    weight = F.lit(1.0)
    for method, w in weights.items():
        weight = F.when(F.col("method") == method, w).otherwise(weight)
    vote = weight * F.exp(-(F.col("position") - 1) / F.col("list_size"))
    tally = lists.groupBy(*keys, "feature").agg(
        F.sum(vote).alias("total_score"), F.count(F.lit(1)).alias("method_count"),
        F.min("position").alias("best_position"), F.avg("position").alias("avg_position"),
        F.array_join(F.array_sort(F.collect_set("method")), ", ").alias("methods"))
    share = F.col("method_count") / n_methods
    scored = (tally.where(F.col("method_count") >= min_votes)
                   .withColumns({"consensus": share,
                                 "score": F.col("total_score") * (1 + 0.2 * share)}))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "feature")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_k)


# ---- tree ensembles -------------------------------------------------------------------------

# Ensembles behind the two importance votes.
FOREST_CONFIGS = [
    Ensemble("forest", 200, 15, min_split=5, features="sqrt", resample=True, seed=42),
    Ensemble("forest", 300, 20, min_split=3, features="sqrt", resample=True, seed=123),
    Ensemble("forest", 150, 12, min_split=8, features="sqrt", resample=True, seed=456),
    Ensemble("forest", 250, 18, min_leaf=2, features="sqrt", resample=True, seed=789),
    Ensemble("forest", 180, None, min_split=10, features=0.8, resample=True, seed=987),
]
EXTRA_TREE_CONFIGS = [
    Ensemble("extra_trees", 200, 15, min_split=3, features="sqrt", random_cuts=True, seed=42),
    Ensemble("extra_trees", 300, 20, min_split=5, features="sqrt", random_cuts=True, seed=123),
    Ensemble("extra_trees", 150, None, min_leaf=3, features="sqrt", random_cuts=True, seed=456),
    Ensemble("extra_trees", 250, 25, features=0.7, random_cuts=True, seed=789),
]


def forest_importances(rows: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, order: Sequence[str],
                       ensembles: Sequence[Ensemble]) -> DataFrame:
    """(keys, feature, importance_mean, importance_std, stability) over the ensembles of each run; gaps as 0."""
    blocks = forests.pack(rows, keys, features, label, order)
    grown = forests.grow(blocks, keys, len(features), ensembles)
    table = forests.importances(grown, keys, features, ensembles)
    return table.groupBy(*keys, "feature").agg(
        F.avg("importance").alias("importance_mean"), F.stddev_pop("importance").alias("importance_std")).withColumn(
        "stability", F.col("importance_mean") / (F.col("importance_std") + 1e-6))


def select_forest(rows: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, order: Sequence[str],
                  ensembles: Sequence[Ensemble] = tuple(FOREST_CONFIGS)) -> DataFrame:
    """0.7 x mean importance + 0.3 x stability over the forests of each run."""
    top = F.max("stability").over(Window.partitionBy(*keys))
    return forest_importances(rows, keys, features, label, order, ensembles).withColumn(
        "score", 0.7 * F.col("importance_mean") + 0.3 * ratio(F.col("stability"), top, 0.0))


def select_extra_trees(rows: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, order: Sequence[str],
                       ensembles: Sequence[Ensemble] = tuple(EXTRA_TREE_CONFIGS)) -> DataFrame:
    """Mean importance raised by up to a fifth for stability, over ensembles with random cuts and no resampling."""
    top = F.max("stability").over(Window.partitionBy(*keys))
    return forest_importances(rows, keys, features, label, order, ensembles).withColumn(
        "score", F.col("importance_mean") * (1 + 0.2 * ratio(F.col("stability"), top, 0.0)))


def feature_selection(long: DataFrame, keys: Sequence[str], method: str = "corr_boost",
                      top_k: int = 450, forest_lists: DataFrame | None = None) -> DataFrame:
    """Selected features with their rank.

    'corr_boost' is the list the search uses; 'vote' joins the votes of mutual information,
    F test and domain scores with the ranked lists of the forests, where given.
    """
    if method == "corr_boost":
        listed = ranked_list(select_corr_boost(long, keys), keys, method, top_k)
        return listed.select(*keys, "feature", F.col("position").alias("place"))
    lists = (ranked_list(select_mutual_info(long, keys), keys, "mutual_info")
             .unionByName(ranked_list(select_f_test(long, keys), keys, "f_test"))
             .unionByName(ranked_list(select_domain(long, keys), keys, "domain_selection")))
    if forest_lists is not None:
        lists = lists.unionByName(forest_lists)
    return vote_features(lists, keys, top_k=top_k)
