"""Checked queries: classifiers, each with a fit per port (the run key)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideledger.functions.scalars import confusion_aggs
from tideledger.operators import forests, models
from tideledger.operators.newton import VARIANTS
from tideledger.operators.search import time_series_folds
from tideledger.plans.base_sql import draw
from tideledger.plans.newton_sql import newton, sigmoids
from tideledger.plans.registry import query
from tideledger.plans.roles import FEATURES, PORT, Roles

ORDER = ["port_name", "date"]
RIDGE_VARIANTS = ("L2", "L2_Strong", "L2_Weak")
GRID_SETS = {"source_a": FEATURES[:3], "source_b": FEATURES[3:6], "global": FEATURES}
N_FOLDS = 5
HOLDOUT_YEAR = 2001


@query("threshold_sweep", "port_name threshold:6 tp:i fp:i tn:i fn:i precision:6 recall:6 f1:6", "model_days",
       """SELECT port_name, threshold, tp, fp, tn, fn, tp / CAST(tp + fp AS DOUBLE) AS precision,
            tp / CAST(tp + fn AS DOUBLE) AS recall, 2.0 * tp / (2 * tp + fp + fn) AS f1
          FROM (SELECT port_name, k / 1000.0 AS threshold, count(*) FILTER (WHERE lv >= k AND y = 1) AS tp,
              count(*) FILTER (WHERE lv >= k AND y = 0) AS fp, count(*) FILTER (WHERE lv < k AND y = 0) AS tn,
              count(*) FILTER (WHERE lv < k AND y = 1) AS fn
            FROM (SELECT port_name, y, CAST(least(floor(round(p / 0.001, 6)), 999) AS INTEGER) AS lv FROM (
              SELECT port_name, y, percent_rank() OVER (PARTITION BY port_name ORDER BY swh_mean_b) AS p
              FROM model_days)), (SELECT unnest(range(1, 1000)) AS k) GROUP BY port_name, k)
          WHERE tp > 0 QUALIFY row_number() OVER (PARTITION BY port_name
            ORDER BY 2.0 * tp / (2 * tp + fp + fn) DESC, threshold) = 1""")
def _(r: Roles):
    rank = F.percent_rank().over(Window.partitionBy("port_name").orderBy("swh_mean_b"))
    probs = r.model_days.select("port_name", F.col("y").alias("label"), rank.alias("probability"))
    return models.threshold_sweep(probs, PORT, count=999)


def _x(names=FEATURES) -> str:
    """Intercept and features; those outside `names` are 0, so that their coefficients stay 0."""
    return "[1e0, " + ", ".join(f"coalesce({f}, 0)" if f in names else "0e0" for f in FEATURES) + "]"


def _ridge(value: str) -> str:
    return "[0.0, " + ", ".join([value] * len(FEATURES)) + "]"


SIZE = len(FEATURES) + 1
ZEROS = "[" + ", ".join(["0.0"] * SIZE) + "]"
_PART = draw("42", "port_name", "date")
_STRENGTH = ", ".join(f"('{v}', {0.0 if kind == 'none' else 1 / c})" for v, (kind, c) in VARIANTS.items() if kind != "l1")
_VARIANTS = f"(VALUES {_STRENGTH}) v(variant, strength)"
_BASE = {
    "base_rows": f"""SELECT port_name || '|' || variant AS k, port_name, variant, {_x()} AS x, CAST(y AS DOUBLE) AS t, y,
        1.0 AS c, {_ridge('strength')} AS ridge, {ZEROS} AS w0 FROM fan_days, {_VARIANTS}""",
    **newton("base", "base_rows", SIZE),
}


@query("logistic_variants", "port_name variant n:i mean_probability:6 tp:i fp:i tn:i fn:i", "fan_days",
       """SELECT port_name, variant, count(*) AS n, avg(p) AS mean_probability,
            count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp,
            count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn
          FROM (SELECT r.*, 1 / (1 + exp(-list_dot_product(w, x))) AS p FROM base_rows r JOIN base USING (k))
          GROUP BY port_name, variant""", _BASE)
def _(r: Roles):
    return _summary(r, [v for v in VARIANTS if v != "L1"])


@query("logistic_l1", "port_name variant n:i mean_probability:6 tp:i fp:i tn:i fn:i")
def _(r: Roles):
    return _summary(r, ["L1"])


def _summary(r: Roles, variants):
    return _counted(models.logistic_probabilities(r.fan_days, PORT, FEATURES, "y", variants))


def _counted(scored):
    pred = (F.col("probability") >= 0.5).cast("int")
    return scored.groupBy("port_name", "variant").agg(
        F.count(F.lit(1)).alias("n"), F.avg("probability").alias("mean_probability"), *confusion_aggs(pred, F.col("y")))


@query("tree_variants", "port_name variant n:i mean_probability:6 tp:i fp:i tn:i fn:i")
def _(r: Roles):
    # boosting is sequential: three levels a round, so 20 rounds of the default 100
    ensembles = [replace(e, trees=20) if e.boosted else e for e in models.TREE_MODELS]
    return _counted(models.tree_probabilities(r.fan_days, PORT, FEATURES, ORDER, ensembles=ensembles))


_EDGES = ", ".join(f"{k / forests.BINS}" for k in range(1, forests.BINS))


@query("tree_stumps", "port_name feature bin:i gain:6 probability_low:6 probability_high:6", "fan_days",
       f"""SELECT port_name, feature, bin, gain, p / n AS probability_low, (pos - p) / (total - n) AS probability_high FROM (
            SELECT *, (g(total, pos) - g(n, p) - g(total - n, pos - p)) / total AS gain FROM (
              SELECT port_name, feature, place, bin, CAST(sum(n) OVER w AS DOUBLE) AS n, CAST(sum(p) OVER w AS DOUBLE) AS p,
                CAST(sum(n) OVER f AS DOUBLE) AS total, CAST(sum(p) OVER f AS DOUBLE) AS pos
              FROM (SELECT port_name, feature, place, bin, count(*) AS n, sum(y) AS p FROM binned GROUP BY ALL)
              WINDOW w AS (PARTITION BY port_name, feature ORDER BY bin), f AS (PARTITION BY port_name, feature)) WHERE n < total)
           WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY port_name
             ORDER BY round(gain * total, 9) DESC, place, bin) = 1""".replace(
           "g(total, pos)", "2 * pos * (total - pos) / total").replace("g(n, p)", "2 * p * (n - p) / n").replace(
           "g(total - n, pos - p)", "2 * (pos - p) * (total - n - pos + p) / (total - n)"),
       {"values_of": " UNION ALL ".join(f"""SELECT port_name, date, y, '{f}' AS feature, {i} AS place,
            CAST(coalesce({f}, 0) AS DOUBLE) AS x FROM fan_days""" for i, f in enumerate(FEATURES)),
        "edges": f"""SELECT port_name, feature, CASE WHEN count(DISTINCT x) < {forests.BINS} THEN list(DISTINCT x)
            ELSE list_distinct(quantile_cont(x, [{_EDGES}])) END AS edges FROM values_of GROUP BY ALL""",
        "binned": """SELECT v.*, len(list_filter(edges, lambda e: e < x)) AS bin
            FROM values_of v JOIN edges USING (port_name, feature)"""})
def _(r: Roles):
    blocks = forests.pack(r.fan_days, PORT, FEATURES, "y", ORDER)
    return forests.root_cuts(forests.grow(blocks, PORT, len(FEATURES), [forests.Ensemble("stump", 1, 1)]), PORT, FEATURES)


def _calibrated(rows: str, parts: int, trains: str, held: str) -> dict[str, str]:
    """CTEs part_fit, part_line over `rows` (m, part, x, y, ridge, ...): k is the model m and the part it leaves out."""
    return {
        "part_rows": f"""SELECT m || '|' || q AS k, x, CAST(y AS DOUBLE) AS t, 1.0 AS c, ridge, {ZEROS} AS w0
            FROM {rows}, range(0, {parts}) p(q) WHERE part <> q AND {trains}""",
        **newton("part_fit", "part_rows", SIZE),
        "part_held": f"""SELECT m || '|' || q AS k, list_dot_product(w, x) AS z, y
            FROM {rows}, range(0, {parts}) p(q) JOIN part_fit ON part_fit.k = m || '|' || q WHERE part = q AND {held}""",
        **sigmoids("part_line", "part_held"),
    }


def _mean_probability(parts: int) -> str:
    """Mean over the parts of a row's model m."""
    return " + ".join(f"""(SELECT 1 / (1 + exp(-(l.w[1] + l.w[2] * list_dot_product(f.w, s.x))))
        FROM part_fit f JOIN part_line l USING (k) WHERE f.k = s.m || '|{q}')""" for q in range(parts))


@query("sigmoid_calibration", "port_name n:i mean_probability:6 observed_rate:6", "fan_days",
       f"""SELECT port_name, count(*) AS n, avg(({_mean_probability(3)}) / 3) AS mean_probability, avg(y) AS observed_rate
           FROM model_rows s GROUP BY port_name""",
       {"model_rows": f"""SELECT port_name, port_name AS m, y, {_x()} AS x, {_ridge('1.0')} AS ridge,
            {_PART} % 3 AS part FROM fan_days""", **_calibrated("model_rows", 3, "true", "true")})
def _(r: Roles):
    made = models.calibrated_probabilities(r.fan_days, PORT, FEATURES, ORDER, 3)
    return made.groupBy("port_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("probability").alias("mean_probability"), F.avg("y").alias("observed_rate"))


# five expanding folds over the days of a port
_FOLDED = f"""SELECT f.*, CASE WHEN i < n - {N_FOLDS} * (n // {N_FOLDS + 1}) THEN -1
        ELSE (i - (n - {N_FOLDS} * (n // {N_FOLDS + 1}))) // (n // {N_FOLDS + 1}) END AS test_fold, {_PART} AS drawn
    FROM (SELECT *, row_number() OVER (PARTITION BY port_name ORDER BY date) - 1 AS i,
                 count(*) OVER (PARTITION BY port_name) AS n FROM fan_days) f"""
_SETS = " UNION ALL ".join(f"""SELECT port_name, date, y, test_fold, drawn, '{name}' AS feature_set, {_x(fs)} AS x
    FROM folded_fan""" for name, fs in GRID_SETS.items())
_RIDGES = ", ".join(f"('{v}', {1 / VARIANTS[v][1]})" for v in RIDGE_VARIANTS)


def _swept(rows: str) -> dict[str, str]:
    """CTE folds: the best threshold of every model and fold; `rows` has one row per model and training fold."""
    return {
        **_calibrated(rows, 2, "test_fold < fold", "test_fold < fold"),
        # models of which both parts could be fitted, scored on their own fold where it has a positive row
        "tested": f"""SELECT * FROM (SELECT *, sum(y) OVER (PARTITION BY m) AS n_pos FROM (
              SELECT m, port_name, feature_set, lr_variant, fold, y, ({_mean_probability(2)}) / 2 AS p
              FROM {rows} s WHERE test_fold = fold)) WHERE n_pos > 0 AND p IS NOT NULL""",
        "levels": """SELECT m, y, CAST(least(greatest(floor(round((p - 0.01) / 0.001, 6)), -1), 979) AS INTEGER) AS lv FROM tested""",
        "cells": """SELECT m, lv, count(*) AS n, sum(y) AS pos FROM levels GROUP BY m, lv""",
        "summed": """SELECT m, j, sum(n) FILTER (WHERE lv >= j) AS fired, coalesce(sum(pos) FILTER (WHERE lv >= j), 0) AS tp,
              sum(n) AS total, sum(pos) AS pos FROM cells, range(0, 980) t(j) GROUP BY m, j""",
        "swept": """SELECT m, j * 0.001 + 0.01 AS threshold, tp, fired - tp AS fp, pos - tp AS fn, total - fired - pos + tp AS tn,
              2.0 * tp / (fired + pos) AS f1 FROM summed WHERE tp > 0
            QUALIFY row_number() OVER (PARTITION BY m ORDER BY 2.0 * tp / (fired + pos) DESC, j) = 1""",
        "folds": """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY port_name, feature_set, lr_variant) AS n_folds FROM (
              SELECT t.port_name, t.feature_set, t.lr_variant, t.fold, coalesce(any_value(s.threshold), 0.5) AS threshold,
                coalesce(any_value(s.tp), 0) AS tp, coalesce(any_value(s.fp), count(*) FILTER (WHERE p >= 0.5)) AS fp,
                coalesce(any_value(s.fn), count(*) FILTER (WHERE p < 0.5 AND y = 1)) AS fn,
                coalesce(any_value(s.tn), count(*) FILTER (WHERE p < 0.5 AND y = 0)) AS tn, coalesce(any_value(s.f1), 0) AS f1
              FROM tested t LEFT JOIN swept s USING (m) GROUP BY ALL)) WHERE n_folds >= 2""",
    }


def _model_rows(sets: str, variants: str) -> str:
    """A row per model (set, variant, fold) and day that it trains on or is tested on; one-class models are left out."""
    return f"""SELECT * FROM (SELECT port_name || '|' || feature_set || '|' || lr_variant || '|' || fold AS m, port_name, date, y,
            test_fold, fold, feature_set, lr_variant, x, {_ridge('strength')} AS ridge, drawn % 2 AS part
          FROM ({sets}), (VALUES {variants}) v(lr_variant, strength), range(0, {N_FOLDS}) t(fold) WHERE test_fold <= fold)
        WHERE (port_name, fold) IN (SELECT (port_name, fold) FROM (
          SELECT port_name, fold, q, sum(y) AS pos, count(*) AS n FROM folded_fan, range(0, {N_FOLDS}) t(fold), range(0, 2) p(q)
          WHERE test_fold < fold AND drawn % 2 <> q GROUP BY ALL) GROUP BY port_name, fold
          HAVING count(*) = 2 AND min(pos) > 0 AND min(n - pos) > 0)"""


def _folded(r: Roles):
    folds = time_series_folds(r.model_days, PORT, N_FOLDS).select(*ORDER, "test_fold")
    return r.fan_days.join(folds, ORDER)


@query("model_cv_threshold", "port_name fold:i threshold:6 tp:i fp:i tn:i fn:i f1:6", "fan_days",
       "SELECT port_name, fold, threshold, tp, fp, tn, fn, f1 FROM folds",
       {"folded_fan": _FOLDED, "model_rows": _model_rows(
           f"SELECT port_name, date, y, test_fold, drawn, 'all' AS feature_set, {_x()} AS x FROM folded_fan", "('L2', 1.0)"),
        **_swept("model_rows")})
def _(r: Roles):
    return models.model_cv(_folded(r), PORT, {"all": FEATURES}, ["L2"], N_FOLDS, ORDER).withColumnRenamed("test_fold", "fold")


_GRID = {"folded_fan": _FOLDED, "model_rows": _model_rows(_SETS, _RIDGES), **_swept("model_rows"), "graded": """
    SELECT *, row_number() OVER (PARTITION BY port_name ORDER BY round(mean_f1, 12) DESC, feature_set, lr_variant) AS place FROM (
      SELECT port_name, feature_set, lr_variant, any_value(n_folds) AS n_folds, avg(f1) AS mean_f1, stddev_pop(f1) AS std_f1,
        avg(threshold) AS mean_threshold FROM folds GROUP BY ALL)"""}
_GRADED = "port_name feature_set lr_variant n_features:i n_folds:i mean_f1:6 std_f1:6 mean_threshold:6 place:i"


@query("model_grid_ridge", _GRADED, "fan_days",
       "SELECT *, CASE feature_set " + " ".join(f"WHEN '{s}' THEN {len(f)}" for s, f in GRID_SETS.items())
       + " END AS n_features FROM graded", _GRID)
def _(r: Roles):
    return models.model_grid(_folded(r), PORT, GRID_SETS, RIDGE_VARIANTS, N_FOLDS, ORDER)


@query("model_grid", _GRADED)
def _(r: Roles):
    return models.model_grid(_folded(r), PORT, GRID_SETS, ["L2", "L1", "L2_Strong", "L2_Weak"], N_FOLDS, ORDER)


_HELD = " UNION ALL ".join(f"""SELECT f.port_name, date, y, {_x(fs)} AS x, year(date) AS year, drawn % 3 AS part, lr_variant,
    feature_set, mean_threshold, mean_f1 FROM folded_fan f JOIN graded g ON g.port_name = f.port_name AND place = 1
    AND feature_set = '{name}' WHERE year(date) <= {HOLDOUT_YEAR}""" for name, fs in GRID_SETS.items())


def _prefixed(ctes: dict[str, str], prefix: str, names) -> dict[str, str]:
    """The CTEs under other names, so that one query can hold two of a kind."""
    out = {}
    for name, body in ctes.items():
        for n in names:
            body = body.replace(n, prefix + n)
        out[prefix + name] = body
    return out


_HOLDOUT = {**_GRID,
            "held_days": f"SELECT * FROM ({_HELD})",
            "held_rows": f"""SELECT h.*, port_name AS m, {_ridge('strength')} AS ridge
                FROM held_days h JOIN (VALUES {_RIDGES}) v(lr_variant, strength) USING (lr_variant)""",
            **_prefixed(_calibrated("held_rows", 3, f"year < {HOLDOUT_YEAR}", f"year < {HOLDOUT_YEAR}"), "h_",
                        ("part_rows", "part_fit", "part_held", "part_line")),
            "whole_rows": f"""SELECT m AS k, x, CAST(y AS DOUBLE) AS t, 1.0 AS c, ridge, {ZEROS} AS w0 FROM held_rows
                WHERE year < {HOLDOUT_YEAR}""",
            **newton("whole", "whole_rows", SIZE)}


@query("fit_predict_holdout", "port_name date:d estimated_probability:6 calibrated_probability:6 "
       "optimal_threshold:6 predicted_event:i observed_event:i feature_set lr_variant cv_f1_score:6", "fan_days",
       f"""SELECT *, CASE WHEN calibrated_probability >= optimal_threshold THEN 1 ELSE 0 END AS predicted_event FROM (
             SELECT port_name, date, 1 / (1 + exp(-list_dot_product(w.w, x))) AS estimated_probability,
               ({_mean_probability(3).replace('part_', 'h_part_')}) / 3 AS calibrated_probability,
               mean_threshold AS optimal_threshold, y AS observed_event, feature_set, lr_variant, mean_f1 AS cv_f1_score
             FROM held_rows s JOIN whole w ON w.k = s.m WHERE year = {HOLDOUT_YEAR})""", _HOLDOUT)
def _(r: Roles):
    best = models.best_models(models.model_grid(_folded(r), PORT, GRID_SETS, RIDGE_VARIANTS, N_FOLDS, ORDER), PORT)
    return models.fit_predict_holdout(r.fan_days, PORT, GRID_SETS, best, HOLDOUT_YEAR, ORDER)


_SPREAD = "[0.0, " + ", ".join(f"var_pop(coalesce({f}, 0)) OVER w" for f in FEATURES) + "]"
_OOF = {"folded_fan": _FOLDED,
        "oof_rows": f"""SELECT port_name || '|' || fold AS k, {_x()} AS x, CAST(y AS DOUBLE) AS t,
              CASE WHEN y = 1 THEN 0.5 * count(*) OVER w / sum(y) OVER w
                   ELSE 0.5 * count(*) OVER w / (count(*) OVER w - sum(y) OVER w) END AS c,
              {_SPREAD} AS ridge, {ZEROS} AS w0, sum(y) OVER w AS n_pos
            FROM folded_fan, range(0, {N_FOLDS}) t(fold) WHERE test_fold < fold WINDOW w AS (PARTITION BY port_name, fold)
            QUALIFY sum(y) OVER w > 0 AND sum(1 - y) OVER w > 0""",
        **newton("oof", "oof_rows", SIZE)}


@query("oof_balanced_lr", "port_name threshold:6 tp:i fp:i tn:i fn:i precision:6 recall:6 accuracy:6 f1:6", "fan_days",
       f"""SELECT *, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(tp + fn AS DOUBLE) AS recall,
             (tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE) AS accuracy, 2.0 * tp / (2 * tp + fp + fn) AS f1 FROM (
           SELECT port_name, 0.01 + j * 0.94 / 49 AS threshold, count(*) FILTER (WHERE lv >= j AND y = 1) AS tp,
             count(*) FILTER (WHERE lv >= j AND y = 0) AS fp, count(*) FILTER (WHERE lv < j AND y = 0) AS tn,
             count(*) FILTER (WHERE lv < j AND y = 1) AS fn
           FROM (SELECT port_name, y, ceil(round((coalesce(1 / (1 + exp(-list_dot_product(w, {_x()}))), 0) - 0.01)
                   / (0.94 / 49), 6)) - 1 AS lv FROM folded_fan LEFT JOIN oof ON k = port_name || '|' || test_fold),
             range(0, 50) t(j) GROUP BY port_name, j)
           WHERE tp > 0 QUALIFY row_number() OVER (PARTITION BY port_name
             ORDER BY 2.0 * tp / (2 * tp + fp + fn) DESC, threshold) = 1""", _OOF)
def _(r: Roles):
    probs = models.oof_balanced_lr(_folded(r), PORT, FEATURES, N_FOLDS).withColumn("label", F.col("y"))
    return models.threshold_sweep(probs, PORT, start=0.01, step=0.94 / 49, count=50, strict=True)
