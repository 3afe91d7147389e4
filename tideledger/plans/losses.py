"""Checked queries: resampling, annual losses and exceedance curves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideledger.operators import aep, resample, rules, search
from tideledger.plans.registry import query
from tideledger.plans.roles import FEATURES, MIN_DAYS, N_SIMS, PORT, Roles
from tideledger.plans.searches import TOP4, _DOUBLE_SOURCE, _MEAN_T, _PAIRS, _TRIPLES


@query("seasonal_block_bootstrap", "port_name sim:i day:i swh_mean_b:9 y:i", "sim_days",
       "SELECT * FROM sim_days")
def _(r: Roles):
    return r.sim_days


@query("simple_block_bootstrap", "port_name sim:i day:i swh_mean_b:9 y:i", "starts numbered draws",
       """SELECT n.port_name, sim, CAST(d.slot * 7 + o + 1 AS INTEGER) AS day, swh_mean_b, y FROM (
            SELECT s.port_name, u.sim, u.slot, s.i, unnest(range(7)) AS o FROM starts s JOIN (
              SELECT port_name, count(*) AS n FROM starts GROUP BY port_name) c
              ON c.port_name = s.port_name JOIN draws u ON u.h % c.n = s.i AND u.sim < 50) d
          JOIN numbered n ON n.port_name = d.port_name AND n.i = d.i + d.o
          WHERE d.slot * 7 + o + 1 <= 365""")
def _(r: Roles):
    pool = resample.anywhere_candidates(r.model_days, PORT, ["swh_mean_b", "y"])
    return resample.draw_days(pool, PORT, 50)


_PROBS = """SELECT port_name, date, y, percent_rank() OVER (PARTITION BY port_name ORDER BY swh_mean_b)
            * 0.1 AS probability, row_number() OVER (PARTITION BY port_name ORDER BY date) AS day
            FROM model_days"""
_DRAWN = """SELECT port_name, sim, day, CASE WHEN CAST('0x' || substr(md5('0|' || sim || '|' || day), 1, 8)
            AS BIGINT) / 4294967296.0 < probability THEN 1 ELSE 0 END AS flag
            FROM probs CROSS JOIN (SELECT unnest(range(20)) AS sim)"""


def _probabilities(r: Roles):
    rank = F.percent_rank().over(Window.partitionBy("port_name").orderBy("swh_mean_b"))
    return r.model_days.select("port_name", "date", "y", (rank * 0.1).alias("probability"))


@query("bernoulli_draws", "port_name sim:i fired:i first_day:i last_day:i", "model_days",
       """SELECT port_name, sim, sum(flag) AS fired, min(CASE WHEN flag = 1 THEN day END) AS first_day,
          max(CASE WHEN flag = 1 THEN day END) AS last_day FROM drawn GROUP BY port_name, sim""",
       extra={"probs": _PROBS, "drawn": _DRAWN})
def _(r: Roles):
    days = resample.bernoulli_days(_probabilities(r), PORT, 20, "probability")
    hit = F.when(F.col("flag") == 1, F.col("day"))
    return days.groupBy("port_name", "sim").agg(
        F.sum("flag").alias("fired"), F.min(hit).alias("first_day"), F.max(hit).alias("last_day"))


@query("annual_loss", "port_name sim:i loss_days:i n_events:i loss:4", "sim_losses",
       "SELECT * FROM sim_losses")
def _(r: Roles):
    return r.sim_losses


@query("component_costs", "port_name sim:i component loss:4 n_events:i", "components",
       "SELECT * FROM components")
def _(r: Roles):
    return r.components


@query("aep_single_rule", "port_name n_simulations:i mean_loss:6 std_loss:3 max_loss:6 zero_prob:6 "
       "p99_loss:6 loss_at_1pct:6 observed_mean:6", "curves obs_yearly",
       """SELECT c.*, o.observed_mean FROM (SELECT port_name, count(*) AS n_simulations,
            avg(loss) AS mean_loss, stddev_pop(loss) AS std_loss, max(loss) AS max_loss,
            avg(CASE WHEN loss = 0 THEN 1.0 ELSE 0 END) AS zero_prob, quantile_cont(loss, 0.99) AS p99_loss,
            min(loss) FILTER (WHERE probability <= 0.01) AS loss_at_1pct FROM curves GROUP BY port_name) c
          JOIN (SELECT port_name, avg(observed_loss) AS observed_mean FROM obs_yearly GROUP BY 1) o
          ON o.port_name = c.port_name""")
def _(r: Roles):
    tail = F.min(F.when(F.col("probability") <= 0.01, F.col("loss"))).alias("loss_at_1pct")
    summary = aep.annual_summary(r.curves, PORT, also=[tail])
    observed = r.obs_yearly.groupBy("port_name").agg(F.avg("observed_loss").alias("observed_mean"))
    return summary.join(observed, "port_name")


def _run_days(source: str, by: str, min_days: int = MIN_DAYS) -> str:
    """SQL: loss days and events per (by, sim) from 0/1 `pred` rows."""
    return f"""SELECT {by}, sim, coalesce(sum(CASE WHEN pred = 1 AND len >= {min_days} THEN len END), 0)
        AS loss_days, count(*) FILTER (WHERE pred = 1) AS n_events,
        coalesce(sum(CASE WHEN pred = 1 THEN len END), 0) AS event_days
        FROM (SELECT {by}, sim, pred, g, count(*) AS len FROM (
          SELECT *, row_number() OVER (PARTITION BY {by}, sim ORDER BY day)
            - row_number() OVER (PARTITION BY {by}, sim, pred ORDER BY day) AS g FROM {source})
          GROUP BY {by}, sim, pred, g) GROUP BY {by}, sim"""


_BEST = """SELECT port_name, feature FROM mean_t QUALIFY row_number() OVER (PARTITION BY port_name
           ORDER BY score DESC, feature) = 1"""
_SWEEP = {
    "mean_t": _MEAN_T, "bestf": _BEST,
    "fold_t": "SELECT b.port_name, fold, threshold FROM best_t b JOIN bestf f ON b.port_name = f.port_name AND b.feature = f.feature",
    "labels": """SELECT port_name, 'fold' || fold AS threshold_label, threshold FROM fold_t UNION ALL
        SELECT port_name, 'mean', avg(threshold) FROM fold_t GROUP BY port_name UNION ALL
        SELECT port_name, 'median', median(threshold) FROM fold_t GROUP BY port_name UNION ALL
        SELECT port_name, 'p75', quantile_cont(threshold, 0.75) FROM fold_t GROUP BY port_name""",
    "swept": "SELECT s.port_name, threshold_label, threshold, sim, day, CASE WHEN (CASE feature "
             + " ".join(f"WHEN '{f}' THEN {f}" for f in FEATURES[:6])
             + """ END) > threshold THEN 1 ELSE 0 END AS pred FROM sim_days s JOIN labels l
               ON l.port_name = s.port_name JOIN bestf f ON f.port_name = s.port_name WHERE sim < 40""",
    "swept_days": _run_days("swept", "port_name, threshold_label"),
}


def _best_feature_days(r: Roles, n_sims: int):
    """Simulated days of each port's best single feature, and its fold thresholds."""
    from tideledger.operators.rules import top_features
    base = [f for f in FEATURES[:6]]
    scores = (r.best_thresholds.where(F.col("feature").isin(base)).groupBy("port_name", "feature")
              .agg(F.round(F.avg("f1"), 9).alias("score")))
    best = top_features(scores, PORT, "score", 1).select("port_name", "feature")
    chosen = r.long.join(best, ["port_name", "feature"])
    days = aep.simulate(chosen, PORT, ["value", "y"], n_sims)
    return days, r.best_thresholds.join(best, ["port_name", "feature"])


_SWEEP["mean_t"] = _MEAN_T.replace("FROM best_t", "FROM best_t WHERE feature IN ("
                                   + ", ".join(f"'{f}'" for f in FEATURES[:6]) + ")")


@query("aep_threshold_sweep", "port_name threshold_label threshold:6 mean_loss:6 median_loss:6 p99_loss:6 "
       "mean_events:6 gap:5", "best_t sim_days exposure obs_yearly",
       """SELECT d.port_name, d.threshold_label, l.threshold, mean_loss, median_loss, p99_loss, mean_events,
            abs(mean_loss - o) AS gap FROM (
            SELECT s.port_name, threshold_label, avg(loss_days * n_workers * daily_wage) AS mean_loss,
              median(loss_days * n_workers * daily_wage) AS median_loss,
              quantile_cont(loss_days * n_workers * daily_wage, 0.99) AS p99_loss,
              avg(n_events) AS mean_events FROM swept_days s JOIN exposure e ON e.port_name = s.port_name
            GROUP BY s.port_name, threshold_label) d JOIN labels l ON l.port_name = d.port_name
            AND l.threshold_label = d.threshold_label JOIN (SELECT port_name, avg(observed_loss) AS o
              FROM obs_yearly GROUP BY port_name) b ON b.port_name = d.port_name""", extra=_SWEEP)
def _(r: Roles):
    days, folds = _best_feature_days(r, 40)
    labels = aep.threshold_labels(folds, PORT)
    losses = aep.single_rule_losses(days, labels, r.exposure, PORT, "value", MIN_DAYS,
                                    ["threshold_label"])
    observed = r.obs_yearly.groupBy("port_name").agg(F.avg("observed_loss").alias("observed_mean"))
    return aep.sweep_table(losses, observed, PORT)


@query("scaled_threshold_aep", "port_name mean_loss:6 p99_loss:6 zero_prob:6", "sim_days trig exposure",
       """SELECT d.port_name, avg(loss_days * n_workers * daily_wage) AS mean_loss,
            quantile_cont(loss_days * n_workers * daily_wage, 0.99) AS p99_loss,
            avg(CASE WHEN loss_days = 0 THEN 1.0 ELSE 0 END) AS zero_prob
          FROM scaled_days d JOIN exposure e ON e.port_name = d.port_name GROUP BY d.port_name""",
       extra={"scaled": """SELECT s.port_name, sim, day, CASE WHEN swh_mean_b > threshold * 0.85 THEN 1
                           ELSE 0 END AS pred FROM sim_days s JOIN trig t ON t.port_name = s.port_name""",
              "scaled_days": _run_days("scaled", "port_name")})
def _(r: Roles):
    limits = aep.scaled_thresholds(r.trigger_thresholds(), 0.85)
    return aep.annual_summary(aep.single_rule_losses(r.sim_days, limits, r.exposure, PORT,
                                                     "swh_mean_b", MIN_DAYS), PORT)


# ---- combinations ---------------------------------------------------------------------------

_P80 = " UNION ALL ".join(f"""SELECT port_name, '{f}' AS feature, quantile_cont({f}, 0.8) AS threshold
                          FROM model_days GROUP BY port_name""" for f in FEATURES[:6])


def _p80(r: Roles):
    return (r.long.where(F.col("feature").isin(FEATURES[:6])).groupBy("port_name", "feature")
            .agg(F.percentile("value", F.lit(0.8)).alias("threshold")))


def _base_ranked(r: Roles):
    base = r.long.where(F.col("feature").isin(FEATURES[:6]))
    return rules.top_features(base.groupBy("port_name", "feature").agg(F.max("value").alias("score")),
                              PORT, "score")


_BASE_RANKED = """SELECT port_name, feature, row_number() OVER (PARTITION BY port_name
    ORDER BY score DESC, feature) - 1 AS pos FROM (SELECT port_name, feature, max(value) AS score
    FROM long WHERE feature IN (""" + ", ".join(f"'{f}'" for f in FEATURES[:6]) + ") GROUP BY ALL)"


def _value(col: str) -> str:
    return f"(CASE {col} " + " ".join(f"WHEN '{f}' THEN s.{f}" for f in FEATURES[:6]) + " END)"


def _multi_sql(source: str, n_sims: int) -> dict[str, str]:
    """CTEs firing rules (rule_id, rule_type, f1, f2, f3) with the p80 thresholds on simulated days."""
    c = [f"{_value(f'k.f{i}')} > p{i}.threshold" for i in (1, 2, 3)]
    return {
        "p80": _P80, "multi_rules": source,
        "multi_fired": f"""SELECT s.port_name, k.rule_id, sim, day, s.y AS obs, CASE WHEN CASE rule_type
            WHEN 'single' THEN {c[0]} WHEN 'double_AND' THEN {c[0]} AND {c[1]}
            WHEN 'double_OR' THEN {c[0]} OR {c[1]}
            WHEN 'triple_AND' THEN {c[0]} AND {c[1]} AND {c[2]} ELSE ({c[0]} AND {c[1]}) OR {c[2]} END
            THEN 1 ELSE 0 END AS pred
            FROM sim_days s JOIN multi_rules k ON k.port_name = s.port_name
            JOIN p80 p1 ON p1.port_name = s.port_name AND p1.feature = k.f1
            LEFT JOIN p80 p2 ON p2.port_name = s.port_name AND p2.feature = k.f2
            LEFT JOIN p80 p3 ON p3.port_name = s.port_name AND p3.feature = k.f3 WHERE sim < {n_sims}""",
        "multi_days": _run_days("multi_fired", "port_name, rule_id")}


_MULTI_LOSS = """SELECT d.port_name, rule_id, avg(loss_days * n_workers * daily_wage) AS mean_loss,
    quantile_cont(loss_days * n_workers * daily_wage, 0.99) AS p99_loss,
    avg(CASE WHEN loss_days = 0 THEN 1.0 ELSE 0 END) AS zero_prob, avg(n_events) AS mean_events
    FROM multi_days d JOIN exposure e ON e.port_name = d.port_name GROUP BY d.port_name, rule_id"""


def _multi_losses(r: Roles, kinds, n_sims: int):
    """Loss statistics of rules fired with the p80 thresholds on simulated days."""
    armed = search.arm_rules(kinds, _p80(r), PORT)
    days = aep.simulate(r.model_days, PORT, [*FEATURES[:6], "y"], n_sims)
    fired = search.fire_wide(days, armed, PORT, FEATURES[:6])
    losses = aep.price(aep.sim_loss_days(fired, ["port_name", "rule_id"], "pred", MIN_DAYS),
                       r.exposure, PORT)
    return aep.annual_summary(losses, ["port_name", "rule_id"],
                              also=[F.avg("n_events").alias("mean_events")])


_MULTI_COLS = "port_name rule_id mean_loss:6 p99_loss:6 zero_prob:6 mean_events:6"
_FIRST_DOUBLE = """SELECT port_name, 'double_AND|' || a.feature || '+' || b.feature AS rule_id,
    'double_AND' AS rule_type, a.feature AS f1, b.feature AS f2, CAST(NULL AS VARCHAR) AS f3
    FROM ranked6 a JOIN ranked6 b USING (port_name) WHERE a.pos = 0 AND b.pos = 1"""


@query("aep_multi_rule", _MULTI_COLS, "sim_days exposure long", _MULTI_LOSS,
       extra={"ranked6": _BASE_RANKED, **_multi_sql(_FIRST_DOUBLE, N_SIMS)})
def _(r: Roles):
    kinds = rules.double_rules(_base_ranked(r).where(F.col("pos") < 2), PORT, 1)
    return _multi_losses(r, kinds, N_SIMS)


@query("aep_multi_search", _MULTI_COLS + " place:i", "sim_days exposure long",
       f"""SELECT *, row_number() OVER (PARTITION BY port_name ORDER BY mean_loss, rule_id) AS place
           FROM ({_MULTI_LOSS}) QUALIFY place <= 3""",
       extra={"ranked": _BASE_RANKED, **_multi_sql(
           "SELECT port_name, rule_id, rule_type, f1, f2, CAST(f3 AS VARCHAR) AS f3 FROM ("
           + _PAIRS.format(order="i, j", source=_DOUBLE_SOURCE.format(n=4), cap=50) + ")", 40)})
def _(r: Roles):
    from tideledger.operators.report import topk_per_group
    kinds = rules.double_rules(_base_ranked(r).where(F.col("pos") < 4), PORT, 50)
    return topk_per_group(_multi_losses(r, kinds, 40), PORT, [F.asc("mean_loss"), F.asc("rule_id")], 3)


@query("aep_triple_rules", _MULTI_COLS, "sim_days exposure long", _MULTI_LOSS,
       extra={"ranked": _BASE_RANKED, "top4": TOP4, **_multi_sql(_TRIPLES, 100)})
def _(r: Roles):
    return _multi_losses(r, rules.triple_rules(_base_ranked(r), PORT), 100)


# ---- triggers rebuilt inside simulated years -------------------------------------------------

_LINEAGE = {
    "adjusted": """SELECT port_name, date, y, d - (regr_slope(d, x) OVER w * x + regr_intercept(d, x) OVER w)
        AS v FROM (SELECT *, swh_mean_b - avg(swh_mean_b) OVER (PARTITION BY port_name, dayofyear(date))
          + avg(swh_mean_b) OVER (PARTITION BY port_name) AS d,
          CAST(row_number() OVER (PARTITION BY port_name ORDER BY date) - 1 AS DOUBLE) AS x FROM model_days)
        WINDOW w AS (PARTITION BY port_name)""",
    "sim_adjusted": """SELECT s.port_name, sim, day, s.y AS obs, a.v FROM sim_days s JOIN adjusted a
        ON a.port_name = s.port_name AND a.date = s.date WHERE sim < 100""",
    "sim_trigger": """SELECT *, lag(p3) OVER (PARTITION BY port_name, sim ORDER BY day) AS trigger FROM (
        SELECT *, avg(v) OVER (PARTITION BY port_name, sim ORDER BY day ROWS BETWEEN 2 PRECEDING AND
        CURRENT ROW) AS p3 FROM sim_adjusted)""",
    "sim_pred": "SELECT *, CASE WHEN trigger > 0.37 THEN 1 ELSE 0 END AS pred FROM sim_trigger",
    "trig_days": _run_days("sim_pred", "port_name")}


@query("aep_full_lineage", "port_name sim:i loss_days:i n_events:i loss:4", "sim_days exposure",
       """SELECT d.port_name, sim, loss_days, n_events, loss_days * n_workers * daily_wage AS loss
          FROM trig_days d JOIN exposure e ON e.port_name = d.port_name""", extra=_LINEAGE)
def _(r: Roles):
    days = aep.resampled_trigger(r.model_days, PORT, "swh_mean_b", 100, "persistence", 3, 1)
    fired = days.withColumn("pred", F.coalesce((F.col("trigger") > 0.37).cast("int"), F.lit(0)))
    return aep.price(aep.sim_loss_days(fired, PORT, "pred", MIN_DAYS), r.exposure, PORT)


# ---- model probabilities ---------------------------------------------------------------------

@query("aep_ml_threshold", "port_name mean_loss:6 p99_loss:6 zero_prob:6", "sim_days exposure",
       """SELECT d.port_name, avg(loss_days * n_workers * daily_wage) AS mean_loss,
            quantile_cont(loss_days * n_workers * daily_wage, 0.99) AS p99_loss,
            avg(CASE WHEN loss_days = 0 THEN 1.0 ELSE 0 END) AS zero_prob
          FROM cut_days d JOIN exposure e ON e.port_name = d.port_name GROUP BY d.port_name""",
       extra={"probs": _PROBS,
              "cut": """SELECT s.port_name, sim, s.day, CASE WHEN probability > 0.085 THEN 1 ELSE 0 END AS pred
                        FROM sim_days s JOIN probs p ON p.port_name = s.port_name AND p.date = s.date""",
              "cut_days": _run_days("cut", "port_name")})
def _(r: Roles):
    days = aep.simulate(_probabilities(r), PORT, ["probability", "y"], N_SIMS)
    limits = r.exposure.select("port_name", F.lit(0.085).alias("threshold"))
    return aep.annual_summary(aep.single_rule_losses(days, limits, r.exposure, PORT, "probability",
                                                     MIN_DAYS), PORT)


@query("aep_ml_bernoulli", "port_name mean_loss:6 std_loss:3 max_loss:6 min_loss:6 zero_prob:6 "
       "mean_events:6 std_events:6 mean_event_days:6", "model_days exposure",
       """SELECT d.port_name, avg(loss) AS mean_loss, stddev_pop(loss) AS std_loss, max(loss) AS max_loss,
            min(loss) AS min_loss, avg(CASE WHEN loss = 0 THEN 1.0 ELSE 0 END) AS zero_prob,
            avg(n_events) AS mean_events, stddev_pop(n_events) AS std_events,
            avg(event_days) AS mean_event_days
          FROM (SELECT b.*, loss_days * n_workers * daily_wage AS loss FROM bern b JOIN exposure e
                ON e.port_name = b.port_name) d GROUP BY d.port_name""",
       extra={"probs": _PROBS, "drawn": _DRAWN, "bern_in": "SELECT *, flag AS pred FROM drawn",
              "bern": _run_days("bern_in", "port_name", 1)})
def _(r: Roles):
    days = resample.bernoulli_days(_probabilities(r), PORT, 20, "probability")
    losses = aep.price(aep.sim_loss_days(days, PORT, "flag", 1), r.exposure, PORT)
    return aep.annual_summary(losses, PORT, also=[
        F.avg("n_events").alias("mean_events"), F.stddev_pop("n_events").alias("std_events"),
        F.avg("event_days").alias("mean_event_days")])


_MATCH_RUNS = """SELECT port_name, min(date) AS s, max(date) AS e, count(*) AS len FROM (
    SELECT *, row_number() OVER (PARTITION BY port_name ORDER BY date)
      - row_number() OVER (PARTITION BY port_name, {f} ORDER BY date) AS g FROM fired)
    WHERE {f} = 1 GROUP BY port_name, g"""


@query("ml_event_match", "port_name outcome n_events:i total_cost:4 mean_cost:6 p99_cost:6", "fired exposure",
       """SELECT m.port_name, outcome, count(*) AS n_events, sum(cost) AS total_cost, avg(cost) AS mean_cost,
            quantile_cont(cost, 0.99) AS p99_cost FROM (
            SELECT r.port_name, outcome, len * n_workers * daily_wage AS cost FROM (
              SELECT p.port_name, len, CASE WHEN EXISTS (SELECT 1 FROM obs_r o WHERE o.port_name = p.port_name
                AND o.s <= p.e AND p.s <= o.e) THEN 'tp' ELSE 'fp' END AS outcome FROM pred_r p UNION ALL
              SELECT o.port_name, len, 'fn' FROM obs_r o WHERE NOT EXISTS (SELECT 1 FROM pred_r p
                WHERE o.port_name = p.port_name AND o.s <= p.e AND p.s <= o.e)) r
            JOIN exposure e ON e.port_name = r.port_name) m GROUP BY m.port_name, outcome""",
       extra={"pred_r": _MATCH_RUNS.format(f="pred"), "obs_r": _MATCH_RUNS.format(f="obs")})
def _(r: Roles):
    return aep.event_match_summary(aep.event_match(r.fired, PORT), r.exposure, PORT, PORT)


@query("aggregate_aep", "probability:6 aggregate_loss:4 n_runs:i exceedance:6 return_period:6", "curves",
       """SELECT probability, aggregate_loss, n_runs, (n - i) / CAST(n AS DOUBLE) AS exceedance,
            1 / nullif((n - i) / CAST(n AS DOUBLE), 0) AS return_period FROM (
            SELECT *, row_number() OVER (ORDER BY aggregate_loss, probability DESC) AS i, count(*) OVER () AS n
            FROM (SELECT probability, sum(loss) AS aggregate_loss, count(*) AS n_runs FROM curves
                  GROUP BY probability))""")
def _(r: Roles):
    total = aep.aggregate_curves(r.curves.withColumnRenamed("port_name", "run"))
    return aep.exceedance_ecdf(
        total.withColumns({"all": F.lit(1), "tie": -F.col("probability")}), ["all"],
        "aggregate_loss", "tie")


# ---- flagship: one fleet-wide series from raw readings to its exceedance curve ----------------

def _fleet_sql() -> dict[str, str]:
    """The bootstrap CTEs of the model days, over the fleet's days instead."""
    import re

    from tideledger.plans.base_sql import CTE
    steps = ["numbered", "starts", "centres", "fitting", "candidates", "sim_days"]
    out = {"fleet_days": f"""SELECT 'ALL' AS port_name, date,
        floor(avg(swh) * 134217728 + 0.5) / 134217728 AS v FROM readings_a GROUP BY date"""}
    for step in steps:
        text = CTE[step][1]
        for name in ["model_days", *steps]:
            text = re.sub(rf"\b{name}\b", "fleet_days" if name == "model_days" else f"fleet_{name}", text)
        out[f"fleet_{step}"] = text
    out["fleet_pred"] = """SELECT port_name, sim, day, CASE WHEN v > (SELECT quantile_cont(v, 0.75)
        FROM fleet_days) THEN 1 ELSE 0 END AS pred FROM fleet_sim_days"""
    out["fleet_losses"] = _run_days("fleet_pred", "port_name")
    return out


@query("aep_fleet", "run sim:i loss:4 rank:i probability:6", "readings_a exposure draws",
       """SELECT 'ALL' AS run, sim, loss, row_number() OVER (ORDER BY loss DESC, sim) AS rank,
            row_number() OVER (ORDER BY loss DESC, sim) / (count(*) OVER () + 1.0) AS probability
          FROM (SELECT sim, loss_days * (SELECT sum(n_workers * daily_wage) FROM exposure) AS loss
                FROM fleet_losses)""", extra=_fleet_sql())
def _(r: Roles):
    from tideledger.functions.scalars import snapped
    days = r.readings_a.groupBy(F.lit("ALL").alias("run"), "date").agg(snapped(F.avg("swh")).alias("v"))
    money = r.exposure.groupBy(F.lit("ALL").alias("run")).agg(
        F.sum(F.col("n_workers") * F.col("daily_wage")).alias("daily_wage"), F.lit(1).alias("n_workers"))
    return aep.aep_curve(days, money, ["run"], "v", 0.75, N_SIMS, MIN_DAYS)
