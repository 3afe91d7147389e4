"""Checked queries: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideledger.functions.scalars import confusion_aggs, with_metrics
from tideledger.operators import aep, daily, exposure, quantiles, report, runs, search
from tideledger.plans.registry import query
from tideledger.plans.roles import PORT, Roles
from tideledger.session import durable

_PCT = {"p25": 0.25, "median": 0.5, "p60": 0.6, "p75": 0.75, "p80": 0.8}


def _sql_longest(source: str, order: str) -> str:
    """Longest run above the threshold per port-day."""
    return f"""SELECT port_name, date, max(CASE WHEN up = 1 THEN len ELSE 0 END) AS longest FROM (
        SELECT port_name, date, up, g, count(*) AS len FROM (
          SELECT *, row_number() OVER (PARTITION BY port_name, date ORDER BY {order})
            - row_number() OVER (PARTITION BY port_name, date, up ORDER BY {order}) AS g
          FROM (SELECT r.*, CASE WHEN swh > threshold THEN 1 ELSE 0 END AS up
                FROM {source} r JOIN cut USING (port_name))) GROUP BY ALL) GROUP BY port_name, date"""


def _chunked(readings, per_chunk: int):
    return readings.withColumn("chunk", F.floor(F.col("reading_id") / per_chunk))


@query("daily_agg_model",
       "port_name date:d swh_mean:6 swh_max:6 swh_min:6 swh_median:6 swh_p25:6 swh_p60:6 swh_p75:6 "
       "swh_p80:6 swh_sd:6 total_obs:i clima_swh_mean:6 anom_swh_mean:6 anom_swh_max:6 anom_swh_min:6 "
       "anom_swh_median:6 anom_swh_p25:6 anom_swh_p75:6 anom_swh_p80:6 anom_swh_sd:6 hours_above:i "
       "pct_day_above:6 max_consecutive_above:i swh_cv:6 swh_range:6 swh_iqr:6 anom_cv:6 "
       "anom_range:6 anom_iqr:6 duration_intensity:6", "readings_a",
       """SELECT a.*, h.hours_above, h.pct_day_above, longest AS max_consecutive_above,
            swh_sd / nullif(swh_mean, 0) AS swh_cv, swh_max - swh_min AS swh_range,
            swh_p75 - swh_p25 AS swh_iqr, anom_swh_sd / nullif(round(anom_swh_mean, 6), 0) AS anom_cv,
            anom_swh_max - anom_swh_min AS anom_range, anom_swh_p75 - anom_swh_p25 AS anom_iqr,
            h.hours_above * swh_mean AS duration_intensity
          FROM agg a JOIN hrs h USING (port_name, date) JOIN lng USING (port_name, date)
          WHERE date >= DATE '1996-01-01'""",
       extra={
           "clim": """SELECT port_name, strftime(date, '%m-%d') AS md, avg(swh) AS c FROM readings_a
                      GROUP BY ALL""",
           "anoms": """SELECT r.*, c, swh - c AS an FROM readings_a r JOIN clim ON
                       r.port_name = clim.port_name AND strftime(date, '%m-%d') = md""",
           "agg": "SELECT port_name, date, avg(swh) AS swh_mean, max(swh) AS swh_max, "
                  "min(swh) AS swh_min, stddev_samp(swh) AS swh_sd, count(*) AS total_obs, "
                  + ", ".join(f"quantile_cont(swh, {p}) AS swh_{k}" for k, p in _PCT.items())
                  + ", avg(c) AS clima_swh_mean, avg(an) AS anom_swh_mean, max(an) AS anom_swh_max, "
                  "min(an) AS anom_swh_min, stddev_samp(an) AS anom_swh_sd, "
                  + ", ".join(f"quantile_cont(an, {p}) AS anom_swh_{k}" for k, p in _PCT.items())
                  + " FROM anoms GROUP BY port_name, date",
           "cut": """SELECT port_name, quantile_cont(swh, 0.6) AS threshold FROM readings_a
                     WHERE year(date) < 2001 GROUP BY port_name""",
           "hrs": """SELECT port_name, date, count(*) FILTER (WHERE swh > threshold) AS hours_above,
                     avg(CASE WHEN swh > threshold THEN 1 ELSE 0 END) * 100 AS pct_day_above
                     FROM readings_a JOIN cut USING (port_name) GROUP BY port_name, date""",
           "lng": _sql_longest("readings_a", "reading_id")})
def _(r: Roles):
    return daily.daily_model(_chunked(r.readings_a, 1000), PORT, "reading_id", 2001, "1996-01-01",
                             chunk="chunk")


@query("daily_agg_reanalysis",
       "port_name date:d swh_mean:6 swh_max:6 swh_min:6 swh_median:6 swh_p25:6 swh_p75:6 swh_p80:6 "
       "swh_sd:6 swh_cv:6 swh_range:6 swh_iqr:6 clima_swh_mean:6 anom_swh_mean:6 anom_swh_max:6 "
       "anom_swh_min:6 anom_swh_sd:6 anom_swh_p80:6 anom_swh_cv:6 anom_swh_range:6 clima_swe_mean:6 "
       "anom_swe_mean:6 anom_swe_max:6 anom_swe_min:6 anom_swe_sd:6 anom_swe_p80:6 anom_swe_cv:6 "
       "anom_swe_range:6 hours_above:i pct_day_above:6 max_consecutive_above:i total_obs:i "
       "duration_intensity:6", "readings_b",
       """SELECT a.*, h.hours_above, h.pct_day_above, longest AS max_consecutive_above,
            coalesce(sdp / nullif(swh_mean, 0), 0) AS swh_cv, swh_max - swh_min AS swh_range,
            swh_p75 - swh_p25 AS swh_iqr,
            coalesce(sdp / nullif(round(anom_swh_mean, 6), 0), 0) AS anom_swh_cv,
            coalesce(sdpe / nullif(round(anom_swe_mean, 6), 0), 0) AS anom_swe_cv,
            anom_swh_max - anom_swh_min AS anom_swh_range,
            anom_swe_max - anom_swe_min AS anom_swe_range,
            h.hours_above * swh_mean AS duration_intensity
          FROM agg a JOIN hrs h USING (port_name, date) JOIN lng USING (port_name, date)
          WHERE year(date) >= 1996""",
       extra={
           "clim": """SELECT port_name, strftime(date, '%m-%d') AS md, avg(swh) AS c, avg(swe) AS ce
                      FROM readings_b GROUP BY ALL""",
           "anoms": """SELECT r.*, c, ce, swh - c AS an, swe - ce AS ane FROM readings_b r JOIN clim
                       ON r.port_name = clim.port_name AND strftime(date, '%m-%d') = md""",
           "agg": """SELECT port_name, date, avg(swh) AS swh_mean, max(swh) AS swh_max,
                  min(swh) AS swh_min, stddev_samp(swh) AS swh_sd, stddev_pop(swh) AS sdp,
                  stddev_pop(swe) AS sdpe, count(*) AS total_obs,
                  quantile_cont(swh, 0.5) AS swh_median, quantile_cont(swh, 0.25) AS swh_p25,
                  quantile_cont(swh, 0.75) AS swh_p75, quantile_cont(swh, 0.8) AS swh_p80,
                  avg(c) AS clima_swh_mean, avg(an) AS anom_swh_mean, max(an) AS anom_swh_max,
                  min(an) AS anom_swh_min, stddev_samp(an) AS anom_swh_sd,
                  quantile_cont(an, 0.8) AS anom_swh_p80, avg(ce) AS clima_swe_mean,
                  avg(ane) AS anom_swe_mean, max(ane) AS anom_swe_max, min(ane) AS anom_swe_min,
                  stddev_samp(ane) AS anom_swe_sd, quantile_cont(ane, 0.8) AS anom_swe_p80
                  FROM anoms GROUP BY port_name, date""",
           "cut": """SELECT port_name, quantile_cont(swh, 0.75) AS threshold FROM readings_b
                     WHERE year(date) < 2001 GROUP BY port_name""",
           "hrs": """SELECT port_name, date, count(*) FILTER (WHERE swh > threshold) AS hours_above,
                     avg(CASE WHEN swh > threshold THEN 1 ELSE 0 END) * 100 AS pct_day_above
                     FROM readings_b JOIN cut USING (port_name) GROUP BY port_name, date""",
           "lng": _sql_longest("readings_b", "reading_id, swh")})
def _(r: Roles):
    # read four times: the join of lines to orders is written once
    readings = _chunked(durable(r.readings_b.drop("net")), 10000).withColumn("moment", F.struct("reading_id", "swh"))
    return daily.daily_reanalysis(readings, PORT, "moment", 2001, 1996, chunk="chunk")


@query("calibrated_threshold", "port_name threshold:6", "readings_a",
       """SELECT port_name, quantile_cont(swh, 0.6) AS threshold FROM readings_a
          WHERE year(date) < 2001 GROUP BY port_name""")
def _(r: Roles):
    return daily.calibrated_threshold(r.readings_a, PORT, "swh", 2001, 0.60)


@query("exceed_counts", "port_name date:d hours_above:i pct_day_above:6", "hours",
       """SELECT port_name, date, count(*) FILTER (WHERE swh > t) AS hours_above,
          avg(CASE WHEN swh > t THEN 1 ELSE 0 END) * 100 AS pct_day_above FROM hours
          JOIN (SELECT port_name, quantile_cont(swh, 0.75) AS t FROM hours GROUP BY port_name)
          USING (port_name) GROUP BY port_name, date""")
def _(r: Roles):
    limits = daily.calibrated_threshold(r.events, PORT, "swh", 2025, 0.75)
    return daily.exceed_counts(r.events, limits, PORT, "swh")


@query("exact_percentile", "port_name p5:6 p25:6 p50:6 p75:6 p95:6 p99:6", "readings_b",
       "SELECT port_name, " + ", ".join(f"quantile_cont(swh, {p / 100}) AS p{p}"
                                        for p in (5, 25, 50, 75, 95, 99))
       + " FROM readings_b GROUP BY port_name")
def _(r: Roles):
    # small split size, so the bucketed way is the one checked
    return quantiles.exact_percentiles(durable(r.readings_b.select("port_name", "swh")), PORT, "swh",
                                       {f"p{p}": p / 100 for p in (5, 25, 50, 75, 95, 99)},
                                       split_above=1000)


@query("daily_event_max", "date:d y:i", "labelled",
       "SELECT date, max(y) AS y FROM labelled GROUP BY date")
def _(r: Roles):
    return daily.daily_event_max(r.labelled, "y")


@query("wage_params", "port_name daily_wage:6 n_workers:6 daily_loss:6", "params",
       "SELECT * FROM params")
def _(r: Roles):
    return exposure.wage_params(r.wages)


@query("wage_median_fill", "port_name daily_wage:6 n_workers:6 daily_loss:6", "params",
       """SELECT port_name, daily_wage, n_workers, daily_loss FROM params UNION ALL
          SELECT 'HARBOUR_' || r_name, w, n, l FROM region CROSS JOIN (SELECT median(daily_wage) AS w,
            median(n_workers) AS n, median(daily_loss) AS l FROM params)""")
def _(r: Roles):
    names = r.table("region").select(F.concat(F.lit("HARBOUR_"), "r_name").alias("port_name"))
    return exposure.wage_median_fill(exposure.wage_params(r.wages), names)


@query("group_exposure", "run n_listed:i n_workers:6 daily_wage:6", "params run_ports",
       """SELECT run, count(*) AS n_listed, coalesce(sum(n_workers), 1) AS n_workers,
          coalesce(sum(daily_wage) / count(*) / 3.5, 1) AS daily_wage
          FROM run_ports LEFT JOIN params USING (port_name) GROUP BY run""")
def _(r: Roles):
    return exposure.group_exposure(exposure.wage_params(r.wages), r.run_ports)


@query("economic_daily", "port_name date:d event_dummy_1:i n_workers:6 daily_wage:6 daily_loss:6",
       "labelled exposure",
       """SELECT l.port_name, date, y AS event_dummy_1, coalesce(e.n_workers, m.n) AS n_workers,
          coalesce(e.daily_wage, m.w) AS daily_wage,
          coalesce(e.n_workers * e.daily_wage, m.x) AS daily_loss FROM labelled l
          LEFT JOIN known e USING (port_name) CROSS JOIN (SELECT median(n_workers) AS n,
            median(daily_wage) AS w, median(n_workers * daily_wage) AS x FROM known) m""",
       extra={"known": "SELECT * FROM exposure WHERE port_name <> '5-LOW'"})
def _(r: Roles):
    return exposure.economic_daily(r.labelled, *_economics(r), flag="y")


def _economics(r: Roles):
    known = (r.exposure.where(F.col("port_name") != "5-LOW")
             .withColumn("daily_loss", F.col("n_workers") * F.col("daily_wage")))
    return known, exposure.wage_medians(known)


@query("economic_total", "port_name n_days:i event_days:i event_rate:6 daily_loss:6 total_loss:6", "labelled exposure",
       """SELECT port_name, n_days, days AS event_days, rate AS event_rate, loss AS daily_loss, days * loss AS total_loss
          FROM (SELECT port_name, count(*) AS n_days, sum(y) AS days, avg(y) AS rate FROM labelled GROUP BY ALL) JOIN (
            SELECT p.port_name, coalesce(e.n_workers * e.daily_wage, m.x) AS loss FROM
            (SELECT DISTINCT port_name FROM labelled) p LEFT JOIN known e USING (port_name)
            CROSS JOIN (SELECT median(n_workers * daily_wage) AS x FROM known) m) USING (port_name)""",
       extra={"known": "SELECT * FROM exposure WHERE port_name <> '5-LOW'"})
def _(r: Roles):
    return exposure.economic_total(exposure.economic_daily(r.labelled, *_economics(r), flag="y"))


@query("economic_yearly", "port_name year:i event_days:i event_rate:6 daily_loss:6 yearly_loss:6",
       "labelled exposure",
       """SELECT port_name, year, days AS event_days, rate AS event_rate, loss AS daily_loss,
          days * loss AS yearly_loss FROM (SELECT port_name, year(date) AS year, sum(y) AS days,
            avg(y) AS rate FROM labelled GROUP BY ALL) JOIN (
            SELECT p.port_name, coalesce(e.n_workers * e.daily_wage, m.x) AS loss FROM
            (SELECT DISTINCT port_name FROM labelled) p LEFT JOIN known e USING (port_name)
            CROSS JOIN (SELECT median(n_workers * daily_wage) AS x FROM known) m) USING (port_name)""",
       extra={"known": "SELECT * FROM exposure WHERE port_name <> '5-LOW'"})
def _(r: Roles):
    return exposure.economic_yearly(exposure.economic_daily(r.labelled, *_economics(r), flag="y"))


_CONFUSION = """SELECT port_name, count(*) FILTER (WHERE pred = 1 AND obs = 1) AS tp,
    count(*) FILTER (WHERE pred = 1 AND obs = 0) AS fp, count(*) FILTER (WHERE pred = 0 AND obs = 0)
    AS tn, count(*) FILTER (WHERE pred = 0 AND obs = 1) AS fn FROM {0} GROUP BY port_name{1}"""
_METRICS = """coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS precision,
    coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS recall,
    coalesce((tp + tn) / nullif(CAST(tp + fp + tn + fn AS DOUBLE), 0), 0) AS accuracy,
    coalesce(2.0 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0) AS f1,
    coalesce(tn / nullif(CAST(tn + fp AS DOUBLE), 0), 0) AS specificity"""


@query("confusion_counts", "port_name tp:i fp:i tn:i fn:i", "fired", _CONFUSION.format("fired", ""))
def _(r: Roles):
    return r.fired.groupBy("port_name").agg(*confusion_aggs(F.col("pred"), F.col("obs")))


@query("classification_metrics", "port_name precision:6 recall:6 accuracy:6 f1:6 specificity:6",
       "fired", f"SELECT port_name, {_METRICS} FROM ({_CONFUSION.format('fired', '')})")
def _(r: Roles):
    return with_metrics(r.fired.groupBy("port_name").agg(
        *confusion_aggs(F.col("pred"), F.col("obs"))))


@query("cv_summary", "port_name feature n_folds:i f1_mean:6 f1_std:6 precision_mean:6 recall_mean:6 "
       "accuracy_mean:6 tp_total:i fp_total:i tn_total:i fn_total:i", "best_t",
       f"""SELECT port_name, feature, count(*) AS n_folds, avg(f1) AS f1_mean,
           stddev_samp(f1) AS f1_std, avg(precision) AS precision_mean, avg(recall) AS recall_mean,
           avg(accuracy) AS accuracy_mean, sum(tp) AS tp_total, sum(fp) AS fp_total,
           sum(tn) AS tn_total, sum(fn) AS fn_total FROM (SELECT port_name, feature, tp, fp, tn, fn,
           {_METRICS} FROM best_t) GROUP BY port_name, feature""")
def _(r: Roles):
    return search.cv_summary(with_metrics(r.best_thresholds), ["port_name", "feature"])


@query("ml_cv_summary", "port_name metric mean:6 std:6 min:6 max:6", "best_t",
       " UNION ALL ".join(
           f"""SELECT port_name, '{m}' AS metric, avg({m}) AS mean, stddev_samp({m}) AS std,
               min({m}) AS min, max({m}) AS max FROM folds GROUP BY port_name"""
           for m in ("precision", "recall", "accuracy", "f1")),
       extra={"folds": f"SELECT port_name, {_METRICS} FROM best_t"})
def _(r: Roles):
    folds = with_metrics(r.best_thresholds)
    return report.metric_spread(folds, PORT, ["precision", "recall", "accuracy", "f1"])


_SUMMARY = """count(*) AS n_simulations, avg(loss) AS mean_loss, stddev_pop(loss) AS std_loss,
    max(loss) AS max_loss, min(loss) AS min_loss, median(loss) AS median_loss,
    quantile_cont(loss, 0.95) AS p95_loss, quantile_cont(loss, 0.99) AS p99_loss,
    avg(CASE WHEN loss = 0 THEN 1.0 ELSE 0 END) AS zero_prob"""
_SUMMARY_COLS = ("n_simulations:i mean_loss:6 std_loss:3 max_loss:6 min_loss:6 median_loss:6 "
                 "p95_loss:6 p99_loss:6 zero_prob:6")


@query("annual_summary", "port_name " + _SUMMARY_COLS, "sim_losses",
       f"SELECT port_name, {_SUMMARY} FROM sim_losses GROUP BY port_name")
def _(r: Roles):
    return aep.annual_summary(r.sim_losses, PORT)


@query("component_summary", "port_name component mean_events:6 " + _SUMMARY_COLS, "components",
       f"""SELECT port_name, component, avg(n_events) AS mean_events, {_SUMMARY} FROM components
           GROUP BY port_name, component""")
def _(r: Roles):
    return aep.component_summary(r.components, PORT)


_LOSS_STATS = """SELECT port_name, count(*) AS n, sum(v) AS total, avg(v) AS mean, median(v) AS median,
    stddev_samp(v) AS sd, min(v) AS min, max(v) AS max, {q},
    count(*) FILTER (WHERE v = 0) AS zero_years, count(*) FILTER (WHERE v > q75) AS high_years,
    count(*) FILTER (WHERE v > q90) AS extreme_years, stddev_samp(v) / nullif(avg(v), 0) AS cv
    FROM (SELECT port_name, v, quantile_cont(v, 0.75) OVER (PARTITION BY port_name) AS q75,
          quantile_cont(v, 0.9) OVER (PARTITION BY port_name) AS q90
          FROM (SELECT port_name, {{v}} AS v FROM {{t}})) GROUP BY port_name""".format(
    q=", ".join(f"quantile_cont(v, {p / 100}) AS p{p}" for p in (25, 75, 90, 95, 99)))
_STATS_COLS = ("port_name n:i total:6 mean:6 median:6 sd:3 min:6 max:6 p25:6 p75:6 p90:6 p95:6 p99:6 "
               "zero_years:i high_years:i extreme_years:i cv:6")


@query("observed_loss_stats", _STATS_COLS, "obs_yearly",
       _LOSS_STATS.format(v="observed_loss", t="obs_yearly"))
def _(r: Roles):
    return exposure.loss_stats(r.obs_yearly, PORT, "observed_loss")


@query("simulated_loss_stats", _STATS_COLS, "sim_losses",
       _LOSS_STATS.format(v="loss", t="sim_losses WHERE loss >= 0"))
def _(r: Roles):
    return exposure.loss_stats(r.sim_losses.where(F.col("loss") >= 0), PORT, "loss")


_LADDER = """SELECT d.port_name, year, k AS min_days, count(*) FILTER (WHERE len >= k) AS days_closed,
            count(*) FILTER (WHERE len >= k AND (CASE WHEN k = 1 THEN prev_y ELSE prev END) < k)
              AS num_events,
            sum(CASE WHEN len >= k THEN n_workers * daily_wage ELSE 0 END) AS total_loss
          FROM (SELECT *, lag(len) OVER (PARTITION BY port_name ORDER BY date) AS prev,
                  lag(len) OVER (PARTITION BY port_name, year ORDER BY date) AS prev_y
                FROM (SELECT *, CASE WHEN y = 1 THEN count(*) OVER (PARTITION BY port_name, y, g)
                             ELSE 0 END AS len
                      FROM (SELECT *, year(date) AS year,
                            row_number() OVER (PARTITION BY port_name ORDER BY date)
                            - row_number() OVER (PARTITION BY port_name, y ORDER BY date) AS g
                            FROM labelled))) d
          JOIN exposure e ON e.port_name = d.port_name CROSS JOIN range(1, 8) t(k)
          GROUP BY d.port_name, year, k"""


@query("duration_ladder", "port_name year:i min_days:i days_closed:i num_events:i total_loss:6",
       "labelled exposure", _LADDER)
def _(r: Roles):
    return _ladder(r)


def _ladder(r: Roles):
    days = r.labelled.withColumn("year", F.year("date")).join(r.exposure, "port_name")
    return runs.duration_ladder(days, PORT, "date", "y", "year",
                                F.col("n_workers") * F.col("daily_wage"))


@query("duration_ladder_stats", "port_name min_days:i total_loss:4 avg_loss_per_year:4 total_events:i total_days_closed:i "
       "years_with_events:i avg_events_per_year:6 avg_days_closed_per_year:6", "labelled exposure",
       f"""SELECT port_name, min_days, sum(total_loss) AS total_loss, avg(total_loss) AS avg_loss_per_year,
            sum(num_events) AS total_events, sum(days_closed) AS total_days_closed,
            count(*) FILTER (WHERE total_loss > 0) AS years_with_events, avg(num_events) AS avg_events_per_year,
            avg(days_closed) AS avg_days_closed_per_year FROM ({_LADDER}) GROUP BY port_name, min_days""")
def _(r: Roles):
    return runs.ladder_stats(_ladder(r), PORT)


_WIDE = [(k, c, kind) for k in range(1, 8) for c, kind in (("total_loss", "6"), ("num_events", "i"), ("days_closed", "i"))]


@query("duration_ladder_wide", "port_name year:i " + " ".join(f"{k}day_{c}:{kind}" for k, c, kind in _WIDE), "labelled exposure",
       "SELECT port_name, year, " + ", ".join(f'max(CASE WHEN min_days = {k} THEN {c} END) AS "{k}day_{c}"' for k, c, _ in _WIDE)
       + f" FROM ({_LADDER}) GROUP BY port_name, year")
def _(r: Roles):
    return runs.ladder_wide(_ladder(r), PORT)


@query("yearly_observed_loss", "port_name year:i loss_days:i observed_loss:6", "obs_yearly",
       "SELECT * FROM obs_yearly")
def _(r: Roles):
    return r.obs_yearly


@query("region_sum_observed", "year:i loss:6 n_runs:i", "obs_yearly",
       """SELECT year, sum(observed_loss) AS loss, count(DISTINCT port_name) AS n_runs FROM obs_yearly
          GROUP BY year HAVING count(DISTINCT port_name) = (SELECT count(DISTINCT port_name)
          FROM obs_yearly)""")
def _(r: Roles):
    return report.region_sum_observed(r.obs_yearly, run="port_name", common_years=True)


@query("region_sum_simulated", "rank:i loss:6 n_runs:i", "curves",
       "SELECT rank, sum(loss) AS loss, count(*) AS n_runs FROM curves GROUP BY rank")
def _(r: Roles):
    return report.region_sum_simulated(r.curves, [])


@query("yearly_evolution", "method year:i total_loss:6 mean_loss:6", "method_years",
       """SELECT method, year, sum(loss) AS total_loss, avg(loss) AS mean_loss FROM method_years
          GROUP BY method, year""")
def _(r: Roles):
    return r.method_years.groupBy("method", "year").agg(
        F.sum("loss").alias("total_loss"), F.avg("loss").alias("mean_loss"))


@query("region_stats", "port_name n_years:i mean_loss:6 total_loss:6", "obs_yearly",
       """SELECT port_name, count(*) AS n_years, avg(observed_loss) AS mean_loss,
          sum(observed_loss) AS total_loss FROM obs_yearly GROUP BY port_name""")
def _(r: Roles):
    return r.obs_yearly.groupBy("port_name").agg(
        F.count(F.lit(1)).alias("n_years"), F.avg("observed_loss").alias("mean_loss"),
        F.sum("observed_loss").alias("total_loss"))


_RULE_RUNS = """SELECT feature AS rule_id, port_name AS run, avg(tp / CAST(tp + fn AS DOUBLE))
    AS recall, CASE WHEN feature LIKE '%\\_a' ESCAPE '\\' THEN 'single' ELSE 'multi' END AS rule_type
    FROM best_t WHERE tp + fn > 0 GROUP BY feature, port_name
    HAVING avg(tp / CAST(tp + fn AS DOUBLE)) > 0.4"""


def _rule_runs(r: Roles):
    recall = F.avg(F.col("tp") / (F.col("tp") + F.col("fn")).cast("double"))
    return (r.best_thresholds.where(F.col("tp") + F.col("fn") > 0)
            .groupBy(F.col("feature").alias("rule_id"), F.col("port_name").alias("run"))
            .agg(recall.alias("recall")).where(F.col("recall") > 0.4)
            .withColumn("rule_type", F.when(F.col("rule_id").endswith("_a"), "single")
                                      .otherwise("multi")))


@query("rule_coverage", "rule_id mean_recall:6 min_recall:6 runs_present:i rule_type", "best_t",
       """SELECT rule_id, avg(recall) AS mean_recall, min(recall) AS min_recall,
          count(DISTINCT run) AS runs_present, min(rule_type) AS rule_type FROM rule_runs
          GROUP BY rule_id HAVING count(DISTINCT run) >= greatest(3, floor(0.6 * (
            SELECT count(DISTINCT run) FROM rule_runs))) AND avg(recall) >=
          CASE WHEN min(rule_type) = 'single' THEN 0.6 ELSE 0.55 END""",
       extra={"rule_runs": _RULE_RUNS})
def _(r: Roles):
    return report.rule_coverage(_rule_runs(r), min_runs=3)


@query("coverage_distribution", "runs_present:i n_rules:i", "best_t",
       """SELECT runs_present, count(*) AS n_rules FROM (SELECT rule_id, count(DISTINCT run)
          AS runs_present FROM rule_runs GROUP BY rule_id) GROUP BY runs_present""",
       extra={"rule_runs": _RULE_RUNS})
def _(r: Roles):
    return report.coverage_distribution(_rule_runs(r))


@query("component_breakdown", "port_name component mean_loss:6 std_loss:3 p95:6 p99:6 max_loss:6 "
       "loss_recall:6 observed_last_year:i predicted_last_year:i", "components fired",
       """SELECT s.*, coalesce(sum(CASE WHEN component = 'tp' THEN mean_loss END) OVER w
            / nullif(sum(CASE WHEN component IN ('tp', 'fn') THEN mean_loss END) OVER w, 0), 0)
            AS loss_recall, observed_last_year, predicted_last_year
          FROM (SELECT port_name, component, avg(loss) AS mean_loss, stddev_samp(loss) AS std_loss,
                quantile_cont(loss, 0.95) AS p95, quantile_cont(loss, 0.99) AS p99,
                max(loss) AS max_loss FROM components WHERE component <> 'insurance' GROUP BY ALL) s
          JOIN (SELECT port_name, sum(obs) AS observed_last_year, sum(pred) AS predicted_last_year
                FROM fired f WHERE year(date) = (SELECT max(year(date)) FROM fired g
                WHERE g.port_name = f.port_name) GROUP BY port_name) l USING (port_name)
          WINDOW w AS (PARTITION BY port_name)""")
def _(r: Roles):
    return report.component_breakdown(r.components, report.last_year_counts(r.fired, PORT), PORT)


@query("run_observed_ratio", "run predicted_total:6 observed_mean:6 ratio:6", "method_years obs_yearly",
       """SELECT port_name AS run, p AS predicted_total, o AS observed_mean,
          coalesce(p / nullif(o, 0), 0) AS ratio
          FROM (SELECT port_name, sum(loss) AS p FROM method_years WHERE method = 'p95' GROUP BY 1)
          JOIN (SELECT port_name, avg(observed_loss) AS o FROM obs_yearly GROUP BY 1)
          USING (port_name)""")
def _(r: Roles):
    predicted = r.method_years.where(F.col("method") == "p95")
    return report.run_observed_ratio(predicted.withColumnRenamed("port_name", "run"),
                                     r.obs_yearly.withColumnRenamed("port_name", "run"))


@query("aggregate_metrics_table", "metric value:6", "obs_yearly curves",
       """SELECT 'observed_' || k AS metric, CASE k WHEN 'mean' THEN avg(l) WHEN 'p95' THEN
            quantile_cont(l, 0.95) WHEN 'p99' THEN quantile_cont(l, 0.99) ELSE max(l) END AS value
          FROM (SELECT year, sum(observed_loss) AS l FROM obs_yearly GROUP BY year)
          CROSS JOIN (VALUES ('mean'), ('p95'), ('p99'), ('max')) v(k) GROUP BY k UNION ALL
          SELECT 'simulated_' || k, CASE k WHEN 'mean' THEN avg(l) WHEN 'p95' THEN
            quantile_cont(l, 0.95) WHEN 'p99' THEN quantile_cont(l, 0.99) ELSE max(l) END
          FROM (SELECT rank, sum(loss) AS l FROM curves GROUP BY rank)
          CROSS JOIN (VALUES ('mean'), ('p95'), ('p99'), ('max')) v(k) GROUP BY k""")
def _(r: Roles):
    return report.aggregate_metrics(report.region_sum_observed(r.obs_yearly, run="port_name"),
                                    report.region_sum_simulated(r.curves, []))


@query("weighted_mean_loss", "port_name weighted_mean_loss:4", "curves",
       """SELECT port_name, sum(loss * probability) / sum(probability) AS weighted_mean_loss
          FROM curves GROUP BY port_name""")
def _(r: Roles):
    return report.weighted_mean_loss(r.curves, PORT)


_MEANS = "SELECT port_name, method, avg(loss) AS mean_loss FROM method_years GROUP BY ALL"


def _means(r: Roles):
    return r.method_years.groupBy("port_name", "method").agg(F.avg("loss").alias("mean_loss"))


@query("method_ranking", "port_name method mean_loss:6 rank:i improvement_vs_worst:6", "method_years",
       """SELECT *, rank() OVER (PARTITION BY port_name ORDER BY mean_loss) AS rank,
          coalesce((max(mean_loss) OVER (PARTITION BY port_name) - mean_loss)
            / nullif(max(mean_loss) OVER (PARTITION BY port_name), 0), 0) * 100
            AS improvement_vs_worst FROM means""", extra={"means": _MEANS})
def _(r: Roles):
    return report.method_ranking(_means(r), PORT)


@query("method_comparison", "port_name method_a method_b improvement_pct:6", "method_years",
       """SELECT a.port_name, a.method AS method_a, b.method AS method_b,
          coalesce((b.mean_loss - a.mean_loss) / nullif(b.mean_loss, 0), 0) * 100 AS improvement_pct
          FROM means a JOIN means b ON a.port_name = b.port_name AND a.method < b.method""",
       extra={"means": _MEANS})
def _(r: Roles):
    return report.method_comparison(_means(r), "port_name")


@query("winner_counts", "method wins:i", "method_years",
       """SELECT method, count(*) AS wins FROM (SELECT * FROM means QUALIFY row_number() OVER (
          PARTITION BY port_name ORDER BY mean_loss, method) = 1) GROUP BY method""",
       extra={"means": _MEANS})
def _(r: Roles):
    return report.winner_counts(_means(r), "port_name", "method", "mean_loss")


@query("totals_row", "run tp:i fp:i tn:i fn:i precision:6 recall:6 accuracy:6 f1:6", "fired",
       f"""SELECT run, tp, fp, tn, fn, {_METRICS} FROM (SELECT port_name AS run, tp, fp, tn, fn FROM c
           UNION ALL SELECT 'TOTAL', sum(tp), sum(fp), sum(tn), sum(fn) FROM c)""",
       extra={"c": _CONFUSION.format("fired", "")})
def _(r: Roles):
    counts = r.fired.groupBy(F.col("port_name").alias("run")).agg(
        *confusion_aggs(F.col("pred"), F.col("obs")))
    return report.totals_row(counts)


@query("run_group_metrics", "method run_group mean_loss:6 p99_loss:6", "method_years",
       """SELECT method, CASE WHEN port_name < '3' THEN 'upper' ELSE 'lower' END AS run_group,
          avg(loss) AS mean_loss, quantile_cont(loss, 0.99) AS p99_loss FROM method_years
          GROUP BY ALL""")
def _(r: Roles):
    group = F.when(F.col("port_name") < "3", "upper").otherwise("lower")
    return report.group_metrics(r.method_years.withColumn("run_group", group),
                                ["method", "run_group"], "loss")


@query("closest_threshold", "port_name method mean_loss:6 observed_mean:6", "method_years obs_yearly",
       """SELECT port_name, method, mean_loss, o AS observed_mean FROM means JOIN (
            SELECT port_name, avg(observed_loss) AS o FROM obs_yearly GROUP BY 1) USING (port_name)
          QUALIFY row_number() OVER (PARTITION BY port_name ORDER BY abs(mean_loss - o), method) = 1""",
       extra={"means": _MEANS})
def _(r: Roles):
    observed = r.obs_yearly.groupBy("port_name").agg(F.avg("observed_loss").alias("observed_mean"))
    return report.closest_threshold(_means(r).join(observed, "port_name"), PORT, "mean_loss",
                                    "observed_mean", "method")


@query("cost_shares", "port_name fp_share:6 tp_share:6 fn_cost:6", "components",
       """SELECT port_name, coalesce(fp / nullif(fp + tp, 0), 0) AS fp_share,
          coalesce(tp / nullif(fp + tp, 0), 0) AS tp_share, fn AS fn_cost FROM (
            SELECT port_name, avg(loss) FILTER (WHERE component = 'fp') AS fp,
            avg(loss) FILTER (WHERE component = 'tp') AS tp,
            avg(loss) FILTER (WHERE component = 'fn') AS fn FROM components GROUP BY port_name)""")
def _(r: Roles):
    means = r.components.groupBy("port_name", "component").agg(F.avg("loss").alias("mean_loss"))
    return aep.cost_shares(means, PORT)


@query("loss_histogram", "port_name bin:i n:i left:6 density:9", "sim_losses",
       """SELECT port_name, bin, count(*) AS n, lo + bin * w AS left,
          coalesce(count(*) / nullif(total * w, 0), 0) AS density FROM (
            SELECT port_name, lo, (hi - lo) / 30 AS w, total,
              CAST(least(coalesce(floor((loss - lo) / nullif((hi - lo) / 30, 0)), 0), 29) AS INTEGER)
              AS bin FROM (SELECT port_name, loss, min(loss) OVER p AS lo, max(loss) OVER p AS hi,
                count(*) OVER p AS total FROM sim_losses WINDOW p AS (PARTITION BY port_name)))
          GROUP BY port_name, bin, lo, w, total""")
def _(r: Roles):
    return report.loss_histogram(r.sim_losses, PORT)


@query("loss_density", "port_name step:i x:6 density:12", "sim_losses",
       """SELECT port_name, step, x, list_sum(list_transform(losses, lambda v:
              exp(-power((x - v) / h, 2) / 2))) / (n * h * sqrt(2 * pi())) AS density FROM (
            SELECT port_name, n, sd * power(CAST(n AS DOUBLE), -0.2) AS h, losses, step,
              lo + (hi - lo) * step / 199.0 AS x FROM (SELECT port_name, min(loss) AS lo,
                max(loss) AS hi, count(*) AS n, stddev_samp(loss) AS sd, list(loss) AS losses,
                unnest(range(200)) AS step FROM sim_losses GROUP BY port_name) WHERE sd > 0)""")
def _(r: Roles):
    return report.loss_density(r.sim_losses, PORT)


@query("pair_correlation", "port_name corr_label:6 corr_sources:6", "model_days",
       """SELECT port_name, corr(swh_mean_b, y) AS corr_label, corr(swh_mean_a, swh_mean_b)
          AS corr_sources FROM model_days GROUP BY port_name""")
def _(r: Roles):
    return r.model_days.groupBy("port_name").agg(
        F.corr("swh_mean_b", "y").alias("corr_label"),
        F.corr("swh_mean_a", "swh_mean_b").alias("corr_sources"))


@query("describe_feature", "feature n:i mean:6 sd:6 min:6 p25:6 p50:6 p75:6 max:6", "base_long",
       """SELECT feature, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd,
          min(value) AS min, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50,
          quantile_cont(value, 0.75) AS p75, max(value) AS max FROM base_long GROUP BY feature""")
def _(r: Roles):
    return report.describe(r.base_long, ["feature"], "value")
