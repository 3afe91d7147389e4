"""Checked queries: windows, run lengths, ranks and folds; sort, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideledger.operators import aep, daily, features as feat, report, runs, search
from tideledger.plans.registry import query
from tideledger.plans.roles import PORT, Roles

SERIES = ["port_name", "feature"]
_BY = "PARTITION BY port_name, feature"
_ON = f"{_BY} ORDER BY date"


def _rows(w: int) -> str:
    return f"({_ON} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


@query("climatology_anomaly", "port_name feature date:d clima_value:6 anom_value:6", "base_long",
       f"""SELECT *, value - clima_value AS anom_value FROM (SELECT *, avg(value) OVER (
           {_BY}, strftime(date, '%m-%d')) AS clima_value FROM base_long)""")
def _(r: Roles):
    return daily.climatology_anomaly(r.base_long, SERIES, "value")


@query("reading_anomaly", "port_name date:d n:i max_anom:6 min_anom:6", "readings_b",
       """SELECT port_name, date, count(*) AS n, max(swh - c) AS max_anom, min(swh - c) AS min_anom
          FROM readings_b r JOIN (SELECT port_name, strftime(date, '%m-%d') AS md, avg(swh) AS c
            FROM readings_b GROUP BY ALL) USING (port_name) WHERE md = strftime(date, '%m-%d')
          GROUP BY port_name, date""")
def _(r: Roles):
    return daily.with_anomaly(r.readings_b, PORT, "swh").groupBy("port_name", "date").agg(
        F.count(F.lit(1)).alias("n"), F.max("anom_swh").alias("max_anom"),
        F.min("anom_swh").alias("min_anom"))


_DESEASON = f"""SELECT *, value - avg(value) OVER ({_BY}, dayofyear(date))
                + avg(value) OVER ({_BY}) AS deseasonalized FROM base_long"""


@query("deseasonalize", "port_name feature date:d deseasonalized:6", "base_long", _DESEASON)
def _(r: Roles):
    return feat.deseasonalize(r.base_long, SERIES)


@query("detrend_linear", "port_name feature date:d detrended:6", "base_long",
       f"""SELECT port_name, feature, date, deseasonalized - (regr_slope(deseasonalized, x) OVER w * x
             + regr_intercept(deseasonalized, x) OVER w) AS detrended
           FROM (SELECT *, CAST(row_number() OVER ({_ON}) - 1 AS DOUBLE) AS x FROM deseason)
           WINDOW w AS ({_BY})""", extra={"deseason": _DESEASON})
def _(r: Roles):
    return feat.detrend(feat.deseasonalize(r.base_long, SERIES), SERIES, value="deseasonalized")


@query("persistence_w", "port_name feature date:d " + " ".join(
    f"p{w}:6" for w in feat.PERSISTENCE_WINDOWS), "base_long",
       "SELECT *, " + ", ".join(f"avg(value) OVER {_rows(w)} AS p{w}"
                                for w in feat.PERSISTENCE_WINDOWS) + " FROM base_long")
def _(r: Roles):
    return r.base_long.withColumns({f"p{w}": feat.persistence(SERIES, "date", "value", w)
                                    for w in feat.PERSISTENCE_WINDOWS})


def _sql_min2(agg: str, w: int) -> str:
    return (f"CASE WHEN count(value) OVER {_rows(w)} >= 2 THEN {agg}(value) OVER {_rows(w)} END")


@query("rolling_mean_w", "port_name feature date:d " + " ".join(f"m{w}:6" for w in (3, 5, 7, 14)),
       "base_long", "SELECT *, " + ", ".join(f"{_sql_min2('avg', w)} AS m{w}"
                                             for w in (3, 5, 7, 14)) + " FROM base_long")
def _(r: Roles):
    return r.base_long.withColumns({f"m{w}": feat.rolling_mean(SERIES, "date", "value", w)
                                    for w in feat.TREND_WINDOWS})


_GAPPY = """SELECT port_name, 'swh_max' AS feature, date,
            CASE WHEN n_obs > 1 THEN swh_max END AS value FROM daily_a"""


def _gappy(r: Roles):
    return r.daily_a.select("port_name", F.lit("swh_max").alias("feature"), "date",
                            F.when(F.col("n_obs") > 1, F.col("swh_max")).alias("value"))


def _sql_trend(w: int) -> str:
    c = (w - 1) / 2
    spread = sum((k - c) ** 2 for k in range(w))
    return (f"CASE WHEN len(l{w}) = {w} AND list_count(l{w}) > 0 THEN "
            f"list_sum(list_transform(l{w}, lambda x, i: (i - 1 - {c}) * (x - list_avg(l{w})))) / {spread} END")


@query("trend_w", "port_name date:d " + " ".join(f"t{w}:6" for w in (3, 5, 7, 14)), "daily_a",
       "SELECT port_name, date, " + ", ".join(f"{_sql_trend(w)} AS t{w}" for w in (3, 5, 7, 14))
       + " FROM (SELECT *, " + ", ".join(f"list(value) OVER {_rows(w)} AS l{w}" for w in (3, 5, 7, 14))
       + " FROM gappy)", extra={"gappy": _GAPPY})
def _(r: Roles):
    return _gappy(r).withColumns({f"t{w}": feat.trend(SERIES, "date", "value", w)
                                  for w in feat.TREND_WINDOWS})


@query("rolling_std_w", "port_name feature date:d s3:6 s7:6", "base_long",
       f"SELECT *, {_sql_min2('stddev_samp', 3)} AS s3, {_sql_min2('stddev_samp', 7)} AS s7 FROM base_long")
def _(r: Roles):
    return r.base_long.withColumns({f"s{w}": feat.rolling_std(SERIES, "date", "value", w)
                                    for w in (3, 7)})


@query("abs_change_w", "port_name date:d " + " ".join(f"a{w}:6" for w in (3, 5, 7, 14)), "daily_a",
       "SELECT port_name, date, " + ", ".join(f"value - lag(value, {w}) OVER ({_ON}) AS a{w}"
                                              for w in (3, 5, 7, 14)) + " FROM gappy",
       extra={"gappy": _GAPPY})
def _(r: Roles):
    return _gappy(r).withColumns({f"a{w}": feat.abs_change(SERIES, "date", "value", w)
                                  for w in feat.CHANGE_WINDOWS})


_ZEROED = """SELECT port_name, 'swh_max' AS feature, date, CASE WHEN n_obs > 2 THEN 0.0
             WHEN n_obs > 1 THEN NULL ELSE swh_max END AS value FROM daily_a"""


@query("rel_change_w", "port_name date:d " + " ".join(f"r{w}:4" for w in feat.CHANGE_WINDOWS), "daily_a",
       "SELECT port_name, date, " + ", ".join(
           f"""CASE WHEN lag(value, {w}) OVER s = 0 THEN 0 ELSE (value - lag(value, {w}) OVER s)
               / nullif(lag(value, {w}) OVER s, 0) * 100 END AS r{w}""" for w in feat.CHANGE_WINDOWS)
       + f" FROM zeroed WINDOW s AS ({_ON})", extra={"zeroed": _ZEROED})
def _(r: Roles):
    value = F.when(F.col("n_obs") > 2, F.lit(0.0)).when(F.col("n_obs") == 1, F.col("swh_max"))
    rows = r.daily_a.select("port_name", F.lit("swh_max").alias("feature"), "date",
                            value.alias("value"))
    return rows.withColumns({f"r{w}": feat.rel_change(SERIES, "date", "value", w) for w in feat.CHANGE_WINDOWS})


@query("lag_k", "port_name feature date:d " + " ".join(f"lag_{k}:9" for k in feat.LAGS)
       + " p7_lag_3:6 m5_lag_5:6", "base_long",
       f"""SELECT *, {", ".join(f"lag(value, {k}) OVER s AS lag_{k}" for k in feat.LAGS)},
           lag(p7, 3) OVER s AS p7_lag_3, lag(m5, 5) OVER s AS m5_lag_5
           FROM (SELECT *, avg(value) OVER {_rows(7)} AS p7, {_sql_min2('avg', 5)} AS m5 FROM base_long)
           WINDOW s AS ({_ON})""")
def _(r: Roles):
    made = r.base_long.withColumns({"p7": feat.persistence(SERIES, "date", "value", 7),
                                    "m5": feat.rolling_mean(SERIES, "date", "value", 5)})
    lag = lambda c, k: feat.lagged(SERIES, "date", c, k)
    return made.withColumns({**{f"lag_{k}": lag("value", k) for k in feat.LAGS},
                             "p7_lag_3": lag("p7", 3), "m5_lag_5": lag("m5", 5)})


@query("engineered_features", "port_name feature n:i n_known:i total:4", "base_long",
       " UNION ALL ".join(
           f"""SELECT port_name, feature || '{name}' AS feature, count(*) AS n, count({expr}) AS n_known,
               coalesce(sum({expr}), 0) AS total FROM fan GROUP BY port_name, feature"""
           for name, expr in {"": "value", "_persistence_3": "p3", "_rolling_mean_3": "m3",
                              "_abs_change_3": "a3", "_lag_1": "l1", "_persistence_3_lag_1": "p3l",
                              "_rolling_mean_3_lag_1": "m3l", "_abs_change_3_lag_1": "a3l"}.items()),
       extra={"fan0": f"""SELECT *, avg(value) OVER {_rows(3)} AS p3, {_sql_min2('avg', 3)} AS m3,
                         value - lag(value, 3) OVER ({_ON}) AS a3 FROM base_long""",
              "fan": f"""SELECT *, lag(value) OVER s AS l1, lag(p3) OVER s AS p3l, lag(m3) OVER s AS m3l,
                         lag(a3) OVER s AS a3l FROM fan0 WINDOW s AS ({_ON})"""})
def _(r: Roles):
    fanned = feat.engineer(r.base_long, SERIES, persistence_windows=(3,), trend_windows=(3,),
                           change_windows=(3,), lags=(1,))
    long = feat.engineered_long(fanned, ["port_name", "date"], "feature", "value")
    return (long.where(~F.col("feature").rlike("trend|rel_change"))
            .groupBy("port_name", "feature")
            .agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_known"),
                 F.coalesce(F.sum("value"), F.lit(0.0)).alias("total")))


@query("anomaly_in_sim", "port_name sim:i base_anomaly:6 sim_anomaly:6", "sim_days",
       """SELECT port_name, sim, sum(anom) AS base_anomaly, 0.0 AS sim_anomaly FROM (
            SELECT s.port_name, sim, swh_mean_b - avg_b AS anom FROM sim_days s JOIN (
              SELECT port_name, date, avg(swh_mean_b) OVER (PARTITION BY port_name,
                strftime(date, '%m-%d')) AS avg_b FROM model_days) c
            ON c.port_name = s.port_name AND c.date = s.date) GROUP BY port_name, sim""")
def _(r: Roles):
    base = daily.climatology_anomaly(r.model_days, PORT, "swh_mean_b")
    days = aep.simulate(base, PORT, ["swh_mean_b", "anom_swh_mean_b"], 200)
    own = Window.partitionBy("port_name", "sim", "day")
    return (days.withColumn("own", F.col("swh_mean_b") - F.avg("swh_mean_b").over(own))
            .groupBy("port_name", "sim").agg(F.sum("anom_swh_mean_b").alias("base_anomaly"),
                                             F.max(F.abs("own")).alias("sim_anomaly")))


# ---- run lengths ---------------------------------------------------------------------------

_HOURLY_RUNS = """SELECT port_name, g, min(ts) AS s, max(ts) AS e, count(*) AS len FROM (
    SELECT *, row_number() OVER (PARTITION BY port_name ORDER BY ts)
      - row_number() OVER (PARTITION BY port_name, up ORDER BY ts) AS g
    FROM (SELECT *, CASE WHEN swh > 20 THEN 1 ELSE 0 END AS up FROM hours))
    WHERE up = 1 GROUP BY port_name, g"""


@query("run_lengths", "port_name run_start:d run_end:d run_days:i", "labelled",
       """SELECT port_name, min(date) AS run_start, max(date) AS run_end, count(*) AS run_days FROM (
            SELECT *, row_number() OVER (PARTITION BY port_name ORDER BY date)
              - row_number() OVER (PARTITION BY port_name, y ORDER BY date) AS g FROM labelled)
          WHERE y = 1 GROUP BY port_name, g""")
def _(r: Roles):
    return runs.run_lengths(r.labelled, PORT, "date", "y")


@query("run_lengths_chunked", "port_name run_start run_end run_days:i", "hours",
       f"""SELECT port_name, strftime(s, '%Y-%m-%d %H:%M:%S') AS run_start,
           strftime(e, '%Y-%m-%d %H:%M:%S') AS run_end, len AS run_days FROM ({_HOURLY_RUNS})""")
def _(r: Roles):
    flagged = r.events.withColumns({"up": (F.col("swh") > 20).cast("int"),
                                    "hour": F.date_trunc("hour", "ts")})
    found = runs.run_lengths_chunked(flagged, PORT, "ts", "up", "hour")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return found.withColumns({"run_start": stamp("run_start"), "run_end": stamp("run_end")})


@query("max_consecutive_above", "port_name date:d max_consecutive_above:i", "hours",
       """SELECT port_name, date, max(CASE WHEN up = 1 THEN len ELSE 0 END) AS max_consecutive_above
          FROM (SELECT port_name, date, up, g, count(*) AS len FROM (
            SELECT *, row_number() OVER (PARTITION BY port_name, date ORDER BY ts)
              - row_number() OVER (PARTITION BY port_name, date, up ORDER BY ts) AS g
            FROM (SELECT *, CASE WHEN swh > 20 THEN 1 ELSE 0 END AS up FROM hours)) GROUP BY ALL)
          GROUP BY port_name, date""")
def _(r: Roles):
    return runs.max_consecutive_above(r.events.withColumn("hour", F.date_trunc("hour", "ts")),
                                      ["port_name", "date"], "ts", "swh", F.lit(20.0), "hour")


_LEN = """SELECT *, CASE WHEN pred = 1 THEN count(*) OVER (PARTITION BY port_name, pred, g) ELSE 0 END
          AS len FROM (SELECT *, row_number() OVER (PARTITION BY port_name ORDER BY date)
            - row_number() OVER (PARTITION BY port_name, pred ORDER BY date) AS g FROM fired)"""


@query("temporal_smoothing", "port_name date:d smoothed:i soft:i", "fired",
       """SELECT port_name, date, CASE WHEN len >= 2 THEN 1 ELSE 0 END AS smoothed,
          CASE WHEN avg(pred) OVER (PARTITION BY port_name ORDER BY date ROWS BETWEEN 2 PRECEDING
            AND CURRENT ROW) > 0.5 THEN 1 ELSE 0 END AS soft FROM lens""", extra={"lens": _LEN})
def _(r: Roles):
    hard = runs.keep_long_runs(r.fired, PORT, "date", "pred", 2)
    return runs.rolling_majority(hard, PORT, "date", "pred", 3, "soft")


@query("event_run_features", "port_name date:d event_duration:i " + " ".join(
    f"event_dummy_{k}:i event_count_{k}:i" for k in range(2, 8)), "fired",
       "SELECT port_name, date, len AS event_duration, " + ", ".join(
           f"""CASE WHEN len >= {k} THEN 1 ELSE 0 END AS event_dummy_{k},
               CASE WHEN len >= {k} AND lag(len) OVER w < {k} THEN 1 ELSE 0 END AS event_count_{k}"""
           for k in range(2, 8))
       + " FROM lens WINDOW w AS (PARTITION BY port_name ORDER BY date)", extra={"lens": _LEN})
def _(r: Roles):
    return runs.run_day_features(r.fired, PORT, "date", "pred")


@query("event_count", "port_name component n_events:i mean_events:6", "components",
       """SELECT port_name, component, sum(n_events) AS n_events, avg(n_events) AS mean_events
          FROM components GROUP BY port_name, component""")
def _(r: Roles):
    return r.components.groupBy("port_name", "component").agg(
        F.sum("n_events").alias("n_events"), F.avg("n_events").alias("mean_events"))


# ---- ranks and folds -----------------------------------------------------------------------

@query("exceedance_rank", "port_name sim:i loss:4 rank:i probability:6", "curves",
       "SELECT * FROM curves")
def _(r: Roles):
    return r.curves


@query("exceedance_ecdf", "port_name sim:i loss:4 exceedance:6 return_period:6", "sim_losses",
       """SELECT port_name, sim, loss, (n - i) / CAST(n AS DOUBLE) AS exceedance,
          1 / nullif((n - i) / CAST(n AS DOUBLE), 0) AS return_period FROM (SELECT *,
            row_number() OVER (PARTITION BY port_name ORDER BY loss, sim) AS i,
            count(*) OVER (PARTITION BY port_name) AS n FROM sim_losses)""")
def _(r: Roles):
    return aep.exceedance_ecdf(r.sim_losses, PORT)


@query("loss_at_probability", "port_name loss:4", "curves",
       """SELECT port_name, min(loss) FILTER (WHERE probability <= 0.01) AS loss FROM curves
          GROUP BY port_name""")
def _(r: Roles):
    return aep.loss_at_probability(r.curves, PORT, 0.01)


@query("smooth_quantile_curve", "port_name step:i probability:6 loss:6", "sim_losses",
       f"""SELECT port_name, step, 1 - step / 99.0 AS probability, qs[step + 1] AS loss FROM (
             SELECT port_name, quantile_cont(loss, {[i / 99 for i in range(100)]}) AS qs,
               unnest(range(100)) AS step FROM sim_losses GROUP BY port_name)""")
def _(r: Roles):
    return aep.quantile_curve(r.sim_losses, PORT, 100)


@query("time_series_folds", "port_name date:d test_fold:i", "folded", "SELECT * FROM folded")
def _(r: Roles):
    return r.folded


@query("stratified_folds", "port_name date:d y:i test_fold:i", "labelled",
       """SELECT port_name, date, y, ntile(5) OVER (PARTITION BY port_name, y ORDER BY CAST('0x' ||
            substr(md5('42|' || port_name || '|' || CAST(date AS VARCHAR)), 1, 8) AS BIGINT), date) - 1
            AS test_fold FROM labelled""")
def _(r: Roles):
    return search.stratified_folds(r.labelled, PORT, "y", 5)


# ---- sort, top-k, set operations -----------------------------------------------------------

@query("topk_per_group", "port_name date:d net_mean:9 place:i", "daily_b",
       """SELECT *, row_number() OVER (PARTITION BY port_name ORDER BY net_mean DESC, date) AS place
          FROM daily_b QUALIFY place <= 10""")
def _(r: Roles):
    return report.topk_per_group(r.daily_b, PORT, [F.desc("net_mean"), F.asc("date")], 10)


@query("best_rule", "port_name feature f1_mean:6 n_folds:i threshold_mean:6 threshold_median:6 "
       "threshold_p75:6", "best_t",
       """SELECT port_name, feature, f1_mean, count(*) AS n_folds, avg(threshold) AS threshold_mean,
            median(threshold) AS threshold_median, quantile_cont(threshold, 0.75) AS threshold_p75
          FROM best_t JOIN (SELECT port_name, feature, avg(f1) AS f1_mean FROM best_t
            GROUP BY port_name, feature QUALIFY row_number() OVER (PARTITION BY port_name ORDER BY
              round(avg(f1), 9) DESC, round(avg(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0)), 9)
              DESC, round(avg(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0)), 9) DESC, feature) = 1)
          USING (port_name, feature) GROUP BY port_name, feature, f1_mean""")
def _(r: Roles):
    from tideledger.functions.scalars import with_metrics
    folds = with_metrics(r.best_thresholds).withColumns({
        "rule_id": F.concat(F.lit("single|"), "feature"), "rule_type": F.lit("single")})
    cv = search.cv_summary(folds, ["port_name", "rule_id", "rule_type"])
    cv = report.round_columns(cv, {c: 9 for c in ("f1_mean", "precision_mean", "recall_mean")})
    return search.best_rule(cv, r.best_thresholds, PORT)


@query("topk_global", "port_name feature fold:i f1:9", "best_t",
       """SELECT port_name, feature, fold, f1 FROM best_t ORDER BY f1 DESC, port_name, feature, fold
          LIMIT 10""")
def _(r: Roles):
    return report.topk_global(r.best_thresholds,
                              [F.desc("f1"), F.asc("port_name"), F.asc("feature"), F.asc("fold")], 10)


@query("best_per_group", "port_name fold:i winner best_score:9", "best_t",
       """SELECT port_name, fold, feature AS winner, f1 AS best_score FROM best_t
          QUALIFY row_number() OVER (PARTITION BY port_name, fold ORDER BY f1 DESC, feature) = 1""")
def _(r: Roles):
    return report.best_per_group(r.best_thresholds, ["port_name", "fold"], "feature", "f1")


@query("union_all", "source n:i swh_max:6", "daily_a daily_b",
       """SELECT source, count(*) AS n, max(swh_max) AS swh_max FROM (SELECT 'a' AS source, swh_max
          FROM daily_a UNION ALL SELECT 'b', swh_max FROM daily_b) GROUP BY source""")
def _(r: Roles):
    both = r.daily_a.select(F.lit("a").alias("source"), "swh_max").unionByName(
        r.daily_b.select(F.lit("b").alias("source"), "swh_max"))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"),
                                      F.max("swh_max").alias("swh_max"))


@query("intersect_years", "year:i", "readings_a readings_b",
       "SELECT DISTINCT year(date) AS year FROM readings_a INTERSECT SELECT DISTINCT year(date) FROM readings_b")
def _(r: Roles):
    years = lambda df: df.select(F.year("date").alias("year")).distinct()
    return years(r.readings_a).intersect(years(r.readings_b))


@query("except_features", "port_name feature", "long base_long",
       """SELECT port_name, feature FROM long EXCEPT SELECT port_name, feature || '_b' FROM base_long""")
def _(r: Roles):
    have = r.long.select("port_name", "feature").distinct()
    drop = r.base_long.select("port_name", F.concat("feature", F.lit("_b")).alias("feature"))
    return have.join(drop.distinct(), ["port_name", "feature"], "left_anti")


@query("distinct_values", "port_name year:i", "daily_b",
       "SELECT DISTINCT port_name, year(date) AS year FROM daily_b")
def _(r: Roles):
    return r.daily_b.select("port_name", F.year("date").alias("year")).distinct()
