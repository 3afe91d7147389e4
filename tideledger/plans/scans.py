"""Checked queries: scans, sinks and scalar columns."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideledger.functions import scalars as S
from tideledger.operators import daily, exposure, features as feat, report, rules
from tideledger.plans.registry import query
from tideledger.plans.roles import PORT, Roles
from tideledger.session import shared_folder as scratch
from tideledger.sources import scan, sinks

# ---- scans and sinks -------------------------------------------------------------------------

@query("scan_series_csv", "date:d n:i swh_max:6 swh_min:6", "hours",
       "SELECT date, count(*) AS n, max(swh) AS swh_max, min(swh) AS swh_min FROM hours GROUP BY date")
def _(r: Roles):
    path = scratch(r.spark, "series")
    (r.events.select(F.col("ts").cast("string").alias("time"),
                     F.col("swh").alias("sea_wave_height"))
     .write.option("header", True).csv(path))
    return scan.scan_series_csv(r.spark, path).groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), F.max("swh").alias("swh_max"), F.min("swh").alias("swh_min"))


@query("scan_yearly_series", "port_name year:i n:i swh_max:6", "readings_a",
       """SELECT port_name, year(date) AS year, count(*) AS n, max(swh) AS swh_max FROM readings_a
          WHERE year(date) BETWEEN 1996 AND 1999 GROUP BY ALL""")
def _(r: Roles):
    path = scratch(r.spark, "yearly")
    none = F.lit(None).cast("double")
    (r.readings_a.select("port_name", F.col("ts").cast("timestamp").alias("datetime"), "swh",
                         F.lit(0.0).alias("swell_height"), none.alias("latitude"),
                         none.alias("longitude"), none.alias("nearest_latitude"),
                         none.alias("nearest_longitude"), F.year("date").alias("series"))
     .write.partitionBy("series").option("header", True).csv(path))
    rows = scan.scan_yearly_series(r.spark, path, 1996, 1999, pattern=r"/series=(\d{4})/")
    return rows.groupBy("port_name", "year").agg(F.count(F.lit(1)).alias("n"),
                                                 F.max("swh").alias("swh_max"))


@query("scan_closures", "port_name capitania date:d year:i duracion:6", "closures",
       """SELECT CASE WHEN contains(port_name, 'MEDIUM') THEN 'PORT_MEDIUM' ELSE port_name END
          AS port_name, CASE WHEN contains(port_name, 'MEDIUM') THEN 'PORT_MEDIUM'
          ELSE 'C' || substr(port_name, 1, 1) END AS capitania, date, year, duracion FROM closures""")
def _(r: Roles):
    path = scratch(r.spark, "closures")
    (r.closures.select("port_name", F.concat(F.lit("C"), F.substring("port_name", 1, 1))
                       .alias("capitania"), F.col("date").cast("string").alias("date"), "year",
                       F.col("duracion").cast("string").alias("duracion"), "event_dummy_1")
     .write.option("header", True).csv(path))
    return scan.scan_closures(r.spark, path, "MEDIUM", "PORT_MEDIUM")


@query("scan_wages", "caleta port_name w_p50:6 fishermen_province:6", "wages", "SELECT * FROM wages")
def _(r: Roles):
    path = scratch(r.spark, "wages")
    r.wages.drop("n_regionkey").write.parquet(path)
    return scan.scan_wages(r.spark, path)


def _artifacts(r: Roles) -> str:
    """Day tables of each port by year, an artefact a month; odd months have fewer columns, even ones another order."""
    path = scratch(r.spark, "artifacts")
    days = r.daily_a.select(
        F.col("port_name").alias("run"), "date", "swh_max", "n_obs", F.month("date").alias("month"), F.concat(
            F.lit("daily_"), F.year("date"), F.lit("_"), F.date_format("date", "yyyyMM"), F.lit("01_120000")).alias("artifact"))
    for odd, columns in ((1, ["date", "swh_max"]), (0, ["n_obs", "date", "swh_max"])):
        (days.where(F.col("month") % 2 == odd).select("run", "artifact", *columns).repartition("run", "artifact")
         .write.mode("append").partitionBy("run", "artifact").option("header", True).csv(path))
    return path


_ARTIFACT = T.StructType([T.StructField("date", T.DateType()), T.StructField("n_obs", T.LongType()),
                          T.StructField("swh_max", T.DoubleType())])
_ARTIFACT_SQL = """SELECT port_name AS run, 'daily_' || year(date) AS family, strftime(date, '%Y%m') || '01_120000' AS stamp,
    date, CASE WHEN month(date) % 2 = 0 THEN n_obs END AS n_obs, swh_max FROM daily_a"""


@query("scan_latest_artifact", "run family stamp date:d n_obs:i swh_max:6", "daily_a",
       f"""SELECT * FROM ({_ARTIFACT_SQL}) QUALIFY stamp = max(stamp) OVER (PARTITION BY run, family)""")
def _(r: Roles):
    return scan.scan_latest(r.spark, _artifacts(r), _ARTIFACT)


@query("concat_artifact_files", "run family stamp date:d n_obs:i swh_max:6", "daily_a", _ARTIFACT_SQL)
def _(r: Roles):
    listing = scan.artifact_listing(r.spark, _artifacts(r))
    rows = scan.read_artifacts(r.spark, listing)  # names as found, all text
    return scan.with_stamp(rows)


@query("concat_artifacts", "run port_name date:d swh_max:6 net_mean:6", "daily_a daily_b",
       """SELECT 'a' AS run, port_name, date, swh_max, NULL AS net_mean FROM daily_a UNION ALL
          SELECT 'b', port_name, date, swh_max, net_mean FROM daily_b""")
def _(r: Roles):
    return scan.concat_artifacts({"a": r.daily_a, "b": r.daily_b})


def _stored(r: Roles, fmt: str):
    path = scratch(r.spark, fmt)
    df = r.daily_a.withColumnRenamed("port_name", "run")
    sinks.write_table(df, path, fmt)
    back = r.spark.read.schema(df.schema).option("header", True).format(fmt).load(path)
    return back.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.max("swh_max").alias("swh_max"),
                                   F.sum("n_obs").alias("n_obs"))


_STORED_SQL = """SELECT port_name AS run, count(*) AS n, max(swh_max) AS swh_max,
                 sum(n_obs) AS n_obs FROM daily_a GROUP BY port_name"""


@query("sink_tables", "run n:i swh_max:6 n_obs:i", "daily_a", _STORED_SQL)
def _(r: Roles):
    return _stored(r, "csv")


@query("sink_parquet", "run n:i swh_max:6 n_obs:i", "daily_a", _STORED_SQL)
def _(r: Roles):
    return _stored(r, "parquet")


@query("sink_excel_tables", "port_name metric value:6", "daily_a",
       """SELECT port_name, 'n_obs' AS metric, CAST(sum(n_obs) AS DOUBLE) AS value FROM daily_a
          GROUP BY port_name UNION ALL SELECT port_name, 'swh_max', max(swh_max) FROM daily_a
          GROUP BY port_name""")
def _(r: Roles):
    table = r.daily_a.groupBy("port_name").agg(
        F.sum("n_obs").cast("double").alias("n_obs"), F.max("swh_max").alias("swh_max"))
    path = scratch(r.spark, "comparison")
    sinks.write_table(table.unpivot(["port_name"], ["n_obs", "swh_max"], "metric", "value"), path,
                      "csv", by=())
    return r.spark.read.schema("port_name string, metric string, value double").csv(
        path, header=True)


@query("sink_run_summary", "run n_rows:i first_date last_date n_columns:i settings", "daily_a",
       """SELECT port_name AS run, count(*) AS n_rows, CAST(min(date) AS VARCHAR) AS first_date,
          CAST(max(date) AS VARCHAR) AS last_date, 7 AS n_columns,
          '{"min_days": 1, "n_simulations": 4000}' AS settings FROM daily_a GROUP BY port_name""")
def _(r: Roles):
    path = scratch(r.spark, "summary")
    sinks.write_run_summary(r.daily_a.withColumnRenamed("port_name", "run").withColumn(
        "total_obs", F.col("n_obs")), {"n_simulations": 4000, "min_days": 1}, path)
    return r.spark.read.schema("run string, n_rows bigint, first_date string, last_date string, "
                               "n_columns int, settings string").json(path)


@query("scalar_threshold_io", "port_name date:d threshold:6 fired:i", "daily_a",
       """SELECT port_name, date, coalesce(t, 0.5) AS threshold,
          CASE WHEN swh_mean / 16 > coalesce(t, 0.5) THEN 1 ELSE 0 END AS fired FROM daily_a
          LEFT JOIN (SELECT port_name, quantile_cont(swh_mean, 0.8) / 16 AS t FROM daily_a
                     WHERE port_name <> '5-LOW' GROUP BY port_name) USING (port_name)""")
def _(r: Roles):
    path = scratch(r.spark, "threshold")
    (r.daily_a.where(F.col("port_name") != "5-LOW").groupBy("port_name")
     .agg((F.percentile("swh_mean", F.lit(0.8)) / 16).alias("threshold"))
     .write.parquet(path))
    stored = r.spark.read.parquet(path)
    return (sinks.with_model_threshold(r.daily_a, stored, PORT)
            .withColumn("fired", (F.col("swh_mean") / 16 > F.col("threshold")).cast("int")))


@query("feature_cache", "feature score:6", "base_long",
       "SELECT feature, max(value) AS score FROM base_long GROUP BY feature")
def _(r: Roles):
    path = scratch(r.spark, "selected")
    def make():
        return r.base_long.groupBy("feature").agg(F.max("value").alias("score"))
    sinks.cached_features(r.spark, path, make)
    return sinks.cached_features(r.spark, path, make)


@query("economic_fallback", "port_name n_workers:6 daily_wage:6 daily_loss:6", "run_ports params",
       """SELECT DISTINCT rp.port_name, coalesce(p.n_workers, m.n_workers) AS n_workers,
            coalesce(p.daily_wage, m.daily_wage) AS daily_wage,
            coalesce(p.daily_loss, m.daily_loss) AS daily_loss
          FROM run_ports rp LEFT JOIN params p USING (port_name)
          CROSS JOIN (SELECT median(n_workers) AS n_workers, median(daily_wage) AS daily_wage,
                      median(daily_loss) AS daily_loss FROM params) m""")
def _(r: Roles):
    params = exposure.wage_params(r.wages)
    medians = exposure.wage_medians(params)
    return exposure.with_default_economics(r.run_ports.select("port_name").distinct(), params,
                                           medians)


# ---- scalar columns --------------------------------------------------------------------------

@query("normalize_port_contains", "port_name n:i", "",
       """SELECT CASE WHEN contains(o_orderpriority, 'MEDIUM') THEN 'PORT_MEDIUM'
          ELSE o_orderpriority END AS port_name, count(*) AS n FROM orders GROUP BY 1""")
def _(r: Roles):
    return (r.table("orders")
            .select(S.contains_to(F.col("o_orderpriority"), "MEDIUM", "PORT_MEDIUM")
                    .alias("port_name")).groupBy("port_name").agg(F.count(F.lit(1)).alias("n")))


_REPAIRS = [("NATION_1", "CALETA_NATION_1"), ("CALETA_NATION_1_(X)", "X"), ("NATION_2", "DPA_(2)"),
            ("DPA_(2)", "DPA_TWO")]


@query("normalize_port_chain", "n_name port_name", "",
       """SELECT n_name, replace(replace(replace(replace(upper(replace(n_name, ' ', '_')),
          'NATION_1', 'CALETA_NATION_1'), 'CALETA_NATION_1_(X)', 'X'), 'NATION_2', 'DPA_(2)'),
          'DPA_(2)', 'DPA_TWO') AS port_name FROM nation WHERE upper(n_name) <> 'NATION_7'""")
def _(r: Roles):
    name = S.canonical_port(F.col("n_name"))
    return (r.table("nation").where(name != "NATION_7")
            .select("n_name", S.canonical_port(F.col("n_name"), _REPAIRS).alias("port_name")))


@query("list_item_count", "caleta n_ports:i n_workers:6", "wages",
       """SELECT caleta, len(string_split(port_name, ',')) AS n_ports,
          round_even(fishermen_province / len(string_split(port_name, ',')), 0) AS n_workers
          FROM wages""")
def _(r: Roles):
    n = S.list_item_count(F.col("port_name"))
    return r.wages.select("caleta", n.alias("n_ports"),
                          S.half_even(F.col("fishermen_province") / n).alias("n_workers"))


@query("rename_suffix", "port_name date:d swh_mean_sw:6 swh_max_sw:6", "daily_a",
       "SELECT port_name, date, swh_mean AS swh_mean_sw, swh_max AS swh_max_sw FROM daily_a")
def _(r: Roles):
    return feat.suffix_columns(r.daily_a.drop("n_obs", "swh_min"), "_sw", ["port_name", "date"])


@query("drop_cols", "port_name date:d swh_max:6", "daily_a",
       "SELECT port_name, date, swh_max FROM daily_a")
def _(r: Roles):
    return r.daily_a.drop("swh_mean", "swh_min", "n_obs")


@query("date_parts", "date:d year:i daymon monday day_of_year:i n:i", "readings_a",
       """SELECT date, year(date) AS year, strftime(date, '%d-%m') AS daymon,
          strftime(date, '%m-%d') AS monday, dayofyear(date) AS day_of_year, count(*) AS n
          FROM readings_a GROUP BY date""")
def _(r: Roles):
    parts = ["date", "year", "daymon", "monday", "day_of_year"]
    return daily.date_parts(r.readings_a, "ts").groupBy(*parts).agg(F.count(F.lit(1)).alias("n"))


@query("coerce_numeric", "k:i n:i nulls:i total:2", "",
       """SELECT k, count(*) AS n, count(*) - count(v) AS nulls, coalesce(sum(v), 0) AS total
          FROM (SELECT length(o_orderstatus) + o_custkey % 10 AS k,
                TRY_CAST(CASE WHEN o_orderstatus = 'F' THEN 'n/a'
                         ELSE CAST(o_custkey AS VARCHAR) END AS DOUBLE) AS v FROM orders)
          GROUP BY k""")
def _(r: Roles):
    text = F.when(F.col("o_orderstatus") == "F", F.lit("n/a")).otherwise(
        F.col("o_custkey").cast("string"))
    return (r.table("orders").select((F.length("o_orderstatus") + F.col("o_custkey") % 10)
                                     .alias("k"), text.try_cast("double").alias("v"))
            .groupBy("k").agg(F.count(F.lit(1)).alias("n"),
                              F.count_if(F.col("v").isNull()).alias("nulls"),
                              F.coalesce(F.sum("v"), F.lit(0.0)).alias("total")))


@query("filter_rows", "port_name year:i n:i swh_max:6", "readings_a",
       """SELECT port_name, year(date) AS year, count(*) AS n, max(swh) AS swh_max FROM readings_a
          WHERE port_name = '2-HIGH' AND date >= DATE '1998-01-01' AND date < DATE '2001-01-01'
          AND swh IS NOT NULL GROUP BY ALL""")
def _(r: Roles):
    day = F.col("ts")
    return (r.readings_a.where((F.col("port_name") == "2-HIGH") & F.col("swh").isNotNull()
                               & (day >= F.lit("1998-01-01").cast("timestamp_ntz"))
                               & (day < F.lit("2001-01-01").cast("timestamp_ntz")))
            .groupBy("port_name", F.year("date").alias("year"))
            .agg(F.count(F.lit(1)).alias("n"), F.max("swh").alias("swh_max")))


@query("derived_ratios", "port_name date:d swh_range:6 swh_cv:6 duration_intensity:6", "daily_a",
       """SELECT port_name, date, swh_max - swh_min AS swh_range,
          (swh_max - swh_min) / nullif(swh_mean, 0) AS swh_cv, n_obs * swh_mean AS duration_intensity
          FROM daily_a""")
def _(r: Roles):
    made = daily.derived_ratios(F.col("n_obs"))
    return r.daily_a.withColumns({
        "swh_range": made["swh_range"], "duration_intensity": made["duration_intensity"],
        "swh_cv": S.ratio(F.col("swh_max") - F.col("swh_min"), F.col("swh_mean"))})


@query("fill_nulls", "port_name date:d zero:6 mean:6 bridged:6", "daily_a",
       """SELECT port_name, date, coalesce(v, 0) AS zero,
            coalesce(v, avg(v) OVER (PARTITION BY port_name)) AS mean,
            coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY port_name ORDER BY date
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                     first_value(v IGNORE NULLS) OVER (PARTITION BY port_name ORDER BY date
                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS bridged
          FROM (SELECT *, CASE WHEN n_obs > 1 THEN swh_max END AS v FROM daily_a)""")
def _(r: Roles):
    gappy = r.daily_a.withColumn("v", F.when(F.col("n_obs") > 1, F.col("swh_max")))
    filled = feat.fill_forward_back(feat.fill_mean(gappy, PORT, "v", "mean"), PORT, "date", "v",
                                    "bridged")
    return filled.withColumn("zero", F.coalesce("v", F.lit(0.0)))


@query("safe_metric", "port_name date:d change:6 share:6", "daily_a",
       """SELECT port_name, date, swh_max / nullif(n_obs - 1, 0) AS change,
          coalesce((n_obs - 1) / nullif(CAST(n_obs - 1 AS DOUBLE), 0), 0) AS share FROM daily_a""")
def _(r: Roles):
    spare = F.col("n_obs") - 1
    return r.daily_a.withColumns({
        "change": S.finite_or_null(S.ratio(F.col("swh_max"), spare)),
        "share": S.ratio(spare, spare, 0.0)})


@query("round_cols", "port_name date:d swh_mean:6 swh_max:6", "daily_a",
       "SELECT port_name, date, round(swh_mean, 3) AS swh_mean, round(swh_max, 1) AS swh_max FROM daily_a")
def _(r: Roles):
    return report.round_columns(r.daily_a, {"swh_mean": 3, "swh_max": 1})


@query("parse_list_text", "port_name date:d n:i total:6 first:6", "daily_a",
       "SELECT port_name, date, 3 AS n, swh_mean + swh_max + swh_min AS total, swh_mean AS first FROM daily_a")
def _(r: Roles):
    text = F.concat(F.lit("[np.float64("), "swh_mean", F.lit("), "), "swh_max",
                    F.lit(", np.float64("), "swh_min", F.lit(")]"))
    parsed = r.daily_a.withColumn("v", S.parse_number_list(text))
    return parsed.select("port_name", "date", F.size("v").alias("n"), F.get("v", F.lit(0)).alias("first"),
                         (F.get("v", F.lit(0)) + F.get("v", F.lit(1)) + F.get("v", F.lit(2)))
                         .alias("total"))


@query("parse_rule_text", "port_name month:i n_conditions:i features operators logic", "daily_a",
       """SELECT DISTINCT port_name, month(date) AS month, 3 AS n_conditions,
          'swh_max_' || month(date) || ',swh_min,n_obs' AS features, '>,<=,>=' AS operators,
          CASE WHEN month(date) > 6 THEN 'AND,OR' ELSE 'OR,AND' END AS logic FROM daily_a""")
def _(r: Roles):
    late = F.month("date") > 6
    text = F.concat(F.lit("swh_max_"), F.month("date"), F.lit(" > t1 "),
                    F.when(late, "AND").otherwise("OR"), F.lit(" swh_min <= t2 "),
                    F.when(late, "OR").otherwise("AND"), F.lit(" n_obs >= t3"))
    parts = S.rule_parts(text)
    return (r.daily_a.select("port_name", F.month("date").alias("month"),
                             *[c.alias(k) for k, c in parts.items()])
            .select("port_name", "month", F.size("features").alias("n_conditions"),
                    *[F.array_join(k, ",").alias(k) for k in parts]).distinct())


@query("rule_feature_name", "feature n:i", "base_long",
       "SELECT feature, count(*) AS n FROM base_long GROUP BY feature")
def _(r: Roles):
    name = F.concat(F.lit("Single: "), "feature", F.lit(" > threshold"))
    return (r.base_long.select(S.rule_feature_name(name).alias("feature"))
            .groupBy("feature").agg(F.count(F.lit(1)).alias("n")))


@query("rule_id", "identity n:i", "base_long",
       """SELECT identity, count(*) AS n FROM (
            SELECT CASE WHEN year(date) < 1998 THEN 'single|' || feature || '|' || year(date)
              ELSE 'multi|' || feature || '+swh_max|>+>|AND' END AS identity FROM base_long)
          GROUP BY identity""")
def _(r: Roles):
    early = F.year("date") < 1998
    kind = F.when(early, "single").otherwise("multi")
    feats = F.when(early, F.array("feature")).otherwise(F.array("feature", F.lit("swh_max")))
    ident = S.rule_identity(kind, feats, F.array(F.lit(">"), F.lit(">")), F.array(F.lit("AND")),
                            F.year("date"))
    return (r.base_long.select(ident.alias("identity"))
            .groupBy("identity").agg(F.count(F.lit(1)).alias("n")))


_SCORES = """SELECT port_name, feature, score, row_number() OVER (PARTITION BY port_name
             ORDER BY score DESC, feature) - 1 AS pos FROM (SELECT port_name, feature,
             max(value) AS score FROM long GROUP BY ALL)"""


@query("feature_pattern_select", "port_name feature matches:i pick:i", "long",
       """SELECT * FROM (SELECT port_name, feature,
            CASE WHEN regexp_matches(feature, '_lag_|_persistence_') THEN 1 ELSE 0 END AS matches,
            row_number() OVER (PARTITION BY port_name ORDER BY CASE WHEN
              regexp_matches(feature, '_lag_|_persistence_') THEN 0 ELSE 1 END, pos) AS pick
          FROM scores) WHERE pick <= 5""", extra={"scores": _SCORES})
def _(r: Roles):
    ranked = rules.top_features(r.long.groupBy("port_name", "feature")
                                .agg(F.max("value").alias("score")), PORT, "score")
    return feat.select_by_pattern(ranked, PORT, "_lag_|_persistence_", 5, "pos")


@query("feature_lineage", "feature base transform window:i lag:i is_derived:i category n:i", "base_long",
       """SELECT feature || suffix AS feature, feature AS base, transform, w AS "window", l AS "lag",
            CASE WHEN suffix = '' THEN 0 ELSE 1 END AS is_derived, 'wave' AS category, n
          FROM (SELECT feature, count(*) AS n FROM base_long GROUP BY feature)
          CROSS JOIN (VALUES ('', 'none', 0, 0), ('_persistence_7', 'persistence', 7, 0),
            ('_trend_3_lag_5', 'trend', 3, 5), ('_lag_14', 'none', 0, 14),
            ('_deseasonalized_detrended', 'deseasonalized_detrended', 0, 0),
            ('_rel_change_5', 'rel_change', 5, 0)) v(suffix, transform, w, l)""")
def _(r: Roles):
    suffixes = ["", "_persistence_7", "_trend_3_lag_5", "_lag_14", "_deseasonalized_detrended",
                "_rel_change_5"]
    counts = r.base_long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    names = counts.select(F.explode(F.array(*[F.concat("feature", F.lit(s)) for s in suffixes]))
                          .alias("feature"))
    catalog = feat.feature_catalog(names)
    resolved = feat.base_or_fallback(catalog, counts, "swh_max").drop("base")
    return (resolved.withColumnRenamed("resolved_base", "base")
            .join(counts.withColumnRenamed("feature", "base"), "base"))


@query("threshold_percentile", "port_name threshold:6 pct:6", "model_days trig",
       """SELECT port_name, max(threshold) AS threshold,
          avg(CASE WHEN swh_mean_b <= threshold THEN 1 ELSE 0 END) * 100 AS pct
          FROM model_days JOIN trig USING (port_name) GROUP BY port_name""")
def _(r: Roles):
    return (r.model_days.join(r.trigger_thresholds(), "port_name").groupBy("port_name")
            .agg(F.max("threshold").alias("threshold"),
                 (F.avg((F.col("swh_mean_b") <= F.col("threshold")).cast("int")) * 100).alias("pct")))


@query("loss_tier", "port_name year:i observed_loss:2 tier", "obs_yearly",
       """SELECT port_name, year, observed_loss, CASE
            WHEN observed_loss > quantile_cont(observed_loss, 0.75) OVER w THEN 'High'
            WHEN observed_loss > quantile_cont(observed_loss, 0.25) OVER w THEN 'Medium'
            ELSE 'Low' END AS tier FROM obs_yearly WINDOW w AS (PARTITION BY port_name)""")
def _(r: Roles):
    yearly = exposure.yearly_observed_loss(r.labelled, PORT, r.exposure, "y")
    return exposure.loss_tier(yearly, PORT, "observed_loss")


@query("run_number", "run number:i prefix n:i", "run_ports",
       """SELECT run, CAST(substr(run, 6) AS INTEGER) AS number, 'run_g' AS prefix, count(*) AS n
          FROM run_ports GROUP BY run""")
def _(r: Roles):
    return (r.run_ports.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
            .withColumns({"number": S.run_number(F.col("run")), "prefix": S.run_prefix(F.col("run"))}))


@query("run_group", "prefix n_runs:i n_ports:i", "run_ports",
       """SELECT 'run_g' AS prefix, count(DISTINCT run) AS n_runs, count(*) AS n_ports FROM run_ports""")
def _(r: Roles):
    return (r.run_ports.groupBy(S.run_prefix(F.col("run")).alias("prefix"))
            .agg(F.countDistinct("run").alias("n_runs"), F.count(F.lit(1)).alias("n_ports")))


@query("coalesce_metric_names", "source port_name date:d loss:6", "daily_a daily_b",
       """SELECT 'a' AS source, port_name, date, swh_max AS loss FROM daily_a UNION ALL
          SELECT 'b', port_name, date, coalesce(CASE WHEN n_obs > 2 THEN net_mean END, swh_mean)
          FROM daily_b""")
def _(r: Roles):
    a = r.daily_a.select(F.lit("a").alias("source"), "port_name", "date",
                         F.col("swh_max").alias("mean_loss"))
    b = r.daily_b.select(F.lit("b").alias("source"), "port_name", "date",
                         F.when(F.col("n_obs") > 2, F.col("net_mean")).alias("annual_loss"),
                         F.col("swh_mean").alias("loss_mean"))
    return report.coalesce_columns(a.unionByName(b, allowMissingColumns=True),
                                   {"loss": ["mean_loss", "annual_loss", "loss_mean", "absent"]})


@query("impute_from_economics",
       "port_name year:i events_filled:6 loss_filled:4 p99_filled:4 is_estimated:i",
       "obs_yearly exposure",
       """SELECT port_name, year, coalesce(CAST(ev AS DOUBLE), loss / nullif(unit, 0)) AS events_filled,
            coalesce(loss, ev * unit) AS loss_filled,
            coalesce(p99, coalesce(loss, ev * unit) * 2.5) AS p99_filled,
            CASE WHEN ev IS NULL OR loss IS NULL OR p99 IS NULL THEN 1 ELSE 0 END AS is_estimated
          FROM (SELECT port_name, year, n_workers * daily_wage AS unit,
                  CASE WHEN year <> 1996 THEN loss_days END AS ev,
                  CASE WHEN year <> 1997 THEN observed_loss END AS loss,
                  CASE WHEN year < 1999 THEN observed_loss * 3 END AS p99
                FROM obs_yearly JOIN exposure USING (port_name))""")
def _(r: Roles):
    yearly = (exposure.yearly_observed_loss(r.labelled, PORT, r.exposure, "y")
              .join(r.exposure, "port_name"))
    year = F.col("year")
    return exposure.impute_from_unit_cost(
        yearly, F.when(year != 1996, F.col("loss_days")),
        F.when(year != 1997, F.col("observed_loss")), F.col("n_workers") * F.col("daily_wage"),
        F.when(year < 1999, F.col("observed_loss") * 3))
