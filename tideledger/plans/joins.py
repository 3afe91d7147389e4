"""Checked queries: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideledger.operators import aep, exposure, labels, resample, rules, search
from tideledger.plans.newton_sql import scrambled_sql
from tideledger.plans.registry import query
from tideledger.plans.roles import BASE_FEATURES, PORT, Roles
from tideledger.session import durable


@query("join_closures_hourly", "port_name n:i n_closed:i duration:2", "readings_a closures",
       """SELECT r.port_name, count(*) AS n, count(c.date) AS n_closed,
          coalesce(sum(duracion), 0) AS duration FROM readings_a r LEFT JOIN closures c
          ON r.port_name = c.port_name AND r.date = c.date GROUP BY r.port_name""")
def _(r: Roles):
    readings = r.readings_a.withColumn("year", F.year("date"))
    return labels.join_closures(readings, durable(r.closures)).groupBy("port_name").agg(
        F.count(F.lit(1)).alias("n"), F.count("event_dummy_1").alias("n_closed"),
        F.coalesce(F.sum("duracion"), F.lit(0.0)).alias("duration"))


@query("join_daily_events", "port_name date:d event_dummy_1:i", "daily_a closures",
       """SELECT d.port_name, d.date, coalesce(e.f, 0) AS event_dummy_1 FROM daily_a d
          LEFT JOIN (SELECT date, max(event_dummy_1) AS f FROM closures GROUP BY date) e
          ON d.date = e.date""")
def _(r: Roles):
    flags = r.closures.groupBy("date").agg(F.max("event_dummy_1").alias("event_dummy_1"))
    return labels.join_daily_flag(r.daily_a, flags, ["date"])


@query("join_sources", "port_name date:d swh_mean_m:9 swh_mean_r:9 n_obs_m:i n_obs_r:i net_mean:9",
       "daily_a daily_b",
       """SELECT port_name, date, a.swh_mean AS swh_mean_m, b.swh_mean AS swh_mean_r,
          a.n_obs AS n_obs_m, b.n_obs AS n_obs_r, net_mean
          FROM daily_a a JOIN daily_b b USING (port_name, date)""")
def _(r: Roles):
    return labels.join_sources(r.daily_a, r.daily_b, ["port_name", "date"], ("_m", "_r"))


@query("join_dynamic_keys", "port_name date:d event_dummy_1:i swh_max:6 net_mean:9", "daily_a daily_b",
       """SELECT a.port_name, a.date, CASE WHEN a.n_obs > 1 THEN 1 ELSE 0 END AS event_dummy_1,
          a.swh_max, b.net_mean FROM daily_a a JOIN daily_b b ON a.port_name = b.port_name
          AND a.date = b.date AND (a.n_obs > 1) = (b.n_obs > 1)""")
def _(r: Roles):
    flag = (F.col("n_obs") > 1).cast("int").alias("event_dummy_1")
    a = r.daily_a.select("port_name", "date", "swh_max", flag)
    b = r.daily_b.select("port_name", "date", "net_mean", flag)
    return a.join(b, labels.shared_keys(a, b, ["port_name", "date"]))


@query("label_closure_days", "port_name date:d y:i", "labelled",
       "SELECT port_name, date, y FROM labelled")
def _(r: Roles):
    return r.labelled


@query("align_reindex", "port_name date:d event:i", "daily_b closures",
       """SELECT d.port_name, d.date, coalesce(c.event_dummy_1, 0) AS event FROM daily_b d
          LEFT JOIN closures c ON d.port_name = c.port_name AND d.date = c.date""")
def _(r: Roles):
    return (labels.join_daily_flag(r.daily_b, r.closures, ["port_name", "date"])
            .withColumnRenamed("event_dummy_1", "event"))


@query("join_ml_probs", "port_name date:d probability:6 y:i", "labelled daily_b",
       """SELECT l.port_name, l.date, p.probability, l.y FROM labelled l JOIN (
            SELECT port_name, date, percent_rank() OVER (PARTITION BY port_name
              ORDER BY net_mean) * 0.1 AS probability FROM daily_b WHERE n_obs > 1) p
          ON l.port_name = p.port_name AND l.date = p.date""")
def _(r: Roles):
    from pyspark.sql import Window
    rank = F.percent_rank().over(Window.partitionBy("port_name").orderBy("net_mean"))
    probs = r.daily_b.where(F.col("n_obs") > 1).select("port_name", "date",
                                                       (rank * 0.1).alias("probability"))
    return r.labelled.join(probs, ["port_name", "date"])


@query("map_lookup", "port_name region n:i", "daily_a",
       """SELECT port_name, r_name AS region, count(*) AS n FROM daily_a
          LEFT JOIN region ON r_regionkey = CAST(substr(port_name, 1, 1) AS INTEGER) - 1
          GROUP BY port_name, r_name""")
def _(r: Roles):
    names = r.table("region").select((F.col("r_regionkey") + 1).cast("string").alias("code"),
                                     F.col("r_name").alias("region"))
    counts = r.daily_a.groupBy("port_name").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(names, F.substring("port_name", 1, 1) == F.col("code"), "left")


@query("semi_port_group", "port_name n_workers:6 daily_wage:6", "params run_ports",
       """SELECT port_name, n_workers, daily_wage FROM params
          WHERE port_name IN (SELECT port_name FROM run_ports WHERE run IN ('run_g1', 'run_g3'))""")
def _(r: Roles):
    group = r.run_ports.where(F.col("run").isin("run_g1", "run_g3"))
    return exposure.ports_in_group(exposure.wage_params(r.wages), group)


@query("seasonal_window_join", "port_name slot:i n:i first_start:d last_start:d", "candidates starts",
       """SELECT c.port_name, slot, count(*) AS n, min(block_start) AS first_start,
          max(block_start) AS last_start FROM candidates c
          JOIN starts s ON s.port_name = c.port_name AND s.i = c.i GROUP BY ALL""")
def _(r: Roles):
    return resample.seasonal_candidates(r.model_days, PORT, ["y"]).groupBy(
        "port_name", "slot").agg(F.count(F.lit(1)).alias("n"),
                                 F.min("block_start").alias("first_start"),
                                 F.max("block_start").alias("last_start"))


_RUNS = """SELECT port_name, {flag} AS kind, min(date) AS s, max(date) AS e, count(*) AS len FROM (
    SELECT *, row_number() OVER (PARTITION BY port_name ORDER BY date)
      - row_number() OVER (PARTITION BY port_name, {flag} ORDER BY date) AS g FROM fired)
    WHERE {flag} = 1 GROUP BY port_name, {flag}, g"""


@query("event_overlap_join", "port_name outcome run_start:d run_end:d run_days:i", "fired",
       """SELECT p.port_name, CASE WHEN EXISTS (SELECT 1 FROM obs_r o WHERE o.port_name = p.port_name
            AND o.s <= p.e AND p.s <= o.e) THEN 'tp' ELSE 'fp' END AS outcome, s AS run_start,
            e AS run_end, len AS run_days FROM pred_r p
          UNION ALL SELECT port_name, 'fn', s, e, len FROM obs_r o WHERE NOT EXISTS (
            SELECT 1 FROM pred_r p WHERE o.port_name = p.port_name AND o.s <= p.e AND p.s <= o.e)""",
       extra={"pred_r": _RUNS.format(flag="pred"), "obs_r": _RUNS.format(flag="obs")})
def _(r: Roles):
    return aep.event_match(r.fired, PORT)


@query("threshold_grid_cross", "port_name rule_id levels t1:6 t2:6 t3:6", "long ranked",
       f"""SELECT port_name, rule_id, levels, t1, t2, t3 FROM (
            SELECT a.port_name, 'triple_AND|' || a.feature || '+' || b.feature || '+' || c.feature
                AS rule_id, a.level || ',' || b.level || ',' || c.level AS levels,
                a.t AS t1, b.t AS t2, c.t AS t3, a.level * 49 + b.level * 7 + c.level AS number
              FROM grid a JOIN grid b ON a.port_name = b.port_name AND b.pos = 1
              JOIN grid c ON a.port_name = c.port_name AND c.pos = 2 WHERE a.pos = 0)
          JOIN drawn USING (rule_id, number)""",
       extra={"rule_names": """SELECT DISTINCT 'triple_AND|' || a.feature || '+' || b.feature || '+' || c.feature AS rule_id
              FROM ranked a JOIN ranked b ON a.port_name = b.port_name AND b.pos = 1
              JOIN ranked c ON a.port_name = c.port_name AND c.pos = 2 WHERE a.pos = 0""",
              **scrambled_sql("rule_names", "343", 9), "grid": " UNION ALL ".join(
           f"""SELECT l.port_name, l.feature, pos, {i} AS level,
               quantile_cont(value, {0.05 + 0.90 * i / 6}) AS t FROM long l JOIN ranked k
               ON k.port_name = l.port_name AND k.feature = l.feature AND pos < 3 GROUP BY ALL"""
           for i in range(7))})
def _(r: Roles):
    triples = rules.triple_rules(r.ranked, PORT).where(F.col("rule_type") == "triple_AND")
    grid = search.grid_values(r.long, PORT, 7)
    points = search.threshold_grid(rules.rule_slots(triples, PORT), grid, PORT, 200)
    return points.select("port_name", "rule_id", F.array_join("levels", ",").alias("levels"),
                         *[F.get("thresholds", F.lit(i)).alias(f"t{i + 1}") for i in range(3)])


_EIGHT = "'all_8|' || string_agg(feature, '+' ORDER BY pos)"


@query("threshold_grid_eight", "port_name rule_id levels thresholds", "long ranked",
       f"""SELECT port_name, rule_id, string_agg(level, ',' ORDER BY pos) AS levels,
             string_agg(printf('%.4f', t), ',' ORDER BY pos) AS thresholds
           FROM (SELECT *, number // CAST(power(7, 7 - pos) AS BIGINT) % 7 AS level FROM drawn, range(0, 8) s(pos))
           JOIN (SELECT port_name, {_EIGHT} AS rule_id FROM ranked GROUP BY port_name) USING (rule_id)
           JOIN grid USING (port_name, pos, level) GROUP BY port_name, rule_id, number""",
       extra={"rule_names": f"SELECT DISTINCT rule_id FROM (SELECT port_name, {_EIGHT} AS rule_id FROM ranked GROUP BY port_name)",
              **scrambled_sql("rule_names", str(7 ** 8), (7 ** 8 - 1).bit_length()),
              "grid": " UNION ALL ".join(
                  f"""SELECT l.port_name, pos, {i} AS level, quantile_cont(value, {0.05 + 0.90 * i / 6}) AS t
                      FROM long l JOIN ranked k ON k.port_name = l.port_name AND k.feature = l.feature GROUP BY ALL"""
                  for i in range(7))})
def _(r: Roles):
    """Seven levels in eight slots: 200 of 5,764,801 combinations."""
    slots = (r.ranked.groupBy("port_name").agg(F.array_sort(F.collect_list(F.struct("pos", "feature"))).alias("f"))
             .select("port_name", F.concat(F.lit("all_8|"), F.array_join("f.feature", "+")).alias("rule_id"),
                     F.posexplode("f.feature").alias("slot", "feature")))
    points = search.threshold_grid(slots, search.grid_values(r.long, PORT, 7), PORT, 200)
    return points.select("port_name", "rule_id", F.array_join("levels", ",").alias("levels"), F.array_join(
        F.transform("thresholds", lambda t: F.format_string("%.4f", t)), ",").alias("thresholds"))


@query("nearest_prob_join", "probability:6 aggregate_loss:2 n_runs:i", "obs_yearly curves",
       """SELECT probability, sum(loss) AS aggregate_loss, count(*) AS n_runs FROM (
            SELECT p.probability, o.port_name, arg_min(o.loss, abs(o.pr - p.probability)) AS loss
            FROM (SELECT DISTINCT probability FROM curves) p CROSS JOIN (
              SELECT port_name, observed_loss AS loss, row_number() OVER (PARTITION BY port_name
                ORDER BY observed_loss DESC, year) / (count(*) OVER (PARTITION BY port_name) + 1.0)
                AS pr FROM obs_yearly) o GROUP BY ALL) GROUP BY probability""")
def _(r: Roles):
    observed = aep.exceedance_rank(r.obs_yearly, PORT, "observed_loss", "year").select(
        F.col("port_name").alias("run"), "probability", F.col("observed_loss").alias("loss"))
    return aep.aggregate_curves(observed, "run", r.curves.select("probability").distinct())


@query("nearest_prob_other_grid", "probability:6 aggregate_loss:2 n_runs:i", "obs_yearly curves",
       """SELECT probability, sum(loss) AS aggregate_loss, count(*) AS n_runs FROM (
            SELECT p.probability, c.port_name, c.loss FROM (SELECT i / 41.0 AS probability FROM range(0, 42) r(i)) p
            CROSS JOIN (SELECT port_name, probability * probability AS pr, max(loss) AS loss FROM curves GROUP BY ALL) c
            QUALIFY row_number() OVER (PARTITION BY p.probability, c.port_name
              ORDER BY round(abs(c.pr - p.probability), 12), c.pr) = 1)
          GROUP BY probability""")
def _(r: Roles):
    """Curves whose probabilities are no ranks, asked for an even grid with both ends."""
    curves = r.curves.select(F.col("port_name").alias("run"), "loss", (F.col("probability") * F.col("probability")).alias("probability"))
    # the grid's 42 points, as the sweep is asked for them
    even = r.spark.range(42).select((F.col("id") / 41.0).alias("probability"))
    return aep.aggregate_curves(curves, "run", even)


_FLAT = " UNION ALL ".join(
    f"""SELECT port_name, date, {i} AS rank, CASE WHEN {c} > quantile_cont({c}, 0.8)
        OVER (PARTITION BY port_name) THEN 1 ELSE 0 END AS pred FROM model_days"""
    for i, c in enumerate(BASE_FEATURES))


@query("rule_pair_join", "port_name a:i b:i corr:6", "model_days",
       """SELECT x.port_name, x.rank AS a, y.rank AS b, coalesce(corr(x.pred, y.pred), 0) AS corr
          FROM flags x JOIN flags y ON x.port_name = y.port_name AND x.date = y.date
          AND x.rank < y.rank GROUP BY ALL""", extra={"flags": _FLAT})
def _(r: Roles):
    from tideledger.operators.features import to_long
    base = to_long(r.model_days, ["port_name", "date"], BASE_FEATURES)
    cut = base.groupBy("port_name", "feature").agg(
        F.percentile("value", F.lit(0.8)).alias("threshold"))
    place = F.array_position(F.array(*[F.lit(c) for c in BASE_FEATURES]), F.col("feature")) - 1
    flags = base.join(cut, ["port_name", "feature"]).select(
        "port_name", "date", place.cast("int").alias("rank"),
        (F.col("value") > F.col("threshold")).cast("int").alias("pred"))
    return search.rule_pair_corr(flags, PORT)
