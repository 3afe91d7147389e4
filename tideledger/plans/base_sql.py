"""The roles again as SQL, for the side-by-side check."""

from __future__ import annotations

from tideledger.plans.roles import (BASE_FEATURES, CLOSURE_SHARE, METHOD_LEVELS, PORTS,
                                    UNIT)

_DRAW = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"


def draw(*parts: str) -> str:
    return _DRAW.format(" || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts))


def _unpivot(source: str, ids: str, cols) -> str:
    return " UNION ALL ".join(
        f"SELECT {ids}, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {source}" for c in cols)


_LONG_COLS = [*BASE_FEATURES, "swh_mean_b_persistence_3", "swh_max_b_lag_1"]

# name -> (tables it needs, query)
CTE: dict[str, tuple[list[str], str]] = {
    "readings_a": ([], f"""SELECT o_orderpriority || '' AS port_name, o_orderdate AS ts,
        CAST(o_orderdate AS DATE) AS date, o_orderkey AS reading_id,
        o_totalprice / {UNIT} AS swh FROM orders"""),
    "readings_b": ([], f"""SELECT o_orderpriority || '' AS port_name, CAST(l_shipdate AS DATE) AS date,
        l_orderkey * 10 + l_linenumber AS reading_id,
        l_extendedprice / {UNIT} AS swh, l_quantity / 7.3 AS swe,
        l_extendedprice * (1 - l_discount) / {UNIT} AS net
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "hours": ([], """SELECT event_type || '' AS port_name, ts, CAST(ts AS DATE) AS date, value AS swh
        FROM events"""),
    "daily_a": (["readings_a"], """SELECT port_name, date, floor(avg(swh) * 134217728 + 0.5) / 134217728 AS swh_mean,
        max(swh) AS swh_max, min(swh) AS swh_min, count(*) AS n_obs
        FROM readings_a GROUP BY port_name, date"""),
    "daily_b": (["readings_b"], """SELECT port_name, date, floor(avg(swh) * 134217728 + 0.5) / 134217728 AS swh_mean,
        max(swh) AS swh_max, min(swh) AS swh_min, floor(avg(net) * 134217728 + 0.5) / 134217728 AS net_mean,
        count(*) AS n_obs FROM readings_b GROUP BY port_name, date"""),
    "closures": (["daily_b"], f"""SELECT d.port_name, d.date, year(d.date) AS year,
        CAST(1 + d.n_obs % 3 AS DOUBLE) AS duracion, 1 AS event_dummy_1
        FROM daily_b d JOIN (SELECT port_name, quantile_cont(net_mean, {CLOSURE_SHARE}) AS cut
                             FROM daily_b GROUP BY port_name) c USING (port_name)
        WHERE d.net_mean > c.cut"""),
    "closed": (["closures"], """SELECT DISTINCT port_name,
        CAST(date + CAST(k AS INTEGER) AS DATE) AS date
        FROM closures, range(0, 3) t(k) WHERE k < duracion"""),
    "labelled": (["daily_a", "closed"], """SELECT d.*, CASE WHEN c.date IS NULL THEN 0 ELSE 1 END
        AS y FROM daily_a d LEFT JOIN closed c ON d.port_name = c.port_name AND d.date = c.date"""),
    "model_days": (["labelled", "daily_b"], """SELECT a.port_name, a.date, a.y,
        a.swh_mean AS swh_mean_a, a.swh_max AS swh_max_a, a.swh_min AS swh_min_a,
        b.swh_mean AS swh_mean_b, b.swh_max AS swh_max_b, b.swh_min AS swh_min_b
        FROM labelled a JOIN daily_b b ON a.port_name = b.port_name AND a.date = b.date"""),
    "fan_days": (["model_days"], """SELECT *, floor(avg(swh_mean_b) OVER (PARTITION BY port_name
        ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) * 134217728 + 0.5) / 134217728 AS swh_mean_b_persistence_3,
        lag(swh_max_b) OVER (PARTITION BY port_name ORDER BY date) AS swh_max_b_lag_1
        FROM model_days"""),
    "long": (["fan_days"], _unpivot("fan_days", "port_name, date, y", _LONG_COLS)),
    "base_long": (["daily_a"], _unpivot("daily_a", "port_name, date",
                                        ["swh_mean", "swh_max", "swh_min"])),
    "exposure": ([], "SELECT CASE n_regionkey " + " ".join(
        f"WHEN {i} THEN '{p}'" for i, p in enumerate(PORTS)) + """ END AS port_name,
        count(*) AS n_workers, round(avg(c_acctbal) / 105, 2) AS daily_wage
        FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey"""),
    "wages": ([], """SELECT replace(lower(n_name), '_', ' ') AS caleta,
        CASE WHEN n_nationkey % 2 = 0 THEN n_name || ',' || n_name ELSE n_name END AS port_name,
        w_p50, CAST(workers AS DOUBLE) AS fishermen_province, n_regionkey
        FROM nation JOIN (SELECT c_nationkey, quantile_cont(c_acctbal, 0.5) AS w_p50,
                          count(*) AS workers FROM customer GROUP BY 1) ON c_nationkey = n_nationkey"""),
    "params": (["wages"], """SELECT upper(replace(caleta, ' ', '_')) AS port_name, w_p50 / 30 AS daily_wage,
        round_even(fishermen_province / len(string_split(port_name, ',')), 0) AS n_workers,
        round_even(fishermen_province / len(string_split(port_name, ',')), 0) * (w_p50 / 30)
        AS daily_loss FROM wages"""),
    "run_ports": ([], """SELECT 'run_g' || (n_regionkey + 1) AS run, upper(n_name) AS port_name
        FROM nation UNION ALL SELECT 'run_g' || (r_regionkey + 1), 'HARBOUR_' || r_name FROM region"""),
    "trig": (["model_days"], """SELECT port_name, quantile_cont(swh_mean_b, 0.75) AS threshold
        FROM model_days GROUP BY port_name"""),
    "fired": (["model_days", "trig"], """SELECT port_name, date, y AS obs,
        CASE WHEN swh_mean_b > threshold THEN 1 ELSE 0 END AS pred, swh_mean_b, threshold
        FROM model_days JOIN trig USING (port_name)"""),
    # folds over the days of a port (six expanding folds)
    "folded": (["model_days"], """SELECT *, CASE WHEN i < n - 6 * (n // 7) THEN -1
        ELSE (i - (n - 6 * (n // 7))) // (n // 7) END AS test_fold
        FROM (SELECT *, row_number() OVER (PARTITION BY port_name ORDER BY date) - 1 AS i,
              count(*) OVER (PARTITION BY port_name) AS n FROM model_days)"""),
    "long_folded": (["long", "folded"], """SELECT l.*, f.test_fold FROM long l
        JOIN folded f ON l.port_name = f.port_name AND l.date = f.date"""),
    "cand": (["long_folded"], f"""SELECT port_name, feature, fold, unnest(list_distinct(
            quantile_cont(value, {[p / 100 for p in range(5, 96, 2)]}))) AS t
        FROM long_folded, range(0, 6) r(fold) WHERE test_fold < fold
        GROUP BY port_name, feature, fold HAVING count(value) >= 5"""),
    "scored": (["cand", "long_folded"], """SELECT c.port_name, c.feature, c.fold, c.t AS threshold,
            count(*) FILTER (WHERE value > t AND y = 1) AS tp,
            count(*) FILTER (WHERE value > t AND y = 0) AS fp,
            count(*) FILTER (WHERE NOT coalesce(value > t, false) AND y = 1) AS fn,
            count(*) FILTER (WHERE NOT coalesce(value > t, false) AND y = 0) AS tn
        FROM cand c JOIN long_folded l ON l.port_name = c.port_name AND l.feature = c.feature
             AND l.test_fold = c.fold GROUP BY ALL"""),
    "best_t": (["scored"], """SELECT port_name, feature, fold, threshold, tp, fp, fn, tn,
            2.0 * tp / (2 * tp + fp + fn) AS f1 FROM scored
        WHERE tp + fp > 0 AND (tp + tn) / CAST(tp + fp + tn + fn AS DOUBLE) >= 0.2
        QUALIFY row_number() OVER (PARTITION BY port_name, feature, fold
            ORDER BY 2.0 * tp / (2 * tp + fp + fn) DESC, threshold) = 1"""),
    "ranked": (["long"], """SELECT port_name, feature, row_number() OVER (PARTITION BY port_name
        ORDER BY score DESC, feature) - 1 AS pos FROM (SELECT port_name, feature,
        max(value) AS score FROM long GROUP BY ALL)"""),
    "methods": (["model_days"], " UNION ALL ".join(f"""SELECT port_name, 'p{int(p * 100)}' AS method,
        quantile_cont(swh_mean_b, {p}) AS threshold FROM model_days GROUP BY port_name"""
        for p in METHOD_LEVELS)),
    "method_days": (["methods", "model_days"], """SELECT d.port_name, method, date, y AS obs,
        CASE WHEN swh_mean_b > threshold THEN 1 ELSE 0 END AS pred
        FROM model_days d JOIN methods m ON d.port_name = m.port_name"""),
    "method_years": (["method_days", "exposure"], """SELECT port_name, method, year, loss_days,
        n_workers * daily_wage * loss_days AS loss FROM (SELECT port_name, method,
        year(date) AS year, sum(pred) AS loss_days FROM method_days GROUP BY ALL)
        JOIN exposure USING (port_name)"""),
    # block bootstrap over the model days
    "numbered": (["model_days"], """SELECT *, row_number() OVER (PARTITION BY port_name
        ORDER BY date) - 1 AS i FROM model_days"""),
    "starts": (["numbered"], """SELECT a.port_name, a.i, a.date AS block_start, b.date AS block_end
        FROM numbered a JOIN numbered b ON b.port_name = a.port_name AND b.i = a.i + 6"""),
    "centres": (["model_days"], """SELECT port_name, slot, CAST(make_date(y, month(ref), least(
            day(ref), day(last_day(make_date(y, month(ref), 1))))) AS DATE) AS centre
        FROM (SELECT DISTINCT port_name, year(date) AS y FROM model_days) ys
        JOIN (SELECT port_name, s AS slot,
                     CAST(make_date(min(year(date)), 1, 1) + CAST(7 * s AS INTEGER) AS DATE) AS ref
              FROM model_days, range(0, 53) r(s) GROUP BY port_name, s) USING (port_name)"""),
    "fitting": (["starts", "centres"], """SELECT s.port_name, slot, s.i, block_start, centre
        FROM starts s JOIN centres c ON s.port_name = c.port_name
        AND block_start BETWEEN centre - 10 AND centre + 10 AND block_end <= centre + 10"""),
    "candidates": (["fitting", "starts", "centres"], """SELECT port_name, slot, i,
            row_number() OVER (PARTITION BY port_name, slot ORDER BY block_start, centre) - 1
            AS pick, count(*) OVER (PARTITION BY port_name, slot) AS n_candidates
        FROM (SELECT * FROM fitting UNION ALL
              SELECT s.port_name, e.slot, s.i, s.block_start, CAST(NULL AS DATE) AS centre
              FROM (SELECT DISTINCT port_name, slot FROM centres
                    EXCEPT SELECT port_name, slot FROM fitting) e
              JOIN starts s ON s.port_name = e.port_name)"""),
    "draws": ([], "SELECT sim, slot, " + _DRAW.format(
        "'0|' || CAST(sim AS VARCHAR) || '|' || CAST(slot AS VARCHAR)")
        + """ AS h FROM (SELECT unnest(range(200)) AS sim), (SELECT unnest(range(53)) AS slot)"""),
    "sim_days": (["candidates", "numbered", "draws"], """SELECT n.* EXCLUDE (i), d.sim,
            CAST(d.slot * 7 + o + 1 AS INTEGER) AS day
        FROM (SELECT c.port_name, c.slot, u.sim, c.i, unnest(range(7)) AS o FROM candidates c
              JOIN draws u ON u.slot = c.slot AND u.h % c.n_candidates = c.pick) d
        JOIN numbered n ON n.port_name = d.port_name AND n.i = d.i + d.o
        WHERE d.slot * 7 + o + 1 <= 365"""),
    "sim_fired": (["sim_days", "trig"], """SELECT s.port_name, sim, day, y AS obs, swh_mean_b,
        CASE WHEN swh_mean_b > threshold THEN 1 ELSE 0 END AS pred
        FROM sim_days s JOIN trig t ON s.port_name = t.port_name"""),
    "sim_losses": (["sim_fired", "exposure"], """SELECT port_name, sim, loss_days, n_events,
            n_workers * daily_wage * loss_days AS loss
        FROM (SELECT port_name, sim, coalesce(sum(CASE WHEN pred = 1 AND len >= 2 THEN len END), 0)
                     AS loss_days, count(*) FILTER (WHERE pred = 1) AS n_events
              FROM (SELECT port_name, sim, pred, g, count(*) AS len FROM (
                        SELECT *, row_number() OVER (PARTITION BY port_name, sim ORDER BY day)
                          - row_number() OVER (PARTITION BY port_name, sim, pred ORDER BY day) AS g
                        FROM sim_fired) GROUP BY port_name, sim, pred, g)
              GROUP BY port_name, sim) JOIN exposure USING (port_name)"""),
    "sim_parts": (["sim_fired", "exposure"], """SELECT port_name, sim, component,
            n_workers * daily_wage * coalesce(days, 0) AS loss, coalesce(n_events, 0) AS n_events
        FROM (SELECT DISTINCT port_name, sim FROM sim_fired) b
        CROSS JOIN (VALUES ('fp'), ('fn'), ('tp')) v(component)
        LEFT JOIN (SELECT port_name, sim, component,
                       sum(CASE WHEN len >= 2 THEN len ELSE 0 END) AS days, count(*) AS n_events
                   FROM (SELECT port_name, sim, component, g, count(*) AS len FROM (
                        SELECT *, row_number() OVER (PARTITION BY port_name, sim ORDER BY day)
                          - row_number() OVER (PARTITION BY port_name, sim, component ORDER BY day)
                          AS g FROM (SELECT *, CASE WHEN pred = 1 AND obs = 0 THEN 'fp'
                                     WHEN pred = 0 AND obs = 1 THEN 'fn'
                                     WHEN pred = 1 THEN 'tp' ELSE 'tn' END AS component
                                     FROM sim_fired)) GROUP BY ALL)
                   GROUP BY port_name, sim, component) USING (port_name, sim, component)
        JOIN exposure USING (port_name)"""),
    "components": (["sim_parts"], """SELECT * FROM sim_parts UNION ALL
        SELECT port_name, sim, 'insurance', sum(loss), sum(n_events) FROM sim_parts
        WHERE component <> 'fn' GROUP BY port_name, sim"""),
    "curves": (["sim_losses"], """SELECT port_name, sim, loss, rank, rank / (n + 1.0) AS probability
        FROM (SELECT *, row_number() OVER (PARTITION BY port_name ORDER BY loss DESC, sim) AS rank,
              count(*) OVER (PARTITION BY port_name) AS n FROM sim_losses)"""),
    "obs_runs": (["labelled"], """SELECT port_name, year, len AS run_days FROM (
        SELECT port_name, year, g, count(*) AS len FROM (
            SELECT *, row_number() OVER (PARTITION BY port_name, year ORDER BY date)
              - row_number() OVER (PARTITION BY port_name, year, y ORDER BY date) AS g
            FROM (SELECT *, year(date) AS year FROM labelled)) WHERE y = 1 GROUP BY ALL)"""),
    "obs_yearly": (["labelled", "obs_runs", "exposure"], """SELECT port_name, year,
            coalesce(loss_days, 0) AS loss_days,
            n_workers * daily_wage * coalesce(loss_days, 0) AS observed_loss
        FROM (SELECT DISTINCT port_name, year(date) AS year FROM labelled)
        LEFT JOIN (SELECT port_name, year, sum(run_days) AS loss_days FROM obs_runs GROUP BY ALL)
            USING (port_name, year) JOIN exposure USING (port_name)"""),
}


def with_tables(*names: str, extra: dict[str, str] | None = None, body: str) -> str:
    """WITH clause holding the named role tables and what they need, then the query."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for need in CTE[name][0]:
            add(need)
        order.append(name)

    for n in names:
        add(n)
    parts = [f"{n} AS ({CTE[n][1]})" for n in order]
    parts += [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return ("WITH RECURSIVE " + ", ".join(parts) + " " if parts else "") + body
