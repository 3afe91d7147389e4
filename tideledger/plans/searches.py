"""Checked queries: rule algebra, rule search, feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideledger.functions.scalars import with_metrics
from tideledger.operators import bitmaps, rules, search, selection
from tideledger.plans.registry import query
from tideledger.plans.roles import FEATURES, N_FOLDS, PORT, Roles
from tideledger.session import durable

# ---- predicates ----------------------------------------------------------------------------
# Three conditions per day: mean of source A above its p75, yesterday's maximum of source B
# above its p60 (null on the first day), minimum of source B above its median.

_CONDS = """SELECT port_name, date, coalesce(swh_mean_a > t1, false) AS c1,
    coalesce(swh_max_b_lag_1 > t2, false) AS c2, coalesce(swh_min_b > t3, false) AS c3
    FROM fan_days JOIN (SELECT port_name, quantile_cont(swh_mean_a, 0.75) AS t1,
      quantile_cont(swh_max_b_lag_1, 0.6) AS t2, quantile_cont(swh_min_b, 0.5) AS t3
      FROM fan_days GROUP BY port_name) USING (port_name)"""


def _conditions(r: Roles):
    cut = r.fan_days.groupBy("port_name").agg(
        F.percentile("swh_mean_a", F.lit(0.75)).alias("t1"),
        F.percentile("swh_max_b_lag_1", F.lit(0.6)).alias("t2"),
        F.percentile("swh_min_b", F.lit(0.5)).alias("t3"))
    return r.fan_days.join(cut, "port_name").select(
        "port_name", "date", rules.fires(F.col("swh_mean_a"), F.col("t1")).alias("c1"),
        rules.fires(F.col("swh_max_b_lag_1"), F.col("t2")).alias("c2"),
        rules.fires(F.col("swh_min_b"), F.col("t3")).alias("c3"))


def _predicate(name: str, sql: str, cond) -> None:
    @query(name, "port_name date:d fired:i", "fan_days",
           f"SELECT port_name, date, CASE WHEN {sql} THEN 1 ELSE 0 END AS fired FROM conds",
           extra={"conds": _CONDS})
    def _(r: Roles):
        c = [F.col(f"c{i}") for i in (1, 2, 3)]
        return _conditions(r).withColumn("fired", cond(*c).cast("int"))


_predicate("rule_single", "c2", lambda a, b, c: b)
_predicate("rule_and", "c1 AND c2", lambda a, b, c: rules.rule_and(a, b))
_predicate("rule_or", "c1 OR c2", lambda a, b, c: rules.rule_or(a, b))
_predicate("rule_majority", "CAST(c1 AS INT) + CAST(c2 AS INT) + CAST(c3 AS INT) >= 2",
           lambda a, b, c: rules.rule_majority(a, b, c))
_predicate("rule_piecewise", "CASE WHEN c2 THEN c1 ELSE c3 END",
           lambda a, b, c: rules.rule_piecewise(a, b, c))
_predicate("rule_multi", "(c1 OR c2) AND c3", lambda a, b, c: rules.rule_multi([a, b, c], ["OR", "AND"]))

# ---- generators ----------------------------------------------------------------------------

_PAIRS = """SELECT port_name, kind || '|' || a || '+' || b AS rule_id, kind AS rule_type, a AS f1,
    b AS f2, NULL AS f3, a || ' > t1 ' || op || ' ' || b || ' > t2' AS rule_name
    FROM (SELECT *, row_number() OVER (PARTITION BY port_name ORDER BY {order}, k) AS seq
          FROM ({source})) WHERE seq <= {cap}"""
_WIDE_SOURCE = """SELECT x.port_name, x.pos AS i, y.pos AS j, x.feature AS a, y.feature AS b, k, op,
      CASE k WHEN 0 THEN 'and_2' ELSE 'or_2' END AS kind
      FROM ranked x JOIN ranked y ON x.port_name = y.port_name AND x.pos <> y.pos
      CROSS JOIN (VALUES (0, 'AND'), (1, 'OR')) v(k, op) WHERE k = 0 OR (x.pos + y.pos) % 7 = 0"""
_SINGLES = """SELECT port_name, 'single|' || feature AS rule_id, 'single' AS rule_type, feature AS f1,
      CAST(NULL AS VARCHAR) AS f2, CAST(NULL AS VARCHAR) AS f3, feature || ' > threshold' AS rule_name
      FROM ranked"""
_MAJORITY = """SELECT a.port_name, 'majority_3|' || a.feature || '+' || b.feature || '+' || c.feature,
      'majority_3', a.feature, b.feature, c.feature,
      'Majority of ' || a.feature || ', ' || b.feature || ', ' || c.feature
      FROM ranked a JOIN ranked b ON a.port_name = b.port_name AND b.pos = a.pos + 1
      JOIN ranked c ON a.port_name = c.port_name AND c.pos = a.pos + 2 WHERE {where}"""
_PIECEWISE = """SELECT a.port_name, 'piecewise|' || a.feature || '+' || b.feature || '+' || a.feature,
      'piecewise', a.feature, b.feature, a.feature, a.feature || ' > t1 if ' || b.feature
      || ' > t2 else ' || a.feature || ' > t3'
      FROM ranked a JOIN ranked b ON a.port_name = b.port_name AND b.pos = a.pos + 1
      JOIN ranked c ON a.port_name = c.port_name AND c.pos = a.pos + 2 WHERE a.pos < {n}"""


def _wide_sql(max_rules: int) -> str:
    cap2, cap3 = min(200, max_rules // 2), min(60, max_rules // 6)
    half = -(-cap3 // 2)
    return " UNION ALL ".join([
        _SINGLES, _PAIRS.format(order="i, j", source=_WIDE_SOURCE, cap=cap2),
        _MAJORITY.format(where=f"a.pos < {half}"), _PIECEWISE.format(n=half)])


@query("gen_rules_wide", "port_name rule_id rule_type rule_name", "ranked", _wide_sql(500))
def _(r: Roles):
    return rules.wide_rules(r.ranked, PORT, 500)


_THEMES = {"extreme": "_max_|_p(85|90|95)", "temporal": "_trend_|_persistence_|_change_|_lag_",
           "anomaly": "_mean_", "source": "_a$"}
_THEMED_SOURCE = """SELECT *, CASE k WHEN 0 THEN 'and_2' ELSE 'or_2' END AS kind FROM (
      SELECT x.port_name, pairing, x.place AS i, y.place AS j, x.feature AS a, y.feature AS b
      FROM (VALUES (0, 'extreme', 8, 'temporal', 8), (1, 'extreme', 8, 'anomaly', 5),
            (2, 'source', 4, 'temporal', 4), (3, 'anomaly', 5, 'temporal', 5)) p(pairing, ta, na, tb, nb)
      JOIN themed x ON x.theme = ta AND x.place < na
      JOIN themed y ON y.theme = tb AND y.place < nb AND x.port_name = y.port_name
      WHERE x.feature <> y.feature) CROSS JOIN (VALUES (0, 'AND'), (1, 'OR')) v(k, op)
      WHERE k = 0 OR CAST('0x' || substr(md5('0|' || pairing || '|' || a || '|' || b), 1, 8) AS BIGINT)
        / 4294967296.0 < 0.3"""


@query("gen_rules_themed", "port_name rule_id rule_type rule_name", "ranked",
       " UNION ALL ".join([_SINGLES, _PAIRS.format(order="pairing, i, j", source=_THEMED_SOURCE, cap=80),
                           _MAJORITY.format(where="a.pos IN (0, 3, 6)")]),
       extra={"themed": " UNION ALL ".join(
           f"""SELECT port_name, feature, '{t}' AS theme, row_number() OVER (PARTITION BY port_name
               ORDER BY pos) - 1 AS place FROM ranked WHERE regexp_matches(feature, '{p}')"""
           for t, p in _THEMES.items())})
def _(r: Roles):
    return rules.themed_rules(r.ranked, PORT, 250, themes=_THEMES)


_DOUBLE_SOURCE = """SELECT x.port_name, x.pos AS i, y.pos AS j, x.feature AS a, y.feature AS b, k, op,
      CASE k WHEN 0 THEN 'double_AND' ELSE 'double_OR' END AS kind
      FROM ranked x JOIN ranked y ON x.port_name = y.port_name AND x.pos < y.pos
      CROSS JOIN (VALUES (0, 'AND'), (1, 'OR')) v(k, op) WHERE y.pos < {n}"""


@query("gen_double_rules", "port_name rule_id rule_type rule_name", "ranked",
       _PAIRS.format(order="i, j", source=_DOUBLE_SOURCE.format(n=99), cap=50))
def _(r: Roles):
    return rules.double_rules(r.ranked, PORT, 50)


_TRIPLES = """SELECT a.port_name, 'triple_AND|' || a.feature || '+' || b.feature || '+' || c.feature AS
      rule_id, 'triple_AND' AS rule_type, a.feature AS f1, b.feature AS f2, c.feature AS f3,
      a.feature || ' AND ' || b.feature || ' AND ' || c.feature AS rule_name FROM top4 a
      JOIN top4 b ON a.port_name = b.port_name AND b.pos = 1
      JOIN top4 c ON a.port_name = c.port_name AND c.pos = 2 WHERE a.pos = 0 UNION ALL
      SELECT a.port_name, 'triple_AND_OR|' || a.feature || '+' || b.feature || '+' || d.feature,
      'triple_AND_OR', a.feature, b.feature, d.feature,
      a.feature || ' AND ' || b.feature || ' OR ' || d.feature FROM top4 a
      JOIN top4 b ON a.port_name = b.port_name AND b.pos = 1
      JOIN top4 d ON a.port_name = d.port_name AND d.pos = 3 WHERE a.pos = 0"""
TOP4 = "SELECT * FROM ranked WHERE pos < 4"


@query("gen_triple_rules", "port_name rule_id rule_type rule_name", "ranked", _TRIPLES,
       extra={"top4": TOP4})
def _(r: Roles):
    return rules.triple_rules(r.ranked, PORT)


# ---- threshold search and cross-validation -------------------------------------------------

@query("fold_threshold_search", "port_name feature fold:i threshold:6 f1:6 tp:i fp:i fn:i tn:i", "best_t",
       "SELECT * FROM best_t")
def _(r: Roles):
    return r.best_thresholds


@query("fold_threshold_search_train", "port_name feature fold:i threshold:6 tp:i fp:i", "cand long_folded",
       """SELECT port_name, feature, fold, threshold, tp, fp FROM (
            SELECT c.port_name, c.feature, c.fold, c.t AS threshold,
              count(*) FILTER (WHERE value > t AND y = 1) AS tp,
              count(*) FILTER (WHERE value > t AND y = 0) AS fp,
              count(*) FILTER (WHERE NOT coalesce(value > t, false) AND y = 1) AS fn,
              count(*) FILTER (WHERE NOT coalesce(value > t, false) AND y = 0) AS tn
            FROM cand c JOIN long_folded l ON l.port_name = c.port_name AND l.feature = c.feature
              AND l.test_fold < c.fold GROUP BY ALL)
          WHERE tp + fp > 0 AND (tp + tn) / CAST(tp + fp + tn + fn AS DOUBLE) >= 0.2
          QUALIFY row_number() OVER (PARTITION BY port_name, feature, fold
            ORDER BY 2.0 * tp / (2 * tp + fp + fn) DESC, threshold) = 1""")
def _(r: Roles):
    return search.fold_threshold_search(r.long_folded, PORT, N_FOLDS, score_on="train")


_METRICS = """coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS precision,
    coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS recall,
    coalesce((tp + tn) / nullif(CAST(tp + fp + tn + fn AS DOUBLE), 0), 0) AS accuracy,
    coalesce(2.0 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0) AS f1"""
_CV = {
    "wrules": _wide_sql(500),
    "flags": """SELECT r.port_name, r.rule_id, r.rule_type, t1.fold, l1.date, l1.y, CASE WHEN
          CASE rule_type WHEN 'single' THEN coalesce(l1.value > t1.threshold, false)
            WHEN 'and_2' THEN coalesce(l1.value > t1.threshold, false) AND coalesce(l2.value > t2.threshold, false)
            WHEN 'or_2' THEN coalesce(l1.value > t1.threshold, false) OR coalesce(l2.value > t2.threshold, false)
            WHEN 'majority_3' THEN CAST(coalesce(l1.value > t1.threshold, false) AS INT)
              + CAST(coalesce(l2.value > t2.threshold, false) AS INT)
              + CAST(coalesce(l3.value > t3.threshold, false) AS INT) >= 2
            ELSE CASE WHEN coalesce(l2.value > t2.threshold, false)
              THEN coalesce(l1.value > t1.threshold, false)
              ELSE coalesce(l3.value > t3.threshold, false) END END THEN 1 ELSE 0 END AS pred
        FROM wrules r JOIN best_t t1 ON t1.port_name = r.port_name AND t1.feature = r.f1
        LEFT JOIN best_t t2 ON t2.port_name = r.port_name AND t2.feature = r.f2 AND t2.fold = t1.fold
        LEFT JOIN best_t t3 ON t3.port_name = r.port_name AND t3.feature = r.f3 AND t3.fold = t1.fold
        JOIN long_folded l1 ON l1.port_name = r.port_name AND l1.feature = r.f1 AND l1.test_fold = t1.fold
        LEFT JOIN long_folded l2 ON l2.port_name = r.port_name AND l2.feature = r.f2 AND l2.date = l1.date
        LEFT JOIN long_folded l3 ON l3.port_name = r.port_name AND l3.feature = r.f3 AND l3.date = l1.date
        WHERE (r.f2 IS NULL OR t2.threshold IS NOT NULL) AND (r.f3 IS NULL OR t3.threshold IS NOT NULL)""",
    "smoothed": """SELECT *, CASE WHEN pred = 1 AND count(*) OVER (PARTITION BY port_name, rule_id, fold,
          pred, g) >= 2 THEN 1 ELSE 0 END AS keep FROM (SELECT *,
          row_number() OVER (PARTITION BY port_name, rule_id, fold ORDER BY date)
          - row_number() OVER (PARTITION BY port_name, rule_id, fold, pred ORDER BY date) AS g FROM flags)""",
    "rule_folds": f"""SELECT *, {_METRICS} FROM (SELECT port_name, rule_id, rule_type, fold,
          count(*) FILTER (WHERE keep = 1 AND y = 1) AS tp, count(*) FILTER (WHERE keep = 1 AND y = 0) AS fp,
          count(*) FILTER (WHERE keep = 0 AND y = 1) AS fn, count(*) FILTER (WHERE keep = 0 AND y = 0) AS tn
          FROM smoothed GROUP BY port_name, rule_id, rule_type, fold)""",
    "cv": """SELECT port_name, rule_id, rule_type, count(*) AS n_folds, avg(f1) AS f1_mean,
          stddev_samp(f1) AS f1_std, avg(precision) AS precision_mean, avg(recall) AS recall_mean,
          avg(accuracy) AS accuracy_mean, sum(tp) AS tp_total, sum(fp) AS fp_total, sum(tn) AS tn_total,
          sum(fn) AS fn_total FROM rule_folds GROUP BY port_name, rule_id, rule_type
          HAVING count(*) >= 3"""}


@query("rule_cv", "port_name rule_id rule_type n_folds:i f1_mean:6 f1_std:6 precision_mean:6 "
       "recall_mean:6 accuracy_mean:6 tp_total:i fp_total:i tn_total:i fn_total:i",
       "best_t long_folded ranked", "SELECT * FROM cv", extra=_CV)
def _(r: Roles):
    return search.rule_cv(rules.wide_rules(r.ranked, PORT, 500), r.long_folded, PORT, N_FOLDS,
                          r.best_thresholds)


_SINGLE_CV = f"""SELECT port_name, 'single|' || feature AS rule_id, 'single' AS rule_type, feature,
    count(*) AS n_folds, round(avg(f1), 9) AS f1_mean, round(stddev_samp(f1), 9) AS f1_std
    FROM (SELECT port_name, feature, {_METRICS} FROM best_t) GROUP BY port_name, feature"""


def _single_cv(r: Roles):
    folds = with_metrics(r.best_thresholds).withColumns({
        "rule_id": F.concat(F.lit("single|"), "feature"), "rule_type": F.lit("single")})
    cv = search.cv_summary(folds, ["port_name", "rule_id", "rule_type"])
    return cv.withColumns({c: F.round(c, 9) for c in ("f1_mean", "f1_std")})


@query("stable_rules", "port_name rule_id f1_mean:9 f1_std:9 n_folds:i", "best_t",
       """SELECT * FROM (SELECT *, max(ok) OVER (PARTITION BY port_name) AS any_ok,
            row_number() OVER (PARTITION BY port_name ORDER BY f1_mean DESC, rule_id) AS r FROM (
            SELECT *, CASE WHEN f1_mean >= 0.25 AND f1_std <= 0.06 AND n_folds >= 4 THEN 1 ELSE 0 END
            AS ok FROM scv)) WHERE CASE WHEN any_ok = 1 THEN ok = 1 ELSE r <= 3 END""",
       extra={"scv": _SINGLE_CV})
def _(r: Roles):
    return search.stable_rules(_single_cv(r), PORT, 0.25, 0.06, 4, 3)


_FIRED = """CASE WHEN CASE r.rule_type WHEN 'single' THEN coalesce(l1.value > t1.threshold, false)
      WHEN 'and_2' THEN coalesce(l1.value > t1.threshold, false) AND coalesce(l2.value > t2.threshold, false)
      WHEN 'or_2' THEN coalesce(l1.value > t1.threshold, false) OR coalesce(l2.value > t2.threshold, false)
      WHEN 'majority_3' THEN CAST(coalesce(l1.value > t1.threshold, false) AS INT)
        + CAST(coalesce(l2.value > t2.threshold, false) AS INT) + CAST(coalesce(l3.value > t3.threshold, false) AS INT) >= 2
      ELSE CASE WHEN coalesce(l2.value > t2.threshold, false) THEN coalesce(l1.value > t1.threshold, false)
        ELSE coalesce(l3.value > t3.threshold, false) END END THEN 1 ELSE 0 END"""
#: The reference's defaults: rules that enter pruning, rules kept, greatest correlation.
ENTERING, KEPT, MOST_CORR = 30, 15, 0.95
_PRUNE = {
    **_CV,
    "entering": f"""SELECT *, row_number() OVER (PARTITION BY port_name ORDER BY f1_mean DESC, rule_id)
        AS rank FROM (SELECT *, max(ok) OVER (PARTITION BY port_name) AS any_ok FROM (SELECT port_name, rule_id, rule_type,
          round(f1_mean, 9) AS f1_mean, CASE WHEN round(f1_std, 9) <= 0.18 AND n_folds >= 4 THEN 1 ELSE 0 END AS ok FROM cv))
        WHERE any_ok = 0 OR ok = 1 QUALIFY rank <= {ENTERING}""",
    "armed": """SELECT r.port_name, r.rule_id, min(t1.fold) AS fold FROM wrules r
        JOIN best_t t1 ON t1.port_name = r.port_name AND t1.feature = r.f1
        LEFT JOIN best_t t2 ON t2.port_name = r.port_name AND t2.feature = r.f2 AND t2.fold = t1.fold
        LEFT JOIN best_t t3 ON t3.port_name = r.port_name AND t3.feature = r.f3 AND t3.fold = t1.fold
        WHERE (r.f2 IS NULL OR t2.threshold IS NOT NULL) AND (r.f3 IS NULL OR t3.threshold IS NOT NULL) GROUP BY ALL""",
    "full_flags": f"""SELECT r.port_name, c.rank, r.rule_id, l1.date, {_FIRED} AS pred
        FROM entering c JOIN wrules r ON r.port_name = c.port_name AND r.rule_id = c.rule_id
        JOIN armed a ON a.port_name = r.port_name AND a.rule_id = r.rule_id
        JOIN best_t t1 ON t1.port_name = r.port_name AND t1.feature = r.f1 AND t1.fold = a.fold
        LEFT JOIN best_t t2 ON t2.port_name = r.port_name AND t2.feature = r.f2 AND t2.fold = a.fold
        LEFT JOIN best_t t3 ON t3.port_name = r.port_name AND t3.feature = r.f3 AND t3.fold = a.fold
        JOIN long l1 ON l1.port_name = r.port_name AND l1.feature = r.f1
        LEFT JOIN long l2 ON l2.port_name = r.port_name AND l2.feature = r.f2 AND l2.date = l1.date
        LEFT JOIN long l3 ON l3.port_name = r.port_name AND l3.feature = r.f3 AND l3.date = l1.date""",
    "clashes": f"""SELECT port_name, b AS rank, list(a) AS clash FROM (
        SELECT x.port_name, x.rank AS a, y.rank AS b, coalesce(corr(x.pred, y.pred), 0) AS corr
        FROM full_flags x JOIN full_flags y ON x.port_name = y.port_name AND x.date = y.date
        AND x.rank < y.rank GROUP BY ALL) WHERE corr > {MOST_CORR} GROUP BY port_name, b""",
    "walk": f"""SELECT DISTINCT port_name, CAST(0 AS BIGINT) AS rank, CAST([] AS BIGINT[]) AS kept
        FROM entering UNION ALL
        SELECT w.port_name, w.rank + 1, CASE WHEN len(kept) < {KEPT} AND NOT list_has_any(kept,
          coalesce(k.clash, CAST([] AS BIGINT[]))) THEN list_append(kept, w.rank + 1) ELSE kept END
        FROM walk w JOIN entering e ON e.port_name = w.port_name AND e.rank = w.rank + 1
        LEFT JOIN clashes k ON k.port_name = w.port_name AND k.rank = w.rank + 1""",
    "kept_rules": """SELECT port_name, rank, row_number() OVER (PARTITION BY port_name ORDER BY rank) AS place
        FROM (SELECT port_name, unnest(kept) AS rank FROM (SELECT port_name,
        arg_max(kept, rank) AS kept FROM walk GROUP BY port_name))"""}


def _pruned(r: Roles):
    """Kept rules with their sets of days, and the days."""
    wide = rules.wide_rules(r.ranked, PORT, 500)
    cv = durable(search.rule_cv(wide, r.long_folded, PORT, N_FOLDS, r.best_thresholds))
    cv = cv.withColumns({c: F.round(c, 9) for c in ("f1_mean", "f1_std")})
    entering = search.prune_candidates(cv, PORT, top=ENTERING)
    sets, days, whole = bitmaps.first_fold_sets(wide, r.best_thresholds, r.long, PORT)
    ranked = durable(entering.select("port_name", "rule_id", "rank", "f1_mean").join(
        sets.select("port_name", "rule_id", "days"), ["port_name", "rule_id"]))
    corr = bitmaps.pair_correlation(ranked, whole, PORT)
    kept = search.greedy_prune(ranked, corr, PORT, MOST_CORR, KEPT)
    names = wide.select("port_name", "rule_id", "rule_name")
    return kept.join(names, ["port_name", "rule_id"]), days


@query("rule_redundancy_prune", "port_name rank:i rule_id f1_mean:9", "best_t long_folded long ranked",
       "SELECT port_name, rank, rule_id, f1_mean FROM kept_rules JOIN entering USING (port_name, rank)",
       extra=_PRUNE)
def _(r: Roles):
    return _pruned(r)[0]


@query("ensemble_vote", "port_name date:d votes:i ensemble_pred:i", "best_t long_folded long ranked",
       """SELECT port_name, date, sum(pred) AS votes, CASE WHEN sum(pred) >= 3 THEN 1 ELSE 0 END
          AS ensemble_pred FROM full_flags JOIN kept_rules USING (port_name, rank)
          GROUP BY port_name, date""", extra=_PRUNE)
def _(r: Roles):
    return bitmaps.ensemble_table(*_pruned(r), PORT, KEPT)


_RULE_COLUMNS = ", ".join(f"""max(CASE WHEN place = {i} THEN pred END) AS rule_{i}_pred,
    max(CASE WHEN place = {i} THEN rule_name END) AS rule_{i}_name,
    max(CASE WHEN place = {i} THEN f1_mean END) AS rule_{i}_f1""" for i in range(1, KEPT + 1))


@query("ensemble_wide", "port_name date:d ensemble_pred:i " + " ".join(
           f"rule_{i}_pred:i rule_{i}_name rule_{i}_f1:9" for i in range(1, KEPT + 1)), "best_t long_folded long ranked",
       f"""SELECT port_name, date, CASE WHEN sum(pred) >= 3 THEN 1 ELSE 0 END AS ensemble_pred, {_RULE_COLUMNS}
           FROM full_flags JOIN kept_rules USING (port_name, rank)
           JOIN (SELECT port_name, rule_id, f1_mean FROM entering) USING (port_name, rule_id)
           JOIN (SELECT port_name, rule_id, rule_name FROM wrules) USING (port_name, rule_id)
           GROUP BY port_name, date""", extra=_PRUNE)
def _(r: Roles):
    return bitmaps.ensemble_table(*_pruned(r), PORT, KEPT)


_GRID = {
    "grid": " UNION ALL ".join(
        f"""SELECT l.port_name, l.feature, pos, {i} AS level, quantile_cont(value, {0.05 + 0.90 * i / 4})
            AS t FROM long l JOIN ranked k ON k.port_name = l.port_name AND k.feature = l.feature
            AND pos < 3 GROUP BY ALL""" for i in range(5)),
    "points": """SELECT a.port_name, op, a.feature AS f1, b.feature AS f2, a.level AS l1, b.level AS l2,
        a.t AS t1, b.t AS t2 FROM grid a JOIN grid b ON a.port_name = b.port_name AND a.pos < b.pos
        CROSS JOIN (VALUES ('AND'), ('OR')) v(op)""",
    "gscored": """SELECT p.port_name, op, f1, f2, l1, l2, t1, t2,
          count(*) FILTER (WHERE hit AND y = 1) AS tp, count(*) FILTER (WHERE hit AND y = 0) AS fp,
          count(*) FILTER (WHERE NOT hit AND y = 1) AS fn, count(*) FILTER (WHERE NOT hit AND y = 0) AS tn
        FROM (SELECT p.*, a.y, CASE op WHEN 'AND' THEN coalesce(a.value > t1, false) AND
                coalesce(b.value > t2, false) ELSE coalesce(a.value > t1, false) OR
                coalesce(b.value > t2, false) END AS hit
              FROM points p JOIN long a ON a.port_name = p.port_name AND a.feature = f1
              JOIN long b ON b.port_name = p.port_name AND b.feature = f2 AND b.date = a.date) p
        GROUP BY ALL""",
    "gbest": """SELECT port_name, 'double_' || op || '|' || f1 || '+' || f2 AS rule_id, op,
          f1 AS feature_1, f2 AS feature_2, l1, l2, t1, t2,
          tp, fp, fn, tn, coalesce(2.0 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0) AS f1
        FROM gscored QUALIFY row_number() OVER (PARTITION BY port_name, op, gscored.f1, f2 ORDER BY
          coalesce(2.0 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0) DESC, l1, l2) = 1"""}


def top_doubles(r: Roles):
    return rules.double_rules(r.ranked.where(F.col("pos") < 3), PORT, 50)


@query("grid_optimize_rule", "port_name rule_id t1:6 t2:6 tp:i fp:i fn:i tn:i f1:6", "long ranked",
       "SELECT * FROM gbest", extra=_GRID)
def _(r: Roles):
    best = search.grid_optimize(top_doubles(r), r.long, PORT, 5)
    return best.withColumns({f"t{i + 1}": F.get("thresholds", F.lit(i)) for i in (0, 1)})


_MEAN_T = """SELECT port_name, feature, avg(threshold) AS threshold, round(avg(f1), 9) AS score FROM best_t
             GROUP BY port_name, feature"""


def _mean_thresholds(r: Roles):
    return r.best_thresholds.groupBy("port_name", "feature").agg(
        F.avg("threshold").alias("threshold"), F.round(F.avg("f1"), 9).alias("score"))


_DETAIL = """SELECT l.port_name, l.feature, place, threshold, count(*) FILTER (WHERE value > threshold AND y = 1)
    AS tp, count(*) FILTER (WHERE value > threshold AND y = 0) AS fp,
    count(*) FILTER (WHERE NOT coalesce(value > threshold, false) AND y = 1) AS fn,
    count(*) FILTER (WHERE NOT coalesce(value > threshold, false) AND y = 0) AS tn,
    avg(CASE WHEN value > threshold THEN 1 ELSE 0 END) AS fire_rate,
    avg(CASE WHEN value <= threshold THEN 1.0 WHEN value > threshold THEN 0 END) * 100 AS threshold_pct
    FROM long l JOIN (SELECT *, row_number() OVER (PARTITION BY port_name ORDER BY score DESC, feature)
      AS place FROM mean_t) m ON m.port_name = l.port_name AND m.feature = l.feature
    WHERE place <= {n} GROUP BY l.port_name, l.feature, place, threshold"""


@query("rule_detail", "port_name feature place:i threshold:6 tp:i fp:i fn:i tn:i fire_rate:6 "
       "threshold_pct:6", "best_t long", _DETAIL.format(n=3), extra={"mean_t": _MEAN_T})
def _(r: Roles):
    return search.rule_detail(_mean_thresholds(r), r.long, PORT, 3)


@query("baseline_compare", "port_name rule_id place:i mean_loss:6 loss_change_pct:6 f1_change_pct:6",
       "best_t long ranked exposure",
       """SELECT m.port_name, rule_id, place, mean_loss,
            coalesce((single_loss - mean_loss) / nullif(single_loss, 0), 0) * 100 AS loss_change_pct,
            coalesce((f1 - single_f1) / nullif(single_f1, 0), 0) * 100 AS f1_change_pct
          FROM (SELECT g.port_name, rule_id, f1, (tp + fp) * n_workers * daily_wage / 7 AS mean_loss,
                  row_number() OVER (PARTITION BY g.port_name ORDER BY (tp + fp) * n_workers * daily_wage / 7,
                    rule_id) AS place FROM gbest g JOIN exposure e ON e.port_name = g.port_name) m
          JOIN (SELECT d.port_name, (tp + fp) * n_workers * daily_wage / 7 AS single_loss,
                  coalesce(2.0 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0) AS single_f1
                FROM detail d JOIN exposure e ON e.port_name = d.port_name) s
          ON s.port_name = m.port_name WHERE place <= 3""",
       extra={**_GRID, "mean_t": _MEAN_T, "detail": _DETAIL.format(n=1)})
def _(r: Roles):
    def priced(df):
        loss = (F.col("tp") + F.col("fp")) * F.col("n_workers") * F.col("daily_wage") / 7
        return df.join(r.exposure, "port_name").withColumn("mean_loss", loss)
    multi = priced(search.grid_optimize(top_doubles(r), r.long, PORT, 5))
    single = priced(search.rule_detail(_mean_thresholds(r), r.long, PORT, 1))
    return search.compare_with_baseline(multi, single, PORT)


# ---- feature selection ----------------------------------------------------------------------

@query("select_mutual_info", "port_name feature score:6", "long",
       """SELECT port_name, feature, sum(n / total * ln(n * total / (nb * ny))) AS score FROM (
            SELECT *, CAST(sum(n) OVER (PARTITION BY port_name, feature) AS DOUBLE) AS total,
              sum(n) OVER (PARTITION BY port_name, feature, b) AS nb,
              sum(n) OVER (PARTITION BY port_name, feature, y) AS ny FROM (
              SELECT port_name, feature, b, y, count(*) AS n FROM (SELECT *, ntile(10) OVER (
                PARTITION BY port_name, feature ORDER BY coalesce(value, 0), date) AS b FROM long)
              GROUP BY ALL)) GROUP BY port_name, feature""")
def _(r: Roles):
    return selection.select_mutual_info(r.long, PORT)


_F = """SELECT port_name, feature, sum(n) AS n, count(*) AS classes,
    (sum(n * m * m) - sum(n) * power(sum(n * m) / sum(n), 2)) / (count(*) - 1)
      / (sum(n * v) / (sum(n) - count(*))) AS f_score
    FROM (SELECT port_name, feature, y, count(*) AS n, avg(coalesce(value, 0)) AS m,
      var_pop(coalesce(value, 0)) AS v FROM long GROUP BY ALL) GROUP BY port_name, feature"""


@query("f_scores", "port_name feature n:i classes:i f_score:6", "long", _F)
def _(r: Roles):
    return selection.f_scores(r.long, PORT)


# Tail of F(1, v) by the finite sums of Student's distribution: v is the days of a port less two.
_TAIL = {
    "tests": f"SELECT *, CAST(n - classes AS BIGINT) AS v, f_score / (f_score + n - classes) AS s2 FROM ({_F})",
    "series": """SELECT odd, k, product(CASE WHEN k = 0 THEN 1e0 WHEN odd = 1 THEN 2e0 * k / (2 * k + 1) ELSE (2e0 * k - 1) / (2 * k) END)
          OVER (PARTITION BY odd ORDER BY k) AS c
        FROM (SELECT unnest(range(0, (SELECT CAST(max(v) // 2 + 1 AS BIGINT) FROM tests))) AS k), (VALUES (0), (1)) o(odd)""",
    "tails": """SELECT port_name, feature, f_score, greatest(1 - CASE WHEN v % 2 = 0 THEN sqrt(s2) * total
            ELSE 2 / pi() * (asin(sqrt(s2)) + sqrt(s2 * (1 - s2)) * total) END, 0) AS p_value
        FROM (SELECT port_name, feature, any_value(f_score) AS f_score, any_value(v) AS v, any_value(s2) AS s2,
                fsum(c * power(1 - s2, k)) AS total
              FROM tests JOIN series ON odd = v % 2 AND k < v // 2 GROUP BY port_name, feature)""",
}


@query("select_f_test", "port_name feature f_score:6 p_value:9 score:6", "long",
       """SELECT *, 0.7 * f_score / (max(f_score) OVER w + 1e-6) + 0.3 * lp / (max(lp) OVER w + 1e-6) AS score
          FROM (SELECT *, -ln(p_value + 1e-10) AS lp FROM tails) WINDOW w AS (PARTITION BY port_name)""", _TAIL)
def _(r: Roles):
    return selection.select_f_test(r.long, PORT)


@query("p_value_udf", "port_name feature p_value:9", "long", "SELECT port_name, feature, p_value FROM tails", _TAIL)
def _(r: Roles):
    return selection.select_f_test(r.long, PORT)


def _boost_sql(patterns) -> str:
    return " * ".join(f"CASE WHEN regexp_matches(feature, '{p}') THEN {b} ELSE 1.0 END"
                      for p, b in patterns)


_CORR = """SELECT port_name, feature, coalesce(abs(corr(coalesce(value, 0), y)), 0) AS base_correlation
           FROM long GROUP BY port_name, feature"""
_DOMAIN = f"""SELECT port_name, feature, base_correlation, {_boost_sql(selection.DOMAIN_PATTERNS)} AS boost,
    base_correlation * {_boost_sql(selection.DOMAIN_PATTERNS)}
      * CASE WHEN contains(feature, '_max_') OR contains(feature, '_p9') THEN 1.2
        WHEN contains(feature, '_trend_') OR contains(feature, '_change_') THEN 1.15
        WHEN contains(feature, '_persistence_') THEN 1.1 ELSE 1.0 END AS score FROM ({_CORR})"""


@query("select_domain", "port_name feature base_correlation:6 boost:6 score:6", "long", _DOMAIN)
def _(r: Roles):
    return selection.select_domain(r.long, PORT)


_QUICK = f"""SELECT port_name, feature, base_correlation,
    base_correlation * {_boost_sql(selection.QUICK_PATTERNS)} AS score FROM ({_CORR})"""


@query("select_corr_boost", "port_name feature base_correlation:6 score:6", "long", _QUICK)
def _(r: Roles):
    return selection.select_corr_boost(r.long, PORT)


_LIST = """SELECT port_name, '{m}' AS method, feature, row_number() OVER (PARTITION BY port_name
    ORDER BY round(score, 9) DESC, feature) AS position FROM ({q}) QUALIFY position <= 5"""


@query("vote_features", "port_name feature score:6 method_count:i consensus:6 methods best_position:i "
       "avg_position:6 place:i", "long",
       """SELECT *, row_number() OVER (PARTITION BY port_name ORDER BY score DESC, feature) AS place
          FROM (SELECT port_name, feature, count(*) AS method_count, count(*) / 5.0 AS consensus,
                  sum(w * exp(-(position - 1) / 5.0)) * (1 + 0.2 * count(*) / 5.0) AS score,
                  string_agg(method, ', ' ORDER BY method) AS methods, min(position) AS best_position,
                  avg(position) AS avg_position
                FROM lists JOIN (VALUES ('mutual_info', 2.2), ('f_test', 1.8),
                  ('domain_selection', 3.0)) v(method, w) USING (method)
                GROUP BY port_name, feature HAVING count(*) >= 2)""",
       extra={"lists": " UNION ALL ".join([
           _LIST.format(m="domain_selection", q=_DOMAIN),
           _LIST.format(m="f_test", q=f"SELECT port_name, feature, f_score AS score FROM ({_F})"),
           _LIST.format(m="mutual_info", q="""SELECT port_name, feature,
             sum(n / total * ln(n * total / (nb * ny))) AS score FROM (
             SELECT *, CAST(sum(n) OVER (PARTITION BY port_name, feature) AS DOUBLE) AS total,
               sum(n) OVER (PARTITION BY port_name, feature, b) AS nb,
               sum(n) OVER (PARTITION BY port_name, feature, y) AS ny FROM (
               SELECT port_name, feature, b, y, count(*) AS n FROM (SELECT *, ntile(10) OVER (
                 PARTITION BY port_name, feature ORDER BY coalesce(value, 0), date) AS b FROM long)
               GROUP BY ALL)) GROUP BY port_name, feature""")])})
def _(r: Roles):
    f = selection.f_scores(r.long, PORT).withColumnRenamed("f_score", "score")
    lists = (selection.ranked_list(selection.select_domain(r.long, PORT), PORT, "domain_selection", 5)
             .unionByName(selection.ranked_list(f, PORT, "f_test", 5))
             .unionByName(selection.ranked_list(selection.select_mutual_info(r.long, PORT), PORT,
                                                "mutual_info", 5)))
    return selection.vote_features(lists, PORT)


@query("feature_selection", "port_name feature place:i", "long",
       f"""SELECT port_name, feature, row_number() OVER (PARTITION BY port_name
           ORDER BY round(score, 9) DESC, feature) AS place FROM ({_QUICK})""")
def _(r: Roles):
    return selection.feature_selection(r.long, PORT)


@query("select_forest", "port_name feature importance_mean:6 importance_std:6 score:6")
def _(r: Roles):
    return selection.select_forest(r.fan_days, PORT, FEATURES, "y", ["port_name", "date"])


@query("select_extra_trees", "port_name feature importance_mean:6 importance_std:6 score:6")
def _(r: Roles):
    return selection.select_extra_trees(r.fan_days, PORT, FEATURES, "y", ["port_name", "date"])
